"""Dataset-level report: one row of scores and labels over the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text_of, type_of
from ..sources.dictionary import Dictionary
from .profile import DatasetProfile, profile
from .quality import duplicate_rows, pattern_total
from .values import scalar_fields

# Thresholds of the report's labels.
RANDOM_ENTROPY, RANDOM_SHARE = 7.2, 0.45
STRUCTURED_ENTROPY, STRUCTURED_DUPLICATES, STRUCTURED_SHARE = 3.4, 5.0, 0.2
RISK_ROWS, RISK_UNIQUE_PCT, RISK_DISTINCT, RISK_DISTINCT_SHARE = 50, 92.0, 80, 0.4


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def dataset_report(fields: DataFrame, duplicates: DataFrame, pattern_hits: DataFrame | None = None) -> DataFrame:
    """One wide row from a profile table and its duplicate row.

    ``pattern_hits`` is the one-row result of :func:`pattern_total`; without it the
    column is NULL.
    """
    rows = F.greatest(F.col("dup.total_rows"), F.lit(1))
    held = _clamp(F.col("distinct_count").cast("double"), 1.0, float("inf"))
    diversity = F.log2(F.least(held, rows)) / F.log2(F.greatest(F.lit(2), rows))
    texty = F.col("inferred_semantic").isin("string", "mixed")
    near_key = (
        texty
        & (F.col("row_count") > 0)
        & (F.col("unique_pct") >= RISK_UNIQUE_PCT)
        & (F.col("distinct_count") > F.greatest(F.lit(RISK_DISTINCT), F.floor(RISK_DISTINCT_SHARE * F.col("row_count"))))
    )
    # One scalar subquery for both figures, so the duplicate count runs once.
    per_field = fields.withColumn("dup", duplicates.select(F.struct("total_rows", "duplicate_pct")).scalar())
    dated = F.sort_array(
        F.collect_list(F.when(F.col("inferred_semantic") == "datetime", F.struct("ord", "field")))
    )
    sums = per_field.agg(
        F.count(F.lit(1)).alias("column_count"),
        F.any_value("dup").alias("dup"),
        F.avg(diversity).alias("diversity"),
        (F.count_if("is_high_cardinality") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("high_share"),
        F.coalesce(F.sum(F.col("null_count") + F.col("empty_count")), F.lit(0)).alias("missing_cells"),
        F.count_if(F.col("inferred_semantic") == "numeric").alias("numeric_fields"),
        F.count_if(F.col("inferred_semantic") == "datetime").alias("datetime_fields"),
        F.max_by("field", F.struct(F.col("distinct_count"), -F.col("ord"))).alias("top_field"),
        F.max("distinct_count").alias("top_distinct"),
        F.min("num_min").alias("pooled_min"),
        F.max("num_max").alias("pooled_max"),
        F.avg("num_std_pop").alias("mean_std"),
        F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("iqr_outliers"),
        F.transform(dated, lambda s: s["field"]).alias("dated"),
        F.count_if(near_key).alias("near_keys"),
    )
    total, dup = F.col("dup.total_rows"), F.col("dup.duplicate_pct")
    entropy = F.when(total > 0, F.round(_clamp(F.col("diversity") * 10.0, 0.0, 10.0), 2)).otherwise(0.0)
    complete = F.when(
        (total > 0) & (F.col("column_count") > 0),
        F.round(_clamp(100.0 * (1.0 - F.col("missing_cells") / (total * F.col("column_count"))), 0.0, 100.0), 2),
    ).otherwise(100.0)
    both = F.col("pooled_min").isNotNull() & F.col("pooled_max").isNotNull()
    hits = F.lit(None).cast("bigint") if pattern_hits is None else pattern_hits.scalar()
    out = sums.select(
        total.alias("row_count"),
        "column_count",
        F.coalesce(entropy, F.lit(0.0)).alias("entropy_score"),
        "high_share",
        dup.alias("duplicate_pct"),
        complete.alias("completeness_pct"),
        F.when(total > 0, F.col("missing_cells")).otherwise(0).alias("missing_cells"),
        "numeric_fields",
        (F.col("column_count") - F.col("numeric_fields") - F.col("datetime_fields")).alias("text_fields"),
        "datetime_fields",
        F.coalesce("top_field", F.lit("(none)")).alias("highest_cardinality_field"),
        F.coalesce("top_distinct", F.lit(0)).alias("highest_cardinality"),
        F.when(both, F.col("pooled_min")).alias("numeric_min"),
        F.when(both, F.col("pooled_max")).alias("numeric_max"),
        F.when(both, F.col("mean_std")).alias("mean_std_pop"),
        "iqr_outliers",
        F.array_join("dated", ", ").alias("timeline_fields"),
        F.when(
            (total >= RISK_ROWS) & (F.col("near_keys") >= F.greatest(F.lit(2), F.floor(F.col("column_count") / 5))),
            "High",
        )
        .otherwise("Low")
        .alias("security_risk"),
        hits.alias("pattern_hits"),
    )
    structured = (
        (F.col("entropy_score") <= STRUCTURED_ENTROPY)
        & (F.col("duplicate_pct") <= STRUCTURED_DUPLICATES)
        & (F.col("high_share") <= STRUCTURED_SHARE)
    )
    randomized = (F.col("entropy_score") >= RANDOM_ENTROPY) | (F.col("high_share") >= RANDOM_SHARE)
    label = F.when(randomized, "randomized").when(structured, "structured").otherwise("unstructured")
    return out.withColumn("primary_characteristic", label)


SECTIONS = {
    "structure": ["row_count", "column_count", "completeness_pct", "missing_cells", "primary_characteristic"],
    "statistics": [
        "entropy_score", "numeric_fields", "text_fields", "datetime_fields", "highest_cardinality_field",
        "highest_cardinality", "numeric_min", "numeric_max", "mean_std_pop",
    ],
    "patterns": ["pattern_hits", "timeline_fields"],
    "anomalies": ["duplicate_pct", "iqr_outliers", "security_risk"],
}


def report_sections(report: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The report as ``(section, metric, value)`` rows, headed by the file facts if given."""

    def rows(table: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
        packed = [
            F.struct(
                F.lit(section).alias("section"), F.lit(m).alias("metric"),
                text_of(F.col(m), type_of(table, m)).alias("value"),
            )
            for section, metrics in sections.items()
            for m in metrics
        ]
        return table.select(F.inline(F.array(*packed)))

    body = rows(report, SECTIONS)
    return body if facts is None else rows(facts, {"file": facts.columns}).unionByName(body)


def report_of(df: DataFrame, dictionary: Dictionary, exact: bool = True, full: DatasetProfile | None = None) -> DataFrame:
    """Profile a table and report on it, pattern hits included.

    Patterns are looked for in all text fields by inference.  Which fields are text is
    part of the profile, so the profile is run first and its rows, one per
    field, are handed on; the table is not profiled again.
    """
    source = full.fields if full else profile(df, dictionary, exact)
    rows = source.collect()
    fields = df.sparkSession.createDataFrame(rows, source.schema)
    duplicates = full.duplicates if full else duplicate_rows(df, scalar_fields(df, dictionary.names))
    texty = {r["field"] for r in rows if r["inferred_semantic"] in ("string", "mixed")}
    ordered = [n for n in dictionary.names if n in texty]
    hits = pattern_total(df, ordered) if ordered else None
    return dataset_report(fields, duplicates, hits)
