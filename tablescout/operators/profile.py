"""The full profile of a table, one row per field."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    boolean_like,
    finite_or_null,
    is_temporal,
    literal_rows,
    qcol,
    safe_double,
    safe_timestamp,
    trim_text,
    type_of,
)
from ..sources.dictionary import Dictionary
from .distribution import bin_distribution, value_distribution
from .percentiles import FINISH_ROWS, literal_double, percentile_values
from .quality import QUARTILES, duplicate_rows, outlier_counts
from .quickstats import one_row_per_field
from .values import dealt, dealt_if_narrow, families, key_of, parts_for, scalar_fields

NUMERIC_BLOCK = ["num_min", "num_max", "num_mean", "num_median", "num_std_pop", "num_var_pop"]
OUTLIER_BLOCK = ["outlier_count", "outlier_pct"]


def _reads(c: Column, dtype: T.DataType) -> dict[str, Column]:
    """What a non-NULL cell reads as, of which only text needs parsing."""
    text, yes, no = isinstance(dtype, T.StringType), F.lit(True), F.lit(False)
    number = isinstance(dtype, (T.NumericType, T.BooleanType))
    fractional = isinstance(dtype, (T.DoubleType, T.FloatType))
    return {
        "empty": trim_text(c) == "" if text else no,
        "boolean": no if fractional or is_temporal(dtype) else boolean_like(c, dtype),
        "numeric": safe_double(c, dtype).isNotNull() if text else yes if number else no,
        "timestamp": safe_timestamp(c, dtype).isNotNull() if text else yes if is_temporal(dtype) else no,
    }


def _facts(df: DataFrame, names: Sequence[str], dtype: T.DataType, parts: int = 0) -> DataFrame:
    """Counts per field of one type; rows' keys are dealt to ``parts`` tasks first, if given.

    Cells are counted by value (texts by digest) with what they read as, so a value
    costs one small row per task however long or frequent it is.
    """
    cells = []
    for name in names:
        c = qcol(name).cast(dtype)
        flags = [F.coalesce(c.isNotNull() & reads, F.lit(False)).alias(k) for k, reads in _reads(c, dtype).items()]
        cells.append(F.struct(F.lit(name).alias("field"), key_of(c, dtype).alias("value"), *flags))
    kinds = ["empty", "boolean", "numeric", "timestamp"]
    unfolded = F.array(*cells)
    if parts:
        df, unfolded = dealt(df.select(unfolded.alias("cells")), parts), F.col("cells")
    counts = df.select(F.inline(unfolded)).groupBy("field", "value", *kinds).agg(F.count(F.lit(1)).alias("cnt"))

    def weight(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("cnt")).otherwise(0))

    return counts.groupBy("field").agg(
        F.sum("cnt").alias("row_count"),
        weight(F.col("value").isNull()).alias("null_count"),
        F.count("value").alias("distinct_count"),
        *[weight(F.col(k)).alias(f"{k}_count") for k in kinds],
    )


def base_metrics(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Counts, missing and unique shares, and parse ratios of every field.

    Everything comes from the value counts: one shuffle for all columns of a type.
    """
    fields = scalar_fields(df, fields)
    parts = parts_for(df, fields)
    if rows := dealt_if_narrow(df, fields, parts):
        df, parts = rows, 0
    facts = [_facts(df, names, dtype, parts) for dtype, names in families(df, fields)]
    table = facts[0]
    for part in facts[1:]:
        table = table.unionByName(part)
    names = literal_rows(df.sparkSession, ["field"], [(n,) for n in fields])
    # One row per field on the broadcast side, however large the table is.
    facts = names.join(F.broadcast(table), "field", "left").na.fill(0)
    rows, present = F.col("row_count"), F.col("row_count") - F.col("null_count")
    share = lambda c: F.when(present > 0, F.col(c) / present).otherwise(0.0)
    return facts.select(
        "field",
        "row_count",
        "null_count",
        "empty_count",
        (100.0 * (F.col("null_count") + F.col("empty_count")) / F.greatest(rows, F.lit(1))).alias("missing_pct"),
        "distinct_count",
        (100.0 * F.col("distinct_count") / F.greatest(rows, F.lit(1))).alias("unique_pct"),
        (F.col("distinct_count") > F.greatest(F.lit(50), F.floor(0.2 * rows))).alias("is_high_cardinality"),
        share("boolean_count").alias("boolean_ratio"),
        share("numeric_count").alias("numeric_ratio"),
        share("timestamp_count").alias("timestamp_ratio"),
    )


def infer_semantic(role: Column, field_type: Column) -> Column:
    """boolean, datetime, string, mixed or numeric, from the ratios of :func:`base_metrics`."""
    return (
        F.when(F.col("distinct_count").between(1, 2) & (F.col("boolean_ratio") >= 0.95), "boolean")
        .when((role == "D") & (F.col("timestamp_ratio") >= 0.9), "datetime")
        .when(role == "D", "string")
        .when((F.lower(field_type) == "char") & (F.col("numeric_ratio") < 0.5), "mixed")
        .otherwise("numeric")
    )


def numeric_metrics(
    df: DataFrame, fields: Sequence[str], exact: bool = True, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """``(field, num_min .. num_var_pop)`` over the cells that are numbers; non-finite results are NULL."""
    return measure_facts(df, fields, exact, finish_rows).select("field", *NUMERIC_BLOCK)


def measure_facts(
    df: DataFrame, fields: Sequence[str], exact: bool = True, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """Numeric block and outliers: quartiles are searched for first, everything else takes one scan."""
    quartiles = percentile_values(df, fields, QUARTILES, exact, finish_rows)
    per_field = {}
    for name in fields:
        x = safe_double(qcol(name), type_of(df, name))
        middle = literal_double(quartiles[name][1])
        values = [F.min(x), F.max(x), F.avg(x), middle, F.stddev_pop(x), F.var_pop(x)]
        outside = outlier_counts(x, quartiles[name])
        per_field[name] = [
            *[finite_or_null(v).alias(c) for v, c in zip(values, NUMERIC_BLOCK)],
            F.when(F.count(x) > 0, outside).alias("outlier_count"),
            F.when(F.count(x) > 0, 100.0 * outside / F.count(x)).alias("outlier_pct"),
        ]
    return one_row_per_field(df, per_field)


def profile(df: DataFrame, dictionary: Dictionary, exact: bool = True) -> DataFrame:
    """One row per dictionary field, in the layout of the profile table."""
    fields = scalar_fields(df, dictionary.names)
    measures = [f.name for f in dictionary.fields if f.role == "M"]
    hints = literal_rows(
        df.sparkSession,
        ["ord", "field", "meta_type", "role", "spark_type"],
        [(i, f.name, f.field_type, f.role, type_of(df, f.name).simpleString()) for i, f in enumerate(dictionary.fields)],
    )
    table = hints.join(F.broadcast(base_metrics(df, fields)), "field")
    if measures:
        table = table.join(F.broadcast(measure_facts(df, measures, exact)), "field", "left")
    else:
        for c in NUMERIC_BLOCK + ["outlier_pct"]:
            table = table.withColumn(c, F.lit(None).cast("double"))
        table = table.withColumn("outlier_count", F.lit(None).cast("bigint"))
    return table.select(
        "field",
        "meta_type",
        "role",
        infer_semantic(F.col("role"), F.col("meta_type")).alias("inferred_semantic"),
        F.when(F.col("row_count") > F.col("null_count"), F.col("spark_type")).otherwise("NULL").alias("type_sample"),
        "row_count",
        "null_count",
        "empty_count",
        "missing_pct",
        "distinct_count",
        "unique_pct",
        "is_high_cardinality",
        *NUMERIC_BLOCK,
        *OUTLIER_BLOCK,
        "ord",
    )


@dataclass(frozen=True)
class DatasetProfile:
    """The four tables of a full profile."""

    fields: DataFrame
    distributions: DataFrame
    duplicates: DataFrame
    dictionary: Dictionary


def profile_dataset(
    df: DataFrame, dictionary: Dictionary, bins: int = 200, top: int = 50, exact: bool = True
) -> DatasetProfile:
    """Profile, distributions by role and duplicate rows of a table."""
    names = scalar_fields(df, dictionary.names)
    dims = [f.name for f in dictionary.fields if f.role == "D"]
    measures = [f.name for f in dictionary.fields if f.role == "M"]
    parts = []
    if dims:
        parts.append(value_distribution(df, dims, top))
    if measures:
        parts.append(bin_distribution(df, measures, bins, top))
    distributions = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return DatasetProfile(profile(df, dictionary, exact), distributions, duplicate_rows(df, names), dictionary)
