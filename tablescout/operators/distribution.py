"""Histograms and the value / bin distributions of the profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null, literal_rows, qcol, require_columns, safe_double, type_of
from ..functions.formats import bin_label
from .quickstats import ranked_top
from .values import scalar_fields, value_counts

NULL_LABEL = "(null)"
NOT_NUMERIC_LABEL = "(null or not numeric)"


def measure_bounds(df: DataFrame, fields: Sequence[str]) -> Column:
    """Map from field to ``(mn, mx, nn, n)``, one scan, to be used as a value in other plans.

    It is a scalar subquery: Spark runs it once, before the plan that uses it, and no
    join is needed to bring the bounds to the rows.
    """
    require_columns(df, fields)
    entries = []
    for name in fields:
        x = safe_double(qcol(name), type_of(df, name))
        entries += [
            F.lit(name),
            F.struct(
                F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("nn"), F.count(F.lit(1)).alias("n")
            ),
        ]
    return df.agg(F.create_map(*entries).alias("bounds")).scalar()


def _bin_counts(df: DataFrame, fields: Sequence[str], bins: int, bounds: Column) -> DataFrame:
    """``(field, bin, cnt, mn, mx)`` of the non-empty bins."""
    last = max(1, int(bins)) - 1
    with_bounds = df.select(
        *[safe_double(qcol(n), type_of(df, n)).alias(f"x{i}") for i, n in enumerate(fields)],
        bounds.alias("bounds"),
    )
    indexes = []
    for i, name in enumerate(fields):
        x = F.col(f"x{i}")
        b = F.col("bounds").getItem(name)
        usable = finite_or_null(b["mn"]).isNotNull() & finite_or_null(b["mx"]).isNotNull()
        width = (b["mx"] - b["mn"]) / F.lit(float(last + 1))
        place = F.least(F.lit(last), F.greatest(F.lit(0), F.floor((x - b["mn"]) / width).cast("int")))
        indexes.append(
            F.when(usable & x.isNotNull(), F.when(b["mn"] == b["mx"], 0).otherwise(place)).alias(f"b{i}")
        )
    labels = F.create_map(*[p for i, n in enumerate(fields) for p in (F.lit(f"b{i}"), F.lit(n))])
    counts = (
        with_bounds.select(*indexes)
        .unpivot([], [f"b{i}" for i in range(len(fields))], "code", "bin")
        .filter(F.col("bin").isNotNull())
        .groupBy("code", "bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.element_at(labels, F.col("code")).alias("field"), "bin", "cnt", bounds.alias("bounds"))
        .withColumn("b", F.element_at("bounds", F.col("field")))
    )
    return counts.select("field", "bin", "cnt", F.col("b.mn").alias("mn"), F.col("b.mx").alias("mx"))


def histogram(df: DataFrame, fields: Sequence[str], bins: int = 200, bounds: Column | None = None) -> DataFrame:
    """``(field, bin, lo, hi, cnt)`` of the non-empty equal-width bins.

    A constant column has one bin; a column without finite bounds has none.
    """
    width = (F.col("mx") - F.col("mn")) / F.lit(float(max(1, int(bins))))
    one = F.col("mn") == F.col("mx")
    lo = F.when(one, F.col("mn")).otherwise(F.col("mn") + F.col("bin") * width)
    hi = F.when(one, F.col("mx")).otherwise(lo + width)
    table = _bin_counts(df, fields, bins, measure_bounds(df, fields) if bounds is None else bounds)
    return table.select("field", "bin", lo.alias("lo"), hi.alias("hi"), "cnt")


def _tail(kind: str, label: str, cnt: Column, place: int) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(label).alias("label"), cnt.alias("cnt"), F.lit(place).alias("ord")
    )


# The tables of tails hold one row per field, so broadcasting them is safe at any size.
def _with_tails(top: DataFrame, tails: DataFrame) -> DataFrame:
    """Append ``(field, kind, label, cnt, ord)`` tail rows after the ranked rows."""
    rest = tails.select("field", F.inline("tails")).select(
        "field",
        "kind",
        "label",
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        "cnt",
        "ord",
    )
    return top.select("field", "kind", "label", "lo", "hi", "cnt", "ord").unionByName(rest)


def bin_distribution(df: DataFrame, fields: Sequence[str], bins: int = 200, top: int = 50) -> DataFrame:
    """The ``top`` densest of ``bins`` bins per measure, then Others, not-numeric and Total rows.

    A field has at most ``bins`` rows once they are counted, so ranking them and
    putting the tail rows behind them happens in one go per field.
    """
    bounds = measure_bounds(df, fields)
    bars = histogram(df, fields, bins, bounds)
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("cnt"), F.asc("lo")))
    place = F.col("rank") <= int(top)
    label = bin_label(F.col("lo"), F.col("hi"))
    bar = F.struct(F.col("rank").alias("ord"), F.lit("bin").alias("kind"), label.alias("label"), "lo", "hi", "cnt")
    per_field = (
        bars.withColumn("rank", rank)
        .groupBy("field")
        .agg(F.collect_list(F.when(place, bar)).alias("bars"), F.sum(F.when(place, F.col("cnt"))).alias("kept"))
    )
    facts = (
        literal_rows(df.sparkSession, ["field"], [(n,) for n in fields])
        .join(F.broadcast(per_field), "field", "left")
        .select("field", "bars", "kept", F.element_at(bounds, F.col("field")).alias("b"))
    )

    def tail(kind: str, text: str, cnt: Column, after: int):
        edge = F.lit(None).cast("double")
        return F.struct(
            F.lit(top + after).alias("ord"), F.lit(kind).alias("kind"), F.lit(text).alias("label"),
            edge.alias("lo"), edge.alias("hi"), cnt.alias("cnt"),
        )

    others, absent = F.col("b.nn") - F.col("kept"), F.col("b.n") - F.col("b.nn")
    tails = F.array(
        F.when(others > 0, tail("others", "Others", others, 1)),
        F.when(F.col("kept").isNotNull() & (absent > 0), tail("not_numeric", NOT_NUMERIC_LABEL, absent, 2)),
        tail("total", "Total", F.col("b.n"), 3),
    )
    rows = F.when(F.col("bars").isNull(), F.array_compact(tails)).otherwise(F.concat("bars", F.array_compact(tails)))
    return facts.select("field", F.inline(rows)).select("field", "kind", "label", "lo", "hi", "cnt", "ord")


def value_distribution(df: DataFrame, fields: Sequence[str] | None = None, top: int = 50) -> DataFrame:
    """The ``top`` most frequent values per dimension, then Others and Total rows.

    NULL counts as a value, labelled ``(null)`` and told from real text by its kind.
    """
    fields = scalar_fields(df, fields)
    counts = value_counts(df, fields).select(
        "field",
        F.when(F.col("value").isNull(), "null").otherwise("value").alias("kind"),
        F.coalesce(F.col("value"), F.lit(NULL_LABEL)).alias("label"),
        "cnt",
    )
    shown = ranked_top(counts, top, tie="label").select(
        "field",
        "kind",
        "label",
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        "cnt",
        F.col("rank").cast("int").alias("ord"),
    )
    kept = shown.groupBy("field").agg(F.sum("cnt").alias("kept"))
    total = counts.groupBy("field").agg(F.sum("cnt").alias("n"))
    names = literal_rows(df.sparkSession, ["field"], [(n,) for n in fields])
    facts = names.join(F.broadcast(total), "field", "left").join(F.broadcast(kept), "field", "left").na.fill(0, ["n", "kept"])
    others = F.col("n") - F.col("kept")
    tails = facts.select(
        "field",
        F.array_compact(
            F.array(
                F.when(others > 0, _tail("others", "Others", others, top + 1)),
                _tail("total", "Total", F.col("n"), top + 2),
            )
        ).alias("tails"),
    )
    return _with_tails(shown, tails)
