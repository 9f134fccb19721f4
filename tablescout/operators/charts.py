"""Aggregations behind the charts: bar, line, pie, stacked bar, scatter, histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol, require_columns, safe_double, type_of

BINS = 10
# How many dimensions and measures each chart needs.
SHAPES = {
    "bar": (1, 1),
    "line": (1, 1),
    "pie": (1, 1),
    "scatter": (1, 1),
    "stacked_bar": (2, 1),
    "histogram": (0, 1),
}


def check_shape(chart: str, dims: Sequence[str], measures: Sequence[str]) -> None:
    """Raise when a chart lacks the dimensions or measures it needs."""
    if chart not in SHAPES:
        raise ValueError(f"unknown chart {chart!r}; known: {sorted(SHAPES)}")
    need_dims, need_measures = SHAPES[chart]
    if len(dims) < need_dims or len(measures) < need_measures:
        raise ValueError(f"a {chart} chart needs {need_dims} dimension(s) and {need_measures} measure(s)")


def _number(df: DataFrame, name: str):
    return safe_double(qcol(name), type_of(df, name))


def _per_first_dim(df, chart, dims, measures, agg) -> DataFrame:
    check_shape(chart, dims, measures)
    require_columns(df, list(dims) + list(measures))
    aggs = [agg(_number(df, m)).alias(m) for m in measures]
    return df.groupBy(qcol(dims[0])).agg(*aggs)


def chart_sum(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Bar and line data: the sum of each measure per first dimension, in dimension order."""
    return _per_first_dim(df, "bar", dims, measures, F.sum).orderBy(qcol(dims[0]).asc_nulls_last())


def chart_avg(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Scatter data: the mean of each measure per first dimension, in dimension order."""
    return _per_first_dim(df, "scatter", dims, measures, F.avg).orderBy(qcol(dims[0]).asc_nulls_last())


def chart_pie(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Pie data: the sum of the first measure per first dimension, largest slice first."""
    slices = _per_first_dim(df, "pie", dims, measures[:1], F.sum)
    return slices.orderBy(qcol(measures[0]).desc_nulls_last(), qcol(dims[0]).asc_nulls_last())


def chart_stacked(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Stacked-bar data: the sum of the first measure per pair of dimensions, as ``agg_value``."""
    check_shape("stacked_bar", dims, measures)
    require_columns(df, list(dims[:2]) + list(measures[:1]))
    pair = [qcol(d) for d in dims[:2]]
    return (
        df.groupBy(*pair)
        .agg(F.sum(_number(df, measures[0])).alias("agg_value"))
        .orderBy(*[d.asc_nulls_last() for d in pair])
    )


def chart_histogram(df: DataFrame, measure: str, bins: int = BINS) -> DataFrame:
    """``(bin_idx, cnt, bin_min, bin_max)`` of the non-empty bins between equally spaced edges.

    Bins are closed on the left, the last one on both sides.  A measure without a
    range is an error, raised when the data is read.
    """
    require_columns(df, [measure])
    x = _number(df, measure)
    low, high = F.min(x), F.max(x)
    problem = F.raise_error(F.lit(f"a histogram of {measure} needs numbers with a range"))
    edges = F.array(*[low + F.lit(float(i)) * ((high - low) / F.lit(float(bins))) for i in range(bins)], high)
    bounds = df.agg(F.when(low < high, edges).otherwise(problem.cast("array<double>")).alias("edges")).scalar()
    at = F.col("edges")
    place = F.when((F.col("x") >= at[0]) & (F.col("x") < at[1]), 0)
    for i in range(1, bins):
        upper = F.col("x") <= at[i + 1] if i == bins - 1 else F.col("x") < at[i + 1]
        place = place.when((F.col("x") >= at[i]) & upper, i)
    return (
        df.select(x.alias("x"), bounds.alias("edges"))
        .select(place.alias("bin_idx"))
        .filter(F.col("bin_idx").isNotNull())
        .groupBy("bin_idx")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("bin_idx", "cnt", bounds.alias("edges"))
        .select("bin_idx", "cnt", at[F.col("bin_idx")].alias("bin_min"), at[F.col("bin_idx") + 1].alias("bin_max"))
        .orderBy("bin_idx")
    )
