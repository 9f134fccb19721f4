"""Quick statistics per column: top values, numeric summaries, date ranges."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_complex, is_temporal, qcol, require_columns, safe_double, text_of, type_of
from ..functions.formats import round_measure, yyyymmdd
from ..sources.dictionary import Dictionary
from .percentiles import FINISH_ROWS, literal_double, percentile_values
from .values import scalar_fields, typed_counts

TOP_VALUES = 15
SLICES = 32
NUMBERS = ["min", "max", "sum", "mean", "median"]


def one_row_per_field(df: DataFrame, per_field: dict[str, list[Column]]) -> DataFrame:
    """Aggregate the whole table once and turn the single wide row into one row per field."""
    wide, structs = [], []
    for i, (name, aggs) in enumerate(per_field.items()):
        packed = F.struct(F.lit(name).alias("field"), *aggs)
        wide.append(packed.alias(f"f{i}"))
        structs.append(F.col(f"f{i}"))
    return df.agg(*wide).select(F.inline(F.array(*structs)))


def ranked_top(counts: DataFrame, n: int, tie: str = "value") -> DataFrame:
    """The ``n`` most frequent rows per field with their ``rank``; ties by ``tie``.

    Rows of a field are ranked in ``SLICES`` slices first, and what can still be among
    the ``n`` of the field is ranked once more, so no task sorts a whole field however
    large ``n`` is.
    """
    order = [F.desc("cnt"), F.asc(tie)]
    slice_of = F.pmod(F.xxhash64(tie), F.lit(SLICES))
    best = F.row_number().over(Window.partitionBy("field", "slice").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(*order))
    near = counts.withColumn("slice", slice_of).withColumn("best", best).filter(F.col("best") <= int(n)).drop("slice", "best")
    return near.withColumn("rank", rank).filter(F.col("rank") <= int(n))


def quick_top(
    df: DataFrame,
    fields: Sequence[str] | None = None,
    n: int = TOP_VALUES,
    days: Iterable[str] = (),
    by_day: bool = False,
) -> DataFrame:
    """``(field, value, cnt, rank)``: the ``n`` most frequent non-NULL values per field.

    Fields in ``days`` show their values as YYYYMMDD; they are still counted by the raw
    value unless ``by_day`` is set.
    """
    fields = scalar_fields(df, fields)
    days = set(days)
    shown = []
    for dtype, counts in typed_counts(df, fields):
        value = F.col("value")
        counts = counts.filter(value.isNotNull())
        is_day = F.col("field").isin(sorted(days)) if days else F.lit(False)
        raw = text_of(value, dtype)
        label = F.when(is_day, yyyymmdd(value, dtype)).otherwise(raw) if days else raw
        if by_day and days:
            counts = counts.groupBy("field", label.alias("value")).agg(F.sum("cnt").alias("cnt"))
            shown.append(counts.select("field", "value", "cnt", F.col("value").alias("raw")))
        else:
            shown.append(counts.select("field", label.alias("value"), "cnt", raw.alias("raw")))
    table = shown[0]
    for part in shown[1:]:
        table = table.unionByName(part)
    return ranked_top(table, n, tie="raw").select("field", "value", "cnt", F.col("rank").cast("int").alias("rank"))


def quick_num(
    df: DataFrame, fields: Sequence[str], exact: bool = True, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """``(field, null_count, min, max, sum, mean, median)``; NaN where there is no number.

    The median is searched for first, everything else takes one scan.
    """
    require_columns(df, fields)
    middle = percentile_values(df, fields, [0.5], exact, finish_rows)
    per_field = {}
    for name in fields:
        x = safe_double(qcol(name), type_of(df, name))
        nan = F.lit(float("nan"))
        per_field[name] = [
            F.count_if(qcol(name).isNull()).alias("null_count"),
            F.coalesce(F.min(x), nan).alias("min"),
            F.coalesce(F.max(x), nan).alias("max"),
            F.coalesce(F.sum(x), nan).alias("sum"),
            F.coalesce(F.avg(x), nan).alias("mean"),
            F.coalesce(literal_double(middle[name][0]), nan).alias("median"),
        ]
    return one_row_per_field(df, per_field)


def quick_date(df: DataFrame, fields: Sequence[str], days: Iterable[str] | None = None) -> DataFrame:
    """``(field, null_count, min_value, max_value)`` as text; fields in ``days`` as YYYYMMDD.

    ``days`` defaults to the date and timestamp columns.
    """
    require_columns(df, fields)
    chosen = set(days) if days is not None else {n for n in fields if is_temporal(type_of(df, n))}
    per_field = {}
    for name in fields:
        dtype = type_of(df, name)

        def shown(c: Column, name=name, dtype=dtype) -> Column:
            text = yyyymmdd(c, dtype) if name in chosen else text_of(c, dtype)
            return F.when(c.isNotNull(), text)

        per_field[name] = [
            F.count_if(qcol(name).isNull()).alias("null_count"),
            shown(F.min(qcol(name))).alias("min_value"),
            shown(F.max(qcol(name))).alias("max_value"),
        ]
    return one_row_per_field(df, per_field)


def null_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, null_count)`` of all fields in one scan."""
    require_columns(df, fields)
    return one_row_per_field(
        df, {n: [F.count_if(qcol(n).isNull()).alias("null_count")] for n in fields}
    )


def quick_stats(
    df: DataFrame, dictionary: Dictionary, n: int = TOP_VALUES, exact: bool = True, places: int | None = None
) -> dict[str, DataFrame]:
    """Quick statistics of every field by its bucket: ``top``, ``num`` and ``nulls`` tables.

    Display-only fields and fields the table lacks are left out, and with a warning those
    that hold no plain values.  ``places`` rounds the numbers of the measures.
    """
    present = [f for f in dictionary.fields if f.name in df.columns and f.stats_bucket != "skip"]
    bad = [f.name for f in present if is_complex(type_of(df, f.name))]
    if bad:
        logging.getLogger(__name__).warning("no quick statistics for columns without plain values: %s", bad)
        present = [f for f in present if f.name not in bad]
    char = [f for f in present if f.stats_bucket == "char"]
    num = [f for f in present if f.stats_bucket == "num"]
    out: dict[str, DataFrame] = {}
    if char:
        out["top"] = quick_top(df, [f.name for f in char], n, days=[f.name for f in char if f.shows_as_day])
    if num:
        out["num"] = quick_num(df, [f.name for f in num], exact)
        if places is not None:
            out["num"] = round_measures(out["num"], dictionary, places)
    if char or num:
        out["nulls"] = null_counts(df, [f.name for f in char + num])
    return out


def round_measures(table: DataFrame, dictionary: Dictionary, places: int = 2) -> DataFrame:
    """Round the ``quick_num`` figures of measure fields; other fields stay as they are."""
    measures = [f.name for f in dictionary.fields if f.role == "M"]
    chosen = F.col("field").isin(measures) if measures else F.lit(False)
    return table.select(
        *[
            F.when(chosen, round_measure(F.col(c), places)).otherwise(F.col(c)).alias(c)
            if c in NUMBERS and isinstance(table.schema[c].dataType, T.DoubleType)
            else F.col(c)
            for c in table.columns
        ]
    )
