"""Outliers, duplicates and pattern hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol, require_columns, safe_double, text_of, trim_text, type_of
from .percentiles import FINISH_ROWS, percentile_values
from .quickstats import one_row_per_field
from .values import dealt, key_of, parts_for, scalar_fields

QUARTILES = [0.25, 0.5, 0.75]
# Formats looked for at the start of (or as the whole of) a trimmed cell.
PATTERNS = {
    "iso_date": r"^\d{4}-\d{2}-\d{2}",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\z",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z",
}


def outlier_counts(x: Column, quartiles: Sequence[float | None]) -> Column:
    """Number of cells strictly outside the fences ``q -/+ 1.5 IQR``."""
    q1, q3 = quartiles[0], quartiles[2]
    if q1 is None or q3 is None:
        return F.count_if(F.lit(False))
    reach = 1.5 * (q3 - q1)
    return F.count_if((x < q1 - reach) | (x > q3 + reach))


def iqr_outliers(
    df: DataFrame, fields: Sequence[str], exact: bool = True, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """``(field, outlier_count, outlier_pct)`` by Tukey's fences; NULLs where there is no number."""
    require_columns(df, fields)
    quartiles = percentile_values(df, fields, QUARTILES, exact, finish_rows)
    per_field = {}
    for name in fields:
        x = safe_double(qcol(name), type_of(df, name))
        outside = outlier_counts(x, quartiles[name])
        per_field[name] = [
            F.when(F.count(x) > 0, outside).alias("outlier_count"),
            F.when(F.count(x) > 0, 100.0 * outside / F.count(x)).alias("outlier_pct"),
        ]
    return one_row_per_field(df, per_field)


def _groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows equal in the columns, with their number ``cnt``."""
    keys = df.select(*[key_of(qcol(c), type_of(df, c)).alias(f"k{i}") for i, c in enumerate(columns)])
    return dealt(keys, parts_for(df, columns)).groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("cnt"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(total_rows, distinct_full_rows, duplicate_extra_rows, duplicate_pct)``.

    Rows equal in all ``columns`` are copies of each other; NULLs are equal.  Copies
    are counted before the shuffle, so a row repeated everywhere moves once per task;
    texts take part by their digests.
    """
    columns = scalar_fields(df, columns)
    if not columns:
        groups = df.select(F.lit(1).cast("bigint").alias("cnt"))
    else:
        groups = _groups(df, columns)
    total = F.coalesce(F.sum("cnt"), F.lit(0))
    distinct = F.count(F.lit(1))
    return groups.agg(
        total.alias("total_rows"),
        distinct.alias("distinct_full_rows"),
        (total - distinct).alias("duplicate_extra_rows"),
        F.when(total > 0, 100.0 * (total - distinct) / total).otherwise(0.0).alias("duplicate_pct"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(total_rows, distinct_keys, duplicated_keys, duplicate_extra_rows, duplicate_pct)``."""
    require_columns(df, keys)
    groups = _groups(df, keys)
    total = F.coalesce(F.sum("cnt"), F.lit(0))
    distinct = F.count(F.lit(1))
    return groups.agg(
        total.alias("total_rows"),
        distinct.alias("distinct_keys"),
        F.count_if(F.col("cnt") > 1).alias("duplicated_keys"),
        (total - distinct).alias("duplicate_extra_rows"),
        F.when(total > 0, 100.0 * (total - distinct) / total).otherwise(0.0).alias("duplicate_pct"),
    )


def duplicated_key_values(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their row count ``cnt``."""
    require_columns(df, keys)
    return df.groupBy(*[qcol(k) for k in keys]).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)


def pattern_scan(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """``(field, pattern, hits)``: cells that look like ISO dates, IPv4 or e-mail addresses.

    One scan of all the fields, without a shuffle of rows.
    """
    per_field = {}
    for name in scalar_fields(df, fields):
        text = trim_text(text_of(qcol(name), type_of(df, name)))
        hits = [
            F.struct(F.lit(p).alias("pattern"), F.count_if(text.rlike("(?i)" + rx)).alias("hits"))
            for p, rx in PATTERNS.items()
        ]
        per_field[name] = [F.array(*hits).alias("found")]
    return one_row_per_field(df, per_field).select("field", F.inline("found"))


def pattern_total(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """``(pattern_hits)``: the hits of all patterns and fields added up."""
    return pattern_scan(df, fields).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("pattern_hits"))
