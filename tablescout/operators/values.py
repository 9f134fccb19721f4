"""Value counts: the table behind distinct counts, top values and distributions.

Columns of one Spark type are unpivoted together and counted as ``(field, value)``
groups.  Counting is combined before the shuffle, so a value that fills a third of
a column costs one row per task.  Values keep their own type through the shuffle
and become text only afterwards, once per distinct value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_complex, qcol, require_columns, text_of, type_of

# Cells of one task that are counted by value at once: distinct ones take some 150 bytes each.
TASK_CELLS = 4_000_000


def _shared_type(dtype: T.DataType) -> T.DataType:
    """Type that columns of ``dtype`` are counted in; integers share one."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return T.StringType()
    return dtype


def scalar_fields(df: DataFrame, fields: Sequence[str] | None = None) -> list[str]:
    """The named columns, or every column that holds plain values.

    Arrays, maps, structs and binaries cannot be profiled: naming one is an error,
    and without names they are left out.
    """
    if fields is None:
        return [f.name for f in df.schema.fields if not is_complex(f.dataType)]
    require_columns(df, fields)
    bad = [n for n in fields if is_complex(df.schema[n].dataType)]
    if bad:
        raise ValueError(f"columns of complex type cannot be profiled: {bad}")
    return list(fields)


def families(df: DataFrame, fields: Sequence[str]) -> list[tuple[T.DataType, list[str]]]:
    """The fields by the type they are counted in."""
    found: dict[str, tuple[T.DataType, list[str]]] = {}
    for name in scalar_fields(df, fields):
        dtype = _shared_type(df.schema[name].dataType)
        found.setdefault(dtype.simpleString(), (dtype, []))[1].append(name)
    return list(found.values())


def parts_for(df: DataFrame, fields: Sequence[str]) -> int:
    """Tasks to deal the rows to before their cells are counted; 0 if no task holds more than ``TASK_CELLS`` cells.

    Counts are combined in the tasks that read the rows, and a small file of narrow rows is read by
    one of them however many cells it unfolds into.
    """
    held = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("held"))
    most, total = held.agg(F.coalesce(F.max("held"), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0))).first()
    return math.ceil(4 * total * len(fields) / TASK_CELLS) if most * len(fields) > TASK_CELLS else 0


def is_narrow(df: DataFrame, fields: Sequence[str]) -> bool:
    """Whether texts are shorter than a digest on average, so that dealing them moves no more than their keys."""
    texts = [F.coalesce(F.octet_length(qcol(n)), F.lit(0)) for n in fields if isinstance(type_of(df, n), T.StringType)]
    mean = df.agg(F.avg(sum(texts, F.lit(0)))).first()[0] if texts else None
    return mean is None or mean < 32 * len(texts)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The rows in so many tasks; as they are for 0.

    They go by a hash of their cells and of the task that read them, which stays the same if a task is
    run again; copies of a row that one task read stay together, as they were.
    """
    hashed = [qcol(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    return rows.repartition(parts, F.spark_partition_id(), F.xxhash64(*hashed)) if parts and hashed else rows


def dealt_if_narrow(df: DataFrame, fields: Sequence[str], parts: int) -> DataFrame | None:
    """The fields' columns in so many tasks; nothing if their texts are too long to be moved."""
    if not parts or not is_narrow(df, fields):
        return None
    return dealt(df.select(*[qcol(n) for n in dict.fromkeys(fields)]), parts)


def typed_counts(df: DataFrame, fields: Sequence[str]) -> list[tuple[T.DataType, DataFrame]]:
    """``(field, value, cnt)`` per type; NULL is counted as a value of its own."""
    out = []
    # Long texts are counted where they are read: moving them would move every copy.
    df = dealt_if_narrow(df, fields, parts_for(df, fields)) or df
    for dtype, names in families(df, fields):
        cols = [qcol(n).cast(dtype).alias(n) for n in names]
        long = df.select(*cols).unpivot([], [qcol(n) for n in names], "field", "value")
        out.append((dtype, long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("cnt"))))
    return out


def key_of(c: Column, dtype: T.DataType) -> Column:
    """What rows are grouped by to tell equal cells: a text by its SHA-256, or by itself where it is shorter than that.

    Digests have 32 bytes and such texts fewer, so the two never meet.
    """
    if not isinstance(dtype, T.StringType):
        return c
    return F.when(F.octet_length(c) < 32, c.cast("binary")).otherwise(F.unhex(F.sha2(c, 256)))


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, value, cnt)`` of all fields with values as text."""
    parts = [
        counts.select("field", text_of(F.col("value"), dtype).alias("value"), "cnt")
        for dtype, counts in typed_counts(df, fields)
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
