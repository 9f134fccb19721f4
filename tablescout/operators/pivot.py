"""Hierarchical pivot: subtotals per prefix of the row dimensions, totals, wide columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol, quoted, require_columns, safe_double, text_of, type_of

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}
MAX_COLUMNS = 10_000
# Up to so many wide columns are made by conditional aggregates, in one shuffle.
CONDITIONAL_COLUMNS = 200
PIVOT_FACTS = ["row_kind", "row_depth", "expandable", "ord"]
GRAND_TOTAL = "GRAND TOTAL"
GRAND_ROW = "Grand Total"


def _check(df, row_dims, col_dims, measures, agg) -> str:
    if not row_dims:
        raise ValueError("a pivot needs at least one row dimension")
    if not measures:
        raise ValueError("a pivot needs at least one measure")
    shared = sorted(set(row_dims) & set(col_dims))
    if shared:
        raise ValueError(f"dimensions both on rows and on columns: {shared}")
    if agg.strip().upper() not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; known: {sorted(AGGREGATES)}")
    require_columns(df, [*row_dims, *col_dims, *measures])
    return agg.strip().upper()


def _aggregate(df: DataFrame, measure: str, agg: str, here: Column | None = None) -> Column:
    """The aggregate of a measure over the rows where ``here`` holds; NULL if there are none."""
    if agg == "COUNT":
        return F.sum(F.lit(1.0) if here is None else F.when(here, 1.0))
    x = safe_double(qcol(measure), type_of(df, measure))
    return AGGREGATES[agg](x if here is None else F.when(here, x))


def pivot_leaves(
    df: DataFrame,
    row_dims: Sequence[str],
    col_dims: Sequence[str],
    measures: Sequence[str],
    agg: str = "SUM",
    condition: Column | None = None,
) -> DataFrame:
    """One row per combination of row and column dimensions.

    Column dimensions come out as text ``__c_<name>``, aggregates as ``__m_<measure>``;
    COUNT counts rows.
    """
    agg = _check(df, row_dims, col_dims, measures, agg)
    rows = df if condition is None else df.filter(condition)
    leaves = rows.groupBy(*[qcol(d) for d in [*row_dims, *col_dims]]).agg(
        *[_aggregate(df, m, agg).alias("__m_" + m) for m in measures]
    )
    return leaves.select(
        *[qcol(d) for d in row_dims],
        *[text_of(qcol(d), type_of(df, d)).alias("__c_" + d) for d in col_dims],
        *[qcol("__m_" + m) for m in measures],
    )


def pivot_keys(
    df: DataFrame, col_dims: Sequence[str], condition: Column | None = None, max_columns: int = MAX_COLUMNS
) -> list[tuple]:
    """The sorted tuples of the column dimensions' texts; NULLs first.

    Reads the column dimensions only.  More than ``max_columns`` is an error, as they all
    become columns; :func:`pivot_long` has no such bound.
    """
    if not col_dims:
        return [()]
    rows = df if condition is None else df.filter(condition)
    texts = [text_of(qcol(d), type_of(df, d)).alias(f"k{i}") for i, d in enumerate(col_dims)]
    found = rows.select(*texts).distinct().limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError(f"the pivot would have more than {max_columns} columns per measure; filter, use fewer or pivot_long")
    return sorted((tuple(r) for r in found), key=lambda k: [(v is not None, v or "") for v in k])


def wide_header(values: Sequence[str | None], col_dims: Sequence[str], measure: str, measures: int) -> str:
    """Header of a wide column: ``DIM-value`` pairs, the measure if there is no dimension or several measures."""
    pairs = " - ".join(f"{d}-{v or ''}" for d, v in zip(col_dims, values, strict=True))
    if not pairs:
        return measure
    return f"{pairs} · {measure}" if measures > 1 else pairs


def _wide_leaves(df: DataFrame, row_dims, col_dims, measures, agg: str, keys, headers) -> DataFrame:
    """Per row-dimension tuple ``r0..`` one column ``w0..`` per header, NULL-free.

    With few columns the aggregates are conditional, so rows are shuffled once; many
    columns are spread by Spark's own pivot over the leaves.
    """
    r = [qcol(d).alias(f"__r{i}") for i, d in enumerate(row_dims)]
    groups: dict[str, list[int]] = {}
    for k, key in enumerate(keys):
        for j, m in enumerate(measures):
            groups.setdefault(headers[(k, j)], []).append(k * len(measures) + j)
    if len(keys) * len(measures) <= CONDITIONAL_COLUMNS:
        cells = []
        for k, key in enumerate(keys):
            here = _same(df, col_dims, key)
            for j, m in enumerate(measures):
                cells.append(_aggregate(df, m, agg, here).alias(f"__v{k * len(measures) + j}"))
        wide = df.groupBy(*r).agg(*cells)
        cell = lambda i: F.col(f"__v{i}")
    else:
        number = F.create_map(*[c for k, key in enumerate(keys) for c in (_struct(key), F.lit(k))])
        place = F.element_at(number, F.struct(*[text_of(qcol(d), type_of(df, d)).alias(f"k{i}") for i, d in enumerate(col_dims)]))
        values = [_aggregate(df, m, agg).alias(f"v{j}") for j, m in enumerate(measures)]
        wide = df.groupBy(*r, place.alias("__key")).agg(*values).groupBy(*[F.col(f"__r{i}") for i in range(len(row_dims))])
        wide = wide.pivot("__key", list(range(len(keys)))).agg(*[F.first(f"v{j}").alias(f"v{j}") for j in range(len(measures))])
        one = len(measures) == 1
        cell = lambda i: F.col(quoted(f"{i}" if one else f"{i // len(measures)}_v{i % len(measures)}"))
    zero = F.lit(0.0)
    added = [
        reduce(lambda x, y: x + y, [F.coalesce(cell(i), zero) for i in members]).alias(f"__w{n}")
        for n, members in enumerate(groups.values())
    ]
    return wide.select(*[F.col(f"__r{i}") for i in range(len(row_dims))], *added)


def _struct(key: Sequence[str | None]) -> Column:
    return F.struct(*[F.lit(v).cast("string").alias(f"k{i}") for i, v in enumerate(key)])


def _same(df: DataFrame, col_dims: Sequence[str], key: Sequence[str | None]) -> Column | None:
    """Rows whose column dimensions read as ``key``; None if there is no dimension."""
    tests = [text_of(qcol(d), type_of(df, d)).eqNullSafe(F.lit(v).cast("string")) for d, v in zip(col_dims, key, strict=True)]
    return reduce(lambda x, y: x & y, tests) if tests else None


def pivot(
    df: DataFrame,
    row_dims: Sequence[str],
    col_dims: Sequence[str],
    measures: Sequence[str],
    agg: str = "SUM",
    condition: Column | None = None,
    keys: Sequence[tuple] | None = None,
    totals: str = "sum_of_leaves",
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """The pivot table in display order.

    Columns: row dimensions as text, wide columns (measure by measure, keys sorted),
    ``GRAND TOTAL`` if there is one measure, then ``row_kind``, ``row_depth``,
    ``expandable`` and ``ord``.  ``ord`` grows in display order but may have gaps.

    Subtotals and totals add up leaf values whatever the aggregate is; with
    ``totals="true"`` all of them, ``GRAND TOTAL`` included, aggregate the rows below
    them instead.  Column tuples with the same header, as of NULL and the empty text,
    share a column: their leaves add up, or their rows are aggregated together.
    """
    agg = _check(df, row_dims, col_dims, measures, agg)
    if totals not in ("sum_of_leaves", "true"):
        raise ValueError("totals is 'sum_of_leaves' or 'true'")
    n, one = len(row_dims), len(measures) == 1
    keys = [tuple(k) for k in keys] if keys is not None else pivot_keys(df, col_dims, condition, max_columns)
    rows = df if condition is None else df.filter(condition)
    headers = {(k, j): wide_header(key, col_dims, m, len(measures)) for k, key in enumerate(keys) for j, m in enumerate(measures)}
    names = list(dict.fromkeys(headers[(k, j)] for j in range(len(measures)) for k in range(len(keys))))
    if taken := sorted({*row_dims, *PIVOT_FACTS, GRAND_TOTAL} & set(names)):
        raise ValueError(f"headers that other columns have already: {taken}")
    r, g = [F.col(f"__r{i}") for i in range(n)], [f"__g{i}" for i in range(n)]
    if totals == "true":
        base = rows.select(*rows.columns, *[qcol(d).alias(f"__r{i}") for i, d in enumerate(row_dims)])
        cells = {}
        for (k, j), name in headers.items():
            here = _same(df, col_dims, keys[k])
            cells.setdefault((name, j), []).append(here)
        sums = []
        for (name, j), tests in cells.items():
            here = None if tests[0] is None else reduce(lambda x, y: x | y, tests)
            sums.append(F.coalesce(_aggregate(df, measures[j], agg, here), F.lit(0.0)).alias(name))
        if one:
            sums.append(F.coalesce(_aggregate(df, measures[0], agg), F.lit(0.0)).alias(GRAND_TOTAL))
    else:
        base = _wide_leaves(rows, row_dims, col_dims, measures, agg, keys, headers)
        order = list(dict.fromkeys(headers.values()))
        sums = [F.sum(f"__w{order.index(name)}").alias(name) for name in names]
        if one:
            every = [F.col(f"__w{i}") for i in range(len(order))]
            whole = F.aggregate(F.array(*every), F.lit(0.0), lambda s, x: s + x) if every else F.lit(0.0)
            base = base.withColumn("__all", whole)
            sums.append(F.sum("__all").alias(GRAND_TOTAL))
    prefixes = [r[:depth] for depth in range(n, -1, -1)]
    grouped = base.groupingSets(prefixes, *r).agg(*sums, *[F.grouping(c).alias(b) for c, b in zip(r, g, strict=True)])
    # Row dimensions become text only now, once per group.
    texts = [text_of(F.col(f"__r{i}"), type_of(df, d)).alias(f"__r{i}") for i, d in enumerate(row_dims)]
    shown = [qcol(c) for c in [*names, *([GRAND_TOTAL] if one else [])]]
    table = grouped.select(*texts, *g, *shown)
    grand = F.col(g[0]) == 1
    depth = sum((1 - F.col(b).cast("int") for b in g), F.lit(0))
    kind = F.when(grand, "grand").when(depth < n, "subtotal").otherwise("detail")
    labels = []
    for i, d in enumerate(row_dims):
        blank = F.lit(GRAND_ROW) if i == n - 1 else F.lit("")
        labels.append(F.when(F.col(g[i]) == 0, r[i]).when(grand, blank).otherwise("").alias(d))
    order_by = [F.col(g[0]).asc(), r[0].asc_nulls_first()]
    for i in range(1, n):
        order_by += [F.col(g[i]).desc(), r[i].asc_nulls_first()]
    return table.orderBy(*order_by).select(
        *labels,
        *shown,
        kind.alias("row_kind"),
        depth.cast("int").alias("row_depth"),
        (kind == "subtotal").alias("expandable"),
        F.monotonically_increasing_id().alias("ord"),
    )


def pivot_long(
    df: DataFrame,
    row_dims: Sequence[str],
    col_dims: Sequence[str],
    measures: Sequence[str],
    agg: str = "SUM",
    condition: Column | None = None,
) -> DataFrame:
    """The cells of the pivot as rows, for any number of column keys; none of them is collected.

    Row and column dimensions are texts, NULL above their level in subtotal rows;
    ``row_depth`` counts the row dimensions that a row names, and each measure adds up
    its leaves.
    """
    agg = _check(df, row_dims, col_dims, measures, agg)
    n = len(row_dims)
    leaves = pivot_leaves(df, row_dims, col_dims, measures, agg, condition)
    r = [f"__r{i}" for i in range(n)]
    columns = ["__c_" + d for d in col_dims]
    base = leaves.select(
        *[text_of(qcol(d), type_of(df, d)).alias(a) for d, a in zip(row_dims, r, strict=True)],
        *[qcol(c) for c in columns],
        *[F.coalesce(qcol("__m_" + m), F.lit(0.0)).alias("__m_" + m) for m in measures],
    )
    keys = [qcol(c) for c in columns]
    sets = [[*[F.col(c) for c in r[:depth]], *keys] for depth in range(n, -1, -1)]
    depth = sum((1 - F.grouping(c).cast("int") for c in r), F.lit(0))
    out = base.groupingSets(sets, *[F.col(c) for c in r], *keys).agg(
        *[F.sum(qcol("__m_" + m)).alias("__m_" + m) for m in measures], depth.cast("int").alias("row_depth")
    )
    return out.select(
        *[F.col(c).alias(d) for c, d in zip(r, row_dims, strict=True)],
        *[qcol(c).alias(d) for c, d in zip(columns, col_dims, strict=True)],
        *[qcol("__m_" + m).alias(m) for m in measures],
        "row_depth",
    )


def collapse(table: DataFrame, row_dims: Sequence[str], depth: int | None = None, nodes: Sequence[Sequence] = ()) -> DataFrame:
    """Hide rows under collapsed subtotals.

    ``depth=1`` collapses everything; ``nodes`` collapses single subtotals, each given
    by the labels that lead to it.  The grand total always stays.
    """
    hidden = F.lit(False)
    if depth is not None:
        hidden = hidden | (F.col("row_depth") > int(depth))
    for node in nodes:
        under = F.col("row_depth") > len(node)
        for d, label in zip(row_dims, node):
            under = under & qcol(d).eqNullSafe(F.lit(None if label is None else str(label)))
        hidden = hidden | under
    return table.filter((F.col("row_kind") == "grand") | ~hidden)
