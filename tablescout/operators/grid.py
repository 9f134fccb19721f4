"""Row views: visible columns, order, pages."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_complex, is_temporal, qcol, require_columns, text_of, type_of
from ..sources.dictionary import Dictionary
from .filters import chart_number

PAGE_SIZE = 100
# Sort keys of so many rows are ranked at once; places further down are narrowed first, by the same order.
RANKED_ROWS = 100_000
SAMPLE_ROWS = 5_000

SortKey = tuple[str, bool]


def row_count(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """``(row_count)`` of the table or of the rows that meet a condition."""
    rows = df if condition is None else df.filter(condition)
    return rows.agg(F.count(F.lit(1)).alias("row_count"))


def visible_columns(
    dictionary: Dictionary, visible: Sequence[str] | None = None, sort_names: bool = False
) -> list[str]:
    """Columns to show, in dictionary order or by name; keys always stay."""
    shown = set(dictionary.names if visible is None else visible) | set(dictionary.keys)
    names = [n for n in dictionary.names if n in shown]
    return sorted(names, key=str.lower) if sort_names else names


def project(
    df: DataFrame, dictionary: Dictionary, visible: Sequence[str] | None = None, sort_names: bool = False
) -> DataFrame:
    return df.select(*[qcol(n) for n in visible_columns(dictionary, visible, sort_names)])


def sort_keys(user: Sequence[SortKey], keys: Sequence[str]) -> list[SortKey]:
    """User keys (the first mention counts), then the key columns not among them, ascending."""
    order: dict[str, bool] = {}
    for name, ascending in [*user, *[(k, True) for k in keys]]:
        order.setdefault(name, ascending)
    return list(order.items())


def grid_order(df: DataFrame, user: Sequence[SortKey] = (), keys: Sequence[str] = ()) -> list[Column]:
    """Order-by columns of the grid, NULLs last both ways; the first column if nothing is given."""
    order = sort_keys(user, keys) or [(df.columns[0], True)]
    require_columns(df, [n for n, _ in order])
    return [qcol(n).asc_nulls_last() if up else qcol(n).desc_nulls_last() for n, up in order]


def page_count(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, math.ceil(total / max(1, size)))


def canonical(c: Column, dtype: T.DataType) -> Column:
    """A text that is equal for equal cells only, for types that have no order of their own too."""
    if isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.struct(canonical(e["key"], dtype.keyType).alias("k"), canonical(e["value"], dtype.valueType).alias("v")),
        )
        return F.to_json(F.array_sort(pairs), {"ignoreNullFields": "false"})
    if isinstance(dtype, T.ArrayType):
        return F.to_json(F.transform(c, lambda x: canonical(x, dtype.elementType)))
    if isinstance(dtype, T.StructType):
        cells = [canonical(c.getField(f.name), f.dataType) for f in dtype.fields]
        return F.when(c.isNotNull(), F.to_json(F.array(*cells)) if cells else F.lit("[]"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def row_digest(df: DataFrame, names: Sequence[str]) -> Column:
    """SHA-256 of some cells of a row: rows level in it are copies in these cells."""
    cells = [canonical(qcol(n), type_of(df, n)) for n in names]
    return F.sha2(F.to_json(F.array(*cells)), 256)


@dataclass(frozen=True)
class _Term:
    """One term of a total order: its column, direction and type."""

    column: Column
    up: bool
    dtype: T.DataType

    @property
    def sort(self) -> Column:
        return self.column.asc_nulls_last() if self.up else self.column.desc_nulls_last()

    @property
    def kept(self) -> Column:
        """The term as a value for the driver; dates and times go by their text."""
        return self.column.cast("string") if is_temporal(self.dtype) else self.column

    def literal(self, value: object) -> Column:
        return F.lit(str(value)).cast(self.dtype) if is_temporal(self.dtype) else F.lit(value).cast(self.dtype)

    def at(self, i: int) -> _Term:
        """The same term over a table that holds the terms as ``k0``, ``k1``, ..."""
        return _Term(F.col(f"k{i}"), self.up, self.dtype)


def _terms(df: DataFrame, order: Sequence[SortKey]) -> list[_Term]:
    """Terms of sort keys; keys without plain values go by their canonical text."""
    require_columns(df, [n for n, _ in order])
    terms = []
    for name, up in order:
        dtype = type_of(df, name)
        if is_complex(dtype):
            terms.append(_Term(canonical(qcol(name), dtype), up, T.StringType()))
        else:
            terms.append(_Term(qcol(name), up, dtype))
    return terms


def _last_term(df: DataFrame, shown: Sequence[str]) -> _Term:
    """The term that ends a total order: a digest of the columns shown."""
    return _Term(row_digest(df, shown), True, T.StringType())


def page(
    df: DataFrame,
    user: Sequence[SortKey] = (),
    keys: Sequence[str] = (),
    index: int = 0,
    size: int = PAGE_SIZE,
    condition: Column | None = None,
    columns: Sequence[str] | None = None,
    total: int | None = None,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """One page of the filtered rows in grid order; an index past the end gives the last page.

    The order is total: sort keys, then a digest of the columns shown, whatever their
    types, so rows level in it are copies and pages neither repeat nor miss a row.  Where
    the page begins and ends is found on the sort keys alone, and whole rows are read
    between these two keys only.  Digests are made of the rows read, and of rows level in
    the keys with a border that lies among them.  Far down, exact counts around sampled
    keys narrow the table until ``ranked_rows`` keys are left to rank, which changes the
    cost but not the page.  ``total`` saves the row count.
    """
    rows = df if condition is None else df.filter(condition)
    # Ranking as many keys as a sample has costs no more than drawing one.
    start, ranked_rows = 0, max(ranked_rows, SAMPLE_ROWS)
    if index > 0 or total is not None or size >= ranked_rows:
        total = rows.count() if total is None else total
        start = min(max(0, index), page_count(total, size) - 1) * size
    shown = list(columns or df.columns)
    terms, last = _terms(rows, sort_keys(user, keys)), _last_term(rows, shown)
    levels = [terms, [last]] if terms else [[last]]
    found = rows.limit(0)
    if size > 0 and (total is None or start < total):
        found = _slice(rows, levels, start, start + size if total is None else min(start + size, total), total, ranked_rows)
    found = found.orderBy(*[t.sort for t in terms], last.sort)
    if size <= ranked_rows:
        found = found.limit(max(0, size))
    return found if columns is None else found.select(*[qcol(c) for c in columns])


def _comes_before(terms: Sequence[_Term], row: Sequence, or_equal: bool) -> Column:
    """Rows that sort before (or level with) a row of term values, NULLs last."""
    result = F.lit(or_equal)
    for term, value in reversed(list(zip(terms, row, strict=True))):
        c = term.column
        if value is None:
            before, level = c.isNotNull(), c.isNull()
        else:
            at = term.literal(value)
            before = F.coalesce(c < at if term.up else c > at, F.lit(False))
            level = F.coalesce(c == at, F.lit(False))
        result = before | (level & result)
    return result


def _around(rows: DataFrame, terms: Sequence[_Term], start: float, stop: float, total: int) -> tuple[list, list] | None:
    """Terms of two sampled rows, one somewhat before and one somewhat behind a range of shares."""
    drawn = rows.sample(min(1.0, SAMPLE_ROWS / total), seed=17)
    narrow = drawn.select(*[t.column.alias(f"k{i}") for i, t in enumerate(terms)])
    # About SAMPLE_ROWS rows of terms: a bounded sample, whatever the table holds.
    ranked = narrow.select(
        "*",
        F.row_number().over(Window.orderBy(*[t.at(i).sort for i, t in enumerate(terms)])).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("held"),
    )
    slack = 2.0 * F.sqrt("held") + 1
    low = F.greatest(F.floor(F.col("held") * start - slack), F.lit(0)) + 1
    high = F.least(F.ceil(F.col("held") * stop + slack) + 1, F.col("held"))
    kept = [t.at(i).kept.alias(f"k{i}") for i, t in enumerate(terms)]
    picked = ranked.filter((F.col("place") == low) | (F.col("place") == high)).orderBy("place").select(*kept).collect()
    if not picked:
        return None
    cut = lambda row: list(row)[: len(terms)]
    return cut(picked[0]), cut(picked[-1])


def _keys_at(rows: DataFrame, terms: Sequence[_Term], places: Sequence[int], total: int | None, ranked_rows: int) -> dict[int, list]:
    """Term values of the rows at some places of the order, places from 0; those past the end are left out."""
    places = sorted(set(places))
    low, high = places[0], places[-1]
    if high - low >= ranked_rows:
        # The places are those of a page's two borders; each is looked for on its own.
        half = [p for p in places if p - low < ranked_rows // 2 + 1]
        rest = [p for p in places if p not in half]
        return _keys_at(rows, terms, half, total, ranked_rows) | _keys_at(rows, terms, rest, total, ranked_rows)
    skipped = 0
    while high - skipped >= ranked_rows + 1 and total is not None:
        around = _around(rows, terms, (low - skipped) / total, (high + 1 - skipped) / total, total)
        if around is None:
            break
        first, second = around
        cuts = [_comes_before(terms, first, False), _comes_before(terms, first, True)]
        cuts += [_comes_before(terms, second, False), _comes_before(terms, second, True)]
        counts = list(rows.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(cuts)]).first())
        # A place among the copies of a sampled row has that row's keys.
        found = {}
        for place in places:
            for row, before, upto in ((first, *counts[:2]), (second, *counts[2:])):
                if before <= place - skipped < upto:
                    found[place] = row
        rest = [p for p in places if p not in found]
        if len(rest) < len(places):
            more = _keys_at(rows, terms, [p - skipped for p in rest], total, ranked_rows) if rest else {}
            return found | {p + skipped: row for p, row in more.items()}
        # Rows on the far sides of the sampled ones go, wherever all places lie beyond.
        held, cut = total, 0
        if counts[1] <= low - skipped:
            rows, cut = rows.filter(~cuts[1]), counts[1]
        if high - skipped < counts[2]:
            rows, total = rows.filter(cuts[2]), counts[2]
        skipped, total = skipped + cut, total - cut
        if total == held:
            break
    narrow = rows.select(*[t.column.alias(f"k{i}") for i, t in enumerate(terms)])
    order = [t.at(i).sort for i, t in enumerate(terms)]
    # Of the keys ranked only those at the places leave the executors.
    ranked = narrow.orderBy(*order).limit(high - skipped + 1).withColumn("__place", F.row_number().over(Window.orderBy(*order)) - 1)
    kept = [t.at(i).kept.alias(f"k{i}") for i, t in enumerate(terms)]
    picked = ranked.filter(F.col("__place").isin([p - skipped for p in places])).select(*kept, "__place").collect()
    return {r["__place"] + skipped: list(r)[: len(terms)] for r in picked}


def _slice(
    rows: DataFrame, levels: Sequence[Sequence[_Term]], start: int, stop: int, total: int | None, ranked_rows: int
) -> DataFrame:
    """The rows at places ``start`` to ``stop`` of the order, in any order; rows level in all ``levels`` are copies."""
    if total is not None and start <= 0 and stop >= total:
        return rows
    if not levels:
        return rows.limit(stop - start)
    terms = levels[0]
    found = _keys_at(rows, terms, [p for p in (start - 1, start, stop - 1, stop) if p >= 0], total, ranked_rows)
    if start not in found:
        return rows.limit(0)
    if stop - 1 not in found:
        # The table ends before; only one without a known count can do so.
        total = rows.count()
        return _slice(rows, levels, start, min(stop, total), total, ranked_rows)
    first, last = found[start], found[stop - 1]
    level = lambda a, b: a is not None and repr(a) == repr(b)
    cut_first, cut_last = level(found.get(start - 1), first), level(found.get(stop), last)
    from_first, upto_last = ~_comes_before(terms, first, False), _comes_before(terms, last, True)
    if not cut_first and not cut_last:
        return rows.filter(from_first & upto_last)
    # A border lies among rows level in these terms: the next terms tell which of them are in.
    after_first, before_last = ~_comes_before(terms, first, True), _comes_before(terms, last, False)
    counted = [~from_first, ~after_first, before_last, upto_last]
    before, upto_low, before_high, upto = rows.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(counted)]).first()
    rest = levels[1:]
    if level(first, last):
        return _slice(rows.filter(from_first & upto_last), rest, start - before, stop - before, upto - before, ranked_rows)
    out = rows.filter((after_first if cut_first else from_first) & (before_last if cut_last else upto_last))
    if cut_first:
        own = rows.filter(from_first & ~after_first)
        out = out.unionAll(_slice(own, rest, start - before, upto_low - before, upto_low - before, ranked_rows))
    if cut_last:
        own = rows.filter(upto_last & ~before_last)
        out = out.unionAll(_slice(own, rest, 0, stop - before_high, upto - before_high, ranked_rows))
    return out


# -- a table kept in order ------------------------------------------------------------------------

PART, WITHIN, PLACE = "__part", "__within", "__place"
PARTS_SCHEMA = "__part int, held long, before long"


def _mixed(df: DataFrame) -> Column:
    """A hash of a row's cells."""
    return F.xxhash64(*[canonical(qcol(f.name), f.dataType) if is_complex(f.dataType) else qcol(f.name) for f in df.schema.fields])


def write_in_order(df: DataFrame, path: str, order: Sequence[Column], parts: int | None = None) -> None:
    """Write rows range-partitioned by ``order``, each with its part and its number inside the part.

    Rows level in ``order`` may be dealt to several parts, by a hash of their plain cells, so that
    many rows with one key do not end in one task.
    """
    if taken := {PART, WITHIN, PLACE} & set(df.columns):
        raise ValueError(f"columns that the written table needs itself: {sorted(taken)}")
    terms = [*order, _mixed(df).asc()]
    dealt = df.repartitionByRange(*([parts] if parts else []), *terms).sortWithinPartitions(*terms)
    number = F.monotonically_increasing_id()
    placed = dealt.select("*", F.shiftright(number, 33).cast("int").alias(PART), number.bitwiseAND(F.lit((1 << 33) - 1)).alias(WITHIN))
    placed.write.partitionBy(PART).parquet(path + "/rows")
    # The schema is kept beside: a table without rows has no part to read it from.
    spark = df.sparkSession
    spark.createDataFrame([(placed.schema.json(),)], "schema string").coalesce(1).write.text(path + "/schema")
    parts_of(_rows_of(spark, path), F.col(PART)).coalesce(1).write.parquet(path + "/parts")


def parts_of(rows: DataFrame, part: Column) -> DataFrame:
    """``(__part, held, before)``: each part's rows, and how many stand in parts before it.

    The driver adds up one count per written part, of which it knows anyway.
    """
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias(PART)).agg(F.count(F.lit(1)).alias("held")).collect())
    before = accumulate([0, *(held for _, held in counts)])
    return rows.sparkSession.createDataFrame([(p, held, b) for (p, held), b in zip(counts, before, strict=False)], PARTS_SCHEMA)


def _rows_of(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(path + "/schema").first()[0]))
    return spark.read.schema(schema).parquet(path + "/rows")


@dataclass(frozen=True)
class RankIndex:
    """A table written once in a total order, any page of which is found by sums of the parts' row counts.

    A page reads the parts that it touches and of these the rows between two numbers, however deep
    it lies; nothing is sorted again but the page.  ``parts`` has a row per written part.
    """

    rows: DataFrame
    parts: DataFrame

    @staticmethod
    def write(df: DataFrame, path: str, user: Sequence[SortKey] = (), keys: Sequence[str] = (), parts: int | None = None) -> RankIndex:
        """Write ``df`` to ``path`` in grid order; ``parts`` is the number of part files, Spark's choice if not given."""
        write_in_order(df, path, [t.sort for t in _terms(df, sort_keys(user, keys))], parts)
        return RankIndex.read(df.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> RankIndex:
        return RankIndex(_rows_of(spark, path), spark.read.schema(PARTS_SCHEMA).parquet(path + "/parts"))

    def total(self) -> int:
        return self.parts.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]

    def page(self, index: int = 0, size: int = PAGE_SIZE) -> DataFrame:
        """The rows of a page in order, with their ``__place`` from 0; an index past the end gives the last page."""
        total = self.total()
        start = min(max(0, index), page_count(total, size) - 1) * size
        return self.between(start, min(start + size, total))

    def between(self, start: int, stop: int) -> DataFrame:
        """The rows at places from ``start`` to before ``stop``, in order."""
        touched = self.parts.filter((F.col("before") < stop) & (F.col("before") + F.col("held") > start))
        # Parts that a page touches: few, and their numbers reach the scan as filters on folders and row groups.
        spans = [(r[PART], r["before"]) for r in touched.orderBy(PART).collect()]
        here, place = F.lit(False), F.lit(None).cast("long")
        for part, before in spans:
            own = F.col(PART) == part
            here = here | (own & (F.col(WITHIN) >= start - before) & (F.col(WITHIN) < stop - before))
            place = F.when(own, F.col(WITHIN) + before).otherwise(place)
        return self.rows.filter(here).withColumn(PLACE, place).orderBy(PLACE).drop(PART, WITHIN)

    def numbered(self) -> DataFrame:
        """All rows with their ``__place`` from 0, without gaps, in no order."""
        return self.rows.join(self.parts.select(PART, "before"), PART).withColumn(PLACE, F.col("before") + F.col(WITHIN)).drop(
            PART, WITHIN, "before"
        )


def dense_places(df: DataFrame, ord_name: str, path: str, name: str = "place") -> DataFrame:
    """All rows with their place from 1 and without gaps, by a column that grows with the part and inside the part.

    Such a column comes from ``monotonically_increasing_id`` over ordered rows, some of which may
    have been dropped since.  The rows are written to ``path`` once, so that places stay the same
    whatever is computed again; rows are numbered inside parts, and parts' counts are added up.
    """
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    part = F.shiftright(F.col(ord_name), 33).cast("int")
    within = F.row_number().over(Window.partitionBy(PART).orderBy(ord_name))
    numbered = rows.withColumn(PART, part).withColumn(WITHIN, within).join(parts_of(rows, part), PART)
    return numbered.withColumn(name, F.col("before") + F.col(WITHIN)).drop(PART, WITHIN, "held", "before")


def with_places(df: DataFrame, order: Sequence[Column], path: str, name: str = "place") -> DataFrame:
    """All rows with their place in an order, from 1 and without gaps; the ordered rows are written to ``path`` once.

    Rows level in ``order`` follow each other by a hash of their cells; many of them are dealt to several parts.
    """
    ordered = df.orderBy(*order, _mixed(df).asc()).withColumn(PLACE, F.monotonically_increasing_id())
    return dense_places(ordered, PLACE, path, name).drop(PLACE)


def next_page(
    df: DataFrame,
    last: dict,
    user: Sequence[SortKey] = (),
    keys: Sequence[str] = (),
    size: int = PAGE_SIZE,
    condition: Column | None = None,
) -> DataFrame:
    """The page after the row with key values ``last``; the filter reaches the scan.

    The order must be unique, as it is with the key columns at its end.
    """
    order = sort_keys(user, keys)
    rows = df if condition is None else df.filter(condition)
    terms = _terms(df, order)
    after = ~_comes_before(terms, [last[n] for n, _ in order], or_equal=True)
    return rows.filter(after).orderBy(*[t.sort for t in terms]).limit(size)


def result_sort_keys(user: Sequence[SortKey], columns: Sequence[str], keys: Sequence[str]) -> list[SortKey]:
    """User keys, then key columns, then all other columns of a chart's result."""
    known = set(columns)
    chosen = [(n, up) for n, up in user if n in known]
    return sort_keys(chosen, [*[k for k in keys if k in known], *columns])


def result_order(
    result: DataFrame, user: Sequence[SortKey] = (), keys: Sequence[str] = (), measures: Sequence[str] = ()
) -> list[Column]:
    """Order-by columns of a chart's result: measures as numbers with non-numbers last, text without case."""
    terms = []
    for name, up in result_sort_keys(user, result.columns, keys):
        dtype = type_of(result, name)
        if name in measures:
            x = chart_number(qcol(name), dtype)
            terms.append(x.asc_nulls_last() if up else x.desc_nulls_last())
        else:
            text = F.lower(F.coalesce(text_of(qcol(name), dtype), F.lit("")))
            terms.append(text.asc() if up else text.desc())
    return terms


def sort_result(
    result: DataFrame, user: Sequence[SortKey] = (), keys: Sequence[str] = (), measures: Sequence[str] = ()
) -> DataFrame:
    """A chart's result in the order of `result_order`."""
    return result.orderBy(*result_order(result, user, keys, measures))
