"""Exact percentiles that never gather a column in one task.

The built-in exact ``percentile`` keeps every distinct value of a column in one hash
map, which no executor can hold for 10^12 rows.  Here each wanted rank is narrowed
down instead.  One scan finds a column's range; the next counts equal-width bins of
it, which combine before the shuffle, and keeps the bin that holds the rank; further
scans repeat this inside that bin until few rows are left, whose values are then
counted one by one.  A step divides the rows by the number of bins, so 10^12 rows
take three of them.  Where a few far outliers put nearly all rows into one bin, a
quantile sketch proposes the next interval; its values split by rank, so the number
of steps stays small whatever the data looks like.

A step reads the table once for all fields, quantiles and intervals.  ``finish_rows``
only says when to stop narrowing; the values found do not depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qcol, safe_double, type_of

BINS = 16_384
FINISH_ROWS = 100_000
ACCURACY = 10_000
FIELDS_PER_SCAN = 32


@dataclass
class _Target:
    """The value of one rank, known to lie in [lo, hi]; ``base`` rows lie below ``lo``."""

    field: str
    rank: int
    base: int = 0
    inside: int = 0
    lo: float = math.nan
    hi: float = math.nan
    value: float | None = None
    skewed: bool = False
    found: tuple | None = None

    @property
    def span(self) -> tuple:
        return (self.field, self.lo, self.hi)

    def narrow(self, lo: float, hi: float, base: int, inside: int) -> None:
        self.skewed = inside * 4 > self.inside
        self.lo, self.hi, self.base, self.inside = lo, hi, base, inside
        if lo == hi:
            self.value = lo


class _Search:
    def __init__(self, df: DataFrame, fields: Sequence[str], probs: Sequence[float], finish_rows: int):
        self.df, self.finish_rows = df, finish_rows
        self.x = {n: safe_double(qcol(n), type_of(df, n)) for n in fields}
        self.total: dict[str, int] = {}
        self.targets: dict[tuple[str, int], _Target] = {}
        self._start(fields, probs)

    def _start(self, fields, probs) -> None:
        aggs = []
        for n in fields:
            x = self.x[n]
            finite = F.when(~F.isnan(x) & ~x.isin(math.inf, -math.inf), x)
            aggs += [F.count(x), F.count_if(x == -math.inf), F.count(finite), F.count_if(x == math.inf)]
            aggs += [F.min(finite), F.max(finite)]
        row = self.df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        for i, n in enumerate(fields):
            total, lowest, finite, highest, lo, hi = row[6 * i : 6 * i + 6]
            self.total[n] = total
            for p in probs if total else ():
                pos = p * (total - 1)
                for rank in (math.floor(pos), math.ceil(pos)):
                    t = _Target(n, rank, lowest, finite, lo, hi)
                    if rank < lowest:
                        t.value = -math.inf
                    elif rank >= lowest + finite:
                        t.value = math.inf if rank < lowest + finite + highest else math.nan
                    elif lo == hi:
                        t.value = lo
                    self.targets[(n, rank)] = t

    def run(self) -> None:
        while True:
            open_ = [t for t in self.targets.values() if t.value is None]
            big = [t for t in open_ if t.inside > self.finish_rows]
            if not big:
                break
            sketched = [t for t in big if t.skewed or not math.isfinite(t.hi - t.lo)]
            binned = [t for t in big if t not in sketched]
            if binned:
                self._bin(binned)
            if sketched:
                self._sketch(sketched)
        if open_:
            self._finish(open_)

    def _rows(self, targets: list[_Target], place=None) -> tuple[list[tuple], DataFrame]:
        """``(span, x[, bin])`` of the rows in the targets' intervals, all from one scan.

        Each row unfolds into the intervals that hold one of its values; a filter on
        the outermost bounds of all fields reaches the scan.
        """
        spans = list(dict.fromkeys(t.span for t in targets))
        fields = list(dict.fromkeys(n for n, _, _ in spans))
        some = self.df.select(*[self.x[n].alias(f"x{i}") for i, n in enumerate(fields)])
        within, held = F.lit(False), []
        for number, (n, lo, hi) in enumerate(spans):
            x = F.col(f"x{fields.index(n)}")
            cells = [F.lit(number).alias("span"), x.alias("x")]
            if place:
                cells.append(place(x, lo, hi).alias("bin"))
            inside = x.between(lo, hi)
            within = within | inside
            held.append(F.when(inside, F.struct(*cells)))
        return spans, some.filter(within).select(F.inline(F.array_compact(F.array(*held))))

    @staticmethod
    def _holding(counts: DataFrame, order: str, ranks: list[list[int]]) -> DataFrame:
        """Running totals over each span's few rows; keeps those that hold a wanted rank."""
        w = Window.partitionBy("span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        wanted = F.element_at(F.array(*[F.array(*[F.lit(r) for r in rs]) for rs in ranks]), F.col("span") + 1)
        return counts.withColumn("upto", F.sum("n").over(w)).filter(
            F.exists(wanted, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
        )

    def _ranks(self, spans, targets) -> list[list[int]]:
        return [sorted({t.rank - t.base for t in targets if t.span == s}) for s in spans]

    def _bin(self, targets: list[_Target]) -> None:
        def place(x: Column, lo: float, hi: float) -> Column:
            # The bin grows with x, so a bin's rows are exactly those between its least and greatest value.
            return F.least(F.floor((x - lo) / F.lit((hi - lo) / BINS)), F.lit(BINS - 1)).cast("int")

        spans, rows = self._rows(targets, place)
        counts = rows.groupBy("span", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for r in self._holding(counts, "bin", self._ranks(spans, targets)).collect():
            for t in targets:
                before = t.base + r["upto"] - r["n"]
                if t.span == spans[r["span"]] and before <= t.rank < before + r["n"]:
                    t.found = (r["lo"], r["hi"], before, r["n"])
        for t in targets:
            t.narrow(*t.found)

    def _sketch(self, targets: list[_Target]) -> None:
        """Two values around each rank by sketch, then exact counts on either side of them."""
        aggs = []
        for i, t in enumerate(targets):
            share, slack = (t.rank - t.base + 0.5) / t.inside, 2.0 / ACCURACY
            x = self.x[t.field]
            around = [max(0.0, share - slack), min(1.0, share + slack)]
            aggs.append(F.percentile_approx(F.when(x.between(t.lo, t.hi), x), around, ACCURACY).alias(f"t{i}"))
        pairs = [tuple(v) for v in self.df.agg(*aggs).first()]
        sides = []
        for t, (a, b) in zip(targets, pairs):
            x = F.when(self.x[t.field].between(t.lo, t.hi), self.x[t.field])
            sides += [F.count_if(x < a), F.count_if(x <= a), F.count_if(x < b), F.count_if(x <= b)]
        row = self.df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sides)]).first()
        for i, (t, (a, b)) in enumerate(zip(targets, pairs)):
            below_a, upto_a, below_b, upto_b = (t.base + c for c in row[4 * i : 4 * i + 4])
            end = t.base + t.inside
            if below_a <= t.rank < upto_a:
                t.value = a
            elif below_b <= t.rank < upto_b:
                t.value = b
            elif t.rank < below_a:
                t.narrow(t.lo, math.nextafter(a, -math.inf), t.base, below_a - t.base)
            elif t.rank >= upto_b:
                t.narrow(math.nextafter(b, math.inf), t.hi, upto_b, end - upto_b)
            else:
                t.narrow(math.nextafter(a, math.inf), math.nextafter(b, -math.inf), upto_a, below_b - upto_a)

    def _finish(self, targets: list[_Target]) -> None:
        """Count the values left in each interval, at most ``finish_rows`` of them."""
        spans, rows = self._rows(targets)
        counts = rows.groupBy("span", "x").agg(F.count(F.lit(1)).alias("n"))
        for r in self._holding(counts, "x", self._ranks(spans, targets)).collect():
            for t in targets:
                if t.span == spans[r["span"]] and r["upto"] - r["n"] <= t.rank - t.base < r["upto"]:
                    t.value = r["x"]

    def value(self, field: str, p: float) -> float | None:
        if not self.total[field]:
            return None
        pos = p * (self.total[field] - 1)
        low, high = math.floor(pos), math.ceil(pos)
        a, b = self.targets[(field, low)].value, self.targets[(field, high)].value
        return a if low == high or a == b else (high - pos) * a + (pos - low) * b


def percentile_values(
    df: DataFrame,
    fields: Sequence[str],
    probs: Sequence[float],
    exact: bool = True,
    finish_rows: int = FINISH_ROWS,
) -> dict[str, list[float | None]]:
    """Percentiles of each field, interpolated between ranks; ``None`` if it has no numbers.

    ``exact=False`` takes them from a sketch in a single scan.
    """
    probs = [float(p) for p in probs]
    out: dict[str, list[float | None]] = {}
    for start in range(0, len(fields), FIELDS_PER_SCAN):
        some = list(fields[start : start + FIELDS_PER_SCAN])
        if exact:
            search = _Search(df, some, probs, finish_rows)
            search.run()
            out.update({n: [search.value(n, p) for p in probs] for n in some})
        else:
            aggs = [
                F.percentile_approx(safe_double(qcol(n), type_of(df, n)), probs, ACCURACY).alias(f"f{i}")
                for i, n in enumerate(some)
            ]
            row = df.agg(*aggs).first()
            out.update({n: list(row[i]) if row[i] else [None] * len(probs) for i, n in enumerate(some)})
    return out


def literal_double(v: float | None) -> Column:
    return F.lit(v).cast("double")


def percentiles(
    df: DataFrame, fields: Sequence[str], probs: Sequence[float], exact: bool = True, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """``(field, q)`` with the percentiles of each field as an array."""
    found = percentile_values(df, fields, probs, exact, finish_rows)
    rows = [
        F.struct(F.lit(n).alias("field"), F.array(*[literal_double(v) for v in vs]).alias("q"))
        for n, vs in found.items()
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))
