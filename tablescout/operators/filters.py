"""Predicates: panel filters, typed column filters, and drilling from a chart into rows.

Every builder returns one boolean ``Column``, so filters combine with ``&`` and reach
the scan with the rest of the plan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol, require_columns, safe_double, text_of, type_of
from ..functions.formats import clamp_places
from ..sources.dictionary import Dictionary

RANGES = 10


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True)


def where_in(df: DataFrame, choices: Mapping[str, Sequence[object]]) -> Column:
    """Cells whose text is among the chosen values, AND between fields.

    ``None`` among the values chooses NULL cells.  Text is compared with text, so
    ``'01'`` and ``'1'`` are different choices; other types compare in their own type.
    """
    parts = []
    for name, values in choices.items():
        dtype = type_of(df, name)
        wanted = [v for v in values if v is not None]
        if not values:
            continue
        as_text = isinstance(dtype, T.StringType) or any(isinstance(v, str) for v in wanted)
        cell = text_of(qcol(name), dtype) if as_text else qcol(name)
        hit = cell.isin([str(v) for v in wanted] if as_text else wanted) if wanted else F.lit(False)
        parts.append(hit | qcol(name).isNull() if len(wanted) < len(values) else hit)
    return all_of(parts)


def distinct_values(df: DataFrame, name: str, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """``(value)``: the distinct values as text in order, NULL last; optionally searched."""
    raw = df.select(qcol(name).alias("raw")).distinct()
    table = raw.select(text_of(F.col("raw"), type_of(df, name)).alias("value"))
    if contains:
        table = table.filter(F.lower("value").contains(contains.strip().lower()))
    table = table.orderBy(F.col("value").asc_nulls_last())
    return table if limit is None else table.limit(int(limit))


@dataclass(frozen=True)
class RangeSpec:
    """One measure range; half-open unless ``include_end``."""

    start: float
    end: float
    include_end: bool = False

    def condition(self, x: Column) -> Column:
        return (x >= self.start) & ((x <= self.end) if self.include_end else (x < self.end))


def measure_ranges(df: DataFrame, name: str, places: int = 2) -> DataFrame:
    """``(ord, start, end, include_end, label)``: ten equal ranges over a measure.

    The last range ends at the maximum itself; a constant measure gets steps of one.
    """
    x = safe_double(qcol(name), type_of(df, name))
    step = F.when(F.col("mn") == F.col("mx"), 1.0).otherwise((F.col("mx") - F.col("mn")) / float(RANGES))
    last = F.col("ord") == RANGES - 1
    end = F.when(last & (F.col("mn") < F.col("mx")), F.col("mx")).otherwise(F.col("mn") + (F.col("ord") + 1) * step)
    dp = clamp_places(places)
    return (
        df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"))
        .filter("mn is not null")
        .select("mn", "mx", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("ord"))
        .select("ord", (F.col("mn") + F.col("ord") * step).alias("start"), end.alias("end"), last.alias("include_end"))
        .withColumn(
            "label",
            F.concat(F.lit("between "), F.format_number("start", dp), F.lit(" and "), F.format_number("end", dp)),
        )
    )


def where_ranges(df: DataFrame, ranges: Mapping[str, Sequence[RangeSpec]]) -> Column:
    """OR of the chosen ranges of a measure, AND between measures."""
    parts = []
    for name, specs in ranges.items():
        if specs:
            x = safe_double(qcol(name), type_of(df, name))
            parts.append(reduce(lambda a, b: a | b, [s.condition(x) for s in specs]))
    return all_of(parts)


def where_contains(df: DataFrame, name: str, text: str) -> Column:
    """Cells whose text holds ``text`` in any case; no wildcards."""
    return F.lower(text_of(qcol(name), type_of(df, name))).contains(text.lower())


# Fixed grammar of a typed range: two numbers around a dash, two dots, "and" or "to".
_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_JOINTS = [r"\s*-\s*", r"\s*\.\.\s*", r"\s+and\s+", r"\s+to\s+"]


def parse_range(text: str) -> tuple[float, float] | None:
    """Bounds of a typed range such as ``100-400``, in order; ``None`` if it is none."""
    plain = text.strip().replace("–", "-").replace("—", "-")
    for joint in _JOINTS:
        m = re.fullmatch(_NUMBER + joint + _NUMBER, plain, re.IGNORECASE)
        if m:
            bounds = sorted(float(g) for g in m.groups())
            if all(math.isfinite(b) for b in bounds):
                return bounds[0], bounds[1]
    return None


def range_bounds(text: Column) -> Column:
    """Column version of :func:`parse_range`: a struct ``(lo, hi)`` or NULL."""
    plain = F.regexp_replace(F.trim(text), "[–—]", "-")
    out = F.lit(None).cast("struct<lo:double,hi:double>")
    for joint in reversed(_JOINTS):
        rx = f"(?i)^{_NUMBER}{joint}{_NUMBER}\\z"
        a = F.regexp_extract(plain, rx, 1).try_cast("double")
        b = F.regexp_extract(plain, rx, 2).try_cast("double")
        finite = ~a.isin(float("inf"), float("-inf")) & ~b.isin(float("inf"), float("-inf"))
        pair = F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        out = F.when(plain.rlike(rx) & finite, pair).otherwise(out)
    return out


def where_range_text(df: DataFrame, name: str, text: str, measure: bool = True) -> Column:
    """A typed column filter: a closed range on a measure, else a substring search."""
    bounds = parse_range(text) if measure else None
    if bounds is None:
        return where_contains(df, name, text.strip())
    return safe_double(qcol(name), type_of(df, name)).between(*bounds)


@dataclass(frozen=True)
class FilterSpec:
    """The filters in force: chart selection or panel filters, never both, and typed filters.

    Setting one of the first two clears the other.  ``typed`` maps columns to filter
    texts; the pivot ignores them.
    """

    choices: Mapping[str, Sequence[object]] = field(default_factory=dict)
    ranges: Mapping[str, Sequence[RangeSpec]] = field(default_factory=dict)
    chart: Column | None = None
    typed: Mapping[str, str] = field(default_factory=dict)

    @property
    def mode(self) -> str:
        if self.chart is not None:
            return "chart"
        return "user" if self.choices or self.ranges else "none"

    def with_chart(self, condition: Column) -> FilterSpec:
        return FilterSpec(chart=condition, typed=self.typed)

    def with_panel(self, choices=None, ranges=None) -> FilterSpec:
        return FilterSpec(choices=choices or {}, ranges=ranges or {}, typed=self.typed)

    def base(self, df: DataFrame) -> Column:
        if self.mode == "chart":
            return self.chart
        return where_in(df, self.choices) & where_ranges(df, self.ranges)

    def column(self, df: DataFrame, dictionary: Dictionary | None = None, for_pivot: bool = False) -> Column:
        """The whole predicate; ``dictionary`` tells which columns take typed ranges."""
        parts = [self.base(df)]
        for name, text in () if for_pivot else self.typed.items():
            if text.strip():
                known = dictionary.get(name) if dictionary else None
                parts.append(where_range_text(df, name, text, measure=known is not None and known.formats_as_measure))
        return all_of(parts)


@dataclass(frozen=True)
class DrillSpec:
    """What a click on a chart stands for.

    ``closed`` says how a histogram bar selects rows: ``both`` takes both edges, ``bin``
    takes the rows the bar counted (the right edge only for the last bar).
    """

    chart: str
    dims: Sequence[str] = ()
    measure: str | None = None
    closed: str = "both"


def _same(df: DataFrame, name: str, value: object) -> Column:
    dtype = type_of(df, name)
    if isinstance(value, str) and not isinstance(dtype, T.StringType):
        return text_of(qcol(name), dtype).eqNullSafe(F.lit(value))
    if isinstance(dtype, T.StringType) and value is not None:
        return qcol(name).eqNullSafe(F.lit(str(value)))
    return qcol(name).eqNullSafe(F.lit(value))


def drill_filter(df: DataFrame, spec: DrillSpec, *values: object, last_bin: bool = False) -> Column:
    """Predicate on the table's rows for the clicked value(s) of a chart.

    One value for bar, line, pie and scatter; two for a stacked bar; the two edges of
    a histogram bar.  NULL groups can be drilled into.
    """
    if spec.chart == "histogram":
        if spec.measure is None or len(values) != 2:
            raise ValueError("drilling a histogram takes a measure and the two edges of a bar")
        x = safe_double(qcol(spec.measure), type_of(df, spec.measure))
        lo, hi = (float(v) for v in values)
        if spec.closed == "both":
            return x.between(lo, hi)
        return RangeSpec(lo, hi, include_end=last_bin).condition(x)
    wanted = 2 if spec.chart == "stacked_bar" else 1
    if len(spec.dims) < wanted or len(values) != wanted:
        raise ValueError(f"drilling a {spec.chart} chart takes {wanted} dimension(s) and value(s)")
    return all_of([_same(df, d, v) for d, v in zip(spec.dims, values)])


def loosely_equal(c: Column, dtype: T.DataType, value: object) -> Column:
    """Both blank, or the same finite number, or the same text but for case and outer blanks."""
    text = text_of(c, dtype)
    blank = c.isNull() | (F.regexp_replace(text, r"\s", "") == "")
    if value is None or (isinstance(value, str) and value.strip() == ""):
        return blank if isinstance(dtype, T.StringType) else c.isNull()
    strip = lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    same_text = strip(text) == strip(F.lit(str(value)))
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        number = math.nan
    if not math.isfinite(number):
        return F.coalesce(same_text, F.lit(False))
    return F.coalesce(safe_double(c, dtype) == number, F.lit(False)) | F.coalesce(same_text, F.lit(False))


def drill_result(result: DataFrame, spec: DrillSpec, *values: object) -> DataFrame:
    """The rows of a chart's result that belong to a click; all of them without a value."""
    if not values:
        return result
    if spec.chart == "histogram":
        names = ["bin_idx"] if "bin_idx" in result.columns else result.columns[:1]
    else:
        wanted = 2 if spec.chart == "stacked_bar" else 1
        if len(values) < wanted:
            return result
        given = list(spec.dims[:wanted])
        names = [
            given[i] if i < len(given) and given[i] in result.columns else result.columns[i] for i in range(wanted)
        ]
    return result.filter(all_of([loosely_equal(qcol(n), type_of(result, n), v) for n, v in zip(names, values)]))


def chart_number(c: Column, dtype: T.DataType) -> Column:
    """A result cell as a finite double; thousands commas are dropped, truth values are no numbers."""
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(dtype, T.StringType):
        c = F.regexp_replace(c, ",", "")
    x = safe_double(c, dtype)
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def filter_result(result: DataFrame, typed: Mapping[str, str], measures: Sequence[str] = ()) -> DataFrame:
    """Typed filters on a chart's result: closed ranges on measures, else substring search."""
    require_columns(result, list(typed))
    parts = []
    for name, text in typed.items():
        if not text.strip():
            continue
        dtype = type_of(result, name)
        bounds = parse_range(text) if name in measures else None
        if bounds is not None:
            parts.append(F.coalesce(chart_number(qcol(name), dtype).between(*bounds), F.lit(False)))
        else:
            shown = F.coalesce(F.lower(text_of(qcol(name), dtype)), F.lit(""))
            parts.append(shown.contains(text.strip().lower()))
    return result.filter(all_of(parts))
