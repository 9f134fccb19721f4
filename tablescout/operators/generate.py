"""Rule-driven synthetic rows.

Every cell is an expression of the row number: randomness is a hash of (row, column,
seed), so the rows are the same however the range is split, and a lost task makes
the same rows again.
"""

from __future__ import annotations

import random
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import qcol

# Places the geography rules draw from.
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]
COUNTIES = {
    "CA": ["Los Angeles", "San Diego", "Orange", "Santa Clara", "Alameda"],
    "TX": ["Harris", "Dallas", "Tarrant", "Bexar", "Travis"],
    "NY": ["Kings", "Queens", "New York", "Suffolk", "Bronx"],
    "FL": ["Miami-Dade", "Broward", "Palm Beach", "Hillsborough", "Orange"],
    "IL": ["Cook", "DuPage", "Lake", "Will", "Kane"],
    "PA": ["Philadelphia", "Allegheny", "Montgomery", "Bucks", "Delaware"],
    "OH": ["Cuyahoga", "Franklin", "Hamilton", "Summit", "Montgomery"],
    "GA": ["Fulton", "Gwinnett", "Cobb", "DeKalb", "Chatham"],
    "NC": ["Wake", "Mecklenburg", "Guilford", "Forsyth", "Cumberland"],
    "MI": ["Wayne", "Oakland", "Macomb", "Kent", "Genesee"],
}
OTHER_COUNTIES = ["Central", "North", "South", "East", "West"]
NUMBER_TYPES = ["num", "number", "numeric", "decimal", "float", "int", "integer"]
TEXT_TYPES = ["char", "string", "text"]
FIRST_YEAR, LAST_YEAR = 2018, 2026
KEY_WIDTH = 12
DEFAULT_RANGE = (1.0, 100_000.0)
DEFAULT_SPAN = 1_000_000.0
LAST_DAY = "9999-12-31"
DAY = 86_400
# Working columns of a synthetic row: text, number, moment.
PREFIX = {"text": "__t_", "number": "__n_", "moment": "__s_"}
# Fixed patterns: "> a [and < b]" and "< OTHER_FIELD".
BOUNDS = re.compile(r">=?\s*(-?\d+(?:\.\d+)?)(?:\s+and\s+<=?\s*(-?\d+(?:\.\d+)?))?", re.IGNORECASE)
BELOW_FIELD = re.compile(r"<\s*([A-Za-z0-9_]+)")


@dataclass(frozen=True)
class ColumnRule:
    """One synthetic column: its type, width and rule text."""

    name: str
    data_type: str = "Char"
    field_length: int | None = None
    rules: str = ""
    is_key: bool = False

    @classmethod
    def from_rows(cls, spec: DataFrame) -> list[ColumnRule]:
        """Collect a parsed generator dictionary (tens of rows) in its order."""
        return [
            cls(r["name"], r["data_type"], r["field_length"], r["rules"], r["is_key"])
            for r in spec.orderBy("ord").collect()
        ]


class _Row:
    """Expressions of one row: its number, the seed, and the columns built so far.

    Numbers and moments are kept beside their text (``__n_`` and ``__s_`` columns), so
    that a rule which looks at an earlier column need not parse it again.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.done: dict[str, str] = {}
        self.used: set[str] = set()
        rng = random.Random(seed)
        year, month = rng.randint(FIRST_YEAR, LAST_YEAR), rng.randint(1, 12)
        self.start = date(year, month, 1)
        self.days = (date(year + month // 12, month % 12 + 1, 1) - self.start).days
        self.number = F.col("id") + 1

    def draw(self, name: str, what: str = "") -> Column:
        """Uniform in [0, 1), fixed by row, column, purpose and seed: 52 bits of an MD5."""
        text = F.concat_ws("/", F.col("id").cast("string"), F.lit(name), F.lit(what), F.lit(str(self.seed)))
        bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
        return bits.cast("double") / float(1 << 52)

    def choose(self, name: str, options: Column, count: Column | int) -> Column:
        size = F.lit(count) if isinstance(count, int) else count
        return F.element_at(options, F.floor(self.draw(name) * size).cast("int") + 1)

    def earlier(self, name: str, kind: str = "text") -> Column | None:
        """An already built column of the row, by name in any case.

        ``kind`` asks for its text, its number (NULL if it is none) or its moment in
        seconds from the start of the month.
        """
        for done, has in self.done.items():
            if done.upper() == name.strip().upper():
                if has not in ("text", kind):
                    return None
                self.used.add(done)
                if has == "text" and kind == "number":
                    return F.replace(qcol("__t_" + done), F.lit(","), F.lit("")).try_cast("double")
                if has == "text" and kind == "moment":
                    return self.seconds(qcol("__t_" + done))
                return qcol(PREFIX[kind] + done)
        return None

    def seconds(self, text: Column) -> Column:
        """Seconds of ``yyyy-MM-dd[ HH:mm:ss]`` text from the start of the month, else NULL."""
        exact = text.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?\z")
        day = F.datediff(F.when(exact, F.substring(text, 1, 10)).try_cast("date"), F.lit(self.start))
        part = lambda at: F.coalesce(F.substring(text, at, 2).try_cast("bigint"), F.lit(0))
        return day.cast("bigint") * 86_400 + part(12) * 3_600 + part(15) * 60 + part(18)

    def day(self, offset: Column) -> Column:
        """Text of the day so many days after the start of the month."""
        return F.date_format(F.date_add(F.lit(self.start), offset.cast("int")), "yyyy-MM-dd")

    def moment(self, seconds: Column) -> Column:
        """Text of a moment; built from a date and a time of day, so no time zone is involved."""
        day = F.floor(seconds / 86_400)
        rest = seconds - day * 86_400
        two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
        clock = F.concat_ws(":", two(F.floor(rest / 3_600)), two(F.floor(rest / 60) % 60), two(rest % 60))
        return F.concat_ws(" ", self.day(day), clock)


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


class Cells:
    """What fills one synthetic column; ``kind`` says which working column holds it."""

    kind = "text"
    limit: int | None = None

    def build(self, name: str, row: _Row) -> Column:
        raise NotImplementedError(type(self).__name__)

    def shown(self, name: str, row: _Row) -> Column:
        """The finished text, from the working column."""
        return qcol(PREFIX[self.kind] + name)

    def cut(self, c: Column) -> Column:
        return F.substring(c, 1, self.limit) if self.limit and self.limit > 0 else c


@dataclass(frozen=True)
class Key(Cells):
    """Row numbers filled up with zeros; a number that does not fit ends the job with an error."""

    width: int

    def build(self, name: str, row: _Row) -> Column:
        digits = row.number.cast("string")
        long = F.raise_error(F.concat(F.lit(f"{name}: a unique number does not fit in {self.width} digits: "), digits))
        return F.when(F.length(digits) > self.width, long).otherwise(F.lpad(digits, self.width, "0"))


@dataclass(frozen=True)
class Choice(Cells):
    """One of some fixed texts."""

    options: tuple[str, ...]
    limit: int | None = None

    def build(self, name: str, row: _Row) -> Column:
        return self.cut(row.choose(name, _texts(self.options), len(self.options)))


@dataclass(frozen=True)
class Lookup(Cells):
    """One of the texts that a table has for an earlier column; other values share a default list."""

    column: str
    table: Mapping[str, Sequence[str]]
    default: tuple[str, ...]
    limit: int | None = None

    def build(self, name: str, row: _Row) -> Column:
        options, by = _texts(self.default), row.earlier(self.column)
        if by is not None:
            pairs = [c for key, texts in self.table.items() for c in (F.lit(key), _texts(texts))]
            options = F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(F.trim(by))), options)
        return self.cut(row.choose(name, options, F.size(options)))


@dataclass(frozen=True)
class Literal(Cells):
    """The same text in every row."""

    value: str
    limit: int | None = None

    def build(self, name: str, row: _Row) -> Column:
        return self.cut(F.lit(self.value))


@dataclass(frozen=True)
class Numbered(Cells):
    """A prefix and the row number."""

    prefix: str
    limit: int | None = None

    def build(self, name: str, row: _Row) -> Column:
        return self.cut(F.concat(F.lit(self.prefix), row.number.cast("string")))


@dataclass(frozen=True)
class Bounds(Cells):
    """A whole number above ``low`` and below both ``high`` and earlier columns, where there is room."""

    kind = "number"
    low: float
    high: float | None
    below: tuple[str, ...] = ()

    def build(self, name: str, row: _Row) -> Column:
        low = F.lit(self.low)
        cells = [c for c in (row.earlier(other, "number") for other in self.below) if c is not None]
        # least() skips NULLs, so a cell that is no number bounds nothing.
        tops = [F.lit(self.high).cast("double"), *cells]
        top = F.coalesce(F.least(*tops) if cells else tops[0], low + DEFAULT_SPAN)
        top = F.greatest(top, F.when(top > low, top).otherwise(low + 1.0))
        last = F.when(top > low + 2.0, top - 1.0).otherwise(top)
        return F.rint(low + 1.0 + row.draw(name) * F.greatest(last - low - 1.0, F.lit(1.0)))

    def shown(self, name: str, row: _Row) -> Column:
        return super().shown(name, row).cast("bigint").cast("string")


@dataclass(frozen=True)
class Moments(Cells):
    """A day or a time of day, in seconds from the start of the row's month.

    ``place`` is ``sentinel`` (the last day there is), ``month_end`` (of a drawn month)
    or ``month`` (within the row's month, before an earlier column if one is named).
    """

    kind = "moment"
    whole_day: bool
    place: str = "month"
    before: tuple[str, ...] = ()

    def build(self, name: str, row: _Row) -> Column:
        return getattr(self, "_" + self.place)(name, row)

    def _sentinel(self, name: str, row: _Row) -> Column:
        return F.lit((date.fromisoformat(LAST_DAY) - row.start).days * DAY).cast("bigint")

    def _month_end(self, name: str, row: _Row) -> Column:
        months = F.floor(row.draw(name) * (12 * (LAST_YEAR - FIRST_YEAR + 1))).cast("int")
        end = F.last_day(F.add_months(F.lit(date(FIRST_YEAR, 1, 1)), months))
        return F.datediff(end, F.lit(row.start)).cast("bigint") * DAY + (0 if self.whole_day else DAY - 1)

    def _month(self, name: str, row: _Row) -> Column:
        if self.whole_day:
            return F.floor(row.draw(name) * row.days) * DAY
        room = F.lit(row.days * DAY).cast("bigint")
        caps = (row.earlier(other, "moment") for other in self.before)
        cap = next((c for c in caps if c is not None), None)
        if cap is not None:
            room = F.when(cap.isNull(), room).otherwise(F.greatest(cap - 1, F.lit(0)))
        return F.floor(row.draw(name) * room)

    def shown(self, name: str, row: _Row) -> Column:
        at = super().shown(name, row)
        return row.day(at / DAY) if self.whole_day else row.moment(at)


def _phrase(rule: ColumnRule) -> Cells | None:
    """Rules that are told by a phrase, whatever the column's type."""
    has = rule.rules.lower().__contains__
    phrases = [
        (has("unique number"), lambda: Key(rule.field_length or KEY_WIDTH)),
        (has("us states only"), lambda: Choice(tuple(STATES), rule.field_length)),
        (has("counties") and has("state"), lambda: Lookup("STATE", COUNTIES, tuple(OTHER_COUNTIES), rule.field_length)),
    ]
    return next((make() for fits, make in phrases if fits), None)


def _bounds(rule: ColumnRule) -> Bounds:
    found = list(BOUNDS.finditer(rule.rules))
    others = tuple(dict.fromkeys(m.upper() for m in BELOW_FIELD.findall(rule.rules)))
    compares = "<" in rule.rules or ">" in rule.rules
    if compares and not found and not others:
        raise ValueError(f"{rule.name}: no bound can be read from the rule {rule.rules!r}")
    if not found:
        return Bounds(0.0, None, others) if "<" in rule.rules else Bounds(*DEFAULT_RANGE)
    highs = [m.group(2) for m in found if m.group(2) is not None]
    return Bounds(float(found[-1].group(1)), float(highs[-1]) if highs else None, others)


def _moments(rule: ColumnRule) -> Moments:
    whole_day = rule.data_type.strip().lower() == "date"
    if LAST_DAY in rule.rules and not (whole_day and "00:00:00" in rule.rules):
        return Moments(whole_day, "sentinel")
    if "last date of the month" in rule.rules.lower():
        return Moments(whole_day, "month_end")
    return Moments(whole_day, before=tuple(BELOW_FIELD.findall(rule.rules)))


def _text(rule: ColumnRule) -> Cells:
    text = rule.rules.strip()
    options = tuple(o.strip() for o in text.split(",") if o.strip())
    if options and "<" not in text and ">" not in text:
        return Choice(options, rule.field_length) if "," in text else Literal(text, rule.field_length)
    named = rule.data_type.strip().lower() in TEXT_TYPES
    return Numbered(rule.name + "_", rule.field_length) if named else Numbered("")


BY_TYPE = {**dict.fromkeys(NUMBER_TYPES, _bounds), **dict.fromkeys(["date", "datetime"], _moments)}


def parse_rule(rule: ColumnRule) -> Cells:
    """What a rule asks for, read once: a phrase if it holds one, else by the column's type."""
    return _phrase(rule) or BY_TYPE.get(rule.data_type.strip().lower(), _text)(rule)


def synthesize(ids: DataFrame, rules: Sequence[ColumnRule], seed: int, rows: int | None = None) -> DataFrame:
    """One synthetic row per ``id`` (0, 1, 2, ...) of a table, all cells as text.

    Columns are added in as few steps as the rules that look at earlier columns allow.
    """
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"duplicate column names in the rules: {names}")
    row, cells = _Row(seed), {rule.name: parse_rule(rule) for rule in rules}
    table = ids.select(F.col("id").cast("bigint").alias("id"))
    pending: dict[str, Column] = {}
    for name, cell in cells.items():
        if isinstance(cell, Key) and rows is not None and rows > 10**cell.width - 1:
            raise ValueError(f"{name}: {rows} unique numbers do not fit in {cell.width} digits")
        row.used.clear()
        built = cell.build(name, row)
        if row.used & set(pending):
            table = table.select("*", *pending.values())
            pending = {}
        pending[name] = built.alias(PREFIX[cell.kind] + name)
        row.done[name] = cell.kind
    table = table.select("*", *pending.values())
    return table.select(*[cell.shown(name, row).alias(name) for name, cell in cells.items()])


def generate(
    spark: SparkSession, rules: Sequence[ColumnRule], rows: int, seed: int | None = None, parts: int | None = None
) -> DataFrame:
    """``rows`` synthetic rows; the same seed gives the same rows."""
    if rows < 0:
        raise ValueError(f"the number of rows cannot be negative: {rows}")
    seed = random.SystemRandom().randrange(1 << 31) if seed is None else int(seed)
    ids = spark.range(0, rows, 1, parts) if parts else spark.range(rows)
    return synthesize(ids, rules, seed, rows)
