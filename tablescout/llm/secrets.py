"""Secrets in texts: three fixed patterns, and random-looking strings by character Markov models.

In DataFrame expressions only.  The patterns' own finds are labelled samples of random strings,
strings of words in one case and numbers, joined by symbols, are samples of ordinary identifiers.
Other strings have no label.  Transitions from character
to character are counted in the distinct strings of either label; a string that no pattern finds
is a secret too if the log-likelihood ratio of the two models passes a margin.  The ratios travel
as one array of integers inside the expression, so scanning needs no join.
"""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import saved

#: Kinds in the order that spans of one start are listed in.
KINDS = ("assign", "access", "hex", "random")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c in string.ascii_lowercase else c for c in word)


#: Patterns of the first three kinds, the characters that a find's decisive group has at least, and its number.
PATTERNS = {
    "assign": (
        "(" + "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"])) + ")"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2,
    ),
    "access": ("AKIA[A-Z0-9]+", 16, 0),
    "hex": ("[0-9a-f]{32,}", 32, 0),
}

#: Characters of the strings that the models know.
SYMBOLS = string.ascii_letters + string.digits + "+/_-"
LEARNT = r"[A-Za-z0-9+/_-]{8,}"
JUDGED = r"[A-Za-z0-9+/_-]{16,}"

#: What no string labelled as ordinary holds: letters of both cases in a word but for a first capital, or letters beside digits.
MIXED = "[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]|[A-Z][A-Z][a-z]"

#: What each transition counts beforehand; log-likelihood ratio, in thousandths, that a secret passes.
PRIOR, MARGIN = 0.5, 12_000

#: Sizes added up in one go, so that a text of very many finds costs no square of their number.
RUN = 512

SPAN = "array<struct<start:int,end:int,value:string>>"


def _before(sizes: Column, first: Column) -> Column:
    """``first`` plus the sum of the sizes before each."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    added = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sizes, start, added)["out"]


def _running(sizes: Column) -> Column:
    """The sum of the sizes before each, in runs."""
    starts = F.filter(F.sequence(F.lit(1), F.size(sizes) + 1, F.lit(RUN)), lambda at: at <= F.size(sizes))
    runs = F.transform(starts, lambda at: F.slice(sizes, at, RUN))
    offsets = _before(F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(runs, offsets, _before))


def with_spans(texts: DataFrame, name: str, text: str, pattern: str, least: int, group: int = 0) -> DataFrame:
    """``texts`` with a column of the spans of one pattern: leftmost matches that don't overlap, those with a short group dropped.

    Places are code points, the end exclusive; ``value`` is the group.  Texts without a match are scanned once.
    """
    hit, found, gaps, values, sizes = (f"__{c}" for c in ("hit", "found", "gaps", "values", "sizes"))
    regex = F.lit(pattern)
    parts = (
        texts.withColumn(hit, F.when(F.regexp_like(F.col(text), regex), F.col(text)))
        .withColumn(found, F.regexp_extract_all(hit, regex, F.lit(0)))
        .withColumn(values, F.regexp_extract_all(hit, regex, F.lit(group)))
        .withColumn(gaps, F.split(F.col(hit), pattern, -1))
        .withColumn(gaps, F.slice(F.col(gaps), 1, F.size(found)))
        .withColumn(sizes, F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.char_length(m)))
        .withColumn(sizes, _running(F.col(sizes)))
    )
    starts = F.zip_with(sizes, gaps, lambda at, g: at + F.char_length(g))
    spans = F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), (at + F.char_length(m)).alias("end")))
    spans = F.zip_with(spans, values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= least)
    return parts.withColumn(name, F.coalesce(spans, F.array().cast(SPAN))).drop(hit, found, gaps, values, sizes)


def base_spans(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with a column of spans for each of the fixed kinds."""
    for kind, (pattern, least, group) in PATTERNS.items():
        texts = with_spans(texts, kind, text, pattern, least, group)
    return texts


def _place(text: Column, at: Column) -> Column:
    """Place of one character in SYMBOLS, from 1; 0 for none."""
    return F.call_function("locate", F.substring(text, at, F.lit(1)), F.lit(SYMBOLS))


def transition_counts(values: DataFrame) -> DataFrame:
    """Rows (random, before, after, n) over strings (value, random): places in SYMBOLS, 0 before the first."""
    steps = values.select("random", "value", F.explode(F.sequence(F.lit(1), F.char_length("value"))).alias("at"))
    before = F.when(F.col("at") == 1, 0).otherwise(_place(F.col("value"), F.col("at") - 1))
    return steps.groupBy("random", before.alias("before"), _place(F.col("value"), F.col("at")).alias("after")).agg(F.count("*").alias("n"))


def log_ratios(counts: list[tuple[bool, int, int, int]]) -> list[int]:
    """Log-likelihood ratios of the transitions in thousandths, at ``before * (symbols + 1) + after``.

    ``counts`` are rows (random, before, after, n); a label without samples counts as uniform.
    """
    size = len(SYMBOLS) + 1
    n = {(bool(r), b, a): n for r, b, a, n in counts}
    out = [0] * (size * size)
    for before in range(size):
        total = {r: sum(n.get((r, before, a), 0) for a in range(1, size)) + PRIOR * len(SYMBOLS) for r in (True, False)}
        for after in range(1, size):
            share = {r: (n.get((r, before, after), 0) + PRIOR) / total[r] for r in (True, False)}
            out[before * size + after] = round(1000 * (math.log(share[True]) - math.log(share[False])))
    return out


def randomness(value: Column, ratios: list[int]) -> Column:
    """Log-likelihood ratio of a string of SYMBOLS, in thousandths."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<int>")
    start = F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, at: Column) -> Column:
        after = _place(value, at)
        return F.struct(after.alias("before"), (acc["sum"] + F.get(table, acc["before"] * (len(SYMBOLS) + 1) + after)).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), start, step)["sum"]


def labelled_strings(texts: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """Distinct strings (value, random): those that a fixed pattern finds, and others of the texts that look ordinary."""
    parts = F.flatten(F.transform("assign", lambda s: F.regexp_extract_all(s["value"], F.lit(LEARNT), F.lit(0))))
    whole = F.transform(F.concat("access", "hex"), lambda s: s["value"])
    random = spans.select(F.explode(F.concat(parts, whole)).alias("value")).distinct()
    every = texts.select(F.explode(F.regexp_extract_all(text, F.lit(LEARNT), F.lit(0))).alias("value")).distinct()
    ordinary = every.where(~F.col("value").rlike(MIXED)).join(random, "value", "left_anti")
    return random.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: int = MARGIN) -> DataFrame:
    """One row per row of ``docs``: id, and the arrays of spans (start, end, value) assign, access, hex, random.

    The first three are the fixed patterns' finds.  ``random`` has strings of 16 or more symbols
    that overlap none of them and whose log-likelihood ratio is above ``margin`` thousandths.
    Null and empty texts have no spans; repeated rows are scanned each and learnt from once; other
    columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Spans are few: the table has no texts.
    spans = saved(with_spans(base_spans(texts), "runs", "text", JUDGED, 1).drop("text"))
    seen = transition_counts(labelled_strings(texts, spans)).collect()
    ratios = log_ratios([tuple(r) for r in seen])
    base = F.concat("assign", "access", "hex")
    apart = F.filter("runs", lambda r: ~F.exists(base, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    found = F.filter(apart, lambda r: randomness(r["value"], ratios) > margin)
    return spans.select(F.col("id").alias(id_col), "assign", "access", "hex", found.alias("random"))


def span_list(*kinds: str) -> Column:
    """``kind:start:end`` of the spans in columns of these names, by start, then kind, joined by commas."""
    def tagged(place: int) -> Column:
        return F.transform(kinds[place], lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end")))

    every = F.array_sort(F.concat(*map(tagged, range(len(kinds)))))
    names = F.array(*map(F.lit, kinds))
    named = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(every, named), ",")
