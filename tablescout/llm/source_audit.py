"""How the sources of each language diverge in their terms, in exact integer arithmetic.

Terms are counted inside tasks and added up by (lang, source, term).  A group's divergence from
its language depends on a term only through two counts, its own and the language's, so terms are
grouped into cells of equal counts, the value is worked out once per cell, cells are ranked by
cumulative multiplicity, equal values merge, and only the cells that reach the top expand into
terms, in UTF-8 order.  Pairs of sources add their values up in slices of the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import BATCH_ROWS, saved, small_batches
from tablescout.llm.components import split_join

#: Documents of a language that a kept term stands in at least, and the parts that a probability is counted in.
MIN_DOCS, PARTS = 3, 1_000_000_000

#: Ranks listed of each group's terms.
TOP = 200

#: Counted terms that a task holds before it hands them on, and counts that a slice of the vocabulary has.
HELD, SLICE = 400_000, 200_000

#: Cells of a block of (terms x sources) worked out at a time.
BLOCK = 1 << 20

#: Bytes that end a term become blanks; A-Z become a-z; bytes of longer UTF-8 sequences stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased, in UTF-8."""
    return text.encode().translate(TERM_BYTES).split()


def _counted(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n, docs) of each task; the term '' stands once for each group met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in groups.items():
                names = [b"", *n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), len(names)), pa.repeat(pa.scalar(source, pa.string()), len(names)),
                        pa.array(names, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *(in_docs[t] for t in n)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, in_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                in_docs.update(set(found))
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS (count + 1) / (total + kept)), exact for any counts."""
    wide = F.lit(PARTS).cast("decimal(18,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + kept).cast("decimal(20,0)"))


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same on arrays, ``total`` being all counts plus kept terms: long division by decimal digits, so nothing overflows."""
    out, rest = np.divmod(counts + 1, total)
    for _ in range(len(str(PARTS)) - 1):
        digit, rest = np.divmod(rest * 10, total)
        out = out * 10 + digit
    return out + 1


def term_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS
) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms, and the groups: written tables.

    The first has a row (lang, source, term, n, lang_n) for each kept term of a group, with its
    occurrences there and in the whole language; the second a row (lang, source, total, kept,
    lang_total, slices) for every group, also those without terms.  A term is kept if it stands in at least
    ``min_docs`` documents (rows) of its language.  Null texts, languages and sources are empty.
    """
    small_batches(docs.sparkSession, BATCH_ROWS)
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    partial = _counted(docs.select(*(c.alias(str(i)) for i, c in enumerate(plain))))
    found = saved(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    real = found.where("term <> ''")
    kept = saved(
        real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).drop("docs")
    )
    counts = saved(split_join(real.drop("docs"), kept, "lang", "term"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms_of = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    rows_of = counts.groupBy("lang").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = found.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left")
    groups = groups.join(terms_of, "lang", "left").join(rows_of, "lang", "left").select(
        "lang", "source", zero("total"), zero("kept"), zero("lang_total"), F.coalesce("slices", F.lit(1)).alias("slices")
    )
    return counts, saved(groups)


def term_ranks(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (lang, source, item, value, rank): the terms more frequent in the group than in its language, by value.

    Equal values rank in the UTF-8 order of the terms; ranks end at ``top``.
    """
    cells = counts.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms"))
    cells = split_join(cells, groups.drop("slices"), "lang", "source").select(
        "lang", "source", "n", "lang_n", "terms",
        _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    cells = saved(cells.where("p > q").select("lang", "source", "n", "lang_n", "terms", value.alias("value")))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    # Each value has a term at least, so no value beyond the first `top` ones can reach a rank.
    first = merged.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= top)
    above = F.coalesce(F.sum("terms").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = first.withColumn("above", above).where(F.col("above") < top).select("lang", "source", "value", "above")
    open_cells = saved(cells.join(reached, ["lang", "source", "value"]).drop("terms"))
    level = Window.partitionBy("lang", "source", "value").orderBy("term")
    listed = split_join(counts, open_cells, "lang", "source", "n", "lang_n").withColumn("place", F.row_number().over(level))
    ranked = listed.where(F.col("place") <= top).withColumn("rank", (F.col("above") + F.col("place")).cast("int"))
    return ranked.where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _pair_values(counts: pd.DataFrame, groups: pd.DataFrame) -> np.ndarray:
    """Sums over the terms of ``counts`` of floor((p - q)^2 / q), a row per group and a column per other source."""
    size = len(groups)
    sums = np.zeros((size, size), np.int64)
    if not len(counts):
        return sums
    totals = (groups["total"] + groups["kept"]).to_numpy(np.int64)
    places = pd.Index(groups["source"]).get_indexer(counts["source"])
    row = pd.factorize(counts["term"])[0]
    order = np.argsort(row, kind="stable")
    row, places, n = row[order], places[order], counts["n"].to_numpy(np.int64)[order]
    step = max(1, BLOCK // size)
    for at in range(0, int(row[-1]) + 1, step):
        a, b = np.searchsorted(row, [at, at + step])
        block = np.zeros((min(step, int(row[-1]) + 1 - at), size), np.int64)
        block[row[a:b] - at, places[a:b]] = n[a:b]
        p = _shares(block, totals[None, :])
        for other in range(size):
            q = p[:, other, None]
            sums[:, other] += ((p - q) ** 2 // q).sum(axis=0)
    return sums


def pair_ranks(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value, rank): every other source of the language, by value and then by name.

    The value adds up over all kept terms of the language; without kept terms it is zero.
    """
    slices = groups.select("lang", "slices").distinct()
    dealt = split_join(counts.select("lang", "source", "term", "n"), slices, "lang")
    dealt = dealt.withColumn("slice", F.pmod(F.hash("term"), F.col("slices"))).drop("slices")
    sides = groups.select("lang", "source", "total", "kept", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def add(own: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", ignore_index=True)
        names, size = sources["source"].to_numpy(object), len(sources)
        apart = ~np.eye(size, dtype=bool).ravel()
        return pd.DataFrame({
            "lang": sources["lang"].iloc[0] if size else None, "source": np.repeat(names, size)[apart], "item": np.tile(names, size)[apart],
            "value": _pair_values(own, sources).ravel()[apart],
        })

    partial = dealt.groupBy("lang", "slice").cogroup(sides.groupBy("lang", "slice")).applyInPandas(
        add, "lang string, source string, item string, value long"
    )
    summed = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(falling))


def source_divergence(docs: DataFrame, **options) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of both parts, ``pair`` and ``term``; options as for `term_counts`.

    Every (lang, source) that occurs takes part, also without terms.  Repeated rows count as often
    as they stand there, other columns are not read, and an empty table gives no rows.
    """
    counts, groups = term_counts(docs, **options)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pair_ranks(counts, groups).select(columns("pair")).unionByName(term_ranks(counts, groups).select(columns("term")))
