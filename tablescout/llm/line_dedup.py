"""Repeated lines dropped across documents, in DataFrame expressions only.

Line hashes are range-partitioned by (hash, salt) and sorted by document and position within.  A
pass over that order streams the first occurrence of each line in each document and, per slice,
counts documents; slices then add up to one row per line.  The salt cuts a line that a third of
all documents share into many slices.  Decisions return as sparse 64-bit words of a bitmap per
document; texts are never sorted and meet their bitmaps in one join on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import BLANKS, lower_ascii, saved
from tablescout.llm.components import split_join

#: Slices that the rows of one line are dealt to.
SALTS = 256


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z lower-cased."""
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Which lines go: rows (doc, text_hash, word, bits) for the 64-line words that lose a line.

    Bit ``i`` of ``word`` w set means that line 64 w + i of the document goes.  A line goes if its
    key has at least ``min_chars`` code points, stands in at least ``min_docs`` documents, and a
    larger document id has it too.  A document is an id: rows that repeat an id count once, and
    rows with a null id neither count nor lose lines.  ``text_hash`` tells apart rows that share
    an id but not a text; equal rows share a bitmap.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(_lines(text)).alias("pos", "line")
    )
    # Only lines that can be long enough once stripped go on; the key is made once.
    keyed = (
        rows.where(F.octet_length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    )
    lines = saved(keyed)
    # The salt follows from the document, so one document's copies of a line meet in one slice.
    ordered = lines.withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS))).repartitionByRange("h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc"), "pos")
    firsts = ordered.withColumn("before", F.lag("doc").over(stream)).where(
        F.col("before").isNull() | (F.col("before") != F.col("doc"))
    )
    shared = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(
        F.col("n") >= min_docs
    )
    going = split_join(lines, shared, "h1", "h2").where(F.col("doc") < F.col("last"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("pos"), F.lit(64)))
    word = F.floor(F.col("pos") / 64).cast("int").alias("word")
    return going.groupBy("doc", "text_hash", word).agg(F.bit_or(bit).alias("bits"))


def _positions(words: Column) -> Column:
    """Positions of the set bits in an array of (word, bits)."""
    places = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(
        F.transform(
            words,
            lambda w: F.transform(F.filter(places, lambda b: F.getbit(w["bits"], b) == 1), lambda b: w["word"] * 64 + b),
        )
    )


def drop_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated lines cut out of the text, and three more columns.

    ``__n_lines`` counts the lines before, ``__dropped`` lists the positions that went, and the
    text column holds the rest joined by line feeds.  A null text is one empty line and becomes
    the empty text.  Rows with a null id keep all lines; repeated rows are treated alike.
    """
    bitmaps = (
        keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
        .groupBy(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"))
        .agg(F.collect_list(F.struct("word", "bits")).alias("__words"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Bitmaps are the small side of each task; texts stream past them without being sorted.
    met = docs.withColumn("__text_hash", F.xxhash64(text)).join(
        bitmaps.hint("shuffle_hash"),
        (F.col(id_col) == F.col("__doc")) & (F.col("__text_hash") == F.col("__hash")),
        "left",
    )
    none = F.array().cast("array<int>")
    met = met.withColumn("__dropped", F.coalesce(F.array_sort(_positions(F.col("__words"))), none))
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return (
        met.withColumn("__n_lines", F.size(lines))
        .withColumn(text_col, F.when(F.size("__dropped") == 0, text).otherwise(rest))
        .drop("__text_hash", "__doc", "__hash", "__words")
    )
