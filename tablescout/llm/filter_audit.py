"""How quality filters interact: what each removes in every order, with exact duplicates as one of them.

A scan judges four rules on each whole text and keeps a narrow row per document.  Exact repeats
are found behind a counting-Bloom prepass: every task adds the cells of its texts to sketches of
its own, the sketches are merged by addition, and a text one of whose cells was met once only is
surely unique.  Only the other texts are shuffled whole, for the exact least id of each.  Flags
then make a mask per document, masks are counted per part, and since counts of masks add up, all
orders of the filters follow from 32 counts of a part.

The sketch is cut into segments, and all cells of a text lie in one of them.  So sketches merge
segment by segment, grow with the corpus, and no task or driver needs the whole of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import BLANK_CLASS, saved
from tablescout.llm.components import split_join

#: Filters in the order of their bits; E is the exact repeat of a text with a smaller id.
FILTERS = "ABCDE"

#: Cells of a segment, cells that a text adds to, and texts that a segment is made for.
CELLS, HASHES, TEXTS = 1 << 16, 3, 1 << 12

#: Bytes of merged sketches up to which they are broadcast; beyond, texts are shuffled by segment.
BROADCAST_BYTES = 64 << 20

ORDERS = ["".join(order) for order in permutations(FILTERS)]


def with_rule_mask(texts: DataFrame) -> DataFrame:
    """``texts`` (column text, no nulls) with ``mask``: bits 0 to 3 for the four rules of one text.

    Under 200 words; under half of them distinct; over 2 % capitals; a symbol of ``#$%&*|``.
    """
    words = F.filter(F.split("text", f"{BLANK_CLASS}+", -1), lambda w: w != "")
    sized = (
        texts.withColumn("words", words)
        .withColumn("all", F.size("words").cast("long"))
        .withColumn("own", F.size(F.array_distinct("words")).cast("long"))
        .withColumn("caps", F.char_length(F.array_join(F.regexp_extract_all("text", F.lit("[A-Z]+"), F.lit(0)), "")).cast("long"))
    )
    rules = [
        F.col("all") < 200,
        100 * F.col("own") < 50 * F.col("all"),
        100 * F.col("caps") > 2 * F.char_length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((rule.cast("int") * (1 << bit) for bit, rule in enumerate(rules)), F.lit(0))
    return sized.withColumn("mask", mask).drop("words", "all", "own", "caps")


def _segment(h: Column, segments: int) -> Column:
    return F.pmod(h, F.lit(segments)).cast("int")


def _cells(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Cells within the segment, a row per text; the same arithmetic as in `_repeats`."""
    return np.stack([(h2 >> (16 * k)) & (CELLS - 1) for k in range(HASHES)], axis=1)


def _sketches(hashes: DataFrame, segments: int) -> DataFrame:
    """Rows (segment, bits): 64-bit words whose set bits are cells met twice or more, over all ``hashes`` (h1, h2)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h1, h2 = batch["h1"].to_numpy(np.int64), batch["h2"].to_numpy(np.int64)
            cells = ((h1 % segments) * CELLS)[:, None] + _cells(h1, h2)
            # A text's cells count once each, also where two of them are the same.
            cells.sort(axis=1)
            once = np.ones(cells.shape, bool)
            once[:, 1:] = cells[:, 1:] != cells[:, :-1]
            found, times = np.unique(cells[once], return_counts=True)
            starts = np.flatnonzero(np.diff(found // CELLS, prepend=-1))
            ends = np.append(starts[1:], len(found))
            yield pd.DataFrame({
                "segment": (found[starts] // CELLS).astype(np.int32),
                "cells": [(found[a:b] % CELLS).astype(np.uint16).tobytes() for a, b in zip(starts, ends, strict=True)],
                "counts": [np.minimum(times[a:b], 255).astype(np.uint8).tobytes() for a, b in zip(starts, ends, strict=True)],
            })

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by segment; one array of counters is held at a time."""
        now, counters = None, np.zeros(CELLS, np.int64)

        def done() -> pd.DataFrame:
            packed = np.packbits(counters >= 2, bitorder="little").view("<i8")
            return pd.DataFrame({"segment": np.array([now], np.int32), "bits": [packed]})

        for batch in batches:
            for segment, cells, counts in zip(batch["segment"], batch["cells"], batch["counts"], strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, counters = segment, np.zeros(CELLS, np.int64)
                counters[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint8)
        if now is not None:
            yield done()

    own = hashes.mapInPandas(count, "segment int, cells binary, counts binary")
    return own.repartition("segment").sortWithinPartitions("segment").mapInPandas(merge, "segment int, bits array<long>")


def _maybe_repeated(bits: Column, h2: Column) -> Column:
    """Whether every cell of a text was met twice or more."""
    met = F.lit(True)
    for k in range(HASHES):
        cell = F.call_function("shiftrightunsigned", h2, F.lit(16 * k)).bitwiseAND(F.lit(CELLS - 1)).cast("int")
        word = F.get(bits, F.call_function("shiftright", cell, F.lit(6)))
        met = met & (F.getbit(word, cell.bitwiseAND(F.lit(63))) == 1)
    return met


def repeated_ids(texts: DataFrame, hashes: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (h1, h2, least) of the texts that stand in several rows: the least id that has the text.

    ``texts`` has columns id, text, h1, h2 (64-bit hashes of the text), ``hashes`` the last two of
    the same rows.  The rows returned may name a few unique texts too, with their own id.
    """
    segments = max(1, -(-hashes.count() // TEXTS))
    sketches = saved(_sketches(hashes, segments))
    keyed = texts.withColumn("segment", _segment(F.col("h1"), segments))
    if segments * CELLS // 8 <= broadcast_bytes:
        met = keyed.join(F.broadcast(sketches), "segment")
    else:
        met = split_join(keyed, sketches, "segment")
    some = met.where(_maybe_repeated(F.col("bits"), F.col("h2")))
    return some.groupBy("text").agg(F.min("id").alias("least"), F.first("h1").alias("h1"), F.first("h2").alias("h2")).select(
        "h1", "h2", "least"
    )


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of a part that fail exactly the filters of ``mask``.

    ``labels`` has rows (id, good, toxic) of zeros and ones; of several for an id the largest
    count, ids without one are neither.  Null parts and texts count as empty.  Rows with a null id
    never repeat another, and no other repeats them; of rows that share id and text none repeats
    the other.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text, F.lit(1)).alias("h1"), F.xxhash64(text, F.lit(2)).alias("h2"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    )
    rows = saved(with_rule_mask(own).drop("text"))
    least = repeated_ids(own.select("id", "text", "h1", "h2"), rows.select("h1", "h2"), broadcast_bytes)
    judged = split_join(rows, saved(least), "h1", "h2", how="left")
    mask = F.col("mask") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)
    known = labels.toDF("id", "good", "toxic").where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max("good").alias("good"), F.max("toxic").alias("toxic")
    )
    flagged = judged.select("id", "part", mask.alias("mask")).join(known, "id", "left")
    yes = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    return flagged.groupBy("part", "mask").agg(F.count("*").alias("n"), yes("good"), yes("toxic"))


def _sums() -> tuple[np.ndarray, ...]:
    """For each order and step, which masks count as kept, removed, redundant, failing this filter only."""
    masks = np.arange(32)
    kept, removed, redundant, only = (np.zeros((len(ORDERS) * 5, 32), np.int64) for _ in range(4))
    for row, (order, step) in enumerate((o, s) for o in ORDERS for s in range(5)):
        before = sum(1 << FILTERS.index(f) for f in order[:step])
        own = 1 << FILTERS.index(order[step])
        fails, earlier = masks & own > 0, masks & before > 0
        kept[row], removed[row] = ~fails & ~earlier, fails & ~earlier
        redundant[row], only[row] = fails & earlier, masks == own
    return kept, removed, redundant, only


def filter_orders(counts: DataFrame) -> DataFrame:
    """All 120 orders and their five steps for every part of ``counts`` (part, mask, n, good, toxic).

    One row per (part, filter_order, step) with kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, the filter's removals summed over all orders.  No counts give no rows.
    """
    cell = lambda c, m: F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0))
    wide = counts.groupBy("part").agg(*(F.array(*(cell(c, m) for m in range(32))).alias(c) for c in ("n", "good", "toxic")))
    steps = len(ORDERS) * 5

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, removed, redundant, only = _sums()
        names, places = np.repeat(ORDERS, 5), np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))
        letters = np.array([order[step] for order in ORDERS for step in range(5)])
        for batch in batches:
            for part, n, good, toxic in zip(batch["part"], batch["n"], batch["good"], batch["toxic"], strict=True):
                gone = removed @ n
                total = {f: int(gone[letters == f].sum()) for f in FILTERS}
                yield pd.DataFrame({
                    "part": [part] * steps, "filter_order": names, "step": places, "kept": kept @ n, "removed": gone,
                    "redundant": redundant @ n, "unique_fails": only @ n, "good_lost": removed @ good,
                    "toxic_lost": removed @ toxic, "shapley": [total[f] for f in letters],
                })

    return wide.mapInPandas(
        expand,
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long",
    )
