"""Benchmark items inside documents: size-partitioned MinHash containment, verified exactly.

An item is contained in a document if enough of its distinct word shingles are.  Items are
partitioned by size.  Each keeps the least hashes of its shingles, as many as its size class
demands so that a document with the needed share cannot miss all of them: if at most m shingles
may be absent, m + 1 minima.  A document's shingle hashes that hit a kept minimum make the item a
candidate, unless the document has too few shingles for its size class; exact shingle sets decide.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import small_batches, words

#: Bytes of benchmark text that one pass over the documents searches for; more text means more passes.
PASS_BYTES = 16_000_000

#: Bits of the filter that hashes pass before they are looked up.
FILTER_BITS = 22

FOUND = "array<struct<item_id:long,n_shingles:int,n_shared:int,containment:double>>"
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word -> 64-bit hash, filled as words come and emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word) | zlib.crc32(word[::-1], 0x5BD1E995) << 32
        return value

    def shingles(self, found: list[bytes], width: int) -> np.ndarray:
        """Hashes of the word shingles in order; none where the words are too few."""
        if len(found) < width:
            return np.zeros(0, np.uint64)
        one = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        total = len(found) - width + 1
        out = np.zeros(total, np.uint64)
        for k in range(width):
            out = (out ^ one[k : k + total]) * MIX
            out ^= out >> np.uint64(29)
        return out


class Benchmark:
    """Items by their size classes and kept minima, and the exact search through a document."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, width: int):
        self.threshold, self.items, hashes = threshold, {}, Hashes()
        minima: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for place, (item_id, text) in enumerate(items):
            found = words(text)
            own = min(width, len(found))
            if not own:
                continue
            sets = {tuple(found[i : i + own]) for i in range(len(found) - own + 1)}
            needed = self.needed(len(sets))
            marks = np.unique(hashes.shingles(found, own))
            self.items[place] = (item_id, own, sets, needed, marks)
            # A size class spans (2^(k-1), 2^k] shingles; all its items keep as many minima as its largest needs.
            top = 1 << (len(sets) - 1).bit_length()
            keep = min(len(sets), max(top - self.needed(top), len(sets) - needed) + 1)
            for h in marks[:keep].tolist():
                minima[own][h].append(place)
        self.classes = {}
        for own, table in minima.items():
            bloom = np.zeros(1 << FILTER_BITS, bool)
            bloom[np.fromiter(table, np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
            self.classes[own] = (bloom, dict(table))

    def needed(self, size: int) -> int:
        """The least number of ``size`` shingles that is the threshold's share of them."""
        return max(1, int(np.ceil(self.threshold * size - 1e-9)))

    def search(self, text: str | None, hashes: Hashes) -> list[dict]:
        found, hits = words(text), []
        for own, (bloom, table) in self.classes.items():
            marks = hashes.shingles(found, own)
            kept = marks[bloom[marks >> np.uint64(64 - FILTER_BITS)]]
            candidates = {place for h in set(kept.tolist()) for place in table.get(h, ())}
            for place in candidates:
                item_id, _, sets, needed, item_marks = self.items[place]
                # Too few shingles for its size class: the item can't be contained.
                if needed > len(marks):
                    continue
                # Shared shingles share hashes, so only places with an item's hash are looked at as words.
                places = np.flatnonzero(np.isin(marks, item_marks)).tolist()
                shared = len(sets & {tuple(found[i : i + own]) for i in places})
                if shared >= needed:
                    hits.append({"item_id": item_id, "n_shingles": len(sets), "n_shared": shared, "containment": shared / len(sets)})
        return sorted(hits, key=lambda hit: hit["item_id"])


def contained_items(
    text: Column, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, item_col: str = "item_id", item_text: str = "text"
) -> Column:
    """An array of the benchmark items contained in each text: item_id, n_shingles, n_shared, containment.

    Shingles have ``width`` words (A-Z lower-cased, between blanks); an item of fewer words is one
    shingle of them all, and one without words is contained nowhere.  Null texts are empty; items
    with a null id or text are left out; repeated items are found as often as they stand there.
    The items are read in parts of about ``PASS_BYTES``, each of which is searched for in all of
    the texts: one part for any usual benchmark, more passes for a larger one.
    """
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text) + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // PASS_BYTES))
    part = F.pmod(F.xxhash64(item_col, item_text), F.lit(parts))
    found = []
    for k in range(parts):
        rows = items.where(part == k).select(F.col(item_col).cast("long"), item_text).collect()
        found.append(_search_column(text, [(r[0], r[1]) for r in rows], threshold, width))
    return found[0] if parts == 1 else F.array_sort(F.concat(*found))


def _search_column(text: Column, items: list[tuple[int, str]], threshold: float, width: int) -> Column:
    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, hashes = Benchmark(items, threshold, width), Hashes()
        for texts in batches:
            yield pd.Series([known.search(t, hashes) for t in texts])

    return search(F.coalesce(text, F.lit("")))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row (id, item_id, n_shingles, n_shared, containment) per document and item contained in it.

    Rows with a null id are searched too; repeated rows of ``docs`` give repeated results.
    """
    small_batches(docs.sparkSession)
    hits = docs.select(F.col(id_col), F.explode(contained_items(F.col(text_col), benchmark, threshold, width)).alias("hit"))
    return hits.select(id_col, "hit.*")
