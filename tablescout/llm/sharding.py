"""Shards of near-equal size by best-fit-decreasing packing of indivisible groups.

Rows with equal texts form a group that stays together.  Groups too large to blend in are items of
their own; there can be only so many of them.  All others are dealt by hash into cells of rising
width, each an item, so that the packing ends with small ones.  The items, a bounded list however
many rows there are, are packed on the driver: in order of size, each into the bin with the least
room that still takes it, found in a balanced tree of the bins' rooms.
"""

from __future__ import annotations

import random
from collections.abc import Hashable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import saved

#: Cells per shard that small groups are dealt to, and the share of a shard from which a group is its own item.
CELLS = 256


class RoomTree:
    """Bins in a balanced (randomised) search tree by (room, bin)."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, priority, left, right]
        self._random = random.Random(0)

    def add(self, room: int, which: int) -> None:
        low, high = self._split(self._root, (room, which))
        self._root = self._merge(self._merge(low, [(room, which), self._random.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (room, bin) with the least room of at least ``size``."""
        node, best = self._root, None
        while node:
            if node[0] >= (size, -1):
                node, best = node[2], node[0]
            else:
                node = node[3]
        if best:
            low, rest = self._split(self._root, best)
            _, high = self._split(rest, (best[0], best[1] + 1))
            self._root = self._merge(low, high)
        return best

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if not node:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]


def best_fit_decreasing(items: Sequence[tuple[Hashable, int]], capacity: int) -> dict[Hashable, int]:
    """Bin of each (name, size): the largest first, each into the tightest bin, else a new one."""
    rooms, bins, placed = RoomTree(), 0, {}
    for name, size in sorted(items, key=lambda item: (-item[1], str(item[0]))):
        room, which = rooms.take_tightest(size) or (capacity, bins)
        bins += which == bins
        if size > room:
            raise ValueError(f"item {name!r} of size {size} exceeds the capacity {capacity}")
        placed[name] = which
        rooms.add(room - size, which)
    return placed


def level_bins(items: Sequence[tuple[Hashable, int]], bins: int) -> dict[Hashable, int]:
    """Items in exactly ``bins`` bins, as level as indivisible items allow.

    An item larger than an even share of what is left gets a bin alone.  The others are packed at
    the least capacity, found by bisection, at which best fit decreasing needs no more bins.
    """
    rest, placed, free = sorted(items, key=lambda item: (-item[1], str(item[0]))), {}, bins
    while rest and free > 1 and rest[0][1] * free > sum(size for _, size in rest):
        placed[rest.pop(0)[0]] = bins - free
        free -= 1
    low = max(-(-sum(size for _, size in rest) // free), rest[0][1] if rest else 0)
    high, best = 2 * low + 1, None
    while best is None or low < high:
        middle = high if best is None else (low + high) // 2
        packed = best_fit_decreasing(rest, middle)
        if max(packed.values(), default=0) < free:
            high, best = middle, packed
        elif best is None:
            high *= 2
        else:
            low = middle + 1
    return placed | {name: bins - free + which for name, which in best.items()}


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1.  The law is ``bytes``: shards hold near-equal sizes, and
    rows of equal texts share a shard; where one group outweighs an even share it has a shard
    alone and the others are levelled.  A null text has no bytes and belongs to the group of empty
    texts; null ids and repeated rows are kept, each with its own slot.  Slots count from 0
    without gaps in each shard, in no particular order.  ``grown_shard`` is null under this law.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"),
        )
    )
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # A group is its hash and CRC: texts that shared both would only stay together needlessly.
    groups = rows.groupBy("h", "text_crc32").agg(F.sum("size").alias("bytes"))
    large_from = max(2, total // (shards * CELLS))
    # Widths run from almost nothing to twice the mean: equal steps of the hash's square root.
    spot = F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)
    cell = F.least(F.floor(F.sqrt(spot) * (shards * CELLS)), F.lit(shards * CELLS - 1)).cast("long")
    item = F.when(F.col("bytes") >= large_from, F.format_string("%d/%d", "h", "text_crc32"))
    dealt = groups.select("h", "text_crc32", "bytes", item.alias("item"), cell.alias("cell"))
    # At most shards * CELLS large groups by their size, and as many cells.
    large = dealt.where("item IS NOT NULL").select("item", "h", "text_crc32", "bytes").collect()
    cells = dealt.where("item IS NULL").groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()
    placed = level_bins([(r["item"], r["bytes"]) for r in large] + [(r["cell"], r["bytes"]) for r in cells], shards)
    spark = docs.sparkSession
    of_group = spark.createDataFrame(
        [(r["h"], r["text_crc32"], placed[r["item"]]) for r in large], "h long, text_crc32 long, own int"
    )
    of_cell = spark.createDataFrame([(r["cell"], placed[r["cell"]]) for r in cells], "cell long, common int")
    sharded = (
        rows.withColumn("cell", cell)
        .join(F.broadcast(of_group), ["h", "text_crc32"], "left")
        .join(F.broadcast(of_cell), "cell", "left")
        .select("id", "size", "text_crc32", "row", F.coalesce("own", "common").alias("shard"))
    )
    return number_slots(sharded, n_rows).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def number_slots(sharded: DataFrame, n_rows: int) -> DataFrame:
    """``slot``: gapless numbers per shard, given out in slices so that no shard meets in one task."""
    # Slices and the rows of one both grow as the square root of the table.
    slices = max(1, int(n_rows**0.5) // 4)
    cut = sharded.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("shard", "slice").agg(F.count("*").alias("n")).select(
        "shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "slice").orderBy("row")
    numbered = cut.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "slice"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long"))
