"""SimHash near-duplicates by a generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits.  Thresholds t_i with
``sum(t_i + 1) = r + 1`` make sure that fingerprints within r bits agree up to t_i bits in some
partition i.  Which partitions and thresholds are cheapest is found by dynamic programming on
candidate counts estimated from a sample of fingerprints; the choice affects cost, not results.
Probing is by deletion: a partition with threshold t gives a key for every choice of t of its
bits masked out, so fingerprints within t bits there share a key.  The fingerprints of a key are
verified against each other and leave a spanning forest of their true links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import saved, small_batches, words
from tablescout.llm.components import components, split_join

#: Fingerprints that partitions and thresholds are chosen by: those with the least hash.
SAMPLE = 2_000

#: Numbers of partitions to choose from, and the most masks a partition may need.
PARTITIONS, MOST_MASKS = (2, 3, 4), 600

#: Rows of a key above which its fingerprints are verified in blocks by several tasks.
BLOCK = 4_096

#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of word shingles by XXH64 with seed 42; fewer words make one shingle, none give zero."""
    import xxhash

    found = words(text)
    if not found:
        return 0
    line, size = b" ".join(found), len(found)
    lengths = np.fromiter(map(len, found), np.int64, size)
    ends = np.cumsum(lengths + 1) - 1
    starts, width = ends - lengths, min(shingle, size)
    hash_of, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), size - width + 1
    for at in range(0, total, CHUNK):
        to = min(at + CHUNK, total)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.array([hash_of(line[a:b], 42) for a, b in spans], np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """Fingerprints as signed 64-bit numbers; a null text counts as empty and gives zero."""

    @F.pandas_udf("long")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return mark(F.coalesce(text, F.lit("")))


def _bits(prints: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones per fingerprint."""
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each grows by the free bit most correlated with its bits."""
    bits = _bits(sample).astype(np.float64)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    like = np.abs(centred.T @ centred) / max(1, len(bits))
    free, groups = set(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, groups))) // (parts - k)
        group = [max(sorted(free), key=lambda b: like[b, sorted(free - {b})].max(initial=0))]
        free.discard(group[0])
        while len(group) < width:
            group.append(max(sorted(free), key=lambda b: like[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, groups: list[list[int]], radius: int, n: float, least_bits: int = 0) -> tuple[float, list[int]]:
    """Cost and thresholds (-1: unused) with ``sum(t + 1) = radius + 1`` by dynamic programming.

    The cost of a threshold is the keys it makes plus the pairs it is estimated to bring together
    among ``n`` fingerprints, each pair as often as its keys meet.  Keys keep ``least_bits`` bits at least.
    """
    bits, pairs = _bits(sample), max(1, len(sample) * (len(sample) - 1) // 2)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        own = bits[:, group].astype(np.float32)
        ones = own.sum(axis=1)
        far = np.rint(ones[:, None] + ones[None, :] - 2 * own @ own.T).astype(np.int64)
        near = np.bincount(far[np.triu_indices(len(sample), 1)], minlength=radius + 1)
        costs = [(0, 0.0)]
        for t in range(radius + 1):
            masks = comb(len(group), t)
            if not 0 < masks <= MOST_MASKS or len(group) - t < least_bits:
                break
            met = sum((near[d] + 0.1 / (d + 1)) * comb(len(group) - d, t - d) for d in range(t + 1))
            costs.append((t + 1, 4.0 * n * masks + met * 0.05 * n * n / 2 / pairs))
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for more, extra in costs:
                if used + more <= radius + 1 and cost + extra < following.get(used + more, (np.inf,))[0]:
                    following[used + more] = (cost + extra, [*chosen, more - 1])
        best = following
    return best.get(radius + 1, (np.inf, []))


def _masks(groups: list[list[int]], thresholds: list[int]) -> list[tuple[int, int]]:
    """(number, mask of the bits kept) for each key that a fingerprint gives."""
    keep = [
        sum(1 << b for b in group) & ~sum(1 << b for b in gone)
        for group, t in zip(groups, thresholds, strict=True)
        if t >= 0
        for gone in combinations(group, t)
    ]
    return list(enumerate(keep))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between fingerprints of two blocks (or one with itself) that join what was apart."""
    names = np.unique(np.concatenate([left, right]))
    label = np.arange(len(names))
    links, heads, spots = [], np.searchsorted(names, left), np.searchsorted(names, right)
    for a, head in zip(left, heads, strict=True):
        near = np.flatnonzero(np.bitwise_count(right ^ a) <= radius)
        apart, first = np.unique(label[spots[near]], return_index=True)
        for other, j in zip(apart, near[first], strict=True):
            if other != label[head]:
                links.append((int(a.view(np.int64)), int(right[j].view(np.int64))))
                label[label == other] = label[head]
    return links


def _linker(radius: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (mask, key, pair, side); each run of one pair is verified on its own."""
        rest = None
        for batch in batches:
            rows = np.column_stack([batch[c].to_numpy(np.int64) for c in ("mask", "key", "pair", "side", "fp")])
            rows = rows if rest is None else np.concatenate([rest, rows])
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            # The last run may go on in the next batch; a run has at most two blocks of rows.
            last = cuts[-1] if len(cuts) else 0
            yield _verified(rows[:last], cuts[:-1], radius)
            rest = rows[last:]
        if rest is not None and len(rest):
            yield _verified(rest, np.zeros(0, np.int64), radius)

    return link


def _verified(rows: np.ndarray, cuts: np.ndarray, radius: int) -> pd.DataFrame:
    links: list[tuple[int, int]] = []
    starts, ends = np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [len(rows)]]).astype(np.int64)
    two = np.flatnonzero(ends - starts == 2)  # most keys with company have two fingerprints
    if len(two):
        a, b = rows[starts[two], 4].view(np.uint64), rows[starts[two] + 1, 4].view(np.uint64)
        near = np.bitwise_count(a ^ b) <= radius
        links += zip(a[near].view(np.int64).tolist(), b[near].view(np.int64).tolist(), strict=True)
    for i in np.flatnonzero(ends - starts > 2):
        run = rows[starts[i] : ends[i]]
        prints = run[:, 4].copy().view(np.uint64)
        second = run[:, 3] == 1
        links += _forest(prints[~second], prints[second] if second.any() else prints, radius)
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def dealt_keys(
    prints: DataFrame, radius: int, partitions: tuple[int, ...] = PARTITIONS, carried: tuple[str, ...] = ("fp",), block: int = BLOCK
) -> DataFrame | None:
    """Rows (mask, key, pair, side, *carried), sorted, in which fingerprints within ``radius`` bits share a key.

    None where there are fewer than two rows.
    """
    n = prints.count()
    if n < 2:
        return None
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plans = []
    for parts in partitions:
        groups = group_bits(sample, parts)
        plans.append((*allocate(sample, groups, radius, n), groups))
    _, thresholds, groups = min(plans, key=lambda plan: plan[0])
    masks = F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("keep")) for i, m in _masks(groups, thresholds)))
    keyed = prints.select(*carried, F.explode(masks).alias("m")).select(
        F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.keep")).alias("key"), *carried
    )
    # Keys of many fingerprints are verified block by block; the table of such keys is short.
    full = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(*carried), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            (F.least(F.col("own"), other) * F.col("blocks") + F.greatest(F.col("own"), other)).alias("pair"),
            (F.col("own") > other).cast("int").alias("side"),
        ),
    )
    dealt = (
        keyed.join(full, ["mask", "key"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("mask", "key", *carried, F.explode(pairs).alias("p"))
        .select("mask", "key", F.col("p.pair").cast("long").alias("pair"), F.col("p.side").alias("side"), *carried)
    )
    return dealt.repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair", "side")


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``) that connect all within ``radius`` bits.

    Not every pair is named: of the fingerprints that share a key a spanning forest of the true
    links remains, which connects the same components.
    """
    tasks = dealt_keys(prints, radius)
    if tasks is None:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("u <> v")
    return tasks.mapInPandas(_linker(radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed 64 bits), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is
    the least id reachable.  Null texts count as empty; empty texts share fingerprint zero and
    are linked like others.  Rows with a null id are kept and take part, but lend no id; if none
    of a component has an id, its component_id is null.  Repeated rows are kept.
    """
    small_batches(docs.sparkSession)
    marked = saved(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")))
    # One row per distinct fingerprint: exact copies meet here, before any search.
    prints = saved(marked.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(near_links(prints.select("fp"), radius))
    grouped = prints.join(found, prints["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = split_join(grouped, least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
