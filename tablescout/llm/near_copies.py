"""Near copies: texts whose sets of word shingles have a Jaccard similarity of a threshold or more.

Texts with the same shingles are one node.  Candidates come from SimHash's pigeonhole search with a
wide radius, in one shuffle: how many tasks share a key is estimated from the sample that the keys
are chosen by.  Nodes of a key are compared only within the sizes that allow the similarity; a second
sketch, one bit of each of 96 minima of the shingle hashes, refuses most of the pairs where they are found.  Every link is then verified on the sets of shingle hashes.  The first
round verifies only forests of candidates, nearest first, so a large group of copies costs about
one check a node.  Groups that a refused candidate leaves open are settled in a second round: their
nodes meet block by block with their sets of hashes, every candidate that could still join two
groups is checked on the spot, and only links that do so come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import saved, words
from tablescout.llm.components import components, split_join
from tablescout.llm.simhash import SAMPLE, allocate, group_bits

#: Words of a shingle and the least Jaccard similarity of near copies.
SHINGLE, SIMILAR = 5, 0.8

#: Bits that candidates may differ in.  At a similarity of 0.8 about 10 are expected, with a deviation of 3;
#: measured on the test data 0.987 of the links or more lie within 14 (README).
RADIUS = 14

#: Partitions of the pigeonhole search, and bits that its keys keep at least.  For so wide a radius fewer and
#: wider partitions bring hardly fewer pairs together, but need several times the keys.
PARTITIONS, LEAST_BITS = 8, 6

#: Minima whose bits make the second sketch, and the bits of it that candidates may differ in: at a
#: similarity of 0.8 a tenth of them is expected to, with a deviation of 2.9; of unlike texts, half.
MINIMA, APART = 96, 23

#: Bits of the packed half of the sketch that hold the size of the set.
SIZE_BITS = 32
SIZES = (1 << SIZE_BITS) - 1

#: Bits of a run's number that hold the key.
KEY_BITS = 64 // PARTITIONS

#: Fingerprints compared with as many others at a time; rows of a key that make a block, or this share of all
#: nodes if that is more, but never more than the last.
STRIP, OTHERS, BLOCK, BLOCK_SHARE, MOST_BLOCK = 256, 1_024, 4_096, 1 / 128, 1 << 17

#: Bits of the filter that keeps texts without a candidate out of the shuffle, and bits of a row of it.
FILTER_BITS, FILTER_ROW = 1 << 25, 1 << 15

#: Shingles hashed at a time, and shingle hashes of a block of the second round.
CHUNK, BLOCK_HASHES = 1 << 16, 1 << 18

#: Columns of a node that travel with its keys: two sketches, the second with the size in its low bits, and
#: a short number that stands for the node.
CARRIED = ("fp", "s1", "s2", "place")


def shingle_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's word shingles in order; fewer words make one shingle, none give none."""
    import xxhash

    found = words(text)
    line, size = b" ".join(found), len(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, size) + 1) - 1
    starts, width = np.concatenate([[0], ends + 1]), min(SHINGLE, size)
    total, hash_of = size - width + 1 if size else 0, xxhash.xxh64_intdigest
    out = np.empty(total, np.uint64)
    for at in range(0, total, CHUNK):
        to = min(at + CHUNK, total)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        out[at:to] = [hash_of(line[a:b], 42) for a, b in spans]
    return out


def _simhash(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the hashes have, as one number; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")


def _minima_bits(own: np.ndarray) -> np.ndarray:
    """One bit of the least value of each of 96 linear hashes over the set, and its size: two numbers."""
    draw = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, (2, MINIMA), np.uint64)
    factor, offset = (draw[0] * np.uint64(2) + np.uint64(1))[:, None], (draw[1] * np.uint64(2))[:, None]
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2_048):
        least = np.minimum(least, (own[None, at : at + 2_048] * factor + offset).min(axis=1))
    bits = np.zeros(128, np.uint8)
    bits[:64], bits[64 + SIZE_BITS :] = np.split(((least >> np.uint64(21)) & np.uint64(1)).astype(np.uint8), [64])
    return np.packbits(bits, bitorder="little").view("<i8") + np.array([0, min(len(own), SIZES)])


def node_column(text: Column) -> Column:
    """Struct (node, fp, s1, s2): hash of the set of shingle hashes, SimHash of the shingles, second sketch with the size."""

    @F.pandas_udf("node long, fp long, s1 long, s2 long")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            out = np.zeros((len(texts), 4), np.int64)
            for row, text in zip(out, texts, strict=True):
                hashes = shingle_hashes(text)
                own = np.unique(hashes)
                row[0] = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64)
                row[1], row[2:] = _simhash(hashes)[0], _minima_bits(own)
            yield pd.DataFrame(out, columns=["node", "fp", "s1", "s2"])

    return mark(F.coalesce(text, F.lit("")))


def hash_set_column(text: Column) -> Column:
    """The distinct shingle hashes of a text."""

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t)).view(np.int64) for t in texts])

    return sets(F.coalesce(text, F.lit("")))


#: Places of a run's columns: number of the run, pair of blocks and side, CARRIED, then in the second round the label.
RUN, PART, FP, S1, S2, PLACE, LABEL = range(7)


def _near(rows: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[np.ndarray]:
    """Places and distances of a few pairs at a time that may be near copies and have different labels; None: of ``left`` alone."""
    marks = [rows[:, c].copy().view(np.uint64) for c in (FP, S1, S2)]
    size = (marks[2] & np.uint64(SIZES)).astype(np.int64)
    marks[2] >>= np.uint64(SIZE_BITS)
    label = rows[:, -1]
    left = left[np.argsort(size[left], kind="stable")]
    others = left if right is None else right[np.argsort(size[right], kind="stable")]
    sizes = size[others]
    for at in range(0, len(left), STRIP):
        a = left[at : at + STRIP]
        # Smaller ones of the same block have met these in an earlier strip.
        low = at if right is None else np.searchsorted(sizes, SIMILAR * size[a[0]] - 1e-6)
        for to in range(low, np.searchsorted(sizes, size[a[-1]] / SIMILAR + 1e-6, side="right"), OTHERS):
            b = others[to : to + OTHERS]
            far = np.bitwise_count(marks[0][a][:, None] ^ marks[0][b][None, :])
            i, j = np.nonzero(far <= RADIUS)
            i, j = a[i], b[j]
            d = np.bitwise_count(marks[1][i] ^ marks[1][j]).astype(np.int64) + np.bitwise_count(marks[2][i] ^ marks[2][j])
            fit = np.minimum(size[i], size[j]) >= SIMILAR * np.maximum(size[i], size[j]) - 1e-9
            fit &= (d <= APART) & (label[i] != label[j])
            if fit.any():
                yield np.stack([i[fit], j[fit], d[fit]])


def _joining(found: np.ndarray, label: np.ndarray, root: dict[int, int], near: Callable[[int, int], bool] | None) -> np.ndarray:
    """Those of ``found`` that, nearest first, ``near`` accepts and that join labels still apart in ``root``."""
    found = found[:, np.argsort(found[2], kind="stable")]
    (i, j), kept = found[:2].tolist(), []

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for k, (a, b) in enumerate(zip(label[i].tolist(), label[j].tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b and (near is None or near(i[k], j[k])):
            root[a] = b
            kept.append(k)
    return found[:, kept]


def _forest(run: np.ndarray, near: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links (u, v) of a run's candidates that join labels still apart: those ``near`` accepts, or else the nearest.

    However many candidates a run has, no more than a few for each of its rows are held.
    """
    second, label, root = run[:, PART] & 1 == 1, run[:, -1], {}
    kept, held = [np.zeros((3, 0), np.int64)], 0
    for found in _near(run, np.flatnonzero(~second), np.flatnonzero(second) if second.any() else None):
        # The nearest forest of all candidates is that of the nearest forests of their parts.
        kept.append(_joining(found, label, root if near else {}, near))
        held += kept[-1].shape[1]
        if not near and held > 4 * len(run):
            kept = [_joining(np.concatenate(kept, axis=1), label, {}, None)]
            held = kept[0].shape[1]
    links = np.concatenate(kept, axis=1)
    if not near and len(kept) > 2:
        links = _joining(links, label, {}, None)
    u, v = run[links[0], PLACE], run[links[1], PLACE]
    return list(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))


def _runs(rows: np.ndarray, ended: bool) -> list[int]:
    """Where runs of sorted rows begin; the last one may go on in the next batch unless they have ended."""
    new = (rows[1:, RUN] != rows[:-1, RUN]) | (rows[1:, PART] >> 1 != rows[:-1, PART] >> 1)
    return [0, *(np.flatnonzero(new) + 1).tolist(), *[len(rows)] * ended]


def _parts(own: Column, blocks: Column) -> Column:
    """The pairs of blocks that a row of block ``own`` is compared in: twice the pair's number, plus its side."""
    return F.transform(
        F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1),
        lambda other: (F.least(own, other) * blocks + F.greatest(own, other)) * 2 + (own > other).cast("long"),
    )


def _reordered(prints: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with bit ``order[k]`` as bit k: distances stay as they are."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view(np.int64).ravel()


def _masks(groups: list[list[int]], thresholds: list[int]) -> list[tuple[int, int, int]]:
    """(base of the run numbers, first bit, bits kept) of each key of a reordered fingerprint."""
    found, start = [], 0
    for group, t in zip(groups, thresholds, strict=True):
        every = (1 << len(group)) - 1
        for gone in combinations(range(len(group)), t) if t >= 0 else ():
            found.append((len(found) << KEY_BITS, start, every & ~sum(1 << b for b in gone)))
        start += len(group)
    return found


def _hot_runs(prints: np.ndarray, n: int, masks: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(run, blocks) of the runs that by a sample's reordered fingerprints have more of ``n`` rows than a block."""
    found, block = [], min(max(BLOCK, int(n * BLOCK_SHARE)), MOST_BLOCK)
    for base, start, keep in masks:
        keys, counts = np.unique((prints.view(np.uint64) >> np.uint64(start)) & np.uint64(keep), return_counts=True)
        blocks = np.ceil(counts * (n / len(prints) / block)).astype(np.int64)
        found += [(base + k, b) for k, b in zip(keys.tolist(), blocks.tolist(), strict=True) if b > 1]
    return found


def _dealt(nodes: DataFrame) -> DataFrame | None:
    """Rows (run, part, *CARRIED), sorted, in which nodes within RADIUS bits share a run; None for fewer than two.

    The sample decides on partitions, thresholds and blocks: cost, not links.  Keys need not be
    counted, so they are shuffled once, and a node has as many of them however many nodes there are.
    The hot runs are at most one for each mask and row of the sample.  Bits of the fingerprints are reordered.
    """
    n = nodes.count()
    if n < 2:
        return None
    sample = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp", "s2").toPandas()
    prints, sizes = sample["fp"].to_numpy(np.int64), np.sort(sample["s2"].to_numpy(np.int64) & SIZES)
    # Only this share of the pairs is of sizes that are compared.
    fit = np.searchsorted(sizes, sizes / SIMILAR + 1e-6, side="right") - np.arange(len(sizes)) - 1
    share = fit.sum() / (len(sizes) * (len(sizes) - 1) / 2)
    groups = group_bits(prints.view(np.uint64), PARTITIONS)
    _, thresholds = allocate(prints.view(np.uint64), groups, RADIUS, max(1.0, n * share), LEAST_BITS)
    order, masks = sum(groups, []), _masks(groups, thresholds)

    @F.pandas_udf("long")
    def reordered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_reordered(batch.to_numpy(np.int64), order))

    each = F.array(*(F.struct(F.lit(b).cast("long").alias("base"), F.lit(s).alias("start"), F.lit(k).cast("long").alias("keep")) for b, s, k in masks))
    key = F.call_function("shiftrightunsigned", F.col("fp"), F.col("m.start")).bitwiseAND(F.col("m.keep"))
    moved = nodes.withColumn("fp", reordered("fp")).select(*CARRIED)
    keyed = moved.select(*CARRIED, F.explode(each).alias("m")).select((F.col("m.base") + key).alias("run"), *CARRIED)
    hot = _hot_runs(_reordered(prints, order), n, masks)
    if hot:
        table = nodes.sparkSession.createDataFrame(pd.DataFrame(hot, columns=["run", "blocks"]), "run long, blocks long")
        keyed = keyed.join(F.broadcast(table), "run", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        own = F.pmod(F.xxhash64("place"), F.col("blocks"))
        keyed = keyed.select("run", F.explode(_parts(own, F.col("blocks"))).alias("part"), *CARRIED)
    else:
        keyed = keyed.select("run", F.lit(0).cast("long").alias("part"), *CARRIED)
    return keyed.repartition(F.col("run"), F.shiftright("part", 1)).sortWithinPartitions("run", "part")


def _candidates(nodes: DataFrame) -> DataFrame | None:
    """Distinct pairs (u, v) of nodes within both sketches' bounds: a forest for each key that nodes share."""
    tasks = _dealt(nodes)
    if tasks is None:
        return None
    names = ("run", "part", *CARRIED)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.zeros((0, len(names)), np.int64)
        for batch in _ended(batches):
            if batch is not None:
                rest = np.concatenate([rest, np.column_stack([batch[c].to_numpy(np.int64) for c in names])])
            ends = _runs(rest, batch is None)
            links = {p for a, b in pairwise(ends) if b - a > 1 for p in _forest(rest[a:b])}
            if links:
                yield pd.DataFrame(list(links), columns=["u", "v"], dtype="int64")
            rest = rest[ends[-1] :]

    return tasks.mapInPandas(link, "u long, v long").distinct()


def _ended(batches: Iterator) -> Iterator:
    """The batches, then None."""
    yield from batches
    yield None


def _named(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose place is in ``ends`` and a few others: a bounded filter, so that others need no shuffle."""
    bit = F.pmod(F.xxhash64("place"), F.lit(FILTER_BITS))
    rows = ends.groupBy(F.floor(bit / FILTER_ROW).alias("__at")).agg(F.expr(f"bitmap_construct_agg(pmod(xxhash64(place), {FILTER_ROW}))").alias("__set"))
    tried = texts.withColumn("__bit", bit).withColumn("__at", F.floor(F.col("__bit") / FILTER_ROW)).join(F.broadcast(rows), "__at")
    byte = F.conv(F.hex(F.expr(f"substring(__set, cast((__bit % {FILTER_ROW}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (F.col("__bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return tried.where(held).select(texts.columns)


def _hash_sets(links: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (place, own): the sets of shingle hashes of the nodes that ``links`` name, written."""
    ends = links.select(F.explode(F.array("u", "v")).alias("place")).distinct()
    held = _named(texts, ends).join(ends.hint("shuffle_hash"), "place")
    return saved(held.select("place", hash_set_column(F.col("text")).alias("own")))


def _verified(links: DataFrame, held: DataFrame) -> DataFrame:
    """Links whose sets of shingle hashes have a Jaccard similarity of ``SIMILAR`` or more."""
    both = links.join(held.select(F.col("place").alias("u"), F.col("own").alias("first")), "u")
    both = both.join(held.select(F.col("place").alias("v"), F.col("own").alias("second")), "v")
    shared, sizes = F.size(F.array_intersect("first", "second")), F.size("first") + F.size("second")
    return both.where(shared >= SIMILAR * (sizes - shared) - 1e-9).select("u", "v")


def _settled(left: DataFrame, held: DataFrame) -> DataFrame:
    """Links (u, v) of near copies that join all labels of ``left`` that can be joined within a value of ``wide``."""
    size = F.col("s2").bitwiseAND(F.lit(SIZES))
    blocks = left.groupBy("wide").agg(F.ceil(F.sum(size) / BLOCK_HASHES).alias("blocks"))
    dealt = split_join(left, blocks.withColumn("blocks", F.greatest("blocks", F.lit(1).cast("long"))), "wide")
    parts = _parts(F.pmod(F.xxhash64("place"), F.col("blocks")), F.col("blocks"))
    dealt = dealt.join(held, "place").select("wide", F.explode(parts).alias("part"), "own", *CARRIED, "label")
    names = ("wide", "part", *CARRIED, "label")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by wide and part; one run of a pair of blocks is held at a time."""
        rows, sets = np.zeros((0, len(names)), np.int64), []

        def near(first: int) -> Callable[[int, int], bool]:
            def check(i: int, j: int) -> bool:
                a, b = sets[first + i], sets[first + j]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                return shared >= SIMILAR * (len(a) + len(b) - shared) - 1e-9

            return check

        for batch in _ended(batches):
            if batch is not None:
                rows = np.concatenate([rows, np.column_stack([batch[c].to_numpy(np.int64) for c in names])])
                sets += list(batch["own"])
            ends = _runs(rows, batch is None)
            links = [p for a, b in pairwise(ends) if b - a > 1 for p in _forest(rows[a:b], near(a))]
            yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")
            rows, sets = rows[ends[-1] :], sets[ends[-1] :]

    tasks = dealt.repartition(F.col("wide"), F.shiftright("part", 1)).sortWithinPartitions("wide", "part")
    return tasks.mapInPandas(settle, "u long, v long").distinct()


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the least place that ``links`` reach as ``label``."""
    found = components(links).select(F.col("node").alias("place"), F.col("component").alias("label"))
    return nodes.join(found, "place", "left").withColumn("label", F.coalesce("label", "place"))


def near_copy_groups(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (place, label) for distinct ``nodes`` (fp, s1, s2, place): near copies share a label.

    ``texts`` (place, text) has a text for the place of each node.  All texts without words are one
    node; a text of fewer words than a shingle is like another only with the same words.  No nodes
    give no rows.  Copies are missed only if they differ in more bits of a sketch than allowed.
    """
    tried = _candidates(nodes)
    if tried is None:
        return nodes.select("place", F.col("place").alias("label"))
    tried = saved(tried)
    held = _hash_sets(tried, texts)
    true = saved(_verified(tried, held))
    grouped = saved(_labelled(nodes, true))
    # Only groups that a refused candidate touches can still be joined; each of their nodes has a
    # candidate and so its set at hand.
    wide = saved(_labelled(nodes, tried)).select("place", F.col("label").alias("wide"))
    both = grouped.join(wide, "place")
    open_ = both.groupBy("wide").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    left = saved(both.join(open_.select("wide"), "wide", "left_semi"))
    return _labelled(nodes, true.unionByName(_settled(left, held))).select("place", "label")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the least id.

    Of rows with the same id the one with the least hash over all columns stays, so the choice does
    not hang on how rows are dealt; rows that are equal in all columns are one.  Rows with a null id
    stay only where their group has no id.  Null and texts without words are one group.  An empty
    table gives no rows; columns keep their names, whatever they are.
    """
    # The rows are written once with a number of their own, so that rows sharing an id stay apart.
    every = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(
        F.struct(*every).alias("row"), F.xxhash64(*every).alias("mix"), F.monotonically_increasing_id().alias("place"),
        node_column(F.col(text_col)).alias("mark"),
    )
    numbered = saved(own.select("row", "mix", "place", "mark.*"))
    key_id = F.col("row")[id_col]
    key = F.struct(key_id.isNull().alias("none"), key_id.alias("id"), "mix", "place")
    marks = [F.min(m).alias(m) for m in ("fp", "s1", "s2")]
    nodes = saved(numbered.groupBy("node").agg(*marks, F.min(key).alias("least")).withColumn("place", F.col("least.place")))
    groups = near_copy_groups(nodes.select(*CARRIED), numbered.select("place", F.col("row")[text_col].alias("text")))
    first = nodes.join(groups, "place").groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.place").alias("place"))
    return numbered.join(first.hint("shuffle_hash"), "place", "left_semi").select("row.*")
