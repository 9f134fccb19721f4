"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors have cosine c exactly where their distance is sqrt(2 - 2 c).  Vectors are sorted by
label and by grid cells of that width on their leading principal dimensions, and cut into blocks
with bounding boxes.  Pairs of blocks whose boxes are farther apart than the distance are provably
without links and never meet.  A pair that meets is split recursively into sequence intervals,
dropping distant ones, down to small intervals that one matrix product compares.  Pairs of blocks
yield counts per vector and a spanning forest of their links, not the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import saved
from tablescout.llm.components import components, split_join

#: Vectors that the principal dimensions are fitted on: those with the least hash.  They affect cost only.
SAMPLE = 5_000

#: Principal dimensions of the grid order and of the bounding boxes, rows of a block, rows of an interval.
GRID_DIMS, BOX_DIMS, BLOCK, INTERVAL = 4, 16, 512, 128

BLOCKS = "block long, label long, low array<double>, high array<double>, reps array<binary>, copies array<long>, data binary"


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: list) -> np.ndarray:
    rows = np.array(vectors, np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal(sample: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading orthonormal directions (as columns) of unit vectors."""
    mean = sample.mean(axis=0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    return mean, axes[:dims].T


def box_distance(low_a, high_a, low_b, high_b) -> float:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(np.sqrt((gap * gap).sum()))


class PairJoin:
    """Counts and forest of one pair of blocks (or of a block with itself)."""

    def __init__(self, least: float, axes: np.ndarray, mean: np.ndarray):
        self.least, self.axes, self.mean = least, axes, mean
        self.reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9

    def __call__(self, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Boolean hits are never kept whole: ``take`` sees them interval by interval."""
        self.left, self.right, self.same = left, right, same
        self.left_at, self.right_at = ((x - self.mean) @ self.axes for x in (left, right))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self._join(0, len(left), 0, len(right))
        return self.found

    def _join(self, a: int, b: int, c: int, d: int) -> None:
        if self.same and d <= a:
            return  # the mirror image is visited
        p, q = self.left_at[a:b], self.right_at[c:d]
        if box_distance(p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0)) > self.reach:
            return
        if b - a <= INTERVAL and d - c <= INTERVAL:
            cosine = self.left[a:b] @ self.right[c:d].T
            hit = cosine >= self.least
            for i, j in zip(*np.nonzero(np.abs(cosine - self.least) < 1e-12), strict=True):
                hit[i, j] = _cosine(self.left[a + i], self.right[c + j]) >= self.least
            rows, columns = np.nonzero(hit)
            rows, columns = rows + a, columns + c
            if self.same:
                rows, columns = rows[rows < columns], columns[rows < columns]
            if len(rows):
                self.found.append((rows, columns))
            return
        if b - a >= d - c:
            middle = (a + b) // 2
            self._join(a, middle, c, d)
            self._join(middle, b, c, d)
        else:
            middle = (c + d) // 2
            self._join(a, b, c, middle)
            self._join(a, b, middle, d)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine by correctly rounded sums, for the few pairs at the very threshold."""
    from math import fsum, sqrt

    return fsum(a * b) / sqrt(fsum(a * a) * fsum(b * b))


def _forest(rows: np.ndarray, columns: np.ndarray, size: int) -> list[int]:
    """Which links of a list join what the ones before left apart."""
    root, kept = list(range(size)), []
    for k, (x, y) in enumerate(zip(rows.tolist(), columns.tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def _cut_blocks(mean: np.ndarray, axes: np.ndarray, reach: float):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows (part, label, ..., rep, copies, vector) in blocks of one label."""
        rest, made, part = None, 0, 0
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            part = int(rows["part"].iloc[0]) if len(rows) else part
            full, rest = _whole_blocks(rows, final=False)
            for own in full:
                yield _block(own, (part << 32) + made, mean, axes, reach)
                made += 1
        for own in _whole_blocks(rest, final=True)[0] if rest is not None else ():
            yield _block(own, (part << 32) + made, mean, axes, reach)
            made += 1

    return cut


def _whole_blocks(rows: pd.DataFrame, final: bool) -> tuple[list[pd.DataFrame], pd.DataFrame]:
    full, at = [], 0
    labels = rows["label"].to_numpy()
    while at < len(rows):
        other = np.flatnonzero(labels[at : at + BLOCK] != labels[at])
        to = at + (int(other[0]) if len(other) else BLOCK)
        if to > len(rows) or (to == len(rows) and not len(other) and len(rows) - at < BLOCK):
            if not final:
                break
            to = len(rows)
        full.append(rows.iloc[at:to])
        at = to
    return full, rows.iloc[at:]


def _block(rows: pd.DataFrame, number: int, mean: np.ndarray, axes: np.ndarray, reach: float) -> pd.DataFrame:
    units = _unit(rows["vector"].tolist())
    at = (units - mean) @ axes
    return pd.DataFrame(
        {
            "block": [number], "label": [int(rows["label"].iloc[0])],
            "low": [at.min(axis=0).tolist()], "high": [at.max(axis=0).tolist()],
            "reps": [rows["rep"].tolist()], "copies": [rows["copies"].tolist()], "data": [units.tobytes()],
        }
    )


def near_vectors(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other rows linked directly), component_id, kept.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``least``.  Vectors that are null, all zero, or hold a null, NaN or
    infinite component link with nothing, nor do vectors of different lengths.  ``component_id``
    is the least id reachable, the row's own included; ``kept`` tells whether it is the row's own.
    Rows with a null id count as linked rows but lend no id; repeated rows count each.
    """
    sound = F.col(label_col).isNotNull() & usable(F.col(vector_col))
    text = F.concat_ws(",", F.transform(F.col(vector_col), lambda x: (x.cast("double") + 0.0).cast("string")))
    rows = saved(
        vectors.select(
            F.col(id_col).alias("id"), F.xxhash64(label_col).alias("label"),
            F.col(vector_col).cast("array<double>").alias("vector"),
            F.when(sound, F.unhex(F.sha2(F.concat_ws("|", F.col(label_col).cast("string"), text), 256))).alias("rep"),
        )
    )
    # Exact copies meet first: one row per distinct vector and label goes on.
    distinct = saved(
        rows.where("rep IS NOT NULL").groupBy("rep").agg(
            F.any_value("label").alias("label"), F.any_value("vector").alias("vector"),
            F.count("*").alias("copies"), F.min("id").alias("least"),
        )
    )
    counts, links = _linked(distinct, least)
    grouped = distinct.select("rep", "copies", "least").join(components(links), F.col("rep") == F.col("node"), "left")
    grouped = grouped.join(counts, "rep", "left").select(
        "rep", "least", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_rep = split_join(grouped, named, "component").select("rep", "n_links", "component_id")
    return rows.select("id", "rep").join(of_rep, "rep", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _linked(distinct: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(rep, linked: rows of other distinct vectors linked) and links (u, v) of a spanning forest."""
    sizes = [r[0] for r in distinct.select(F.size("vector")).distinct().collect()]
    counts, links = [], []
    for size in sizes:
        own = distinct.where(F.size("vector") == size)
        pairs = _block_pairs(own, least)
        counts.append(pairs.where("other IS NULL").groupBy("rep").agg(F.sum("n").alias("linked")))
        links.append(pairs.where("other IS NOT NULL").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    if not sizes:
        none = distinct.select("rep", F.col("copies").alias("linked")).where("false")
        return none, none.select(F.col("rep").alias("u"), F.col("rep").alias("v"))
    for more, link in zip(counts[1:], links[1:], strict=True):
        counts[0], links[0] = counts[0].unionByName(more), links[0].unionByName(link)
    return counts[0], links[0]


def _block_pairs(distinct: DataFrame, least: float) -> DataFrame:
    """Rows (rep, n, other): counts where other is null, links of the forest where it isn't."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas()["vector"].tolist()
    units = _unit(sample)
    mean, axes = principal(units, min(BOX_DIMS, units.shape[1]))
    dims = min(GRID_DIMS, axes.shape[1])

    @F.pandas_udf("array<int>")
    def cells(batch: pd.Series) -> pd.Series:
        at = (_unit(batch.tolist()) - mean) @ axes[:, :dims]
        return pd.Series(np.floor(at / reach).astype(np.int32).tolist())

    # A label of a third of all vectors is spread over many tasks: cells and digests are part of the order.
    order = ["label", "cells", "rep"]
    sorted_rows = (
        distinct.withColumn("cells", cells("vector")).repartitionByRange(*order).sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "label", "rep", "copies", "vector")
    )
    blocks = saved(sorted_rows.mapInPandas(_cut_blocks(mean, axes, reach), BLOCKS))
    # Slabs of twice the reach on the first dimension: blocks within reach share or neighbour one.
    slab = lambda x: F.floor(x / (2 * reach)).cast("int")
    boxes = blocks.select("block", "label", "low", "high").withColumn(
        "slabs", F.sequence(slab(F.col("low")[0] - reach / 2), slab(F.col("high")[0] + reach / 2))
    )
    a = boxes.select("label", "block", "low", "high", F.explode("slabs").alias("slab"))
    b = a.select("label", "slab", *(F.col(c).alias(f"{c}_b") for c in ("block", "low", "high")))
    gaps = F.zip_with(
        F.zip_with("low", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)
    near = a.join(b, ["label", "slab"]).where((F.col("block") <= F.col("block_b")) & (apart <= reach * reach))
    pairs = near.select("block", "block_b").distinct()
    left = blocks.select("block", F.struct("block", "reps", "copies", "data").alias("x"))
    right = blocks.select(F.col("block").alias("block_b"), F.struct("block", "reps", "copies", "data").alias("y"))
    met = pairs.join(left, "block").join(right, "block_b").select("x", "y")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compare = PairJoin(least, axes, mean)
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"], strict=True):
                yield _pair_rows(compare, x, y)

    # A row holds two blocks, so few rows make a batch; the session's own setting comes back after.
    spark, key = distinct.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "32")
    try:
        return saved(met.mapInPandas(join, "rep binary, n long, other binary"))
    finally:
        spark.conf.set(key, before)


def _pair_rows(compare: PairJoin, x: dict, y: dict) -> pd.DataFrame:
    same = x["block"] == y["block"]
    left = np.frombuffer(x["data"]).reshape(len(x["reps"]), -1)
    right = left if same else np.frombuffer(y["data"]).reshape(len(y["reps"]), -1)
    found = compare(left, right, same)
    if not found:
        return pd.DataFrame({"rep": [], "n": [], "other": []})
    rows, columns = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    of_left = np.bincount(rows, np.asarray(y["copies"])[columns], len(left)).astype(np.int64)
    of_right = np.bincount(columns, np.asarray(x["copies"])[rows], len(right)).astype(np.int64)
    shift = 0 if same else len(left)
    kept = _forest(rows, columns + shift, shift + len(right))
    out = [(x["reps"][i], int(of_left[i]), None) for i in np.flatnonzero(of_left)]
    out += [(y["reps"][j], int(of_right[j]), None) for j in np.flatnonzero(of_right)]
    out += [(x["reps"][rows[k]], None, y["reps"][columns[k]]) for k in kept]
    return pd.DataFrame(out, columns=["rep", "n", "other"]).astype({"n": "Int64"})
