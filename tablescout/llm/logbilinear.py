"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Word counts of all training texts are one Spark table, as large as the corpus makes it.  The most
frequent words are classes of their own; every other word belongs to a class by its highest
character, in which it has its share of the class's counts.  The neural model predicts the next
class from the classes before it: a linear map per context place, a dot product with the class's
vector, and a bias.  It is trained in numpy against noise classes, on every place of every
training text: documents are dealt to rounds by a hash of their id, each task of a round starts
from the same parameters and goes over its own texts, and the next round starts from the tasks'
parameters, averaged in Spark with each task weighing as many places as it saw.  The driver holds
parameters only.  Scoring normalises over all classes by batched matrix products, so probabilities
sum to one over all words, unseen ones included.

Counts of at most ``KNOWN`` frequent words travel with the scoring tasks; occurrences of all other
words, none of which is frequent, are joined to the table by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import saved, small_batches, words

#: Word classes, classes of other words, context places, dimensions.
TOP, OTHERS, CONTEXT, DIMS = 255, 8, 3, 24

#: Words whose counts are sent to all tasks, at most; a word's bytes beyond WIDE keep it out of them.
KNOWN, WIDE = 1 << 17, 64

#: Noise classes of a place, places that share them, places of a batch.
NOISE, SHARED, BATCH = 24, 512, 2_048

#: Rounds that share out the documents, first step size.
ROUNDS, STEP = 3, 0.02

#: Places that a task shuffles together.  One with little text goes over it again until it has made
#: LEAST_STEPS steps, at most MOST_PASSES times; that changes how fast small parts learn, not what is learnt from.
BUFFER, LEAST_STEPS, MOST_PASSES = 1 << 18, 600, 12

#: Parameters in a row of the table that averages them.
WIDTH = 32

#: The token at the end of each text; no word is empty.
END = b""

#: Distinct words after which a counting task passes on what it has.
FLUSH = 300_000


def other_class(word: bytes) -> int:
    """A class of words by their highest character; ASCII words have class 0."""
    if word.isascii():
        return 0
    return 1 + ord(max(word.decode("utf-8", "surrogatepass"))) % (OTHERS - 1)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word binary, kind, c) for all words of the texts; the empty word counts ends of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words(text))
                seen[END] += 1
            if len(seen) > FLUSH:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    partial = texts.mapInPandas(count, "word binary, kind int, n long")
    return partial.groupBy("word").agg(F.any_value("kind").alias("kind"), F.sum("n").alias("c"))


def _counted(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(seen), "kind": list(map(other_class, seen)), "n": list(seen.values())})


@dataclass
class LanguageModel:
    known: dict[bytes, int]  # frequent word -> rank; the first TOP are classes
    counts: np.ndarray  # by rank
    class_of: np.ndarray  # by rank
    tokens: int
    types: int
    masses: np.ndarray  # of the classes of other words: sum of c + 1/2, unseen words included
    context: np.ndarray  # (places, classes + start, dims): vectors already mapped by place
    vectors: np.ndarray  # (classes, dims)
    bias: np.ndarray
    places: int  # that the neural part has learnt from

    @property
    def classes(self) -> int:
        return len(self.bias)

    @property
    def top(self) -> int:
        return self.classes - OTHERS

    def log_norms(self, before: np.ndarray) -> np.ndarray:
        """ln of the normaliser after each row of context classes."""
        out = np.empty(len(before), np.float32)
        for at in range(0, len(before), 8192):
            rows = before[at : at + 8192]
            logits = self.predicted(rows) @ self.vectors.T
            logits += self.bias
            most = logits.max(axis=1, keepdims=True)
            logits -= most
            out[at : at + 8192] = np.log(np.exp(logits, out=logits).sum(axis=1)) + most[:, 0]
        return out

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.context[k][before[:, k]] for k in range(CONTEXT))


def _contexts(classes: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT classes before each place, nearest first."""
    padded = np.concatenate([np.full(CONTEXT, start, np.int64), classes])
    return np.column_stack([padded[CONTEXT - 1 - k : len(padded) - 1 - k] for k in range(CONTEXT)])


def _class_ids(found: list[bytes], known: dict[bytes, int], class_of: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each word (-1: not sent along) and its class."""
    ranks = np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))
    classes = class_of[ranks] if len(class_of) else np.zeros(len(found), np.int64)
    rare = np.flatnonzero(ranks < 0)
    classes[rare] = top  # the class of ASCII words
    words_of = [found[i] for i in rare.tolist()]
    if not b"".join(words_of).isascii():
        classes[rare] += np.fromiter(map(other_class, words_of), np.int64, len(rare))
    return ranks, classes


def first_guess(shares: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before any place was seen: the classes' shares as biases, small random vectors."""
    rng, n = np.random.default_rng(seed), len(shares)
    return {
        "words": rng.normal(0, 0.1, (n + 1, DIMS)), "maps": np.stack([np.eye(DIMS)] * CONTEXT) / CONTEXT,
        "vectors": rng.normal(0, 0.1, (n, DIMS)), "bias": np.log(shares),
    }


def _sum_by(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with equal keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[ordered[starts]] = np.add.reduceat(np.take(rows, order, axis=0), starts, axis=0)
    return out


class NceLearner:
    """Noise-contrastive estimation of the log-bilinear model over the places one task sees.

    Each place is told from NOISE classes drawn by ``shares``, the same for SHARED places: the score less the log of a class's
    expected number of noise draws is the log-odds that it is data.  Adam steps on mini-batches.
    """

    def __init__(self, start: dict[str, np.ndarray], shares: np.ndarray, rate: float, seed: int):
        self.p = {k: v.astype(np.float32) for k, v in start.items()}
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.rng, self.rate, self.steps, self.seen = np.random.default_rng(seed), rate, 0, 0
        self.expected = np.log(NOISE * shares).astype(np.float32)
        self.bounds = np.cumsum(shares)[:-1]
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, classes: np.ndarray) -> None:
        """One text's places: its classes behind the classes before them."""
        rows = np.column_stack([_contexts(classes, len(self.expected)), classes]).astype(np.int16)
        for at in range(0, len(rows), BUFFER):
            self.waiting.append(rows[at : at + BUFFER])
            self.held += len(self.waiting[-1])
            if self.held >= BUFFER:
                self._learn(1)

    def finish(self) -> np.ndarray:
        """All parameters in one row, after the places that still wait."""
        if self.held:
            missing = max(LEAST_STEPS - self.steps, 0)
            self._learn(min(max(-(-missing * BATCH // self.held), 1), MOST_PASSES))
        return np.concatenate([v.ravel() for v in self.p.values()])

    def _learn(self, passes: int) -> None:
        rows = np.concatenate(self.waiting)
        for _ in range(passes):
            order = self.rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                batch = np.take(rows, order[at : at + BATCH], axis=0)
                self._step(batch[:, :CONTEXT], batch[:, CONTEXT])
        self.seen += len(rows)
        self.waiting, self.held = [], 0

    def _step(self, before: np.ndarray, target: np.ndarray) -> None:
        p, m, n = self.p, len(target), len(self.expected)
        hat = sum(np.take(p["words"] @ p["maps"][k], before[:, k], axis=0) for k in range(CONTEXT))
        own, odds = np.take(p["vectors"], target, axis=0), p["bias"] - self.expected
        data = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", hat, own) + odds[target], -30, 30)))
        # Ascent directions: data towards 1, noise towards 0.
        g_hat = data[:, None] * own
        g_vectors, g_bias = _sum_by(target, data[:, None] * hat, n), np.bincount(target, data, n)
        for at in range(0, m, SHARED):
            noise = np.searchsorted(self.bounds, self.rng.random(NOISE), side="right")
            drawn, some = p["vectors"][noise], hat[at : at + SHARED]
            false = 1 / (1 + np.exp(-np.clip(some @ drawn.T + odds[noise], -30, 30)))
            g_hat[at : at + SHARED] -= false @ drawn
            np.subtract.at(g_vectors, noise, false.T @ some)
            np.subtract.at(g_bias, noise, false.sum(axis=0))
        sums = [_sum_by(before[:, k], g_hat, n + 1) for k in range(CONTEXT)]
        slopes = {
            "words": sum(sums[k] @ p["maps"][k].T for k in range(CONTEXT)),
            "maps": np.stack([p["words"].T @ sums[k] for k in range(CONTEXT)]),
            "vectors": g_vectors, "bias": g_bias.astype(np.float32),
        }
        self.steps += 1
        for k, slope in slopes.items():
            slope = slope / m - 1e-5 * p[k] * (k != "bias")
            self.first[k] = 0.9 * self.first[k] + 0.1 * slope
            self.second[k] = 0.999 * self.second[k] + 0.001 * slope**2
            up = self.first[k] / (1 - 0.9**self.steps) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
            p[k] = (p[k] + self.rate * up).astype(np.float32)


def learn_round(
    texts: DataFrame, start: dict[str, np.ndarray], shares: np.ndarray, known: dict[bytes, int], class_of: np.ndarray, rate: float
) -> tuple[dict[str, np.ndarray], int]:
    """Parameters after the tasks have gone over their ``texts`` (one column) from ``start``, averaged, and the places seen.

    A task hands on as many rows as the parameters take, however much text it has; they are added up
    by Spark, so the driver gets one average.  No texts leave ``start`` as it is.
    """
    top, columns = len(shares) - OTHERS, [f"v{i}" for i in range(WIDTH)]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        learner = NceLearner(start, shares, rate, context.partitionId() if context else 0)
        for batch in batches:
            for text in batch["text"]:
                learner.add(_class_ids([*words(text), END], known, class_of, top)[1])
        flat = learner.finish().astype(np.float64)
        if learner.seen:
            rows = np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH) * learner.seen
            out = pd.DataFrame(rows, columns=columns)
            out.insert(0, "seen", learner.seen)
            out.insert(0, "at", np.arange(len(rows), dtype=np.int32))
            yield out

    parts = texts.mapInPandas(learn, "at int, seen long, " + ", ".join(f"{c} double" for c in columns))
    whole = parts.groupBy("at").agg(F.sum("seen").alias("seen"), *[F.sum(c).alias(c) for c in columns]).toPandas()
    if whole.empty:
        return start, 0
    whole = whole.sort_values("at")
    seen = int(whole["seen"].iloc[0])
    flat, at, out = (whole[columns].to_numpy() / seen).ravel(), 0, {}
    for k, v in start.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out, seen


def _known_words(counts: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The most frequent words, their counts and kinds; at most KNOWN: all from a count that the counts' spread gives."""
    level = F.floor(F.log2("c") * 64).cast("int").alias("level")
    short = counts.where(F.octet_length("word") <= WIDE)
    spread = short.groupBy(level).agg(F.count("*").alias("n")).collect()  # a few thousand levels at most
    total, least = 0, np.inf
    for row in sorted(spread, key=lambda r: -r["level"]):
        total += row["n"]
        if total > KNOWN:
            break
        least = row["level"]
    rows = short.where(F.floor(F.log2("c") * 64) >= (least if np.isfinite(least) else 1 << 30)).select("word", "c", "kind").toArrow()
    found, c, kind = rows["word"].to_pylist(), rows["c"].to_numpy(), rows["kind"].to_numpy()
    order = sorted(range(len(found)), key=lambda i: (-c[i], found[i]))
    return [found[i] for i in order], c[order].astype(float), kind[order].astype(int)


def learn_language(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """The model of training texts ``docs`` whose ``count_words`` are ``counts``; empty tables give a flat one."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known, frequent, kinds = _known_words(counts)
    ranks = {w: i for i, w in enumerate(known)}
    top = min(TOP, len(known))
    masses = np.full(OTHERS, 0.5)
    for row in counts.groupBy("kind").agg(F.sum(F.col("c") + 0.5).alias("mass")).collect():
        masses[row["kind"]] += row["mass"]
    np.subtract.at(masses, kinds[:top], frequent[:top] + 0.5)
    masses = np.maximum(masses, 0.5)
    shares = np.concatenate([frequent[:top] + 0.5, masses])
    shares /= shares.sum()
    class_of = np.concatenate([np.arange(top), top + kinds[top:]]).astype(np.int64)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(ROUNDS)).alias("turn"))
    learnt, places = first_guess(shares), 0
    for turn in range(ROUNDS):
        own = texts.where(F.col("turn") == turn).select("text")
        learnt, seen = learn_round(own, learnt, shares, ranks, class_of, STEP / (turn + 1))
        places += seen
    context = np.stack([learnt["words"] @ learnt["maps"][k] for k in range(CONTEXT)]).astype(np.float32)
    vectors, bias = learnt["vectors"].astype(np.float32), learnt["bias"].astype(np.float32)
    return LanguageModel(ranks, frequent, class_of, int(totals[0]), int(totals[1]), masses, context, vectors, bias, places)


PARTS = "n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>"


def _part_column(text: Column, model: LanguageModel) -> Column:
    """What a text's score has without the counts of words that are not sent along, and those words."""

    @F.pandas_udf(PARTS)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, size = model, model.classes + 1
        norms = np.zeros(size**CONTEXT, np.float32)  # of contexts met so far; 0: not yet made
        weights = size ** np.arange(CONTEXT)
        whole = np.log10(m.tokens + 0.5 * (m.types + 1))
        base_of = np.append(np.log10(m.counts + 0.5), 0.0) - whole  # by rank; the last one is for words not sent along
        inside = np.append(np.log10(m.counts + 0.5), 0.0)
        inside[: m.top] = 0.0
        mass_of = np.concatenate([np.zeros(m.top), np.log10(m.masses)])
        for texts in batches:
            out = []
            for text in texts:
                found = [*words(text), END]
                ranks, classes = _class_ids(found, m.known, m.class_of, m.top)
                before = _contexts(classes, m.classes)
                codes = before @ weights
                new = np.unique(codes[norms[codes] == 0])
                if len(new):
                    norms[new] = m.log_norms(new[:, None] // weights % size)
                logit = np.einsum("ij,ij->i", m.predicted(before), m.vectors[classes]) + m.bias[classes]
                ln = (logit - norms[codes]).sum(dtype=np.float64)
                rare = Counter([found[i] for i in np.flatnonzero(ranks < 0).tolist()])
                out.append(
                    (
                        len(found), len(found) - sum(rare.values()), base_of[ranks].sum(),
                        ln / np.log(10) + inside[ranks].sum() - mass_of[classes].sum(),
                        list(rare), list(rare.values()),
                    )
                )
            yield pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "score", "rare", "times"])

    return score(F.coalesce(text, F.lit("")))


def language_scores(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    Rows for which ``training`` holds are learnt from.  Tokens are the words and one end per text;
    n_known counts those seen in training.  ``base_score`` is the sum of log10 of smoothed relative
    frequencies (c + 1/2) / (N + (V + 1) / 2); ``score`` is the model's log10 probability of the
    text.  Null texts count as empty; null ids and repeated rows are kept.
    """
    small_batches(docs.sparkSession)
    learnt = docs.where(training)
    counts = saved(count_words(learnt, id_col, text_col))
    model = learn_language(learnt, counts, id_col, text_col)
    parts = saved(
        docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _part_column(F.col(text_col), model).alias("p"))
        .select("id", "row", "p.*")
    )
    pairs = F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("n"))
    rare = parts.select("row", F.explode(pairs).alias("r")).select("row", "r.word", "r.n")
    met = rare.join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("met")
    )
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("met", F.lit(0))
    return parts.drop("rare", "times").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + more).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
