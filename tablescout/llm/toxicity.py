"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens fall into a fixed number of hash buckets.  Each bucket's score is the log-odds of toxic
against clean documents under a Dirichlet prior that equals the classes' shares, less a cost per
token, so that clean text drifts down.  A linear scan finds all maximal segments of a text.  A
segment of score S in a text of n tokens counts by ``lambda S - ln(K n)``, the negative log of the
number of such segments that clean text of that length has by chance.  What exceeds a significance
level adds up, and a logistic curve turns the sum into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import saved, small_batches

TOKEN = re.compile(rb"[a-z0-9'\x80-\xff]+")

#: Buckets of tokens; the model is as large at any scale.
BUCKETS = 1 << 18

#: At most so many labelled documents of each class are learnt from: those with the least hash of their id.
SAMPLE = {1: 10_000, 0: 20_000}

#: What the training folds choose from: a bucket's prior strength in tokens, the cost of a token, and the
#: evidence from which a segment is significant.
PRIORS, COSTS, LEVELS = (0.3, 1.0, 3.0, 10.0, 30.0), (1.0, 1.5, 2.0, 3.0), (0.0, 1.5, 3.0)

#: Cost under which the prior is chosen.
FIRST_COST = 1.5

#: Parts of the sample; each is weighed with scores learnt from the other parts.
FOLDS = 5

#: Distinct tokens that a worker remembers the bucket of; memory only.
REMEMBERED = 300_000

PASSAGES = "score double, passages array<struct<first:int,last:int,evidence:double>>"


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters, digits, apostrophes and all non-ASCII bytes, A-Z lower-cased."""
    return TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Buckets(dict):
    """Token -> bucket, filled as tokens come."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        spot = self[token] = zlib.crc32(token) % BUCKETS
        return spot

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.int32, count=len(found))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score), positions included, in linear time.

    Segments are disjoint, none can grow to a higher score, and each starts and ends at a positive
    score.  Negative stretches between positive scores enter as cumulative sums only.
    """
    above = np.flatnonzero(scores > 0)
    if not len(above):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, spot of the nearest lower
    for i, before, after in zip(above.tolist(), sums[above].tolist(), sums[above + 1].tolist(), strict=True):
        first = last = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((first, last, before, after, j))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last, after - before) for first, last, before, after, _ in stack]


@dataclass
class ToxicityModel:
    scores: np.ndarray  # by bucket
    rate: float  # lambda: scores times this are in nats
    log_k: float  # ln K of the extreme-value law
    level: float  # evidence from which a segment is significant
    offset: float
    slope: float

    def rated(self, found: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal segments with their evidence."""
        if not len(found):
            return []
        least = self.log_k + np.log(len(found))
        return [(a, b, self.rate * s - least) for a, b, s in maximal_segments(self.scores[found])]

    def evidence(self, found: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """The sum of the significant segments' evidence (else that of the best one), and those segments."""
        rated = self.rated(found)
        return total_evidence(rated, self.level), [x for x in rated if x[2] >= self.level]

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.offset + self.slope * np.arcsinh(evidence)))))


def total_evidence(rated: list[tuple[int, int, float]], level: float) -> float:
    """Evidence of all segments from ``level``; where there are none, of the best one, 0 at least."""
    strong = [x[2] for x in rated if x[2] >= level]
    return sum(strong) if strong else max([0.0, *(x[2] for x in rated)])


def _class_counts(rows: DataFrame) -> np.ndarray:
    """Token counts by fold, class (clean, toxic) and bucket of rows (text, toxic, fold)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, total = Buckets(), np.zeros((FOLDS * 2, BUCKETS), np.int64)
        for batch in batches:
            for text, part in zip(batch["text"], batch["fold"] * 2 + batch["toxic"], strict=True):
                total[part] += np.bincount(buckets.of(tokens(text)), minlength=BUCKETS)
        for part in range(FOLDS * 2):
            spots = np.flatnonzero(total[part])
            yield pd.DataFrame({"part": part, "bucket": spots, "n": total[part][spots]})

    found = rows.mapInPandas(count, "part int, bucket long, n long").groupBy("part", "bucket").agg(F.sum("n").alias("n"))
    table = found.select(F.col("part") * BUCKETS + F.col("bucket"), F.col("n")).toArrow()  # at most a row per part and bucket
    counts = np.zeros(FOLDS * 2 * BUCKETS)
    counts[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return counts.reshape(FOLDS, 2, BUCKETS)


def _scored(counts: np.ndarray, prior: float, cost: float) -> ToxicityModel:
    """Scores and their rate from counts by class and bucket, not yet calibrated."""
    totals = counts.sum(axis=1)
    share = (totals[1] + 1) / (totals.sum() + 2)
    odds = (counts[1] + prior * share) / (counts[0] + prior * (1 - share))
    scores = (np.log(odds) - np.log(share / (1 - share)) - cost).astype(np.float32)
    clean = (counts[0] + prior * (1 - share) / BUCKETS) / (totals[0] + prior * (1 - share))
    return ToxicityModel(scores, _rate(scores.astype(np.float64), clean), 0.0, LEVELS[0], -5.0, 0.0)


def _rate(scores: np.ndarray, clean: np.ndarray) -> float:
    """The positive root of sum(p exp(rate s)) = 1 over clean text; where none exists, 1."""
    low, high = 0.0, 20.0
    if clean @ scores >= 0 or not (scores > 0).any():
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if clean @ np.exp(middle * scores) > 1 else (middle, high)
    return low or 1.0


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Offset, slope and mean log-loss by damped Newton steps; a light penalty keeps separable data finite."""
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + 0.01 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
    sure = np.clip(design @ beta, -30, 30) * (2 * y - 1)
    return float(beta[0]), float(beta[1]), float(np.log1p(np.exp(-sure)).mean())


def learn_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from the documents that ``labels`` (id, toxic 0/1) marks, among ids for which ``allowed`` holds.

    Of each class at most ``SAMPLE`` documents teach, those whose id hashes least.  Labels that are
    null or neither 0 nor 1, and null ids, teach nothing; an id marked both ways counts as toxic.
    The prior's strength, then the token's cost and the level of significance are those whose
    calibration fits best, each document weighed by scores learnt without it; nothing is chosen on
    other ids.  Without documents of both classes, every text scores about 0.
    """
    small_batches(docs.sparkSession)
    marked = (
        labels.where(allowed & F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("marked")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = (F.xxhash64("marked"), F.col("marked"))
    sample = marked.where("toxic = 1").orderBy(*order).limit(SAMPLE[1]).unionByName(
        marked.where("toxic = 0").orderBy(*order).limit(SAMPLE[0])
    )
    # The sample has at most 30,000 ids, so it is safe to send everywhere.
    fold = F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("marked").cast("string"))), F.lit(FOLDS)).cast("int")
    # One row speaks for each id, however often it is repeated.
    rows = saved(
        docs.select(F.col(id_col).alias("marked"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(sample), "marked")
        .groupBy("marked", "toxic").agg(F.max("text").alias("text"))
        .select("text", "toxic", fold.alias("fold"))
    )
    counts = _class_counts(rows)
    whole = counts.sum(axis=0)

    def weigh(models: list[list[ToxicityModel]], of) -> pd.DataFrame:
        """``of(model, found)``, a list, for each sampled document under each setting, by the model without its fold."""

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            buckets = Buckets()
            for batch in batches:
                found = [buckets.of(tokens(text)) for text in batch["text"]]
                out = [[v for own in models for v in of(own[f], x)] for f, x in zip(batch["fold"], found, strict=True)]
                yield pd.DataFrame({"toxic": batch["toxic"], "n": list(map(len, found)), "value": out})

        return rows.mapInPandas(each, "toxic int, n long, value array<double>").toPandas()  # a row per sampled document

    def best_of(settings: list[tuple[float, float]]) -> tuple[float, float, ToxicityModel] | None:
        """Prior, cost and model of the setting and level that fit best; None without both classes."""
        models = [[_scored(whole - counts[f], *setting) for f in range(FOLDS)] for setting in settings]
        # The location of the law comes from clean documents: the mean of an extreme is ln K + ln n + Euler's constant.
        tops = weigh(models, lambda own, x: [own.rate * max([0.0, *(s for *_, s in maximal_segments(own.scores[x]))])])
        calm = tops[(tops["toxic"] == 0) & (tops["n"] > 0)]
        if not len(calm) or tops["toxic"].nunique() < 2:
            return None
        places = np.array(calm["value"].tolist()).mean(axis=0) - np.log(calm["n"]).mean() - np.euler_gamma
        for own, place in zip(models, places.tolist(), strict=True):
            for one in own:
                one.log_k = place

        def by_level(own: ToxicityModel, x: np.ndarray) -> list[float]:
            rated = own.rated(x)
            return [total_evidence(rated, level) for level in LEVELS]

        weighed = weigh(models, by_level)
        evidence, toxic = np.array(weighed["value"].tolist()), weighed["toxic"].to_numpy()
        fits = [_logistic(np.arcsinh(evidence[:, k]), toxic) for k in range(evidence.shape[1])]
        best = min(range(len(fits)), key=lambda k: fits[k][2])
        at, level = divmod(best, len(LEVELS))
        model = _scored(whole, *settings[at])
        model.log_k, model.level, (model.offset, model.slope, _) = float(places[at]), LEVELS[level], fits[best]
        return *settings[at], model

    first = best_of([(prior, FIRST_COST) for prior in PRIORS])
    if first is None:
        return _scored(whole, PRIORS[-1], FIRST_COST)
    return best_of([(first[0], cost) for cost in COSTS])[2]


def toxicity_column(text: Column, model: ToxicityModel) -> Column:
    """A struct: score (0 to 1) and passages, the significant segments by their first and last token.

    Null and empty texts score like texts without any evidence.  Texts are scanned whole.
    """
    @F.pandas_udf(PASSAGES)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for texts in batches:
            found = [model.evidence(buckets.of(tokens(t))) for t in texts]
            yield pd.DataFrame(
                {
                    "score": [model.probability(e) for e, _ in found],
                    "passages": [[{"first": a, "last": b, "evidence": x} for a, b, x in s] for _, s in found],
                }
            )

    return judge(F.coalesce(text, F.lit("")))
