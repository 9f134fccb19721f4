import collections
import math
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescout.llm import decontaminate, line_dedup, logbilinear, sharding, simhash, toxicity
from tablescout.llm.common import in_fold
from tests.llm import brute


def segments_by_force(scores):
    """Maximal segments by definition: grow the best segment, then look left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(
        ((sum(scores[a : b + 1]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a, len(scores))),
    )
    a, b = best[3], best[4]
    right = [(x + b + 1, y + b + 1, s) for x, y, s in segments_by_force(scores[b + 1 :])]
    return [*segments_by_force(scores[:a]), (a, b, best[0]), *right]


@settings(max_examples=200, deadline=None)
@given(scores=st.lists(st.integers(-5, 5), max_size=14))
def test_maximal_segments(scores):
    found = toxicity.maximal_segments(np.array(scores, np.float32))
    force = segments_by_force(scores)
    assert [s for *_, s in found] == [s for *_, s in force]
    assert all(sum(scores[a : b + 1]) == s for a, b, s in found)


def test_segments_of_long_texts_take_linear_time():
    scores = np.where(np.arange(2_000_000) % 2 == 0, 1.0, -1.5).astype(np.float32)
    assert len(toxicity.maximal_segments(scores)) == 1_000_000


def toxic_corpus(n=1_200, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        found = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(20, 300))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            at = rng.randrange(len(found))
            found[at:at] = [rng.choice(["scum", "moron", "Trash!"]) for _ in range(rng.randrange(2, 5))]
        rows.append((i, " ".join(found)))
        if rng.random() < 0.7:
            labels.append((i, toxic))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    noise = [(None, 1), (3, None), (5, 7), (99_999, 1), labels[0], labels[0]]
    marks = spark.createDataFrame(labels + noise, "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, marks, ~in_fold("doc_id", 3, 1))
    out = docs.select("doc_id", toxicity.toxicity_column(F.col("text"), model).alias("t")).collect()
    truth = {i: t for i, t in labels if brute.in_fold(i, 3, 1)}
    right = [(r.t.score >= 0.7) == bool(truth[r.doc_id]) for r in out if r.doc_id in truth]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    texts = dict(rows)
    for r in out:
        found = toxicity.tokens(texts[r.doc_id])
        assert all(0 <= p.first <= p.last < len(found) for p in r.t.passages)
        assert 0 <= r.t.score <= 1


def best_passages(scores):
    """Maximal segments by their definition: the best sum first (the shortest of equals), then left and right of it."""
    best = max(
        ((sum(scores[a : b + 1]), -(b - a), -a, b) for a in range(len(scores)) for b in range(a, len(scores))), default=(0, 0, 0, 0)
    )
    if best[0] <= 0:
        return []
    first, last = -best[2], best[3]
    right = [(last + 1 + a, last + 1 + b) for a, b in best_passages(scores[last + 1 :])]
    return [*best_passages(scores[:first]), (first, last), *right]


def test_scores_and_passages_against_brute_force(spark):
    """Whole scores from the model's table: log-odds, all maximal segments, their evidence, the curve."""
    rows, labels = toxic_corpus(300)
    rows = [(i, " ".join(t.split()[:40])) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~in_fold("doc_id", 3, 1))
    assert model.level in toxicity.LEVELS
    out = {r.doc_id: r.t for r in docs.select("doc_id", toxicity.toxicity_column(F.col("text"), model).alias("t")).collect()}
    for i, text in rows:
        found = re.findall(r"[a-z0-9']+", text.lower())
        scores = [round(float(model.scores[zlib.crc32(w.encode()) % toxicity.BUCKETS]), 12) for w in found]
        rated = [(a, b, model.rate * sum(scores[a : b + 1]) - model.log_k - math.log(len(found))) for a, b in best_passages(scores)]
        strong = [x for x in rated if x[2] >= model.level]
        evidence = sum(x[2] for x in strong) if strong else max([0.0, *(x[2] for x in rated)])
        expected = 1 / (1 + math.exp(-(model.offset + model.slope * math.asinh(evidence))))
        assert abs(out[i].score - expected) < 1e-4
        assert [(p.first, p.last) for p in out[i].passages] == [(a, b) for a, b, _ in strong]


def test_labels_of_other_ids_change_nothing(spark):
    """Neither scores nor prior, cost, level or curve follow labels that are not allowed."""
    rows, labels = toxic_corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - t if brute.in_fold(i, 3, 1) else t) for i, t in labels]
    one, other = (
        toxicity.learn_toxicity(docs, spark.createDataFrame(given, "doc_id long, toxic int"), ~in_fold("doc_id", 3, 1))
        for given in (labels, turned)
    )
    assert np.array_equal(one.scores, other.scores)
    assert np.allclose(
        [one.rate, one.log_k, one.level, one.offset, one.slope], [other.rate, other.log_k, other.level, other.offset, other.slope]
    )


def test_awkward_texts_score_like_texts_without_evidence(spark):
    rows, labels = toxic_corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    odd = spark.createDataFrame([(t,) for t in brute.AWKWARD], "text string")
    scores = [r[0].score for r in odd.select(toxicity.toxicity_column(F.col("text"), model)).collect()]
    assert len(scores) == len(brute.AWKWARD) and all(0 <= s < 0.5 for s in scores)
    assert scores[0] == scores[1] == model.probability(0.0)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for own, labels in ((docs, marks), (docs, marks.where("false")), (docs.where("false"), marks)):
        model = toxicity.learn_toxicity(own, labels, F.lit(True))
        assert [r[0].score < 0.1 for r in docs.select(toxicity.toxicity_column(F.col("text"), model)).collect()] == [True]


CLASHES = ["id", "marked", "toxic", "fold", "h", "row", "n", "word", "kind", "c", "p", "rare", "label", "cell", "shard", "slot", "line", "pos", "key", "m"]


def test_extra_columns_with_clashing_names(spark):
    """Operators read the id and the text only, whatever other columns are called."""
    rows, labels = toxic_corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("marked", F.lit("x"))
    model = toxicity.learn_toxicity(docs, marks, F.lit(True))
    assert docs.select("*", toxicity.toxicity_column(F.col("text"), model)["score"]).count() == 120
    assert logbilinear.language_scores(docs, F.lit(True)).count() == 120
    assert simhash.simhash_components(docs).count() == 120
    assert sharding.shard_by_bytes(docs, 4).count() == 120
    assert line_dedup.drop_lines(docs).count() == 120
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").withColumn("hit", F.lit(1))
    assert decontaminate.contaminated(docs.withColumn("hit", F.lit(2)), items).count() == 1


# Language model


def corpus(n=500, seed=1):
    """Two languages, so that the words before tell about the next one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tongue = "aé"[i % 2]
        rows.append((i, " ".join(f"{tongue}{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(1, 200)))))
    return rows


def tokens(text):
    return [*brute.words(text), ""]


def test_scores_against_brute_force_and_base(spark, monkeypatch):
    monkeypatch.setattr(logbilinear, "KNOWN", 400)
    rows = corpus() + [(10_000, None), (10_001, ""), (None, "a1 a2 unseenword"), (7, "a1 a1"), (7, "a1 a1"), (10_002, "é1 zzz zzz")]
    rows.append((10_003, " ".join(["a1"] * 50_000)))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(4)
    out = logbilinear.language_scores(docs, ~in_fold("doc_id", 5, 1)).collect()
    counts = collections.Counter(w for i, t in rows if not brute.in_fold(i, 5, 1) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)

    def base(text):
        return sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(text))

    def key(i, t):
        return (repr(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(base(t), 6))

    got = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == sorted(key(i, t) for i, t in rows)
    held = [r for r in out if brute.in_fold(r.doc_id, 5, 1) and r.doc_id < 10_000]
    assert len(held) > 60 and sum(r.score for r in held) > sum(r.base_score for r in held) * 0.95


def test_probabilities_sum_to_one(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = logbilinear.count_words(docs)
    model = logbilinear.learn_language(docs, counts)
    before = np.array([[0, 1, 2], [model.classes] * 3, [model.classes - 1, 3, 0]])
    logits = model.predicted(before) @ model.vectors.T + model.bias - model.log_norms(before)[:, None]
    assert np.allclose(np.exp(logits).sum(axis=1), 1, atol=1e-4)
    table = {bytes(r.word): (r.kind, r.c) for r in counts.collect()}
    inside = np.full(logbilinear.OTHERS, 0.5)
    for word, (kind, c) in table.items():
        if model.known.get(word, model.top) >= model.top:
            inside[kind] += c + 0.5
    assert np.allclose(inside, model.masses)


def test_every_place_is_learnt_from(spark):
    """Whole texts of all rows: null, empty, long, repeated, without an id; parts of any number."""
    rows = corpus(80) + [(3, "a1 a2"), (None, "a1"), (500, None), (501, ""), (502, "a1 a2 " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        model = logbilinear.learn_language(docs.repartition(parts), logbilinear.count_words(docs))
        assert model.places == model.tokens == sum(len(tokens(t)) for _, t in rows)


def test_average_weighs_parts_by_their_places(spark):
    """One round over two parts is the mean of what each part learns alone, by its places."""
    shares = np.full(logbilinear.OTHERS + 3, 1 / (logbilinear.OTHERS + 3))
    known, class_of, start = {b"a": 0, b"b": 1, b"": 2}, np.arange(3), logbilinear.first_guess(shares)
    texts = ["a b a b", "a b"]
    alone, seen = [], []
    for part, text in enumerate(texts):
        learner = logbilinear.NceLearner(start, shares, 0.01, part)
        learner.add(np.array([known[w.encode()] for w in tokens(text)]))
        alone.append(learner.finish())
        seen.append(learner.seen)
    expected = np.average(alone, axis=0, weights=seen)
    docs = spark.sparkContext.parallelize([(t,) for t in texts], 2).toDF("text string")
    got, places = logbilinear.learn_round(docs, start, shares, known, class_of, 0.01)
    assert places == 5 + 3 and np.allclose(np.concatenate([v.ravel() for v in got.values()]), expected, atol=1e-6)
    same, none = logbilinear.learn_round(docs.where("false"), start, shares, known, class_of, 0.01)
    assert none == 0 and all(np.array_equal(same[k], start[k]) for k in start)


def test_scores_are_sums_of_the_models_log_probabilities(spark, monkeypatch):
    """Token by token: softmax over all classes, times the word's share of its class's counts."""
    monkeypatch.setattr(logbilinear, "KNOWN", 300)
    rows = corpus(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    training = ~in_fold("doc_id", 5, 1)
    counts = logbilinear.count_words(docs.where(training))
    model = logbilinear.learn_language(docs.where(training), counts)
    table = {bytes(r.word): r.c for r in counts.collect()}

    def class_of(word):
        rank = model.known.get(word, model.top)
        return rank if rank < model.top else model.top + logbilinear.other_class(word)

    def score(text):
        total, before = 0.0, [model.classes] * logbilinear.CONTEXT
        for word in (w.encode() for w in tokens(text)):
            hat = sum(model.context[k][before[k]] for k in range(logbilinear.CONTEXT))
            odds = (model.vectors @ hat + model.bias).astype(float)
            own = class_of(word)
            total += odds[own] - np.log(np.exp(odds).sum())
            if own >= model.top:
                total += math.log((table.get(word, 0) + 0.5) / model.masses[own - model.top])
            before = [own, *before[:-1]]
        return total / math.log(10)

    out = {r.doc_id: r.score for r in logbilinear.language_scores(docs, training).collect()}
    assert all(abs(out[i] - score(t)) < 1e-3 * len(tokens(t)) ** 0.5 for i, t in rows)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = logbilinear.language_scores(docs, F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in out] == [(3, 0, 0), (1, 0, 0)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert logbilinear.language_scores(docs.where("false"), F.lit(True)).collect() == []


def test_classes_of_other_words():
    assert logbilinear.other_class(b"plain") == 0 == logbilinear.other_class(b"")
    assert 1 <= logbilinear.other_class("é".encode()) < logbilinear.OTHERS


def test_classes_of_unknown_words_are_looked_up_only_beyond_ascii(monkeypatch):
    known, class_of, asked = {b"a": 0, b"b": 1}, np.array([0, 1]), []
    kind = logbilinear.other_class
    monkeypatch.setattr(logbilinear, "other_class", lambda w: asked.append(w) or kind(w))
    ranks, classes = logbilinear._class_ids([b"b", b"x", b"a", b"y", b""], known, class_of, 2)
    assert ranks.tolist() == [1, -1, 0, -1, -1] and classes.tolist() == [1, 2, 0, 2, 2] and not asked
    found = [b"a", "é".encode(), b"x", "ω".encode()]
    ranks, classes = logbilinear._class_ids(found, known, class_of, 2)
    assert classes.tolist() == [0, *(2 + kind(w) for w in found[1:])]
    assert logbilinear._class_ids(found[1:], {}, np.zeros(0, np.int64), 0)[1].tolist() == list(map(kind, found[1:]))
