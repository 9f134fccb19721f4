"""The registered queries on the given tables against the libraries and brute force."""

import public_tokenizers
import pytest

from tablescout.llm import queries
from tests.llm import brute
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_names():
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 14)]


def test_token_counts(spark, sf_dir, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, sf_dir).collect()}
    counts = {i: len(library.encode(t)) for i, t in documents.items()}
    assert out == {i: (len(t.encode()), counts[i], counts[i] > 4096) for i, t in documents.items()}


def test_byte_bpe(spark, sf_dir, documents):
    library = brute.tiktoken_encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in queries.op6_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == brute.sha(documents[r.doc_id])


def test_simhash(spark, sf_dir, documents):
    ids = sorted(documents)
    prints = [brute.simhash(documents[i]) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = {(i, f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute.classes(len(ids), pairs), strict=True)}
    assert {tuple(r) for r in queries.op5_simhash(spark, sf_dir).collect()} == expected


def test_sharding(spark, sf_dir, documents):
    out = queries.op3_sharding(spark, sf_dir).collect()
    loads = [sum(r.size for r in out if r.shard == k) for k in range(16)]
    assert len(out) == len(documents) and max(loads) <= 1.1 * min(loads)


def test_scores_have_the_rows(spark, sf_dir, documents):
    toxic = queries.op1_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in toxic) == sorted(documents)
    assert all(r.predicted == (r.score >= 0.7) and r.held_out == brute.in_fold(r.doc_id, 3, 1) for r in toxic)
    language = queries.op7_lm_scores(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in language) == sorted(documents)
    held = [r for r in language if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_forms(spark, sf_dir, name):
    assert compare(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name]) is None
