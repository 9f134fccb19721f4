import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescout.llm import byte_bpe, token_counts
from tests.llm import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(st.one_of(st.sampled_from(" ▁\n\t'aZé9.ß漢"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(open(MODEL, "rb").read())


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    return brute.tiktoken_encoding(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_counts_equal_the_library(text, counter, library):
    assert counter([text]) == [len(library.encode(text))]


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_ids_equal_the_library(text, encoder, encoding):
    assert encoder([text])[0].tolist() == encoding.encode_ordinary(text)


def test_counts_of_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(brute.AWKWARD)] + [(None, "a b", "y"), (3, "a b", "z"), (3, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = token_counts.token_counts(docs, MODEL, limit=100).collect()
    assert len(out) == len(rows)
    expected = sorted((repr(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == expected
    assert all(r.over_limit == (r.n_tokens > 100) for r in out)


def test_counts_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, MODEL).collect() == []


def test_a_worker_table_starts_anew(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_ROWS", 3)
    texts = ["a b c d e", "f g h", "a b", "i j k l"]
    assert [counter([t])[0] for t in texts] == [len(library.encode(t)) for t in texts]


def test_encoding_round_trip(spark, encoding):
    rows = [(i, t, 1) for i, t in enumerate(brute.AWKWARD)] + [(None, "same", 1), (0, "same", 1), (0, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    got = sorted((repr(r.doc_id), list(r.ids), bytes(r.decoded)) for r in out)
    assert got == sorted((repr(i), encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)


def test_slices_and_old_tables_change_nothing(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TABLE_ROWS", 4)
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 30)
    own = byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [t or "" for t in brute.AWKWARD] * 2
    assert [ids.tolist() for ids in own(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_long_rows_decode_without_arrays(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ARRAY_IDS", 3)
    docs = spark.createDataFrame([(1, "many tokens in one text é"), (2, "a")], "doc_id long, text string")
    out = byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in out] == ["many tokens in one text é", "a"]


def test_encoding_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_a_token_is_taken_whole_even_where_merges_do_not_reach_it():
    tokens = [bytes([b]) for b in range(256)] + [b"abc"]
    assert byte_bpe.Encoder(tokens, r"\S+|\s+")(["abc"])[0].tolist() == [256]
    assert byte_bpe.Encoder(tokens, r"\S+|\s+")(["abcd"])[0].tolist() == list(b"abcd")


def test_gaps_in_ranks_are_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="without gaps"):
        byte_bpe.read_ranks(str(path))


def test_character_classes_equal_the_library(encoder, encoding):
    for start in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert encoder([text])[0].tolist() == encoding.encode_ordinary(text), hex(start)


def test_lists_of_nothing():
    assert byte_bpe.lists([]).to_pylist() == []
    assert byte_bpe.lists([np.zeros(0, np.int32)]).to_pylist() == [[]]
