"""Byte-level BPE through sentencepiece: a model serialised from ranks, encoding, and decoding.

Byte-level ranks become a sentencepiece BPE model: every byte is one character, every token a
piece whose score is its negative rank, and the normaliser is the identity.  Both libraries then
merge the same pairs in the same order.  A pre-token that is itself a token is taken whole, as
byte-level encoders do.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import read_bytes, small_batches

#: The character that stands for byte b is chr(BYTE_BASE + b): letters, none of them a blank.
BYTE_BASE = 0x100
BYTE_TABLE = {b: chr(BYTE_BASE + b) for b in range(256)}

#: Distinct pre-tokens after which a worker's table starts anew; memory only, not results.
TABLE_ROWS = 300_000

#: Characters of texts that are encoded at a time, and ids of a text that are decoded by arrays; memory only.
SLICE_CHARS, ARRAY_IDS = 2_000_000, 1_000_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order, from lines of a base64 token and its rank."""
    pairs = [line.split() for line in read_bytes(path).splitlines() if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [tokens[rank] for rank in range(len(tokens))]


def _varint(number: int) -> bytes:
    out = bytearray()
    while number > 0x7F:
        out.append(number & 0x7F | 0x80)
        number >>= 7
    out.append(number)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def mapped(data: bytes) -> str:
    """One character per byte."""
    return data.decode("latin-1").translate(BYTE_TABLE)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file: piece 0 is unknown, piece r + 1 is the token of rank r.

    Fields of the public model format: pieces 1 (piece 1, score 2, type 3), trainer_spec 2
    (model_type 3: BPE is 2), normalizer_spec 3 (name 1, add_dummy_prefix 3,
    remove_extra_whitespaces 4, escape_whitespaces 5).
    """

    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece("<unk>", 0.0, 2), *(piece(mapped(token), -float(rank), 1) for rank, token in enumerate(tokens))]
    plain = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, _number(3, 2)) + _message(3, plain)


class Encoder:
    """Ids of texts by their pre-tokens, each distinct one encoded once while it stays in the table."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self._find = regex.compile(pattern).findall
        self._whole = {mapped(token): rank for rank, token in enumerate(tokens)}
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self._start_anew()

    def _start_anew(self) -> None:
        self._table: dict[str, int] = {}  # pre-token -> number of its run of ids
        self._sizes, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        """Runs of ids for pre-tokens that the table lacks: tokens as they are, the others in one call."""
        names = [mapped(pre.encode("utf-8", "surrogatepass")) for pre in new]
        parts = [name for name in names if name not in self._whole]
        pieces = self._pieces.encode(parts, num_threads=1)
        split = np.fromiter(chain.from_iterable(pieces), np.int32) - 1
        cut, whole = iter(map(len, pieces)), self._whole.get
        ranks = np.fromiter((whole(name, -1) for name in names), np.int32, len(names))
        sizes = np.fromiter((1 if rank >= 0 else next(cut) for rank in ranks.tolist()), np.int64, len(names))
        flat = np.empty(sizes.sum(), np.int32)
        single = np.repeat(ranks >= 0, sizes)
        flat[single], flat[~single] = ranks[ranks >= 0], split
        first = len(self._table)
        self._table.update(zip(new, range(first, first + len(new)), strict=True))
        self._sizes = np.concatenate([self._sizes, sizes])
        self._flat = np.concatenate([self._flat, flat])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            to, chars = at + 1, len(texts[at])
            while to < len(texts) and chars + len(texts[to]) <= SLICE_CHARS:
                chars += len(texts[to])
                to += 1
            out += self._encode(texts[at:to])
            at = to
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [self._find(text) for text in texts]
        if len(self._table) > TABLE_ROWS:
            self._start_anew()
        table = self._table
        self._learn([pre for pre in set().union(*found) if pre not in table])
        sizes, flat = self._sizes, self._flat
        starts = np.cumsum(sizes) - sizes
        return [flat[spread(starts, sizes, np.fromiter(map(table.__getitem__, f), np.int64, len(f)))] for f in found]


def spread(starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each chosen run, one run after the other."""
    own = sizes[chosen]
    ends = np.cumsum(own)
    return np.repeat(starts[chosen] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow list array from one array per row."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode_column(text: Column, tokens: list[bytes], pattern: str) -> Column:
    """Ids (array of int) of a text column; a null text has no ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(tokens, pattern)
        for texts in batches:
            yield lists(encoder(texts.to_pylist()))

    return encode(F.coalesce(text, F.lit("")))


def decode_column(ids: Column, tokens: list[bytes]) -> Column:
    """The bytes that a column of ids stands for; null or empty ids give no bytes."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(sizes) - sizes

        def text(row: pa.ListScalar) -> bytes:
            if not row.is_valid or not len(row):
                return b""
            own = row.values.to_numpy(zero_copy_only=False)
            if len(own) > ARRAY_IDS:
                return b"".join(map(tokens.__getitem__, own.tolist()))
            return flat[spread(starts, sizes, own)].tobytes()

        for rows in batches:
            yield pa.array(map(text, rows), pa.binary())

    return decode(ids)


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int), decoded (the bytes decoded from ids).

    Null texts count as empty and have no ids.  Null ids of documents and repeated rows are kept;
    other columns are not read.  A text is encoded whole, whatever its length.
    """
    small_batches(docs.sparkSession)
    tokens = read_ranks(ranks_path)
    ids = docs.select(F.col(id_col), encode_column(F.col(text_col), tokens, pattern).alias("ids"))
    return ids.withColumn("decoded", decode_column(F.col("ids"), tokens))
