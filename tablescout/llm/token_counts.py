"""Token counts by a sentencepiece BPE model, without making the ids of any document.

No piece of such a model has a word separator after another character, so no merge crosses the
start of a separator run.  A text therefore falls into pre-tokens (a run of separators and what
follows) that are segmented independently, and its count is the sum over its pre-tokens.

Each task holds a table pre-token -> number of pieces, filled once per distinct pre-token, and
joins it to the pre-token frequencies of its documents.  The join stays inside the task: a shuffle
of all (document, pre-token) frequencies would move more bytes than the texts have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import read_bytes, small_batches

SEPARATOR = "▁"
PRE_TOKEN = re.compile(f"[ {SEPARATOR}]+[^ {SEPARATOR}]*")

#: Distinct pre-tokens that a worker's table holds before it starts anew; memory only, not results.
TABLE_ROWS = 200_000


class PieceCounter:
    """Numbers of pieces per text, by way of a table of distinct pre-tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = map(self._pieces.id_to_piece, range(self._pieces.get_piece_size()))
        if any(SEPARATOR in name.lstrip(SEPARATOR) for name in names):
            raise ValueError("the model has pieces across word boundaries; its texts don't fall into pre-tokens")
        if len(self._pieces.encode("a")) != 1 or self._pieces.encode("  a", out_type=str) == ["▁a"]:
            raise ValueError("the model must add a word separator in front and keep repeated blanks")
        self._alone = len(self._pieces.encode("a ")) - len(self._pieces.encode("a"))
        self._table: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        frequencies = [Counter(PRE_TOKEN.findall(" " + text)) if text else Counter() for text in texts]
        if len(self._table) > TABLE_ROWS:
            self._table = {}
        table = self._table
        new = [pre for pre in set().union(*frequencies) if pre not in table]
        # The model puts the first separator back in front of each pre-token.
        for pre, ids in zip(new, self._pieces.encode([pre[1:] for pre in new], num_threads=1), strict=True):
            table[pre] = len(ids) if len(pre) > 1 else self._alone
        return [sum(n * table[pre] for pre, n in found.items()) for found in frequencies]


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    Null texts count as empty: no bytes, no tokens.  Null ids and repeated rows are kept as they
    are; other columns of ``docs`` are not read.  A text is processed whole, whatever its length.
    """
    small_batches(docs.sparkSession)
    model = read_bytes(model_path)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = PieceCounter(model)
        for texts in batches:
            yield pd.Series(count(texts.tolist()), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
