"""A training corpus from the documents table: five stages, each an operator over all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as
the next one's documents.  All but the last return the columns of their input.  Null ids, null or
empty texts and repeated rows pass unless a stage's rule takes them; extra columns are carried
along.  Helper columns start with two underscores.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import byte_bpe, decontaminate, line_dedup, near_copies, toxicity
from tablescout.llm.common import in_fold, saved, small_batches
from tablescout.llm.queries import TOXIC_FROM, byte_bpe_digests, table, tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxic threshold; labels of one fold of ids are never learnt from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn_toxicity(docs, labels, ~in_fold("doc_id", 3, 1))
    judged = docs.withColumn("__score", toxicity.toxicity_column(F.col("text"), model)["score"])
    return judged.where(F.col("__score") < TOXIC_FROM).drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without lines that larger ids repeat; ``n_chars`` follows the text."""
    kept = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (`near_copies.one_of_each`)."""
    small_batches(spark)
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    small_batches(spark)
    found = decontaminate.contained_items(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.withColumn("__items", F.size(found)).where(F.col("__items") == 0).drop("__items")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, and digests of its ids and of the bytes decoded from them."""
    coded = byte_bpe.encode_decode(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", *byte_bpe_digests())


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", encode),
]

#: Learnt scores and XXH64 fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
