"""What several operators of this subpackage share: scratch tables, words, Arrow batches, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of long texts; a batch of a thousand average documents is a few megabytes.
BATCH_ROWS = 1_000

#: What `words` splits at, as a character class for regular expressions and as the characters themselves.
BLANK_CLASS = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{shared.rstrip('/')}/tablescout-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read back: short lineage, fixed content."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of texts small in this session; only memory depends on it, no result does."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def words(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text between blanks, A-Z lower-cased; other letters stay as they are."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id's text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased only; all-ASCII texts take the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def read_bytes(path: str) -> bytes:
    """A small file of the driver's machine, such as a vocabulary; tasks get its content, not its path."""
    with open(path, "rb") as file:
        return file.read()
