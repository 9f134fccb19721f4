"""Delimited files in: one table with the types its dictionary asks for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol, safe_double, safe_timestamp
from ..functions.formats import size_text
from ..operators.quickstats import one_row_per_field
from .dictionary import Dictionary

def separator(text: str) -> str:
    """The delimiter itself; the two characters ``\\t`` stand for a tab."""
    return "\t" if text == "\\t" else text


@dataclass(frozen=True)
class Dataset:
    """A loaded table with its dictionary and where it came from.

    ``raw`` is the text the file holds, ``df`` the same rows with the dictionary's types.
    """

    df: DataFrame
    dictionary: Dictionary
    source: str = ""
    delimiter: str = ","
    decimals: int = 2
    raw: DataFrame | None = None

    def register(self, name: str = "data") -> Dataset:
        """Make the table a temporary view; a reload under the same name replaces it."""
        self.df.createOrReplaceTempView(name)
        return self

    def save(self, path: str) -> Dataset:
        """Write text and typed table as Parquet, replacing what is there, and go on from that copy.

        The file is split into cells once this way however many statistics are asked for.
        """
        spark = self.df.sparkSession
        if self.raw is None:
            self.df.write.mode("overwrite").parquet(path)
            return replace(self, df=spark.read.parquet(path))
        self.raw.write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
        return replace(self, df=typed(stored, self.dictionary), raw=stored)

    def bad_cells(self) -> DataFrame:
        """``(field, row_count, null_count, bad_count)``: cells without text, and with text of another type."""
        if self.raw is None:
            raise ValueError("this dataset was not read from text")
        checks = typed(self.raw, self.dictionary, flags=True)
        return one_row_per_field(
            checks,
            {
                n: [
                    F.count(F.lit(1)).alias("row_count"),
                    F.count_if(qcol(n) == "null").alias("null_count"),
                    F.count_if(qcol(n) == "bad").alias("bad_count"),
                ]
                for n in self.raw.columns
            },
        )


def typed_cell(text: Column, dtype: T.DataType) -> Column:
    """A text cell in the type asked for, NULL where it does not read as one."""
    if isinstance(dtype, T.StringType):
        return text
    if isinstance(dtype, T.DoubleType):
        return safe_double(text, T.StringType())
    if isinstance(dtype, T.DecimalType):
        return F.replace(F.btrim(text), F.lit("_"), F.lit("")).try_cast(dtype)
    return safe_timestamp(text, T.StringType()).cast(dtype)


def typed(raw: DataFrame, dictionary: Dictionary, flags: bool = False) -> DataFrame:
    """The columns of a text table in the dictionary's types; with ``flags`` null, bad or good instead."""
    cells = []
    for name in raw.columns:
        text = qcol(name)
        cell = typed_cell(text, dictionary[name].spark_type)
        if flags:
            cell = F.when(text.isNull(), "null").when(cell.isNull(), "bad").otherwise("good")
        cells.append(cell.alias(name))
    return raw.select(*cells)


def _options(delimiter: str, header: bool, multiline: bool) -> dict:
    return {
        "sep": separator(delimiter),
        "header": header,
        "multiLine": multiline,
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
    }


def file_header(spark: SparkSession, path: str, delimiter: str, header: bool = True) -> list[str]:
    """Column names of the file; reads its first line only."""
    return spark.read.options(**_options(delimiter, header, False)).csv(path).columns


def header_mismatch(names: list[str], dictionary: Dictionary) -> str | None:
    """One message that lists dictionary columns the file lacks and the reverse."""
    absent = [n for n in dictionary.names if n not in names]
    unknown = [n for n in names if n not in dictionary.names]
    if not absent and not unknown:
        return None
    return f"columns in the dictionary but not in the file: {absent}; in the file but not in the dictionary: {unknown}"


def read_dataset(
    spark: SparkSession,
    path: str,
    dictionary: Dictionary | None = None,
    delimiter: str = ",",
    header: bool = True,
    decimals: int = 2,
    multiline: bool = False,
) -> Dataset:
    """Read delimited text with the types of its dictionary; lazily, in parallel splits.

    Nothing is inferred, so dimension codes keep their leading zeros.  Without a
    dictionary every column is a text dimension.  A cell that is not of its type is NULL
    in ``df`` and keeps its text in ``raw``, where profiles tell it from a missing one;
    ``bad_cells`` counts both.  ``multiline`` allows line breaks in quoted cells but makes each file one split.
    """
    if header or dictionary is None:
        names = file_header(spark, path, delimiter, header)
    else:
        names = dictionary.names
    problem = header_mismatch(names, dictionary) if dictionary else None
    if problem:
        raise ValueError(problem)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).options(**_options(delimiter, header, multiline)).csv(path)
    known = dictionary or Dictionary.of(raw)
    return Dataset(typed(raw, known), known, path, separator(delimiter), decimals, raw)


# Labels of file extensions and delimiters.
FORMATS = {
    "csv": "CSV (delimited text)",
    "tsv": "TSV (delimited text)",
    "tab": "TSV (delimited text)",
    "txt": "Plain text (delimited)",
    "json": "JSON / JSON-lines (not inferred from parser)",
    "jsonl": "JSON / JSON-lines (not inferred from parser)",
    "ndjson": "JSON / JSON-lines (not inferred from parser)",
    "parquet": "Parquet (columnar binary)",
    "pq": "Parquet (columnar binary)",
    "xlsx": "Spreadsheet binary",
    "xls": "Spreadsheet binary",
    "": "Unknown extension (loaded as delimited text)",
}
DELIMITERS = {"\t": "Tab", "|": "Pipe (|)", ",": "Comma", ";": "Semicolon"}


def format_label(extension: Column) -> Column:
    out = F.concat(F.upper(extension), F.lit(" (loaded as delimited text)"))
    for ext, label in FORMATS.items():
        out = F.when(F.lower(extension) == ext, label).otherwise(out)
    return out


def delimiter_label(delimiter: str) -> str:
    return DELIMITERS.get(separator(delimiter), repr(delimiter))


def file_facts(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(file_name, file_count, file_size, size_text, format, delimiter)`` of the files at a path.

    The files are listed with their lengths; none of them is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("first_path", "/"), -1)
    extension = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    return files.agg(
        F.min("path").alias("first_path"),
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("file_size"),
    ).select(
        name.alias("file_name"),
        "file_count",
        "file_size",
        size_text(F.col("file_size")).alias("size_text"),
        format_label(extension).alias("format"),
        F.lit(delimiter_label(delimiter)).alias("delimiter"),
    )
