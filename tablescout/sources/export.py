"""Delimited files and text out.

Sorted exports are range-partitioned and written as ordered part files: read in name
order they are the sorted table, and no task holds more than its part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import double_text, is_temporal, qcol, text_of, type_of
from ..functions.formats import fmt_dimension, fmt_measure
from ..operators.generate import ColumnRule, generate
from ..operators.grid import SortKey, grid_order, visible_columns
from ..operators.pivot import PIVOT_FACTS
from .delimited import separator
from .dictionary import Dictionary

# Writing options under which a cell's text comes back as it was; ``""`` tells the empty text from NULL.
FAITHFUL = {"escape": '"', "emptyValue": '""', "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _write(df: DataFrame, path: str, sep: str, header: bool, mode: str = "overwrite") -> None:
    # Timestamps are written as their text, which keeps microseconds and no zone.
    texts = [
        qcol(f.name).cast("string").alias(f.name) if is_temporal(f.dataType) else qcol(f.name) for f in df.schema.fields
    ]
    df.select(*texts).write.mode(mode).options(header=header, sep=separator(sep), **FAITHFUL).csv(path)


def export_csv(
    df: DataFrame,
    path: str,
    dictionary: Dictionary,
    condition: Column | None = None,
    order: Sequence[SortKey] = (),
    visible: Sequence[str] | None = None,
    sep: str = ",",
    header: bool = True,
) -> None:
    """Write all filtered rows, raw values, visible columns, in grid order.

    Rows with the same keys are ordered by the partition they were read in, so a key
    that fills a third of the table is spread over many ranges.
    """
    rows = df if condition is None else df.filter(condition)
    rows = rows.orderBy(*grid_order(df, order, dictionary.keys), F.spark_partition_id())
    _write(rows.select(*[qcol(n) for n in visible_columns(dictionary, visible)]), path, sep, header)


def formatted(df: DataFrame, dictionary: Dictionary, places: int = 2) -> DataFrame:
    """All cells as the text the grid shows: measures, calendar keys, dimensions."""
    cells = []
    for name in df.columns:
        f, dtype = dictionary.get(name), type_of(df, name)
        if f is not None and f.formats_as_measure:
            cells.append(fmt_measure(qcol(name), dtype, places).alias(name))
        else:
            cells.append(fmt_dimension(qcol(name), dtype, f.field_type if f else None).alias(name))
    return df.select(*cells)


def formatted_pivot(table: DataFrame, row_dims: Sequence[str], places: int = 2) -> DataFrame:
    """The pivot's shown cells: row labels as they are, numbers with separators."""
    numbers = [c for c in table.columns if c not in row_dims and c not in PIVOT_FACTS]
    return table.select(
        *[F.coalesce(qcol(d), F.lit("")).alias(d) for d in row_dims],
        *[fmt_measure(qcol(c), type_of(table, c), places).alias(c) for c in numbers],
    )


def export_pivot(table: DataFrame, path: str, row_dims: Sequence[str], places: int = 2) -> None:
    """Write the rows of a (collapsed) pivot with formatted cells, in display order."""
    rows = formatted_pivot(table.orderBy("ord"), row_dims, places)
    _write(rows, path, ",", header=True)


def tab_page(page: DataFrame, dictionary: Dictionary, places: int = 2) -> DataFrame:
    """A page as spreadsheet text: formatted cells under upper-cased headers."""
    shown = formatted(page, dictionary, places)
    return shown.toDF(*[c.upper() for c in shown.columns])


def export_tsv(page: DataFrame, path: str, dictionary: Dictionary, places: int = 2) -> None:
    """Write one page of rows as tab-separated text."""
    _write(tab_page(page, dictionary, places), path, "\t", header=True)


def write_synthetic(
    spark: SparkSession,
    rules: Sequence[ColumnRule],
    rows: int,
    path: str,
    seed: int | None = None,
    header: bool = True,
    sep: str = "|",
    parts: int | None = None,
) -> None:
    """Generate rows and write them as delimited text without quotes.

    A cell that holds the delimiter or a line break has no such form and ends the job
    with an error.  The header is a part file of its own, first in name order.
    """
    table = generate(spark, rules, rows, seed, parts)
    lines = delimited_lines(table, sep)
    if header:
        names = separator(sep).join(table.columns)
        lines = spark.range(0, 1, 1, 1).select(F.lit(names).alias("line")).unionAll(lines)
    lines.write.mode("overwrite").text(path)


def delimited_lines(table: DataFrame, sep: str = "|") -> DataFrame:
    """``(line)``: the cells of each row as text with a delimiter between, unquoted; NULL is empty."""
    sep = separator(sep)
    cells = []
    for name in table.columns:
        text = F.coalesce(text_of(qcol(name), type_of(table, name)), F.lit(""))
        bad = text.contains(sep) | text.rlike("[\\r\\n]")
        problem = F.raise_error(F.concat(F.lit(f"{name}: a cell holds the delimiter or a line break: "), text))
        cells.append(F.when(bad, problem).otherwise(text))
    return table.select(F.concat_ws(sep, *cells).alias("line"))


def _two(name: str) -> Column:
    return F.format_string("%.2f", F.col(name))


def profile_digest(fields: DataFrame, distributions: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``(ord, field, digest)``: the profile as short texts, one per field after one for the table.

    The table's text has ``ord`` -1 and no field.  Nothing is cut: each text shows all
    the values that ``distributions`` kept, and who needs one text of some length joins
    and cuts the rows as they like.
    """
    tops = (
        distributions.filter(F.col("kind").isin("value", "null", "others", "total") & (F.col("ord") > 0))
        .groupBy("field")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("ord", F.concat_ws(":", "label", F.col("cnt").cast("string")).alias("t")))
            ).alias("tops")
        )
    )
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    number = lambda c: F.coalesce(double_text(F.col(c)), F.lit("None"))
    lines = [
        F.concat(
            F.lit("=== "), "field", F.lit(" ("), "inferred_semantic", F.lit(", meta "), "meta_type", F.lit(") ===")
        ),
        F.concat(
            F.lit("  missing%="), _two("missing_pct"), F.lit(" nulls="), count("null_count"), F.lit(" empty_str="),
            count("empty_count"), F.lit(" distinct="), count("distinct_count"), F.lit(" unique%="), _two("unique_pct"),
        ),
        F.when(
            F.col("num_mean").isNotNull(),
            F.concat(
                F.lit("  min="), number("num_min"), F.lit(" max="), number("num_max"), F.lit(" mean="),
                number("num_mean"), F.lit(" median="), number("num_median"), F.lit(" std="), number("num_std_pop"),
                F.lit(" var="), number("num_var_pop"),
            ),
        ),
        F.when(
            F.col("outlier_count").isNotNull(),
            F.concat(F.lit("  IQR outliers: "), count("outlier_count"), F.lit(" ("), _two("outlier_pct"), F.lit("%)")),
        ),
        F.when(
            (F.col("role") == "D") & (F.size("tops") > 0),
            F.concat(F.lit("  top values: "), F.array_join(F.transform("tops", lambda t: t["t"]), ", ")),
        ),
    ]
    # One row per field on the broadcast side.
    blocks = fields.join(F.broadcast(tops), "field", "left").select("ord", "field", F.concat_ws("\n", *lines).alias("digest"))
    head = duplicates.select(
        F.lit(-1).alias("ord"),
        F.lit(None).cast("string").alias("field"),
        F.concat(
            F.lit("Rows: "), F.col("total_rows").cast("string"), F.lit("; duplicate extra rows: "),
            F.col("duplicate_extra_rows").cast("string"), F.lit(" ("), _two("duplicate_pct"), F.lit("%)"),
        ).alias("digest"),
    )
    return head.unionByName(blocks)
