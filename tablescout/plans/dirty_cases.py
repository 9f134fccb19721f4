"""Named queries on cells that are missing, blank, padded, not finite or no numbers.

The given tables hold none of these, so every row of ``orders`` gets its share of them
by its key; the queries read all rows, and their SQL derives the same cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distribution, filters, grid, profile, quality, quickstats, report
from ..operators.filters import DrillSpec
from ..operators.generate import STATES
from ..operators.pivot import pivot, pivot_long
from ..sources.delimited import file_facts, read_dataset
from ..sources.dictionary import Dictionary, Field
from ..sources.export import delimited_lines, export_csv, write_synthetic
from .pivot_cases import comparable, pivot_sql
from .scratch import scratch_folder
from .source_cases import RULES, draw_sql, synthetic
from .stats_cases import (
    CUSTOMER_FIELDS,
    _customer,
    _orders,
    base_sql,
    duplicate_sql,
    histogram_sql,
    labelled_bins_sql,
    outlier_sql,
    pattern_sql,
    profile_sql,
    profile_table,
    report_sql,
    rounded,
    table,
    top_sql,
    union,
    value_distribution_sql,
)

# The cells as SQL that both engines read alike.
CELLS = {
    "k": "o_orderkey",
    "status": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderstatus END",
    "amount": "CASE WHEN o_orderkey % 7 = 3 THEN NULL WHEN o_orderkey % 40 = 5 THEN o_totalprice * 10 ELSE o_totalprice END",
    "written": "CASE WHEN o_orderkey % 9 = 1 THEN '1_000' WHEN o_orderkey % 9 = 2 THEN '1e3' WHEN o_orderkey % 9 = 3 THEN 'abc' "
    "WHEN o_orderkey % 9 = 4 THEN '' WHEN o_orderkey % 9 = 5 THEN NULL ELSE concat('  ', CAST(o_custkey AS {text}), ' ') END",
    "wild": "CASE WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 5 = 1 THEN CAST('{infinity}' AS DOUBLE) "
    "WHEN o_orderkey % 5 = 2 THEN -CAST('{infinity}' AS DOUBLE) WHEN o_orderkey % 5 = 3 THEN NULL ELSE o_totalprice END",
    "day": "o_orderdate",
}
SOURCE = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in CELLS.items()).format(text="VARCHAR", infinity="inf") + " FROM orders) AS dirty"
# A text cell as a number: blanks around it and underscores between digits are fine.
WRITTEN = "try_cast(replace(trim(written), '_', '') AS DOUBLE)"
NUMBERS = f"(SELECT {WRITTEN} AS written FROM {SOURCE}) AS numbers"
FIELDS = [
    ("k", "number", "Char", "D", "bigint"),
    ("status", "text", "Char", "D", "string"),
    ("amount", "number", "Num", "M", "double"),
    ("day", "time", "Datetime", "D", "timestamp_ntz"),
]


def dirty(spark, sf_dir) -> DataFrame:
    cells = [f"{e} AS {n}".format(text="STRING", infinity="Infinity") for n, e in CELLS.items()]
    return table(spark, sf_dir, "orders").selectExpr(*cells)


def _profiled(s, d):
    df = dirty(s, d).select("k", "status", "amount", "day")
    return df, Dictionary.of(df, ["amount"], ["k"])


def _quick_stats(s, d):
    """All tables of the quick statistics as rows ``(part, field, label, number)``."""
    df, dictionary = _profiled(s, d)
    out = quickstats.quick_stats(df, dictionary, 4, places=3)
    parts = [
        out["top"].select(F.lit("top").alias("part"), "field", F.col("value").alias("label"), F.col("cnt").cast("double").alias("number")),
        out["nulls"].select(F.lit("nulls").alias("part"), "field", F.lit(None).cast("string").alias("label"), F.col("null_count").cast("double").alias("number")),
    ]
    for name in ("min", "max", "sum", "mean", "median"):
        parts.append(out["num"].select(F.lit("num").alias("part"), "field", F.lit(name).alias("label"), F.col(name).alias("number")))
    return reduce(DataFrame.unionByName, parts)


def _quick_stats_sql() -> str:
    top = {"status": "status", "day": "strftime(day, '%Y%m%d')", "k": "CAST(k AS VARCHAR)"}
    numbers = union(
        f"SELECT 'num' AS part, 'amount' AS field, '{n}' AS label, ROUND({f}(amount), 3) AS number FROM {SOURCE}"
        for n, f in [("min", "MIN"), ("max", "MAX"), ("sum", "SUM"), ("mean", "AVG"), ("median", "MEDIAN")]
    )
    nulls = union(
        f"SELECT 'nulls', '{c}', NULL, CAST(COUNT(*) - COUNT({c}) AS DOUBLE) FROM {SOURCE}" for c in ("k", "status", "amount", "day")
    )
    return f"{numbers}\nUNION ALL\n{nulls}\nUNION ALL\nSELECT 'top', field, value, CAST(cnt AS DOUBLE) FROM ({top_sql(SOURCE, top, 4)})"


def _emails(s, d):
    """Fifteen text columns, each an address on every second customer."""
    key = F.col("c_custkey")
    cells = [F.when((key + i) % 2 == 0, F.concat(F.lit(f"a{i}."), key.cast("string"), F.lit("@b.org"))).otherwise("none").alias(f"t{i}") for i in range(15)]
    return table(s, d, "customer").select(*cells)


EMAILS = "(SELECT " + ", ".join(f"CASE WHEN (c_custkey + {i}) % 2 = 0 THEN 'a{i}.' || c_custkey || '@b.org' ELSE 'none' END AS t{i}" for i in range(15)) + " FROM customer) AS emails"


def _emails_report(s, d):
    df = _emails(s, d)
    return report.report_of(df, Dictionary.of(df, (), ())).select("row_count", "text_fields", "pattern_hits")


def _pivot(s, d):
    df = dirty(s, d)
    return comparable(pivot(df, ["status"], [], ["written"]), ["status"])


def _drill_null(s, d):
    df = dirty(s, d).select("k", "status", "amount")
    return df.filter(filters.drill_filter(df, DrillSpec("bar", ["status"]), None))


def _sorted(s, d):
    """Places in the order of a result, over all rows: numbers in text, no numbers last."""
    df = dirty(s, d).select("k", "written")
    return grid.with_places(df, grid.result_order(df, [("written", False)], ["k"], ["written"]), scratch_folder(s))


def _bad_cells(s, d):
    """A file with cells that are not of their type: typed, counted, and their text kept."""
    path = scratch_folder(s) + "/dirty"
    df = dirty(s, d).select("k", "written", F.col("day").cast("string").alias("day"))
    export_csv(df, path, Dictionary.of(df, (), ["k"]))
    fields = (Field("k", "Num", "M"), Field("written", "Num", "M"), Field("day", "Date", "D"))
    return read_dataset(s, path, Dictionary(fields, ())).bad_cells()


def _padded_roundtrip(s, d):
    """Outer blanks, quotes, delimiters and line breaks through a file, cell for cell."""
    text = F.concat(F.lit('  "a",|'), F.col("o_orderpriority"), F.lit("\n b\t "))
    df = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, text).alias("t"))
    path, dictionary = scratch_folder(s) + "/padded", Dictionary.of(df, (), ["o_orderkey"])
    export_csv(df, path, dictionary)
    raw = read_dataset(s, path, dictionary, multiline=True).raw
    return raw.select(F.col("o_orderkey").cast("bigint"), "t")


def _empty_marks(s, d):
    """Raw lines of a written file: the empty text is quoted, NULL is not."""
    df = dirty(s, d).select("k", "status")
    path = scratch_folder(s) + "/marks"
    export_csv(df, path, Dictionary.of(df, (), ["k"]), header=False)
    return s.read.text(path).select(F.col("value").alias("line"))


def _lines(s, d):
    df = synthetic(s, d).select("LOAN_NBR", "END_DT", "ACTIVE", "NAME")
    path = scratch_folder(s) + "/synthetic"
    delimited_lines(df, "|").write.text(path)
    return s.read.text(path).select(F.col("value").alias("line"))


WRITTEN_FIELDS = ["LOAN_NBR", "STATE", "FEE", "END_DT", "METHOD", "ACTIVE", "NAME"]


def _written(s, d):
    """All lines of a synthetic file, its header too, as many rows as there are orders."""
    path = scratch_folder(s) + "/written"
    rules = [rule for rule in RULES if rule.name in WRITTEN_FIELDS]
    write_synthetic(s, rules, table(s, d, "orders").count(), path, seed=11)
    return s.read.text(path).select(F.col("value").alias("line"))


def _facts(s, d):
    facts = file_facts(s, f"{d}/orders.parquet")
    return facts.select(F.regexp_extract("file_name", r"\.([a-z]+)$", 1).alias("extension"), F.col("file_size") > 0, "format", "delimiter").toDF(
        "extension", "has_size", "format", "delimiter"
    )


def _sections(s, d):
    """The report's sections, the file's facts first."""
    df, dictionary = _customer(s, d)
    facts = file_facts(s, f"{d}/customer.parquet").select("format", "delimiter")
    return report.report_sections(rounded(report.report_of(df, dictionary), 3, "mean_std_pop"), facts)


def _sections_sql(fields, source: str) -> str:
    rows = [
        f"SELECT '{section}' AS section, '{m}' AS metric, CAST({m} AS VARCHAR) AS value FROM r"
        for section, metrics in report.SECTIONS.items()
        for m in metrics
    ]
    head = "SELECT 'file', 'format', 'Parquet (columnar binary)' UNION ALL SELECT 'file', 'delimiter', 'Comma'"
    return f"WITH r AS ({report_sql(source, fields)})\n{union(rows)}\nUNION ALL {head}"


def _whole_profile(s, d):
    """Fields of a full profile beside how much its distributions hold."""
    df, dictionary = _orders(s, d)
    full = profile.profile_dataset(df, dictionary, bins=20, top=5)
    held = full.distributions.groupBy("field").agg(
        F.sum(F.when(F.col("kind") == "total", F.col("cnt"))).alias("total"),
        F.sum(F.when(F.col("kind") != "total", F.col("cnt"))).alias("parts"),
    )
    return full.fields.select("field", "role", "row_count", "distinct_count").join(held, "field")


def _long(s, d):
    return rounded(pivot_long(table(s, d, "orders"), ["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"]), 2, "o_totalprice")


ORDER_ROLES = {"o_totalprice": "M"}
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

CASES = {
    "quick_stats": (_quick_stats, _quick_stats_sql()),
    "profile_dirty": (lambda s, d: profile_table(*_profiled(s, d)), profile_sql(SOURCE, FIELDS)),
    "profile_base_dirty": (
        lambda s, d: profile.base_metrics(dirty(s, d), ["status", "amount"]),
        base_sql(SOURCE, {"status": "text", "amount": "number"}),
    ),
    "quick_num_not_finite": (
        lambda s, d: quickstats.quick_num(dirty(s, d), ["wild"]).select("field", "null_count", "min", "max"),
        f"SELECT 'wild' AS field, COUNT(*) - COUNT(wild) AS null_count, MIN(wild) AS min, MAX(wild) AS max "
        f"FROM {SOURCE}",
    ),
    "value_distribution_dirty": (
        lambda s, d: distribution.value_distribution(dirty(s, d), ["status", "written"], 3),
        value_distribution_sql(SOURCE, {"status": "status", "written": "written"}, 3),
    ),
    "bin_distribution_dirty": (
        lambda s, d: rounded(distribution.bin_distribution(dirty(s, d), ["amount", "written"], 40, 7), 6, "lo", "hi"),
        union([labelled_bins_sql(SOURCE, "amount", 40, 7), labelled_bins_sql(NUMBERS, "written", 40, 7)]),
    ),
    "histogram_dirty": (
        lambda s, d: rounded(distribution.histogram(dirty(s, d), ["written"], 10), 6, "lo", "hi"),
        histogram_sql(NUMBERS, "written", 10),
    ),
    "iqr_outliers_dirty": (
        lambda s, d: rounded(quality.iqr_outliers(dirty(s, d), ["amount", "written"]), 6, "outlier_pct"),
        "SELECT field, outlier_count, ROUND(outlier_pct, 6) AS outlier_pct FROM ("
        + union([outlier_sql(SOURCE, "amount"), outlier_sql(NUMBERS, "written")]) + ")",
    ),
    "duplicate_rows_dirty": (
        lambda s, d: quality.duplicate_rows(dirty(s, d), ["status", "written"]),
        duplicate_sql(SOURCE, "status, written"),
    ),
    "pivot_dirty": (
        _pivot,
        pivot_sql(SOURCE, {"status": "status"}, "'Total'", {"Total": "{m}"}, {"written": WRITTEN}),
    ),
    "drill_null": (_drill_null, f"SELECT k, status, amount FROM {SOURCE} WHERE status IS NULL"),
    "sort_result_dirty": (
        _sorted,
        f"""SELECT k, written, ROW_NUMBER() OVER (ORDER BY {WRITTEN} DESC NULLS LAST, lower(CAST(k AS VARCHAR))) AS place
FROM {SOURCE}""",
    ),
    "pattern_scan_wide": (lambda s, d: quality.pattern_scan(_emails(s, d)), pattern_sql(EMAILS, [f"t{i}" for i in range(15)])),
    "dataset_report_wide": (
        _emails_report,
        f"SELECT (SELECT COUNT(*) FROM customer) AS row_count, 15 AS text_fields, CAST(SUM(hits) AS BIGINT) AS pattern_hits "
        f"FROM ({pattern_sql(EMAILS, [f't{i}' for i in range(15)])})",
    ),
    "read_bad_cells": (
        _bad_cells,
        f"""SELECT 'k' AS field, COUNT(*) AS row_count, 0 AS null_count, 0 AS bad_count FROM {SOURCE}
UNION ALL SELECT 'written', COUNT(*), COUNT(*) FILTER (WHERE written IS NULL OR written = ''), COUNT(*) FILTER (WHERE written = 'abc') FROM {SOURCE}
UNION ALL SELECT 'day', COUNT(*), 0, 0 FROM {SOURCE}""",
    ),
    "export_padded": (
        _padded_roundtrip,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN '  \"a\",|' || o_orderpriority || chr(10) || ' b' || chr(9) || ' ' END AS t FROM orders",
    ),
    "export_empty_marks": (
        _empty_marks,
        f"""SELECT k || ',' || CASE WHEN status IS NULL THEN '' WHEN status = '' THEN '""' ELSE status END AS line FROM {SOURCE}""",
    ),
    "export_synthetic": (
        _lines,
        """SELECT lpad(CAST(o_orderkey + 1 AS VARCHAR), 9, '0') || '|9999-12-31 00:00:00|A|NAME_' || (o_orderkey + 1) AS line FROM orders""",
    ),
    "write_synthetic": (
        _written,
        f"""WITH o AS (SELECT range AS o_orderkey FROM range((SELECT COUNT(*) FROM orders))),
u AS (SELECT o_orderkey AS id, {draw_sql('STATE')} AS s, {draw_sql('FEE')} AS f, {draw_sql('METHOD')} AS m FROM o)
SELECT '{"|".join(WRITTEN_FIELDS)}' AS line UNION ALL
SELECT concat_ws('|', lpad(CAST(id + 1 AS VARCHAR), 9, '0'), list_extract({STATES!r}, CAST(floor(s * {len(STATES)}) AS INTEGER) + 1),
  CAST(CAST(round_even(2.0 + f * 99997.0, 0) AS BIGINT) AS VARCHAR), '9999-12-31 00:00:00',
  list_extract(['Cash', 'Card', 'Wire'], CAST(floor(m * 3) AS INTEGER) + 1), 'A', 'NAME_' || (id + 1)) FROM u""",
    ),
    "file_facts": (
        _facts,
        "SELECT 'parquet' AS extension, TRUE AS has_size, 'Parquet (columnar binary)' AS format, 'Comma' AS delimiter",
    ),
    "profile_dataset": (
        _whole_profile,
        union(
            f"SELECT '{c}' AS field, '{ORDER_ROLES.get(c, 'D')}' AS role, COUNT(*) AS row_count, COUNT(DISTINCT {c}) AS distinct_count, "
            f"COUNT(*) AS total, COUNT(*) AS parts FROM orders"
            for c in ORDER_COLUMNS
        ),
    ),
    "pivot_long": (
        _long,
        """WITH leaf AS (SELECT o_orderpriority AS p, o_orderstatus AS k, SUM(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT p AS o_orderpriority, k AS o_orderstatus, ROUND(SUM(v), 2) AS o_totalprice, CAST(1 - GROUPING(p) AS INTEGER) AS row_depth
FROM leaf GROUP BY GROUPING SETS ((p, k), (k))""",
    ),
    "report_sections": (_sections, _sections_sql(CUSTOMER_FIELDS, "customer")),
}
