"""Named queries on charts, filters, drilling and row views, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.columns import qcol, type_of
from ..operators import charts, filters, grid
from ..operators.filters import DrillSpec, FilterSpec, RangeSpec
from ..sources.dictionary import Dictionary
from ..sources.export import formatted
from .scratch import scratch_folder
from .stats_cases import rounded, table

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_ORDER = ", ".join(f"{k} ASC NULLS LAST" for k in LINE_KEYS)


def _where(name: str, condition):
    """Query that keeps the rows of a table that meet a condition built from it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.filter(condition(df))

    return query


# -- SQL pieces ---------------------------------------------------------------------------


def edges_sql(source: str, column: str, bins: int = 10) -> str:
    """``(i, lo, hi)`` of the chart histogram's bins."""
    return f"""SELECT i, mn + i * ((mx - mn) / {bins}.0) AS lo,
  CASE WHEN i = {bins - 1} THEN mx ELSE mn + (i + 1) * ((mx - mn) / {bins}.0) END AS hi
FROM (SELECT MIN({column}) AS mn, MAX({column}) AS mx FROM {source}),
  (SELECT CAST(range AS INTEGER) AS i FROM range({bins}))"""


def chart_histogram_sql(source: str, column: str) -> str:
    return f"""WITH e AS ({edges_sql(source, column)})
SELECT i AS bin_idx, COUNT(*) AS cnt, ROUND(lo, 6) AS bin_min, ROUND(hi, 6) AS bin_max
FROM {source} JOIN e ON {column} >= lo AND ({column} < hi OR (i = 9 AND {column} <= hi)) GROUP BY i, lo, hi"""


# -- drilling -------------------------------------------------------------------------------


def _drill_one(spark, d):
    df = table(spark, d, "orders")
    top = charts.chart_pie(df, ["o_orderpriority"], ["o_totalprice"]).first()
    return df.filter(filters.drill_filter(df, DrillSpec("pie", ["o_orderpriority"]), top["o_orderpriority"]))


def _drill_two(spark, d):
    df = table(spark, d, "orders")
    dims = ["o_orderstatus", "o_orderpriority"]
    first = charts.chart_stacked(df, dims, ["o_totalprice"]).first()
    return df.filter(filters.drill_filter(df, DrillSpec("stacked_bar", dims), *[first[x] for x in dims]))


def _drill_bin(closed: str):
    def query(spark, d):
        df = table(spark, d, "lineitem")
        bar = charts.chart_histogram(df, "l_quantity").filter("bin_idx = 3").first()
        spec = DrillSpec("histogram", measure="l_quantity", closed=closed)
        return df.filter(filters.drill_filter(df, spec, bar["bin_min"], bar["bin_max"]))

    return query


def _drill_result(spark, d):
    result = charts.chart_sum(table(spark, d, "part"), ["p_brand"], ["p_retailprice"])
    out = filters.drill_result(result, DrillSpec("bar", ["p_brand"]), "  bRAND#13 ")
    return rounded(out, 2, "p_retailprice")


def _drill_result_number(spark, d):
    result = charts.chart_stacked(table(spark, d, "part"), ["p_size", "p_type"], ["p_retailprice"])
    out = filters.drill_result(result, DrillSpec("stacked_bar", ["p_size", "p_type"]), "7.0", "economy")
    return rounded(out, 2, "agg_value")


def _drill_result_bin(spark, d):
    result = charts.chart_histogram(table(spark, d, "orders"), "o_totalprice")
    out = filters.drill_result(result, DrillSpec("histogram", measure="o_totalprice"), 4)
    return rounded(out, 6, "bin_min", "bin_max")


def _filter_result(spark, d):
    result = charts.chart_sum(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity"])
    return filters.filter_result(result, {"l_suppkey": "1", "l_quantity": "100 - 16000"}, measures=["l_quantity"])


def _sort_result(spark, d):
    result = charts.chart_sum(table(spark, d, "lineitem"), ["l_partkey"], ["l_quantity"])
    return grid.with_places(
        result, grid.result_order(result, [("l_quantity", False)], ["l_partkey"], ["l_quantity"]), scratch_folder(spark)
    )


def _combined(spark, d):
    df = table(spark, d, "customer")
    dictionary = Dictionary.of(df, ["c_acctbal"], ["c_custkey"])
    spec = FilterSpec(
        choices={"c_mktsegment": ["BUILDING", "FURNITURE"]},
        ranges={"c_acctbal": [RangeSpec(-100.0, 4000.0), RangeSpec(9000.0, 10000.0, True)]},
        typed={"c_acctbal": "0 to 9500", "c_name": "customer#0"},
    )
    return df.filter(spec.column(df, dictionary))


def _chart_mode(spark, d):
    df = table(spark, d, "customer")
    chart = filters.drill_filter(df, DrillSpec("bar", ["c_nationkey"]), 7)
    spec = FilterSpec(choices={"c_mktsegment": ["BUILDING"]}).with_chart(chart)
    return df.filter(spec.column(df))


def _range_column(spark, d):
    joints = F.array(F.lit("-"), F.lit(" and "), F.lit(".."), F.lit(" TO "), F.lit(" or "))
    text = F.concat(
        F.col("o_custkey").cast("string"),
        F.element_at(joints, F.pmod("o_orderkey", F.lit(5)).cast("int") + 1),
        F.col("o_orderkey").cast("string"),
    )
    bounds = table(spark, d, "orders").select("o_orderkey", filters.range_bounds(text).alias("b"))
    return bounds.select("o_orderkey", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


# -- row views --------------------------------------------------------------------------------


def _page(index: int, size: int = 100, **more):
    def query(spark, d):
        df = table(spark, d, "lineitem")
        return grid.page(df, [("l_shipdate", False)], LINE_KEYS, index, size, **more)

    return query


def _rank_index(spark, d):
    """Pages near the front, deep and last of an order that was written once, with their places."""
    index = grid.RankIndex.write(table(spark, d, "lineitem"), scratch_folder(spark), [("l_shipdate", False)], LINE_KEYS)
    pages = reduce(DataFrame.unionAll, [index.page(i, 100) for i in (3, 250, 10**9)])
    return pages.withColumnRenamed("__place", "place").distinct()


def _filtered_page(spark, d):
    df = table(spark, d, "lineitem")
    return grid.page(
        df, [("l_returnflag", False)], LINE_KEYS, 3, 50,
        condition=filters.where_in(df, {"l_linestatus": ["F"]}),
        columns=["l_returnflag", "l_linestatus", *LINE_KEYS],
    )


def _last_page(spark, d):
    return grid.page(table(spark, d, "customer"), keys=["c_custkey"], index=10**6, size=70)


def _next_page(spark, d):
    df = table(spark, d, "lineitem")
    last = grid.page(df, [("l_returnflag", False)], LINE_KEYS, 0, 100).collect()[-1].asDict()
    return grid.next_page(df, last, [("l_returnflag", False)], LINE_KEYS, 100)


def _all_pages(spark, d):
    """Four pages in an order with many ties, narrowed by sampled rows; together they are the table."""
    df = table(spark, d, "customer")
    total = df.count()
    size = -(-total // 4)
    pages = [grid.page(df, [("c_mktsegment", False)], index=i, size=size, total=total, ranked_rows=100) for i in range(4)]
    return reduce(DataFrame.unionAll, pages)


def _project(sort_names: bool):
    def query(spark, d):
        df = table(spark, d, "customer")
        dictionary = Dictionary.of(df, ["c_acctbal"], ["c_custkey"])
        return grid.project(df, dictionary, ["c_name", "c_acctbal"], sort_names)

    return query


def _formats(spark, d):
    df = table(spark, d, "orders")
    cell = lambda f, n, *a: f(qcol(n), type_of(df, n), *a)
    return df.select(
        "o_orderkey",
        cell(formats.yyyymmdd, "o_orderdate").alias("day"),
        cell(formats.fmt_measure, "o_totalprice", 2).alias("price"),
        cell(formats.fmt_measure, "o_totalprice", 0).alias("price_whole"),
        cell(formats.fmt_dimension, "o_totalprice").alias("price_dim"),
        cell(formats.fmt_dimension, "o_custkey").alias("custkey_dim"),
        cell(formats.fmt_dimension, "o_orderpriority").alias("priority_dim"),
    )


def _text_days(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("bigint").alias("whole"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("double").alias("real"),
        "o_orderpriority",
    )
    names = ["iso", "whole", "real", "o_orderpriority"]
    return df.select("o_orderkey", *[formats.yyyymmdd(qcol(n), type_of(df, n)).alias(n) for n in names])


def _formatted(spark, d):
    df = table(spark, d, "customer")
    return formatted(df, Dictionary.of(df, ["c_acctbal"], ["c_custkey"]), 1)


CASES = {
    "chart_sum": (
        lambda s, d: rounded(
            charts.chart_sum(table(s, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"]),
            2, "l_extendedprice",
        ),
        "SELECT l_returnflag, SUM(l_quantity) AS l_quantity, ROUND(SUM(l_extendedprice), 2) AS l_extendedprice "
        "FROM lineitem GROUP BY 1",
    ),
    "chart_avg": (
        lambda s, d: rounded(
            charts.chart_avg(table(s, d, "orders"), ["o_orderpriority"], ["o_totalprice"]), 4, "o_totalprice"
        ),
        "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1",
    ),
    "chart_pie": (
        lambda s, d: rounded(
            charts.chart_pie(table(s, d, "orders"), ["o_orderstatus"], ["o_totalprice"]), 2, "o_totalprice"
        ),
        "SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1",
    ),
    "chart_stacked": (
        lambda s, d: rounded(
            charts.chart_stacked(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]),
            2, "agg_value",
        ),
        "SELECT o_orderstatus, o_orderpriority, ROUND(SUM(o_totalprice), 2) AS agg_value FROM orders GROUP BY 1, 2",
    ),
    "chart_histogram": (
        lambda s, d: rounded(
            charts.chart_histogram(table(s, d, "orders"), "o_totalprice"), 6, "bin_min", "bin_max"
        ),
        chart_histogram_sql("orders", "o_totalprice"),
    ),
    "chart_histogram_quantity": (
        lambda s, d: rounded(
            charts.chart_histogram(table(s, d, "lineitem"), "l_quantity"), 6, "bin_min", "bin_max"
        ),
        chart_histogram_sql("lineitem", "l_quantity"),
    ),
    "where_in": (
        _where("customer", lambda df: filters.where_in(
            df, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": ["1", "2", "24"]})),
        "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 24)",
    ),
    "where_ranges": (
        _where("lineitem", lambda df: filters.where_ranges(df, {
            "l_extendedprice": [RangeSpec(1000.0, 20000.0), RangeSpec(90000.0, 104997.88, True)],
            "l_quantity": [RangeSpec(1.0, 25.0)]})),
        "SELECT * FROM lineitem WHERE ((l_extendedprice >= 1000 AND l_extendedprice < 20000) OR "
        "(l_extendedprice >= 90000 AND l_extendedprice <= 104997.88)) AND l_quantity >= 1 AND l_quantity < 25",
    ),
    "where_contains": (
        _where("part", lambda df: filters.where_contains(df, "p_name", "WIDGET")),
        "SELECT * FROM part WHERE instr(lower(p_name), lower('WIDGET')) > 0",
    ),
    "where_contains_number": (
        _where("orders", lambda df: filters.where_contains(df, "o_totalprice", "99.9")),
        "SELECT * FROM orders WHERE instr(lower(CAST(o_totalprice AS VARCHAR)), '99.9') > 0",
    ),
    "where_contains_text": (
        lambda s, d: _where("documents", lambda df: filters.where_contains(df, "text", "The "))(s, d).select(
            "doc_id", "lang", "n_chars"
        ),
        "SELECT doc_id, lang, n_chars FROM documents WHERE instr(lower(text), lower('The ')) > 0",
    ),
    "where_range_text": (
        _where("lineitem", lambda df: filters.where_range_text(df, "l_extendedprice", "  40000 and 1e4 ")),
        "SELECT * FROM lineitem WHERE l_extendedprice BETWEEN 10000 AND 40000",
    ),
    "range_text_column": (
        _range_column,
        """SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 < 4 THEN CAST(LEAST(o_custkey, o_orderkey) AS DOUBLE) END AS lo,
  CASE WHEN o_orderkey % 5 < 4 THEN CAST(GREATEST(o_custkey, o_orderkey) AS DOUBLE) END AS hi FROM orders""",
    ),
    "combined_filter": (
        _combined,
        """SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')
  AND ((c_acctbal >= -100 AND c_acctbal < 4000) OR (c_acctbal >= 9000 AND c_acctbal <= 10000))
  AND c_acctbal BETWEEN 0 AND 9500 AND instr(lower(c_name), 'customer#0') > 0""",
    ),
    "chart_overrides_panel": (_chart_mode, "SELECT * FROM customer WHERE c_nationkey = 7"),
    "measure_ranges": (
        lambda s, d: rounded(filters.measure_ranges(table(s, d, "customer"), "c_acctbal"), 6, "start", "end"),
        """SELECT i AS ord, ROUND(mn + i * step, 6) AS start,
  ROUND(CASE WHEN i = 9 THEN mx ELSE mn + (i + 1) * step END, 6) AS "end", i = 9 AS include_end,
  'between ' || format('{:,.2f}', mn + i * step) || ' and '
    || format('{:,.2f}', CASE WHEN i = 9 THEN mx ELSE mn + (i + 1) * step END) AS label
FROM (SELECT mn, mx, (mx - mn) / 10.0 AS step FROM
  (SELECT MIN(c_acctbal) AS mn, MAX(c_acctbal) AS mx FROM customer)),
  (SELECT CAST(range AS INTEGER) AS i FROM range(10))""",
    ),
    "distinct_values": (
        lambda s, d: filters.distinct_values(table(s, d, "customer"), "c_mktsegment"),
        "SELECT DISTINCT c_mktsegment AS value FROM customer",
    ),
    "distinct_values_search": (
        lambda s, d: filters.distinct_values(table(s, d, "orders"), "o_totalprice", contains="77"),
        "SELECT DISTINCT CAST(o_totalprice AS VARCHAR) AS value FROM orders "
        "WHERE CAST(o_totalprice AS VARCHAR) LIKE '%77%'",
    ),
    "drill_one": (
        _drill_one,
        """SELECT * FROM orders WHERE o_orderpriority = (SELECT o_orderpriority FROM orders GROUP BY 1
  ORDER BY SUM(o_totalprice) DESC LIMIT 1)""",
    ),
    "drill_two": (
        _drill_two,
        """SELECT * FROM orders WHERE o_orderstatus = (SELECT MIN(o_orderstatus) FROM orders)
  AND o_orderpriority = (SELECT MIN(o_orderpriority) FROM orders
    WHERE o_orderstatus = (SELECT MIN(o_orderstatus) FROM orders))""",
    ),
    "drill_bin": (
        _drill_bin("both"),
        f"""SELECT l.* FROM lineitem l, ({edges_sql('lineitem', 'l_quantity')}) e
WHERE i = 3 AND l_quantity >= lo AND l_quantity <= hi""",
    ),
    "drill_bin_half_open": (
        _drill_bin("bin"),
        f"""SELECT l.* FROM lineitem l, ({edges_sql('lineitem', 'l_quantity')}) e
WHERE i = 3 AND l_quantity >= lo AND l_quantity < hi""",
    ),
    "drill_result": (
        _drill_result,
        "SELECT p_brand, ROUND(SUM(p_retailprice), 2) AS p_retailprice FROM part "
        "WHERE lower(p_brand) = 'brand#13' GROUP BY 1",
    ),
    "drill_result_number": (
        _drill_result_number,
        "SELECT p_size, p_type, ROUND(SUM(p_retailprice), 2) AS agg_value FROM part "
        "WHERE p_size = 7 AND lower(p_type) = 'economy' GROUP BY 1, 2",
    ),
    "drill_result_bin": (
        _drill_result_bin,
        f"SELECT * FROM ({chart_histogram_sql('orders', 'o_totalprice')}) WHERE bin_idx = 4",
    ),
    "filter_result": (
        _filter_result,
        """SELECT l_suppkey, l_quantity FROM (SELECT l_suppkey, SUM(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)
WHERE instr(CAST(l_suppkey AS VARCHAR), '1') > 0 AND l_quantity BETWEEN 100 AND 16000""",
    ),
    "sort_result": (
        _sort_result,
        """SELECT *, ROW_NUMBER() OVER (ORDER BY l_quantity DESC NULLS LAST, lower(CAST(l_partkey AS VARCHAR))) AS place
FROM (SELECT l_partkey, SUM(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)""",
    ),
    "grid_rank_index": (
        _rank_index,
        f"""SELECT *, ROW_NUMBER() OVER (ORDER BY l_shipdate DESC NULLS LAST, {LINE_ORDER}) - 1 AS place FROM lineitem
QUALIFY place BETWEEN 300 AND 399 OR place BETWEEN (SELECT ((COUNT(*) - 1) // 100) * 100 FROM lineitem) AND (SELECT COUNT(*) FROM lineitem)
  OR place // 100 = (SELECT LEAST(25000, ((COUNT(*) - 1) // 100) * 100) // 100 FROM lineitem)""",
    ),
    "grid_page": (
        _page(3),
        f"SELECT * FROM lineitem ORDER BY l_shipdate DESC NULLS LAST, {LINE_ORDER} LIMIT 100 OFFSET 300",
    ),
    "grid_page_deep": (
        _page(250, ranked_rows=10_000),
        f"""SELECT * FROM lineitem ORDER BY l_shipdate DESC NULLS LAST, {LINE_ORDER} LIMIT 100
OFFSET (SELECT LEAST(25000, ((COUNT(*) - 1) // 100) * 100) FROM lineitem)""",
    ),
    "grid_page_filtered": (
        _filtered_page,
        f"""SELECT l_returnflag, l_linestatus, {', '.join(LINE_KEYS)} FROM lineitem WHERE l_linestatus = 'F'
ORDER BY l_returnflag DESC NULLS LAST, {LINE_ORDER} LIMIT 50 OFFSET 150""",
    ),
    "grid_chart_page": (
        lambda s, d: grid.page(
            charts.chart_sum(table(s, d, "lineitem"), ["l_partkey"], ["l_quantity"]), [("l_quantity", False)], ["l_partkey"], 1, 40
        ),
        """SELECT l_partkey, SUM(l_quantity) AS l_quantity FROM lineitem GROUP BY 1
ORDER BY l_quantity DESC NULLS LAST, l_partkey LIMIT 40 OFFSET 40""",
    ),
    "grid_last_page": (
        _last_page,
        """SELECT * FROM customer ORDER BY c_custkey LIMIT 70
OFFSET (SELECT ((COUNT(*) - 1) // 70) * 70 FROM customer)""",
    ),
    "grid_next_page": (
        _next_page,
        f"SELECT * FROM lineitem ORDER BY l_returnflag DESC NULLS LAST, {LINE_ORDER} LIMIT 100 OFFSET 100",
    ),
    "grid_all_pages": (_all_pages, "SELECT * FROM customer"),
    "project": (_project(False), "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "project_by_name": (_project(True), "SELECT c_acctbal, c_custkey, c_name FROM customer"),
    "row_count": (
        lambda s, d: grid.row_count(table(s, d, "lineitem")), "SELECT COUNT(*) AS row_count FROM lineitem"
    ),
    "row_count_filtered": (
        lambda s, d: grid.row_count(table(s, d, "lineitem"), F.col("l_quantity") > 25),
        "SELECT COUNT(*) AS row_count FROM lineitem WHERE l_quantity > 25",
    ),
    "cell_formats": (
        _formats,
        """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, format('{:,.2f}', o_totalprice) AS price,
  format('{:,.0f}', o_totalprice) AS price_whole,
  regexp_replace(format('{:.4f}', o_totalprice), '\\.?0+$', '') AS price_dim,
  CAST(o_custkey AS VARCHAR) AS custkey_dim, o_orderpriority AS priority_dim FROM orders""",
    ),
    "yyyymmdd_of_text": (
        _text_days,
        """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS iso, strftime(o_orderdate, '%Y%m%d') AS whole,
  strftime(o_orderdate, '%Y%m%d') AS real, o_orderpriority FROM orders""",
    ),
    "formatted_rows": (
        _formatted,
        """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  format('{:,.1f}', c_acctbal) AS c_acctbal, c_mktsegment FROM customer""",
    ),
}
