"""Named queries on dictionaries, synthetic rows, files in and out, each with its SQL.

Dictionaries and rules are small by nature, so these queries derive their input from
the rows of a table: their work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import COUNTIES, OTHER_COUNTIES, STATES, ColumnRule, synthesize
from ..operators.grid import page
from ..operators.pivot import pivot
from ..sources import dictionary as meta
from ..sources.delimited import read_dataset
from ..sources.dictionary import Dictionary
from ..sources.export import export_csv, export_pivot, export_tsv, formatted, formatted_pivot
from .scratch import scratch_folder
from .stats_cases import table


def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dictionary line per part: a key list that runs into its first of two records.

    Every seventh line names a key that is no field, every eleventh repeats a field.
    """
    key = F.col("p_partkey")
    name = F.concat(F.lit("F"), key.cast("string"))
    keys = F.when(key % 7 == 0, F.concat(name, F.lit(",GHOST"))).otherwise(name)
    second = F.when(key % 11 == 0, name).otherwise("QTY")
    line = F.concat(
        keys, F.lit("|"), name, F.lit("|Char|"), F.col("p_size").cast("string"), F.lit("|"), "p_name",
        F.lit("|D,"), second, F.lit("|Num||"), F.regexp_replace("p_brand", "#", " "), F.lit("|M"),
    )
    return table(spark, sf_dir, "part").select(key.cast("string").alias("source"), line.alias("line"))


def _dictionary_text(spark, d):
    return meta.parse_lines(dictionary_lines(spark, d))


def _validate(spark, d):
    return meta.validate_dictionary(meta.parse_lines(dictionary_lines(spark, d)))


def _roles(spark, d):
    """Role flags of one field per customer, its type taken from the customer's data."""
    kinds = ["Char", "Num", "YYYYMMDD", "DISPLAY", "D", "M", "Date", "Money"]
    df = table(spark, d, "customer").select(
        F.col("c_name").alias("name"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), F.pmod("c_custkey", F.lit(8)).cast("int") + 1).alias("field_type"),
        F.when(F.col("c_acctbal") > 0, "M").otherwise("D").alias("role"),
    )
    return meta.roles(df)


def _dictionary_table(spark, d):
    """A dictionary table with one row per part, in shuffled spellings of the headers."""
    df = table(spark, d, "part").select(
        F.col("p_type").alias("FieldType"),
        F.when(F.col("p_size") % 2 == 0, "number").otherwise(" dim ").alias("Data Type"),
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("Field_Length"),
        F.when(F.col("p_partkey") % 3 == 0, "yes").otherwise("N").alias("Primary Key"),
        F.when(F.col("p_size") < 10, " ").otherwise(F.col("p_name")).alias("description"),
        F.concat(F.lit(" C"), F.col("p_partkey").cast("string")).alias("Field Name"),
    )
    return meta.read_dictionary_table(df).drop("ord")


def _generator_spec(spark, d):
    df = table(spark, d, "part").select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("Field Name"),
        F.lit("Num").alias("Datatype"),
        F.col("p_size").cast("double").alias("Field Length"),
        F.concat(F.lit(">"), F.col("p_size").cast("string")).alias("RULES"),
    )
    return meta.read_generator_spec(df).drop("ord")


RULES = [
    ColumnRule("LOAN_NBR", "Char", 9, "Unique Number"),
    ColumnRule("STATE", "Char", 2, "US states only"),
    ColumnRule("COUNTY", "Char", 40, "Counties of the STATE"),
    ColumnRule("LOAN_AMT", "Num", None, ">100 and <10000"),
    ColumnRule("UPB", "Num", None, ">100 and <10000 and <loan_amt"),
    ColumnRule("FEE", "Num", None, ""),
    ColumnRule("TXN_DT", "Datetime", None, "Any datetime in the month"),
    ColumnRule("BEG_DT", "Datetime", None, "Any datetime in the month < TXN_DT"),
    ColumnRule("END_DT", "Datetime", None, "9999-12-31 00:00:00"),
    ColumnRule("DUE_DT", "Date", None, "Last Date of the Month"),
    ColumnRule("PAY_DT", "Date", None, "Any date in the month"),
    ColumnRule("METHOD", "Char", 4, "Cash, Card, Wire transfer"),
    ColumnRule("ACTIVE", "Char", 1, "Active"),
    ColumnRule("NAME", "Char", 30, ""),
]


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic loan per order."""
    return synthesize(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), RULES, seed=11)


def _generate_checked(spark, d):
    """The fixed columns of the synthetic rows, and whether the drawn ones keep their rules."""
    number = lambda c: F.col(c).cast("bigint")
    texts = lambda names: F.array(*[F.lit(n) for n in names])
    counties = F.create_map(*[c for state, names in COUNTIES.items() for c in (F.lit(state), texts(names))])
    others = texts(OTHER_COUNTIES)
    return synthetic(spark, d).select(
        "LOAN_NBR",
        "END_DT",
        "ACTIVE",
        "NAME",
        F.col("STATE").isin(STATES).alias("state_ok"),
        F.array_contains(F.coalesce(F.try_element_at(counties, F.col("STATE")), others), F.col("COUNTY")).alias("county_ok"),
        ((number("LOAN_AMT") > 100) & (number("LOAN_AMT") < 10000)).alias("amount_ok"),
        ((number("UPB") > 100) & ((number("UPB") < number("LOAN_AMT")) | (number("LOAN_AMT") <= 102))).alias("upb_ok"),
        number("FEE").between(1, 100_000).alias("fee_ok"),
        ((F.col("BEG_DT") < F.col("TXN_DT")) | F.col("TXN_DT").endswith("-01 00:00:00")).alias("order_ok"),
        (F.substring("TXN_DT", 1, 7) == F.substring("PAY_DT", 1, 7)).alias("month_ok"),
        (F.last_day("DUE_DT") == F.to_date("DUE_DT")).alias("due_ok"),
        F.col("METHOD").isin("Cash", "Card", "Wire").alias("method_ok"),
    )


def _export_roundtrip(spark, d):
    df = table(spark, d, "orders")
    dictionary = Dictionary.of(df, ["o_totalprice"], ["o_orderkey"])
    path = scratch_folder(spark) + "/orders"
    export_csv(df, path, dictionary, F.col("o_orderstatus") == "F", [("o_totalprice", False)], sep="|")
    back = read_dataset(spark, path, dictionary, "|").df
    return back.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def _text_roundtrip(spark, d):
    """Texts with line breaks, quotes and delimiters survive the file."""
    df = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    dictionary = Dictionary.of(df, (), ["conv_id", "turn"])
    path = scratch_folder(spark) + "/texts"
    export_csv(df, path, dictionary)
    back = read_dataset(spark, path, dictionary, multiline=True).df
    return back.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")


def _pivot_roundtrip(spark, d):
    dims = ["o_orderpriority"]
    out = pivot(table(spark, d, "orders"), dims, ["o_orderstatus"], ["o_totalprice"])
    path = scratch_folder(spark) + "/pivot"
    export_pivot(out, path, dims)
    return spark.read.csv(path, header=True)


def _pivot_cells(spark, d):
    dims = ["l_returnflag", "l_linestatus"]
    return formatted_pivot(pivot(table(spark, d, "lineitem"), dims, [], ["l_quantity"]), dims)


def _page_roundtrip(spark, d):
    df = table(spark, d, "customer")
    dictionary = Dictionary.of(df, ["c_acctbal"], ["c_custkey"])
    path = scratch_folder(spark) + "/page"
    export_tsv(page(df, [("c_acctbal", False)], ["c_custkey"], 1, 50), path, dictionary)
    return spark.read.csv(path, header=True, sep="\t")


def _typed_roundtrip(spark, d):
    """Synthetic rows written, then read with a dictionary: codes keep zeros, amounts are numbers."""
    path = scratch_folder(spark) + "/loans"
    synthetic(spark, d).select("LOAN_NBR", "END_DT", "ACTIVE", "NAME").write.csv(path, sep="|", header=True)
    fields = [
        meta.Field("LOAN_NBR", "Char", "D", "9"),
        meta.Field("END_DT", "Datetime", "D"),
        meta.Field("ACTIVE", "D", "D"),
        meta.Field("NAME", "Varchar", "D"),
    ]
    back = read_dataset(spark, path, Dictionary(tuple(fields), ("LOAN_NBR",)), "|").df
    return back.select("LOAN_NBR", F.date_format("END_DT", "yyyy-MM-dd HH:mm:ss").alias("END_DT"), "ACTIVE", "NAME")


def _formatted_lines(spark, d):
    df = table(spark, d, "lineitem")
    return formatted(df.select("l_orderkey", "l_extendedprice", "l_discount"), Dictionary.of(df, ["l_extendedprice"]))


NAME_SQL = "'F' || p_partkey"


def draw_sql(name: str, seed: int = 11) -> str:
    """The uniform draw of a column: 52 bits of an MD5."""
    return f"CAST('0x' || substr(md5(o_orderkey || '/{name}//{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0"


CASES = {
    "dictionary_text": (
        _dictionary_text,
        f"""SELECT CAST(p_partkey AS VARCHAR) AS source, 0 AS ord, {NAME_SQL} AS name, 'Char' AS field_type,
  CAST(p_size AS VARCHAR) AS field_length, p_name AS description, 'D' AS role, TRUE AS is_key, 1 AS key_ord FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, CASE WHEN p_partkey % 11 = 0 THEN {NAME_SQL} ELSE 'QTY' END, 'Num',
  NULL, replace(p_brand, '#', ' '), 'M', p_partkey % 11 = 0, CASE WHEN p_partkey % 11 = 0 THEN 1 END FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, 'GHOST', NULL, NULL, NULL, NULL, TRUE, NULL
  FROM part WHERE p_partkey % 7 = 0""",
    ),
    "validate_dictionary": (
        _validate,
        f"""SELECT CAST(p_partkey AS VARCHAR) AS source, 'key is not a field' AS problem, 'GHOST' AS detail
  FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'duplicate field name', {NAME_SQL} FROM part WHERE p_partkey % 11 = 0""",
    ),
    "dictionary_table": (
        _dictionary_table,
        """SELECT 'C' || p_partkey AS name, p_type AS field_type, CAST(p_size AS VARCHAR) AS field_length,
  CASE WHEN p_size < 10 THEN '' ELSE p_name END AS description,
  CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'D' END AS role, p_partkey % 3 = 0 AS is_key FROM part""",
    ),
    "roles": (
        _roles,
        """WITH f AS (SELECT c_name AS name,
  list_extract(['Char', 'Num', 'YYYYMMDD', 'DISPLAY', 'D', 'M', 'Date', 'Money'], c_custkey % 8 + 1) AS field_type,
  CASE WHEN c_acctbal > 0 THEN 'M' ELSE 'D' END AS role FROM customer)
SELECT name, field_type, role,
  field_type <> 'DISPLAY' AND (field_type = 'YYYYMMDD' OR role = 'D') AS is_dimension,
  field_type NOT IN ('DISPLAY', 'YYYYMMDD') AND role = 'M' AS is_measure,
  field_type <> 'YYYYMMDD' AND role = 'M' AS formats_as_measure,
  field_type IN ('YYYYMMDD', 'Date') AS shows_as_day,
  CASE WHEN field_type = 'DISPLAY' THEN 'skip' WHEN field_type IN ('YYYYMMDD', 'Date', 'D', 'Char') THEN 'char'
    ELSE 'num' END AS stats_bucket FROM f""",
    ),
    "generator_spec": (
        _generator_spec,
        """SELECT 'C' || p_partkey AS name, 'Num' AS data_type, p_size AS field_length, '>' || p_size AS rules,
  FALSE AS is_key FROM part""",
    ),
    "generate": (
        _generate_checked,
        """SELECT lpad(CAST(o_orderkey + 1 AS VARCHAR), 9, '0') AS "LOAN_NBR", '9999-12-31 00:00:00' AS "END_DT",
  'A' AS "ACTIVE", 'NAME_' || (o_orderkey + 1) AS "NAME", TRUE AS state_ok, TRUE AS county_ok, TRUE AS amount_ok,
  TRUE AS upb_ok, TRUE AS fee_ok, TRUE AS order_ok, TRUE AS month_ok, TRUE AS due_ok, TRUE AS method_ok FROM orders""",
    ),
    "generate_rows": (
        lambda s, d: synthetic(s, d).select("LOAN_NBR", "STATE", "FEE", "METHOD"),
        f"""WITH u AS (SELECT o_orderkey AS id, {draw_sql('STATE')} AS s, {draw_sql('FEE')} AS f, {draw_sql('METHOD')} AS m FROM orders)
SELECT lpad(CAST(id + 1 AS VARCHAR), 9, '0') AS "LOAN_NBR",
  list_extract({STATES!r}, CAST(floor(s * {len(STATES)}) AS INTEGER) + 1) AS "STATE",
  CAST(CAST(round_even(2.0 + f * 99997.0, 0) AS BIGINT) AS VARCHAR) AS "FEE",
  list_extract(['Cash', 'Card', 'Wire'], CAST(floor(m * 3) AS INTEGER) + 1) AS "METHOD" FROM u""",
    ),
    "export_roundtrip": (_export_roundtrip, "SELECT * FROM orders WHERE o_orderstatus = 'F'"),
    "export_texts": (_text_roundtrip, "SELECT conv_id, turn, role, text FROM conversations"),
    "export_pivot": (
        _pivot_roundtrip,
        """WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS k, SUM(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT CASE WHEN GROUPING(p) = 1 THEN 'Grand Total' ELSE p END AS o_orderpriority, """
        + ", ".join(
            f"""format('{{:,.2f}}', SUM(v) FILTER (WHERE k = '{k}')) AS "o_orderstatus-{k}\"""" for k in "FOP"
        )
        + """, format('{:,.2f}', SUM(v)) AS "GRAND TOTAL" FROM g GROUP BY ROLLUP (p)""",
    ),
    "pivot_cells": (
        _pivot_cells,
        """SELECT CASE WHEN GROUPING(l_returnflag) = 1 THEN '' ELSE l_returnflag END AS l_returnflag,
  CASE WHEN GROUPING(l_returnflag) = 1 THEN 'Grand Total' WHEN GROUPING(l_linestatus) = 1 THEN ''
    ELSE l_linestatus END AS l_linestatus,
  format('{:,.2f}', SUM(l_quantity)) AS l_quantity, format('{:,.2f}', SUM(l_quantity)) AS "GRAND TOTAL"
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    ),
    "export_page": (
        _page_roundtrip,
        """SELECT CAST(c_custkey AS VARCHAR) AS "C_CUSTKEY", c_name AS "C_NAME", CAST(c_nationkey AS VARCHAR) AS "C_NATIONKEY",
  format('{:,.2f}', c_acctbal) AS "C_ACCTBAL", c_mktsegment AS "C_MKTSEGMENT"
FROM (SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 50)""",
    ),
    "read_typed": (
        _typed_roundtrip,
        """SELECT lpad(CAST(o_orderkey + 1 AS VARCHAR), 9, '0') AS "LOAN_NBR", '9999-12-31 00:00:00' AS "END_DT",
  'A' AS "ACTIVE", 'NAME_' || (o_orderkey + 1) AS "NAME" FROM orders""",
    ),
    "formatted_lines": (
        _formatted_lines,
        """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, format('{:,.2f}', l_extendedprice) AS l_extendedprice,
  CASE WHEN l_discount = 0 THEN '0' ELSE regexp_replace(format('{:.4f}', l_discount), '\\.?0+$', '') END AS l_discount
FROM lineitem""",
    ),
}
