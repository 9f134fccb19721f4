"""Named queries on statistics and profiles, each with the SQL that gives the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import BOOLEAN_TOKENS
from ..operators import distribution, profile, quality, quickstats, report
from ..sources.dictionary import Dictionary
from ..sources.export import profile_digest

LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_DIMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Round the figures whose last digits depend on the order of addition."""
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


# -- SQL pieces ---------------------------------------------------------------------------


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def counts_sql(source: str, columns: dict[str, str], nulls: bool = False) -> str:
    """``(field, value, cnt)`` of some columns; the dict gives each column's value expression."""
    return union(
        f"SELECT '{c}' AS field, {e} AS value, {e} AS raw, COUNT(*) AS cnt FROM {source} "
        + ("" if nulls else f"WHERE {c} IS NOT NULL ")
        + "GROUP BY 2, 3"
        for c, e in columns.items()
    )


def top_sql(source: str, columns: dict[str, str], n: int) -> str:
    return f"""WITH c AS ({counts_sql(source, columns)}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field ORDER BY cnt DESC, raw) AS rn FROM c)
SELECT field, value, cnt, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= {n}"""


def number_sql(source: str, columns, places: int) -> str:
    return union(
        f"SELECT '{c}' AS field, COUNT(*) - COUNT({c}) AS null_count, MIN({c}) AS min, MAX({c}) AS max, "
        f"ROUND(SUM({c}), {places}) AS sum, ROUND(AVG({c}), {places}) AS mean, "
        f"ROUND(MEDIAN({c}), {places}) AS median FROM {source}"
        for c in columns
    )


def base_sql(source: str, columns: dict[str, str]) -> str:
    """Base metrics; the dict names each column's kind: text, number or time."""
    tokens = ", ".join(f"'{t}'" for t in BOOLEAN_TOKENS)
    return union(
        f"""SELECT '{c}' AS field, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count,
  COUNT(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '') AS empty_count,
  100.0 * (COUNT(*) - COUNT({c}) + COUNT(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '')) / COUNT(*) AS missing_pct,
  COUNT(DISTINCT {c}) AS distinct_count,
  100.0 * COUNT(DISTINCT {c}) / COUNT(*) AS unique_pct,
  COUNT(DISTINCT {c}) > GREATEST(50, CAST(FLOOR(0.2 * COUNT(*)) AS BIGINT)) AS is_high_cardinality,
  COUNT(*) FILTER (WHERE lower(trim(CAST({c} AS VARCHAR))) IN ({tokens})) / CAST(COUNT({c}) AS DOUBLE) AS boolean_ratio,
  COUNT(*) FILTER (WHERE {'FALSE' if kind == 'time' else f'try_cast({c} AS DOUBLE) IS NOT NULL'})
    / CAST(COUNT({c}) AS DOUBLE) AS numeric_ratio,
  COUNT(*) FILTER (WHERE try_cast(trim(CAST({c} AS VARCHAR)) AS TIMESTAMP) IS NOT NULL)
    / CAST(COUNT({c}) AS DOUBLE) AS timestamp_ratio
FROM {source}"""
        for c, kind in columns.items()
    )


def semantic_sql(role: str = "role", field_type: str = "meta_type") -> str:
    return f"""CASE WHEN distinct_count BETWEEN 1 AND 2 AND boolean_ratio >= 0.95 THEN 'boolean'
  WHEN {role} = 'D' AND timestamp_ratio >= 0.9 THEN 'datetime' WHEN {role} = 'D' THEN 'string'
  WHEN lower({field_type}) = 'char' AND numeric_ratio < 0.5 THEN 'mixed' ELSE 'numeric' END"""


def outlier_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS field,
  COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  100.0 * COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / COUNT(*) AS outlier_pct
FROM (SELECT {column} AS x, (SELECT quantile_cont({column}, 0.25) FROM {source}) AS q1,
  (SELECT quantile_cont({column}, 0.75) FROM {source}) AS q3 FROM {source}) WHERE x IS NOT NULL"""


def numeric_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS field, MIN({column}) AS num_min, MAX({column}) AS num_max,
  ROUND(AVG({column}), 4) AS num_mean, ROUND(MEDIAN({column}), 4) AS num_median,
  ROUND(stddev_pop({column}), 4) AS num_std_pop, ROUND(var_pop({column}), 2) AS num_var_pop FROM {source}"""


def duplicate_sql(source: str, columns: str) -> str:
    return f"""WITH g AS (SELECT COUNT(*) AS cnt FROM {source} GROUP BY {columns})
SELECT CAST(SUM(cnt) AS BIGINT) AS total_rows, COUNT(*) AS distinct_full_rows,
  CAST(SUM(cnt - 1) AS BIGINT) AS duplicate_extra_rows, 100.0 * CAST(SUM(cnt - 1) AS BIGINT) / CAST(SUM(cnt) AS BIGINT) AS duplicate_pct
FROM g"""


def key_sql(source: str, columns: str) -> str:
    return f"""WITH g AS (SELECT COUNT(*) AS cnt FROM {source} GROUP BY {columns})
SELECT CAST(SUM(cnt) AS BIGINT) AS total_rows, COUNT(*) AS distinct_keys,
  COUNT(*) FILTER (WHERE cnt > 1) AS duplicated_keys, CAST(SUM(cnt - 1) AS BIGINT) AS duplicate_extra_rows,
  100.0 * CAST(SUM(cnt - 1) AS BIGINT) / CAST(SUM(cnt) AS BIGINT) AS duplicate_pct FROM g"""


def value_distribution_sql(source: str, columns: dict[str, str], top: int) -> str:
    return f"""WITH c AS ({counts_sql(source, columns, nulls=True)}),
l AS (SELECT field, CASE WHEN value IS NULL THEN 'null' ELSE 'value' END AS kind,
  COALESCE(value, '(null)') AS label, cnt FROM c),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field ORDER BY cnt DESC, label) AS rn FROM l),
t AS (SELECT field, CAST(SUM(cnt) AS BIGINT) AS n,
  CAST(SUM(CASE WHEN rn > {top} THEN cnt ELSE 0 END) AS BIGINT) AS rest FROM r GROUP BY field)
SELECT field, kind, label, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, cnt, CAST(rn AS INTEGER) AS ord
FROM r WHERE rn <= {top}
UNION ALL SELECT field, 'others', 'Others', NULL, NULL, rest, {top + 1} FROM t WHERE rest > 0
UNION ALL SELECT field, 'total', 'Total', NULL, NULL, n, {top + 2} FROM t"""


def bins_sql(source: str, column: str, bins: int) -> str:
    """``(bin, cnt, mn, mx, nn, n)`` of one measure."""
    return f"""SELECT CASE WHEN mn = mx THEN 0 ELSE LEAST({bins - 1}, GREATEST(0,
    CAST(FLOOR((x - mn) / ((mx - mn) / {bins}.0)) AS INTEGER))) END AS bin, COUNT(*) AS cnt, mn, mx
  FROM (SELECT {column} AS x, (SELECT MIN({column}) FROM {source}) AS mn,
    (SELECT MAX({column}) FROM {source}) AS mx FROM {source}) WHERE x IS NOT NULL GROUP BY 1, 3, 4"""


def histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""SELECT '{column}' AS field, bin,
  ROUND(CASE WHEN mn = mx THEN mn ELSE mn + bin * ((mx - mn) / {bins}.0) END, 6) AS lo,
  ROUND(CASE WHEN mn = mx THEN mx ELSE mn + bin * ((mx - mn) / {bins}.0) + (mx - mn) / {bins}.0 END, 6) AS hi, cnt
FROM ({bins_sql(source, column, bins)})"""


def edge_sql(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.?0*$', '')"


def labelled_bins_sql(source: str, column: str, bins: int, top: int) -> str:
    """The bin distribution with its labels."""
    lo, width = f"(mn + bin * ((mx - mn) / {bins}.0))", f"((mx - mn) / {bins}.0)"
    return f"""SELECT * FROM (WITH h AS (SELECT bin, cnt, CASE WHEN mn = mx THEN mn ELSE {lo} END AS lo,
  CASE WHEN mn = mx THEN mx ELSE {lo} + {width} END AS hi FROM ({bins_sql(source, column, bins)})),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cnt DESC, lo) AS rn FROM h),
t AS (SELECT COUNT(*) AS n, COUNT({column}) AS nn FROM {source}),
k AS (SELECT CAST(SUM(cnt) AS BIGINT) AS kept FROM r WHERE rn <= {top})
SELECT '{column}' AS field, 'bin' AS kind, {edge_sql('lo')} || ' - ' || {edge_sql('hi')} AS label,
  ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi, cnt, CAST(rn AS INTEGER) AS ord FROM r WHERE rn <= {top}
UNION ALL SELECT '{column}', 'others', 'Others', NULL, NULL, nn - kept, {top + 1} FROM t, k WHERE nn > kept
UNION ALL SELECT '{column}', 'not_numeric', '(null or not numeric)', NULL, NULL, n - nn, {top + 2} FROM t WHERE n > nn
UNION ALL SELECT '{column}', 'total', 'Total', NULL, NULL, n, {top + 3} FROM t)"""


def pattern_sql(source: str, columns) -> str:
    import re

    rows = []
    for c in columns:
        for name, rx in quality.PATTERNS.items():
            plain = re.sub(r"\\z$", "$", rx)
            rows.append(
                f"SELECT '{c}' AS field, '{name}' AS pattern, COUNT(*) FILTER (WHERE {c} IS NOT NULL AND "
                f"regexp_matches(trim(CAST({c} AS VARCHAR)), '{plain}', 'i')) AS hits FROM {source}"
            )
    return union(rows)


# -- profile of a whole table ----------------------------------------------------------------

PROFILE_ROUNDING = {"num_mean": 4, "num_median": 4, "num_std_pop": 4, "num_var_pop": 2}


def profile_table(df: DataFrame, dictionary: Dictionary) -> DataFrame:
    out = profile.profile(df, dictionary)
    return out.select(
        *[F.round(c, PROFILE_ROUNDING[c]).alias(c) if c in PROFILE_ROUNDING else F.col(c) for c in out.columns]
    )


def profile_sql(source: str, fields) -> str:
    """Profile of ``(name, kind, meta_type, role, spark_type)`` fields."""
    hints = union(
        f"SELECT CAST({i} AS INTEGER) AS ord, '{n}' AS field, '{m}' AS meta_type, '{r}' AS role, '{s}' AS spark_type"
        for i, (n, _, m, r, s) in enumerate(fields)
    )
    measures = [n for n, _, _, r, _ in fields if r == "M"]
    numbers = union(numeric_sql(source, n) for n in measures)
    outliers = union(outlier_sql(source, n) for n in measures)
    return f"""WITH h AS ({hints}), b AS ({base_sql(source, {n: k for n, k, *_ in fields})}),
n AS ({numbers}), o AS ({outliers})
SELECT h.field, meta_type, role, {semantic_sql()} AS inferred_semantic,
  CASE WHEN row_count > null_count THEN spark_type ELSE 'NULL' END AS type_sample,
  row_count, null_count, empty_count, missing_pct, distinct_count, unique_pct, is_high_cardinality,
  num_min, num_max, num_mean, num_median, num_std_pop, num_var_pop, outlier_count, outlier_pct, ord
FROM h JOIN b ON h.field = b.field LEFT JOIN n ON h.field = n.field LEFT JOIN o ON h.field = o.field"""


ORDERS_FIELDS = [
    ("o_orderkey", "number", "Char", "D", "bigint"),
    ("o_custkey", "number", "Char", "D", "bigint"),
    ("o_orderstatus", "text", "Char", "D", "string"),
    ("o_totalprice", "number", "Num", "M", "double"),
    ("o_orderdate", "time", "Datetime", "D", "timestamp_ntz"),
    ("o_orderpriority", "text", "Char", "D", "string"),
]
CUSTOMER_FIELDS = [
    ("c_custkey", "number", "Char", "D", "bigint"),
    ("c_name", "text", "Char", "D", "string"),
    ("c_nationkey", "number", "Char", "D", "int"),
    ("c_acctbal", "number", "Num", "M", "double"),
    ("c_mktsegment", "text", "Char", "D", "string"),
]
EVENT_FIELDS = [
    ("event_id", "number", "Char", "D", "bigint"),
    ("ts", "time", "Datetime", "D", "timestamp_ntz"),
    ("user_id", "number", "Char", "D", "bigint"),
    ("event_type", "text", "Char", "M", "string"),
    ("value", "number", "Num", "M", "double"),
    ("props", "text", "Char", "M", "string"),
]


def semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantics of events, with two text columns declared measures so that ``mixed`` occurs."""
    df = table(spark, sf_dir, "events")
    roles = F.create_map(*[F.lit(x) for n, _, _, r, _ in EVENT_FIELDS for x in (n, r)])
    types = F.create_map(*[F.lit(x) for n, _, m, _, _ in EVENT_FIELDS for x in (n, m)])
    base = profile.base_metrics(df, [n for n, *_ in EVENT_FIELDS])
    role, meta = F.element_at(roles, F.col("field")), F.element_at(types, F.col("field"))
    return base.select("field", profile.infer_semantic(role, meta).alias("inferred_semantic"))


def semantics_sql() -> str:
    hints = union(f"SELECT '{n}' AS field, '{m}' AS meta_type, '{r}' AS role" for n, _, m, r, _ in EVENT_FIELDS)
    return f"""WITH h AS ({hints}), b AS ({base_sql('events', {n: k for n, k, *_ in EVENT_FIELDS})})
SELECT h.field, {semantic_sql()} AS inferred_semantic FROM h JOIN b ON h.field = b.field"""


def report_sql(source: str, fields) -> str:
    columns = ", ".join(n for n, *_ in fields)
    text_fields = [n for n, k, _, r, _ in fields if r == "D" and k != "time"]
    return f"""WITH p AS ({profile_sql(source, fields)}), d AS ({duplicate_sql(source, columns)}),
x AS (SELECT CAST(SUM(hits) AS BIGINT) AS pattern_hits FROM ({pattern_sql(source, text_fields)})),
s AS (SELECT (SELECT total_rows FROM d) AS row_count, COUNT(*) AS column_count,
  ROUND(LEAST(10.0, GREATEST(0.0, 10.0 * AVG(log2(CAST(GREATEST(1, LEAST(distinct_count, row_count)) AS DOUBLE))
    / log2(CAST(GREATEST(2, row_count) AS DOUBLE))))), 2) AS entropy_score,
  COUNT(*) FILTER (WHERE is_high_cardinality) / CAST(COUNT(*) AS DOUBLE) AS high_share,
  (SELECT duplicate_pct FROM d) AS duplicate_pct,
  CAST(SUM(null_count + empty_count) AS BIGINT) AS missing_cells,
  COUNT(*) FILTER (WHERE inferred_semantic = 'numeric') AS numeric_fields,
  COUNT(*) FILTER (WHERE inferred_semantic = 'datetime') AS datetime_fields,
  MAX(distinct_count) AS highest_cardinality, MIN(num_min) AS numeric_min, MAX(num_max) AS numeric_max,
  ROUND(AVG(num_std_pop), 3) AS mean_std_pop, CAST(COALESCE(SUM(outlier_count), 0) AS BIGINT) AS iqr_outliers,
  COUNT(*) FILTER (WHERE inferred_semantic IN ('string', 'mixed') AND unique_pct >= 92.0
    AND distinct_count > GREATEST(80, FLOOR(0.4 * row_count))) AS near_keys FROM p)
SELECT row_count, column_count, entropy_score, high_share, duplicate_pct,
  ROUND(100.0 * (1.0 - missing_cells / CAST(row_count * column_count AS DOUBLE)), 2) AS completeness_pct,
  missing_cells, numeric_fields, column_count - numeric_fields - datetime_fields AS text_fields, datetime_fields,
  (SELECT field FROM p ORDER BY distinct_count DESC, ord LIMIT 1) AS highest_cardinality_field, highest_cardinality,
  numeric_min, numeric_max, mean_std_pop, iqr_outliers,
  COALESCE((SELECT string_agg(field, ', ' ORDER BY ord) FROM p WHERE inferred_semantic = 'datetime'), '') AS timeline_fields,
  CASE WHEN row_count >= 50 AND near_keys >= GREATEST(2, column_count // 5) THEN 'High' ELSE 'Low' END AS security_risk,
  (SELECT pattern_hits FROM x) AS pattern_hits,
  CASE WHEN entropy_score >= 7.2 OR high_share >= 0.45 THEN 'randomized'
    WHEN entropy_score <= 3.4 AND duplicate_pct <= 5.0 AND high_share <= 0.2 THEN 'structured'
    ELSE 'unstructured' END AS primary_characteristic FROM s"""


def _orders(spark, d):
    df = table(spark, d, "orders")
    return df, Dictionary.of(df, ["o_totalprice"], ["o_orderkey"])


def _customer(spark, d):
    df = table(spark, d, "customer")
    return df, Dictionary.of(df, ["c_acctbal"], ["c_custkey"])


def _digest(spark, d):
    """Whole digests of the customers' profile: heading and counts, figures of measures as numbers, all further lines."""
    df, dictionary = _customer(spark, d)
    full = profile.profile_dataset(df, dictionary)
    lines = F.split("digest", "\n")
    figures = F.get(F.filter(lines, lambda x: x.startswith("  min=")), F.lit(0))
    rest = F.filter(F.slice(lines, 3, 1_000_000), lambda x: ~x.startswith("  min="))
    out = profile_digest(full.fields, full.distributions, full.duplicates).select(
        "ord", "field", F.array_join(F.slice(lines, 1, 2), "\n").alias("head"), F.array_join(rest, "\n").alias("rest"),
        *[F.regexp_extract(figures, rf" {short}=(\S+)", 1).try_cast("double").alias(name) for short, name in FIGURES.items()],
    )
    for name, places in PROFILE_ROUNDING.items():
        out = rounded(out, places, name)
    return out


FIGURES = {
    "min": "num_min", "max": "num_max", "mean": "num_mean", "median": "num_median", "std": "num_std_pop", "var": "num_var_pop",
}


def digest_sql(source: str, fields) -> str:
    columns = ", ".join(n for n, *_ in fields)
    dims = {n: f"CAST({n} AS VARCHAR)" for n, _, _, role, _ in fields if role == "D"}
    return f"""WITH p AS ({profile_sql(source, fields)}), d AS ({duplicate_sql(source, columns)}),
v AS (SELECT field, '  top values: ' || string_agg(label || ':' || cnt, ', ' ORDER BY ord) AS tops
  FROM ({value_distribution_sql(source, dims, 50)}) GROUP BY field)
SELECT -1 AS ord, NULL AS field, 'Rows: ' || total_rows || '; duplicate extra rows: ' || duplicate_extra_rows || ' ('
  || format('{{:.2f}}', duplicate_pct) || '%)' AS head, '' AS rest, {", ".join(f"NULL AS {n}" for n in FIGURES.values())} FROM d
UNION ALL SELECT ord, field, '=== ' || field || ' (' || inferred_semantic || ', meta ' || meta_type || ') ===' || chr(10)
  || '  missing%=' || format('{{:.2f}}', missing_pct) || ' nulls=' || null_count || ' empty_str=' || empty_count
  || ' distinct=' || distinct_count || ' unique%=' || format('{{:.2f}}', unique_pct),
  CASE WHEN role = 'D' THEN tops ELSE '  IQR outliers: ' || outlier_count || ' (' || format('{{:.2f}}', outlier_pct) || '%)' END,
  {", ".join(FIGURES.values())} FROM p LEFT JOIN v USING (field)"""


DAY = "strftime({c}, '%Y%m%d')"
LINE_TEXTS = {c: f"CAST({c} AS VARCHAR)" for c in LINE_DIMS}

# name -> (query, SQL for the same table or None)
CASES = {
    "quick_top": (
        lambda s, d: quickstats.quick_top(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], 3),
        top_sql("orders", {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}, 3),
    ),
    "quick_top_all_dimensions": (
        lambda s, d: quickstats.quick_top(table(s, d, "lineitem"), LINE_DIMS),
        top_sql("lineitem", LINE_TEXTS, 15),
    ),
    "quick_top_dates": (
        lambda s, d: quickstats.quick_top(table(s, d, "lineitem"), ["l_shipdate"], 15, days=["l_shipdate"]),
        top_sql("lineitem", {"l_shipdate": DAY.format(c="l_shipdate")}, 15),
    ),
    "quick_top_by_day": (
        lambda s, d: quickstats.quick_top(table(s, d, "events"), ["ts"], 10, days=["ts"], by_day=True),
        top_sql("events", {"ts": DAY.format(c="ts")}, 10),
    ),
    "quick_num": (
        lambda s, d: rounded(
            quickstats.quick_num(table(s, d, "lineitem"), LINE_MEASURES), 4, "sum", "mean", "median"
        ),
        number_sql("lineitem", LINE_MEASURES, 4),
    ),
    "round_measures": (
        lambda s, d: quickstats.round_measures(
            quickstats.quick_num(table(s, d, "orders"), ["o_totalprice"]),
            Dictionary.of(table(s, d, "orders"), ["o_totalprice"]),
            3,
        ),
        union(
            f"SELECT 'o_totalprice' AS field, 0 AS null_count, {cols} FROM orders"
            for cols in [
                ", ".join(
                    f"ROUND({f}(o_totalprice), 3) AS {n}"
                    for f, n in [("MIN", "min"), ("MAX", "max"), ("SUM", "sum"), ("AVG", "mean"), ("MEDIAN", "median")]
                )
            ]
        ),
    ),
    "quick_date": (
        lambda s, d: quickstats.quick_date(table(s, d, "orders"), ["o_orderdate"]),
        "SELECT 'o_orderdate' AS field, COUNT(*) - COUNT(o_orderdate) AS null_count, "
        "strftime(MIN(o_orderdate), '%Y%m%d') AS min_value, strftime(MAX(o_orderdate), '%Y%m%d') AS max_value FROM orders",
    ),
    "null_counts": (
        lambda s, d: quickstats.null_counts(table(s, d, "lineitem"), LINE_DIMS + LINE_MEASURES),
        union(
            f"SELECT '{c}' AS field, COUNT(*) - COUNT({c}) AS null_count FROM lineitem" for c in LINE_DIMS + LINE_MEASURES
        ),
    ),
    "profile_base": (
        lambda s, d: profile.base_metrics(table(s, d, "customer")),
        base_sql("customer", {n: k for n, k, *_ in CUSTOMER_FIELDS}),
    ),
    "profile_base_wide": (
        lambda s, d: profile.base_metrics(table(s, d, "lineitem")),
        base_sql(
            "lineitem",
            {c: {"l_shipdate": "time", "l_returnflag": "text", "l_linestatus": "text"}.get(c, "number") for c in [*LINE_DIMS, *LINE_MEASURES]},
        ),
    ),
    "profile_base_texts": (
        lambda s, d: profile.base_metrics(table(s, d, "documents")),
        base_sql("documents", {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number"}),
    ),
    "profile_base_skips_arrays": (
        lambda s, d: profile.base_metrics(table(s, d, "embeddings")),
        base_sql("embeddings", {"vec_id": "number", "label": "number"}),
    ),
    "profile_numeric": (
        lambda s, d: rounded(
            rounded(profile.numeric_metrics(table(s, d, "part"), ["p_size", "p_retailprice"]), 2, "num_var_pop"),
            4, "num_mean", "num_median", "num_std_pop",
        ),
        union(numeric_sql("part", c) for c in ["CAST(p_size AS DOUBLE)", "p_retailprice"]).replace(
            "'CAST(p_size AS DOUBLE)'", "'p_size'"
        ),
    ),
    "profile_semantic": (semantics, semantics_sql()),
    "profile_orders": (lambda s, d: profile_table(*_orders(s, d)), profile_sql("orders", ORDERS_FIELDS)),
    "profile_customer": (lambda s, d: profile_table(*_customer(s, d)), profile_sql("customer", CUSTOMER_FIELDS)),
    "value_distribution": (
        lambda s, d: distribution.value_distribution(table(s, d, "part"), ["p_brand", "p_type", "p_size"], 5),
        value_distribution_sql("part", {"p_brand": "p_brand", "p_type": "p_type", "p_size": "CAST(p_size AS VARCHAR)"}, 5),
    ),
    "value_distribution_texts": (
        lambda s, d: distribution.value_distribution(table(s, d, "documents"), ["lang", "source", "text"]),
        value_distribution_sql("documents", {c: c for c in ["lang", "source", "text"]}, 50),
    ),
    "value_distribution_numbers": (
        lambda s, d: distribution.value_distribution(table(s, d, "lineitem"), ["l_extendedprice", "l_discount"], 20),
        value_distribution_sql(
            "lineitem", {c: f"CAST({c} AS VARCHAR)" for c in ["l_extendedprice", "l_discount"]}, 20
        ),
    ),
    "histogram": (
        lambda s, d: rounded(distribution.histogram(table(s, d, "lineitem"), LINE_MEASURES, 10), 6, "lo", "hi"),
        union(histogram_sql("lineitem", c, 10) for c in LINE_MEASURES),
    ),
    "bin_distribution": (
        lambda s, d: rounded(
            distribution.bin_distribution(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 6, "lo", "hi"
        ),
        union(labelled_bins_sql("lineitem", c, 200, 50) for c in ["l_quantity", "l_extendedprice"]),
    ),
    "iqr_outliers": (
        lambda s, d: rounded(quality.iqr_outliers(table(s, d, "events"), ["value", "user_id"]), 6, "outlier_pct"),
        "SELECT field, outlier_count, ROUND(outlier_pct, 6) AS outlier_pct FROM ("
        + union(outlier_sql("events", c) for c in ["value", "user_id"])
        + ")",
    ),
    "iqr_outliers_orders": (
        lambda s, d: rounded(quality.iqr_outliers(table(s, d, "orders"), ["o_totalprice"]), 6, "outlier_pct"),
        f"SELECT field, outlier_count, ROUND(outlier_pct, 6) AS outlier_pct FROM ({outlier_sql('orders', 'o_totalprice')})",
    ),
    "duplicate_rows": (
        lambda s, d: quality.duplicate_rows(table(s, d, "events"), ["user_id", "event_type"]),
        duplicate_sql("events", "user_id, event_type"),
    ),
    "duplicate_rows_all_columns": (
        lambda s, d: quality.duplicate_rows(table(s, d, "lineitem")),
        duplicate_sql("lineitem", ", ".join([*LINE_DIMS, *LINE_MEASURES])),
    ),
    "duplicate_texts": (
        lambda s, d: quality.duplicate_rows(table(s, d, "documents"), ["text"]),
        duplicate_sql("documents", "text"),
    ),
    "duplicate_keys": (
        lambda s, d: quality.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey"]),
        key_sql("lineitem", "l_orderkey"),
    ),
    "duplicate_composite_keys": (
        lambda s, d: quality.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
        key_sql("lineitem", "l_orderkey, l_linenumber"),
    ),
    "duplicated_key_values": (
        lambda s, d: quality.duplicated_key_values(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "SELECT l_orderkey, l_linenumber, COUNT(*) AS cnt FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
    ),
    "pattern_scan": (
        lambda s, d: quality.pattern_scan(table(s, d, "documents"), ["text", "lang", "source"]),
        pattern_sql("documents", ["text", "lang", "source"]),
    ),
    "pattern_scan_dates": (
        lambda s, d: quality.pattern_scan(table(s, d, "orders"), ["o_orderdate", "o_orderpriority"]),
        pattern_sql("orders", ["o_orderdate", "o_orderpriority"]),
    ),
    "pattern_total": (
        lambda s, d: quality.pattern_total(table(s, d, "pages"), ["url", "html"]),
        f"SELECT CAST(SUM(hits) AS BIGINT) AS pattern_hits FROM ({pattern_sql('pages', ['url', 'html'])})",
    ),
    "dataset_report": (
        lambda s, d: rounded(report.report_of(*_customer(s, d)), 3, "mean_std_pop"),
        report_sql("customer", CUSTOMER_FIELDS),
    ),
    "dataset_report_orders": (
        lambda s, d: rounded(report.report_of(*_orders(s, d)), 3, "mean_std_pop"),
        report_sql("orders", ORDERS_FIELDS),
    ),
    "profile_digest": (_digest, digest_sql("customer", CUSTOMER_FIELDS)),
}
