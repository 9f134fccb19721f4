"""Named pivot queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import dense_places
from ..operators.pivot import collapse, pivot, pivot_leaves
from .scratch import scratch_folder
from .stats_cases import table

FLAGS = ["l_returnflag", "l_linestatus"]
YEARS = [str(y) for y in range(1995, 2002)]
STATUSES = ["F", "O"]
FACTS = ["row_kind", "row_depth", "expandable"]


def lines_by_year(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))


def comparable(df: DataFrame, row_dims, places: int = 2) -> DataFrame:
    """Rounded cells, and for ``ord``, whose steps depend on the partitions, the place in display order."""
    keep = [*row_dims, *FACTS, "ord"]
    cells = [F.round(F.col(f"`{c}`"), places).alias(c) for c in df.columns if c not in keep]
    shown = df.select(*[F.col(f"`{c}`") for c in row_dims], *cells, *FACTS, "ord")
    return dense_places(shown, "ord", scratch_folder(df.sparkSession)).drop("ord")


def pivot_sql(
    source: str,
    row_dims: dict[str, str],
    key: str,
    keys: dict[str, str],
    measures: dict[str, str],
    where: str = "TRUE",
    leaf: str = "SUM",
    places: int = 2,
) -> str:
    """Pivot with totals that add up leaves.

    ``row_dims`` maps each row dimension to its expression, ``keys`` each column key to
    its header pattern (``{m}`` is the measure), ``measures`` each measure to the SQL
    that is aggregated.
    """
    names = list(row_dims)
    n = len(names)
    leaves = ", ".join(f"CAST({e} AS VARCHAR) AS r{i}" for i, e in enumerate(row_dims.values()))
    values = ", ".join(f"{leaf}({e}) AS v{j}" for j, e in enumerate(measures.values()))
    groups = ", ".join(str(i + 1) for i in range(n + 1))
    labels = []
    for i, name in enumerate(names):
        blank = "'Grand Total'" if i == n - 1 else "''"
        labels.append(
            f"CASE WHEN GROUPING(r0) = 1 THEN {blank} WHEN GROUPING(r{i}) = 1 THEN '' ELSE r{i} END AS {name}"
        )
    cells = []
    for j, m in enumerate(measures):
        for k, header in keys.items():
            cells.append(
                f"ROUND(SUM(CASE WHEN k = '{k}' THEN COALESCE(v{j}, 0.0) ELSE 0.0 END), {places}) "
                f"AS \"{header.format(m=m)}\""
            )
    if len(measures) == 1:
        cells.append(f'ROUND(SUM(COALESCE(v0, 0.0)), {places}) AS "GRAND TOTAL"')
    depth = " + ".join(f"(1 - GROUPING(r{i}))" for i in range(n))
    order = ", ".join(f"GROUPING(r{i}) DESC, r{i} ASC NULLS FIRST" for i in range(1, n)) or "1"
    return f"""WITH leaf AS (SELECT {leaves}, {key} AS k, {values} FROM {source} WHERE {where} GROUP BY {groups})
SELECT {', '.join(labels)}, {', '.join(cells)},
  CASE WHEN GROUPING(r0) = 1 THEN 'grand' WHEN {depth} < {n} THEN 'subtotal' ELSE 'detail' END AS row_kind,
  CAST({depth} AS INTEGER) AS row_depth, GROUPING(r0) = 0 AND {depth} < {n} AS expandable,
  ROW_NUMBER() OVER (ORDER BY GROUPING(r0), r0 ASC NULLS FIRST, {order}) AS place
FROM leaf GROUP BY ROLLUP ({', '.join(f'r{i}' for i in range(n))})"""


FLAG_DIMS = {d: d for d in FLAGS}
YEAR_SQL = "CAST(year(l_shipdate) AS VARCHAR)"
YEAR_KEYS = {y: "year-" + y for y in YEARS}


def _year_pivot(agg: str, places: int = 2, where: str | None = None):
    def query(s, d):
        condition = F.expr(where) if where else None
        out = pivot(lines_by_year(s, d), FLAGS, ["year"], ["l_extendedprice"], agg, condition)
        return comparable(out, FLAGS, places)

    return query


def _two_columns(s, d):
    df = lines_by_year(s, d)
    out = pivot(df, ["l_returnflag"], ["year", "l_linestatus"], ["l_quantity"])
    return comparable(out, ["l_returnflag"])


def _true_totals(agg: str):
    def query(s, d):
        df = table(s, d, "lineitem")
        return comparable(pivot(df, ["l_returnflag"], ["l_linestatus"], ["l_extendedprice"], agg, totals="true"), ["l_returnflag"], 4)

    return query


def true_totals_sql(agg: str) -> str:
    return f"""SELECT CASE WHEN GROUPING(l_returnflag) = 1 THEN 'Grand Total' ELSE l_returnflag END AS l_returnflag,
  COALESCE(ROUND({agg}(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 4), 0.0) AS "l_linestatus-F",
  COALESCE(ROUND({agg}(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 4), 0.0) AS "l_linestatus-O",
  ROUND({agg}(l_extendedprice), 4) AS "GRAND TOTAL",
  CASE WHEN GROUPING(l_returnflag) = 1 THEN 'grand' ELSE 'detail' END AS row_kind,
  CAST(1 - GROUPING(l_returnflag) AS INTEGER) AS row_depth, FALSE AS expandable,
  ROW_NUMBER() OVER (ORDER BY GROUPING(l_returnflag), l_returnflag ASC NULLS FIRST) AS place
FROM lineitem GROUP BY ROLLUP (l_returnflag)"""


def _wide_keys(s, d):
    return comparable(pivot(table(s, d, "orders"), ["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"]), ["o_orderpriority"])


def _many_groups(s, d):
    dims = ["c_nationkey", "c_mktsegment", "c_custkey"]
    return comparable(pivot(table(s, d, "customer"), dims, [], ["c_acctbal"]), dims)


CASES = {
    "pivot_leaves": (
        lambda s, d: pivot_leaves(lines_by_year(s, d), FLAGS, ["year"], ["l_quantity"], "MAX"),
        f"""SELECT l_returnflag, l_linestatus, {YEAR_SQL} AS __c_year, MAX(l_quantity) AS __m_l_quantity
FROM lineitem GROUP BY 1, 2, 3""",
    ),
    "pivot_sum": (
        _year_pivot("SUM"),
        pivot_sql("lineitem", FLAG_DIMS, YEAR_SQL, YEAR_KEYS, {"l_extendedprice": "l_extendedprice"}),
    ),
    "pivot_avg": (
        _year_pivot("AVG", 4),
        pivot_sql(
            "lineitem", FLAG_DIMS, YEAR_SQL, YEAR_KEYS, {"l_extendedprice": "l_extendedprice"}, leaf="AVG", places=4
        ),
    ),
    "pivot_min": (
        _year_pivot("MIN"),
        pivot_sql("lineitem", FLAG_DIMS, YEAR_SQL, YEAR_KEYS, {"l_extendedprice": "l_extendedprice"}, leaf="MIN"),
    ),
    "pivot_max": (
        _year_pivot("MAX"),
        pivot_sql("lineitem", FLAG_DIMS, YEAR_SQL, YEAR_KEYS, {"l_extendedprice": "l_extendedprice"}, leaf="MAX"),
    ),
    "pivot_count": (
        _year_pivot("COUNT", where="l_quantity > 10"),
        pivot_sql(
            "lineitem", FLAG_DIMS, YEAR_SQL, YEAR_KEYS, {"l_extendedprice": "1.0"}, where="l_quantity > 10"
        ),
    ),
    "pivot_two_measures": (
        lambda s, d: comparable(
            pivot(table(s, d, "lineitem"), FLAGS[:1], FLAGS[1:], ["l_quantity", "l_extendedprice"]), FLAGS[:1]
        ),
        pivot_sql(
            "lineitem", {"l_returnflag": "l_returnflag"}, "l_linestatus",
            {k: f"l_linestatus-{k} · {{m}}" for k in STATUSES},
            {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice"},
        ),
    ),
    "pivot_no_columns": (
        lambda s, d: comparable(pivot(table(s, d, "lineitem"), FLAGS, [], ["l_extendedprice"]), FLAGS),
        pivot_sql("lineitem", FLAG_DIMS, "'Total'", {"Total": "{m}"}, {"l_extendedprice": "l_extendedprice"}),
    ),
    "pivot_two_columns": (
        _two_columns,
        pivot_sql(
            "lineitem", {"l_returnflag": "l_returnflag"}, f"{YEAR_SQL} || '|' || l_linestatus",
            {f"{y}|{k}": f"year-{y} - l_linestatus-{k}" for y in YEARS for k in STATUSES},
            {"l_quantity": "l_quantity"},
        ),
    ),
    "pivot_orders": (
        _wide_keys,
        pivot_sql(
            "orders", {"o_orderpriority": "o_orderpriority"}, "o_orderstatus",
            {k: f"o_orderstatus-{k}" for k in ["F", "O", "P"]}, {"o_totalprice": "o_totalprice"},
        ),
    ),
    "pivot_many_groups": (
        _many_groups,
        pivot_sql(
            "customer", {c: c for c in ["c_nationkey", "c_mktsegment", "c_custkey"]}, "'Total'", {"Total": "{m}"},
            {"c_acctbal": "c_acctbal"},
        ),
    ),
    "pivot_true_totals": (_true_totals("AVG"), true_totals_sql("AVG")),
    "pivot_true_totals_min": (_true_totals("MIN"), true_totals_sql("MIN")),
    "pivot_true_totals_max": (_true_totals("MAX"), true_totals_sql("MAX")),
    "pivot_collapsed": (
        lambda s, d: comparable(
            collapse(pivot(lines_by_year(s, d), FLAGS, ["year"], ["l_extendedprice"]), FLAGS, depth=1), FLAGS
        ),
        "SELECT * REPLACE (ROW_NUMBER() OVER (ORDER BY place) AS place) FROM ("
        + pivot_sql("lineitem", FLAG_DIMS, YEAR_SQL, YEAR_KEYS, {"l_extendedprice": "l_extendedprice"})
        + ") WHERE row_depth <= 1",
    ),
    "pivot_collapsed_node": (
        lambda s, d: comparable(
            collapse(pivot(lines_by_year(s, d), FLAGS, ["year"], ["l_extendedprice"]), FLAGS, nodes=[["A"]]), FLAGS
        ),
        "SELECT * REPLACE (ROW_NUMBER() OVER (ORDER BY place) AS place) FROM ("
        + pivot_sql("lineitem", FLAG_DIMS, YEAR_SQL, YEAR_KEYS, {"l_extendedprice": "l_extendedprice"})
        + ") WHERE NOT (row_depth > 1 AND l_returnflag = 'A')",
    ),
}
