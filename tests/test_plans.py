"""Shapes of plans that have to hold at scale."""

import ast
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablescout.operators import distribution, filters, grid, percentiles, profile, quality, quickstats, values
from tablescout.operators.pivot import pivot
from tablescout.plans import catalog
from tablescout.plans.pivot_cases import FLAGS, lines_by_year
from tablescout.sources.delimited import file_facts


def plan_of(df, mode="simple") -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.fixture()
def lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


# These write files, which plans of their results do not show.
@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if not n.startswith(("export", "read_"))))
def test_no_cross_joins_no_global_windows_no_python(spark, sf_dir, name):
    plan = plan_of(catalog.queries()[name](spark, sf_dir))
    for bad in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]:
        assert bad not in plan, plan
    for line in plan.splitlines():
        if " Window [" in line:
            assert re.search(r"specifiedwindowframe\(.*\], \[[^\]]+\], \[", line), line  # partitioned, then ordered


def test_filters_reach_the_scan(lines):
    cond = filters.where_range_text(lines, "l_extendedprice", "100-400") & filters.where_in(lines, {"l_returnflag": ["A"]})
    plan = plan_of(lines.filter(cond).select("l_orderkey"), "formatted")
    assert "GreaterThanOrEqual(l_extendedprice,100.0)" in plan and "EqualTo(l_returnflag,A)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string>" in plan


def test_scans_read_only_what_they_need(lines):
    assert "ReadSchema: struct<l_quantity:double>" in plan_of(quickstats.quick_num(lines, ["l_quantity"]))
    assert "ReadSchema: struct<l_returnflag:string>" in plan_of(quickstats.quick_top(lines, ["l_returnflag"]))


def test_ranking_is_limited_before_its_shuffle(lines):
    plan = plan_of(distribution.value_distribution(lines, ["l_partkey"], 5))
    partial = [ln for ln in plan.splitlines() if "WindowGroupLimit" in ln]
    assert any("Partial" in ln for ln in partial) and any("Final" in ln for ln in partial)


def test_counts_are_combined_before_the_shuffle(lines):
    for df in [quality.duplicate_rows(lines), profile.base_metrics(lines), pivot(lines, FLAGS, [], ["l_tax"])]:
        assert "partial_count" in plan_of(df) or "partial_sum" in plan_of(df)


def test_pivot_aggregates_rows_once(spark, sf_dir):
    out = pivot(lines_by_year(spark, sf_dir), FLAGS, ["year"], ["l_tax"])
    assert plan_of(out).count("FileScan parquet") == 1


def test_pivots_shuffle_once_per_grouping(spark, sf_dir):
    """Leaves, grouping sets, and the sort; column dimensions add no shuffle."""
    for dims in ([], ["year"]):
        plan = plan_of(pivot(lines_by_year(spark, sf_dir), FLAGS, dims, ["l_tax"]))
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange rangepartitioning") == 1
    true = plan_of(pivot(lines_by_year(spark, sf_dir), FLAGS, ["year"], ["l_tax"], "AVG", totals="true"))
    assert true.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("fields", [["l_quantity"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]])
def test_a_percentile_step_is_one_scan(spark, lines, fields):
    search = percentiles._Search(lines, fields, [0.1, 0.25, 0.5, 0.75, 0.9], 10)
    open_ = [t for t in search.targets.values() if t.value is None]
    assert len(open_) > len(fields)
    _, rows = search._rows(open_)
    assert plan_of(rows).count("FileScan parquet") == 1


def test_texts_are_counted_by_digest(spark, sf_dir):
    """No raw text is part of a shuffle of counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (quality.duplicate_rows(docs, ["text"]), profile.base_metrics(docs, ["text"])):
        plan = plan_of(df)
        shuffles = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
        assert shuffles and not any(re.search(r"\btext#", ln) for ln in shuffles)
        assert "sha2" in plan


def test_file_facts_read_no_file(spark, sf_dir):
    plan = plan_of(file_facts(spark, f"{sf_dir}/lineitem.parquet"), "formatted")
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_large_rankings_are_sliced(lines):
    plan = plan_of(quickstats.quick_top(lines, ["l_partkey"], 5_000))
    assert len([ln for ln in plan.splitlines() if " Window [" in ln]) == 2


def test_pages_are_a_top_k(lines):
    assert "TakeOrderedAndProject" in plan_of(grid.page(lines, keys=["l_orderkey"], index=2))


def test_a_page_ranks_keys_only(lines, monkeypatch):
    """Where a page lies is found on its sort keys; whole rows are read between two keys."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, collect = [], DataFrame.collect

    def seen(self):
        plans.append(plan_of(self))
        return collect(self)

    monkeypatch.setattr(DataFrame, "collect", seen)
    out = grid.page(lines, [("l_shipdate", False)], ["l_orderkey", "l_linenumber"])
    (ranking,) = plans
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate" in ranking and "sha2" not in ranking
    assert "l_shipdate" in plan_of(out).split("DataFilters", 1)[1]


def test_a_hot_sort_key_is_spread(spark):
    df = spark.range(8000).select((F.col("id") % 1).alias("k"), F.lit("same").alias("v")).repartition(8)
    ordered = df.orderBy(*grid.grid_order(df, [], ["k"]), F.spark_partition_id())
    ranges = [ln for ln in plan_of(ordered).splitlines() if "rangepartitioning(k" in ln]
    assert ranges and "_nondeterministic" in ranges[0]


def test_a_hot_value_and_a_hot_row(spark):
    """One value in a third of the rows changes no result."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("v"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id").cast("double")).alias("x"),
    )
    top = quickstats.quick_top(df, ["v"], 1).first()
    assert (top["value"], top["cnt"]) == ("hot", 3000)
    row = quality.duplicate_rows(df).first()
    assert (row["distinct_full_rows"], row["duplicate_extra_rows"]) == (6001, 2999)
    assert quickstats.quick_num(df, ["x"], finish_rows=50).first()["median"] == df.agg(F.percentile("x", 0.5)).first()[0]


@pytest.mark.parametrize("path", sorted(Path(catalog.__file__).parent.glob("*.py")), ids=lambda p: p.name)
def test_a_name_of_a_module_is_given_once(path):
    """SQL is put together from constants by name; a second constant of that name would spoil it."""
    given = [t.id for node in ast.parse(path.read_text()).body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name)]
    assert [name for name, times in Counter(given).items() if times > 1] == []


@pytest.mark.parametrize("name", ["pivot_dirty", "sort_result_dirty"])
def test_text_cells_are_read_as_numbers_in_sql_too(name):
    assert "try_cast(replace(trim(written), '_', '') AS DOUBLE)" in catalog.oracle_sql()[name]


@pytest.mark.parametrize("query", [profile.base_metrics, quality.duplicate_rows, quickstats.quick_top], ids=lambda q: q.__name__)
def test_rows_that_unfold_into_many_cells_are_dealt_to_more_tasks(spark, query, monkeypatch):
    """No task counts many more cells than its share, though one task reads all rows; results stay."""
    cells = [F.concat(F.lit(f"{i}."), F.col("id")).alias(f"t{i}") for i in range(5)]
    df = spark.range(0, 4000, 1, 1).select(*cells, F.lit("same").alias("s"), F.col("id"))
    whole = sorted(map(str, query(df).collect()))
    assert "REPARTITION_BY_NUM" not in plan_of(query(df))
    monkeypatch.setattr(values, "TASK_CELLS", 7000, raising=False)
    assert "REPARTITION_BY_NUM" in plan_of(query(df))
    assert sorted(map(str, query(df).collect())) == whole
    dealt = values.dealt(df, values.parts_for(df, df.columns)).groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] * len(df.columns) < 7000 and dealt.count() == 16


def test_long_texts_are_dealt_by_their_digests(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("long" * 30), F.col("id") % 7).alias("t"), (F.col("id") % 5).alias("x"))
    queries = [profile.base_metrics, quality.duplicate_rows, quickstats.quick_top]
    whole = [sorted(map(str, q(df).collect())) for q in queries]
    monkeypatch.setattr(values, "TASK_CELLS", 1000)
    for query, rows in zip(queries, whole, strict=True):
        plan = plan_of(query(df), "formatted").split("REPARTITION_BY_NUM")
        moved = len(plan) > 1 and re.search(r"xxhash64\(t#", plan[0] + plan[1])
        assert not moved and (len(plan) > 1) == (query is not quickstats.quick_top)
        assert sorted(map(str, query(df).collect())) == rows
