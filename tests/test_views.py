"""Charts, filters, drilling, order and pages."""

import pytest
from pyspark.sql import functions as F

from tablescout.operators import charts, filters, grid
from tablescout.operators.filters import DrillSpec, FilterSpec, RangeSpec
from tablescout.sources.dictionary import Dictionary, Field


@pytest.mark.parametrize(
    "text,want",
    [("  100 and 400 ", (100, 400)), ("400-100", (100, 400)), ("1.5 TO 9", (1.5, 9)), ("0..1", (0, 1)),
     ("-5 - -1", (-5, -1)), ("1e2–3e2", (100, 300)), ("10—20", (10, 20)), ("hello", None), ("100", None),
     ("1e999-2", None), ("", None)],
)
def test_typed_ranges(spark, text, want):
    assert filters.parse_range(text) == want
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(filters.range_bounds(F.col("t")).alias("b")).first()["b"]
    assert (None if got is None else tuple(got)) == want


def cells(spark):
    return spark.createDataFrame([("42",), ("3.14",), ("1,234.5",), ("x",), (None,), ("inf",)], "v string")


def test_result_filter_drops_commas(spark):
    got = filters.filter_result(cells(spark), {"v": "0 to 2000"}, measures=["v"]).collect()
    assert [r["v"] for r in got] == ["42", "3.14", "1,234.5"]
    assert filters.filter_result(cells(spark), {"v": "4"}).count() == 3
    assert filters.filter_result(cells(spark), {"v": "  "}).count() == 6
    flags = spark.createDataFrame([(True,)], "v boolean")
    assert filters.filter_result(flags, {"v": "0-2"}, measures=["v"]).count() == 0


def test_in_list_compares_text_with_text(spark):
    df = spark.createDataFrame([("01",), ("1",), ("x",), (None,)], "v string")
    pick = lambda *vs: [r["v"] for r in df.filter(filters.where_in(df, {"v": list(vs)})).collect()]
    assert pick("01") == ["01"]
    assert pick("x", None) == ["x", None]
    assert pick(None) == [None]
    assert df.filter(filters.where_in(df, {"v": []})).count() == 4


def test_ranges_are_half_open_but_for_the_last(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    count = lambda *rs: df.filter(filters.where_ranges(df, {"x": rs})).count()
    assert count(RangeSpec(0, 5)) == 5
    assert count(RangeSpec(5, 10, True)) == 6
    assert count(RangeSpec(0, 1), RangeSpec(9, 10)) == 2


def test_measure_ranges(spark):
    df = spark.createDataFrame([(0.3,), (1.0,)], "x double")
    rows = filters.measure_ranges(df, "x").orderBy("ord").collect()
    assert len(rows) == 10 and rows[-1]["end"] == 1.0 and rows[-1]["include_end"]
    same = filters.measure_ranges(df.limit(1), "x").orderBy("ord").collect()
    assert (same[0]["end"] - same[0]["start"], same[9]["end"]) == (1.0, 10.3)
    assert filters.measure_ranges(df.limit(0), "x").count() == 0


def test_contains_has_no_wildcards(spark):
    df = spark.createDataFrame([("100%",), ("100x",), (None,)], "v string")
    assert [r["v"] for r in df.filter(filters.where_contains(df, "v", "0%")).collect()] == ["100%"]


def test_range_text_on_a_dimension_is_a_search(spark):
    df = spark.createDataFrame([("1-3",), ("2",)], "v string")
    assert df.filter(filters.where_range_text(df, "v", "1-3", measure=False)).count() == 1
    assert [r["v"] for r in df.filter(filters.where_range_text(df, "v", "1-3")).collect()] == ["2"]


def test_chart_and_panel_exclude_each_other(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "d string, m double")
    spec = FilterSpec(choices={"d": ["a"]}, typed={"m": "2-3"})
    assert spec.mode == "user" and FilterSpec().mode == "none"
    dictionary = Dictionary((Field("d"), Field("m", "Num", "M")))
    assert df.filter(spec.column(df, dictionary)).count() == 0
    assert df.filter(spec.column(df, dictionary, for_pivot=True)).count() == 1
    chart = spec.with_chart(filters.drill_filter(df, DrillSpec("bar", ["d"]), "b"))
    assert chart.mode == "chart" and df.filter(chart.column(df, dictionary)).count() == 1
    assert chart.with_panel({"d": ["a"]}).mode == "user"


def test_drill_into_null(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", 2)], "d string, k int")
    assert df.filter(filters.drill_filter(df, DrillSpec("bar", ["d"]), None)).count() == 1
    assert df.filter(filters.drill_filter(df, DrillSpec("bar", ["k"]), "1")).count() == 2
    assert df.filter(filters.drill_filter(df, DrillSpec("stacked_bar", ["d", "k"]), "a", 2)).count() == 1
    with pytest.raises(ValueError):
        filters.drill_filter(df, DrillSpec("stacked_bar", ["d"]), "a")


def test_drill_bin_conventions(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    both, own = DrillSpec("histogram", measure="x"), DrillSpec("histogram", measure="x", closed="bin")
    assert df.filter(filters.drill_filter(df, both, 2, 3)).count() == 2
    assert df.filter(filters.drill_filter(df, own, 2, 3)).count() == 1
    assert df.filter(filters.drill_filter(df, own, 9, 10, last_bin=True)).count() == 2


def test_drill_into_a_result(spark):
    df = spark.createDataFrame([("United States", 331), ("Canada", 40), (" ", 1), (None, 2)], "NAME string, POP int")
    spec = DrillSpec("bar", ["NAME"])
    assert [r["POP"] for r in filters.drill_result(df, spec, " united states ").collect()] == [331]
    assert filters.drill_result(df, spec, "").count() == 2
    assert filters.drill_result(df, spec).count() == 4
    assert filters.drill_result(df, DrillSpec("bar", ["POP"]), "40.0").count() == 1
    assert filters.drill_result(df, DrillSpec("pie", ["gone"]), "CANADA").count() == 1


def test_shapes(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, m double")
    for bad in [lambda: charts.chart_sum(df, [], ["m"]), lambda: charts.chart_stacked(df, ["a"], ["m"]),
                lambda: charts.chart_pie(df, ["a"], []), lambda: charts.check_shape("cake", ["a"], ["m"])]:
        with pytest.raises(ValueError):
            bad()


def test_chart_order(spark):
    df = spark.createDataFrame([("b", 1.0), (None, 9.0), ("a", 5.0), ("b", 3.0)], "d string, m double")
    assert [r["d"] for r in charts.chart_sum(df, ["d"], ["m"]).collect()] == ["a", "b", None]
    assert [r["d"] for r in charts.chart_pie(df, ["d"], ["m"]).collect()] == [None, "a", "b"]
    assert [r["m"] for r in charts.chart_avg(df, ["d"], ["m"]).collect()] == [5.0, 2.0, 9.0]


def test_chart_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 10]], "x double")
    rows = charts.chart_histogram(df, "x").collect()
    assert [(r["bin_idx"], r["cnt"], r["bin_min"], r["bin_max"]) for r in rows] == [
        (0, 1, 0.0, 1.0), (1, 2, 1.0, 2.0), (9, 1, 9.0, 10.0)]
    with pytest.raises(Exception, match="range"):
        charts.chart_histogram(df.filter("x = 1"), "x").collect()


def test_sort_keys():
    assert grid.sort_keys([], ["SUMLEV", "STATE"]) == [("SUMLEV", True), ("STATE", True)]
    assert grid.sort_keys([("STATE", False)], ["SUMLEV", "STATE"]) == [("STATE", False), ("SUMLEV", True)]
    assert grid.sort_keys([("A", False), ("A", True)], []) == [("A", False)]
    assert grid.result_sort_keys([("Z", True)], ["SUMLEV", "NAME", "POP"], ["NAME"]) == [
        ("NAME", True), ("SUMLEV", True), ("POP", True)]


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    for up, want in [(True, [1, 2, None]), (False, [2, 1, None])]:
        assert [r["k"] for r in grid.page(df, [("k", up)]).collect()] == want


def test_pages(spark):
    df = spark.range(250).withColumnRenamed("id", "k")
    assert grid.page_count(250) == 3 and grid.page_count(0) == 1
    sizes = [grid.page(df, keys=["k"], index=i).count() for i in (0, 2, 99)]
    assert sizes == [100, 50, 50]


@pytest.mark.parametrize("user", [[("g", False)], [("g", True), ("v", False)], []])
def test_deep_pages_equal_shallow_ones(spark, user):
    df = spark.range(3000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("v"),
    )
    for index in (5, 29, 100, 140):
        deep = grid.page(df, user, ["k"], index, 20, ranked_rows=150).collect()
        assert deep == grid.page(df, user, ["k"], index, 20).collect()
        assert len(deep) == 20


def test_deep_pages_among_copies(spark):
    """Two thirds of the rows are copies of one row; pages cover the table exactly once."""
    df = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") - 450).alias("k"),
        F.when(F.col("id") % 3 > 0, F.lit("t")).otherwise(F.lit("u")).alias("v"),
        F.when(F.col("id") % 3 == 0, F.timestamp_seconds("id")).alias("at"),
    )
    seen = []
    for index in range(6):
        rows = grid.page(df, [("k", False)], index=index, size=150, ranked_rows=20).collect()
        assert len(rows) == 150
        seen += rows
    assert [r["k"] for r in seen] == sorted((r["k"] for r in df.collect()), reverse=True)
    assert sorted(map(str, seen)) == sorted(map(str, df.collect()))


def test_pages_of_columns_without_order(spark):
    """Tied keys, maps, structs and arrays: all pages together are the table, at any depth."""
    df = spark.range(600).select(
        (F.col("id") % 3).alias("k"),
        F.create_map(F.lit("a"), F.col("id") % 50, F.lit("b"), F.col("id") % 7).alias("m"),
        F.struct((F.col("id") % 2).alias("x"), F.lit(None).cast("string").alias("y")).alias("s"),
        F.array(F.col("id") % 40, F.lit(None).cast("bigint")).alias("l"),
        F.when(F.col("id") % 5 == 0, float("nan")).alias("d"),
        F.col("id").cast("string").cast("binary").alias("b"),
    )
    for key, rank in (("k", 1000), ("k", 60), ("s", 60), ("m", 60), ("d", 60)):
        pages = [grid.page(df, [(key, True)], index=i, size=50, ranked_rows=rank).collect() for i in range(12)]
        assert [len(p) for p in pages] == [50] * 12
        assert sorted(str(r) for p in pages for r in p) == sorted(map(str, df.collect()))


def test_canonical_text_ignores_the_order_of_a_map(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 1, 'b', NULL)")
    texts = [r[0] for r in df.select(grid.canonical(F.col("m"), df.schema["m"].dataType)).collect()]
    assert texts[0] == texts[1] != texts[2]


def test_next_page_follows_the_last_row(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("g"))
    first = grid.page(df, [("g", False)], ["k"], 0, 40).collect()
    rest = grid.next_page(df, first[-1].asDict(), [("g", False)], ["k"], 60).collect()
    assert first + rest == grid.page(df, [("g", False)], ["k"], 0, 100).collect()


def test_result_order(spark):
    df = spark.createDataFrame([("b", "10"), ("A", "9"), (None, "x"), ("a", "1,000")], "d string, m string")
    assert [r["m"] for r in grid.sort_result(df, [("m", False)], measures=["m"]).collect()] == ["1,000", "10", "9", "x"]
    assert [r["d"] for r in grid.sort_result(df, [("d", True)], measures=["m"]).collect()] == [None, "A", "a", "b"]


def test_visible_columns():
    d = Dictionary((Field("b"), Field("K"), Field("a")), ("K",))
    assert grid.visible_columns(d) == ["b", "K", "a"]
    assert grid.visible_columns(d, ["a"]) == ["K", "a"]
    assert grid.visible_columns(d, []) == ["K"]
    assert grid.visible_columns(d, sort_names=True) == ["a", "b", "K"]


def test_distinct_values(spark):
    df = spark.createDataFrame([(2.0,), (10.0,), (None,), (2.0,)], "x double")
    assert [r["value"] for r in filters.distinct_values(df, "x").collect()] == ["10.0", "2.0", None]
    assert [r["value"] for r in filters.distinct_values(df, "x", contains=" 0.0").collect()] == ["10.0"]
    assert filters.distinct_values(df, "x", limit=1).count() == 1


def test_large_pages_keep_terms_off_the_driver(spark, monkeypatch):
    """Pages of many rows are right, copies on their borders too, and no collected frame has more rows than a page has borders."""
    rows = [(i % 7, i // 3 % 11, "x" if i % 5 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(5)
    seen, collect = [], type(df).collect

    def counted(self):
        out = collect(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(grid, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(type(df), "collect", counted)
    pages = [grid.page(df, [("b", False)], ["a"], index=i, size=250, total=900, ranked_rows=100) for i in range(4)]
    largest = max(seen)
    monkeypatch.undo()
    got = [[tuple(r) for r in p.collect()] for p in pages]
    assert [len(p) for p in got] == [250, 250, 250, 150] and largest <= 4
    assert sorted(map(repr, sum(got, []))) == sorted(map(repr, rows))
    keys = [(-b, a) for a, b, _ in sum(got, [])]
    assert keys == sorted(keys)


def test_pages_narrowed_by_samples(spark, monkeypatch):
    """Places far beyond what is ranked at once, among copies and ties, in a table of known order."""
    monkeypatch.setattr(grid, "SAMPLE_ROWS", 60)
    df = spark.range(2_000).select((F.col("id") * 7 % 40).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("v")).repartition(5)
    want = sorted(r["k"] for r in df.collect())
    for index in (0, 21, 39):
        page = [r["k"] for r in grid.page(df, [("k", True)], index=index, size=50, total=2_000, ranked_rows=60).collect()]
        assert page == want[50 * index : 50 * index + 50]


def test_rank_index(spark, tmp_path):
    """Every page of a written order equals the sorted table, with a hot key over several parts."""
    rows = [(None if i % 10 == 0 else (5 if i % 3 else i % 40), i, [i % 2]) for i in range(1_000)]
    df = spark.createDataFrame(rows, "k int, id int, a array<int>").repartition(6)
    index = grid.RankIndex.write(df, str(tmp_path / "index"), [("k", False)], ["id"], parts=8)
    assert index.parts.count() > 4 and index.total() == 1_000
    want = [r["id"] for r in df.orderBy(F.col("k").desc_nulls_last(), "id").collect()]
    got = [r for i in range(4) for r in grid.RankIndex.read(spark, str(tmp_path / "index")).page(i, 300).collect()]
    assert [r["id"] for r in got] == want and [r["__place"] for r in got] == list(range(1_000))
    plan = index.page(2, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "__within" in plan.split("PushedFilters", 1)[1]
    assert [r["id"] for r in index.page(10**6, 300).collect()] == want[900:]
    empty = grid.RankIndex.write(df.limit(0), str(tmp_path / "none"), [("k", True)])
    assert empty.page(3).count() == 0


def test_places_without_gaps(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    out = grid.with_places(df, [F.col("k").desc(), F.col("id").asc()], str(tmp_path / "places"))
    want = sorted(((-r.k, r.id) for r in df.collect()))
    assert [(-r.k, r.id) for r in sorted(out.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in out.collect()) == list(range(1, 501))
    some = df.orderBy("id").withColumn("o", F.monotonically_increasing_id()).filter("id % 3 = 0")
    dense = grid.dense_places(some, "o", str(tmp_path / "dense"), "n").collect()
    assert sorted((r.n, r.id) for r in dense) == [(i + 1, 3 * i) for i in range(167)]
