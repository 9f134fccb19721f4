import pytest
from pyspark.sql import functions as F

from tablescout.operators.pivot import collapse, pivot, pivot_keys, pivot_leaves, pivot_long, wide_header
from tablescout.sources.export import formatted_pivot

POP = [("40", "5", "3", 10.0), ("40", "5", "4", 1.0), ("40", "7", "3", 5.0)]


def population(spark):
    return spark.createDataFrame(POP, "SUMLEV string, DIVISION string, REGION string, POP double")


def shown(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_leaves(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2)], "a string, v int")
    assert shown(pivot_leaves(df, ["a"], [], ["v"]), "a", "__m_v") == [("x", 3.0)]
    assert shown(pivot_leaves(df, ["a"], [], ["v"], "count"), "a", "__m_v") == [("x", 2.0)]


def test_subtotals_details_and_totals(spark):
    out = pivot(population(spark), ["SUMLEV", "DIVISION"], ["REGION"], ["POP"])
    assert out.columns[:5] == ["SUMLEV", "DIVISION", "REGION-3", "REGION-4", "GRAND TOTAL"]
    assert [tuple(r)[:9] for r in out.drop("ord").collect()] == [
        ("40", "", 15.0, 1.0, 16.0, "subtotal", 1, True),
        ("40", "5", 10.0, 1.0, 11.0, "detail", 2, False),
        ("40", "7", 5.0, 0.0, 5.0, "detail", 2, False),
        ("", "Grand Total", 15.0, 1.0, 16.0, "grand", 0, False),
    ]
    order = [r["ord"] for r in out.collect()]
    assert order == sorted(set(order))


def test_three_row_dimensions_without_columns(spark):
    df = spark.createDataFrame([("040", "05", "SomePlace", 123.45)], "a string, b string, c string, v double")
    out = pivot(df, ["a", "b", "c"], [], ["v"]).collect()
    assert [(r["row_kind"], r["row_depth"], r["v"], r["GRAND TOTAL"]) for r in out] == [
        ("subtotal", 1, 123.45, 123.45), ("subtotal", 2, 123.45, 123.45), ("detail", 3, 123.45, 123.45), ("grand", 0, 123.45, 123.45)]
    assert (out[-1]["a"], out[-1]["b"], out[-1]["c"]) == ("", "", "Grand Total")


def test_two_measures_have_no_grand_total_column(spark):
    df = spark.createDataFrame([("40", "5", "3", 1, 10), ("40", "5", "4", 2, 20)], "s string, d string, r string, POP int, EST int")
    out = pivot(df, ["s", "d"], ["r"], ["POP", "EST"])
    assert out.columns[2:6] == ["r-3 · POP", "r-4 · POP", "r-3 · EST", "r-4 · EST"]
    assert "GRAND TOTAL" not in out.columns
    detail = out.filter("row_kind = 'detail'").first()
    assert tuple(detail)[2:6] == (1.0, 2.0, 10.0, 20.0)


def test_nulls_come_first_numbers_sort_as_text(spark):
    df = spark.createDataFrame([(10, None, 1.0), (9, "x", 2.0), (None, "", 3.0)], "a int, b string, v double")
    out = pivot(df, ["a", "b"], [], ["v"])
    assert shown(out, "a", "b", "row_kind") == [
        (None, "", "subtotal"), (None, "", "detail"), ("10", "", "subtotal"), ("10", None, "detail"),
        ("9", "", "subtotal"), ("9", "x", "detail"), ("", "Grand Total", "grand")]


def test_averages_add_up_unless_true_totals_are_asked(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 10.0)], "d string, k string, v double")
    added = pivot(df, ["d", "k"], [], ["v"], "AVG").collect()
    assert added[0]["v"] == 12.0 and added[-1]["v"] == 12.0
    true = pivot(df, ["d", "k"], [], ["v"], "AVG", totals="true").collect()
    assert true[0]["v"] == pytest.approx(14 / 3) and true[1]["v"] == 2.0


def test_colliding_keys_add_up(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "", 2.0)], "d string, k string, v double")
    out = pivot(df, ["d"], ["k"], ["v"])
    assert out.columns[1] == "k-" and out.first()[1] == 3.0


def test_measures_that_are_no_numbers_count_as_zero(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", "y")], "d string, v string")
    assert shown(pivot(df, ["d"], [], ["v"]), "d", "v") == [("a", 1.0), ("b", 0.0), ("Grand Total", 1.0)]


def test_arguments(spark):
    df = population(spark)
    for bad in [([], [], ["POP"], "SUM"), (["SUMLEV"], [], [], "SUM"), (["SUMLEV"], ["SUMLEV"], ["POP"], "SUM"),
                (["SUMLEV"], [], ["POP"], "MODE"), (["nope"], [], ["POP"], "SUM")]:
        with pytest.raises(ValueError):
            pivot(df, *bad)
    with pytest.raises(ValueError, match="more than 1 columns"):
        pivot_keys(df, ["REGION"], max_columns=1)


def test_headers():
    assert wide_header((), [], "v", 1) == "v"
    assert wide_header(("3",), ["R"], "v", 1) == "R-3"
    assert wide_header((None,), ["R"], "v", 1) == "R-"
    assert wide_header(("a", "b"), ["R", "S"], "v", 2) == "R-a - S-b · v"
    assert wide_header(("a|b", "c"), ["R", "S"], "v", 1) == "R-a|b - S-c"


def test_values_with_bars_keep_columns_of_their_own(spark):
    df = spark.createDataFrame([("x", "a|b", "c", 1.0), ("x", "a", "b|c", 2.0)], "d string, k string, l string, v double")
    row = pivot(df, ["d"], ["k", "l"], ["v"]).first().asDict()
    assert (row["k-a|b - l-c"], row["k-a - l-b|c"], row["GRAND TOTAL"]) == (1.0, 2.0, 3.0)


def test_true_grand_totals(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 5.0), ("b", None, None)], "d string, k string, v double")
    for agg, want in (("AVG", [3.0, 0.0, 3.0]), ("MIN", [1.0, 0.0, 1.0]), ("MAX", [5.0, 0.0, 5.0]), ("SUM", [9.0, 0.0, 9.0]), ("COUNT", [3.0, 1.0, 4.0])):
        assert [r["GRAND TOTAL"] for r in pivot(df, ["d"], ["k"], ["v"], agg, totals="true").collect()] == want, agg


def test_headers_must_not_hide_other_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "d string, ord double")
    with pytest.raises(ValueError, match="already"):
        pivot(df, ["d"], [], ["ord"])


@pytest.mark.parametrize("agg", ["SUM", "AVG", "COUNT"])
def test_many_columns_equal_few(spark, monkeypatch, agg):
    df = spark.range(400).select(
        (F.col("id") % 3).alias("d"), (F.col("id") % 4).alias("e"), F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"), F.lit(1).alias("w"),
    )
    few = pivot(df, ["d", "e"], ["k"], ["v", "w"], agg).drop("ord").collect()
    monkeypatch.setattr("tablescout.operators.pivot.CONDITIONAL_COLUMNS", 0)
    assert pivot(df, ["d", "e"], ["k"], ["v", "w"], agg).drop("ord").collect() == few


def test_long_form(spark):
    out = pivot_long(population(spark), ["SUMLEV", "DIVISION"], ["REGION"], ["POP"])
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [
        ("40", "5", "3", 10.0, 2), ("40", "5", "4", 1.0, 2), ("40", "7", "3", 5.0, 2),
        ("40", None, "3", 15.0, 1), ("40", None, "4", 1.0, 1), (None, None, "3", 15.0, 0), (None, None, "4", 1.0, 0)]))


def test_condition_reaches_the_leaves(spark):
    df = population(spark)
    out = pivot(df, ["SUMLEV"], ["REGION"], ["POP"], condition=F.col("REGION") == "3")
    assert out.columns[:3] == ["SUMLEV", "REGION-3", "GRAND TOTAL"]


def test_collapse(spark):
    dims = ["SUMLEV", "DIVISION"]
    df = population(spark).unionByName(spark.createDataFrame([("50", "1", "3", 2.0)], population(spark).schema))
    out = pivot(df, dims, ["REGION"], ["POP"])
    assert [r["row_kind"] for r in collapse(out, dims, depth=1).collect()] == ["subtotal", "subtotal", "grand"]
    one = collapse(out, dims, nodes=[["40"]]).collect()
    assert [(r["SUMLEV"], r["row_kind"]) for r in one] == [
        ("40", "subtotal"), ("50", "subtotal"), ("50", "detail"), ("", "grand")]
    assert collapse(out, dims).count() == out.count()


def test_formatted_cells(spark):
    cells = formatted_pivot(pivot(population(spark), ["SUMLEV"], [], ["POP"]), ["SUMLEV"], 1).collect()
    assert [tuple(r) for r in cells] == [("40", "16.0", "16.0"), ("Grand Total", "16.0", "16.0")]
