"""Quick statistics, profile, distributions, outliers, duplicates, report."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.operators import distribution, percentiles, profile, quality, quickstats, report, values
from tablescout.sources.dictionary import Dictionary, Field
from tablescout.sources.export import profile_digest


def loans(spark):
    return spark.createDataFrame([("CA", 100.0), ("NY", 200.0), ("CA", 150.0)], "STATE string, LOAN_AMT double")


LOANS = Dictionary((Field("STATE", "D", "D"), Field("LOAN_AMT", "M", "M"), Field("NOTE", "DISPLAY", "D")), ("STATE",))


def test_quick_stats_by_bucket(spark):
    stats = quickstats.quick_stats(loans(spark), LOANS, n=5)
    assert stats["top"].orderBy("rank").first()["value"] == "CA"
    assert stats["num"].first()["max"] == 200.0
    assert {r["field"] for r in stats["nulls"].collect()} == {"STATE", "LOAN_AMT"}


def test_null_count(spark):
    df = spark.createDataFrame([("CA",), (None,), ("NY",)], "STATE string")
    assert quickstats.null_counts(df, ["STATE"]).first()["null_count"] == 1
    assert {r["value"] for r in quickstats.quick_top(df, ["STATE"]).collect()} == {"CA", "NY"}


def test_dates_show_as_eight_digits(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2026, 1, 31),), (d(2026, 1, 31),), (d(2022, 2, 28),)], "DUE_DT date")
    dictionary = Dictionary((Field("DUE_DT", "Date", "D"),))
    top = quickstats.quick_stats(df, dictionary)["top"].orderBy("rank").collect()
    assert [(r["value"], r["cnt"]) for r in top] == [("20260131", 2), ("20220228", 1)]


def test_two_moments_of_a_day_stay_apart_unless_asked(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (1, 2)], "t timestamp")
    assert quickstats.quick_top(df, ["t"], days=["t"]).count() == 2
    assert quickstats.quick_top(df, ["t"], days=["t"], by_day=True).collect()[0]["cnt"] == 2


def test_ties_are_broken_by_value(spark):
    df = spark.createDataFrame([(c,) for c in "dcbaabcd"], "v string")
    assert [r["value"] for r in quickstats.quick_top(df, ["v"], 2).orderBy("rank").collect()] == ["a", "b"]


def test_measures_without_numbers_are_nan(spark):
    df = spark.createDataFrame([("x",), (None,)], "v string")
    row = quickstats.quick_num(df, ["v"]).first()
    assert row["null_count"] == 1 and all(math.isnan(row[c]) for c in ("min", "max", "sum", "mean", "median"))


def test_rounding_of_measures_only(spark):
    rows = [("a", 0, 1.23456, 9.87654, 2.5, 0.125, math.nan), ("b", 0, 1.23456, 9.87654, 2.5, 0.125, math.nan)]
    table = spark.createDataFrame(rows, "field string, null_count long, min double, max double, sum double, mean double, median double")
    dictionary = Dictionary((Field("a", "Num", "M"), Field("b", "Num", "D")))
    a, b = quickstats.round_measures(table, dictionary, 2).orderBy("field").collect()
    assert (a["min"], a["max"]) == (1.23, 9.88) and math.isnan(a["median"])
    assert b["min"] == 1.23456


def test_missing_fields_are_left_out_of_quick_stats(spark):
    dictionary = Dictionary((Field("STATE", "Char", "D"), Field("GONE", "Num", "M")))
    assert set(quickstats.quick_stats(loans(spark), dictionary)) == {"top", "nulls"}


def test_duplicates(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", 2.0), (None, None), (None, None)], "a string, b double")
    row = quality.duplicate_rows(df).first()
    assert (row["total_rows"], row["distinct_full_rows"], row["duplicate_extra_rows"]) == (5, 3, 2)
    keys = quality.duplicate_keys(df, ["a"]).first()
    assert (keys["distinct_keys"], keys["duplicated_keys"]) == (3, 2)
    empty = quality.duplicate_rows(df.limit(0)).first()
    assert (empty["total_rows"], empty["duplicate_pct"]) == (0, 0.0)


def test_measure_profile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "x double")
    row = profile.profile(df, Dictionary((Field("x", "Num", "M"),))).first()
    assert (row["num_mean"], row["num_median"], row["inferred_semantic"]) == (4.0, 2.0, "numeric")


def test_last_row_of_a_distribution_is_the_total(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "a string")
    rows = distribution.value_distribution(df, ["a"]).orderBy("ord").collect()
    assert [(r["kind"], r["label"], r["cnt"]) for r in rows] == [("value", "x", 2), ("value", "y", 1), ("total", "Total", 3)]


def test_others_and_null_values(spark):
    df = spark.createDataFrame([(v,) for v in ["a", "a", "b", None, None, None, "c", "(null)"]], "a string")
    rows = distribution.value_distribution(df, ["a"], top=2).orderBy("ord").collect()
    assert [(r["kind"], r["cnt"]) for r in rows] == [("null", 3), ("value", 2), ("others", 3), ("total", 8)]


def test_distribution_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, x double")
    assert [(r["kind"], r["cnt"]) for r in distribution.value_distribution(df, ["a"]).collect()] == [("total", 0)]
    assert [(r["kind"], r["cnt"]) for r in distribution.bin_distribution(df, ["x"]).collect()] == [("total", 0)]


def test_bins_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(5.0, "1", math.nan), (5.0, "x", 1.0), (None, "3", 2.0)], "same double, text string, nan double"
    )
    rows = distribution.bin_distribution(df, ["same", "text", "nan"], bins=2, top=1).orderBy("field", "ord").collect()
    assert [(r["field"], r["kind"], r["cnt"]) for r in rows] == [
        ("nan", "total", 3),
        ("same", "bin", 2), ("same", "not_numeric", 1), ("same", "total", 3),
        ("text", "bin", 1), ("text", "others", 1), ("text", "not_numeric", 1), ("text", "total", 3),
    ]
    assert rows[1]["label"] == "5 - 5"


@pytest.mark.parametrize("finish_rows", [5, 300])
@pytest.mark.parametrize("shape", ["uniform", "ties", "outlier", "log", "infinite", "huge"])
def test_percentiles_by_narrowing(spark, shape, finish_rows):
    rng = np.random.default_rng(1)
    data = {
        "uniform": rng.uniform(size=3001),
        "ties": np.r_[np.zeros(1500), rng.normal(size=700), np.full(900, 7.0)],
        "outlier": np.r_[rng.uniform(size=2000), [1e18]],
        "log": 10 ** rng.uniform(-300, 300, size=3000),
        "infinite": np.r_[rng.normal(size=900), [np.inf] * 400, [-np.inf] * 30],
        "huge": np.r_[rng.uniform(size=900), -rng.uniform(size=900)] * 1.7e308,
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0]
    got = percentiles.percentile_values(df, ["x"], probs, finish_rows=finish_rows)["x"]
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_percentile_interpolates_and_skips_text(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "v string")
    assert percentiles.percentile_values(df, ["v"], [0.5])["v"] == [1.5]
    assert percentiles.percentile_values(df.filter("v = 'x'"), ["v"], [0.5])["v"] == [None]


def test_outliers_strictly_outside_the_fences(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "x double")
    row = quality.iqr_outliers(df, ["x"]).first()
    assert row["outlier_count"] == 1 and row["outlier_pct"] == pytest.approx(100 / 6)
    assert quality.iqr_outliers(df.limit(0), ["x"]).first()["outlier_count"] is None


@pytest.mark.parametrize(
    "role,field_type,rows,want",
    [
        ("D", "Char", ["Y", "n", "Y"], "boolean"),
        ("D", "Char", ["Y", "n", "maybe"], "string"),
        ("D", "Char", ["2024-01-05"] * 9 + ["x"], "datetime"),
        ("D", "Char", ["2024", "2025", "2026"], "string"),
        ("D", "Num", ["1", "2", "3"], "string"),
        ("M", "Char", ["a", "b", "3"], "mixed"),
        ("M", "Num", ["a", "b", "3"], "numeric"),
        ("M", "Char", ["1", "2", "c"], "numeric"),
    ],
)
def test_semantics(spark, role, field_type, rows, want):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    row = profile.profile(df, Dictionary((Field("v", field_type, role),))).first()
    assert row["inferred_semantic"] == want


def test_missing_and_blank_cells(spark):
    df = spark.createDataFrame([("a",), ("  ",), (None,), ("\t",)], "v string")
    row = profile.base_metrics(df).first()
    assert (row["null_count"], row["empty_count"], row["distinct_count"]) == (1, 1, 3)
    assert row["missing_pct"] == 50.0


def test_zero_and_minus_zero_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (math.nan,), (math.nan,)], "v double")
    assert profile.base_metrics(df).first()["distinct_count"] == 2


def test_complex_columns(spark):
    df = spark.createDataFrame([(1, [1.0])], "a int, e array<double>")
    assert values.scalar_fields(df) == ["a"]
    with pytest.raises(ValueError, match="complex"):
        profile.base_metrics(df, ["e"])
    with pytest.raises(ValueError, match="not in the table"):
        profile.base_metrics(df, ["zzz"])


def test_quick_stats_leave_out_fields_without_plain_values(spark, caplog):
    df = spark.createDataFrame([("a", [1], 2.0)], "k string, l array<int>, x double")
    out = quickstats.quick_stats(df, Dictionary((Field("k"), Field("l"), Field("x", "Num", "M"), Field("gone"))))
    assert {r["field"] for r in out["nulls"].collect()} == {"k", "x"}
    assert "['l']" in caplog.text


def test_patterns(spark):
    cells = [" 2024-01-05 ", "2024-01-05x", "10.0.0.255", "10.0.0.256", "A.b@C.org", "a@b", "a@b.org\n", None]
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    hits = {r["pattern"]: r["hits"] for r in quality.pattern_scan(df).collect()}
    assert hits == {"iso_date": 2, "ipv4": 1, "email": 1}
    assert quality.pattern_total(df).first()[0] == 4


def test_report_labels(spark):
    rows = [(f"k{i}", f"v{i}", float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, x double")
    dictionary = Dictionary((Field("a"), Field("b"), Field("x", "Num", "M")), ("a",))
    row = report.report_of(df, dictionary).first()
    assert row["security_risk"] == "High"
    assert row["primary_characteristic"] == "randomized"
    assert row["highest_cardinality_field"] == "a"
    same = spark.createDataFrame([("a", 1.0)] * 60, "a string, x double")
    d2 = Dictionary((Field("a"), Field("x", "Num", "M")), ("a",))
    row = report.report_of(same, d2).first()
    assert (row["entropy_score"], row["security_risk"], row["primary_characteristic"]) == (0.0, "Low", "unstructured")


def test_report_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, x double")
    row = report.report_of(df, Dictionary((Field("a"), Field("x", "Num", "M")), ("a",))).first()
    assert (row["row_count"], row["completeness_pct"], row["entropy_score"], row["missing_cells"]) == (0, 100.0, 0.0, 0)


def test_digest(spark):
    df = loans(spark)
    full = profile.profile_dataset(df, Dictionary((Field("STATE"), Field("LOAN_AMT", "Num", "M")), ("STATE",)))
    rows = profile_digest(full.fields, full.distributions, full.duplicates).orderBy("ord").collect()
    assert [(r["ord"], r["field"]) for r in rows][:2] == [(-1, None), (0, "STATE")]
    assert rows[0]["digest"] == "Rows: 3; duplicate extra rows: 0 (0.00%)"
    assert rows[1]["digest"].startswith("=== STATE (string, meta Char) ===")
    assert rows[1]["digest"].endswith("  top values: CA:2, NY:1, Total:3")
    assert "  min=100.0 max=200.0 mean=150.0 median=150.0" in "".join(r["digest"] for r in rows)
