"""Casts, texts and formats: the places where engines differ."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import columns, formats
from tablescout.operators.values import key_of


def one(spark, value, dtype, expr):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    return df.select(expr(F.col("v"), dtype).alias("r")).first()["r"]


NUMBERS = [
    "1", " 1 ", "+1", "-2.5", ".5", "5.", "1e3", "1_000", "1__0", "_1", "1_", "1e1_0", "1d", "1f", "1D ", "0x10",
    "inf", "-Infinity", "nan", "", " ", "abc", "true", "1,234", "12-3", "1 0", "\t1", "1\n", "1e400", "e5",
]


def test_text_to_double_agrees_with_sql(spark):
    con = duckdb.connect()
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", columns.safe_double(F.col("v"), T.StringType()).alias("r")).collect()}
    for i, text in enumerate(NUMBERS):
        want = con.execute("SELECT try_cast(? AS DOUBLE)", [text]).fetchall()[0][0]
        assert repr(got[i]) == repr(want), text


@pytest.mark.parametrize("dtype,value", [(T.DateType(), "2024-01-05"), (T.TimestampType(), "2024-01-05 10:00:00")])
def test_dates_are_no_numbers(spark, dtype, value):
    df = spark.sql(f"SELECT CAST('{value}' AS {dtype.simpleString()}) AS v")
    assert df.select(columns.safe_double(F.col("v"), dtype)).first()[0] is None


def test_text_to_timestamp_agrees_with_sql(spark):
    con = duckdb.connect()
    texts = [
        "2024-01-05", "2024-1-5", "2024/01/05", "2024-01-05 10:00", " 2024-01-05 ", "2024", "2024-01", "12:30",
        "12345", "20240105", "2024-13-01", "1/2/2024", "abc", "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    expr = columns.safe_timestamp(F.col("v"), T.StringType()).cast("string").alias("r")
    got = {r["i"]: r["r"] for r in df.select("i", expr).collect()}
    for i, text in enumerate(texts):
        want = con.execute("SELECT CAST(try_cast(trim(?) AS TIMESTAMP) AS VARCHAR)", [text]).fetchall()[0][0]
        assert got[i] == want, text


@pytest.mark.parametrize(
    "x", [0.0, 1.0, 1e7, 123456789.25, 1e15, 1e16, 1.5e20, 1e-3, 1e-4, 1.5e-5, -1e7, 0.1, 9999999.999999998, 1e300]
)
def test_double_text(spark, x):
    assert one(spark, x, T.DoubleType(), columns.text_of) == repr(x)


@pytest.mark.parametrize("x,text", [(1e7, "10000000"), (1.5, "1.5"), (0.0, "0"), (100.0, "100"), (1e-5, "0.00001"), (1.5e20, "150000000000000000000"), (-0.25, "-0.25")])
def test_bin_edges_have_no_exponent(spark, x, text):
    assert one(spark, x, T.DoubleType(), lambda c, t: formats.edge_text(c)) == text


def test_trim_takes_no_break_spaces_but_not_tabs(spark):
    assert one(spark, "  a\t ", T.StringType(), lambda c, t: columns.trim_text(c)) == "a\t"


@pytest.mark.parametrize(
    "value,dtype,want",
    [
        ("2024-05-15", T.StringType(), "20240515"),
        (20240515, T.LongType(), "20240515"),
        (20240515.0, T.DoubleType(), "20240515"),
        ("20240515", T.StringType(), "20240515"),
        ("2024-05-15 10:11:12", T.StringType(), "20240515"),
        (None, T.StringType(), ""),
        ("  ", T.StringType(), ""),
        ("hello", T.StringType(), "hello"),
        (math.nan, T.DoubleType(), ""),
        (math.inf, T.DoubleType(), "—"),
    ],
)
def test_yyyymmdd(spark, value, dtype, want):
    assert one(spark, value, dtype, formats.yyyymmdd) == want


def test_yyyymmdd_of_dates(spark):
    df = spark.sql("SELECT DATE'2024-05-15' AS d, TIMESTAMP'2024-05-15 23:00:00' AS t")
    cells = [formats.yyyymmdd(F.col(c), df.schema[c].dataType) for c in df.columns]
    assert tuple(df.select(*cells).first()) == ("20240515", "20240515")


@pytest.mark.parametrize(
    "value,places,want",
    [(1234.5, 2, "1,234.50"), (None, 2, ""), (math.nan, 2, "—"), (0.125, 2, "0.12"), (1234.125, 2, "1,234.12"),
     (1e6, 0, "1,000,000"), (1.5, 99, "1.5" + "0" * 29), (math.inf, 2, "inf")],
)
def test_measure_format(spark, value, places, want):
    assert one(spark, value, T.DoubleType(), lambda c, t: formats.fmt_measure(c, t, places)) == want


@pytest.mark.parametrize(
    "value,dtype,want",
    [(100.0, T.DoubleType(), "100"), (10.5, T.DoubleType(), "10.5"), (1234567.0, T.DoubleType(), "1234567"),
     ("010", T.StringType(), "10"), ("x", T.StringType(), "x"), (7, T.IntegerType(), "7"), (None, T.StringType(), ""),
     (math.nan, T.DoubleType(), "—"), (0.0, T.DoubleType(), "0"), (True, T.BooleanType(), "1")],
)
def test_dimension_format(spark, value, dtype, want):
    assert one(spark, value, dtype, formats.fmt_dimension) == want


def test_names_with_special_characters(spark):
    df = spark.createDataFrame([(1, 2)], ["a b.c", "sel`ect"])
    assert df.select(columns.qcol("a b.c"), columns.qcol("sel`ect")).first() == (1, 2)


@pytest.mark.parametrize("n,text", [(512, "512 bytes"), (1536, "1.50 KB"), (3 * 1024 * 1024, "3.00 MB"), (-1, "unknown")])
def test_sizes(spark, n, text):
    assert one(spark, n, T.LongType(), lambda c, t: formats.size_text(c)) == text


def test_rounding_by_exact_value(spark):
    """Like Python's round: ties of the digits are decided by the binary value, true ties go to even."""
    rng = random.Random(5)
    given = [2.675, 1.005, 0.125, 0.375, 2.5, 3.5, -2.675, 0.0, -0.0, 1e15, 4503599627370495.5, 9007199254740993.0, 1e300, 5e-324]
    given += [round(rng.uniform(-1e6, 1e6), 4) for _ in range(500)]
    given += [(rng.randrange(-(10**9), 10**9) * 10 + 5) / 10 ** rng.randrange(1, 8) for _ in range(3_000)]
    given += [rng.randrange(-(10**6), 10**6) / 2 ** rng.randrange(1, 12) for _ in range(1_000)]
    df = spark.createDataFrame([(float(x),) for x in given], "x double")
    out = df.select("x", *[formats.round_measure(F.col("x"), n).alias(f"r{n}") for n in (0, 1, 2, 3, 6)]).collect()
    for r in out:
        assert [r[f"r{n}"] for n in (0, 1, 2, 3, 6)] == [round(r.x, n) for n in (0, 1, 2, 3, 6)], r.x


def test_rounding_keeps_what_is_no_finite_number(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    out = [r[0] for r in df.select(formats.round_measure(F.col("x"))).collect()]
    assert math.isnan(out[0]) and out[1:] == [math.inf, -math.inf, None]
    assert df.limit(0).select(formats.round_measure(F.col("x"), 40)).collect() == []


def test_keys_tell_texts_of_any_length_apart(spark):
    """Around the digest's length, in bytes of UTF-8; NULL stays NULL."""
    texts = ["", " ", "a", *[c * n for c in "aé" for n in (15, 16, 17, 30, 31, 32, 33, 5_000)], None]
    df = spark.createDataFrame([(t,) for t in texts * 2], "t string")
    out = df.select(key_of(F.col("t"), T.StringType()).alias("k"), "t").distinct().collect()
    assert len(out) == len(texts) == len({r.k and bytes(r.k) for r in out})
    assert [r.t for r in out if r.k is None] == [None]
    assert all(len(r.k) <= 32 for r in out if r.t is not None)
