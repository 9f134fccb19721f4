"""Reading and writing delimited files, synthetic rows, file facts."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from tablescout.operators.generate import (
    Bounds,
    Choice,
    ColumnRule,
    Key,
    Literal,
    Moments,
    Numbered,
    generate,
    parse_rule,
    synthesize,
)
from tablescout.operators.grid import page
from tablescout.operators.pivot import pivot
from tablescout.plans.scratch import scratch_folder
from tablescout.plans.source_cases import RULES
from tablescout.sources import delimited, export
from tablescout.sources.dictionary import Dictionary, Field

FIELDS = Dictionary(
    (Field("CODE"), Field("AMT", "Num", "M"), Field("DAY", "Date", "D"), Field("AT", "Datetime", "D"), Field("NOTE")), ("CODE",)
)


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_codes_keep_zeros_and_types_come_from_the_dictionary(spark, tmp_path):
    path = write(tmp_path, "d.txt", 'CODE|AMT|DAY|AT|NOTE\n010|1.5|2024-01-05|2024-01-05 10:00:00|"a|""b"""\n020||||""\n')
    rows = delimited.read_dataset(spark, path, FIELDS, "|").df.orderBy("CODE").collect()
    assert rows[0] == ("010", 1.5, dt.date(2024, 1, 5), dt.datetime(2024, 1, 5, 10), 'a|"b"')
    assert rows[1] == ("020", None, None, None, None)


def test_file_order_of_columns_may_differ(spark, tmp_path):
    path = write(tmp_path, "d.csv", "AMT,CODE,DAY,AT,NOTE\n2,007,,,\n")
    df = delimited.read_dataset(spark, path, FIELDS).df
    assert df.columns[0] == "AMT" and df.first()["CODE"] == "007"


def test_header_mismatch_names_both_sides(spark, tmp_path):
    path = write(tmp_path, "d.csv", "CODE,EXTRA\n1,2\n")
    with pytest.raises(ValueError, match="AMT.*EXTRA"):
        delimited.read_dataset(spark, path, FIELDS)
    with pytest.raises(Exception):
        delimited.read_dataset(spark, str(tmp_path / "absent.csv"), FIELDS)


def test_bad_cells_are_counted_and_their_text_stays(spark, tmp_path):
    path = write(tmp_path, "d.csv", "CODE,AMT,DAY,AT,NOTE\n1,oops,2024-02-30,,\n2,1_000,2024-02-28,x,\n3,,,,\n")
    data = delimited.read_dataset(spark, path, FIELDS)
    rows = {r["CODE"]: r for r in data.df.collect()}
    assert rows["1"]["AMT"] is None and rows["1"]["DAY"] is None and rows["2"]["AMT"] == 1000.0
    assert {r["field"]: (r["null_count"], r["bad_count"]) for r in data.bad_cells().collect()} == {
        "CODE": (0, 0), "AMT": (1, 1), "DAY": (1, 1), "AT": (2, 1), "NOTE": (3, 0)}
    assert {r["CODE"]: r["AMT"] for r in data.raw.collect()} == {"1": "oops", "2": "1_000", "3": None}


def test_tabs_no_header_no_dictionary(spark, tmp_path):
    path = write(tmp_path, "d.tsv", "1\tx\n2\ty\n")
    assert delimited.separator("\\t") == "\t"
    two = Dictionary((Field("A"), Field("B")))
    assert delimited.read_dataset(spark, path, two, "\\t", header=False).df.orderBy("A").first() == ("1", "x")
    plain = delimited.read_dataset(spark, path, None, "\\t")
    assert plain.df.columns == ["1", "x"] and plain.dictionary["1"].role == "D"


def test_reload_replaces_the_view(spark, tmp_path):
    a = delimited.read_dataset(spark, write(tmp_path, "a.csv", "A\n1\n"))
    b = delimited.read_dataset(spark, write(tmp_path, "b.csv", "A\n2\n3\n"))
    a.register("loaded")
    b.register("loaded")
    assert spark.table("loaded").count() == 2
    assert b.save(str(tmp_path / "stored")).df.count() == 2


def test_export_is_sorted_filtered_and_projected(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("K"), (F.col("id") % 7).cast("double").alias("M"), F.lit("x").alias("X"))
    d = Dictionary.of(df, ["M"], ["K"])
    out = str(tmp_path / "out")
    export.export_csv(df, out, d, F.col("K") < 400, [("M", False)], visible=["M"])
    rows = []
    for part in sorted(glob.glob(out + "/part-*")):
        lines = open(part).read().splitlines()
        assert lines[0] == "K,M"
        rows += [line.split(",") for line in lines[1:]]
    want = [[str(k), str(float(k % 7))] for k in sorted(range(400), key=lambda k: (-(k % 7), k))]
    assert rows == want


def test_cells_come_back_as_they_were(spark, tmp_path):
    """Outer blanks, quotes, delimiters and line breaks stay; raw lines tell the empty text from NULL."""
    texts = ["  lead", "trail  ", "a,b", 'say "x"', "two\nlines", " ", "\t", "plain", "'", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").coalesce(1)
    d = Dictionary.of(df, [], ["k"])
    export.export_csv(df, str(tmp_path / "f"), d)
    raw = "".join(open(p, newline="").read() for p in sorted(glob.glob(str(tmp_path / "f") + "/part-*")))
    assert '9,""\n' in raw and "10,\n" in raw and "0,  lead\n" in raw
    back = delimited.read_dataset(spark, str(tmp_path / "f"), d, multiline=True).raw
    assert {int(r["k"]): r["t"] for r in back.collect()} == {i: t or None for i, t in enumerate(texts)}


def test_timestamps_keep_microseconds(spark, tmp_path):
    df = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ'2024-01-01 00:09:58.778549' AS t")
    export.export_csv(df, str(tmp_path / "t"), Dictionary.of(df, [], ["k"]))
    assert spark.read.csv(str(tmp_path / "t"), header=True).first()["t"] == "2024-01-01 00:09:58.778549"


def test_page_as_tabs(spark, tmp_path):
    df = spark.createDataFrame([("a", 1234.5), ("b", None)], "name string, amt double")
    d = Dictionary.of(df, ["amt"], ["name"])
    export.export_tsv(page(df, keys=["name"]), str(tmp_path / "p"), d)
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "p") + "/part-*")))
    assert text.splitlines()[0] == "NAME\tAMT" and "a\t1,234.50" in text


def test_pivot_file(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", 2000.0)], "d string, v double")
    export.export_pivot(pivot(df, ["d"], [], ["v"]), str(tmp_path / "v"), ["d"])
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "v") + "/part-*")))
    assert [ln for ln in text.splitlines() if not ln.startswith("d,")] == [
        'a,"2,000.00","2,000.00"', "b,1.00,1.00", 'Grand Total,"2,001.00","2,001.00"']


def test_file_facts(spark, tmp_path):
    path = write(tmp_path, "loans.txt", "A|B\n" + "1|2\n" * 500)
    row = delimited.file_facts(spark, path, "|").first()
    assert tuple(row) == ("loans.txt", 1, 2004, "1.96 KB", "Plain text (delimited)", "Pipe (|)")
    labels = spark.createDataFrame([("csv",), ("dat",), ("",), ("PQ",)], "e string").select(delimited.format_label(F.col("e")))
    assert [r[0] for r in labels.collect()] == [
        "CSV (delimited text)", "DAT (loaded as delimited text)", "Unknown extension (loaded as delimited text)",
        "Parquet (columnar binary)"]


def test_scratch_folder_follows_the_session(spark, shared_folder):
    a, b = scratch_folder(spark), scratch_folder(spark)
    assert a.startswith(shared_folder + "/") and a != b


# -- synthetic rows ------------------------------------------------------------------------


def rows_of(spark, rules, n=400, seed=5, parts=None):
    return [r.asDict() for r in generate(spark, rules, n, seed, parts).collect()]


def test_unique_numbers(spark):
    rows = rows_of(spark, [ColumnRule("A", "Char", 3, "Unique Number"), ColumnRule("B", "Char", 50, "unique number"), ColumnRule("C", "Num", None, "Unique Number")], 7)
    assert rows[6]["A"] == "007" and rows[0]["B"] == "0" * 49 + "1" and rows[0]["C"] == "0" * 11 + "1"
    with pytest.raises(ValueError, match="do not fit"):
        generate(spark, [ColumnRule("A", "Char", 2, "Unique Number")], 100)
    generate(spark, [ColumnRule("A", "Char", 2, "Unique Number")], 99)


def test_unique_numbers_that_do_not_fit_end_the_job(spark):
    rules = [ColumnRule("A", "Char", 2, "Unique Number")]
    ids = spark.createDataFrame([(8,), (98,)], "id long")
    assert [r["A"] for r in synthesize(ids, rules, 1).collect()] == ["09", "99"]
    with pytest.raises(Exception, match="does not fit"):
        synthesize(spark.createDataFrame([(98,), (99,), (999,)], "id long"), rules, 1).collect()


def test_rules_are_read_once():
    kinds = [
        (ColumnRule("A", "Char", 5, "Unique Number"), Key(5)),
        (ColumnRule("A", "Char", 2, "x, y ,"), Choice(("x", "y"), 2)),
        (ColumnRule("A", "Num", None, ">=1 and <=5 and <b"), Bounds(1.0, 5.0, ("B",))),
        (ColumnRule("A", "Num", None, "< b"), Bounds(0.0, None, ("B",))),
        (ColumnRule("A", "Num", None, "any"), Bounds(1.0, 100_000.0)),
        (ColumnRule("A", "Date", None, "Last Date of the Month"), Moments(True, "month_end")),
        (ColumnRule("A", "Datetime", None, "< B"), Moments(False, "month", ("B",))),
        (ColumnRule("A", "Char", 3, "one"), Literal("one", 3)),
        (ColumnRule("A", "Text", 3, "a < b"), Numbered("A_", 3)),
        (ColumnRule("A", "Blob", 3, ""), Numbered("")),
    ]
    for rule, want in kinds:
        assert parse_rule(rule) == want
    with pytest.raises(ValueError, match="no bound"):
        parse_rule(ColumnRule("A", "Num", None, "> ?"))


def test_same_seed_same_rows_whatever_the_partitions(spark):
    one, eight, other = (rows_of(spark, RULES, 300, s, p) for s, p in [(5, 1), (5, 8), (6, 8)])
    assert sorted(map(str, one)) == sorted(map(str, eight))
    assert one != other


def test_rules_hold_on_every_row(spark):
    rows = rows_of(spark, RULES, 3000)
    states = {r["STATE"] for r in rows}
    assert len(states) == 51
    assert {r["COUNTY"] for r in rows if r["STATE"] == "GA"} <= {"Fulton", "Gwinnett", "Cobb", "DeKalb", "Chatham"}
    assert {r["COUNTY"] for r in rows if r["STATE"] == "WY"} <= {"Central", "North", "South", "East", "West"}
    assert {r["METHOD"] for r in rows} == {"Cash", "Card", "Wire"}
    months = {r["TXN_DT"][:7] for r in rows} | {r["PAY_DT"][:7] for r in rows}
    assert len(months) == 1
    for r in rows:
        assert 100 < int(r["UPB"]) < int(r["LOAN_AMT"]) < 10000 or int(r["LOAN_AMT"]) <= 102
        assert len(r["TXN_DT"]) == len(r["BEG_DT"]) == 19 and r["BEG_DT"] < r["TXN_DT"]
        assert len(r["DUE_DT"]) == 10
        day = dt.date.fromisoformat(r["DUE_DT"])
        assert (day + dt.timedelta(days=1)).day == 1 and 2018 <= day.year <= 2026
        assert r["END_DT"] == "9999-12-31 00:00:00" and r["ACTIVE"] == "A"


def test_caps_literals_and_fallbacks(spark):
    rules = [
        ColumnRule("CAP", "Char", None, "1,000"),
        ColumnRule("LIMIT", "Char", None, "50"),
        ColumnRule("X", "Num", None, ">10 and <limit"),
        ColumnRule("OPEN", "Num", None, ">= 5"),
        ColumnRule("NAME", "Char", 4, ""),
        ColumnRule("OTHER", "Blob", None, ""),
        ColumnRule("D0", "Date", None, "9999-12-31"),
        ColumnRule("END", "Datetime", None, "Last Date of the Month"),
        ColumnRule("FROM", "Char", None, "2020-01-01"),
        ColumnRule("EARLY", "Datetime", None, "any datetime in the month < FROM"),
        ColumnRule("id", "Num", None, ">1 and <9"),
        ColumnRule("UP", "Num", None, ">1 and <ID"),
    ]
    rows = rows_of(spark, rules, 200)
    assert {r["CAP"] for r in rows} == {"1", "000"}
    assert all(10 < int(r["X"]) < 50 for r in rows)
    assert all(5 < int(r["OPEN"]) <= 1_000_005 for r in rows)
    assert rows[0]["NAME"] == "NAME" and rows[4]["OTHER"] == "5" and rows[0]["D0"] == "9999-12-31"
    assert all(r["END"].endswith(" 23:59:59") for r in rows)
    before = [r["EARLY"] for r in rows]
    assert all(len(b) == 19 for b in before)
    assert all(1 < int(r["id"]) < 9 for r in rows)


def test_synthetic_file(spark, tmp_path):
    rules = [ColumnRule("ID", "Char", 5, "Unique Number"), ColumnRule("FLAG", "Char", 1, "A")]
    export.write_synthetic(spark, rules, 3, str(tmp_path / "s"), seed=1, parts=1)
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "s") + "/part-*")))
    assert text.splitlines() == ["ID|FLAG", "00001|A", "00002|A", "00003|A"]
    parts = [open(p).read() for p in sorted(glob.glob(str(tmp_path / "s") + "/part-*"))]
    assert parts[0].splitlines()[0] == "ID|FLAG"
    raw = ColumnRule("RULE", "Char", None, "x|y")
    export.write_synthetic(spark, [raw], 2, str(tmp_path / "c"), seed=1, sep=";")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "c")).collect()) == ["RULE", "x|y", "x|y"]
    with pytest.raises(Exception, match="delimiter"):
        export.write_synthetic(spark, [raw], 2, str(tmp_path / "bad"), seed=1)
    with pytest.raises(ValueError):
        generate(spark, rules, -1)
    assert generate(spark, rules, 0).count() == 0
