import pytest

from tablescout.sources import dictionary as meta
from tablescout.sources.dictionary import Dictionary, Field

HEADERS = ["Field Name", "Primary Key", "FieldType", "Datatype", "Field Length", "Field Description"]


def parse(spark, *lines):
    rows = [(str(i), line) for i, line in enumerate(lines)]
    return meta.parse_lines(spark.createDataFrame(rows, "source string, line string"))


def test_key_list_runs_into_the_first_record(spark):
    table = parse(spark, "SUMLEV,REGION|SUMLEV|Char|3|Level|D,REGION|Char|50|REGION|D,POP|Num||Base|M")
    d = Dictionary.from_rows(table)
    assert d.keys == ("SUMLEV", "REGION")
    assert d.names == ["SUMLEV", "REGION", "POP"]
    assert d["POP"].field_length is None and d["POP"].role == "M"


def test_description_that_starts_with_a_role_letter(spark):
    table = parse(spark, "SUMLEV,DIVISION|SUMLEV|Char|3|Division code|D,DIVISION|Char|2|Mountain|D")
    assert Dictionary.from_rows(table).names == ["SUMLEV", "DIVISION"]


def test_key_that_is_no_field_is_reported(spark):
    table = parse(spark, "SUMLEV,REGION,DIVISION|SUMLEV|Char|3|Level|D,REGION|Char|50|REGION|D")
    with pytest.raises(ValueError, match="DIVISION"):
        Dictionary.from_rows(table)


def test_no_key_and_duplicates_are_reported(spark):
    table = parse(spark, "|A|Char|3|x|D,A|Char|3|y|D")
    problems = {r["problem"] for r in meta.validate_dictionary(table).collect()}
    assert problems == {"no key column", "duplicate field name"}


def test_field_record():
    assert meta.parse_field_record("ESTIMATESBASE2020|Num||Base|M").field_length is None
    with pytest.raises(ValueError):
        meta.parse_field_record("a|b|c")
    with pytest.raises(ValueError):
        meta.parse_field_record("a|Char|1|x|Z")


def test_files_in_two_encodings(spark, tmp_path):
    (tmp_path / "a_Meta").write_text("\n\nA|A|Char|3|Größe|D\n", encoding="utf-8")
    (tmp_path / "b_Meta").write_bytes("B|B|Num|3|Größe|M".encode("latin-1"))
    rows = meta.read_dictionary_text(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r["name"], r["description"], r["role"]) for r in rows] == [("A", "Größe", "D"), ("B", "Größe", "M")]


def table_of(spark, rows, headers=HEADERS):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in headers)).coalesce(1)


def test_table_in_any_column_order(spark):
    rows = [("", "D", "A", "Y", "Char", "a"), ("10.0", "M", "B", "N", "Num", "b"), ("", "D", "C", "yes", "Char", None)]
    headers = ["Field Length", "Datatype", "Field Name", "Primary Key", "FieldType", "Field Description"]
    d = Dictionary.from_rows(meta.read_dictionary_table(table_of(spark, rows, headers)))
    assert d.keys == ("A", "C")
    assert d["B"] == Field("B", "Num", "M", "10", "b")
    assert d["C"].field_length is None


def test_table_synonyms(spark):
    rows = [("A", "Y", "", "String", "", ""), ("B", "", "", "Varchar2", "", ""), ("DUE", "", "Date", "Datetime", "", ""),
            (" ", "", "", "D", "", ""), ("X", "", "", "what", "", "")]
    table = meta.read_dictionary_table(table_of(spark, rows))
    assert [(r["name"], r["role"], r["field_type"]) for r in table.orderBy("ord").collect()] == [
        ("A", "D", "Char"), ("B", "D", "Char"), ("DUE", "M", "Date"), ("X", None, "Char")]
    with pytest.raises(ValueError, match="X"):
        Dictionary.from_rows(table)


def test_missing_headers(spark):
    assert meta.missing_headers(["Field Name", "Datatype"]) == [
        "Primary Key", "FieldType", "Field Length", "Field Description"]
    with pytest.raises(ValueError, match="Primary Key"):
        meta.read_dictionary_table(table_of(spark, [("A", "D")], ["Field Name", "Datatype"]))


ROLES = [
    (Field("a", "DISPLAY", "D"), False, False, "skip", False),
    (Field("b", "display", "M"), False, False, "skip", True),
    (Field("c", "YYYYMMDD", "M"), True, False, "char", False),
    (Field("d", "D", "D"), True, False, "char", False),
    (Field("e", "M", "M"), False, True, "num", True),
    (Field("f", "Date", "D"), True, False, "char", False),
    (Field("g", "Datetime", "M"), False, True, "char", True),
    (Field("h", "integer", "D"), True, False, "num", False),
    (Field("i", "whatever", "M"), False, True, "num", True),
]


@pytest.mark.parametrize("f,dim,measure,bucket,formats", ROLES)
def test_roles(f, dim, measure, bucket, formats):
    assert (f.is_dimension, f.is_measure, f.stats_bucket, f.formats_as_measure) == (dim, measure, bucket, formats)


def test_roles_as_columns(spark):
    df = spark.createDataFrame([(f.name, f.field_type, f.role) for f, *_ in ROLES], "name string, field_type string, role string")
    got = [
        (r["is_dimension"], r["is_measure"], r["stats_bucket"], r["formats_as_measure"])
        for r in meta.roles(df).orderBy("name").collect()
    ]
    assert got == [tuple(r[1:]) for r in ROLES]


def test_types():
    assert Field("a", "Char", "D").spark_type.simpleString() == "string"
    assert Field("a", "Num", "M", "10").spark_type.simpleString() == "double"
    assert Field("a", "Num", "M", "12,2").spark_type.simpleString() == "decimal(12,2)"
    assert Field("a", "Date", "M").spark_type.simpleString() == "date"
    assert Field("a", "Time", "M").spark_type.simpleString() == "string"
    assert Field("a", "YYYYMMDD", "M").spark_type.simpleString() == "string"


def test_generator_spec(spark):
    df = spark.createDataFrame(
        [("A", "Char", "3.0", "Unique Number", "Y"), (None, "Char", "1", "x", ""), ("B", None, "0", None, "")],
        "`Field Name` string, Datatype string, `Field Length` string, Rules string, `Primary Key` string",
    ).coalesce(1)
    rows = meta.read_generator_spec(df).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in rows] == [("A", "Char", 3, "Unique Number", True), ("B", "Char", None, "", False)]
    with pytest.raises(ValueError, match="rules"):
        meta.read_generator_spec(df.drop("Rules"))


def test_column_metadata_carries_the_dictionary():
    schema = Dictionary((Field("a", "Char", "D", "3", "text"),), ("a",)).schema()
    assert schema["a"].metadata == {"field_type": "Char", "length": "3", "desc": "text", "role": "D"}
