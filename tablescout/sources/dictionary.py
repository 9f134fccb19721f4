"""Data dictionaries: which column is a dimension, which a measure, which the key.

A dictionary is a table of a few dozen rows, so it is parsed by Spark (one job for
a whole directory of dictionaries) and only the finished rows are collected into
the frozen :class:`Dictionary` that the operators take.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol

# Storage type names, role tokens and header spellings.
TEXT_TYPES = ["char", "varchar", "nvarchar", "text", "string", "str", "character", "alpha"]
NUMBER_TYPES = [
    "num", "number", "numeric", "integer", "int", "float", "double", "decimal", "real",
    "bigint", "smallint", "long", "money", "currency",
]
DATE_TYPES = ["date", "datetime", "timestamp", "time"]
DIMENSION_WORDS = [
    "D", "DIM", "DIMENSION", "CHAR", "STRING", "TEXT", "VARCHAR", "VARCHAR2", "NVARCHAR", "NVARCHAR2",
]
MEASURE_WORDS = [
    "M", "MEAS", "MEASURE", "NUM", "NUMBER", "FLOAT", "INT", "INTEGER", "DECIMAL",
    "DATE", "DATETIME", "TIMESTAMP", "TIME",
]
TRUE_WORDS = ["Y", "YES", "TRUE", "1", "T"]
HEADER_WORDS = {
    "name": ["fieldname", "columnname", "name"],
    "is_key": ["primarykey", "pk", "iskey", "key"],
    "field_type": ["fieldtype", "ftype", "semantic", "semantictype"],
    "role": ["datatype", "fielddtype", "dm", "fielddm", "dimensionmeasure", "role"],
    "field_length": ["fieldlength", "length", "flen", "precision"],
    "description": ["fielddescription", "description", "desc", "fielddesc", "comment"],
}
HEADER_LABELS = {
    "name": "Field Name",
    "is_key": "Primary Key",
    "field_type": "FieldType",
    "role": "Datatype",
    "field_length": "Field Length",
    "description": "Field Description",
}
GENERATOR_HEADER_WORDS = {
    "name": ["fieldname", "columnname", "name"],
    "data_type": ["datatype", "type"],
    "field_length": ["fieldlength", "length"],
    "rules": ["rules"],
    "is_key": ["primarykey", "pk"],
}
# Fixed pattern: name|type|length|description|D-or-M, ended by a comma or the line's end.
RECORD = r"([^|,\n\r]+)\|([^|,\n\r]+)\|([^|,\n\r]*)\|([^|,\n\r]+)\|([DM])(?=\s*(?:,|$))"

FIELD_SCHEMA = "ord int, name string, field_type string, field_length string, description string, role string, is_key boolean"


def _token(text: str) -> str:
    return "".join(ch for ch in str(text).strip() if ch.isalnum())


@dataclass(frozen=True)
class Field:
    """One dictionary row; ``role`` is ``D`` (dimension) or ``M`` (measure)."""

    name: str
    field_type: str = "Char"
    role: str = "D"
    field_length: str | None = None
    description: str = ""

    @property
    def kind(self) -> str:
        return _token(self.field_type).upper()

    @property
    def is_display_only(self) -> bool:
        return self.kind == "DISPLAY"

    @property
    def is_calendar_key(self) -> bool:
        return self.kind == "YYYYMMDD"

    @property
    def is_dimension(self) -> bool:
        return not self.is_display_only and (self.is_calendar_key or self.role == "D")

    @property
    def is_measure(self) -> bool:
        return not self.is_display_only and not self.is_calendar_key and self.role == "M"

    @property
    def formats_as_measure(self) -> bool:
        return not self.is_calendar_key and self.role == "M"

    @property
    def shows_as_day(self) -> bool:
        """Quick statistics print this field's values as YYYYMMDD."""
        return self.is_calendar_key or self.kind.lower() in DATE_TYPES

    @property
    def stats_bucket(self) -> str:
        """``char``, ``num`` or ``skip``: which quick statistics apply."""
        if self.is_display_only:
            return "skip"
        if self.shows_as_day or self.kind == "D":
            return "char"
        if self.kind == "M":
            return "num"
        storage = self.field_type.strip().lower()
        if storage in TEXT_TYPES:
            return "char"
        if storage in NUMBER_TYPES:
            return "num"
        return {"D": "char", "M": "num"}.get(self.role, "skip")

    @property
    def spark_type(self) -> T.DataType:
        """Type to read the column with; dimensions keep their leading zeros."""
        storage = self.field_type.strip().lower()
        if storage in NUMBER_TYPES or self.kind == "M":
            parts = (self.field_length or "").replace(" ", "").split(",")
            if len(parts) == 2 and all(p.isdigit() for p in parts) and int(parts[0]) <= 38:
                return T.DecimalType(int(parts[0]), int(parts[1]))
            return T.DoubleType()
        if storage == "date":
            return T.DateType()
        if storage in ("datetime", "timestamp"):
            return T.TimestampType()
        if storage in TEXT_TYPES or storage == "time" or self.kind in ("D", "YYYYMMDD"):
            return T.StringType()
        return T.DoubleType() if self.role == "M" else T.StringType()


@dataclass(frozen=True)
class Dictionary:
    """Ordered fields and the ordered names of the key columns."""

    fields: tuple[Field, ...]
    keys: tuple[str, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        object.__setattr__(self, "keys", tuple(self.keys))
        names = [f.name for f in self.fields]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"duplicate field names in the dictionary: {twice}")
        unknown = [k for k in self.keys if k not in names]
        if unknown:
            raise ValueError(f"key columns that are not fields: {unknown}")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def dimensions(self) -> list[Field]:
        return [f for f in self.fields if f.is_dimension]

    def measures(self) -> list[Field]:
        return [f for f in self.fields if f.is_measure]

    def bucket(self, kind: str) -> list[Field]:
        return [f for f in self.fields if f.stats_bucket == kind]

    def schema(self, order: Sequence[str] | None = None) -> T.StructType:
        """Read schema, with each field's dictionary row in the column metadata."""
        out = T.StructType()
        for name in order or self.names:
            f = self.get(name)
            dtype = f.spark_type if f else T.StringType()
            meta = (
                {"field_type": f.field_type, "length": f.field_length, "desc": f.description, "role": f.role}
                if f
                else {}
            )
            out.add(T.StructField(name, dtype, True, meta))
        return out

    @classmethod
    def of(cls, df: DataFrame, measures: Iterable[str] = (), keys: Iterable[str] = ()) -> Dictionary:
        """Roles for a table that has no dictionary: everything else is a dimension."""
        chosen = set(measures)
        kinds = {T.DateType: "Date", T.TimestampType: "Datetime", T.TimestampNTZType: "Datetime"}
        fields = []
        for sf in df.schema.fields:
            if sf.name in chosen:
                fields.append(Field(sf.name, "Num", "M"))
            else:
                fields.append(Field(sf.name, kinds.get(type(sf.dataType), "Char"), "D"))
        return cls(tuple(fields), tuple(keys))

    @classmethod
    def from_rows(cls, table: DataFrame) -> Dictionary:
        """Collect one parsed dictionary (tens of rows) and check it."""
        problems = [r.asDict() for r in validate_dictionary(table).collect()]
        if problems:
            raise ValueError("; ".join(f"{p['problem']}: {p['detail']}" for p in problems))
        rows = table.orderBy("ord").collect()
        if not rows:
            raise ValueError("the dictionary holds no field rows")
        fields = tuple(
            Field(r["name"], r["field_type"], r["role"], r["field_length"], r["description"] or "") for r in rows
        )
        keyed = [r for r in rows if r["is_key"]]
        if "key_ord" in table.columns:
            keyed.sort(key=lambda r: r["key_ord"])
        return cls(fields, tuple(r["name"] for r in keyed))


def parse_lines(lines: DataFrame, line: str = "line", source: str = "source") -> DataFrame:
    """Field rows from one-line dictionaries: a key list, then the records.

    The text before the first record is the key list, so the last key may run into
    the first record.  Each line yields its fields with ``ord``, ``is_key`` and
    ``key_ord``; keys that name no field come out as rows with a NULL ``field_type``
    so that :func:`validate_dictionary` can report them.
    """
    text = F.trim(qcol(line))
    head = F.regexp_replace(
        F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(RECORD)) - 1), r"[| \t]+$", ""
    )
    keys = F.filter(F.transform(F.split(head, ","), lambda k: F.trim(k)), lambda k: k != "")
    parsed = lines.select(
        qcol(source).alias("source"),
        F.when(F.regexp_instr(text, F.lit(RECORD)) > 0, keys).otherwise(F.array().cast("array<string>")).alias("keys"),
        F.regexp_extract_all(text, F.lit(RECORD), F.lit(0)).alias("records"),
    )
    part = F.split("record", r"\|")

    def piece(i: int) -> Column:
        return F.trim(part.getItem(i))

    rows = parsed.select("source", "keys", F.posexplode("records").alias("ord", "record")).select(
        "source",
        F.col("ord").cast("int").alias("ord"),
        piece(0).alias("name"),
        piece(1).alias("field_type"),
        F.nullif(piece(2), F.lit("")).alias("field_length"),
        piece(3).alias("description"),
        piece(4).alias("role"),
        F.array_contains("keys", piece(0)).alias("is_key"),
        F.nullif(F.array_position("keys", piece(0)).cast("int"), F.lit(0)).alias("key_ord"),
    )
    names = F.transform("records", lambda r: F.trim(F.split(r, r"\|").getItem(0)))
    unmatched = parsed.select("source", F.posexplode(F.array_except("keys", names)).alias("pos", "name")).select(
        "source",
        F.lit(None).cast("int").alias("ord"),
        "name",
        *[F.lit(None).cast("string").alias(c) for c in ("field_type", "field_length", "description", "role")],
        F.lit(True).alias("is_key"),
        F.lit(None).cast("int").alias("key_ord"),
    )
    return rows.unionByName(unmatched)


def parse_field_record(record: str) -> Field:
    """One ``name|type|length|description|D-or-M`` record."""
    parts = [p.strip() for p in record.split("|")]
    if len(parts) != 5:
        raise ValueError(f"a field record has 5 parts, this one has {len(parts)}: {record}")
    if parts[4] not in ("D", "M"):
        raise ValueError(f"a field is D or M, not {parts[4]!r}")
    return Field(parts[0], parts[1], parts[4], parts[2] or None, parts[3])


def read_dictionary_text(spark: SparkSession, path: str) -> DataFrame:
    """Parse every text dictionary under ``path`` in one job, one ``source`` per file.

    Bytes are read as UTF-8, or as Latin-1 where they are not valid UTF-8; the first
    non-empty line counts.
    """
    raw = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(
        F.decode("content", "ISO-8859-1")
    )
    first = F.element_at(
        F.filter(F.split(text, r"\r\n|\n|\r"), lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")) > 0), 1
    )
    return parse_lines(raw.select(F.col("path").alias("source"), first.alias("line")))


def _slots(columns: Sequence[str], words: dict[str, list[str]]) -> dict[str, str]:
    found: dict[str, str] = {}
    for column in columns:
        token = _token(column).lower()
        for slot, spellings in words.items():
            if token in spellings:
                found.setdefault(slot, column)
                break
    return found


def missing_headers(columns: Sequence[str]) -> list[str]:
    """Labels of the required dictionary columns that no header stands for."""
    found = _slots(columns, HEADER_WORDS)
    return [label for slot, label in HEADER_LABELS.items() if slot not in found]


def _cell(name: str) -> Column:
    text = F.trim(qcol(name).cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def _whole(c: Column) -> Column:
    number = c.try_cast("double")
    is_whole = ~F.isnan(number) & (F.abs(number) < 1e15) & (number == F.floor(number))
    return F.when(is_whole, number.cast("bigint").cast("string")).otherwise(c)


def read_dictionary_table(table: DataFrame, order: str | None = None) -> DataFrame:
    """Field rows from a dictionary that is itself a table (CSV, Parquet, ...).

    Headers are matched by meaning, in any order and spelling; the first match of a
    meaning wins.  ``order`` names a column to take the field order from; without it
    rows keep the order in which they were read.
    """
    missing = missing_headers(table.columns)
    if missing:
        raise ValueError(f"dictionary columns missing: {missing}; found: {table.columns}")
    slot = _slots(table.columns, HEADER_WORDS)
    word = F.upper(_cell(slot["role"]))
    place = qcol(order) if order else F.monotonically_increasing_id()
    return (
        table.withColumn("_place", place)
        .select(
            F.col("_place").cast("bigint").alias("ord"),
            _cell(slot["name"]).alias("name"),
            F.coalesce(_cell(slot["field_type"]), F.lit("Char")).alias("field_type"),
            _whole(_cell(slot["field_length"])).alias("field_length"),
            F.coalesce(_cell(slot["description"]), F.lit("")).alias("description"),
            F.when(word.isin(DIMENSION_WORDS), "D").when(word.isin(MEASURE_WORDS), "M").alias("role"),
            F.coalesce(F.upper(_cell(slot["is_key"])).isin(TRUE_WORDS), F.lit(False)).alias("is_key"),
        )
        .filter(F.col("name").isNotNull())
    )


def validate_dictionary(table: DataFrame) -> DataFrame:
    """Problems of parsed dictionary rows as ``(source, problem, detail)``; empty when sound."""
    rows = table if "source" in table.columns else table.withColumn("source", F.lit(""))
    fields = rows.filter(F.col("field_type").isNotNull())
    duplicates = (
        fields.groupBy("source", "name").count().filter("count > 1")
        .select("source", F.lit("duplicate field name").alias("problem"), F.col("name").alias("detail"))
    )
    orphans = (
        rows.filter("is_key").join(fields.select("source", "name"), ["source", "name"], "left_anti")
        .select("source", F.lit("key is not a field").alias("problem"), F.col("name").alias("detail"))
    )
    keyless = (
        rows.groupBy("source").agg(F.max("is_key").alias("any_key")).filter("not any_key")
        .select("source", F.lit("no key column").alias("problem"), F.lit("").alias("detail"))
    )
    roleless = fields.filter(F.col("role").isNull() | ~F.col("role").isin("D", "M")).select(
        "source", F.lit("role is not D or M").alias("problem"), F.col("name").alias("detail")
    )
    return duplicates.unionByName(orphans).unionByName(keyless).unionByName(roleless)


def roles(table: DataFrame) -> DataFrame:
    """Role flags and statistics bucket of every parsed dictionary row."""
    kind = F.upper(F.regexp_replace("field_type", r"[^\p{L}\p{N}]", ""))
    storage = F.lower(F.trim("field_type"))
    display, key = kind == "DISPLAY", kind == "YYYYMMDD"
    day = key | F.lower(kind).isin(DATE_TYPES)
    bucket = (
        F.when(display, "skip")
        .when(day | (kind == "D"), "char")
        .when(kind == "M", "num")
        .when(storage.isin(TEXT_TYPES), "char")
        .when(storage.isin(NUMBER_TYPES), "num")
        .when(F.col("role") == "D", "char")
        .when(F.col("role") == "M", "num")
        .otherwise("skip")
    )
    return table.select(
        "*",
        (~display & (key | (F.col("role") == "D"))).alias("is_dimension"),
        (~display & ~key & (F.col("role") == "M")).alias("is_measure"),
        (~key & (F.col("role") == "M")).alias("formats_as_measure"),
        day.alias("shows_as_day"),
        bucket.alias("stats_bucket"),
    )


def read_generator_spec(table: DataFrame) -> DataFrame:
    """Column rules ``(ord, name, data_type, field_length int, rules, is_key)`` from a table."""
    slot = _slots(table.columns, GENERATOR_HEADER_WORDS)
    missing = [s for s in ("name", "data_type", "rules") if s not in slot]
    if missing:
        raise ValueError(f"generator columns missing: {missing}; found: {table.columns}")
    length = _cell(slot["field_length"]).try_cast("double") if "field_length" in slot else F.lit(None).cast("double")
    key = (
        F.coalesce(F.upper(_cell(slot["is_key"])).isin(TRUE_WORDS), F.lit(False)) if "is_key" in slot else F.lit(False)
    )
    return (
        table.withColumn("_place", F.monotonically_increasing_id())
        .select(
            F.col("_place").alias("ord"),
            _cell(slot["name"]).alias("name"),
            F.coalesce(_cell(slot["data_type"]), F.lit("Char")).alias("data_type"),
            F.when(length > 0, F.bround(length).cast("int")).alias("field_length"),
            F.coalesce(F.trim(qcol(slot["rules"]).cast("string")), F.lit("")).alias("rules"),
            key.alias("is_key"),
        )
        .filter(F.col("name").isNotNull())
    )
