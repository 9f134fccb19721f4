"""Column helpers shared by every operator.

All of them are pure JVM-side expressions, so they stay inside whole-stage
codegen.  They need the Spark type of the column they work on, because a cast
that is harmless on text is an analysis error (date -> double) or means
something else (timestamp -> epoch seconds) on other types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of a truth value, compared after trim and lower.
BOOLEAN_TOKENS = ["0", "1", "f", "false", "n", "no", "t", "true", "y", "yes"]

_NUMERIC = (T.NumericType, T.BooleanType)
_COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def qcol(name: str) -> Column:
    """Column by exact name; dots, spaces and backticks in the name are safe."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + str(name).replace("`", "``") + "`"


def literal_rows(spark, names, rows) -> DataFrame:
    """A table of a few literal rows that needs no Python worker; ``rows`` holds literal tuples."""
    packed = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*packed)))


def type_of(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, [name])
    return df.schema[name].dataType


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}; it has {df.columns}")


def is_complex(dtype: T.DataType) -> bool:
    return isinstance(dtype, _COMPLEX) or dtype.typeName() in ("variant",)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def trim_text(c: Column) -> Column:
    """Strip blanks and no-break spaces from both ends (tabs and newlines stay)."""
    return F.btrim(c, F.lit(" \u00a0"))


def plain_digits(x: Column) -> Column:
    """Digits of a double without an exponent, for sizes from 1e-4 up to 1e16.

    The cast takes the shortest digits that stand for the double; within these sizes
    none of them lie beyond the 21st decimal.
    """
    return F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")


def shift_point(sci: Column) -> Column:
    """Rewrite ``d.ddde[+-]n`` text as plain digits, whatever the exponent."""
    sign = F.when(sci.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(sci, r"e.*$|[-.]", ""), "0+$", "")
    whole = F.regexp_extract(sci, r"e\+?(-?[0-9]+)$", 1).cast("int") + 1
    padded = F.rpad(digits, F.greatest(whole, F.length(digits)), "0")
    big = F.concat(F.substring(padded, F.lit(1), whole), F.lit("."), F.substring(padded, whole + 1, F.length(padded)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), digits)
    return F.concat(sign, F.when(whole > 0, big).otherwise(small))


def exponent_text(x: Column) -> Column:
    """``d.ddde[+-]nn`` with sixteen digits if they stand for the double, else seventeen."""
    short = F.format_string("%.15e", x)
    full = F.when(short.try_cast("double") == x, short).otherwise(F.format_string("%.16e", x))
    return F.regexp_replace(full, r"\.?0*e", "e")


def double_text(x: Column) -> Column:
    """Text of a double: plain digits from 1e-4 up to 1e16, exponent form outside."""
    size = F.abs(x)
    return (
        F.when((size >= 1e-3) & (size < 1e7) | (size == 0), x.cast("string"))
        .when((size >= 1e-4) & (size < 1e16), plain_digits(x))
        .when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(size > 0, exponent_text(x))
    )


def text_of(c: Column, dtype: T.DataType) -> Column:
    """Text form of a scalar cell, the same for every engine that shows it."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.FloatType):
        return double_text(c.cast("string").cast("double"))
    if isinstance(dtype, T.DoubleType):
        return double_text(c)
    return c.cast("string")


# Fixed grammar of a number in text: blanks around it, single underscores between digits.
NUMBER_TEXT = (
    r"(?i)^\s*[-+]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[-+]?\d+(?:_\d+)*)?"
    r"|inf(?:inity)?|nan)\s*\z"
)


def safe_double(c: Column, dtype: T.DataType) -> Column:
    """The cell as a double, NULL where it is not a number.

    Text has to match ``NUMBER_TEXT``; checking first is cheaper than a failing cast.
    Dates and timestamps are never numbers.
    """
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(NUMBER_TEXT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))
    if isinstance(dtype, _NUMERIC):
        return c.cast("double")
    return F.lit(None).cast("double")


def safe_timestamp(c: Column, dtype: T.DataType) -> Column:
    """The cell's text as a timestamp, NULL where it is not a full calendar date."""
    if is_temporal(dtype):
        return c.cast("timestamp")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp")
    text = trim_text(c)
    dashed = F.regexp_replace(text, r"^(\d+)/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    return F.when(text.rlike(r"^\d+[-/]\d{1,2}[-/]\d{1,2}"), dashed).try_cast("timestamp")


def boolean_like(c: Column, dtype: T.DataType) -> Column:
    """True where the non-NULL cell reads as a truth value."""
    if isinstance(dtype, T.BooleanType):
        return F.lit(True)
    if isinstance(dtype, T.IntegralType):
        return c.isin(0, 1)
    if isinstance(dtype, T.StringType):
        return F.lower(trim_text(c)).isin(BOOLEAN_TOKENS)
    if isinstance(dtype, T.DecimalType):
        return c.cast("string").isin("0", "1")
    return F.lit(False)


def finite_or_null(c: Column) -> Column:
    infinite = c.isin(float("inf"), float("-inf"))
    return F.when(~(F.isnan(c) | infinite), c)
