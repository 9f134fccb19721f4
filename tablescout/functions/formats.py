"""Display formats: calendar keys, measures, dimensions, bin labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import double_text, exponent_text, is_temporal, plain_digits, safe_double, shift_point, text_of

# The whole numbers that read as a year-month-day key.
FIRST_DAY_KEY, LAST_DAY_KEY = 10000101, 99991231
NOT_A_NUMBER = "—"


def clamp_places(places: int) -> int:
    return max(0, min(30, int(places)))


def yyyymmdd(c: Column, dtype: T.DataType) -> Column:
    """Eight-digit calendar key of a cell; text that is no date stays as it is."""
    if is_temporal(dtype):
        return F.coalesce(F.date_format(c, "yyyyMMdd"), F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(F.initcap(c.cast("string")), F.lit(""))
    text = F.trim(text_of(c, dtype))
    number = safe_double(c, dtype)
    digits = F.regexp_replace(text, r"\D", "")
    fractional = isinstance(dtype, (T.DoubleType, T.FloatType))
    iso = F.when(text.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?$"), text).try_cast("timestamp")
    missing = c.isNull() | (text == "")
    if fractional:
        missing = missing | F.isnan(c)
    return (
        F.when(missing, "")
        .when(F.isnan(number) | number.isin(float("inf"), float("-inf")), NOT_A_NUMBER)
        .when(
            (number == F.floor(number)) & number.between(FIRST_DAY_KEY, LAST_DAY_KEY),
            number.cast("bigint").cast("string"),
        )
        .when(F.length(digits) == 8, digits)
        .otherwise(text if fractional else F.coalesce(F.date_format(iso, "yyyyMMdd"), text))
    )


def _shown(number: Column, plain: Column) -> Column:
    """``plain`` for finite numbers, a dash for NaN, ``inf`` and ``-inf`` for the rest."""
    infinite = F.when(F.isnan(number), NOT_A_NUMBER).when(number > 0, "inf").when(number < 0, "-inf")
    return F.when(F.abs(number) < float("inf"), plain).otherwise(infinite)


def _formatted(c: Column, dtype: T.DataType, plain) -> Column:
    """Cells that are numbers through ``plain``, others as text, NULL as blank."""
    if isinstance(dtype, T.StringType):
        number = safe_double(c, dtype)
        return F.when(c.isNull(), "").when(number.isNotNull(), _shown(number, plain(number))).otherwise(c)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        number = c.cast("double")
        fractional = isinstance(dtype, (T.DoubleType, T.FloatType))
        return F.coalesce(_shown(number, plain(number)) if fractional else plain(number), F.lit(""))
    return F.coalesce(text_of(c, dtype), F.lit(""))


def fmt_measure(c: Column, dtype: T.DataType, places: int = 2) -> Column:
    """Thousands separators and fixed decimals; blank for NULL, a dash for NaN."""
    return _formatted(c, dtype, lambda x: F.format_number(x, clamp_places(places)))


def fmt_dimension(c: Column, dtype: T.DataType, field_type: str | None = None) -> Column:
    """Numbers to at most four decimals without separators; other cells as text."""
    if field_type is not None and "".join(ch for ch in field_type.upper() if ch.isalnum()) == "YYYYMMDD":
        return yyyymmdd(c, dtype)
    if isinstance(dtype, T.IntegralType):
        return F.coalesce(c.cast("string"), F.lit(""))

    def plain(x: Column) -> Column:
        digits = F.translate(F.format_number(x, 4), ",", "")
        return F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))

    return _formatted(c, dtype, plain)


#: 2^27 + 1 splits a double into halves whose products are exact; 10^22 is the last exact power of ten.
SPLITTER, EXACT_POWER = 134217729.0, 22

#: Below this a double has a fraction bit to spare.
WHOLE = float(1 << 52)


def _halves(x: Column) -> tuple[Column, Column]:
    wide = x * F.lit(SPLITTER)
    high = wide - (wide - x)
    return high, x - high


def round_measure(c: Column, places: int = 2) -> Column:
    """A double rounded by its exact binary value, exact ties to even; NaN and infinities stay.

    2.675 lies below the tie its digits show, so it becomes 2.67.  The product with the power of ten
    is split into the rounded product and its exact error, which decides where the product shows a
    tie.  Numbers that have no fraction left at that scale, and more than 22 places, are rounded by
    their shortest digits.
    """
    places = clamp_places(places)
    x = c.cast("double")
    special = F.isnan(x) | (F.abs(x) == float("inf"))
    by_digits = F.bround(x, places)
    if places > EXACT_POWER:
        return F.when(special, x).otherwise(by_digits)
    power = float(10**places)
    size = F.abs(x)
    scaled = size * F.lit(power)
    high, low = _halves(size)
    head = float(power * SPLITTER)
    head = head - (head - power)
    tail = power - head
    error = ((high * F.lit(head) - scaled) + high * F.lit(tail) + low * F.lit(head)) + low * F.lit(tail)
    whole = F.floor(scaled)
    over = (scaled - whole) - F.lit(0.5)
    side = F.when(over != 0, over).otherwise(error)
    up = F.when(side > 0, 1).when(side < 0, 0).otherwise(whole % 2)
    exact = F.signum(x) * ((whole + up).cast("double") / F.lit(power))
    return F.when(special, x).when(scaled < WHOLE, exact).otherwise(by_digits)


def edge_text(x: Column) -> Column:
    """A bin edge in plain digits: no exponent, no trailing zeros."""
    size = F.abs(x)
    plain = F.when((size >= 1e-4) & (size < 1e16) | (size == 0), plain_digits(x)).otherwise(
        shift_point(exponent_text(x))
    )
    finite = F.regexp_replace(plain, r"\.?0*$", "")
    return F.when(F.isnan(x) | (size == float("inf")), double_text(x)).otherwise(finite)


def bin_label(lo: Column, hi: Column) -> Column:
    return F.concat_ws(" - ", edge_text(lo), edge_text(hi))


def size_text(n: Column) -> Column:
    """A byte count as bytes, KB, MB, GB or TB with two decimals."""
    out = F.when(n < 0, "unknown").when(n < 1024, F.concat(F.format_number(n, 0), F.lit(" bytes")))
    for power, unit in enumerate(["KB", "MB", "GB"], start=1):
        scaled = n.cast("double") / float(1024**power)
        out = out.when(scaled < 1024.0, F.format_string(f"%.2f {unit}", scaled))
    return out.otherwise(F.format_string("%.2f TB", n.cast("double") / float(1024**4)))
