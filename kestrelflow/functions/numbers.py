"""Number tests, parsing and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """True for numbers other than NaN and infinities; null for null."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_whole(x: Column) -> Column:
    return x == F.floor(x)


def parsed_number(text: Column) -> Column:
    """A number of a field's text, null if it isn't one; nan and inf are numbers."""
    return text.try_cast("double")


def answer_number(text: Column) -> Column:
    """The non-negative plain number that an answer consists of, white space aside; else NaN."""
    bare = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    return F.when(bare.rlike(r"\A[+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"), bare.try_cast("double")).otherwise(F.lit(float("nan")))


def signed(x: Column, digits: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%+.{digits}f", x))


def significant(x: Column, digits: int = 4) -> Column:
    """x with so many significant digits and no zeros at the end, in scientific form when very small or large."""
    rounded = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.element_at(F.split(rounded, "e"), 2).cast("int")
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    plain = F.lit(None).cast("string")
    for e in range(-4, digits):
        plain = F.when(exponent == e, tidy(F.format_string(f"%.{max(0, digits - 1 - e)}f", x))).otherwise(plain)
    mantissa = tidy(F.element_at(F.split(rounded, "e"), 1))
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(F.isnan(x), "nan").when(~is_finite(x), F.when(x > 0, "inf").otherwise("-inf")).otherwise(
        F.coalesce(plain, F.concat(mantissa, F.lit("e"), power))
    )


def clipped(x: Column) -> Column:
    """x, or 0 if less; a failed prediction (NaN) stays one."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(x, F.lit(0.0)))


def is_sha256(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{64}\z")


def decimal_log(x: Column) -> Column:
    """The decimal logarithm: of zero minus infinity, of a negative number NaN; null for null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log10(x))


def dot(a: Column, b: Column, bias: float | Column = 0.0) -> Column:
    """Inner product of two arrays plus a bias."""
    start = bias if isinstance(bias, Column) else F.lit(float(bias))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), start, lambda s, x: s + x)


def name_number(name: Column) -> Column:
    """The whole number at the end of a name such as sensor_11; null where there is none."""
    return F.regexp_extract(name, r"_([0-9]+)\z", 1).try_cast("int")


def iso_utc(at: Column) -> Column:
    """A UTC time in ISO form with seconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(share: Column) -> Column:
    """A share as percent with one digit."""
    return F.format_string("%.1f%%", 100 * share)


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
