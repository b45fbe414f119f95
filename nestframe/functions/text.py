"""Text of names and results, by built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that JSON within HTML may not hold as they are, and their escapes.
HTML_UNSAFE = (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))


def html_safe(json: Column) -> Column:
    """JSON text that can stand within HTML."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), HTML_UNSAFE, json)


def camel_case(name: Column) -> Column:
    """foo_bar as FooBar."""
    parts = F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.array_join(parts, "")


def snake_case(name: Column) -> Column:
    """FooBar as foo_bar."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2"))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of the value, which is computed once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _trimmed(number: Column) -> Column:
    """Digits with a point, without the zeros and the point at their end."""
    return F.rtrim(F.rtrim(number, F.lit("0")), F.lit("."))


def _has_exponent(java: Column) -> Column:
    """Whether a double's text has an exponent: below 1e-3 and from 1e7 on."""
    return F.contains(java, F.lit("E"))


def _scientific(java: Column, width: int) -> Column:
    """Of a double's text with an exponent: the exponent has a sign and ``width`` digits at least."""
    power = F.substring_index(java, "E", -1)
    size = F.ltrim(power, F.lit("-"))
    padded = size if width == 1 else F.when(F.length(size) < width, F.lpad(size, width, "0")).otherwise(size)
    return F.concat(_trimmed(F.substring_index(java, "E", 1)), F.when(F.startswith(power, F.lit("-")), F.lit("e-")).otherwise(F.lit("e+")), padded)


def _plain(java: Column, scale: int) -> Column:
    """Of a double's text with an exponent: plain digits, of which ``scale`` at most follow the point and 38 - ``scale`` at most come before it."""
    return _trimmed(java.try_cast(f"decimal(38,{scale})").cast("string"))


def _of_text(value: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` a double and its text (its shortest digits); each is computed once."""
    return _bound(value, lambda v: _bound(v.cast("string"), lambda java: of(v, java)))


def number(value: Column) -> Column:
    """A double as JSON: with an exponent below 1e-6 and from 1e21 on, plain digits else; null where it isn't finite."""

    def of(v: Column, java: Column) -> Column:
        size = F.abs(v)
        # A double has 17 digits at most: from 1e-6 on they end at the 23rd place after the point, from 1e7 on at the 9th.
        written = F.when((size < F.lit(1e-6)) | (size >= F.lit(1e21)), _scientific(java, 1)).when(size < 1, _plain(java, 24)).otherwise(_plain(java, 10))
        return F.when(F.isnan(v) | (size == F.lit(float("inf"))), F.lit(None)).when(_has_exponent(java), written).otherwise(_trimmed(java))

    return _of_text(value, of)


def shown(value: Column) -> Column:
    """A double as text in messages and strings: with an exponent (of two digits at least) below 1e-4 and from 1e6 on, plain digits else."""

    def of(v: Column, java: Column) -> Column:
        size = F.abs(v)
        written = F.when((size < F.lit(1e-4)) | (size >= 1), _scientific(java, 2)).otherwise(_plain(java, 24))
        # From 1e6 to 1e7 the text has seven digits before the point and no exponent.
        sign, digits = F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.translate(java, "-.", "")
        millions = F.concat(sign, _trimmed(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 1 << 30))), F.lit("e+06"))
        named = F.when(F.isnan(v), F.lit("NaN")).when(v == F.lit(float("inf")), F.lit("+Inf")).when(v == F.lit(float("-inf")), F.lit("-Inf"))
        return named.when(_has_exponent(java), written).when(size >= F.lit(1e6), millions).otherwise(_trimmed(java))

    return _of_text(value, of)


def quoted(value: Column) -> Column:
    """Text as a JSON string."""
    whole = F.to_json(F.struct(value.alias("s")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)
