"""Result coercion of columns, and input coercion of argument values.

A result coercion gives two columns: the value (null where it can't be represented) and the message
(null where it can). Built-in functions only: no value leaves the JVM.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestframe.functions.text import quoted, shown
from nestframe.plans.suggest import did_you_mean

INT_MIN, INT_MAX = -(2**31), 2**31 - 1
#: Marks an argument that wasn't given, which differs from null.
UNSET: Any = type("Unset", (), {"__repr__": lambda self: "UNSET", "__bool__": lambda self: False})()


@dataclass(frozen=True)
class Coerced:
    value: Column
    message: Column | None = None  # None: nothing can fail

    def failed(self) -> Column:
        return F.lit(False) if self.message is None else self.message.isNotNull()


#: Forms of numbers in text, and the texts of the messages.
INTEGER = "^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NON_INTEGER, NON_NUMERIC = "not an integer", "not a numeric value"
TOO_LARGE, TOO_SMALL = "value too large for 32-bit signed integer", "value too small for 32-bit signed integer"
INEXACT = "integer that cannot represent with float: out of range"


def _text(c: Column, kind: str) -> Column:
    """A value as messages show it."""
    return quoted(c) if kind == "string" else shown(c.cast("double")) if kind in ("float", "double") else c.cast("string")


def _refused(name: str, c: Column, kind: str, why: str | Column) -> Column:
    return F.concat(F.lit(f"{name} cannot represent "), _text(c, kind), F.lit(": "), F.lit(why) if isinstance(why, str) else why)


def _checked(value: Column, ok: Column, given: Column, message: Column) -> Coerced:
    bad = given.isNotNull() & ~F.coalesce(ok, F.lit(False))
    return Coerced(F.when(~bad, value), F.when(bad, message))


def nullish(c: Column, kind: str) -> Column:
    """NaN is null before any coercion."""
    return F.when(~F.isnan(c), c) if kind in ("float", "double") else c


def to_int(c: Column, kind: str) -> Coerced:
    """32-bit integers: whole numbers in range, booleans as 0 and 1, decimal text."""
    if kind in ("tinyint", "smallint", "int", "boolean"):
        return Coerced(c.cast("int"))
    if kind == "bigint":
        why = F.when(c > INT_MAX, F.lit(TOO_LARGE)).otherwise(F.lit(TOO_SMALL))
        return _checked(c.try_cast("int"), c.between(INT_MIN, INT_MAX), c, _refused("Int", c, kind, why))
    if kind in ("float", "double"):
        c = nullish(c, kind)
        return _checked(F.when(c.between(INT_MIN, INT_MAX), c).cast("long").cast("int"), (c == F.floor(c)) & c.between(INT_MIN, INT_MAX), c, _refused("Int", c, kind, NON_INTEGER))
    return _checked(F.when(c.rlike(INTEGER), c.try_cast("int")), c.rlike(INTEGER) & c.try_cast("int").isNotNull(), c, _refused("Int", c, kind, NON_INTEGER))


def to_float(c: Column, kind: str) -> Coerced:
    """Finite doubles, decimal text; 64-bit integers that a double doesn't hold exactly are refused."""
    if kind in ("float", "double"):
        d = nullish(c, kind).cast("double")
        return _checked(d, F.abs(d) < F.lit(math.inf), d, _refused("Float", d, "double", NON_NUMERIC))
    if kind == "bigint":
        return _checked(c.cast("double"), c.cast("double").cast("decimal(38,0)") == c.cast("decimal(38,0)"), c, _refused("Float", c, kind, INEXACT))
    if kind == "string":
        d = F.when(c.rlike(DECIMAL), c.try_cast("double"))
        # Text of no number is shown as what it names; all else as it is.
        named = F.when(c.rlike(r"(?i)^[+]?inf(inity)?$"), F.lit("+Inf")).when(c.rlike(r"(?i)^-inf(inity)?$"), F.lit("-Inf")).when(c.rlike("(?i)^nan$"), F.lit("NaN"))
        message = F.concat(F.lit("Float cannot represent "), F.coalesce(named, quoted(c)), F.lit(f": {NON_NUMERIC}"))
        return _checked(d, F.abs(d) < F.lit(math.inf), c, message)
    return Coerced(c.cast("int").cast("double") if kind == "boolean" else c.cast("double"))


def to_string(c: Column, kind: str) -> Coerced:
    """Text; doubles by their shortest digits, with an exponent from 1e6 on and below 1e-4."""
    if kind in ("float", "double"):
        return Coerced(shown(nullish(c, kind).cast("double")))
    return Coerced(c.cast("string"))


def to_boolean(c: Column, kind: str) -> Coerced:
    """Booleans, and numbers as unequal to 0."""
    if kind == "boolean":
        return Coerced(c)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return Coerced(c != 0)
    raise TypeError(f"Boolean cannot represent values of type {kind}")


def to_id(c: Column, kind: str) -> Coerced:
    if kind in ("tinyint", "smallint", "int", "bigint", "string"):
        return Coerced(c.cast("string"))
    raise TypeError(f"ID cannot represent values of type {kind}")


def to_datetime(c: Column, kind: str) -> Coerced:
    """A custom scalar: timestamps as ISO 8601 text to the second."""
    return Coerced(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))


def positive_int(c: Column, kind: str) -> Coerced:
    """An alias of Int that refuses numbers below 1."""
    base = to_int(c, kind)
    low = base.value <= 0
    refused = F.when(low, F.concat(F.lit("PositiveInt cannot represent "), base.value.cast("string"), F.lit(": not positive")))
    return Coerced(F.when(~low, base.value), refused if base.message is None else F.coalesce(base.message, refused))


@dataclass(frozen=True)
class Enum:
    """Names with their internal values (a name's own text where none is given)."""

    name: str
    values: Mapping[str, Any]
    deprecated: Mapping[str, str] = field(default_factory=dict)

    def by_value(self, c: Column, kind: str) -> Coerced:
        name = F.lit(None).cast("string")
        for n, v in self.values.items():
            name = F.when(c == F.lit(v), F.lit(n)).otherwise(name)
        return _checked(name, name.isNotNull(), c, self._unknown(c))

    def by_name(self, c: Column, kind: str) -> Coerced:
        return _checked(c, c.isin(list(self.values)), c, self._unknown(c))

    def _unknown(self, c: Column) -> Column:
        return F.concat(F.lit(f'Expected a value of type "{self.name}" but received: '), c.cast("string"))

    def parse(self, value: Any) -> Any:
        if value is None:
            return None
        if not isinstance(value, str) or value not in self.values:
            raise Invalid(f"Expected type {self.name}", did_you_mean(value, self.values).strip() if isinstance(value, str) else "")
        return self.values[value]


Parser = Callable[[Any], Any]


class Invalid(ValueError):
    """A value that an input type refuses: what was expected, where in the value, and why it is refused."""

    def __init__(self, expected: str, why: str = "", path: str = "") -> None:
        self.expected, self.why, self.path = expected, why, path
        super().__init__(expected + (f" at value{path}" if path else "") + (f"; {why}" if why else "."))

    def below(self, step: str) -> Invalid:
        return Invalid(self.expected, self.why, step + self.path)


def _at(step: str, parse: Parser, value: Any) -> Any:
    """What a part of a value is parsed to; a refusal tells which part."""
    try:
        return parse(value)
    except Invalid as e:
        raise e.below(step) from None


def _leaf(name: str, value: Any) -> Invalid:
    return Invalid(f"Expected type {name}", f"{name} cannot represent {json.dumps(value, ensure_ascii=False, default=str)}")


def parse_int(value: Any) -> Any:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int) or not INT_MIN <= value <= INT_MAX:
        raise _leaf("Int", value)
    return value


def parse_float(value: Any) -> Any:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise _leaf("Float", value)
    return float(value)


def parse_string(value: Any) -> Any:
    if value is not None and not isinstance(value, str):
        raise _leaf("String", value)
    return value


def parse_boolean(value: Any) -> Any:
    if value is not None and not isinstance(value, bool):
        raise _leaf("Boolean", value)
    return value


def parse_id(value: Any) -> Any:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int | str):
        raise _leaf("ID", value)
    return str(value)


def parse_list(item: Parser) -> Parser:
    """A list; a single value is a list of one."""

    def parse(value: Any) -> Any:
        if value is None:
            return None
        return [_at(f"[{i}]", item, v) for i, v in enumerate(value)] if isinstance(value, list | tuple) else [item(value)]

    return parse


def required(item: Parser, type_: str = "") -> Parser:
    def parse(value: Any) -> Any:
        if value is None:
            raise Invalid(f"Expected non-nullable type {type_} not to be null".replace("  ", " "))
        return item(value)

    parse.type = type_  # type: ignore[attr-defined]
    return parse


def parse_object(name: str, /, **fields: Any) -> Parser:
    """An input object; a field is a parser, or a parser and a default. A required field without a default has to be given."""
    known = {k: v if isinstance(v, tuple) else (v, UNSET) for k, v in fields.items()}

    def parse(value: Any) -> Any:
        if value is None:
            return None
        if not isinstance(value, Mapping):
            raise Invalid(f"Expected type {name} to be an object")
        if unknown := [k for k in value if k not in known]:
            raise Invalid(f'Field "{unknown[0]}" is not defined by type {name}', did_you_mean(unknown[0], known).strip())
        out = {}
        for k, (item, default) in known.items():
            v = value.get(k, default)
            if v is not UNSET:
                out[k] = _at(f".{k}", item, v)
            elif (type_ := getattr(item, "type", None)) is not None:
                raise Invalid(f"Field value.{k} of required type {type_} was not provided")
        return out

    return parse
