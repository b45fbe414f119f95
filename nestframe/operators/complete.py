"""Completion: a value as its type wants it, with what went wrong and where.

A refused value, or a null where none may be, is an error with a path and a null, which goes up to the nearest place
that may be null. What follows a null that goes up, within what it nulls, has no errors of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Container, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestframe.functions.coerce import Coerced
from nestframe.functions.text import quoted

ERROR = "struct<message:string,path:array<string>>"
Coercion = Callable[[Column, str], Coerced]


def none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


@dataclass(frozen=True)
class Leaf:
    """A scalar's or enum's value: how columns of ``kind`` become it (None: as they are)."""

    name: str = "String"
    kind: str = "string"
    coerce: Coercion | None = None


@dataclass(frozen=True)
class ListOf:
    of: object


@dataclass(frozen=True)
class NonNull:
    of: object


def type_text(of: object) -> str:
    """A type as it is written: ``[Line!]``."""
    if isinstance(of, ListOf):
        return f"[{type_text(of.of)}]"
    if isinstance(of, NonNull):
        return f"{type_text(of.of)}!"
    return of.name if isinstance(of, Leaf) else str(of)


def is_subtype(a: str, b: str, possible: Callable[[str], Container[str]] = lambda name: ()) -> bool:
    """Whether every value of the type ``a`` is one of ``b``, both as they are written; ``possible``: the members of an abstract type."""
    if a == b:
        return True
    if b.endswith("!"):
        return a.endswith("!") and is_subtype(a[:-1], b[:-1], possible)
    if a.endswith("!"):
        return is_subtype(a[:-1], b, possible)
    if a.startswith("[") or b.startswith("["):
        return a.startswith("[") and b.startswith("[") and is_subtype(a[1:-1], b[1:-1], possible)
    return a in possible(b)


@dataclass(frozen=True)
class Done:
    """A completed value; its errors (an array, never null; None: it can have none), and whether it is null where its type
    forbids it (None: it can't be)."""

    value: Column
    errors: Column | None = None
    broken: Column | None = None


def raised(message: Column | str, when: Column) -> Column:
    one = F.array(F.struct((F.lit(message) if isinstance(message, str) else message).alias("message"), F.array().cast("array<string>").alias("path")))
    return F.when(F.coalesce(when, F.lit(False)), one.cast(f"array<{ERROR}>")).otherwise(none())


def under(key: Column, errors: Column) -> Column:
    """Errors of what stands under a key or an index."""
    return F.transform(errors, lambda e: F.struct(e["message"].alias("message"), F.concat(F.array(key), e["path"]).alias("path")))


def leaf(of: Leaf, c: Column) -> Done:
    if of.coerce is None:
        return Done(c)
    made = of.coerce(c, of.kind)
    return Done(made.value, None if made.message is None else raised(made.message, made.message.isNotNull()))


def required(done: Done, null: Column, where: str) -> Done:
    """A value that may not be null; ``null`` tells where there was none to begin with."""
    missing = raised(f"Cannot return null for non-nullable field {where}.", null)
    return Done(done.value, missing if done.errors is None else F.when(null, missing).otherwise(done.errors), done.value.isNull())


def fields_of(outs: Mapping[str, Done]) -> tuple[Column | None, Column | None]:
    """Errors of an object's fields, up to the one that nulls the object, and whether one does."""
    broken: Column | None = None
    errors: list[Column] = []
    for key, d in outs.items():
        if d.errors is not None:
            e = under(F.lit(key), d.errors)
            errors.append(e if broken is None else F.when(broken, none()).otherwise(e))
        if d.broken is not None:
            broken = d.broken if broken is None else broken | d.broken
    return (F.concat(*errors) if errors else None), broken


def items_of(values: Column, errors: bool, broken: bool) -> Done:
    """A list of structs (value, errors, broken) as a list: null as a whole where an item is broken, its errors up to that one."""
    if not errors and not broken:
        return Done(F.transform(values, lambda x: x["value"]))
    value, shown = F.transform(values, lambda x: x["value"]), values
    if broken:
        first = F.array_position(F.transform(values, lambda x: x["broken"]), True)
        value = F.when(first == 0, value)
        shown = F.when(first > 0, F.slice(values, F.lit(1), first.cast("int"))).otherwise(values)
    all_errors = F.flatten(F.transform(shown, lambda x, i: under(i.cast("string"), x["errors"])))
    return Done(value, F.coalesce(all_errors, none()))


def item(done: Done) -> Column:
    return F.struct(done.value.alias("value"), (none() if done.errors is None else done.errors).alias("errors"), (F.lit(False) if done.broken is None else done.broken).alias("broken"))


def error_json(errors: Column) -> Column:
    """Errors as JSON; of a path, what is a number is a list's index."""
    step = lambda p: F.when(p.rlike("^[0-9]+$"), p).otherwise(quoted(p))
    path = lambda e: F.array_join(F.transform(e["path"], step), ",")
    one = lambda e: F.concat(F.lit('{"message":'), quoted(e["message"]), F.lit(',"path":['), path(e), F.lit("]}"))
    return F.concat(F.lit("["), F.array_join(F.transform(errors, one), ","), F.lit("]"))


def result_json(data: Column, errors: Column) -> Column:
    """A result as JSON: errors first and only if there are some, nulls kept in the data."""
    keep = {"ignoreNullFields": "false"}
    body = F.to_json(F.struct(data.alias("data")), keep)
    return F.when(F.size(errors) > 0, F.concat(F.lit('{"errors":'), error_json(errors), F.lit(","), F.substring(body, 2, 1 << 30))).otherwise(body)
