"""Nested selections over tables that are linked by keys, as one DataFrame plan.

Objects become structs, lists arrays, relationships left joins on a child that is nested before it is
joined, arguments filters on the child's table, abstract types tagged unions. Objects, lists and lists of lists that
a column holds are selected into in place. What isn't selected
isn't read: a plan projects the columns that the selection names and nothing else.
"""

from __future__ import annotations

import json as js
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestframe.functions.coerce import UNSET, Coerced, Parser
from nestframe.operators.complete import Coercion, Done, Leaf, ListOf, NonNull, fields_of, is_subtype, item, items_of, leaf, none, raised, required, result_json
from nestframe.plans.suggest import did_you_mean


@dataclass(frozen=True)
class Arg:
    """An argument: its parser, its default where it isn't given, and its type as it is written."""

    parse: Parser
    default: Any = UNSET
    required: bool = False
    type: str = "String"


@dataclass(frozen=True)
class Field:
    """A column, an expression of what is known of the field (``Info``), which may fail by a message of its own (``Coerced``), or, without a source, what the
    default resolver gives.

    ``of`` is the type of what it holds: leaves, embedded objects by their type's name, lists and non-null types of these. Where it
    isn't given, the field is a leaf by ``coerce``, ``kind`` and ``type_name``."""

    source: str | Callable[[Info], Column | Coerced] | None = None
    coerce: Coercion | None = None
    kind: str = ""
    non_null: bool = False
    type_name: str = "String"
    args: Mapping[str, Arg] = field(default_factory=dict)
    deprecated: str | None = None
    of: Any = None


@dataclass(frozen=True)
class Edge:
    """A relationship: the child whose ``theirs`` equals our ``ours`` (unique in the child, unless ``many``).

    ``keys`` says that ours is an array of keys, in whose order the children come, null where a key has none.
    ``order`` are the child's columns by which a list is sorted, ties by the items themselves. Where the target is abstract and its
    members have tables of their own, ``theirs`` and ``order`` are by member. ``non_null`` and ``item_non_null`` say what may not be null."""

    target: str
    ours: str
    theirs: str | Mapping[str, str]
    many: bool = False
    keys: bool = False
    order: Sequence[str] | Mapping[str, Sequence[str]] = ()
    args: Mapping[str, Arg] = field(default_factory=dict)
    where: Callable[[DataFrame, Mapping[str, Any]], DataFrame] | None = None
    non_null: bool = False
    deprecated: str | None = None
    item_non_null: bool = False


@dataclass(frozen=True)
class ObjectType:
    name: str
    table: Callable[[], DataFrame]
    fields: Mapping[str, Field | Edge]
    interfaces: Sequence[str] = ()
    key: str = ""  # the column that tells its rows apart, for ordered lookups
    description: str | None = None


@dataclass(frozen=True)
class AbstractType:
    """A union's or interface's members. They have tables of their own, or share ``table`` or a column's values; then ``resolve`` gives
    the member's name for each (with a message of its own, if it fails)."""

    name: str
    members: Sequence[str]
    resolve: Callable[[Info], Column | Coerced] | None = None
    table: Callable[[], DataFrame] | None = None


@dataclass(frozen=True)
class Pick:
    """A selected field; its response key is the alias or the name."""

    name: str
    children: tuple[Pick | Spread, ...] = ()
    alias: str | None = None
    args: Mapping[str, Any] = field(default_factory=dict)
    skip: Any = False
    include: Any = True

    @property
    def key(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Spread:
    """A fragment in place: its selections apply where the object is of the type ``on`` (None: always)."""

    children: tuple[Pick | Spread, ...]
    on: str | None = None
    skip: Any = False
    include: Any = True


@dataclass(frozen=True)
class Variable:
    """Stands for a value given at run time, or for its default; ``parse`` and ``type`` (as it is written) are those of its declaration."""

    name: str
    default: Any = UNSET
    parse: Parser | None = None
    type: str = ""


class Info(dict):
    """What a field's expression may look at: its arguments (as a mapping), the object's columns, and where it stands."""

    def __init__(self, args: Mapping[str, Any], column: Callable[[str], Column], selector: Selector, type_name: str, pick: Pick, parent: Info | None) -> None:
        super().__init__(args)
        self.column, self.selector, self.type_name, self.pick, self.parent = column, selector, type_name, pick, parent

    @property
    def path(self) -> tuple[str, ...]:
        """Response keys from the root; places in lists are not known before a job runs."""
        return (*(() if self.parent is None else self.parent.path), self.pick.key)

    @property
    def variables(self) -> Mapping[str, Any]:
        return self.selector.variables

    @property
    def schema(self) -> Schema:
        return self.selector.schema

    def selected(self, type_: str | None = None) -> tuple[str, ...]:
        """The names of the fields selected below this one, for a type or those named in place."""
        if type_ is not None:
            return tuple(p.name for p in self.selector.collect(type_, self.pick.children).values())
        return tuple(p.name for p in self.pick.children if isinstance(p, Pick) and self.selector.on(p))


@dataclass(frozen=True)
class ByName:
    """The default resolver: a field's column has its name, after ``prefix`` and, if ``snake``, in lower case with underscores."""

    prefix: str = ""
    snake: bool = False

    def __call__(self, info: Info) -> Column:
        name = re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", info.pick.name).lower() if self.snake else info.pick.name
        return info.column(self.prefix + name)


def pick(name: str, /, *children: Pick | Spread, alias: str | None = None, skip: Any = False, include: Any = True, **args: Any) -> Pick:
    return Pick(name, children, alias, args, skip, include)


def spread(*children: Pick | Spread, on: str | None = None, skip: Any = False, include: Any = True) -> Spread:
    return Spread(children, on, skip, include)


class SelectionError(ValueError):
    """A selection that the schema doesn't allow."""


@dataclass(frozen=True)
class Directive:
    """A directive's places and its arguments' types and defaults."""

    name: str
    locations: Sequence[str]
    args: Mapping[str, tuple[str, Any]] = field(default_factory=dict)
    description: str | None = None


#: The directives that every schema has.
STANDARD = (
    Directive("skip", ("FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"), {"if": ("Boolean!", UNSET)}, "Directs the executor to skip this field or fragment when the `if` argument is true."),
    Directive("include", ("FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"), {"if": ("Boolean!", UNSET)}, "Directs the executor to include this field or fragment only when the `if` argument is true."),
    Directive("deprecated", ("FIELD_DEFINITION", "ENUM_VALUE"), {"reason": ("String", "No longer supported")}, "Marks an element of a GraphQL schema as no longer supported."),
)


@dataclass
class Schema:
    """Types by name; input objects' fields as (type, default); directives; root types by the kind of operation."""

    types: dict[str, ObjectType | AbstractType]
    inputs: Mapping[str, Mapping[str, tuple[str, Any]]] = field(default_factory=dict)
    directives: Sequence[Directive] = STANDARD
    roots: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, *types: ObjectType | AbstractType, **more: Any) -> Schema:
        named: dict[str, ObjectType | AbstractType] = {}
        for t in types:
            if t.name in named:
                raise SelectionError(f"Schema must contain unique named types but contains multiple types named {t.name!r}")
            named[t.name] = t
        return cls(named, **more)

    def possible(self, name: str) -> set[str]:
        """The object types that a type's value can be."""
        t = self.types.get(name)
        if t is None:
            raise SelectionError(f"Unknown type {name!r}.{did_you_mean(name, self.types)}")
        if isinstance(t, AbstractType):
            return set(t.members)
        return {name}

    def subtype(self, a: str, b: str) -> bool:
        """Whether a value of the type ``a`` can stand where ``b`` is wanted, both as they are written."""
        return is_subtype(a, b, lambda name: self.possible(name) if isinstance(self.types.get(name), AbstractType) else ())

    def is_a(self, name: str, condition: str) -> bool:
        return name in self.possible(condition) or condition in getattr(self.types[name], "interfaces", ())


class Selector:
    """Compiles selections against a schema; ``variables`` are the values of Variables, ``default`` resolves fields without a source."""

    def __init__(self, schema: Schema, variables: Mapping[str, Any] | None = None, default: Callable[[Info], Column] = ByName()) -> None:
        self.schema, self.variables, self.default, self.made = schema, dict(variables or {}), default, 0

    def value(self, given: Any) -> Any:
        if isinstance(given, Variable):
            return self.variable(given)
        if isinstance(given, list):
            return [None if (v := self.value(x)) is UNSET else v for x in given]
        if isinstance(given, dict):
            return {k: v for k, x in given.items() if (v := self.value(x)) is not UNSET}
        return given

    def variable(self, v: Variable) -> Any:
        value = self.variables.get(v.name, v.default)
        if v.type.endswith("!") and (value is UNSET or value is None):
            raise SelectionError(f'Variable "${v.name}" of required type "{v.type}" was not provided.' if value is UNSET else f'Variable "${v.name}" of non-null type "{v.type}" must not be null.')
        if v.parse is None or value is UNSET:
            return value
        try:
            v.parse(value)
        except ValueError as e:
            raise SelectionError(f'Variable "${v.name}" got invalid value {js.dumps(value, default=str)}; {e}') from None
        return value  # the argument's own parser makes of it what it needs

    def on(self, p: Pick | Spread) -> bool:
        return bool(self.value(p.include)) and not self.value(p.skip)

    def collect(self, type_: str, picks: Sequence[Pick | Spread]) -> dict[str, Pick]:
        """Selected fields of an object type by response key, in order; equal keys are merged, their children joined."""
        out: dict[str, Pick] = {}
        for p in picks:
            if not self.on(p):
                continue
            found = list(self.collect(type_, p.children).values()) if isinstance(p, Spread) and (p.on is None or self.schema.is_a(type_, p.on)) else [p] if isinstance(p, Pick) else []
            for q in found:
                if (old := out.get(q.key)) is None:
                    out[q.key] = q
                elif (old.name, dict(old.args)) != (q.name, dict(q.args)):
                    raise SelectionError(f"Fields {q.key!r} conflict because {old.name} and {q.name} are different fields or have differing arguments. Use different aliases on the fields to fetch both if this was intentional.")
                else:
                    out[q.key] = Pick(old.name, old.children + q.children, old.alias, old.args)
        return out

    def arguments(self, owner: str, known: Mapping[str, Arg], given: Mapping[str, Any]) -> dict[str, Any]:
        for name in given:
            if name not in known:
                raise SelectionError(f"Unknown argument {name!r} on field {owner}.{did_you_mean(name, known)}")
        out = {}
        for name, arg in known.items():
            v = self.value(given[name]) if name in given else UNSET
            v = arg.default if v is UNSET else v
            if v is UNSET or v is None and arg.required:
                if arg.required:
                    raise SelectionError(f"Argument {name!r} of {owner} is required, but it was not provided.")
                continue
            try:
                out[name] = arg.parse(v)
            except ValueError as e:
                raise SelectionError(f"Argument {name!r} of {owner} has invalid value {v!r}: {e}") from None
        return out

    def _fresh(self) -> str:
        self.made += 1
        return f"__k{self.made}"

    def fields(self, type_: str, picks: Sequence[Pick | Spread], df: DataFrame | None, column: Callable[[str], Column] = F.col, parent: Info | None = None) -> tuple[DataFrame | None, dict[str, Done]]:
        """The frame with what the selection needs joined to it, and each response key's value. An embedded object has no frame (None)."""
        owner = self.schema.types[type_]
        out: dict[str, Done] = {}
        for key, p in self.collect(type_, picks).items():
            if p.name == "__typename":
                out[key] = Done(F.lit(type_))
                continue
            f = owner.fields.get(p.name)
            if f is None:
                raise SelectionError(f"Cannot query field {p.name!r} on type {type_!r}.{did_you_mean(p.name, owner.fields)}")
            where = f"{type_}.{p.name}"
            info = Info(self.arguments(where, f.args, p.args), column, self, type_, p, parent)
            if isinstance(f, Edge):
                if not p.children:
                    raise SelectionError(f"Field {p.name!r} of type {f.target!r} must have a selection of subfields.")
                if df is None:
                    raise SelectionError(f"Field {p.name!r} is a relationship of the type's table and can't be selected in an embedded {type_!r}.")
                df, out[key] = self.edge(owner, f, p, info, df, where)
                continue
            kind = f.kind or (dict(df.dtypes).get(f.source, "string") if df is not None else "string")
            of = f.of or Leaf(f.type_name, kind, f.coerce)
            of = NonNull(of) if f.non_null and not isinstance(of, NonNull) else of
            c = column(f.source) if isinstance(f.source, str) else (f.source or self.default)(info)
            listed = of.of if isinstance(of, NonNull) else of
            if isinstance(listed, ListOf) and isinstance(f.source, str) and df is not None and not dict(df.dtypes).get(f.source, "array").startswith("array"):
                # The column holds no list, whatever its rows are.
                out[key] = Done(F.lit(None).cast("string"), raised(f"Expected Iterable, but did not find one for field {where}.", c.isNotNull()), F.lit(True) if of is not listed else None)
                continue
            out[key] = self.complete(of, c, where, info) if not isinstance(c, Coerced) else self.failing(of, c, where, info)
        return df, out

    def failing(self, of: Any, c: Coerced, where: str, info: Info) -> Done:
        """The value of a resolver that may fail: where it has a message, that is the field's only error, and its value null."""
        done = self.complete(of, c.value, where, info)
        if c.message is None:
            return done
        value = F.when(c.message.isNull(), done.value)
        errors = F.when(c.message.isNotNull(), raised(c.message, F.lit(True))).otherwise(none() if done.errors is None else done.errors)
        return Done(value, errors, value.isNull() if isinstance(of, NonNull) else None)

    def complete(self, of: Any, c: Column, where: str, info: Info) -> Done:
        """A column's value as its type wants it."""
        if isinstance(of, NonNull):
            inner = of.of
            null = c.isNull() | F.isnan(c) if isinstance(inner, Leaf) and inner.kind in ("float", "double") else c.isNull()
            return required(self.complete(inner, c, where, info), null, where)
        if isinstance(of, ListOf):
            made: list[Done] = []

            def one(x: Column) -> Column:
                made.append(self.complete(of.of, x, where, info))
                return item(made[-1])

            values = F.transform(c, one)
            return items_of(values, made[0].errors is not None, made[0].broken is not None)
        if isinstance(of, Leaf):
            if info.pick.children:
                raise SelectionError(f"Field {info.pick.name!r} must not have a selection since it has no subfields.")
            return leaf(of, c)
        if not info.pick.children:
            raise SelectionError(f"Field {info.pick.name!r} of type {of!r} must have a selection of subfields.")
        at = lambda name: c[name]
        if isinstance(self.schema.types.get(of), AbstractType):
            known = Info(info, at, self, of, info.pick, info.parent)
            _, outs, extra = self.resolved(self.schema.types[of], info.pick.children, None, at, known, where, c)
            errors, broken = fields_of(outs)
            errors = extra if errors is None else F.concat(extra, errors)
            ok = c.isNotNull() & (F.size(extra) == 0)
        else:
            _, outs = self.fields(of, info.pick.children, None, at, info)
            errors, broken = fields_of(outs)
            ok = c.isNotNull()
        ok = ok if broken is None else ok & ~broken
        return Done(F.when(ok, F.struct(*[d.value.alias(k) for k, d in outs.items()])), None if errors is None else F.when(c.isNotNull(), errors).otherwise(none()))

    def resolved(self, t: AbstractType, picks: Sequence[Pick | Spread], df: DataFrame | None, at: Callable[[str], Column], info: Info | None, where: str, c: Column | None = None) -> tuple[DataFrame | None, dict[str, Done], Column]:
        """The values of an abstract type's rows or column, by what ``resolve`` says each is, and the errors of those that are nothing it can be."""
        there = F.lit(True) if c is None else c.isNotNull()
        shown = F.lit("of its row") if c is None else F.to_json(c)
        if t.resolve is None:
            text = F.concat(F.lit(f"Abstract type {t.name} must provide resolver to resolve to an Object type at runtime for field {where} with value "), shown)
            return df, {"__typename": Done(F.lit(None).cast("string"))}, raised(text, there)
        said = t.resolve(info if info is not None else Info({}, at, self, t.name, Pick(t.name, tuple(picks)), None))
        said = said if isinstance(said, Coerced) else Coerced(said)
        text = F.when(said.value.isNull(), F.concat(F.lit(f"Abstract type {t.name} must resolve to an Object type at runtime for field {where} with value "), shown, F.lit(", received nil.")))
        text = text.when(~said.value.isin(list(t.members)), F.concat(F.lit('Runtime Object type "'), said.value, F.lit(f'" is not a possible type for "{t.name}".')))
        text = text if said.message is None else F.coalesce(said.message, text)
        by: dict[str, list[tuple[str, Done]]] = {}
        for m in t.members:
            df, outs = self.fields(m, picks, df, at, info)
            for key, d in outs.items():
                by.setdefault(key, []).append((m, d))

        def of_member(parts: list[tuple[str, Column | None]], rest: Column | None) -> Column | None:
            """The part of the member that a value is; ``rest`` for others."""
            if all(x is None for _, x in parts):
                return None
            chosen = None
            for m, x in parts:
                if x is not None:
                    chosen = F.when(said.value == m, x) if chosen is None else chosen.when(said.value == m, x)
            return chosen if rest is None else chosen.otherwise(rest)

        out = {key: Done(of_member([(m, d.value) for m, d in parts], None), of_member([(m, d.errors) for m, d in parts], none()), of_member([(m, d.broken) for m, d in parts], F.lit(False))) for key, parts in by.items()}
        return df, out, raised(text, there & text.isNotNull())

    def nested(self, type_: str, picks: Sequence[Pick | Spread], df: DataFrame, keep: Mapping[str, str], where: str = "", info: Info | None = None) -> tuple[DataFrame, bool]:
        """``item``, a struct (value and, if there can be some, errors) of the selection for each row, and columns to keep under new names; and whether there can be errors."""
        t = self.schema.types[type_]
        if isinstance(t, AbstractType):
            df, outs, extra = self.resolved(t, picks, df, F.col, None, where)
            errors, broken = fields_of(outs)
            errors, ok = extra if errors is None else F.concat(extra, errors), F.size(extra) == 0
        else:
            df, outs = self.fields(type_, picks, df, parent=info)
            errors, broken = fields_of(outs)
            ok = F.lit(True)
        ok = ok if broken is None else ok & ~broken
        value = F.when(ok, F.struct(*[d.value.alias(k) for k, d in outs.items()]))
        return df.select(self._item(value, errors).alias("item"), *[F.col(a).alias(b) for a, b in keep.items()]), errors is not None

    @staticmethod
    def _item(value: Column, errors: Column | None) -> Column:
        return F.struct(value.alias("value"), *([] if errors is None else [errors.alias("errors")]))

    def children(self, f: Edge, p: Pick, args: Mapping[str, Any], keep: Callable[[str], Mapping[str, str]], where: str, info: Info) -> tuple[DataFrame, bool]:
        """The target's rows, nested, with the columns that ``keep`` names of each of its types; members with tables of their own are put together."""
        t = self.schema.types[f.target]
        own = lambda m: f.where(m, args) if f.where else m
        if not isinstance(t, AbstractType) or t.table is not None:
            return self.nested(f.target, p.children, own(t.table()), keep(f.target), where, info)
        parts = []
        for m in t.members:
            df, outs = self.fields(m, p.children, own(self.schema.types[m].table()), parent=info)
            errors, broken = fields_of(outs)
            parts.append((df.select(*[d.value.alias(f"v_{k}") for k, d in outs.items()], (F.lit(False) if broken is None else broken).alias("broken"), (none() if errors is None else errors).alias("errors"), *[F.col(a).alias(b) for a, b in keep(m).items()]), list(outs), errors is not None))
        keys = list(dict.fromkeys(k for _, known, _ in parts for k in known))
        every = parts[0][0]
        for part, _, _ in parts[1:]:
            every = every.unionByName(part, allowMissingColumns=True)
        failing = any(e for *_, e in parts)
        value = F.when(~F.col("broken"), F.struct(*[F.col(f"v_{k}").alias(k) for k in keys]))
        return every.select(self._item(value, F.col("errors") if failing else None).alias("item"), *keep(t.members[0]).values()), failing

    def edge(self, owner: ObjectType, f: Edge, p: Pick, info: Info, df: DataFrame, where: str) -> tuple[DataFrame, Done]:
        k, got = self._fresh(), self._fresh()
        theirs = (lambda m: f.theirs) if isinstance(f.theirs, str) else (lambda m: f.theirs[m])
        orders = (lambda m: f.order) if not isinstance(f.order, Mapping) else (lambda m: f.order[m])
        if f.keys:
            # Ordered lookup: each key with its place, met with the child and gathered again in order.
            own, place = self._fresh(), self._fresh()
            rows, failing = self.children(f, p, info, lambda m: {theirs(m): k}, where, info)
            target = self.schema.types[f.target]
            rows = rows if isinstance(target, ObjectType) and target.key == f.theirs else rows.dropDuplicates([k])
            placed = df.select(F.col(owner.key).alias(own), F.posexplode(f.ours).alias(place, k))
            gathered = placed.join(rows, k, "left").groupBy(own).agg(F.sort_array(F.collect_list(F.struct(place, "item"))).alias(got))
            df = df.join(gathered, df[owner.key] == gathered[own], "left").drop(own)
            found = F.when(F.col(f.ours).isNotNull(), F.coalesce(F.transform(got, lambda x: x["item"]), F.array()))
        elif not f.many:
            rows, failing = self.children(f, p, info, lambda m: {theirs(m): k}, where, info)
            df = df.join(rows.withColumnRenamed("item", got), df[f.ours] == F.col(k), "left").drop(k)
            done = Done(F.col(got)["value"], F.coalesce(F.col(got)["errors"], none()) if failing else None)
            return df, required(done, F.col(got).isNull(), where) if f.non_null else done
        else:
            names = [self._fresh() for _ in (next(iter(f.order.values())) if isinstance(f.order, Mapping) else f.order)]
            rows, failing = self.children(f, p, info, lambda m: {theirs(m): k, **dict(zip(orders(m), names, strict=True))}, where, info)
            grouped = rows.groupBy(k).agg(F.sort_array(F.collect_list(F.struct(*names, "item"))).alias(got))
            df = df.join(grouped, df[f.ours] == grouped[k], "left").drop(k)
            found = F.coalesce(F.transform(got, lambda x: x["item"]), F.array())
        if f.item_non_null:
            # An item that is null without an error of its own is one that no row was found for.
            own = (lambda x: F.coalesce(x["errors"], none())) if failing else (lambda x: none())
            missing = lambda x: F.when(x["value"].isNull() & (F.size(own(x)) == 0), raised(f"Cannot return null for non-nullable field {where}.", F.lit(True))).otherwise(own(x))
            found = F.transform(found, lambda x: F.struct(x["value"].alias("value"), missing(x).alias("errors"), x["value"].isNull().alias("broken")))
        elif failing:
            found = F.transform(found, lambda x: F.struct(x["value"].alias("value"), F.coalesce(x["errors"], none()).alias("errors"), F.lit(False).alias("broken")))
        done = items_of(found, failing or f.item_non_null, f.item_non_null)
        return df, required(done, F.col(f.ours).isNull() if f.keys else F.lit(False), where) if f.non_null else done

    def rows(self, type_: str, *picks: Pick | Spread, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """One row an object of the type, one column a response key; rows with a null in a non-null field are left out, as list items would be null
        (``results`` gives them, with their errors).

        Abstract types give the union of their members, tagged where ``__typename`` is selected; fields that a member
        doesn't have are null. Where the type resolves its own table's rows, rows that are nothing it can be are left out."""
        t = self._type(type_)
        if isinstance(t, AbstractType) and t.table is None:
            parts = [self.rows(m, *picks) for m in t.members if self.collect(m, picks)]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part, allowMissingColumns=True)
            return out
        df = where(t.table()) if where else t.table()
        if isinstance(t, AbstractType):
            df, outs, extra = self.resolved(t, picks, df, F.col, None, t.name)
            df = df.filter(F.size(extra) == 0)
        else:
            df, outs = self.fields(type_, picks, df)
        _, broken = fields_of(outs)
        df = df if broken is None else df.filter(~broken)
        return df.select(*[d.value.alias(k) for k, d in outs.items()])

    def _type(self, name: str) -> ObjectType | AbstractType:
        t = self.schema.types.get(name)
        if t is None:
            raise SelectionError(f"Unknown type {name!r}.{did_you_mean(name, self.schema.types)}")
        return t

    def results(self, type_: str, *picks: Pick | Spread, where: Callable[[DataFrame], DataFrame] | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """One row an object of the type: ``data``, the selection as a struct (null where a null goes up to it), ``errors`` (message, path),
        and the table's columns that ``keep`` names."""
        t = self._type(type_)
        if isinstance(t, AbstractType) and t.table is None:
            raise SelectionError(f"{type_!r} has no table of its own; select its members.")
        df = where(t.table()) if where else t.table()
        kept = {c: self._fresh() for c in keep}
        rows, failing = self.nested(type_, picks, df, kept, type_)
        return rows.select(*[F.col(n).alias(c) for c, n in kept.items()], F.col("item")["value"].alias("data"), (F.col("item")["errors"] if failing else none()).alias("errors"))

    def json(self, type_: str, *picks: Pick | Spread, where: Callable[[DataFrame], DataFrame] | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """``results`` as JSON texts in the column ``result``: errors first and only if there are some."""
        return self.results(type_, *picks, where=where, keep=keep).select(*keep, result_json(F.col("data"), F.col("errors")).alias("result"))


def operation(operations: Mapping[str | None, Any], name: str | None = None) -> Any:
    """The operation of a document that is asked for: by name, or the only one."""
    if not name:
        if len(operations) > 1:
            raise SelectionError("Must provide operation name if query contains multiple operations.")
        if not operations:
            raise SelectionError("Must provide an operation.")
        return next(iter(operations.values()))
    if name not in operations:
        raise SelectionError(f'Unknown operation named "{name}".')
    return operations[name]
