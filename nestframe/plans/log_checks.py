"""Checks of a log of stored operations, at any number of documents: every rule is a join or a grouping.

The log has one row a definition or selection:

* ``kind``: operation, fragment, spread, field, condition, variable, use, argument, input_field or directive;
* ``name``, and ``owner``, the name of the operation or fragment (for arguments and directives the path of the field,
  for fields of input objects the path of the object) that it stands in; an anonymous operation's name is null;
* ``parent_type``: the type that a field is selected on, a fragment's or spread's surroundings;
* ``key`` and ``path``: a field's response key and path; a field's children, spreads among them, have its path as ``parent``. Where fields of different parent types
  share a key at one place, their paths are to differ as their children do;
* arguments of directives have ``@`` and the directive's name as ``parent_type``;
* ``type``: an operation's kind, a variable's, condition's or fragment's type, the type that a use or argument is expected to
  have; ``value``: an argument's kind of literal, a variable's default, a field's arguments as text in the order of their names.

What is said of fragments holds for the operations that reach them. An owner is a fragment where its document
defines one of this name, and an operation where it defines such or no fragment.

Every check gives doc, name, message; a document that is right gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestframe.operators.complete import is_subtype
from nestframe.plans.suggest import distance
from nestframe.storage import stored as _stored

SCHEMA = "doc long, kind string, name string, owner string, parent_type string, key string, path string, parent string, type string, value string"


def _of(log: DataFrame, kind: str) -> DataFrame:
    return log.filter(F.col("kind") == kind)


def _bad(rows: DataFrame, message: str | Column, name: str = "name") -> DataFrame:
    return rows.select("doc", F.col(name).alias("name"), (F.lit(message) if isinstance(message, str) else message).alias("message")).distinct()


def _twice(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("doc", *by).agg(F.count("*").alias("times")).filter("times > 1").drop("times")


def suggested(wrong: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """Adds ``hint`` to rows (name, ``by``): the up to five known names (name, ``by``) of the same ``by`` that the name may stand for, nearest first; else empty text.

    A pair of names is compared once, however often it occurs; known names are as many as a schema has."""
    near = F.pandas_udf(lambda a, b: pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)]), "int")
    pairs = wrong.select(by, "name").distinct().join(known.select(by, F.col("name").alias("other")).distinct(), by).withColumn("far", near("name", "other"))
    half = lambda c: F.floor(F.length(c) / 2)
    close = pairs.filter(F.col("far") <= F.greatest(half("name"), half("other"), F.lit(1)))
    best = close.withColumn("place", F.row_number().over(Window.partitionBy(by, "name").orderBy("far", "other"))).filter("place <= 5")
    lists = best.groupBy(by, "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "other"))), lambda x: F.concat(F.lit('"'), x["other"], F.lit('"'))).alias("n"))
    size = F.size("n")
    text = F.when(size == 1, F.get("n", F.lit(0))).otherwise(F.concat(F.array_join(F.slice("n", F.lit(1), size - 1), ", "), F.when(size > 2, F.lit(",")).otherwise(F.lit("")), F.lit(" or "), F.get("n", size - 1)))
    hints = lists.select(by, "name", F.concat(F.lit(" Did you mean "), text, F.lit("?")).alias("hint"))
    return wrong.join(hints, [by, "name"], "left").withColumn("hint", F.coalesce("hint", F.lit("")))


def unique_names(log: DataFrame, kind: str) -> DataFrame:
    """Names defined more than once: operations and fragments in a document, variables, arguments and directives by owner."""
    by = ("name",) if kind in ("operation", "fragment") else ("owner", "name")
    return _bad(_twice(_of(log, kind).filter(F.col("name").isNotNull()), *by), f"There can be only one {kind} of this name")


def lone_anonymous(log: DataFrame) -> DataFrame:
    """Documents with an anonymous operation among several."""
    by = _of(log, "operation").groupBy("doc").agg(F.count("*").alias("n"), F.count("name").alias("named"))
    return _bad(by.filter("n > 1 AND named < n").withColumn("name", F.lit(None).cast("string")), "This anonymous operation must be the only defined operation")


def single_field_subscriptions(log: DataFrame) -> DataFrame:
    """Subscriptions with more than one field at their root."""
    roots = _of(log, "field").filter(F.col("parent").isNull()).groupBy("doc", "owner").agg(F.count("*").alias("n")).filter("n > 1")
    return _bad(_of(log, "operation").filter("type = 'subscription'").join(roots.withColumnRenamed("owner", "name"), ["doc", "name"], "left_semi"), "Subscription must select only one top level field")


def known_types(log: DataFrame, types: DataFrame) -> DataFrame:
    """Types of conditions, fragments and variables that the schema doesn't have; ``types``: name."""
    used = log.filter(F.col("kind").isin("condition", "fragment", "variable")).select("doc", F.regexp_replace("type", r"[\[\]!]", "").alias("name")).filter(F.col("name").isNotNull())
    wrong = used.join(types.select("name"), "name", "left_anti").withColumn("of", F.lit("type"))
    return _bad(suggested(wrong, types.withColumn("of", F.lit("type")), "of"), F.concat(F.lit('Unknown type "'), "name", F.lit('".'), "hint"))


def composite_conditions(log: DataFrame, types: DataFrame) -> DataFrame:
    """Conditions and fragments on types without fields; ``types``: name, kind."""
    flat = types.filter(~F.col("kind").isin("OBJECT", "INTERFACE", "UNION")).select(F.col("name").alias("type"))
    return _bad(log.filter(F.col("kind").isin("condition", "fragment")).join(flat, "type", "left_semi"), "Fragment cannot condition on non composite type", "type")


def input_variables(log: DataFrame, types: DataFrame) -> DataFrame:
    """Variables of types that arguments can't have."""
    output = types.filter(F.col("kind").isin("OBJECT", "INTERFACE", "UNION")).select(F.col("name").alias("bare"))
    return _bad(_of(log, "variable").withColumn("bare", F.regexp_replace("type", r"[\[\]!]", "")).join(output, "bare", "left_semi"), "Variable cannot be non-input type")


def scalar_leafs(log: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields with subfields on a leaf type, or without on others; ``fields``: type_name, name, leaf."""
    known = fields.select(F.col("type_name").alias("parent_type"), "name", "leaf")
    parents = _of(log, "field").filter(F.col("parent").isNotNull()).select("doc", "owner", F.col("parent").alias("path")).distinct().withColumn("has", F.lit(True))
    met = _of(log, "field").join(known, ["parent_type", "name"]).join(parents, ["doc", "owner", "path"], "left")
    wrong = met.filter(F.col("leaf") == F.coalesce("has", F.lit(False)))
    return _bad(wrong, F.when(F.col("leaf"), "Field must not have a selection since its type has no subfields").otherwise("Field must have a selection of subfields"))


def known_fields(log: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields that their type doesn't have; ``fields``: type_name, name."""
    known = fields.select(F.col("type_name").alias("parent_type"), "name")
    wrong = _of(log, "field").filter("name <> '__typename'").join(known, ["parent_type", "name"], "left_anti")
    return _bad(suggested(wrong, known, "parent_type"), F.concat(F.lit('Cannot query field "'), "name", F.lit('" on type "'), "parent_type", F.lit('".'), "hint"))


def known_fragments(log: DataFrame) -> DataFrame:
    """Spreads of fragments that their document doesn't define."""
    return _bad(_of(log, "spread").join(_of(log, "fragment").select("doc", "name"), ["doc", "name"], "left_anti"), "Unknown fragment")


def unused_fragments(log: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Fragments that no operation reaches, directly or through others."""
    operations = _of(log, "operation").select("doc", _owner("name").alias("operation")).distinct()
    reached = (reachable(log) if reach is None else reach).join(operations, ["doc", "operation"], "left_semi").select("doc", F.col("owner").alias("name")).distinct()
    return _bad(_of(log, "fragment").join(reached, ["doc", "name"], "left_anti"), "Fragment is never used")


def fragment_cycles(log: DataFrame) -> DataFrame:
    """Fragments that spread themselves, directly or through others."""
    edges = _of(log, "spread").join(_of(log, "fragment").select("doc", F.col("name").alias("owner")), ["doc", "owner"], "left_semi").select("doc", F.col("owner").alias("a"), F.col("name").alias("b")).distinct()
    reach = _stored(edges)
    while True:  # each round doubles the length of the ways
        further = _stored(reach.alias("x").join(reach.alias("y"), (F.col("x.doc") == F.col("y.doc")) & (F.col("x.b") == F.col("y.a"))).select("x.doc", "x.a", "y.b").distinct().join(reach, ["doc", "a", "b"], "left_anti"))
        if further.isEmpty():
            break
        reach = _stored(reach.unionByName(further))
    return _bad(reach.filter("a = b"), "Cannot spread fragment within itself", "a")


def possible_spreads(log: DataFrame, possible: DataFrame) -> DataFrame:
    """Spreads and conditions whose type shares no object type with the surroundings'; ``possible``: type_name, possible (objects name themselves)."""
    types = _of(log, "fragment").select("doc", "name", F.col("type").alias("inner"))
    named = _of(log, "spread").select("doc", "name", "parent_type").join(types, ["doc", "name"])
    inline = _of(log, "condition").select("doc", F.col("type").alias("name"), "parent_type", F.col("type").alias("inner"))
    both = named.unionByName(inline).distinct()
    inner = possible.select(F.col("type_name").alias("inner"), "possible")
    outer = possible.select(F.col("type_name").alias("parent_type"), "possible")
    return _bad(both.join(inner.join(outer, "possible").select("inner", "parent_type").distinct(), ["inner", "parent_type"], "left_anti"), "Fragment cannot be spread here as its type can never be this type")


def _owner(column: str = "owner") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _fragments(log: DataFrame) -> DataFrame:
    return _of(log, "fragment").select("doc", F.col("name").alias("owner")).distinct()


def _operations(log: DataFrame) -> DataFrame:
    """doc, owner of all operations: those that the log has, and owners that are no fragments."""
    owners = log.filter(F.col("kind").isin("spread", "field", "condition", "variable", "use")).select("doc", _owner().alias("owner")).distinct()
    return _of(log, "operation").select("doc", _owner("name").alias("owner")).unionByName(owners.join(_fragments(log), ["doc", "owner"], "left_anti")).distinct()


def reachable(log: DataFrame) -> DataFrame:
    """doc, operation, owner: each operation with itself and all fragments that it reaches."""
    edges = _stored(_of(log, "spread").select("doc", _owner().alias("owner"), F.col("name").alias("next")).join(_fragments(log).withColumnRenamed("owner", "next"), ["doc", "next"], "left_semi").distinct())
    itself = _stored(_operations(log).select("doc", F.col("owner").alias("operation"), "owner"))
    # Only operations that spread reach more than themselves.
    spreading = itself.join(edges.select("doc", "owner"), ["doc", "owner"], "left_semi").select("doc", "operation", "owner")
    reached = _closure(spreading, lambda last: last.join(edges, ["doc", "owner"]).select("doc", "operation", F.col("next").alias("owner")))
    return itself.unionByName(reached.filter("operation <> owner"))


def _closure(start: DataFrame, further: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The distinct rows ``start`` and all that rounds of ``further`` add to it, until no row is new. Each round's new rows are written once, and put together now and then."""
    new = _stored(start)
    parts = [new]
    while not new.isEmpty():
        new = _stored(further(new).distinct().join(reduce(DataFrame.unionByName, parts), start.columns, "left_anti"))
        parts = [*parts, new] if len(parts) < 8 else [_stored(reduce(DataFrame.unionByName, [*parts, new]))]
    return reduce(DataFrame.unionByName, parts)


def _variables(log: DataFrame) -> DataFrame:
    return _of(log, "variable").withColumn("operation", _owner())


def _uses(log: DataFrame, reach: DataFrame | None) -> DataFrame:
    """Uses with each operation that reaches them; ``reach``: what ``reachable`` gives, made anew where it isn't given."""
    return _of(log, "use").withColumn("owner", _owner()).join(reachable(log) if reach is None else reach, ["doc", "owner"])


def undefined_variables(log: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    return _bad(_uses(log, reach).join(_variables(log).select("doc", "operation", "name"), ["doc", "operation", "name"], "left_anti"), "Variable is not defined by operation")


def unused_variables(log: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    return _bad(_variables(log).join(_uses(log, reach).select("doc", "operation", "name"), ["doc", "operation", "name"], "left_anti"), "Variable is never used in operation")


def variable_positions(log: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Uses where a type is expected that the variable's isn't: it may only be stricter about nulls."""
    variables = _variables(log).select("doc", "operation", "name", F.col("type").alias("given"), F.col("value").alias("default"))
    given = F.when(F.col("default").isNotNull() & ~F.col("given").endswith("!"), F.concat("given", F.lit("!"))).otherwise(F.col("given"))
    used = _uses(log, reach).filter(F.col("type").isNotNull()).join(variables, ["doc", "operation", "name"]).withColumn("given", given)
    # A pair of types is compared once, however often it occurs; else Spark would filter before it looks for distinct pairs.
    fits = F.pandas_udf(lambda a, b: pd.Series([is_subtype(x, y) for x, y in zip(a, b, strict=True)]), "boolean").asNondeterministic()
    wrong = used.select("given", "type").filter("given <> type").distinct().filter(~fits("given", "type"))
    message = F.concat(F.lit('Variable of type "'), "given", F.lit('" used in position expecting type "'), "type", F.lit('"'))
    return _bad(used.join(wrong, ["given", "type"], "left_semi"), message)


def known_directives(log: DataFrame, directives: DataFrame) -> DataFrame:
    """Directives that aren't known, or not at their place; ``directives``: name, location (a place's kind is in ``type``)."""
    used = _of(log, "directive")
    unknown = _bad(used.join(directives.select("name"), "name", "left_anti"), "Unknown directive")
    placed = used.join(directives.select("name"), "name", "left_semi").join(directives.select("name", F.col("location").alias("type")), ["name", "type"], "left_anti")
    return unknown.unionByName(_bad(placed, "Directive may not be used here"))


def known_arguments(log: DataFrame, arguments: DataFrame) -> DataFrame:
    """Arguments that their field or directive doesn't have; ``arguments``: field (Type.name, or @name), name. An argument's ``parent_type`` is its field or directive."""
    known = arguments.select(F.col("field").alias("parent_type"), "name")
    wrong = _of(log, "argument").join(known, ["parent_type", "name"], "left_anti")
    owner = F.when(F.col("parent_type").startswith("@"), F.concat(F.lit("directive "), "parent_type")).otherwise(F.concat(F.lit("field "), "parent_type"))
    return _bad(suggested(wrong, known, "parent_type"), F.concat(F.lit('Unknown argument "'), "name", F.lit('" on '), owner, F.lit("."), "hint"))


def required_arguments(log: DataFrame, arguments: DataFrame) -> DataFrame:
    """Fields and directives without an argument that they need; ``arguments``: field (Type.name, or @name), name, required."""
    needed = arguments.filter("required").select("field", F.col("name").alias("argument"))
    fields = _of(log, "field").select("doc", "name", "path", F.concat_ws(".", "parent_type", "name").alias("field"))
    directives = _of(log, "directive").select("doc", "name", F.col("owner").alias("path"), F.concat(F.lit("@"), "name").alias("field"))
    given = _of(log, "argument").select("doc", F.col("owner").alias("path"), F.col("parent_type").alias("field"), F.col("name").alias("argument"))
    missing = fields.unionByName(directives).join(needed, "field").join(given, ["doc", "path", "field", "argument"], "left_anti")
    return _bad(missing, F.concat(F.when(F.col("field").startswith("@"), F.lit("Directive")).otherwise(F.lit("Field")), F.lit(" is missing argument "), "argument"))


def argument_values(log: DataFrame, fits: DataFrame) -> DataFrame:
    """Arguments with literals that their type can't have; ``fits``: type, value."""
    literal = _of(log, "argument").filter(F.col("value").isNotNull() & F.col("type").isNotNull())
    plain = literal.filter(~((F.col("value") == "null") & ~F.col("type").endswith("!"))).withColumn("bare", F.regexp_replace("type", r"[\[\]!]", ""))
    return _bad(plain.join(fits.select(F.col("type").alias("bare"), "value"), ["bare", "value"], "left_anti"), "Expected another type of value")


def _shapes(fields: DataFrame, types: DataFrame) -> DataFrame:
    """parent_type, name, shape: a field's type as it is written, with a star for a type that has fields."""
    named = fields.select(F.col("type_name").alias("parent_type"), "name", "type", F.regexp_replace("type", r"[\[\]!]", "").alias("bare"))
    kinds = types.select(F.col("name").alias("bare"), F.col("kind").isin("OBJECT", "INTERFACE", "UNION").alias("composite"))
    return named.join(kinds, "bare", "left").select("parent_type", "name", F.when(F.col("composite"), F.replace("type", "bare", F.lit("*"))).otherwise(F.col("type")).alias("shape"))


def conflicting_keys(log: DataFrame, fields: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """Response keys that stand for different things in selections that are merged: different fields, differing arguments, or types that can't be one.

    A selection (owner and path) is merged with the fragments that it spreads, directly or through others, and these with one
    another; where merged selections have the same key, the selections below are merged too. Fields of different object types never meet on
    one object, nor does what is below them, so only their types must agree: the same lists, nulls and leaves. ``fields`` (type_name, name, type) and
    ``types`` (name, kind) tell these; without them types are not compared, and all parent types are taken for object types.
    """
    rows = _of(log, "field").select("doc", _owner().alias("owner"), F.coalesce("parent", F.lit("")).alias("at"), F.coalesce("path", F.lit("")).alias("path"), "parent_type", "key", "name", F.coalesce("value", F.lit("")).alias("value")).distinct()
    if fields is None or types is None:
        rows = rows.withColumn("shape", F.lit(None).cast("string")).withColumn("abstract", F.lit(False))
    else:
        kinds = types.select(F.col("name").alias("parent_type"), F.col("kind").isin("INTERFACE", "UNION").alias("abstract"))
        rows = rows.join(_shapes(fields, types), ["parent_type", "name"], "left").join(kinds, "parent_type", "left").withColumn("abstract", F.coalesce("abstract", F.lit(False)))
    rows = _stored(rows)
    # Within a selection only keys that several rows have can differ; others' texts are not compared.
    twice = _twice(rows, "owner", "at", "key").select(F.col("doc").alias("twice")).distinct()
    repeated = _stored(rows.join(twice, F.col("doc").eqNullSafe(F.col("twice")), "left_semi"), "repeated")
    spreads = _of(log, "spread").select("doc", _owner().alias("owner"), F.coalesce("parent", F.lit("")).alias("at"), F.col("name").alias("next")).distinct()
    spreads = _stored(spreads.join(_fragments(log).withColumnRenamed("owner", "next"), ["doc", "next"], "left_semi"))
    side = lambda df, n: df.select("doc", *[F.col(c).alias(c + n) for c in df.columns if c != "doc"])
    other = side(spreads, "_b").withColumnRenamed("next_b", "next")
    same = lambda c: F.col(c + "_a").eqNullSafe(F.col(c + "_b"))
    differ = F.coalesce(F.col("shape_a") != F.col("shape_b"), F.lit(False))
    field_differs = ~F.col("here") & (~same("name") | ~same("value"))
    # Different selections are merged only in documents with spreads, or with a key that has several paths.
    several = repeated.groupBy("doc", "owner", "at", "key").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).filter("lo <> hi")
    merging = _stored(spreads.select("doc").unionByName(several.select("doc")).distinct())
    nodes = rows.select("doc", "owner", "at").unionByName(spreads.select("doc", "owner", "at")).join(merging, "doc", "left_semi").distinct()
    pairs = nodes.select("doc", F.col("owner").alias("owner_a"), F.col("at").alias("at_a"), F.col("owner").alias("owner_b"), F.col("at").alias("at_b"), F.lit(False).alias("apart"))

    def met(last: DataFrame) -> DataFrame:
        """Fields of one key; ``here``: whether they can't be of one object."""
        both = last.join(a, ["doc", "owner_a", "at_a"]).join(b, ["doc", "owner_b", "at_b"]).filter(same("key"))
        return both.withColumn("here", F.col("apart") | (~same("parent_type") & ~F.col("abstract_a") & ~F.col("abstract_b")))

    def further(last: DataFrame) -> DataFrame:
        spread = last.join(other, ["doc", "owner_b", "at_b"]).select("doc", "owner_a", "at_a", F.col("next").alias("owner_b"), F.lit("").alias("at_b"), "apart")
        below = met(last).filter(~field_differs & ~differ & (F.col("path_a") != "") & (F.col("path_b") != "")).select("doc", "owner_a", F.col("path_a").alias("at_a"), "owner_b", F.col("path_b").alias("at_b"), F.col("here").alias("apart"))
        both = spread.unionByName(below)
        return both.unionByName(both.select("doc", F.col("owner_b").alias("owner_a"), F.col("at_b").alias("at_a"), F.col("owner_a").alias("owner_b"), F.col("at_a").alias("at_b"), "apart"))

    found = lambda df, cases: df.select("doc", "key", cases.alias("why")).filter(F.col("why").isNotNull())
    say = lambda name, value, shape: F.when(name, F.lit("they are different fields")).when(value, F.lit("they have differing arguments")).when(shape, F.lit("they return conflicting types"))
    # Within one selection, without pairs: of one parent type, and of all where one of the parents is abstract.
    spans = [F.min(c).alias(f"{c}_lo") for c in ("name", "value", "shape")] + [F.max(c).alias(f"{c}_hi") for c in ("name", "value", "shape")]
    one = repeated.groupBy("doc", "owner", "at", "parent_type", "key").agg(*spans)
    every = found(one, say(F.col("name_lo") != F.col("name_hi"), F.col("value_lo") != F.col("value_hi"), F.lit(False)))
    mixed = repeated.groupBy("doc", "owner", "at", "key").agg(*spans, F.max("abstract").alias("abstract"))
    every = every.unionByName(found(mixed, say(F.col("abstract") & (F.col("name_lo") != F.col("name_hi")), F.col("abstract") & (F.col("value_lo") != F.col("value_hi")), F.col("shape_lo") != F.col("shape_hi"))))
    if not merging.isEmpty():
        rows = _stored(rows.join(merging, "doc", "left_semi").select(*rows.columns), "merging")
        a, b = side(rows, "_a"), side(rows, "_b")
        own = _closure(pairs, further).filter((F.col("owner_a") != F.col("owner_b")) | (F.col("at_a") != F.col("at_b")))
        crossed = met(own).withColumn("key", F.col("key_a"))
        every = every.unionByName(found(crossed, say(~F.col("here") & ~same("name"), ~F.col("here") & ~same("value"), differ)))
    return _bad(every, F.concat(F.lit("Fields conflict because "), "why"), "key")
