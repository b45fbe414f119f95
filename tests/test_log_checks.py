"""Checks of operation logs through fragments, each with documents that are right and wrong."""

from nestframe.plans import log_checks as of

COLUMNS = [c.split()[0] for c in of.SCHEMA.split(", ")]


def bad(check, spark, *docs):
    """The names found wrong, by document."""
    log = spark.createDataFrame([tuple({"doc": doc, **row}.get(c) for c in COLUMNS) for doc, rows in enumerate(docs) for row in rows], of.SCHEMA)
    found = [(r["doc"], r["name"]) for r in check(log).collect()]
    return [sorted(n for d, n in found if d == doc) for doc in range(len(docs))]


def row(kind, name=None, owner=None, **more):
    return {"kind": kind, "name": name, "owner": owner, **more}


THROUGH = [row("operation", "q"), row("fragment", "f"), row("fragment", "g"), row("spread", "f", "q"), row("spread", "g", "f"), row("spread", "f", "g")]


def test_variables_through_fragments(spark):
    used = [*THROUGH, row("variable", "v", "q", type="Int"), row("use", "v", "g", type="String")]
    undefined = [*THROUGH, row("use", "w", "g", type="Int")]
    apart = [row("operation", "q"), row("fragment", "f"), row("variable", "v", "q", type="Int"), row("use", "v", "f", type="String")]
    anonymous = [row("operation"), row("variable", "v", type="Int"), row("use", "v", type="Int")]
    docs = (used, undefined, apart, anonymous)
    assert bad(of.unused_variables, spark, *docs) == [[], [], ["v"], []]
    assert bad(of.undefined_variables, spark, *docs) == [[], ["w"], [], []]
    assert bad(of.variable_positions, spark, *docs) == [["v"], [], [], []]


def field(name, owner, key, args=None, parent=None):
    return row("field", name, owner, parent_type="T", key=key, path=key if parent is None else f"{parent}.{key}", parent=parent, value=args)


def test_conflicts_through_fragments(spark):
    docs = (
        [*THROUGH, field("id", "q", "x"), field("name", "g", "x")],
        [*THROUGH, field("id", "q", "x"), field("id", "g", "x")],
        [field("id", "q", "x", "a: 1"), field("id", "q", "x", "a: 2")],
        [*THROUGH, field("p", "q", "p"), field("p", "g", "p"), field("id", "q", "x", parent="p"), field("name", "g", "x", parent="p")],
        [row("operation", "q"), row("fragment", "f"), field("p", "q", "p"), row("spread", "f", "q", parent="p"), field("id", "q", "x"), field("name", "f", "x")],
        [row("operation", "q"), row("fragment", "f"), row("fragment", "g"), row("spread", "f", "q"), row("spread", "g", "q"), field("id", "f", "x"), field("id", "g", "x", "a: 1")],
    )
    assert bad(of.conflicting_keys, spark, *docs) == [["x"], [], ["x"], ["x"], [], ["x"]]


def test_input_fields(spark):
    twice = [row("input_field", "a", "orders.filter"), row("input_field", "a", "orders.filter")]
    assert bad(lambda log: of.unique_names(log, "input_field"), spark, twice, [twice[0], row("input_field", "a", "orders.other")]) == [["a"], []]


def test_fragments_far_from_operations(spark):
    chain = [row("operation", "q"), row("spread", "f0", "q"), *[row("fragment", f"f{i}") for i in range(40)], *[row("spread", f"f{i + 1}", f"f{i}") for i in range(39)]]
    cycle = [*[row("fragment", f"f{i}") for i in range(70)], *[row("spread", f"f{(i + 1) % 70}", f"f{i}") for i in range(70)]]
    assert bad(of.unused_fragments, spark, chain) == [[]]
    assert len(bad(of.fragment_cycles, spark, cycle)[0]) == 70


def test_conflicts_of_types_and_of_exclusive_parents(spark):
    types = spark.createDataFrame([("Dog", "OBJECT"), ("Cat", "OBJECT"), ("Pet", "INTERFACE"), ("P", "OBJECT"), ("Int", "SCALAR"), ("String", "SCALAR")], "name string, kind string")
    known = [("Dog", "a", "Int"), ("Cat", "a", "Int"), ("Cat", "b", "Int"), ("Cat", "c", "String"), ("Cat", "n", "Int!"), ("Cat", "l", "[Int]"), ("Pet", "a", "Int"), ("Dog", "p", "P"), ("Cat", "p", "P"), ("Cat", "q", "[P]"), ("P", "x", "Int"), ("P", "y", "Int"), ("P", "z", "String")]
    fields = spark.createDataFrame(known, "type_name string, name string, type string")
    at = lambda parent, name, key="k", path=None, below=None: row("field", name, "q", parent_type=parent, key=key, path=path or key, parent=below)
    check = lambda log: of.conflicting_keys(log, fields, types)
    docs = (
        [at("Dog", "a"), at("Cat", "b")],  # other fields of types that exclude each other
        [at("Dog", "a"), at("Cat", "c")],
        [at("Dog", "a"), at("Cat", "n")],
        [at("Dog", "a"), at("Cat", "l")],
        [at("Pet", "a"), at("Cat", "b")],  # a cat is a pet
        [at("Dog", "p"), at("Cat", "q")],
        [at("Dog", "p", path="k@Dog"), at("Cat", "p", path="k@Cat"), at("P", "x", "v", "1", "k@Dog"), at("P", "y", "v", "2", "k@Cat")],
        [at("Dog", "p", path="k@Dog"), at("Cat", "p", path="k@Cat"), at("P", "x", "v", "1", "k@Dog"), at("P", "z", "v", "2", "k@Cat")],
        [at("Pet", "a"), at("Dog", "a"), at("Cat", "a")],
    )
    assert bad(check, spark, *docs) == [[], ["k"], ["k"], ["k"], ["k"], ["k"], [], ["v"], []]


def test_suggestions_and_arguments_of_directives(spark):
    fields = spark.createDataFrame([("T", "name"), ("T", "size"), ("U", "nmae")], "type_name string, name string")
    log = spark.createDataFrame([tuple({"doc": 1, **row("field", n, "q", parent_type="T")}.get(c) for c in COLUMNS) for n in ("nmae", "zzzzzzzz")], of.SCHEMA)
    assert {r["name"]: r["message"] for r in of.known_fields(log, fields).collect()} == {"nmae": 'Cannot query field "nmae" on type "T". Did you mean "name"?', "zzzzzzzz": 'Cannot query field "zzzzzzzz" on type "T".'}
    arguments = spark.createDataFrame([("@skip", "if", True), ("T.name", "size", False)], "field string, name string, required boolean")
    docs = (
        [row("directive", "skip", "f"), row("argument", "if", "f", parent_type="@skip")],
        [row("directive", "skip", "f")],
        [row("directive", "skip", "f"), row("argument", "unless", "f", parent_type="@skip"), row("argument", "if", "g", parent_type="@skip")],
    )
    assert bad(lambda log: of.required_arguments(log, arguments), spark, *docs) == [[], ["skip"], ["skip"]]
    assert bad(lambda log: of.known_arguments(log, arguments), spark, *docs) == [[], [], ["unless"]]


def test_a_pair_of_types_is_compared_once(spark):
    """The comparison stands above the distinct pairs, not below."""
    log = spark.createDataFrame([(1,) + ("use",) + (None,) * 8], of.SCHEMA)
    reach = spark.createDataFrame([(1, "q", "q")], "doc long, operation string, owner string")
    plan = of.variable_positions(log, reach)._jdf.queryExecution().optimizedPlan().toString()
    compared = plan.index("ArrowEvalPython")
    assert "Aggregate [given" in plan[compared:] and plan.count("ArrowEvalPython") == 1


def test_only_documents_that_merge_selections_are_paired(spark, monkeypatch):
    started = []
    closure = of._closure
    monkeypatch.setattr(of, "_closure", lambda start, further: started.append({r["doc"] for r in start.select("doc").collect()}) or closure(start, further))
    plain = [row("operation", "q"), field("id", "q", "x"), field("id", "q", "y")]
    docs = (plain, [*THROUGH, field("id", "q", "x"), field("name", "g", "x")], plain, [field("id", "q", "x"), field("name", "q", "x")])
    assert bad(of.conflicting_keys, spark, *docs) == [[], ["x"], [], ["x"]]
    assert bad(of.unused_fragments, spark, *docs) == [[], [], [], []]
    assert started == [{1}, {1}]
