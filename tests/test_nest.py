import pytest
from pyspark.sql import functions as F

from nestframe.functions import coerce as C
from nestframe.operators.batch import Lookup
from nestframe.operators.nest import AbstractType, Edge, Field, ObjectType, Schema, SelectionError, Selector, Variable, pick, spread
from nestframe.plans import log_checks
from nestframe.plans.suggest import distance, or_list, suggestions
from nestframe.sources.tables import schema


@pytest.fixture(scope="module")
def people(spark):
    rows = [("1000", "Luke", ["1002", "1003", "9999"]), ("1002", "Han", ["1000"]), ("1003", "Leia", []), ("1004", "Tarkin", None)]
    df = spark.createDataFrame(rows, "id string, name string, friends array<string>")
    person = ObjectType("Person", lambda: df, {"id": Field("id", C.to_id, "string", non_null=True), "name": Field("name", C.to_string, "string"), "friends": Edge("Person", "friends", "id", keys=True)}, ("Named",), "id")
    return Schema.of(person, AbstractType("Named", ("Person",)))


def test_ordered_lookup_keeps_key_order_and_gaps(people):
    got = {r["name"]: r["friends"] for r in Selector(people).rows("Person", pick("name"), pick("friends", pick("name"))).collect()}
    assert [f and f["name"] for f in got["Luke"]] == ["Han", "Leia", None]
    assert got["Leia"] == [] and got["Tarkin"] is None


def test_two_levels(people):
    got = {r["name"]: r["friends"] for r in Selector(people).rows("Person", pick("name"), pick("friends", pick("name"), pick("friends", pick("name")))).collect()}
    assert [f["name"] for f in got["Luke"][0]["friends"]] == ["Luke"]


@pytest.mark.parametrize(
    ("picks", "message"),
    [
        ([pick("nam")], 'Did you mean "name"'),
        ([pick("friends")], "must have a selection"),
        ([pick("name", pick("id"))], "no subfields"),
        ([pick("id", alias="x"), pick("name", alias="x")], "conflict"),
        ([pick("name", size=3)], "Unknown argument"),
    ],
)
def test_refused_selections(people, picks, message):
    with pytest.raises(SelectionError, match=message):
        Selector(people).rows("Person", *picks)


def test_types_must_have_different_names(people):
    with pytest.raises(SelectionError, match="unique named types"):
        Schema.of(*people.types.values(), AbstractType("Person", ()))


def test_fragments_and_directives(people):
    got = Selector(people, {"yes": False}).rows("Person", spread(pick("name"), on="Named"), spread(pick("id"), include=Variable("yes")))
    assert got.columns == ["name"]


def test_scan_reads_only_what_is_selected(spark, tiny):
    plan = Selector(schema(spark, tiny)).rows("Order", pick("id"), pick("customer", pick("name")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan and "c_acctbal" not in plan


def test_argument_reaches_the_scan(spark, tiny):
    plan = Selector(schema(spark, tiny)).rows("Customer", pick("id"), pick("orders", pick("id"), status="OPEN"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan


@pytest.mark.parametrize(("value", "kind", "expected"), [("7", "string", 7), ("7x", "string", None), (2.0, "double", 2), (2.5, "double", None), (2**40, "bigint", None), (True, "boolean", 1)])
def test_int(spark, value, kind, expected):
    c = C.to_int(F.col("v"), kind)
    row = spark.createDataFrame([(value,)], f"v {kind}").select(c.value.alias("x"), c.failed().alias("bad")).first()
    assert row["x"] == expected and row["bad"] == (expected is None)


def test_inputs():
    assert C.parse_list(C.parse_int)(3) == [3]
    parse = C.parse_object("P", a=C.required(C.parse_int), b=(C.parse_string, "x"))
    assert parse({"a": 1}) == {"a": 1, "b": "x"}
    for bad in ({"a": None}, {"a": 1, "c": 2}, {"a": True}, {"a": 2**31}):
        with pytest.raises(ValueError):
            parse(bad)


def test_lookup_prime_and_clear(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key int, v string")
    keys = spark.createDataFrame([(1,), (1,), (3,), (None,)], "key int")
    lookup = Lookup(lambda k: rows.join(k, "key", "left_semi"), "key").prime(spark.createDataFrame([(3, "p")], "key int, v string"))
    assert sorted((r["key"], r["v"]) for r in lookup.get(keys).collect()) == [(1, "a"), (3, "p")]
    assert lookup.many(keys).count() == 4
    assert lookup.clear().get(keys).count() == 1


def test_suggestions():
    assert distance("ab", "ba") == 1 and distance("Name", "name") == 1
    assert suggestions("nmae", ["name", "zzzzzz"]) == ["name"]
    assert or_list(["a", "b", "c"]) == '"a", "b", or "c"'


def test_log_checks(spark):
    rows = [("d", "operation", "q", None), ("d", "operation", None, None), ("d", "fragment", "f", None), ("d", "fragment", "g", None), ("d", "fragment", "h", None), ("d", "spread", "f", "q"), ("d", "spread", "g", "f"), ("d", "spread", "x", "q")]
    log = spark.createDataFrame([(1, *r[1:], *[None] * 6) for r in rows], log_checks.SCHEMA)
    assert [r["name"] for r in log_checks.unused_fragments(log).collect()] == ["h"]
    assert [r["name"] for r in log_checks.known_fragments(log).collect()] == ["x"]
    assert log_checks.lone_anonymous(log).count() == 1
    assert log_checks.unique_names(log, "operation").count() == 0


def test_text(spark):
    from nestframe.functions import text

    row = lambda c, v: spark.createDataFrame([(v,)], "v string" if isinstance(v, str) else "v double").select(c(F.col("v"))).first()[0]
    assert row(text.html_safe, "<a>&\u2028 b") == "\\u003ca\\u003e\\u0026\\u2028 b"
    assert row(text.camel_case, "foo_bar") == "FooBar" and row(text.snake_case, "FooBARBaz") == "foo_bar_baz"
    assert [row(text.number, v) for v in (1.0, 0.5, 1e-7, 1e21, 0.0001, -2.25)] == ["1", "0.5", "1e-7", "1e+21", "0.0001", "-2.25"]
    assert [row(text.number, v) for v in (12345678.5, 1e15, 3e20, 1.5e-7, 1e-6, -0.0)] == ["12345678.5", "1000000000000000", "300000000000000000000", "1.5e-7", "0.000001", "-0"]
    assert row(text.number, float("inf")) is None
    assert [row(text.shown, v) for v in (1e5, 123456789.0, 1e-5, 1e100, -1.1, float("-inf"))] == ["100000", "1.23456789e+08", "1e-05", "1e+100", "-1.1", "-Inf"]


@pytest.mark.parametrize(
    ("parse", "value", "message"),
    [
        (C.parse_object("P", a=C.parse_list(C.parse_int)), {"a": [1, "x"]}, 'Expected type Int at value.a[1]; Int cannot represent "x"'),
        (C.parse_object("P", a=C.parse_object("Q", b=C.required(C.parse_int, "Int!"))), {"a": {"b": None}}, "Expected non-nullable type Int! not to be null at value.a.b."),
        (C.parse_object("P", a=C.required(C.parse_int, "Int!")), {}, "Field value.a of required type Int! was not provided."),
        (C.parse_object("P", name=C.parse_int), {"nmae": 1}, 'Field "nmae" is not defined by type P; Did you mean "name"?'),
        (C.parse_list(C.parse_list(C.parse_boolean)), [[True], [1]], "Expected type Boolean at value[1][0]; Boolean cannot represent 1"),
        (C.Enum("E", {"RED": 1}).parse, "REDD", 'Expected type E; Did you mean "RED"?'),
    ],
)
def test_refused_inputs_say_where(parse, value, message):
    with pytest.raises(ValueError) as e:
        parse(value)
    assert str(e.value) == message


def test_variables(people):
    given = lambda what, **values: Selector(people, values).value(what)
    assert given(Variable("v", 3)) == 3 and given([Variable("v"), 1]) == [None, 1] and given({"a": Variable("v"), "b": 1}) == {"b": 1}
    assert given(Variable("v", parse=C.parse_int), v=4) == 4
    for v, values, message in (
        (Variable("v", type="Int!"), {}, 'Variable "$v" of required type "Int!" was not provided.'),
        (Variable("v", type="Int!"), {"v": None}, 'Variable "$v" of non-null type "Int!" must not be null.'),
        (Variable("v", parse=C.parse_list(C.parse_int)), {"v": ["x"]}, 'Variable "$v" got invalid value ["x"]; Expected type Int at value[0]; Int cannot represent "x"'),
    ):
        with pytest.raises(SelectionError) as e:
            given(v, **values)
        assert str(e.value) == message


def test_subtypes(people):
    yes = [("Int", "Int"), ("Int!", "Int"), ("[Int!]!", "[Int]"), ("[[Int!]!]!", "[[Int!]]"), ("Person", "Named"), ("[Person!]", "[Named]")]
    no = [("Int", "Int!"), ("[Int]", "Int"), ("Int", "[Int]"), ("[Int]!", "[Int!]"), ("Named", "Person"), ("String", "Int")]
    assert all(people.subtype(a, b) for a, b in yes) and not any(people.subtype(a, b) for a, b in no)
