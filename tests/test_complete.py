"""Completion: unions and interfaces, embedded values, errors with paths, nulls that go up."""

import json

import pytest
from pyspark.sql import functions as F

from nestframe.functions import coerce as C
from nestframe.operators.complete import Leaf, ListOf, NonNull
from nestframe.operators.nest import AbstractType, ByName, Edge, Field, Info, ObjectType, Schema, SelectionError, Selector, operation, pick, spread

TEXT, BOOL = Leaf("String", "string", C.to_string), Leaf("Boolean", "boolean", C.to_boolean)
PET = "struct<kind:string,name:string,barks:boolean,meows:boolean>"


def positive(of="Int"):
    return Leaf("PositiveInt", "int", C.positive_int)


@pytest.fixture(scope="module")
def zoo(spark):
    rows = [("John", [("Cat", "Garfield", None, False), ("Dog", "Odie", True, None)]), ("Liz", None), ("Jon", [("Cow", "Bess", None, None), (None, "Ghost", None, None), None])]
    people = spark.createDataFrame(rows, f"name string, pets array<{PET}>")
    shape = {"name": Field(of=TEXT)}
    dog, cat = (ObjectType(n, lambda: people, {**shape, f: Field(of=BOOL)}, ("Named",)) for n, f in (("Dog", "barks"), ("Cat", "meows")))
    cow = ObjectType("Cow", lambda: people, shape)
    pet = AbstractType("Pet", ("Dog", "Cat"), resolve=lambda info: info.column("kind"))
    bare = AbstractType("Bare", ("Dog", "Cat"))
    fields = {**shape, "pets": Field("pets", of=ListOf("Pet")), "sure": Field("pets", of=ListOf(NonNull("Pet"))), "bare": Field("pets", of=ListOf("Bare"))}
    person = ObjectType("Person", lambda: people, fields, ("Named",), "name")
    return Schema.of(dog, cat, cow, pet, bare, person, AbstractType("Named", ("Dog", "Cat", "Person")))


def results(df):
    return {r["name"]: json.loads(r["result"]) for r in df.collect()}


def test_union_of_embedded_values(zoo):
    picks = pick("pets", pick("__typename"), spread(pick("name"), pick("barks"), on="Dog"), spread(pick("name"), pick("meows"), on="Cat"))
    got = results(Selector(zoo).json("Person", pick("name"), picks, keep=("name",)))
    assert got["John"] == {"data": {"name": "John", "pets": [{"__typename": "Cat", "name": "Garfield", "barks": None, "meows": False}, {"__typename": "Dog", "name": "Odie", "barks": True, "meows": None}]}}
    assert got["Liz"] == {"data": {"name": "Liz", "pets": None}}
    assert got["Jon"]["data"] == {"name": "Jon", "pets": [None, None, None]}
    assert [e["path"] for e in got["Jon"]["errors"]] == [["pets", 0], ["pets", 1]]
    assert got["Jon"]["errors"][0]["message"] == 'Runtime Object type "Cow" is not a possible type for "Pet".'
    assert got["Jon"]["errors"][1]["message"] == 'Abstract type Pet must resolve to an Object type at runtime for field Person.pets with value {"name":"Ghost"}, received nil.'


def test_fragments_on_interfaces_of_union_members(zoo):
    got = results(Selector(zoo).json("Person", pick("pets", spread(pick("name", alias="n"), on="Named")), keep=("name",)))
    assert got["John"] == {"data": {"pets": [{"n": "Garfield"}, {"n": "Odie"}]}}


def test_items_that_may_not_be_null_null_their_list(zoo):
    got = results(Selector(zoo).json("Person", pick("sure", pick("name")), keep=("name",)))
    assert got["Jon"]["data"] == {"sure": None} and len(got["Jon"]["errors"]) == 1 and got["Jon"]["errors"][0]["path"] == ["sure", 0]


def test_a_union_without_a_resolver(zoo):
    got = results(Selector(zoo).json("Person", pick("bare", pick("name")), keep=("name",)))
    assert got["John"]["errors"][0]["message"].startswith("Abstract type Bare must provide resolver to resolve to an Object type at runtime for field Person.bare with value {")


@pytest.fixture(scope="module")
def deep(spark):
    rows = [(1, [[1, 2], [0, 3]], 5), (2, [None, [4]], None), (3, None, 7)]
    df = spark.createDataFrame(rows, "id int, m array<array<int>>, n int").withColumn("o", F.when(F.col("id") < 3, F.struct(F.col("n").alias("size"), F.struct(F.col("n").alias("size")).alias("in"))))
    of = lambda x: Field("m", of=x)
    fields = {
        "id": Field("id", C.to_int, "int"),
        "loose": of(ListOf(ListOf(positive()))),
        "inner": of(ListOf(ListOf(NonNull(positive())))),
        "outer": of(ListOf(NonNull(ListOf(NonNull(positive()))))),
        "whole": of(NonNull(ListOf(NonNull(ListOf(NonNull(positive())))))),
        "scalar": Field("n", of=ListOf(positive())),
        "box": Field("o", of="Box"),
        "sure": Field("o", of=NonNull("Box")),
    }
    box = ObjectType("Box", lambda: df, {"size": Field("size", C.to_int, "int"), "must": Field("size", C.to_int, "int", non_null=True), "in": Field("in", of="Box"), "really": Field("in", of=NonNull("Box"))})
    return Schema.of(ObjectType("T", lambda: df, fields, (), "id"), box)


def of(schema, *picks):
    rows = Selector(schema).json("T", *picks, keep=("id",)).collect()
    return {r["id"]: json.loads(r["result"]) for r in rows}


ZERO = "PositiveInt cannot represent 0: not positive"


@pytest.mark.parametrize(("name", "one", "two"), [("loose", [[1, 2], [None, 3]], [None, [4]]), ("inner", [[1, 2], None], [None, [4]]), ("outer", None, None)])
def test_lists_of_lists(deep, name, one, two):
    got = of(deep, pick(name))
    assert got[1]["data"] == {name: one} and got[1]["errors"] == [{"message": ZERO, "path": [name, 1, 0]}]
    assert got[2]["data"] == {name: two} and got[3] == {"data": {name: None}}
    assert got[2].get("errors") == ([{"message": "Cannot return null for non-nullable field T.outer.", "path": ["outer", 0]}] if name == "outer" else None)


def test_a_null_goes_up_to_the_root(deep):
    got = of(deep, pick("whole"), pick("scalar"))
    assert got[1] == {"errors": [{"message": ZERO, "path": ["whole", 1, 0]}], "data": None}
    assert got[3] == {"errors": [{"message": "Cannot return null for non-nullable field T.whole.", "path": ["whole"]}], "data": None}


def test_a_column_that_is_no_list(deep):
    got = of(deep, pick("scalar"))
    assert got[1] == {"errors": [{"message": "Expected Iterable, but did not find one for field T.scalar.", "path": ["scalar"]}], "data": {"scalar": None}}
    assert got[2] == {"data": {"scalar": None}}


def test_embedded_objects(deep):
    got = of(deep, pick("box", pick("in", pick("size"), pick("__typename")), pick("size", alias="s")))
    assert got[1] == {"data": {"box": {"in": {"size": 5, "__typename": "Box"}, "s": 5}}} and got[3] == {"data": {"box": None}}
    got = of(deep, pick("box", pick("really", pick("must"), alias="a"), pick("size")))
    missing = {"message": "Cannot return null for non-nullable field Box.must.", "path": ["box", "a", "must"]}
    assert got[2] == {"errors": [missing], "data": {"box": None}}
    assert of(deep, pick("sure", pick("size")))[3]["data"] is None


def test_edges_carry_errors_and_nulls(spark):
    parents = spark.createDataFrame([(1, [10, 11]), (2, [12]), (3, [10, 99])], "id int, kids array<int>")
    kids = spark.createDataFrame([(10, 1, 4), (11, 1, 0), (12, 2, 5)], "kid int, of int, n int")
    kid = ObjectType("Kid", lambda: kids, {"n": Field("n", of=NonNull(positive())), "soft": Field("n", of=positive())}, (), "kid")
    many = lambda **kw: Edge("Kid", "id", "of", many=True, order=("kid",), **kw)
    fields = {"kids": many(), "sure": many(item_non_null=True), "must": many(item_non_null=True, non_null=True), "listed": Edge("Kid", "kids", "kid", keys=True), "found": Edge("Kid", "kids", "kid", keys=True, item_non_null=True), "one": Edge("Kid", "id", "kid", non_null=True)}
    schema = Schema.of(kid, ObjectType("T", lambda: parents, fields, (), "id"))
    low = lambda *path: {"message": ZERO, "path": list(path)}
    assert of(schema, pick("kids", pick("n")))[1] == {"errors": [low("kids", 1, "n")], "data": {"kids": [{"n": 4}, None]}}
    assert of(schema, pick("kids", pick("soft")))[1] == {"errors": [low("kids", 1, "soft")], "data": {"kids": [{"soft": 4}, {"soft": None}]}}
    assert of(schema, pick("sure", pick("n")))[1] == {"errors": [low("sure", 1, "n")], "data": {"sure": None}}
    assert of(schema, pick("must", pick("n"))) == {1: {"errors": [low("must", 1, "n")], "data": None}, 2: {"data": {"must": [{"n": 5}]}}, 3: {"data": {"must": []}}}
    assert of(schema, pick("listed", pick("n")))[3] == {"data": {"listed": [{"n": 4}, None]}}
    assert of(schema, pick("found", pick("n")))[3] == {"errors": [{"message": "Cannot return null for non-nullable field T.found.", "path": ["found", 1]}], "data": {"found": None}}
    assert of(schema, pick("one", pick("n")))[2]["errors"] == [{"message": "Cannot return null for non-nullable field T.one.", "path": ["one"]}]


def test_unions_of_tables_and_of_one_table(spark):
    a, b = spark.createDataFrame([(1, "x", 5)], "pid int, name string, size int"), spark.createDataFrame([(1, "y", True), (2, "z", False)], "own int, name string, barks boolean")
    parents, mixed = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, "A", "x"), (1, "Q", "w"), (3, None, "v")], "of int, kind string, name string")
    of_a = ObjectType("A", lambda: a, {"name": Field(of=TEXT), "size": Field("size", C.to_int, "int")}, ("Thing",))
    of_b = ObjectType("B", lambda: b, {"name": Field(of=TEXT), "barks": Field(of=BOOL)}, ("Thing",))
    one = AbstractType("Mixed", ("A", "B"), lambda info: info.column("kind"), lambda: mixed)
    edges = {"things": Edge("Thing", "id", {"A": "pid", "B": "own"}, many=True, order={"A": ("name",), "B": ("name",)}), "mixed": Edge("Mixed", "id", "of", many=True, order=("name",))}
    schema = Schema.of(of_a, of_b, one, AbstractType("Thing", ("A", "B")), ObjectType("T", lambda: parents, edges, (), "id"))
    got = of(schema, pick("things", pick("__typename"), pick("name"), spread(pick("size"), on="A")))
    assert got[1]["data"]["things"] == [{"__typename": "A", "name": "x", "size": 5}, {"__typename": "B", "name": "y", "size": None}] and got[3]["data"]["things"] == []
    got = of(schema, pick("mixed", pick("__typename"), pick("name")))
    assert got[1]["data"]["mixed"] == [None, {"__typename": "A", "name": "x"}] and [e["path"] for e in got[1]["errors"]] == [["mixed", 0]]
    assert [r["name"] for r in Selector(schema).rows("Mixed", pick("name")).collect()] == ["x"]


def test_what_a_resolver_sees(spark):
    df = spark.createDataFrame([(1, "n")], "id int, my_name string").withColumn("o", F.struct(F.col("my_name")))
    seen = []

    def look(info: Info):
        seen.append((info.path, dict(info), info.selected(), info.parent.selected(), info.variables))
        return info.column("my_name")

    inner = ObjectType("In", lambda: df, {"deep": Field(look), "myName": Field(of=TEXT)})
    outer = ObjectType("T", lambda: df, {"box": Field("o", of="In"), "myName": Field(of=TEXT)}, (), "id")
    short = ObjectType("Short", lambda: df, {"name": Field(of=TEXT)})
    selector = Selector(Schema.of(inner, outer), {"v": 1}, default=ByName(snake=True))
    got = selector.rows("T", pick("myName"), pick("box", pick("deep", alias="d"), pick("myName"))).first()
    assert got["myName"] == "n" and got["box"]["d"] == "n" and got["box"]["myName"] == "n"
    assert seen == [(("box", "d"), {}, (), ("deep", "myName"), {"v": 1})]
    assert Selector(Schema.of(short), default=ByName(prefix="my_")).rows("Short", pick("name")).first()["name"] == "n"


def test_operations_by_name():
    assert operation({None: 1}) == 1 and operation({"a": 1, "b": 2}, "b") == 2
    for known, name, message in (({}, None, "Must provide an operation."), ({"a": 1, "b": 2}, None, "Must provide operation name if query contains multiple operations."), ({"a": 1}, "c", 'Unknown operation named "c".')):
        with pytest.raises(SelectionError, match=message):
            operation(known, name)
