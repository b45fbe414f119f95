"""The star schema's tables as types with fields and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestframe.functions import coerce as C
from nestframe.operators.complete import Leaf, ListOf, NonNull
from nestframe.operators.nest import AbstractType, Arg, Edge, Field, ObjectType, Schema

STATUS = C.Enum("OrderStatus", {"FULFILLED": "F", "OPEN": "O", "PARTIAL": "P"})
FLAG = C.Enum("Flag", {"NO": 0, "YES": 1})
ORDER_FILTER = C.parse_object("OrderFilter", minTotal=C.parse_float, status=(STATUS.parse, C.UNSET), priorities=(C.parse_list(C.parse_string), C.UNSET))


def table(spark: SparkSession, sf_dir: str, name: str) -> Callable[[], DataFrame]:
    return lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_where(df: DataFrame, args: dict) -> DataFrame:
    """Arguments of an orders field as filters on columns, which reach the scan."""
    wanted = {**args, **(args.get("filter") or {})}
    if wanted.get("status") is not None:
        df = df.filter(F.col("o_orderstatus") == wanted["status"])
    if wanted.get("priorities") is not None:
        df = df.filter(F.col("o_orderpriority").isin(wanted["priorities"]))
    if wanted.get("minTotal") is not None:
        df = df.filter(F.col("o_totalprice") >= wanted["minTotal"])
    return df


ORDER_ARGS = {"status": Arg(STATUS.parse, type="OrderStatus"), "priorities": Arg(C.parse_list(C.parse_string), type="[String]"), "filter": Arg(ORDER_FILTER, type="OrderFilter"), "minTotal": Arg(C.parse_float, default=0.0, type="Float")}
INPUTS = {"OrderFilter": {"minTotal": ("Float", C.UNSET), "status": ("OrderStatus", C.UNSET), "priorities": ("[String]", C.UNSET)}}


def schema(spark: SparkSession, sf_dir: str) -> Schema:
    t = lambda name: table(spark, sf_dir, name)
    text = lambda c, **kw: Field(c, C.to_string, "string", **kw)
    ident = lambda c: Field(c, C.to_id, "bigint", non_null=True, type_name="ID")
    number = lambda c: Field(c, C.to_float, "double", type_name="Float")
    lines = lambda: table(spark, sf_dir, "lineitem")().withColumn("line_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))

    def part_lists() -> DataFrame:
        """Orders with their part keys as an array in line order."""
        by = table(spark, sf_dir, "lineitem")().groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
        return by.select(F.col("l_orderkey").alias("order_key"), F.transform("p", lambda x: x["l_partkey"]).alias("part_keys"))

    def positive(c: str, less: int) -> Field:
        return Field(lambda info: info.column(c).cast("int") - less, of=NonNull(Leaf("PositiveInt", "int", C.positive_int)), type_name="PositiveInt")

    def baskets() -> DataFrame:
        """Orders that hold their lines as an array of structs, and these's quantities as an array of arrays, two by two."""
        line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
        by = table(spark, sf_dir, "lineitem")().groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
        pairs = F.transform(F.sequence(F.lit(1), F.size("lines"), F.lit(2)), lambda i: F.transform(F.slice("lines", i, F.lit(2)), lambda x: x["l_quantity"].cast("int") - 3))
        return by.withColumn("first", F.get("lines", F.lit(0))).withColumn("pairs", pairs)

    small = Leaf("PositiveInt", "int", C.positive_int)
    held = {"number": Field("l_linenumber", C.to_int, "int", type_name="Int"), "part": Field("l_partkey", C.to_id, "bigint", type_name="ID")}
    return Schema.of(
        ObjectType("Region", t("region"), {"id": Field("r_regionkey", C.to_id, "int", type_name="ID"), "name": text("r_name"), "nations": Edge("Nation", "r_regionkey", "n_regionkey", many=True, order=("n_nationkey",))}, ("Named",), "r_regionkey"),
        ObjectType("Nation", t("nation"), {"id": Field("n_nationkey", C.to_id, "int", type_name="ID"), "name": text("n_name"), "region": Edge("Region", "n_regionkey", "r_regionkey")}, ("Named",), "n_nationkey"),
        ObjectType("Customer", t("customer"), {"id": ident("c_custkey"), "name": text("c_name"), "balance": number("c_acctbal"), "segment": text("c_mktsegment"), "mktsegment": text("c_mktsegment", deprecated="Use segment."), "nation": Edge("Nation", "c_nationkey", "n_nationkey"), "orders": Edge("Order", "c_custkey", "o_custkey", many=True, order=("o_orderkey",), args=ORDER_ARGS, where=orders_where)}, ("Named",), "c_custkey"),
        ObjectType("Supplier", t("supplier"), {"id": ident("s_suppkey"), "name": text("s_name"), "balance": number("s_acctbal"), "nation": Edge("Nation", "s_nationkey", "n_nationkey")}, ("Named",), "s_suppkey"),
        ObjectType("Part", t("part"), {"id": ident("p_partkey"), "name": text("p_name"), "brand": text("p_brand"), "size": Field("p_size", C.to_int, "int", type_name="Int"), "price": number("p_retailprice")}, ("Named",), "p_partkey"),
        ObjectType("Order", t("orders"), {"id": ident("o_orderkey"), "status": Field("o_orderstatus", STATUS.by_value, "string", type_name="OrderStatus"), "total": number("o_totalprice"), "date": Field("o_orderdate", C.to_datetime, "timestamp", type_name="DateTime"), "priority": text("o_orderpriority"), "customer": Edge("Customer", "o_custkey", "c_custkey"), "lines": Edge("Line", "o_orderkey", "l_orderkey", many=True, order=("l_linenumber", "l_partkey"))}, (), "o_orderkey"),
        ObjectType("Line", lines, {"id": Field("line_key", C.to_id, "string", type_name="ID"), "number": Field("l_linenumber", C.to_int, "int", type_name="Int"), "quantity": number("l_quantity"), "order": Edge("Order", "l_orderkey", "o_orderkey"), "part": Edge("Part", "l_partkey", "p_partkey"), "supplier": Edge("Supplier", "l_suppkey", "s_suppkey")}, (), "line_key"),
        ObjectType("PartList", part_lists, {"id": ident("order_key"), "parts": Edge("Part", "part_keys", "p_partkey", keys=True)}, (), "order_key"),
        ObjectType("StrictPart", t("part"), {"id": ident("p_partkey"), "name": text("p_name"), "size": positive("p_size", 10), "loose": Field(lambda info: F.col("p_size") - 10, of=small)}, (), "p_partkey"),
        ObjectType("Brand", lambda: table(spark, sf_dir, "part")().select("p_brand").distinct(), {"name": text("p_brand"), "parts": Edge("StrictPart", "p_brand", "p_brand", many=True, order=("p_partkey",)), "sure": Edge("StrictPart", "p_brand", "p_brand", many=True, order=("p_partkey",), item_non_null=True)}, (), "p_brand"),
        ObjectType("ReturnedLine", baskets, {**held, "returned": Field(lambda info: F.lit(True), type_name="Boolean")}),
        ObjectType("KeptLine", baskets, {**held, "quantity": Field("l_quantity", C.to_float, "double", type_name="Float")}),
        ObjectType("Basket", baskets, {"id": ident("l_orderkey"), "first": Field("first", of="KeptLine"), "lines": Field("lines", of=ListOf("BasketLine")), "pairs": Field("pairs", of=ListOf(ListOf(small))), "strict": Field("pairs", of=ListOf(ListOf(NonNull(small))))}, (), "l_orderkey"),
        AbstractType("BasketLine", ("ReturnedLine", "KeptLine"), lambda info: F.when(info.column("l_returnflag") == "R", F.lit("ReturnedLine")).when(info.column("l_returnflag") == "N", F.lit("KeptLine"))),
        ObjectType("Props", t("events"), {"k": Field("k", C.to_int, "string", type_name="Int"), "missing": Field("none", C.to_string, "string")}),
        ObjectType("Event", t("events"), {"id": Field("event_id", C.to_id, "bigint", type_name="ID"), "props": Field(lambda info: F.from_json(info.column("props"), "map<string,string>"), of="Props")}, (), "event_id"),
        ObjectType("Click", t("events"), {"id": Field("event_id", C.to_id, "bigint", type_name="ID"), "user": Field("user_id", C.to_id, "bigint", type_name="ID")}),
        ObjectType("Purchase", t("events"), {"id": Field("event_id", C.to_id, "bigint", type_name="ID"), "amount": number("value")}),
        AbstractType("Activity", ("Click", "Purchase"), lambda info: F.initcap(info.column("event_type")), t("events")),
        ObjectType("Country", t("nation"), {"name": text("n_name"), "parties": Edge("Party", "n_nationkey", {"Customer": "c_nationkey", "Supplier": "s_nationkey"}, many=True, order={"Customer": ("c_custkey",), "Supplier": ("s_suppkey",)})}, ("Named",), "n_nationkey"),
        AbstractType("Party", ("Customer", "Supplier")),
        AbstractType("Named", ("Region", "Nation", "Customer", "Supplier", "Part")),
        inputs=INPUTS,
        roots={"query": "Customer"},
    )
