"""Queries over the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestframe.functions import coerce as C
from nestframe.functions import text
from nestframe.operators import nulls
from nestframe.operators.batch import Lookup, in_batches
from nestframe.operators.nest import Arg, ByName, Field, ObjectType, Pick, Schema, Selector, Spread, Variable, operation, pick, spread
from nestframe.operators.write import Versions, Write, mutate, read_lines, write_lines
from nestframe.plans import catalog, log_checks
from nestframe.sources.tables import FLAG, STATUS, schema
from nestframe.storage import new_path, stored
from nestframe.streaming.subscribe import subscribe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rows(name: str, type_: str, *picks: Pick | Spread, sql: str, flat: dict[str, str] | None = None, variables: dict | None = None) -> None:
    """A query by selection; ``flat`` names expressions over its response keys."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Selector(schema(spark, sf_dir), variables).rows(type_, *picks)
        return out.select(*[F.expr(e).alias(n) for n, e in flat.items()]) if flat else out

    add(name, sql)(run)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


CUSTOMER = "SELECT c_custkey::VARCHAR AS id, c_name AS name"
ORDER = "SELECT o_orderkey::VARCHAR AS id"
STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'FULFILLED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PARTIAL' END"

# Projection.
rows("field_selection", "Customer", pick("name"), pick("segment"), sql="SELECT c_name AS name, c_mktsegment AS segment FROM customer")
rows("alias", "Customer", pick("id"), pick("name", alias="n"), sql="SELECT c_custkey::VARCHAR AS id, c_name AS n FROM customer")
rows("field_merge", "Customer", pick("id"), pick("nation", pick("name")), pick("nation", pick("id")), flat={"id": "id", "nation_name": "nation.name", "nation_id": "nation.id"}, sql="SELECT c_custkey::VARCHAR AS id, n_name AS nation_name, n_nationkey::VARCHAR AS nation_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
rows("typename", "Region", pick("__typename"), pick("name"), flat={"type_name": "__typename", "name": "name"}, sql="SELECT 'Region' AS type_name, r_name AS name FROM region")
rows("fragment_spread", "Customer", spread(pick("id"), pick("name")), pick("segment"), sql=f"{CUSTOMER}, c_mktsegment AS segment FROM customer")
rows("fragment_nested", "Customer", spread(pick("id"), spread(pick("name"), on="Named"), on="Customer"), sql=f"{CUSTOMER} FROM customer")
rows("fragment_repeat", "Customer", spread(pick("id"), pick("name")), spread(pick("id"), pick("name")), sql=f"{CUSTOMER} FROM customer")
rows("inline_fragment", "Customer", pick("id"), spread(pick("name"), on="Customer"), spread(pick("balance"), on="Supplier"), sql=f"{CUSTOMER} FROM customer")
rows("inline_fragment_untyped", "Customer", pick("id"), spread(pick("name")), sql=f"{CUSTOMER} FROM customer")
rows("skip_true", "Customer", pick("id"), pick("name"), pick("segment", skip=True), sql=f"{CUSTOMER} FROM customer")
rows("skip_false", "Customer", pick("id"), pick("name", skip=False), sql=f"{CUSTOMER} FROM customer")
rows("include_true", "Customer", pick("id"), pick("name", include=Variable("yes")), variables={"yes": True}, sql=f"{CUSTOMER} FROM customer")
rows("include_false", "Customer", pick("id"), pick("name"), pick("segment", include=Variable("yes")), variables={"yes": False}, sql=f"{CUSTOMER} FROM customer")
rows("skip_include", "Customer", pick("id"), pick("name"), spread(pick("segment"), skip=True, include=True), sql=f"{CUSTOMER} FROM customer")

# Relationships.
rows("to_one", "Order", pick("id"), pick("customer", pick("name")), flat={"id": "id", "customer_name": "customer.name"}, sql=f"{ORDER}, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
rows("to_one_chain", "Line", pick("id"), pick("order", pick("customer", pick("nation", pick("region", pick("name"))))), flat={"id": "id", "region_name": "order.customer.nation.region.name"}, sql="SELECT l_orderkey || '-' || l_linenumber AS id, r_name AS region_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
rows("to_many", "Customer", pick("id"), pick("orders", pick("id")), flat={"id": "id", "order_ids": "array_join(transform(orders, x -> x.id), ',')"}, sql="SELECT c_custkey::VARCHAR AS id, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS order_ids FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
rows("to_many_nested", "Customer", pick("id"), pick("orders", pick("id"), pick("lines", pick("part", pick("name")))), flat={"id": "id", "part_names": "array_join(flatten(transform(orders, o -> transform(o.lines, l -> l.part.name))), '|')"}, sql="SELECT c_custkey::VARCHAR AS id, coalesce(string_agg(p_name, '|' ORDER BY o_orderkey, l_linenumber, l_partkey), '') AS part_names FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY c_custkey")
rows("load_many", "PartList", pick("id"), pick("parts", pick("name")), flat={"id": "id", "part_names": "array_join(transform(parts, x -> x.name), '|')"}, sql="SELECT l_orderkey::VARCHAR AS id, coalesce(string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey), '') AS part_names FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
rows("self_recursive", "Nation", pick("id"), pick("region", pick("nations", pick("name"), pick("region", pick("name")))), flat={"id": "id", "neighbours": "array_join(transform(region.nations, x -> concat(x.name, ':', x.region.name)), ',')"}, sql="SELECT a.n_nationkey::VARCHAR AS id, string_agg(b.n_name || ':' || r_name, ',' ORDER BY b.n_nationkey) AS neighbours FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region ON b.n_regionkey = r_regionkey GROUP BY a.n_nationkey")
rows("siblings", "Customer", pick("id"), pick("orders", pick("id"), alias="open", status="OPEN"), pick("orders", pick("id"), alias="done", status="FULFILLED"), flat={"id": "id", "n_open": "size(open)", "n_done": "size(done)"}, sql="SELECT c_custkey::VARCHAR AS id, count(*) FILTER (o_orderstatus = 'O')::INT AS n_open, count(*) FILTER (o_orderstatus = 'F')::INT AS n_done FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")

# Arguments, on the edge from customers to orders.
COUNTED = {"id": "id", "n": "size(orders)"}
COUNT_SQL = "SELECT c_custkey::VARCHAR AS id, count(o_orderkey)::INT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {} GROUP BY c_custkey"
rows("arg_enum", "Customer", pick("id"), pick("orders", pick("id"), status="FULFILLED"), flat=COUNTED, sql=COUNT_SQL.format("o_orderstatus = 'F'"))
rows("arg_eq", "Customer", pick("id"), pick("orders", pick("id"), minTotal=1000.0), flat=COUNTED, sql=COUNT_SQL.format("o_totalprice >= 1000"))
rows("arg_default", "Customer", pick("id"), pick("orders", pick("id")), flat=COUNTED, sql=COUNT_SQL.format("o_totalprice >= 0"))
rows("arg_null", "Customer", pick("id"), pick("orders", pick("id"), status=None), flat=COUNTED, sql=COUNT_SQL.format("true"))
rows("arg_variable", "Customer", pick("id"), pick("orders", pick("id"), status=Variable("s")), variables={"s": "OPEN"}, flat=COUNTED, sql=COUNT_SQL.format("o_orderstatus = 'O'"))
rows("arg_variable_default", "Customer", pick("id"), pick("orders", pick("id"), status=Variable("s", "PARTIAL")), flat=COUNTED, sql=COUNT_SQL.format("o_orderstatus = 'P'"))
rows("arg_list", "Customer", pick("id"), pick("orders", pick("id"), priorities=["1-URGENT", "2-HIGH"]), flat=COUNTED, sql=COUNT_SQL.format("o_orderpriority IN ('1-URGENT', '2-HIGH')"))
rows("arg_list_of_one", "Customer", pick("id"), pick("orders", pick("id"), priorities="1-URGENT"), flat=COUNTED, sql=COUNT_SQL.format("o_orderpriority IN ('1-URGENT')"))
rows("arg_input_object", "Customer", pick("id"), pick("orders", pick("id"), filter={"minTotal": 5000.0, "status": "OPEN"}), flat=COUNTED, sql=COUNT_SQL.format("o_totalprice >= 5000 AND o_orderstatus = 'O'"))

# Abstract types.
rows("union_type", "Party", pick("__typename"), spread(pick("id"), pick("segment"), on="Customer"), spread(pick("id"), pick("balance"), on="Supplier"), flat={"type_name": "__typename", "id": "id", "segment": "segment", "balance": "balance"}, sql="SELECT 'Customer' AS type_name, c_custkey::VARCHAR AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR, NULL, s_acctbal FROM supplier")
rows("interface_type", "Named", pick("__typename"), pick("name"), flat={"type_name": "__typename", "name": "name"}, sql="SELECT 'Region' AS type_name, r_name AS name FROM region UNION ALL SELECT 'Nation', n_name FROM nation UNION ALL SELECT 'Customer', c_name FROM customer UNION ALL SELECT 'Supplier', s_name FROM supplier UNION ALL SELECT 'Part', p_name FROM part")

# Coercion.
rows("custom_scalar_date", "Order", pick("id"), pick("date"), sql=f"{ORDER}, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date FROM orders")
rows("enum_by_value", "Order", pick("id"), pick("status"), sql=f"{ORDER}, {STATUS_SQL} AS status FROM orders")
rows("int_coerce", "Part", pick("id"), pick("size"), sql="SELECT p_partkey::VARCHAR AS id, p_size AS size FROM part")
rows("float_coerce", "Part", pick("id"), pick("price"), sql="SELECT p_partkey::VARCHAR AS id, p_retailprice AS price FROM part")
rows("id_coerce", "Supplier", pick("id"), sql="SELECT s_suppkey::VARCHAR AS id FROM supplier")


@add("int_overflow_null", "SELECT event_id, CASE WHEN event_id * 3000000 BETWEEN -2147483648 AND 2147483647 THEN (event_id * 3000000)::INT END AS value, CASE WHEN NOT event_id * 3000000 BETWEEN -2147483648 AND 2147483647 THEN 'Int cannot represent ' || (event_id * 3000000) || ': value too ' || CASE WHEN event_id > 0 THEN 'large' ELSE 'small' END || ' for 32-bit signed integer' END AS message FROM events")
def int_overflow_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.to_int(F.col("event_id") * 3_000_000, "bigint")
    return read(spark, sf_dir, "events").select("event_id", c.value.alias("value"), c.message.alias("message"))


@add("nan_to_null", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").select("event_id", C.to_float(c, "double").value.alias("value"))


@add("string_coerce", "SELECT p_partkey, p_size::DOUBLE::BIGINT::VARCHAR AS size FROM part")
def string_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", C.to_string(F.col("p_size").cast("double"), "double").value.alias("size"))


@add("bool_coerce", "SELECT doc_id, toxic <> 0 AS toxic FROM labels")
def bool_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", C.to_boolean(F.col("toxic"), "int").value.alias("toxic"))


@add("enum_by_name", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS segment FROM customer")
def enum_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = C.Enum("Segment", {"BUILDING": "BUILDING", "MACHINERY": "MACHINERY"})
    return read(spark, sf_dir, "customer").select("c_custkey", segment.by_name(F.col("c_mktsegment"), "string").value.alias("segment"))


@add("enum_flag", "SELECT doc_id, CASE quality WHEN 0 THEN 'NO' WHEN 1 THEN 'YES' END AS quality FROM labels")
def enum_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", FLAG.by_value(F.col("quality"), "int").value.alias("quality"))


@add("scalar_alias", "SELECT p_partkey, CASE WHEN p_size - 10 > 0 THEN p_size - 10 END AS size, CASE WHEN p_size - 10 <= 0 THEN 'PositiveInt cannot represent ' || (p_size - 10) || ': not positive' END AS message FROM part")
def scalar_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.positive_int(F.col("p_size") - 10, "int")
    return read(spark, sf_dir, "part").select("p_partkey", c.value.alias("size"), c.message.alias("message"))


# Nulls, lists and maps.
REFUSED = "'PositiveInt cannot represent ' || (p_size - 10) || ': not positive'"


@add("non_null_bubble", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS name FROM part")
def non_null_bubble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part object whose non-null size is refused is null as a whole."""
    return Selector(schema(spark, sf_dir)).results("StrictPart", pick("name"), pick("size"), keep=("p_partkey",)).select("p_partkey", "data.name")


def _sizes(spark: SparkSession, sf_dir: str, non_null: bool) -> DataFrame:
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("q"))
    values = nulls.items(F.transform("q", lambda x: x["l_quantity"].cast("int") - 3), lambda x: C.positive_int(x, "int"), non_null)
    return lists.select("l_orderkey", F.array_join(values, ",", "null").alias("quantities"))


@add("nullable_list", "SELECT l_orderkey, string_agg(CASE WHEN l_quantity::INT - 3 > 0 THEN (l_quantity::INT - 3)::VARCHAR ELSE 'null' END, ',' ORDER BY l_linenumber, l_quantity) AS quantities FROM lineitem GROUP BY l_orderkey")
def nullable_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir, False)


@add("non_null_list", "SELECT l_orderkey, CASE WHEN min(l_quantity::INT) > 3 THEN string_agg((l_quantity::INT - 3)::VARCHAR, ',' ORDER BY l_linenumber, l_quantity) END AS quantities FROM lineitem GROUP BY l_orderkey")
def non_null_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir, True)


@add("list_nested", "SELECT vec_id, len(embedding)::INT AS n, embedding[9]::DOUBLE AS ninth FROM embeddings")
def list_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as a list of lists of eight."""
    chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return read(spark, sf_dir, "embeddings").withColumn("chunks", chunks).select("vec_id", F.size(F.flatten("chunks")).alias("n"), F.get(F.get("chunks", F.lit(1)), F.lit(0)).cast("double").alias("ninth"))


@add("map_keys", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def map_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", F.array_join(F.sort_array(F.map_keys(parsed)), ",").alias("keys"))


@add("field_errors", f"SELECT p_partkey, CASE WHEN p_size > 10 THEN '{{\"data\":{{\"loose\":' || (p_size - 10) || '}}}}' ELSE '{{\"errors\":[{{\"message\":\"' || {REFUSED} || '\",\"path\":[\"loose\"]}}],\"data\":{{\"loose\":null}}}}' END AS result FROM part")
def field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Selector(schema(spark, sf_dir)).json("StrictPart", pick("loose"), keep=("p_partkey",))


@add("json_envelope", "SELECT c_custkey, '{\"data\":{\"name\":\"' || c_name || '\",\"nation\":' || CASE WHEN n_name IS NULL THEN 'null' ELSE '{\"name\":\"' || n_name || '\"}' END || '}}' AS result FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Selector(schema(spark, sf_dir)).json("Customer", pick("name"), pick("nation", pick("name")), keep=("c_custkey",))


# Batched lookups.
@add("batch_lookup", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    lookup = Lookup(lambda keys: customers.join(keys, "key", "left_semi"), "key")
    return lookup.many(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))).select("o_orderkey", "found.c_name")


@add("batch_cache_prime", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'primed' ELSE c_name END AS c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 5 <> 0 OR o_custkey IN (SELECT c_custkey FROM customer)")
def batch_cache_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    lookup = Lookup(lambda keys: customers.join(keys, "key", "left_semi"), "key").prime(customers.filter("key % 5 = 0").select("key", F.lit("primed").alias("c_name")))
    return lookup.many(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))).select("o_orderkey", "found.c_name")


@add("batch_max_size", "SELECT c_custkey AS key, c_custkey * 2 AS twice, true AS small FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def batch_max_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loader that is called with up to seven keys at a time."""
    load = in_batches(lambda keys: pd.DataFrame({"key": keys, "twice": keys * 2, "small": len(keys) <= 7}), "key", "key long, twice long, small boolean", 7)
    return Lookup(load, "key").get(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


@add("batch_errors", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 OR o_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN o_custkey % 7 = 0 THEN 'must specify key to identify data to be loaded' WHEN o_custkey % 5 = 0 THEN 'no customer ' || o_custkey END AS error FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are null, and keys for which an error is primed."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    lookup = Lookup(lambda keys: customers.join(keys, "key", "left_semi"), "key")
    lookup.prime_error(customers.filter("key % 5 = 0").select("key", F.concat(F.lit("no customer "), "key").alias("message")))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("key"))
    return lookup.many(orders, error="error").select("o_orderkey", "found.c_name", "error")


@add("batch_custom_key", "SELECT o_orderkey, min(c.c_custkey) OVER (PARTITION BY o_custkey % 10) AS loaded FROM orders JOIN customer c ON o_custkey = c_custkey")
def batch_custom_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are one if their last digits are: the smallest is loaded for all."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("loaded"))
    lookup = Lookup(lambda keys: customers.join(keys, "key", "left_semi"), "key", lambda c: c % 10)
    orders = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("key"), "left_semi").select("o_orderkey", F.col("o_custkey").alias("key"))
    return lookup.many(orders).select("o_orderkey", "found.loaded")


# Abstract types and embedded values within objects.
rows("pets_union", "Country", pick("name"), pick("parties", pick("__typename"), spread(pick("id"), pick("segment"), on="Customer"), spread(pick("id"), on="Supplier")), flat={"name": "name", "parties": "array_join(transform(parties, x -> concat_ws(':', x.__typename, x.id, x.segment)), ',')"}, sql="SELECT n_name AS name, coalesce((SELECT string_agg(t || ':' || k || coalesce(':' || s, ''), ',' ORDER BY k, (t || ':' || k || coalesce(':' || s, ''))) FROM (SELECT 'Customer' AS t, c_custkey AS k, c_mktsegment AS s, c_nationkey AS n FROM customer UNION ALL SELECT 'Supplier', s_suppkey, NULL, s_nationkey FROM supplier) p WHERE p.n = n_nationkey), '') AS parties FROM nation")
rows("friends_interface", "Country", pick("name"), pick("parties", spread(pick("__typename"), pick("name"), on="Named"), spread(pick("balance"), on="Supplier")), flat={"name": "name", "n": "size(parties)", "n_suppliers": "size(filter(parties, x -> x.__typename = 'Supplier'))", "balances": "round(aggregate(parties, 0D, (a, x) -> a + coalesce(x.balance, 0D)), 2)"}, sql="SELECT n_name AS name, ((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey))::INT AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::INT AS n_suppliers, round(coalesce((SELECT sum(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey), 0), 2) AS balances FROM nation")
rows("resolved_rows", "Activity", pick("__typename"), pick("id"), spread(pick("user"), on="Click"), spread(pick("amount"), on="Purchase"), flat={"type_name": "__typename", "id": "id", "user": "user", "amount": "amount"}, sql="SELECT CASE event_type WHEN 'click' THEN 'Click' ELSE 'Purchase' END AS type_name, event_id::VARCHAR AS id, CASE event_type WHEN 'click' THEN user_id::VARCHAR END AS user, CASE event_type WHEN 'purchase' THEN value END AS amount FROM events WHERE event_type IN ('click', 'purchase')")
rows("embedded_struct", "Basket", pick("id"), pick("first", pick("part"), pick("quantity", alias="q")), flat={"id": "id", "part": "first.part", "q": "first.q"}, sql="SELECT l_orderkey::VARCHAR AS id, x.l_partkey::VARCHAR AS part, x.l_quantity AS q FROM (SELECT l_orderkey, min(struct_pack(l_linenumber, l_partkey, l_quantity)) AS x FROM lineitem GROUP BY l_orderkey)")
LINE_SQL = "CASE l_returnflag WHEN 'R' THEN 'ReturnedLine:' || l_partkey || ':true' WHEN 'N' THEN 'KeptLine:' || l_partkey ELSE 'null' END"
rows("embedded_list", "Basket", pick("id"), pick("lines", pick("__typename"), pick("part"), spread(pick("returned"), on="ReturnedLine")), flat={"id": "id", "lines": "array_join(transform(lines, x -> if(x IS NULL, 'null', concat_ws(':', x.__typename, x.part, x.returned))), ',')"}, sql=f"SELECT l_orderkey::VARCHAR AS id, string_agg({LINE_SQL}, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS lines FROM lineitem GROUP BY l_orderkey")
PAIRS_SQL = "SELECT l_orderkey, (row_number() OVER w - 1) // 2 AS pair, (row_number() OVER w - 1) % 2 AS place, l_quantity::INT - 3 AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag)"


@add("embedded_nested_lists", f"SELECT l_orderkey, string_agg(CASE WHEN least < 1 THEN 'null' ELSE items END, '|' ORDER BY pair) AS strict, coalesce(string_agg(failed, ';' ORDER BY pair), '') AS paths FROM (SELECT l_orderkey, pair, min(q) AS least, string_agg(q::VARCHAR, ',' ORDER BY place) AS items, 'strict,' || pair || ',' || min(place) FILTER (q < 1) AS failed FROM ({PAIRS_SQL}) GROUP BY l_orderkey, pair) GROUP BY l_orderkey")
def embedded_nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of lists whose items may not be null: an inner list with a refused item is null, and its first refused item has an error."""
    out = Selector(schema(spark, sf_dir)).results("Basket", pick("strict"), keep=("l_orderkey",))
    lists = F.array_join(F.transform("data.strict", lambda x: F.coalesce(F.array_join(x, ","), F.lit("null"))), "|")
    return out.select("l_orderkey", lists.alias("strict"), F.array_join(F.transform("errors", lambda e: F.array_join(e["path"], ",")), ";").alias("paths"))


@add("edge_errors", "SELECT p_brand, count(*)::INT AS n, count(*) FILTER (p_size <= 10)::INT AS n_null, count(*) FILTER (p_size <= 10)::INT AS n_errors FROM part GROUP BY p_brand")
def edge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of objects of which some are null, each with its error."""
    out = Selector(schema(spark, sf_dir)).results("Brand", pick("parts", pick("size")), keep=("p_brand",))
    return out.select("p_brand", F.size("data.parts").alias("n"), F.size(F.filter("data.parts", lambda x: x.isNull())).alias("n_null"), F.size("errors").alias("n_errors"))


@add("edge_bubble", "SELECT p_brand, min(p_size) <= 10 AS is_null, CASE WHEN min(p_size) <= 10 THEN 'sure.' || ((min(r) FILTER (p_size <= 10)) - 1) || '.size' END AS path FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) GROUP BY p_brand")
def edge_bubble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list whose objects may not be null: null as a whole, with the error of the first that is refused."""
    out = Selector(schema(spark, sf_dir)).results("Brand", pick("sure", pick("size")), keep=("p_brand",))
    return out.select("p_brand", F.col("data.sure").isNull().alias("is_null"), F.array_join(F.get("errors", F.lit(0))["path"], ".").alias("path"))


rows("map_source", "Event", pick("id"), pick("props", pick("k"), pick("missing")), flat={"id": "id", "k": "props.k", "missing": "props.missing"}, sql="SELECT event_id::VARCHAR AS id, json_extract_string(props, '$.k')::INT AS k, NULL::VARCHAR AS missing FROM events")


@add("introspect_predicates", "SELECT * FROM (VALUES ('Customer', false, true, true, false, false), ('Party', false, true, true, false, true), ('OrderFilter', true, false, false, false, false), ('OrderStatus', true, true, false, true, false), ('Float', true, true, false, true, false)) t(name, is_input, is_output, is_composite, is_leaf, is_abstract)")
def introspect_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.predicates(spark, schema(spark, sf_dir), (STATUS, FLAG)).filter(F.col("name").isin("Customer", "Party", "OrderFilter", "OrderStatus", "Float"))


@add("resolver_errors", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_name END AS name, CASE WHEN p_size % 5 = 0 THEN 'no name for ' || p_partkey END AS message, p_size % 5 = 0 AS sure_is_null FROM part")
def resolver_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field whose resolver fails for some rows, in a place that may be null and in one that may not."""
    resolve = lambda info: C.Coerced(info.column("p_name"), F.when(info.column("p_size") % 5 == 0, F.concat(F.lit("no name for "), info.column("p_partkey"))))
    fields = {"name": Field(resolve), "sure": Field(resolve, non_null=True)}
    parts = Selector(Schema.of(ObjectType("Part", lambda: read(spark, sf_dir, "part"), fields, (), "p_partkey")))
    name = parts.results("Part", pick("name"), keep=("p_partkey",)).select("p_partkey", "data.name", F.get("errors", F.lit(0))["message"].alias("message"))
    sure = parts.results("Part", pick("sure"), keep=("p_partkey",)).select("p_partkey", F.col("data").isNull().alias("sure_is_null"))
    return name.join(sure, "p_partkey")


# Numbers as text.
NUMBERS = ("1", "0.5", "12345678.5", "1000000000000000", "300000000000000000000", "1e21", "0.0000001", "0.000001", "-2.25", "0")
NUMBER_SQL = "SELECT event_id, [{}][(event_id % 10)::INT + 1] AS text FROM events"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, one for each event in turn."""
    return read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, NUMBERS)), (F.col("event_id") % 10 + 1).cast("int")).alias("text"))


@add("json_number", NUMBER_SQL.format("'1', '0.5', '12345678.5', '1000000000000000', '300000000000000000000', '1e+21', '1e-7', '0.000001', '-2.25', '0'"))
def json_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select("event_id", text.number(F.col("text").cast("double")).alias("text"))


@add("float_to_string", NUMBER_SQL.format("'1', '0.5', '1.23456785e+07', '1e+15', '3e+20', '1e+21', '1e-07', '1e-06', '-2.25', '0'"))
def float_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select("event_id", C.to_string(F.col("text").cast("double"), "double").value.alias("text"))


@add("float_from_text", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id + 0.5::DOUBLE END AS value, CASE event_id % 3 WHEN 1 THEN 'Float cannot represent \"' || event_id || 'd\": not a numeric value' WHEN 2 THEN 'Float cannot represent \" ' || event_id || '\": not a numeric value' END AS message FROM events")
def float_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with a suffix or a space is no number."""
    given = F.when(F.col("event_id") % 3 == 0, F.concat("event_id", F.lit(".5"))).when(F.col("event_id") % 3 == 1, F.concat("event_id", F.lit("d"))).otherwise(F.concat(F.lit(" "), F.col("event_id")))
    c = C.to_float(given, "string")
    return read(spark, sf_dir, "events").select("event_id", c.value.alias("value"), c.message.alias("message"))


@add("int_from_float", "SELECT event_id, CASE WHEN value = floor(value) THEN value::INT END AS value, CASE WHEN value <> floor(value) THEN 'Int cannot represent ' || value || ': not an integer' END AS message FROM events")
def int_from_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.to_int(F.col("value"), "double")
    return read(spark, sf_dir, "events").select("event_id", c.value.alias("value"), c.message.alias("message"))


# Introspection.
@add("introspect_types", "SELECT * FROM (VALUES ('UNION', 'Party'), ('UNION', 'Activity'), ('UNION', 'BasketLine'), ('INTERFACE', 'Named'), ('INPUT_OBJECT', 'OrderFilter'), ('ENUM', 'OrderStatus'), ('ENUM', 'Flag')) t(kind, name)")
def introspect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.types(spark, schema(spark, sf_dir), (STATUS, FLAG)).filter(~F.col("kind").isin("SCALAR", "OBJECT")).select("kind", "name")


@add("introspect_arguments", "SELECT * FROM (VALUES ('status', 'OrderStatus', NULL), ('priorities', '[String]', NULL), ('filter', 'OrderFilter', NULL), ('minTotal', 'Float', '0.0')) t(name, type, default_value)")
def introspect_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.arguments(spark, schema(spark, sf_dir)).filter("type_name = 'Customer' AND field = 'orders'").select("name", "type", "default_value")


@add("introspect_input_fields", "SELECT * FROM (VALUES ('minTotal', 'Float'), ('status', 'OrderStatus'), ('priorities', '[String]')) t(name, type)")
def introspect_input_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.input_fields(spark, schema(spark, sf_dir)).filter("type_name = 'OrderFilter'").select("name", "type")


@add("introspect_directives", "SELECT * FROM (VALUES ('skip', 'if', 'Boolean!', NULL, 3), ('include', 'if', 'Boolean!', NULL, 3), ('deprecated', 'reason', 'String', 'No longer supported', 2)) t(directive, name, type, default_value, places)")
def introspect_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema(spark, sf_dir)
    places = catalog.directives(spark, s).groupBy(F.col("name").alias("directive")).agg(F.count("*").cast("int").alias("places"))
    return catalog.directive_arguments(spark, s).join(places, "directive")


@add("introspect_roots", "SELECT * FROM (VALUES ('query', 'Customer'), ('mutation', NULL), ('subscription', NULL)) t(operation, type_name)")
def introspect_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.roots(spark, schema(spark, sf_dir))


@add("introspect_type_layers", "SELECT * FROM (VALUES ('strict', 0, 'LIST', NULL), ('strict', 1, 'LIST', NULL), ('strict', 2, 'NON_NULL', NULL), ('strict', 3, 'SCALAR', 'PositiveInt'), ('id', 0, 'NON_NULL', NULL), ('id', 1, 'SCALAR', 'ID'), ('lines', 0, 'LIST', NULL), ('lines', 1, 'UNION', 'BasketLine')) t(field, depth, kind, name)")
def introspect_type_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.type_layers(spark, schema(spark, sf_dir)).filter("type_name = 'Basket' AND field IN ('strict', 'id', 'lines')").drop("type_name")


@add("introspect_interfaces", "SELECT * FROM (VALUES ('Region', 'Named'), ('Nation', 'Named'), ('Customer', 'Named'), ('Supplier', 'Named'), ('Part', 'Named'), ('Country', 'Named')) t(type_name, interface)")
def introspect_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.interfaces(spark, schema(spark, sf_dir))


@add("introspect_fields", "SELECT * FROM (VALUES ('id', 'ID'), ('name', 'String'), ('region', 'Region')) t(name, of_type)")
def introspect_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fields(spark, schema(spark, sf_dir)).filter("type_name = 'Nation'").select("name", "of_type")


@add("introspect_deprecated", "SELECT 'mktsegment' AS name, 'Use segment.' AS deprecation_reason")
def introspect_deprecated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fields(spark, schema(spark, sf_dir), include_deprecated=True).filter(F.col("deprecation_reason").isNotNull()).select("name", "deprecation_reason")


# Operations.
@add("mutation_serial", "SELECT s_suppkey::VARCHAR AS id, s_acctbal + 10 AS first, CASE WHEN s_suppkey % 2 = 0 THEN (s_acctbal + 10) * 2 ELSE s_acctbal + 10 END AS second FROM supplier")
def mutation_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two root fields that write a copy of the suppliers, one after the other, and what each selects when it is done."""
    suppliers = Versions(read(spark, sf_dir, "supplier"), "suppliers")
    s = schema(spark, sf_dir)
    own = Schema({**s.types, "Supplier": replace(s.types["Supplier"], table=suppliers)})
    writes = {
        "add": Write("Supplier", lambda args: suppliers.write(lambda df: df.withColumn("s_acctbal", F.col("s_acctbal") + args["amount"])), args={"amount": Arg(C.parse_float, required=True)}),
        "double": Write("Supplier", lambda args: suppliers.write(lambda df: df.withColumn("s_acctbal", F.when(F.col("s_suppkey") % args["every"] == 0, F.col("s_acctbal") * 2).otherwise(F.col("s_acctbal")))), args={"every": Arg(C.parse_int, default=2)}),
    }
    done = mutate(own, writes, pick("add", pick("id"), pick("balance"), amount=10, alias="first"), pick("double", pick("id"), pick("balance"), alias="second"))
    return done["first"].withColumnRenamed("balance", "first").join(done["second"].withColumnRenamed("balance", "second"), "id")


@add("json_lines", "SELECT '{\"data\":{\"name\":\"' || r_name || '\"}}' AS result FROM region")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as lines of JSON, and read again."""
    path = new_path(spark, "results")
    write_lines(Selector(schema(spark, sf_dir)).json("Region", pick("name")), path)
    return read_lines(spark, path)


@add("operation_by_name", "SELECT r_name AS name FROM region")
def operation_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation of its name among several of a document."""
    document = {"Nations": ("Nation", pick("name")), "Regions": ("Region", pick("name"))}
    return Selector(schema(spark, sf_dir)).rows(*operation(document, "Regions"))


@add("default_resolver", "SELECT c_custkey AS custkey, c_mktsegment AS mktsegment, upper(c_name) AS loud FROM customer")
def default_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without a source, by the names of their columns; one looks at what is selected beside its arguments."""
    fields = {"custkey": Field(), "mktsegment": Field(), "loud": Field(lambda info: F.upper(info.column("c_name")) if info.path == ("loud",) else F.lit(None))}
    plain = Schema.of(ObjectType("Customer", lambda: read(spark, sf_dir, "customer"), fields, (), "c_custkey"))
    return Selector(plain, default=ByName(prefix="c_")).rows("Customer", pick("custkey"), pick("mktsegment"), pick("loud"))


@add("column_resolver", "SELECT c_custkey::VARCHAR AS id, upper(c_mktsegment) AS loud FROM customer")
def column_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field whose resolver is an expression."""
    s = schema(spark, sf_dir)
    t = s.types["Customer"]
    loud = ObjectType("Customer", t.table, {**t.fields, "loud": Field(lambda args: F.upper("c_mktsegment"))}, t.interfaces, t.key)
    return Selector(Schema({**s.types, "Customer": loud})).rows("Customer", pick("id"), pick("loud"))


@add("subscription_stream", "SELECT n_name AS nation_name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def subscription_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection over the customers read as a stream, run until all that is there is read; rows by nation, in a table that each batch writes anew."""
    source = read(spark, sf_dir, "customer")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/customer.parque[t]")
    path = new_path(spark, "subscription")
    counted = subscribe(schema(spark, sf_dir), "Customer", stream, pick("id"), pick("nation", pick("name"))).groupBy(F.col("nation.name").alias("nation_name")).agg(F.count("*").alias("n"))
    out = counted.writeStream.outputMode("complete").option("checkpointLocation", new_path(spark, "progress")).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(path)


# Checks of an operation log, derived from the events: a document for each user, a field for each event.
def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    row = lambda kind, key=None: [F.col("user_id").alias("doc"), F.lit(kind).alias("kind"), F.col("event_type").alias("name"), F.lit("q").alias("owner"), F.lit("Event").alias("parent_type"), (F.lit(None).cast("string") if key is None else key).alias("key"), *[F.lit(None).cast("string").alias(c) for c in ("path", "parent", "type", "value")]]
    fields = e.select(*row("field", F.concat(F.lit("k"), F.col("event_id") % 3)))
    variables = e.filter("event_id % 4 = 0").select(*row("variable"))
    uses = e.filter("event_id % 4 = 0 AND event_type <> 'click' OR event_id % 5 = 0").select(*row("use"))
    return fields.unionByName(variables).unionByName(uses)


@add("check_unique_variables", "SELECT user_id AS doc, event_type AS name FROM events WHERE event_id % 4 = 0 GROUP BY ALL HAVING count(*) > 1")
def check_unique_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_checks.unique_names(log(spark, sf_dir), "variable").select("doc", "name")


@add("check_known_fields", "SELECT DISTINCT user_id AS doc, event_type AS name FROM events WHERE event_type NOT IN ('click', 'view')")
def check_known_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Event", "click"), ("Event", "view")], "type_name string, name string")
    return log_checks.known_fields(log(spark, sf_dir), known).select("doc", "name")


@add("check_undefined_variables", "SELECT DISTINCT user_id AS doc, event_type AS name FROM events e WHERE event_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_id % 4 = 0 AND v.user_id = e.user_id AND v.event_type = e.event_type)")
def check_undefined_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_checks.undefined_variables(log(spark, sf_dir)).select("doc", "name")


@add("check_unused_variables", "SELECT DISTINCT user_id AS doc, event_type AS name FROM events v WHERE event_id % 4 = 0 AND event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events u WHERE u.event_id % 5 = 0 AND v.user_id = u.user_id AND v.event_type = u.event_type)")
def check_unused_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_checks.unused_variables(log(spark, sf_dir)).select("doc", "name")


@add("check_conflicting_keys", "SELECT user_id AS doc, 'k' || (event_id % 3) AS name FROM events GROUP BY ALL HAVING min(event_type) <> max(event_type)")
def check_conflicting_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_checks.conflicting_keys(log(spark, sf_dir)).select("doc", "name")


Q = {"kind": "operation", "name": "q", "type": "query"}
CUSTOMER_FIELD = {"kind": "field", "owner": "q", "parent_type": "Customer"}
ORDERS = {**CUSTOMER_FIELD, "name": "orders", "key": "orders", "path": "orders"}
ORDER_ID = {"kind": "field", "owner": "q", "name": "id", "key": "id", "parent_type": "Order", "path": "orders.id", "parent": "orders"}
TOTAL = {"kind": "argument", "name": "minTotal", "owner": "orders", "parent_type": "Customer.orders"}
F_ = {"kind": "fragment", "name": "f", "type": "Customer"}
TO_F = {"kind": "spread", "name": "f", "owner": "q", "parent_type": "Customer"}
V = {"kind": "variable", "name": "v", "owner": "q", "type": "Int"}
USE = {"kind": "use", "name": "v", "owner": "q", "type": "Int"}


def _leaf(name: str, key: str, **more: str) -> dict:
    return {**CUSTOMER_FIELD, "name": name, "key": key, "path": key, **more}


#: Rows of a document for each rule, by the log's columns, right but for that rule (and those named beside it); the first breaks none.
FAULTS = (
    ("", (), [Q, _leaf("id", "id"), ORDERS, TOTAL, ORDER_ID, F_, TO_F, V, USE, {**USE, "owner": "f"}, {"kind": "directive", "name": "skip", "owner": "id", "type": "FIELD"}, {"kind": "argument", "name": "if", "owner": "id", "parent_type": "@skip"}]),
    ("unique_operations", (), [Q, Q]),
    ("lone_anonymous", (), [Q, {"kind": "operation"}]),
    ("single_field_subscriptions", (), [{**Q, "type": "subscription"}, _leaf("id", "a"), _leaf("name", "b")]),
    ("known_types", ("possible_spreads",), [Q, {"kind": "condition", "type": "Nope", "parent_type": "Party"}]),
    ("composite_conditions", ("possible_spreads",), [Q, {"kind": "condition", "type": "String", "parent_type": "Party"}]),
    ("input_variables", (), [Q, {**V, "type": "Customer!"}, {**USE, "type": "Customer!"}]),
    ("scalar_leafs", (), [Q, _leaf("name", "name"), {"kind": "field", "name": "id", "owner": "q", "parent_type": "Nation", "key": "id", "path": "name.id", "parent": "name"}]),
    ("known_fields", (), [Q, _leaf("nope", "nope")]),
    ("unique_fragments", (), [Q, F_, F_, TO_F]),
    ("known_fragments", (), [Q, TO_F]),
    ("unused_fragments", (), [Q, F_]),
    ("possible_spreads", (), [Q, {"kind": "condition", "type": "Order", "parent_type": "Party"}]),
    ("fragment_cycles", (), [Q, F_, {**F_, "name": "g"}, TO_F, {**TO_F, "name": "g", "owner": "f"}, {**TO_F, "owner": "g"}]),
    ("unique_variables", (), [Q, V, V, USE]),
    ("undefined_variables", (), [Q, F_, TO_F, {**USE, "owner": "f"}]),
    ("unused_variables", (), [Q, V]),
    ("variable_positions", (), [Q, F_, TO_F, V, {**USE, "type": "String", "owner": "f"}]),
    ("known_directives", (), [Q, {"kind": "directive", "name": "nope", "owner": "x", "type": "FIELD"}]),
    ("directive_places", (), [Q, {"kind": "directive", "name": "skip", "owner": "x", "type": "QUERY"}, {"kind": "argument", "name": "if", "owner": "x", "parent_type": "@skip"}]),
    ("unique_directives", (), [Q, *[{"kind": "directive", "name": "skip", "owner": "x", "type": "FIELD"}] * 2, {"kind": "argument", "name": "if", "owner": "x", "parent_type": "@skip"}]),
    ("known_arguments", (), [Q, ORDERS, ORDER_ID, TOTAL, {**TOTAL, "name": "nope"}]),
    ("unique_arguments", (), [Q, ORDERS, ORDER_ID, TOTAL, TOTAL]),
    ("required_arguments", (), [Q, ORDERS, ORDER_ID]),
    ("argument_values", (), [Q, ORDERS, ORDER_ID, {**TOTAL, "type": "Float", "value": "string"}]),
    ("conflicting_keys", (), [Q, _leaf("id", "x"), F_, TO_F, _leaf("name", "x", owner="f")]),
    ("unique_input_fields", (), [Q, *[{"kind": "input_field", "name": "status", "owner": "orders.filter"}] * 2]),
)
#: Rules that are found together with another by one check.
TOGETHER = {"directive_places": "known_directives"}
BROKEN = [(TOGETHER.get(r, r), n) for n, (rule, more, _) in enumerate(FAULTS) for r in (rule, *more) if r]


@add("validate_rules", f"SELECT rule, event_id AS doc FROM events JOIN (VALUES {', '.join(f"('{rule}', {n})" for rule, n in BROKEN)}) t(rule, n) ON event_id % {len(FAULTS)} = n")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule and document that breaks it, of as many documents as there are events: each has, in turn, the rows of one of ``FAULTS``."""
    columns = [c.split()[0] for c in log_checks.SCHEMA.split(", ")]
    parts = spark.createDataFrame([tuple({"doc": n, **row}.get(c) for c in columns) for n, (_, _, rows_of) in enumerate(FAULTS) for row in rows_of], log_checks.SCHEMA)
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % len(FAULTS)).alias("doc"))
    log_ = stored(events.join(F.broadcast(parts), "doc").drop("doc").withColumnRenamed("id", "doc").select(*columns), "log", ("kind",))  # the parts are FAULTS' rows
    s = schema(spark, sf_dir)
    types = catalog.types(spark, s, (STATUS, FLAG)).select("name", "kind").unionByName(spark.createDataFrame([("Int", "SCALAR")], "name string, kind string")).distinct()
    fields = catalog.fields(spark, s, include_deprecated=True)
    leafs = fields.join(types.filter(F.col("kind").isin("SCALAR", "ENUM")).select(F.col("name").alias("of_type"), F.lit(True).alias("l")), "of_type", "left").select("type_name", "name", F.coalesce("l", F.lit(False)).alias("leaf"))
    objects = types.filter("kind = 'OBJECT'").select(F.col("name").alias("type_name"), F.col("name").alias("possible"))
    possible = catalog.possible_types(spark, s).unionByName(objects)
    directives = catalog.directives(spark, s)
    arguments = catalog.arguments(spark, s).filter("type_name = 'Customer'").select(F.concat_ws(".", "type_name", "field").alias("field"), "name", (F.col("name") == "minTotal").alias("required"))
    arguments = arguments.unionByName(catalog.directive_arguments(spark, s).select(F.concat(F.lit("@"), "directive").alias("field"), "name", F.col("type").endswith("!").alias("required")))
    fits = spark.createDataFrame([("Int", "int"), ("Float", "int"), ("Float", "float"), ("String", "string"), ("ID", "int"), ("ID", "string"), ("Boolean", "boolean"), ("OrderStatus", "enum")], "type string, value string")
    of = log_checks
    reach = stored(of.reachable(log_), "reach")
    found = {
        **{f"unique_{k}s": of.unique_names(log_, k) for k in ("operation", "fragment", "variable", "directive", "argument", "input_field")},
        "lone_anonymous": of.lone_anonymous(log_),
        "single_field_subscriptions": of.single_field_subscriptions(log_),
        "known_types": of.known_types(log_, types),
        "composite_conditions": of.composite_conditions(log_, types),
        "input_variables": of.input_variables(log_, types),
        "scalar_leafs": of.scalar_leafs(log_, leafs),
        "known_fields": of.known_fields(log_, fields),
        "known_fragments": of.known_fragments(log_),
        "unused_fragments": of.unused_fragments(log_, reach),
        "possible_spreads": of.possible_spreads(log_, possible),
        "fragment_cycles": of.fragment_cycles(log_),
        "undefined_variables": of.undefined_variables(log_, reach),
        "unused_variables": of.unused_variables(log_, reach),
        "variable_positions": of.variable_positions(log_, reach),
        "known_directives": of.known_directives(log_, directives),
        "known_arguments": of.known_arguments(log_, arguments),
        "required_arguments": of.required_arguments(log_, arguments),
        "argument_values": of.argument_values(log_, fits),
        "conflicting_keys": of.conflicting_keys(log_, fields, types),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), "doc").distinct() for rule, df in found.items()])


@add("introspect_possible_types", "SELECT * FROM (VALUES ('Party', 'Customer'), ('Party', 'Supplier')) t(type_name, possible)")
def introspect_possible_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.possible_types(spark, schema(spark, sf_dir)).filter("type_name = 'Party'")


@add("introspect_enum_values", "SELECT * FROM (VALUES ('OrderStatus', 'FULFILLED'), ('OrderStatus', 'OPEN'), ('OrderStatus', 'PARTIAL'), ('Flag', 'NO'), ('Flag', 'YES')) t(type_name, name)")
def introspect_enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.enum_values(spark, (STATUS, FLAG)).select("type_name", "name")


@add("map_values", "SELECT event_id, json_extract_string(props, '$.' || list_sort(json_keys(props))[1]) AS first_value FROM events")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of a map's first key."""
    parsed = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", F.element_at(parsed, F.get(F.sort_array(F.map_keys(parsed)), F.lit(0))).alias("first_value"))


@add("pandas_resolver", "SELECT c_custkey::VARCHAR AS id, length(c_name)::BIGINT AS name_length FROM customer")
def pandas_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field whose resolver is a function over batches of values."""
    lengths = F.pandas_udf(lambda names: names.str.len(), "long")
    s = schema(spark, sf_dir)
    t = s.types["Customer"]
    longer = ObjectType("Customer", t.table, {**t.fields, "name_length": Field(lambda args: lengths("c_name"))}, t.interfaces, t.key)
    return Selector(Schema({**s.types, "Customer": longer})).rows("Customer", pick("id"), pick("name_length"))


@add("error_list", f"SELECT p_partkey, {REFUSED} AS message, p_size AS size FROM part WHERE p_size <= 10")
def error_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refused value in a non-null field has its own error, not that of a null."""
    out = Selector(schema(spark, sf_dir)).results("StrictPart", pick("size"), keep=("p_partkey", "p_size"))
    return out.select("p_partkey", F.explode("errors.message").alias("message"), F.col("p_size").alias("size"))


@add("html_safe_json", "SELECT page_id, replace(replace(replace(url, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS url, length(replace(html, '<', '\\u003c')) - length(html) AS grown FROM pages")
def html_safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as JSON text within HTML, and by how much escaping the opening brackets of a page lengthens it."""
    grown = F.length(F.replace(F.col("html"), F.lit("<"), F.lit("\\u003c"))) - F.length("html")
    return read(spark, sf_dir, "pages").select("page_id", text.html_safe(F.col("url")).alias("url"), grown.cast("long").alias("grown"))


@add("name_cases", "SELECT p_partkey, list_aggregate(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS camel, replace(p_name, ' ', '_') AS snake FROM part")
def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    camel = text.camel_case(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return read(spark, sf_dir, "part").select("p_partkey", camel.alias("camel"), text.snake_case(camel).alias("snake"))
