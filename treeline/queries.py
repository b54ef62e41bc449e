"""The engine's operators as queries over the driver's tables, each with DuckDB SQL for the same rows.

Unpaged reads cover whole tables; pages keep their limit, which is what they are about.  Nested results are exploded,
one row for each child (and one for a parent without any), so that both engines compare scalars.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.access import AccessPolicy, Context, roles
from treeline.engine import Engine
from treeline.errors import ValidationError
from treeline.functions.columns import concat, when_positive
from treeline.operators.writes import written as after_writes
from treeline.plans.wire import parse
from treeline.schema import Computed, Entity, Join, Schema, Through
from treeline.sources.catalog import Catalog, Federation
from treeline.streaming.live import channel, changed, decoded, encode, live, request_rates

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"]

SCHEMA = Schema(
    {
        "region": Entity(("r_regionkey", "r_name"), "r_regionkey", "region"),
        "nation": Entity(("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", "nation", computed={"label": Computed(("n_name", "region.r_name"), concat("{n_name} / {region.r_name}"), "string")}),
        "customer": Entity(
            ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey", "customer",
            computed={
                "title": Computed(("c_name", "c_mktsegment"), concat("{c_name} ({c_mktsegment})"), "string"),
                "solvent": Computed(("c_acctbal",), when_positive("c_acctbal"), "boolean"),
                "place": Computed(("nation.n_name",), concat("{nation.n_name}"), "string"),
            },
        ),
        "supplier": Entity(("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_suppkey", "supplier"),
        "part": Entity(("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "p_partkey", "part"),
        "order": Entity(
            ("key", "buyer", "status", "total", "date", "priority"), "key", "orders",
            {"key": "o_orderkey", "buyer": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"},
        ),
        "lineitem": Entity(
            ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), None, "lineitem",
        ),
        "event": Entity(("event_id", "ts", "user_id", "event_type", "value", "props"), "event_id", "events"),
        "document": Entity(("doc_id", "text", "lang", "source", "n_chars"), "doc_id", "documents"),
        "label": Entity(("doc_id", "quality", "toxic"), "doc_id", "labels"),
        "message": Entity(("conv_id", "turn", "role", "text"), ("conv_id", "turn"), "conversations"),
        "account": Entity(("id", "balance", "segment", "nation"), "id", "accounts"),
    },
    {
        "region.nations": Join("nation", "nation.n_regionkey = region.r_regionkey", True),
        "nation.region": Join("region", "region.r_regionkey = nation.n_regionkey"),
        "nation.customers": Join("customer", "customer.c_nationkey = nation.n_nationkey", True),
        "nation.suppliers": Join("supplier", "supplier.s_nationkey = nation.n_nationkey", True),
        "customer.nation": Join("nation", "nation.n_nationkey = customer.c_nationkey"),
        "customer.orders": Join("order", "orders.o_custkey = customer.c_custkey", True),
        "customer.events": Join("event", "events.user_id = customer.c_custkey", True),
        "order.customer": Join("customer", "customer.c_custkey = orders.o_custkey"),
        "order.lines": Join("lineitem", "lineitem.l_orderkey = orders.o_orderkey", True),
        "lineitem.part": Join("part", "part.p_partkey = lineitem.l_partkey"),
        "lineitem.supplier": Join("supplier", "supplier.s_suppkey = lineitem.l_suppkey"),
        "supplier.nation": Join("nation", "nation.n_nationkey = supplier.s_nationkey"),
        "part.suppliers": Join("supplier", through=Through("lineitem", "l_partkey", "l_suppkey"), many=True),
        "supplier.parts": Join("part", through=Through("lineitem", "l_suppkey", "l_partkey"), many=True),
        "document.label": Join("label", "labels.doc_id = documents.doc_id"),
        "message.peers": Join("message", "parent.conv_id = child.conv_id", True),
        "message.twin": Join("message", "parent.conv_id = child.conv_id AND parent.turn = child.turn"),
    },
)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nulls: no balance below zero, no segment for every fifth nation."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"),
    )


#: The same in SQL.
ACCOUNTS = "(SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS segment, c_nationkey AS nation FROM customer) AS a"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.files(spark, sf_dir, TABLES).add("accounts", lambda: accounts(spark, sf_dir))


def engine(spark: SparkSession, sf_dir: str, access: AccessPolicy | None = None) -> Engine:
    return Engine(spark, SCHEMA, catalog(spark, sf_dir), access=access)


def _select(fields: str, **refs: dict) -> dict:
    return {"$select": dict.fromkeys(fields.split(), True) | refs}


def _test(field: str, op: str, value: Any = None) -> dict:
    return {"field": field, "op": op} | ({} if op in ("isNull", "isNotNull") else {"value": value})


def _sort(field: str, direction: str = "asc", nulls: str = "last") -> dict:
    return {"field": field, "direction": direction, "nulls": nulls}


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, query: dict | None = None, fn: Callable | None = None, **how: Any) -> None:
    """A query by its wire form (unpaged unless it says otherwise), and maybe a function over the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if query is None:
            return fn(spark, sf_dir)
        out = engine(spark, sf_dir, how.get("access")).dataframe(query, context=how.get("context"), **{k: v for k, v in how.items() if k in ("id", "unpaged", "form")})
        return fn(out) if fn else out

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


CUSTOMER = "c_custkey c_name c_acctbal"
for _name, _where, _sql in (
    ("filter_eq", _test("c_mktsegment", "eq", "BUILDING"), "c_mktsegment = 'BUILDING'"),
    ("filter_ne", _test("c_mktsegment", "ne", "BUILDING"), "c_mktsegment <> 'BUILDING'"),
    ("filter_gt", _test("c_acctbal", "gt", 5000), "c_acctbal > 5000"),
    ("filter_gte", _test("c_custkey", "gte", 700), "c_custkey >= 700"),
    ("filter_lt", _test("c_acctbal", "lt", 0.5), "c_acctbal < 0.5"),
    ("filter_lte", _test("c_custkey", "lte", "70"), "c_custkey <= 70"),
    ("filter_in", _test("c_nationkey", "in", [1, 3, 5]), "c_nationkey IN (1, 3, 5)"),
    ("filter_nin", _test("c_nationkey", "nin", [1, 3, 5]), "c_nationkey NOT IN (1, 3, 5)"),
    ("filter_in_empty", _test("c_nationkey", "in", []), "false"),
    ("filter_like", _test("c_name", "like", "%7_"), "c_name LIKE '%7_'"),
    ("filter_ilike", _test("c_name", "ilike", "cUSTOMER%1"), "c_name ILIKE 'cUSTOMER%1'"),
    ("filter_is_null", _test("c_name", "isNull"), "c_name IS NULL"),
    ("filter_is_not_null", _test("c_name", "isNotNull"), "c_name IS NOT NULL"),
    ("filter_eq_null", _test("c_name", "eq", None), "c_name = NULL"),
    (
        "filter_and_or_not",
        {"and": [{"or": [_test("c_mktsegment", "eq", "BUILDING"), _test("c_acctbal", "lt", 0)]}, {"not": _test("c_nationkey", "in", [2, 4])}]},
        "(c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT c_nationkey IN (2, 4)",
    ),
):
    _add(_name, f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE {_sql}", {"customer": _select(CUSTOMER) | {"$where": _where}}, unpaged=True)

_add("filter_timestamp", "SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'",
     {"order": _select("key total") | {"$where": _test("date", "gte", "1996-01-01")}}, unpaged=True)
_add("select_rename", "SELECT o_orderkey AS key, o_custkey AS buyer, o_orderstatus AS status, o_totalprice AS total FROM orders",
     {"order": _select("key buyer status total")}, unpaged=True)
_add("select_braces", "SELECT n_nationkey, n_name FROM nation", fn=lambda spark, d: engine(spark, d).dataframe("{ nation { n_nationkey n_name } }", "ql", unpaged=True))
_add("point_read", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42", {"customer": _select("c_custkey c_name c_mktsegment")}, id="42")
_add("point_read_composite", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1", {"message": _select("conv_id turn role")}, id=[3, 1])
_add("point_read_missing", "SELECT c_custkey, c_name FROM customer WHERE false", {"customer": _select("c_custkey c_name")}, id="none")

_page = {"customer": _select("c_custkey c_name c_mktsegment c_acctbal") | {"$where": {"and": [_test("c_mktsegment", "eq", "BUILDING"), _test("c_acctbal", "gt", 0)]}, "$orderBy": [_sort("c_acctbal", "desc")], "$page": {"first": 20}}}
_PAGE = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20"
_add("page_first", _PAGE, _page)
_add("page_default", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50", {"customer": _select("c_custkey c_name")})
_add("sort_multi_nulls", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC NULLS FIRST, c_nationkey ASC NULLS LAST, c_custkey LIMIT 150",
     {"customer": _select("c_custkey c_nationkey c_mktsegment") | {"$orderBy": [_sort("c_mktsegment", "desc", "first"), _sort("c_nationkey")], "$page": {"first": 150}}})


def _second_page(query: dict) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = engine(spark, sf_dir)
        (root,) = query
        after = own.execute(query)["pageInfo"]["endCursor"]
        return own.dataframe({root: query[root] | {"$page": query[root]["$page"] | {"after": after}}})

    return run


_add("page_after", _PAGE + " OFFSET 20", fn=_second_page(_page))
_mixed = {"customer": _select("c_custkey c_nationkey c_mktsegment") | {"$orderBy": [_sort("c_mktsegment", "desc"), _sort("c_nationkey", "asc", "first")], "$page": {"first": 30}}}
_add("page_after_mixed_dir", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_nationkey ASC NULLS FIRST, c_custkey LIMIT 30 OFFSET 30", fn=_second_page(_mixed))
_add("distinct_fields", "SELECT c_mktsegment, c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS n FROM customer) WHERE n = 1",
     {"customer": _select("c_mktsegment c_nationkey c_custkey") | {"$distinct": ["c_mktsegment", "c_nationkey"], "$orderBy": [_sort("c_acctbal", "desc")]}}, unpaged=True)


def _grouped(entity: str, keys: str, aggregates: dict, **more: Any) -> dict:
    first = keys.split() or [next(iter(SCHEMA.entities[entity].fields))]
    return {entity: {"$select": dict.fromkeys(first, True), "$aggregate": aggregates} | ({"$groupBy": keys.split()} if keys else {}) | more}


def _rounded(*names: str) -> Callable:
    return lambda df: df.select(*[F.round(c, 2).alias(c) if c in names else F.col(c) for c in df.columns])


_count = {"n": {"fn": "count"}}
_sums = {"n": {"fn": "count", "field": "*"}, "qty": {"fn": "sum", "field": "l_quantity"}, "price": {"fn": "avg", "field": "l_extendedprice"}, "least": {"fn": "min", "field": "l_discount"}, "most": {"fn": "max", "field": "l_tax"}}
_add("agg_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type", _grouped("event", "event_type", _count), unpaged=True)
_add("agg_sum_avg_min_max", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_discount) AS least, max(l_tax) AS most FROM lineitem GROUP BY 1, 2",
     _grouped("lineitem", "l_returnflag l_linestatus", _sums), _rounded("qty", "price"), unpaged=True)
_add("agg_count_field", "SELECT o_orderstatus AS status, count(o_custkey) AS n FROM orders GROUP BY 1", _grouped("order", "status", {"n": {"fn": "count", "field": "buyer"}}), unpaged=True)
_add("agg_count_distinct", "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::BIGINT AS s, round(avg(DISTINCT o_custkey), 4) AS a FROM orders GROUP BY 1",
     _grouped("order", "status", {"n": {"fn": "count", "field": "buyer", "distinct": True}, "s": {"fn": "sum", "field": "buyer", "distinct": True}, "a": {"fn": "avg", "field": "buyer", "distinct": True}}),
     lambda df: df.withColumn("a", F.round("a", 4)), unpaged=True)
_add("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders",
     _grouped("order", "", {"n": {"fn": "count"}, "total": {"fn": "sum", "field": "total"}}), _rounded("total"), unpaged=True)
_add("agg_where", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1", _grouped("lineitem", "l_returnflag", _count, **{"$where": _test("l_quantity", "gt", 25)}), unpaged=True)
_add("agg_having", "SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1 HAVING count(*) >= 55 AND NOT c_nationkey = 3",
     _grouped("customer", "c_nationkey", {"n": {"fn": "count"}, "top": {"fn": "max", "field": "c_acctbal"}}, **{"$having": {"and": [{"aggregate": "n", "op": "gte", "value": 55}, {"not": _test("c_nationkey", "eq", 3)}]}}), unpaged=True)
_add("agg_order_by_alias", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 7",
     _grouped("customer", "c_nationkey", _count, **{"$orderBy": [{"aggregate": "n", "direction": "desc"}], "$page": {"first": 7}}))
_add("agg_page", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 7 OFFSET 7",
     fn=_second_page(_grouped("customer", "c_nationkey", _count, **{"$orderBy": [{"aggregate": "n", "direction": "desc"}], "$page": {"first": 7}})))


def _exploded(ref: str, own: list[str], theirs: list[str], place: bool = True) -> Callable:
    """One row for each child, with its place; a parent without children has one of nulls."""

    def run(df: DataFrame) -> DataFrame:
        rows = df.select(*own, F.posexplode_outer(ref).alias("pos", "_c"))
        return rows.select(*own, *(["pos"] if place else []), *[F.col(f"_c.{t}").alias(t) for t in theirs])

    return run


def _filled(fn: Callable, *names: str) -> Callable:
    """-1 for nulls of the columns, as drivers differ in how they show whole numbers with nulls."""
    return lambda df: fn(df).fillna(-1, list(names))


_add("rel_one", "SELECT o_orderkey AS key, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
     {"order": _select("key", customer=_select("c_name c_mktsegment"))}, lambda df: df.select("key", "customer.c_name", "customer.c_mktsegment"), unpaged=True)
_add("rel_many", "SELECT c_custkey, o_orderkey AS key, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1)::INTEGER AS pos, o_totalprice AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
     {"customer": _select("c_custkey", orders=_select("key total"))}, _exploded("orders", ["c_custkey"], ["key", "total"]), unpaged=True)
_add("rel_empty_many", "SELECT o_orderkey AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
     {"order": _select("key", lines=_select("l_linenumber l_partkey"))}, lambda df: df.select("key", F.size("lines").cast("long").alias("n")), unpaged=True)
_add("rel_null_one", "SELECT d.doc_id, l.doc_id IS NULL AS missing, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
     {"document": _select("doc_id", label=_select("quality toxic"))}, _filled(lambda df: df.select("doc_id", F.col("label").isNull().alias("missing"), "label.quality", "label.toxic"), "quality", "toxic"), unpaged=True)
_add("rel_three_level", "SELECT r_name, n_name, c_name, c_acctbal FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey",
     {"region": _select("r_name", nations=_select("n_name", customers=_select("c_name c_acctbal")))},
     lambda df: _exploded("customers", ["r_name", "n_name"], ["c_name", "c_acctbal"], False)(_exploded("nations", ["r_name"], ["n_name", "customers"], False)(df)), unpaged=True)
_add("rel_siblings", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT round(sum(c_acctbal), 2) FROM customer WHERE c_nationkey = n_nationkey) AS balance FROM nation",
     {"nation": _select("n_nationkey", customers=_select("c_acctbal"), suppliers=_select("s_name"))},
     lambda df: df.select("n_nationkey", F.size("customers").cast("long").alias("customers"), F.size("suppliers").cast("long").alias("suppliers"),
                          F.round(F.aggregate("customers", F.lit(0.0), lambda s, c: s + c["c_acctbal"]), 2).alias("balance")), unpaged=True)
_add("rel_m2m", "SELECT p_partkey, s_suppkey, s_name, (row_number() OVER (PARTITION BY p_partkey ORDER BY s_suppkey) - 1)::INTEGER AS pos FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey",
     {"part": _select("p_partkey", suppliers=_select("s_suppkey s_name"))},
     lambda df: _exploded("suppliers", ["p_partkey"], ["s_suppkey", "s_name"])(df).withColumn("pos", F.coalesce("pos", F.lit(0))), unpaged=True)
QUERIES["rel_many"] = (lambda f: lambda s, d: f(s, d).withColumn("pos", F.coalesce("pos", F.lit(0))))(QUERIES["rel_many"])
_add("rel_same_table_twice", "SELECT o_orderkey AS key, cn.n_name AS buyer_nation, l_partkey, sn.n_name AS seller_nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey",
     {"order": _select("key", customer=_select("c_custkey", nation=_select("n_name")), lines=_select("l_partkey", supplier=_select("s_name", nation=_select("n_name"))))},
     lambda df: df.select("key", F.col("customer.nation.n_name").alias("buyer_nation"), F.explode("lines").alias("l")).select("key", "buyer_nation", "l.l_partkey", F.col("l.supplier.nation.n_name").alias("seller_nation")), unpaged=True)
_add("rel_self_join", "SELECT a.conv_id, a.turn, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id GROUP BY 1, 2",
     {"message": _select("conv_id turn", peers=_select("turn role"))}, lambda df: df.select("conv_id", "turn", F.size("peers").cast("long").alias("n")), unpaged=True)
_add("rel_page", "SELECT c_custkey, c_acctbal, o_orderkey AS key FROM (SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20) LEFT JOIN orders ON o_custkey = c_custkey",
     {"customer": _select("c_custkey c_acctbal", orders=_select("key")) | {"$orderBy": [_sort("c_acctbal", "desc")], "$page": {"first": 20}}}, _exploded("orders", ["c_custkey", "c_acctbal"], ["key"], False))
_add("nested_where", "SELECT c_custkey, coalesce(o_orderkey, -1) AS key, coalesce(o_totalprice, -1) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 AND o_orderstatus = 'O'",
     {"customer": _select("c_custkey", orders=_select("key total") | {"$where": {"and": [_test("total", "gt", 100000), _test("status", "eq", "O")]}})}, _filled(_exploded("orders", ["c_custkey"], ["key", "total"], False), "key", "total"), unpaged=True)
_add("nested_order_page", "SELECT c_custkey, key, pos FROM (SELECT c_custkey, o_orderkey AS key, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1)::INTEGER AS pos FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE pos < 3",
     {"customer": _select("c_custkey", orders=_select("key") | {"$orderBy": [_sort("total", "desc")], "$page": {"first": 3}})},
     lambda df: _exploded("orders", ["c_custkey"], ["key"])(df).withColumn("pos", F.coalesce("pos", F.lit(0))), unpaged=True)

_add("computed_same_entity", "SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS title, c_acctbal > 0 AS solvent FROM customer", {"customer": _select("c_custkey title solvent")}, unpaged=True)
_add("computed_cross_entity", "SELECT c_custkey, n_name AS place FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", {"customer": _select("c_custkey place")}, unpaged=True)
_add("computed_nested", "SELECT c_custkey, n_name || ' / ' || r_name AS label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
     {"customer": _select("c_custkey", nation=_select("label"))}, lambda df: df.select("c_custkey", "nation.label"), unpaged=True)

POLICY = AccessPolicy(
    entities={"event": roles("admin")},
    fields={"customer.c_acctbal": roles("admin"), "order.total": roles("admin", "clerk")},
    rows={"order": lambda c: None if c.role == "admin" else _test("status", "eq", "F")},
)
CLERK, GUEST = Context("u1", "clerk"), Context(None, "guest")
_add("access_field_strip", "SELECT c_custkey, c_name FROM customer", {"customer": _select(CUSTOMER)}, access=POLICY, context=GUEST, unpaged=True)
_add("access_nested_strip", "SELECT c_custkey, coalesce(o_orderkey, -1) AS key FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'",
     {"customer": _select("c_custkey", orders=_select("key total"))}, _filled(lambda df: df.select("c_custkey", F.explode_outer("orders").alias("o")).select("c_custkey", "o.*"), "key"), access=POLICY, context=GUEST, unpaged=True)
_add("access_row_filter", "SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F'", {"order": _select("key total")}, access=POLICY, context=CLERK, unpaged=True)
_add("access_denied_empty", "SELECT event_id, event_type FROM events WHERE false", {"event": _select("event_id event_type")}, access=POLICY, context=CLERK, unpaged=True)

_flat = {"nation": _select("n_name", customers=_select("c_name"), suppliers=_select("s_name"))}
_FLAT = "SELECT n_nationkey AS nation_n_nationkey, n_name AS nation_n_name, c_custkey AS customers_c_custkey, c_name AS customers_c_name, s_suppkey AS suppliers_s_suppkey, s_name AS suppliers_s_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey"
_add("flat_rows", _FLAT, fn=lambda spark, d: engine(spark, d).flat(_flat))


def _resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows of a resolver, nested again."""
    from treeline.operators.flat import flat

    own = engine(spark, sf_dir)
    own.resolve("nation", lambda plan, catalog: flat(plan, SCHEMA, catalog), joined=True)
    out = own.dataframe(_flat, unpaged=True)
    return out.select("n_name", F.size("customers").cast("long").alias("customers"), F.size("suppliers").cast("long").alias("suppliers"))


_add("resolver_nested", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation", fn=_resolver)
_add("introspection", None, fn=lambda spark, d: spark.createDataFrame(
    [(e["name"], f["name"], f["kind"], f.get("sparkType") or f.get("type") or "-") for e in engine(spark, d).describe()["entities"] for f in e["fields"]], "entity string, field string, kind string, type string"))


def _described() -> str:
    """SQL: physical fields with their types from DuckDB's own catalog, and the computed ones."""
    physical = ", ".join(f"('{e}', '{f}', '{SCHEMA.table(e)}', '{c.column(f)}')" for e, c in SCHEMA.entities.items() if e != "account" for f in c.fields)
    computed = " UNION ALL ".join(f"SELECT '{e}', '{n}', 'computed', '{x.type or '-'}'" for e, c in SCHEMA.entities.items() for n, x in c.computed.items())
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp"}
    told = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items())
    own = " UNION ALL ".join(f"SELECT 'account', '{f}', 'scalar', '{t}'" for f, t in (("id", "bigint"), ("balance", "double"), ("segment", "string"), ("nation", "int")))
    return (
        f"SELECT entity, field, 'scalar' AS kind, CASE regexp_replace(data_type, '_NS$|_S$|_MS$', '') {told} ELSE data_type END AS type FROM (VALUES {physical}) AS f(entity, field, t, c) "
        f"JOIN information_schema.columns ON table_name = t AND column_name = c UNION ALL {computed} UNION ALL {own}"
    )


SQL["introspection"] = _described()


def _notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with an event as one that changed, from lines of notifications."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.to_json(F.struct(F.concat(F.lit(channel("customer") + ":"), F.col("user_id")).alias("channel"), F.lit(json.dumps({"type": "updated"})).alias("payload"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("publishedAt")))
    return changed(decoded(rows.select(line.alias("value")))).select("entity", F.col("id").cast("long").alias("id"))


_add("live_changed", "SELECT DISTINCT 'customer' AS entity, user_id AS id FROM events", fn=_notifications)


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of two records, as a live read emits them."""
    from treeline.streaming.live import snapshot

    own, query = engine(spark, sf_dir), parse({"customer": _select("c_custkey c_name")})
    got = [snapshot(own, query, id) for id in (1, 2)]
    return spark.createDataFrame([(e.kind, e.data["c_custkey"], e.data["c_name"]) for e in got], "kind string, c_custkey long, c_name string")


#: Nulls: filters, sorts and pages over columns that hold them.
for _name, _where, _sql in (
    ("null_is_null", _test("balance", "isNull"), "balance IS NULL"),
    ("null_is_not_null", _test("segment", "isNotNull"), "segment IS NOT NULL"),
    ("null_eq", _test("balance", "eq", None), "balance = NULL"),
    ("null_ne", _test("segment", "ne", "BUILDING"), "segment <> 'BUILDING'"),
    ("null_nin", _test("segment", "nin", ["BUILDING", "MACHINERY"]), "segment NOT IN ('BUILDING', 'MACHINERY')"),
    ("null_not", {"not": _test("balance", "gt", 5000)}, "NOT balance > 5000"),
    ("null_like", {"not": _test("segment", "like", "%U%")}, "NOT segment LIKE '%U%'"),
):
    _add(_name, f"SELECT id, nation FROM {ACCOUNTS} WHERE {_sql}", {"account": _select("id nation") | {"$where": _where}}, unpaged=True)

for _name, _order, _sql in (
    ("null_page_asc_first", [_sort("segment", "asc", "first"), _sort("balance", "desc")], "segment ASC NULLS FIRST, balance DESC NULLS LAST, id"),
    ("null_page_desc_last", [_sort("segment", "desc"), _sort("balance", "asc", "first")], "segment DESC NULLS LAST, balance ASC NULLS FIRST, id"),
    ("null_page_balance", [_sort("balance", "asc", "first")], "balance ASC NULLS FIRST, id"),
):
    _nulls = {"account": _select("id nation") | {"$orderBy": _order, "$page": {"first": 40}}}
    _add(_name, f"SELECT id, nation FROM {ACCOUNTS} ORDER BY {_sql} LIMIT 40 OFFSET 40", fn=_second_page(_nulls))

_add("null_aggregates", f"SELECT coalesce(segment, '-') AS segment, count(*) AS n, count(balance) AS known, round(sum(balance), 2) AS total, min(balance) AS least FROM {ACCOUNTS} GROUP BY 1",
     _grouped("account", "segment", {"n": {"fn": "count"}, "known": {"fn": "count", "field": "balance"}, "total": {"fn": "sum", "field": "balance"}, "least": {"fn": "min", "field": "balance"}}),
     lambda df: _rounded("total")(df.fillna("-", ["segment"])), unpaged=True)
_add("null_distinct", f"SELECT coalesce(segment, '-') AS segment, id FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY balance DESC NULLS FIRST, id) AS n FROM {ACCOUNTS}) WHERE n = 1",
     {"account": _select("segment id") | {"$distinct": ["segment"], "$orderBy": [_sort("balance", "desc", "first")]}}, lambda df: df.fillna("-", ["segment"]), unpaged=True)

_add("rel_composite_key", "SELECT a.conv_id, a.turn, b.role AS twin FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn",
     {"message": _select("conv_id turn", twin=_select("role"))}, lambda df: df.select("conv_id", "turn", F.col("twin.role").alias("twin")), unpaged=True)
_add("rel_shared_join", "SELECT c_custkey, n_name AS place, n_nationkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
     {"customer": _select("c_custkey place", nation=_select("n_nationkey"))}, lambda df: df.select("c_custkey", "place", "nation.n_nationkey"), unpaged=True)


def _federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one service with customers of another."""
    services = {"sales": Catalog.files(spark, sf_dir, ["orders", "lineitem"]), "people": Catalog.files(spark, sf_dir, ["customer", "nation"])}
    own = Engine(spark, SCHEMA, Federation(services))
    return own.dataframe({"order": _select("key", customer=_select("c_name", nation=_select("n_name")))}, unpaged=True).select("key", "customer.c_name", "customer.nation.n_name")


_add("rel_cross_service", "SELECT o_orderkey AS key, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey", fn=_federated)


def _preshaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolver that returns records as the result has them."""
    own = engine(spark, sf_dir)
    records = lambda plan, tables: tables.table("region").join(
        tables.table("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_name"))).alias("nations")), "r_regionkey"
    )
    own.resolve("region", records, nested=True)
    return own.dataframe({"region": _select("r_regionkey r_name", nations=_select("n_name"))}, unpaged=True).select("r_regionkey", "r_name", F.explode("nations").alias("n")).select("r_regionkey", "r_name", "n.n_name")


_add("resolver_preshaped", "SELECT r_regionkey, r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey", fn=_preshaped)


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after a batch of writes."""
    write = lambda op, **more: {"$write": {"op": op, "entity": "customer"} | more}
    batch = [
        write("create", data={"c_custkey": -1, "c_name": "new", "c_nationkey": 3, "c_acctbal": 1.5, "c_mktsegment": "BUILDING"}),
        write("update", id=7, data={"c_name": "renamed"}), write("delete", id="11"), write("update", id=-1, data={"c_acctbal": 2.5}), write("delete", id="none"),
    ]
    return after_writes(spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet"), SCHEMA, "customer", batch)


_add("writes", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey <> 11 UNION ALL SELECT -1, 'new', 3, 2.5, 'BUILDING'", fn=_written)


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes of the pages that lead through all nations; a cursor of another query is refused."""
    own, rows, after = engine(spark, sf_dir), [], None
    while True:
        query = {"nation": _select("n_nationkey") | {"$page": {"first": 10} | ({"after": after} if after else {})}}
        got = own.execute(query)
        rows.append((len(rows), len(got["items"]), got["pageInfo"]["hasNextPage"], got["items"][0]["n_nationkey"]))
        after = got["pageInfo"]["endCursor"]
        if not got["pageInfo"]["hasNextPage"]:
            break
    try:
        own.execute({"region": _select("r_regionkey") | {"$page": {"after": after}}})
    except ValidationError:
        rows.append((-1, 0, False, -1))
    return spark.createDataFrame(rows, "page int, items int, more boolean, first_key int")


_add("page_envelope", "SELECT (n // 10)::INTEGER AS page, count(*)::INTEGER AS items, max(n) < (SELECT count(*) FROM nation) - 1 AS more, min(n_nationkey) AS first_key FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation) GROUP BY 1 UNION ALL SELECT -1, 0, false, -1", fn=_envelope)

HIDING = AccessPolicy(
    entities={"region": roles("admin")}, fields={"nation.n_name": roles("admin"), "customer.c_mktsegment": roles("admin")},
    points={"customer": lambda c, id: str(id) != "13"}, rows={"nation": lambda c: _test("n_regionkey", "eq", 1)},
)
ROWS_ONLY = AccessPolicy(rows={"nation": lambda c: _test("n_regionkey", "eq", 1)})
_add("access_computed_field", "SELECT c_custkey, c_acctbal > 0 AS solvent FROM customer", {"customer": _select("c_custkey title place solvent")}, access=HIDING, context=GUEST, unpaged=True)
_add("access_computed_entity", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1", {"nation": _select("n_nationkey label")}, access=HIDING, context=GUEST, unpaged=True)
_add("access_computed_rows", "SELECT c_custkey, coalesce(n_name, '-') AS place FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1",
     {"customer": _select("c_custkey place")}, lambda df: df.fillna("-").replace("", "-"), access=ROWS_ONLY, context=GUEST, unpaged=True)
_add("access_point_denied", "SELECT c_custkey FROM customer WHERE false", {"customer": _select("c_custkey")}, access=HIDING, context=GUEST, id=13)
_add("access_point_allowed", "SELECT c_custkey FROM customer WHERE c_custkey = 14", {"customer": _select("c_custkey")}, access=HIDING, context=GUEST, id=14)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live read run over a stream of notifications to its end: what it emitted."""
    folder = f"{_folder(spark)}/live-{uuid.uuid4().hex[:12]}"
    lines = [encode("customer", 2), encode("customer", 3), encode("order", 1), "no JSON", encode("customer", 2)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/lines")
    got: list = []
    stream = spark.readStream.schema("value string").text(f"{folder}/lines")
    query = live(engine(spark, sf_dir), stream, "customer", {"customer": _select("c_custkey c_name")}, [1, 2, 3], got.append, checkpoint=f"{folder}/state", once=True)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.createDataFrame([(n, e.kind, e.data["c_custkey"], e.data["c_name"]) for n, e in enumerate(got)], "place int, kind string, c_custkey long, c_name string")


_add("live_stream", "SELECT place, 'update' AS kind, c_custkey, c_name FROM (VALUES (0, 1), (1, 2), (2, 3), (3, 2), (4, 3)) AS e(place, id) JOIN customer ON c_custkey = id", fn=_streamed)


def _folder(spark: SparkSession) -> str:
    """A folder that all executors reach."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (root or tempfile.mkdtemp(prefix="treeline-")).rstrip("/")


def _rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rates of a stream of events, run to its end; each batch's counts replace the ones before."""
    folder = f"{_folder(spark)}/rates-{uuid.uuid4().hex[:12]}"
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    rows.write.parquet(f"{folder}/events")
    events = spark.readStream.schema(rows.schema).parquet(f"{folder}/events")
    rates = request_rates(events, F.col("user_id"), window="1 hour")
    out = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rates")
    rates.writeStream.outputMode("complete").foreachBatch(out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rates")


_add("rate_stream", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id AS key, count(*) AS requests FROM events GROUP BY 1, 2", fn=_rate_stream)

_add("live_snapshot", "SELECT 'update' AS kind, c_custkey, c_name FROM customer WHERE c_custkey IN (1, 2)", fn=_snapshot)
_add("rate_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id AS key, count(*) AS requests FROM events GROUP BY 1, 2",
     fn=lambda spark, d: request_rates(spark.read.parquet(f"{d}/events.parquet"), F.col("user_id"), window="1 hour"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
