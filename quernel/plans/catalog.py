"""The named queries over the driver's tables, each with its SQL for the oracle.

The driver's tables stand for entities; absent values, dangling keys, shares and deltas are derived from their keys by
fixed rules that both engines can state.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import predicates, scalars
from quernel.operators import access, aggregate, constraints, listing, mutate
from quernel.plans.engine import Engine
from quernel.plans.model import Config, Filter, ForeignKey, ListRequest, Missing, NotNull, OnDelete, QuernelError, Relationship, Schema, Unique, parse_derived, parse_pairs
from quernel.sources import backends, backup, export, stores
from quernel.streaming import routing, streams

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("id", F.col(key).cast("string"))


RELATIONS = {
    (a, b): Relationship(a, b, c, d)
    for a, b, c, d in (
        ("lineitem", "order", "orders", "l_orderkey"),
        ("orders", "customer", "customer", "o_custkey"),
        ("customer", "nation", "nation", "c_nationkey"),
        ("nation", "region", "region", "n_regionkey"),
    )
}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "part": "p_partkey"}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    return {name: (t(spark, sf_dir, name), key) for name, key in KEYS.items()}


@query("""
SELECT o.o_orderkey, o.o_totalprice, c.c_name AS customer__c_name, c.c_mktsegment AS customer__c_mktsegment
FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10) o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def list_full(spark, sf_dir):
    request = ListRequest("orders").where("o_orderstatus", "eq", "F").where("o_totalprice", ">", 100000).order("o_totalprice", True).page(10).include("customer").project("o_totalprice", "customer")
    rows = listing.plan(t(spark, sf_dir, "orders"), request, "o_orderkey", relations=RELATIONS, tables=tables(spark, sf_dir))
    return rows.select("o_orderkey", "o_totalprice", F.col("customer.c_name").alias("customer__c_name"), F.col("customer.c_mktsegment").alias("customer__c_mktsegment"))


flagship = list_full

# filters: one query per operator, on orders with a status that is null where the key is a multiple of 7

_NULLED = "(SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders)"


def nulled(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))


def _filter_query(name: str, field: str, op: str, value, where: str) -> None:
    def run(spark, sf_dir):
        return listing.where(nulled(spark, sf_dir), [Filter.of(field, op, value)])

    run.__name__ = name
    query(f"SELECT * FROM {_NULLED} WHERE {where}")(run)


for _name, _field, _op, _value, _where in (
    ("filter_eq", "status", "eq", "F", "status = 'F'"),
    ("filter_eq_null", "status", "=", None, "status IS NULL"),
    ("filter_neq", "status", "neq", "F", "status IS DISTINCT FROM 'F'"),
    ("filter_lt", "o_totalprice", "lt", 50000, "o_totalprice < 50000"),
    ("filter_lte", "o_orderkey", "<=", 1000, "o_orderkey <= 1000"),
    ("filter_gt", "o_totalprice", ">", 250000.5, "o_totalprice > 250000.5"),
    ("filter_gte", "o_orderpriority", "gte", "3", "o_orderpriority >= '3'"),
    ("filter_range_mixed_types", "status", "gt", 5, "false"),
    ("filter_in", "status", "in", ["F", "P"], "status IN ('F', 'P')"),
    ("filter_in_empty", "status", "in", [], "false"),
    ("filter_in_null", "status", "in", ["P", None], "status = 'P' OR status IS NULL"),
    ("filter_is_null", "status", "?", None, "status IS NULL"),
    ("filter_is_not_null", "status", "!?", None, "status IS NOT NULL"),
):
    _filter_query(_name, _field, _op, _value, _where)


def _glob_query(name: str, glob: str, pattern: str) -> None:
    def run(spark, sf_dir):
        return listing.where(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), [Filter.of("p_name", "like", glob)])

    run.__name__ = name
    query(f"SELECT p_partkey, p_name, p_type FROM part WHERE regexp_full_match(p_name, '{pattern}', 's')")(run)


for _name, _glob, _pattern in (
    ("filter_like_prefix", "cold*", "cold.*"),
    ("filter_like_suffix", "*widget", ".*widget"),
    ("filter_like_infix", "*l*", ".*l.*"),
    ("filter_like_multi", "*o*d*t", ".*o.*d.*t"),
    ("filter_like_exact", "cold widget", "cold widget"),
    ("filter_like_literal", "c_ld%", "c_ld%"),
):
    _glob_query(_name, _glob, _pattern)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_totalprice < 90000 AND o_orderpriority <> '1-URGENT' AND regexp_full_match(o_orderpriority, '.*-.*')")
def filter_conjunction(spark, sf_dir):
    filters = predicates.parse_filters("o_orderstatus=O,o_totalprice>=1000,o_totalprice<90000,o_orderpriority<>1-URGENT,o_orderpriority~*-*")
    return listing.where(t(spark, sf_dir, "orders"), filters).select("o_orderkey", "o_totalprice")


_DOCS = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN '{"k": null}' WHEN 2 THEN '{"k": "5"}' WHEN 3 THEN '{"k": true}' ELSE props END AS doc FROM events)"""


@query(f"""
SELECT event_id,
       j IS NOT NULL AND ty = 'NULL' AS list_is_null,
       ty IS NULL OR ty = 'NULL' AS document_is_null,
       ty IS NOT NULL AND ty <> 'NULL' AS list_is_not_null,
       ty IS NOT NULL AND NOT (num AND CAST(v AS DOUBLE) = 5) AS list_neq,
       NOT coalesce(num AND CAST(v AS DOUBLE) = 5, false) AS cursor_neq,
       coalesce(ty = 'VARCHAR' AND v = '5', false) AS eq_text,
       coalesce(num AND CAST(v AS DOUBLE) > 20, false) AS gt,
       coalesce(ty = 'BOOLEAN', false) AND v = 'true' AS eq_true,
       coalesce(num AND CAST(v AS DOUBLE) = 7, false) OR coalesce(ty = 'NULL', false) AS list_in_null,
       coalesce(num AND CAST(v AS DOUBLE) = 7, false) OR coalesce(ty = 'NULL', true) AS cursor_in_null,
       coalesce(ty = 'NULL', true) AS watch_eq_null
FROM (SELECT event_id, json_extract(doc, '$.k') AS j, json_type(doc, '$.k') AS ty, CASE WHEN json_type(doc, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(doc, '$.k') WHEN json_type(doc, '$.k') IN ('VARCHAR', 'BOOLEAN') THEN json_extract_string(doc, '$.k') END AS v,
             coalesce(json_type(doc, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false) AS num FROM {_DOCS})""".replace("CAST(v AS DOUBLE)", "TRY_CAST(v AS DOUBLE)").replace("AND v = 'true' AS eq_true", "AND coalesce(v, '') = 'true' AS eq_true"))
def filter_json_missing_vs_null(spark, sf_dir):
    kind = F.col("event_id") % 5
    doc = F.when(kind == 0, "{}").when(kind == 1, '{"k": null}').when(kind == 2, '{"k": "5"}').when(kind == 3, '{"k": true}').otherwise(F.col("props"))
    rows = t(spark, sf_dir, "events").select("event_id", F.parse_json(doc).alias("data"))
    say = lambda op, value, missing: predicates.variant(Filter.of("k", op, value), F.col("data"), missing)
    return rows.select(
        "event_id",
        say("is_null", None, Missing.LIST).alias("list_is_null"),
        say("is_null", None, Missing.DOCUMENT).alias("document_is_null"),
        say("is_not_null", None, Missing.LIST).alias("list_is_not_null"),
        say("neq", 5, Missing.LIST).alias("list_neq"),
        say("neq", 5, Missing.CURSOR).alias("cursor_neq"),
        say("eq", "5", Missing.LIST).alias("eq_text"),
        say("gt", 20, Missing.LIST).alias("gt"),
        say("eq", True, Missing.LIST).alias("eq_true"),
        say("in", [7, None], Missing.LIST).alias("list_in_null"),
        say("in", [7, None], Missing.CURSOR).alias("cursor_in_null"),
        say("eq", None, Missing.WATCH).alias("watch_eq_null"),
    )


# scans, pages, sorts


@query("SELECT * FROM orders")
def scan_full(spark, sf_dir):
    return listing.plan(t(spark, sf_dir, "orders"), ListRequest("orders"), "o_orderkey")


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def read_point(spark, sf_dir):
    return listing.read(t(spark, sf_dir, "orders"), 77, "o_orderkey")


@query("SELECT k AS o_orderkey, o_custkey, o_totalprice FROM (SELECT unnest([1, 5, 9, 999999999])::BIGINT AS k) LEFT JOIN orders ON o_orderkey = k")
def read_many(spark, sf_dir):
    wanted = spark.range(1).select(F.explode(F.array(*(F.lit(x).cast("bigint") for x in (1, 5, 9, 999999999)))).alias("o_orderkey"))
    return listing.read_many(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), wanted, "o_orderkey")


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_equality(spark, sf_dir):
    return listing.lookup(t(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING")


@query("SELECT * FROM part WHERE p_size > 5 AND p_size <= 20 AND p_brand <> 'Brand#11'")
def index_range(spark, sf_dir):
    return listing.where(listing.lookup_range(t(spark, sf_dir, "part"), "p_size", 5, 20, low_open=True), [Filter.of("p_brand", "<>", "Brand#11")])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 10000 AND o_totalprice > 200000 AND o_totalprice < 240000")
def range_tightest(spark, sf_dir):
    return listing.where(t(spark, sf_dir, "orders"), predicates.parse_filters("o_totalprice>10000,o_totalprice>200000,o_totalprice<240000")).select("o_orderkey", "o_totalprice")


@query("SELECT id, o_totalprice FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders) ORDER BY id LIMIT 25 OFFSET 50")
def list_default_order_page(spark, sf_dir):
    return listing.plan(text_id(t(spark, sf_dir, "orders"), "o_orderkey"), ListRequest("orders").page(25, 50).project("o_totalprice"))


@query("SELECT id, o_totalprice FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders) WHERE id > '1200' ORDER BY id LIMIT 40")
def list_keyset_page(spark, sf_dir):
    return listing.keyset_page(text_id(t(spark, sf_dir, "orders"), "o_orderkey").select("id", "o_totalprice"), "1200", 40)


@query("SELECT * FROM (SELECT * FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 20 OFFSET 30)")
def list_capped(spark, sf_dir):
    return listing.plan(t(spark, sf_dir, "orders"), ListRequest("orders", limit=100, offset=30, cap=50).where("o_totalprice", ">", 1000).order("o_totalprice"), "o_orderkey")


@query("SELECT * FROM orders WHERE false")
def list_past_the_end(spark, sf_dir):
    return listing.plan(t(spark, sf_dir, "orders"), ListRequest("orders", limit=10, offset=10_000_000).order("o_orderdate"), "o_orderkey")


@query("SELECT c_custkey, c_mktsegment, c_acctbal, CAST(row_number() OVER (ORDER BY c_mktsegment NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS BIGINT) AS place FROM customer")
def sort_multi(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return mutate.sequenced(rows, listing.ordering(ListRequest("c").order("c_mktsegment").order("c_acctbal", True).sort, "c_custkey")).withColumnRenamed("sequence", "place")


@query(f"SELECT o_orderkey, status, CAST(row_number() OVER (ORDER BY status DESC NULLS LAST, o_orderkey) AS BIGINT) AS place FROM {_NULLED}")
def sort_nulls(spark, sf_dir):
    return mutate.sequenced(nulled(spark, sf_dir).select("o_orderkey", "status"), listing.ordering(ListRequest("o").order("status", True).sort, "o_orderkey")).withColumnRenamed("sequence", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def top_k(spark, sf_dir):
    return listing.plan(t(spark, sf_dir, "orders"), ListRequest("orders").order("o_totalprice", True).page(100).project("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 4 AS INT) AS partition FROM orders WHERE (o_orderkey % 4 <> 0 OR o_orderkey > 100) AND (o_orderkey % 4 <> 2 OR o_orderkey > 2) ORDER BY o_orderkey % 4, o_orderkey LIMIT 500")
def partition_cursor(spark, sf_dir):
    return listing.partition_page(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), {0: 100, 2: 2}, 500, 4, "o_orderkey", F.col("o_orderkey") % 4)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 10 AND o_totalprice > 5000")
def list_owned(spark, sf_dir):
    return listing.plan(t(spark, sf_dir, "orders"), ListRequest("orders").where("o_totalprice", "gt", 5000).project("o_custkey", "o_orderstatus", "no_such_field"), "o_orderkey", owner=("o_custkey", 10))


@query("SELECT c_custkey AS id, c_name, count(*) OVER () > 50 AS has_more FROM (SELECT * FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 51) QUALIFY row_number() OVER (ORDER BY c_custkey) <= 50")
def store_query(spark, sf_dir):
    return stores.query(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name"), None, 50, 20)


# includes and keys


@query("SELECT o_orderkey, o_custkey, c_name AS customer__c_name, c_nationkey AS customer__c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 5 <> 0".replace("AND o_orderkey % 5 <> 0", ""))
def include_1(spark, sf_dir):
    rows = listing.include_path(t(spark, sf_dir, "orders"), "customer", RELATIONS, "orders", tables(spark, sf_dir))
    return rows.select("o_orderkey", "o_custkey", F.col("customer.c_name").alias("customer__c_name"), F.col("customer.c_nationkey").alias("customer__c_nationkey"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice AS order__o_totalprice, c_name AS order__customer__c_name, n_name AS order__customer__nation__n_name
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
WHERE l_quantity < 10""")
def include_3(spark, sf_dir):
    rows = listing.where(t(spark, sf_dir, "lineitem"), [Filter.of("l_quantity", "<", 10)])
    rows = listing.include_path(rows, "order.customer.nation", RELATIONS, "lineitem", tables(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("order.o_totalprice").alias("order__o_totalprice"), F.col("order__customer.c_name").alias("order__customer__c_name"), F.col("order__customer__nation.n_name").alias("order__customer__nation__n_name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 11 = 0")
def fk_missing(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return constraints.missing_targets(rows, t(spark, sf_dir, "customer"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0)")
def fk_reverse_lookup(spark, sf_dir):
    gone = listing.where(t(spark, sf_dir, "customer"), predicates.parse_filters("c_mktsegment=MACHINERY,c_acctbal<0"))
    return constraints.referencing(t(spark, sf_dir, "orders"), gone, ForeignKey("orders", "o_custkey", "customer", "c_custkey")).select("o_orderkey", "o_custkey")


def _rules(on_delete=OnDelete.CASCADE, leaf=OnDelete.CASCADE):
    return [ForeignKey("nation", "n_regionkey", "region", "r_regionkey", on_delete), ForeignKey("customer", "c_nationkey", "nation", "n_nationkey", on_delete), ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey", on_delete), ForeignKey("orders", "o_custkey", "customer", "c_custkey", leaf)]


def _flat(plan: dict[str, DataFrame]) -> DataFrame:
    return mutate.union_all([df.select(F.lit(e).alias("entity"), "id") for e, df in plan.items() if e != "set_null"])


@query("""
WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 0), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n))
SELECT 'region' AS entity, '0' AS id UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM n UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM c
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey IN (FROM n) UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey IN (FROM c)""")
def cascade_closure(spark, sf_dir):
    return _flat(constraints.cascade(tables(spark, sf_dir), _rules(), "region", t(spark, sf_dir, "region").filter("r_regionkey = 0")))


@query("""
WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))
SELECT 'orders' AS entity, 'o_custkey' AS field, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey IN (FROM c)""")
def set_null_plan(spark, sf_dir):
    return constraints.cascade(tables(spark, sf_dir), _rules(leaf=OnDelete.SET_NULL), "region", t(spark, sf_dir, "region").filter("r_regionkey = 1"))["set_null"]


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3)
SELECT 'delete' AS action, 'nation' AS entity, '3' AS id
UNION ALL SELECT 'delete', 'customer', CAST(c_custkey AS VARCHAR) FROM c WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'set_null', 'customer', CAST(c_custkey AS VARCHAR) FROM c WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT 'delete', 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 3
UNION ALL SELECT 'delete', 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c WHERE c_mktsegment = 'BUILDING')""")
def owner_aware_cascade(spark, sf_dir):
    plan = constraints.cascade(tables(spark, sf_dir), _rules(), "nation", t(spark, sf_dir, "nation").filter("n_nationkey = 3"), ({"customer": "c_mktsegment"}, "BUILDING"))
    return _flat(plan).select(F.lit("delete").alias("action"), "entity", "id").unionByName(plan["set_null"].select(F.lit("set_null").alias("action"), "entity", "id"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 10")
def fk_restrict_block(spark, sf_dir):
    """The rows because of which customer 10 cannot be deleted."""
    return constraints.referencing(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer").filter("c_custkey = 10"), ForeignKey("orders", "o_custkey", "customer", "c_custkey")).select("o_orderkey", "o_custkey")


@query("""
WITH RECURSIVE e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 ELSE 0 END AS parent, p_partkey AS child FROM part UNION ALL SELECT 48, 3),
r AS (SELECT 3::BIGINT AS id UNION SELECT e.child FROM r JOIN e ON e.parent = r.id)
SELECT id FROM r""")
def share_closure(spark, sf_dir):
    """Over all parts: below part 3 are only its doublings, few in a table of any size."""
    parts = t(spark, sf_dir, "part").select(F.expr("case when p_partkey % 2 = 0 then p_partkey div 2 else 0 end").alias("parent"), F.col("p_partkey").alias("child"))
    cycle = spark.range(1).select(F.lit(48).cast("bigint").alias("parent"), F.lit(3).cast("bigint").alias("child"))
    return access.closure(parts.unionByName(cycle), spark.range(3, 4))


@query("""
WITH RECURSIVE r AS (SELECT p_partkey AS root, p_partkey AS id FROM part WHERE p_partkey IN (2, 5, 7)
UNION SELECT r.root, p.p_partkey FROM r JOIN part p ON p.p_partkey // 4 = r.id) SELECT root, id FROM r""")
def closure_all(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    return access.closure_all(part.select(F.expr("p_partkey div 4").alias("parent"), F.col("p_partkey").alias("child")), part.filter("p_partkey in (2, 5, 7)").select(F.col("p_partkey").alias("id")))


# counts and distinct


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 150000")
def count_filtered(spark, sf_dir):
    return aggregate.count(t(spark, sf_dir, "orders"), predicates.parse_filters("o_orderstatus=O,o_totalprice>150000"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS record_count FROM {n}" for n in ("customer", "nation", "orders", "part", "region", "supplier")))
def catalog_counts(spark, sf_dir):
    return aggregate.catalog({n: df for n, (df, _) in tables(spark, sf_dir).items()})


@query("SELECT DISTINCT event_type AS entity FROM events")
def entity_names(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.col("event_type").alias("entity")).distinct().orderBy("entity")


@query("SELECT p AS percent, v[least(CAST(floor(len(v) * p / 100.0) AS BIGINT), len(v) - 1) + 1] AS value FROM (SELECT list_sort(list(value)) AS v FROM events), (SELECT unnest([50, 95, 99]) AS p)")
def percentile_floor(spark, sf_dir):
    return aggregate.percentile_floor(t(spark, sf_dir, "events"), "value", [50, 95, 99])


@query("SELECT CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS n_ok, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_failed FROM events")
def op_counters(spark, sf_dir):
    return aggregate.counters(t(spark, sf_dir, "events"), F.col("event_type") != "error")


@query("SELECT c_custkey, min(c_acctbal) AS c_acctbal, min(src) AS src FROM (SELECT c_custkey, c_acctbal, 0 AS src FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal, 1 FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def distinct_by_id(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return aggregate.distinct_union([rows.filter("c_custkey % 3 <> 0").withColumn("src", F.lit(0)), rows.filter("c_custkey % 2 = 0").withColumn("src", F.lit(1))], "c_custkey")


@query("SELECT event_type AS share_group, count(DISTINCT user_id) AS members FROM events GROUP BY 1")
def group_members(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("share_group")).agg(F.countDistinct("user_id").alias("members"))


@query("SELECT CAST(p % 3 AS INT) AS node, count(*) AS partitions FROM (SELECT unnest(range(256)) AS p) GROUP BY 1")
def partitions_per_node(spark, sf_dir):
    return spark.range(256).groupBy((F.col("id") % 3).cast("int").alias("node")).agg(F.count(F.lit(1)).alias("partitions"))


@query("SELECT CAST(p AS INT) AS partition FROM (SELECT unnest(range(16)) AS p) WHERE p NOT IN (SELECT DISTINCT o_orderkey * o_orderkey % 16 FROM orders)")
def missing_partitions(spark, sf_dir):
    """Over all orders: a square leaves 0, 1, 4 or 9."""
    got = t(spark, sf_dir, "orders").select((F.col("o_orderkey") * F.col("o_orderkey") % 16).alias("id")).distinct()
    return spark.range(16).join(got, "id", "left_anti").select(F.col("id").cast("int").alias("partition"))


@query("""
SELECT user_id, event_type, 'add' AS change FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 3 = 0)
UNION ALL SELECT user_id, event_type, 'remove' FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 2 = 0)""")
def reconcile_subscriptions(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    return routing.reconcile(events.filter("event_id % 2 = 0"), events.filter("event_id % 3 = 0"), ["user_id", "event_type"])


# constraints


@query("SELECT 'l_orderkey' AS field, CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY l_linenumber HAVING count(*) > 1")
def unique_field_violations(spark, sf_dir):
    return constraints.unique_violations(t(spark, sf_dir, "lineitem"), Unique("lineitem", ("l_orderkey", "l_linenumber")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_tuple_violations(spark, sf_dir):
    return constraints.unique_violations(t(spark, sf_dir, "lineitem"), Unique("lineitem", ("l_orderkey", "l_linenumber"), each=False))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS won FROM orders")
def unique_first_claim(spark, sf_dir):
    return constraints.first_claims(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "won")


_CLAIMS = "(SELECT 'v' || o_orderkey AS value, CAST(o_orderkey AS VARCHAR) AS record_id, 'q' || (o_orderkey % 3) AS request_id, CASE WHEN o_orderkey % 5 = 0 THEN 'committed' ELSE 'reserved' END AS state, o_orderkey % 100 AS expires_at FROM orders WHERE o_orderkey % 2 = 0)"
_ASKED = "(SELECT 'v' || o_orderkey AS value, CAST(o_orderkey AS VARCHAR) AS record_id, 'q' || q AS request_id, 10::BIGINT AS ttl FROM orders, (VALUES (0), (1), (2)) t(q) WHERE o_orderkey % 7 <> q)"


def _claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    rows = t(spark, sf_dir, "orders").select(k, F.concat(F.lit("v"), k).alias("value"), k.cast("string").alias("record_id"))
    claims = rows.filter(k % 2 == 0).select("value", "record_id", F.concat(F.lit("q"), k % 3).alias("request_id"), F.when(k % 5 == 0, "committed").otherwise("reserved").alias("state"), (k % 100).alias("expires_at"))
    asked = rows.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("q")).filter(k % 7 != F.col("q"))
    return claims, asked.select("value", "record_id", F.concat(F.lit("q"), "q").alias("request_id"), F.lit(10).cast("bigint").alias("ttl"))


@query(f"""
WITH c AS {_CLAIMS}, a AS {_ASKED},
o AS (SELECT a.*, CASE WHEN c.state = 'committed' THEN 'conflict' WHEN c.request_id = a.request_id THEN 'held' WHEN (c.value IS NULL OR c.expires_at <= 50) AND row_number() OVER (PARTITION BY a.value ORDER BY a.request_id) = 1 THEN 'reserved' ELSE 'conflict' END AS outcome FROM a LEFT JOIN c ON c.value = a.value)
SELECT value, request_id, outcome, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS BIGINT) AS expires_at FROM o
UNION ALL SELECT value, request_id, 'claim', state, expires_at FROM c WHERE value NOT IN (SELECT value FROM o WHERE outcome = 'reserved') UNION ALL SELECT value, request_id, 'claim', 'reserved', 60 FROM o WHERE outcome = 'reserved'""")
def unique_reserve(spark, sf_dir):
    claims, outcomes = constraints.reserve(*_claims(spark, sf_dir), 50)
    return outcomes.unionByName(claims.select("value", "request_id", F.lit("claim").alias("outcome"), "state", "expires_at"), allowMissingColumns=True)


@query(f"""
WITH c AS {_CLAIMS}, a AS {_ASKED},
o AS (SELECT a.value, a.request_id, CASE WHEN c.value IS NULL THEN 'not_found' WHEN c.state = 'committed' THEN 'already_committed' WHEN c.request_id <> a.request_id THEN 'wrong_request' ELSE 'committed' END AS outcome FROM a LEFT JOIN c ON c.value = a.value)
SELECT value, request_id, outcome FROM o UNION ALL SELECT value, request_id, CASE WHEN value IN (SELECT value FROM o WHERE outcome = 'committed') THEN 'claim committed' ELSE 'claim ' || state END FROM c""")
def unique_commit(spark, sf_dir):
    claims, outcomes = constraints.commit_claims(*_claims(spark, sf_dir))
    return outcomes.unionByName(claims.select("value", "request_id", F.concat(F.lit("claim "), "state").alias("outcome")))


@query(f"WITH c AS {_CLAIMS} SELECT value, request_id, state FROM c WHERE NOT EXISTS (SELECT 1 FROM {_ASKED} a WHERE a.value = c.value AND a.request_id = CASE c.state WHEN 'committed' THEN c.record_id ELSE c.request_id END) AND NOT (state = 'committed' AND record_id LIKE '%0')")
def unique_release(spark, sf_dir):
    claims, asked = _claims(spark, sf_dir)
    by_record = claims.filter(F.col("record_id").endswith("0")).select("value", F.col("record_id").alias("request_id"))
    return constraints.release_claims(claims, asked.select("value", "request_id").unionByName(by_record)).select("value", "request_id", "state")


@query("""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'established' WHEN c_custkey % 6 = 1 THEN 'already_committed' WHEN c_custkey % 6 = 2 THEN 'repaired' WHEN c_custkey % 6 = 3 THEN 'pending' ELSE 'conflict' END AS outcome FROM customer""")
def unique_reconcile(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey") % 6
    claims = rows.filter(k != 0).select("c_name", F.when(k <= 2, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1).alias("claim_id"), F.when(k.isin(2, 3), "reserved").otherwise("committed").alias("state"))
    return constraints.reconcile_claims(rows, claims, "c_name", "c_custkey")


@query(f"SELECT o_orderkey, 'status' AS field FROM {_NULLED} WHERE status IS NULL")
def not_null_violations(spark, sf_dir):
    return constraints.null_violations(nulled(spark, sf_dir), NotNull("orders", "status"), "o_orderkey")


@query("""
SELECT event_id, 'k' AS field, CASE event_id % 5 WHEN 0 THEN 'required' ELSE 'type' END AS violation FROM events WHERE event_id % 5 <> 4""")
def schema_violations(spark, sf_dir):
    kind = F.col("event_id") % 5
    doc = F.when(kind == 0, "{}").when(kind == 1, '{"k": null}').when(kind == 2, '{"k": "5"}').when(kind == 3, '{"k": true}').otherwise(F.col("props"))
    rows = t(spark, sf_dir, "events").select("event_id", F.parse_json(doc).alias("data"))
    return constraints.document_violations(rows, Schema("events", {"k": scalars.field("number", required=True)}), id_col="event_id")


@query(f"SELECT o_orderkey, 'status' AS field, 'required' AS violation FROM {_NULLED} WHERE status IS NULL UNION ALL SELECT o_orderkey, 'o_totalprice', 'type' FROM orders")
def schema_violations_typed(spark, sf_dir):
    return constraints.schema_violations(nulled(spark, sf_dir), Schema("orders", {"status": scalars.field("string", True), "o_totalprice": scalars.field("string")}), "o_orderkey")


@query(f"SELECT o_orderkey, coalesce(status, 'new') AS status, 1 AS priority FROM {_NULLED}")
def schema_defaults(spark, sf_dir):
    return scalars.with_defaults(nulled(spark, sf_dir).select("o_orderkey", "status"), Schema("orders", {"status": scalars.field("string", default="new"), "priority": scalars.field("number", default=1)}))


@query("SELECT l_orderkey AS id, l_linenumber FROM lineitem WHERE l_orderkey % 13 = 0")
def stale_index_entries(spark, sf_dir):
    index = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return constraints.stale_entries(index, t(spark, sf_dir, "orders").filter("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("id")))


# writes: a state of orders and a delta of it

_STATE = "(SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(3 AS BIGINT) AS _version FROM orders)"


def state(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(3).cast("bigint").alias("_version"))


@query(f"""
SELECT o_orderkey, o_orderstatus, o_totalprice, _version, CAST(NULL AS BIGINT) AS _expires_at FROM {_STATE} WHERE o_orderkey % 10 <> 0
UNION ALL SELECT CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END, 'N', o_totalprice + 1, CAST(1 AS BIGINT), CASE WHEN o_orderkey % 30 = 0 THEN CAST(1000 + o_orderkey % 100 AS BIGINT) END FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, _version, NULL FROM {_STATE} WHERE o_orderkey % 20 = 0""")
def upsert_apply(spark, sf_dir):
    k = F.col("o_orderkey")
    incoming = t(spark, sf_dir, "orders").filter(k % 10 == 0).select(F.when(k % 20 == 0, k + 10000000).otherwise(k).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(k % 30 == 0, k % 100).alias("ttl_secs"))
    return mutate.create(state(spark, sf_dir), incoming, "o_orderkey", now=1000)


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 30 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN _version + 1 ELSE _version END AS _version FROM {_STATE}""")
def update_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    delta = t(spark, sf_dir, "orders").filter(k % 10 == 0).select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), F.when(k % 30 == 0, F.col("o_totalprice") + 1).alias("o_totalprice"))
    return mutate.update(state(spark, sf_dir), delta, "o_orderkey", given=lambda new, c: F.lit(True) if c == "o_orderstatus" else new[c].isNotNull())


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 20 = 0 THEN _version + 1 ELSE _version END AS _version FROM {_STATE}")
def update_optimistic(spark, sf_dir):
    k = F.col("o_orderkey")
    delta = t(spark, sf_dir, "orders").filter(k % 10 == 0).select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(k % 20 == 0, 3).otherwise(2).alias("seen"))
    return mutate.update(state(spark, sf_dir), delta, "o_orderkey", expected="seen")


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice, _version FROM {_STATE} WHERE o_orderkey % 10 NOT IN (0, 1) UNION ALL SELECT o_orderkey + CASE WHEN o_orderkey % 20 = 1 THEN 10000000 ELSE 0 END, 'B', o_totalprice, _version + 1 FROM {_STATE} WHERE o_orderkey % 10 = 1")
def batch_commit(spark, sf_dir):
    """A batch whose preconditions hold: rows as they are expected, new ids absent. Half of the puts are new ids."""
    rows, k = state(spark, sf_dir), F.col("o_orderkey")
    ones = rows.filter(k % 10 == 1)
    puts = ones.select(F.when(k % 20 == 1, k + 10000000).otherwise(k).alias("o_orderkey"), F.lit("B").alias("o_orderstatus"), "o_totalprice", (F.col("_version") + 1).alias("_version"))
    removes = rows.filter((k % 10 == 0) | (k % 20 == 1)).select("o_orderkey")
    return mutate.batch(rows, "o_orderkey", puts, removes, equal=ones.select("o_orderkey", "_version", "o_orderstatus"), absent=puts.filter(k > 10000000))


@query(f"SELECT * FROM {_STATE} WHERE o_orderkey % 10 <> 0")
def delete_apply(spark, sf_dir):
    return mutate.delete(state(spark, sf_dir), t(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0"), "o_orderkey")


@query("""
SELECT entity, id, operation, status, CAST(row_number() OVER (ORDER BY operation, id) AS BIGINT) AS sequence FROM (
  SELECT 'orders' AS entity, CAST(o_orderkey AS VARCHAR) AS id, 'Delete' AS operation, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'Update', 'U' FROM orders WHERE o_orderkey % 10 = 1 AND o_orderstatus <> 'U'
  UNION ALL SELECT 'orders', CAST(o_orderkey + 10000000 AS VARCHAR), 'Create', o_orderstatus FROM orders WHERE o_orderkey % 10 = 2)""")
def change_feed(spark, sf_dir):
    k = F.col("o_orderkey")
    old = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = old.filter(k % 10 != 0).withColumn("o_orderstatus", F.when(k % 10 == 1, "U").otherwise(F.col("o_orderstatus"))).unionByName(old.filter(k % 10 == 2).withColumn("o_orderkey", k + 10000000))
    feed = mutate.changes(old, new, "orders", "o_orderkey").withColumn("status", F.get_json_object("data", "$.o_orderstatus")).drop("data")
    return mutate.sequenced(feed, [F.col("operation"), F.col("id")])


@query("""
SELECT user_id, prev AS after, seq AS next, seq - prev - 1 AS missing
FROM (SELECT user_id, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE seq > prev + 1""")
def sequence_gaps(spark, sf_dir):
    return mutate.gaps(t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("sequence")), ["user_id"])


# delivery of events

_PATTERNS = [("s1", "users/+/view", None, None, "broadcast"), ("s2", "users/#", "view", "g1", "load_balanced"), ("s3", "users/#", None, "g1", "load_balanced"), ("s4", "+/7/#", None, None, "broadcast"), ("s5", "users/+/purchase", None, "g1", "load_balanced"), ("s6", "#/error", None, None, "broadcast")]
_SUBS = "(VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if c is None else repr(c)}, {'NULL' if d is None else repr(d)}, '{e}')" for a, b, c, d, e in _PATTERNS) + ") s(subscription_id, pattern, sub_entity, share_group, mode)"
_REGEX = "'^' || replace(replace(array_to_string(list_transform(string_split(pattern, '/'), lambda x: '/' || x), ''), '/+', '/[^/]*'), '/#', '(/[^/]*)*') || '$'"
_MATCHED = f"""(SELECT e.event_id, e.event_type AS entity, e.topic, s.subscription_id, s.share_group FROM (SELECT event_id, event_type, 'users/' || user_id || '/' || event_type AS topic FROM events) e
JOIN {_SUBS} ON regexp_full_match('/' || e.topic, {_REGEX}) AND (s.sub_entity IS NULL OR s.sub_entity = e.event_type))"""


def feed(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("entity"), F.concat(F.lit("users/"), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("topic"))


def subscriptions(spark) -> DataFrame:
    return spark.createDataFrame(_PATTERNS, "subscription_id string, pattern string, entity string, share_group string, mode string")


def matched(spark, sf_dir) -> DataFrame:
    return routing.matches(feed(spark, sf_dir), subscriptions(spark)).select("event_id", "entity", "topic", "subscription_id", "share_group")


@query(f"SELECT * FROM {_MATCHED}")
def sub_match(spark, sf_dir):
    return matched(spark, sf_dir)


@query(f"SELECT event_id, subscription_id FROM {_MATCHED} WHERE share_group IS NULL")
def route_broadcast(spark, sf_dir):
    return routing.broadcast_mode(matched(spark, sf_dir)).select("event_id", "subscription_id")


@query(f"""
SELECT event_id, share_group, subscription_id FROM (
  SELECT *, row_number() OVER (PARTITION BY share_group, event_id ORDER BY subscription_id) - 1 AS place, count(*) OVER (PARTITION BY share_group, event_id) AS members, dense_rank() OVER (PARTITION BY share_group ORDER BY event_id) - 1 AS turn
  FROM {_MATCHED} WHERE share_group IS NOT NULL) WHERE place = turn % members""")
def route_round_robin(spark, sf_dir):
    return routing.round_robin(matched(spark, sf_dir), ["event_id"]).select("event_id", "share_group", "subscription_id")


_MEMBERS = "(SELECT DISTINCT event_type AS share_group, 'm' || (user_id % 3) AS member FROM events)"
_ASSIGNED = f"""(SELECT share_group, CAST(p AS INT) AS partition, member FROM (SELECT share_group, member, row_number() OVER (PARTITION BY share_group ORDER BY member) - 1 AS place, count(*) OVER (PARTITION BY share_group) AS n FROM {_MEMBERS}), (SELECT unnest(range(8)) AS p) WHERE p % n = place)"""


def members(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "events").select(F.col("event_type").alias("share_group"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("member")).distinct()


@query(f"SELECT * FROM {_ASSIGNED}")
def group_rebalance(spark, sf_dir):
    return routing.assignments(members(spark, sf_dir))


@query(f"""
SELECT e.event_id, e.event_type AS share_group, CAST(('0x' || substr(md5('users:' || e.user_id), 1, 7))::BIGINT % 8 AS INT) AS partition, a.member
FROM events e JOIN {_ASSIGNED} a ON a.share_group = e.event_type AND a.partition = ('0x' || substr(md5('users:' || e.user_id), 1, 7))::BIGINT % 8""")
def route_ordered(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("share_group"), F.lit("users").alias("entity"), F.col("user_id").alias("id"))
    return routing.ordered(rows, routing.assignments(members(spark, sf_dir))).select("event_id", "share_group", "partition", "member")


_BEATS = "(SELECT event_type AS share_group, 'u' || user_id AS member, CAST(max(event_id % 100) AS BIGINT) AS heartbeat FROM events GROUP BY ALL)"


@query(f"SELECT share_group, CAST(p AS INT) AS partition, member FROM (SELECT share_group, member, row_number() OVER (PARTITION BY share_group ORDER BY member) - 1 AS place, count(*) OVER (PARTITION BY share_group) AS n FROM {_BEATS} WHERE 120 - heartbeat <= 30), (SELECT unnest(range(8)) AS p) WHERE p % n = place")
def stale_members(spark, sf_dir):
    beats = t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("share_group"), F.concat(F.lit("u"), F.col("user_id")).alias("member")).agg(F.max(F.col("event_id") % 100).alias("heartbeat"))
    return routing.assignments(routing.fresh_members(beats, 120))


@query("SELECT 'g' || (user_id % 10) AS share_group, count(DISTINCT event_type) AS modes FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def mixed_mode_groups(spark, sf_dir):
    return routing.mixed_groups(t(spark, sf_dir, "events").select(F.concat(F.lit("g"), F.col("user_id") % 10).alias("share_group"), F.col("event_type").alias("mode")))


@query("""
SELECT event_id AS entry_id, CAST(event_id % 13 AS INT) AS retry_count, CAST(event_id % 4 AS INT) AS "from",
       CASE WHEN event_id % 13 >= 10 THEN 'dead' WHEN rn <= 100 THEN 'deliver' ELSE 'wait' END AS action
FROM (SELECT event_id, CASE WHEN event_id % 13 < 10 THEN row_number() OVER (PARTITION BY event_id % 13 < 10 ORDER BY ts, event_id) END AS rn FROM events)""")
def outbox_classify(spark, sf_dir):
    k = F.col("event_id")
    entries = t(spark, sf_dir, "events").select(k.alias("entry_id"), F.col("ts").alias("created_at"), (k % 13).cast("int").alias("retry_count"), (k % 4).cast("int").alias("dispatched_count"))
    return routing.outbox(entries).select("entry_id", "retry_count", "from", "action")


@query("SELECT o_orderkey, CAST(o_orderkey % 1000 AS BIGINT) AS _expires_at FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 1000 <= 500")
def ttl_sweep(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 1000).alias("_expires_at"))
    return routing.sweep(rows, 500)[1]


@query("""
SELECT topic, payload, event_id FROM (SELECT event_type || '/' || user_id AS topic, CASE WHEN event_id % 9 = 0 THEN '' ELSE props END AS payload, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND payload <> ''""")
def retained_latest(spark, sf_dir):
    messages = t(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("topic"), F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("props")).alias("payload"), "event_id", "ts")
    return routing.retained(messages, F.struct("ts", "event_id")).drop("ts")


@query("""SELECT consumer, partition, sequence, "at" FROM (SELECT event_type AS consumer, CAST(user_id % 8 AS INT) AS partition, event_id AS sequence, event_id * 1000 AS "at", row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND 1000000 - "at" <= 604800""")
def consumer_offsets(spark, sf_dir):
    commits = t(spark, sf_dir, "events").select(F.col("event_type").alias("consumer"), (F.col("user_id") % 8).cast("int").alias("partition"), F.col("event_id").alias("sequence"), (F.col("event_id") * 1000).alias("at"))
    return routing.offsets(commits, 1_000_000)


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 50 + c_custkey % 20 <= 30")
def expired_sessions(spark, sf_dir):
    k = F.col("c_custkey")
    return routing.expired_sessions(t(spark, sf_dir, "customer").select("c_custkey", (k % 4 == 0).alias("connected"), (k % 50).alias("disconnected_at"), (k % 20).alias("expiry_s")), 30).select("c_custkey")


@query("""
SELECT request_id, sequence, CASE WHEN 900 - first_at > 600 THEN 'expired' WHEN rn = 1 THEN 'first' WHEN params <> first_params THEN 'mismatch' ELSE 'replay' END AS outcome
FROM (SELECT user_id AS request_id, event_id AS sequence, event_type AS params, first_value(event_id) OVER w AS first_at, first_value(event_type) OVER w AS first_params, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def idempotency(spark, sf_dir):
    return routing.idempotency(t(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("params"), F.col("event_id").alias("at")), 900, 600)


@query("""
WITH o AS (SELECT event_id % 8 AS partition, event_id AS k, event_type, CASE event_id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'committed' ELSE 'expired' END AS status FROM events WHERE event_id % 4 = 0),
n AS (SELECT event_id % 8 AS partition, event_id AS k, CASE WHEN event_id % 20 = 0 THEN 'other' ELSE event_type END AS event_type FROM events WHERE event_id % 4 <> 1),
f AS (SELECT n.partition, n.k, row_number() OVER (PARTITION BY n.partition ORDER BY n.k) + coalesce(u, 0) > 60 AS full FROM n LEFT JOIN (SELECT partition, count(*) AS u FROM o GROUP BY 1) c USING (partition) WHERE n.k NOT IN (SELECT k FROM o))
SELECT n.partition, CAST(n.k AS VARCHAR) AS request_key, n.k AS sequence, CASE WHEN o.event_type <> n.event_type THEN 'mismatch' WHEN o.status = 'committed' THEN 'cached' WHEN o.status IS NOT NULL THEN o.status WHEN f.full THEN 'full' ELSE 'proceed' END AS outcome,
       CASE WHEN o.event_type = n.event_type AND o.status = 'committed' THEN 'r' || n.k END AS response FROM n LEFT JOIN o USING (partition, k) LEFT JOIN f USING (partition, k)""")
def idempotency_states(spark, sf_dir):
    k = F.col("event_id")
    rows = t(spark, sf_dir, "events").select((k % 8).alias("partition"), k.cast("string").alias("request_key"), F.col("event_type").alias("entity"), k.cast("string").alias("id"), k.alias("sequence"))
    at = F.col("sequence")
    status = F.when(at % 3 == 0, "processing").when(at % 3 == 1, "committed").otherwise("expired")
    records = rows.filter(at % 4 == 0).select("partition", "request_key", "entity", "id", status.alias("status"), F.concat(F.lit("r"), "id").alias("response"))
    return routing.idempotency_check(records, rows.filter(at % 4 != 1).withColumn("entity", F.when(at % 20 == 0, "other").otherwise(F.col("entity"))), 60)


@query("SELECT client, CAST(least(max(qos), 1) AS INT) AS qos FROM (SELECT user_id AS client, CAST(event_id % 3 AS INT) AS qos FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, CAST(event_id % 2 AS INT) FROM events WHERE event_type <> 'click') GROUP BY 1")
def route_max_qos(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    row = lambda where, n: events.filter(where).select(F.col("user_id").alias("client"), (F.col("event_id") % n).cast("int").alias("qos"))
    return routing.strongest_qos(row("event_type = 'view'", 3), row("event_type <> 'click'", 2), 1)


@query("SELECT o_orderkey AS sequence, o_orderstatus FROM orders WHERE o_orderkey > 300 ORDER BY o_orderkey LIMIT 200")
def log_replay(spark, sf_dir):
    return routing.replay(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sequence"), "o_orderstatus"), 300, 200)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'top/users/' || user_id || '/click/events/created' ELSE 'top/click/events/p' || CAST(('0x' || substr(md5('click:' || event_id), 1, 7))::BIGINT % 8 AS VARCHAR) || '/' || event_id END AS topic FROM events WHERE event_type = 'click'")
def event_topics(spark, sf_dir):
    rows = t(spark, sf_dir, "events").filter("event_type = 'click'")
    scope = scalars.scope_of(F.lit("click"), F.col("event_id"), {"users": "user_id"}, {"user_id": F.when(F.col("event_id") % 4 == 0, F.col("user_id"))})
    part = routing.event_partition(F.col("event_type"), F.col("event_id")).cast("string")
    return rows.select("event_id", scalars.event_topic("top", F.col("event_type"), F.lit("Create"), F.col("event_id"), part, scope).alias("topic"))


@query("SELECT topic, topic LIKE 'users/%' AS under_users, topic NOT LIKE '$%' AS any_level, regexp_full_match(topic, 'users/[^/]*/view') AS one_level FROM (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN '$SYS/' ELSE 'users/' END || user_id || '/' || event_type AS topic FROM events)")
def topic_patterns(spark, sf_dir):
    topic = F.concat(F.when(F.col("event_id") % 3 == 0, "$SYS/").otherwise("users/"), F.col("user_id"), F.lit("/"), F.col("event_type"))
    rows = t(spark, sf_dir, "events").select(topic.alias("topic")).distinct()
    return rows.select("topic", predicates.topic_match(F.col("topic"), "users/#").alias("under_users"), predicates.topic_match(F.col("topic"), "#", system=False).alias("any_level"), predicates.topic_match(F.col("topic"), "users/+/view").alias("one_level"))


#: Shapes of topics, {} is a number: every tier, its near misses and the exempt internal entities.
_SHAPES = ("_quernel/x{}", "_quernel", "_quernelx/{}", "$DB/_idx/{}", "$DB/_unique/a/{}", "$DB/_fk/{}", "$DB/_query/{}", "$DB/p{}/x", "$DB/p/{}", "$DB/px{}/1", "$DB/users/events/{}", "$DB/users/event/{}", "$DB/u/{}/a", "$DB/_sub/{}", "$DB/_sub/events/{}",
           "$SYS/quernel/cluster/{}", "$SYS/quernel/{}", "$SYS/broker/{}", "$DB/_verify/{}", "$DB/_health/{}", "$DB/_vault/{}", "$DB/_auth", "$DB/_admin/{}", "$DB/_oauth_tokens/{}", "$DB/_sessions", "$DB/users/{}", "plain/{}/events")
_TIER = r"""CASE WHEN topic = '_quernel' OR topic LIKE '\_quernel/%' ESCAPE '\' THEN 'block' WHEN regexp_matches(topic, '^\$DB/(_idx|_unique|_fk|_query|p[0-9]+)(/|$)') THEN 'block' WHEN regexp_matches(topic, '^\$DB/[^/]*/events(/|$)') OR regexp_matches(topic, '^\$DB/u(/|$)') THEN 'read_only'
WHEN regexp_matches(topic, '^\$DB/_sub(/|$)') THEN 'write_only' WHEN regexp_matches(topic, '^\$SYS/quernel/cluster(/|$)') THEN 'admin' WHEN topic LIKE '$SYS/%' OR topic = '$SYS' THEN 'read_only' WHEN regexp_matches(topic, '^\$DB/_verify(/|$)') THEN 'admin'
WHEN starts_with(topic, '$DB/_') AND split_part(topic, '/', 2) NOT IN ('_health', '_vault', '_auth', '_verify') THEN 'internal' ELSE 'open' END"""


@query(f"""
WITH s AS (SELECT [{", ".join(f"'{x}'" for x in _SHAPES)}] AS shapes),
r AS (SELECT c_custkey, replace(shapes[CAST(c_custkey % {len(_SHAPES)} AS INT) + 1], '{{}}', CAST(c_custkey AS VARCHAR)) AS topic, publish, admin FROM customer, s, (VALUES (true), (false)) p(publish), (VALUES (true), (false)) q(admin)),
t AS (SELECT *, {_TIER} AS tier FROM r)
SELECT c_custkey, topic, publish, admin, tier, CASE WHEN tier = 'block' THEN 'blocked' WHEN tier = 'read_only' AND publish THEN 'read_only' WHEN tier = 'write_only' AND NOT publish THEN 'write_only' WHEN tier IN ('admin', 'internal') AND NOT admin THEN tier END AS refused FROM t""")
def topic_protection(spark, sf_dir):
    """Every tier, both directions, with and without the admin role."""
    k = F.col("c_custkey")
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (k % len(_SHAPES)).cast("int") + 1)
    both = lambda name: F.explode(F.array(F.lit(True), F.lit(False))).alias(name)
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.replace(shape, F.lit("{}"), k.cast("string")).alias("topic"))
    return access.topic_access(rows.select("*", both("publish")).select("*", both("admin")))


# access

_SHARES = "(SELECT 'orders' AS resource_entity, CAST(o_orderkey AS VARCHAR) AS resource_id, 'u' || (o_orderkey % 5) AS grantee, CASE WHEN o_orderkey % 2 = 0 THEN 'edit' ELSE 'view' END AS permission, 'u' || (o_custkey % 7) AS granted_by FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'u' || (o_orderkey % 5), 'edit', 'u9' FROM orders WHERE o_orderkey % 9 = 0)"


def shares(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t(spark, sf_dir, "orders")
    grantee = F.concat(F.lit("u"), k % 5).alias("grantee")
    first = rows.filter(k % 3 == 0).select(F.lit("orders").alias("resource_entity"), k.cast("string").alias("resource_id"), grantee, F.when(k % 2 == 0, "edit").otherwise("view").alias("permission"), F.concat(F.lit("u"), F.col("o_custkey") % 7).alias("granted_by"))
    return first.unionByName(rows.filter(k % 9 == 0).select(F.lit("orders").alias("resource_entity"), k.cast("string").alias("resource_id"), grantee, F.lit("edit").alias("permission"), F.lit("u9").alias("granted_by")))


def owned_orders(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("u"), F.col("o_custkey") % 7).alias("owner"))


@query(f"SELECT resource_entity, resource_id, grantee, max(CASE permission WHEN 'edit' THEN 2 ELSE 1 END) AS level FROM {_SHARES} GROUP BY ALL")
def access_effective_level(spark, sf_dir):
    return access.effective_levels(shares(spark, sf_dir))


@query(f"SELECT o_orderkey, o_custkey, 'u' || (o_custkey % 7) AS owner FROM orders WHERE o_custkey % 7 = 2 OR CAST(o_orderkey AS VARCHAR) IN (SELECT resource_id FROM {_SHARES} WHERE grantee = 'u2' AND permission = 'edit')")
def access_allowed(spark, sf_dir):
    return access.accessible(owned_orders(spark, sf_dir), shares(spark, sf_dir), "orders", "u2", "edit", "owner", "o_orderkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3 OR CAST(o_orderkey AS VARCHAR) IN (SELECT resource_id FROM {_SHARES} WHERE grantee = 'u3'))")
def access_derived(spark, sf_dir):
    return access.derived(t(spark, sf_dir, "lineitem"), "l_orderkey", owned_orders(spark, sf_dir), shares(spark, sf_dir), "orders", "u3", "view", "owner", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT o_orderkey, o_custkey, 'u' || (o_custkey % 7) AS owner, level FROM orders JOIN (SELECT resource_id, max(CASE permission WHEN 'edit' THEN 2 ELSE 1 END) AS level FROM {_SHARES} WHERE grantee = 'u1' GROUP BY 1) ON resource_id = CAST(o_orderkey AS VARCHAR)")
def shared_with_me(spark, sf_dir):
    return access.shared_with(owned_orders(spark, sf_dir), shares(spark, sf_dir), "orders", "u1", "o_orderkey")


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE array_to_string(list_sort(list_distinct(list_append(coalesce(g, []), 'u' || (o_custkey % 7)))), ',') END AS recipients
FROM orders LEFT JOIN (SELECT resource_id, list(grantee) AS g FROM {_SHARES} GROUP BY 1) ON resource_id = CAST(o_orderkey AS VARCHAR)""")
def event_recipients(spark, sf_dir):
    events = t(spark, sf_dir, "orders").select("o_orderkey", F.lit("orders").alias("governing_entity"), F.col("o_orderkey").cast("string").alias("governing_id"))
    owners = owned_orders(spark, sf_dir).filter("o_orderkey % 4 <> 0").select(F.lit("orders").alias("entity"), F.col("o_orderkey").cast("string").alias("id"), "owner")
    return access.recipients(events, owners, shares(spark, sf_dir)).select("o_orderkey", F.array_join("recipients", ",").alias("recipients"))


@query(f"""
SELECT o_orderkey, r.recipient, '$USERS/' || r.recipient || '/orders/events/' || o_orderkey AS recipient_topic FROM orders
LEFT JOIN (SELECT resource_id, list(grantee) AS g FROM {_SHARES} GROUP BY 1) ON resource_id = CAST(o_orderkey AS VARCHAR), LATERAL (SELECT unnest(list_distinct(list_append(coalesce(g, []), 'u' || (o_custkey % 7)))) AS recipient) r
WHERE o_orderkey % 4 <> 0""")
def scoped_routing(spark, sf_dir):
    events = t(spark, sf_dir, "orders").select("o_orderkey", F.lit("orders").alias("governing_entity"), F.col("o_orderkey").cast("string").alias("governing_id"))
    owners = owned_orders(spark, sf_dir).filter("o_orderkey % 4 <> 0").select(F.lit("orders").alias("entity"), F.col("o_orderkey").cast("string").alias("id"), "owner")
    rows = access.recipients(events, owners, shares(spark, sf_dir))
    return routing.scoped(rows, F.concat_ws("/", F.lit("orders/events"), "governing_id")).select("o_orderkey", "recipient", "recipient_topic")


@query(f"""
SELECT DISTINCT resource_id, recipient FROM (SELECT s.resource_id, s.grantee AS recipient, s.granted_by FROM {_SHARES} s
UNION ALL SELECT s.resource_id, 'u' || (o_custkey % 7), s.granted_by FROM {_SHARES} s JOIN orders ON CAST(o_orderkey AS VARCHAR) = s.resource_id WHERE 'u' || (o_custkey % 7) <> s.granted_by)""")
def share_events(spark, sf_dir):
    owners = owned_orders(spark, sf_dir).select(F.lit("orders").alias("entity"), F.col("o_orderkey").cast("string").alias("id"), "owner")
    return access.share_events(shares(spark, sf_dir), owners).select("resource_id", "recipient").distinct()


_ONE = f"(SELECT resource_entity, resource_id, grantee, max(permission) FILTER (WHERE permission = 'edit') AS e, min(granted_by) AS granted_by FROM {_SHARES} GROUP BY ALL)"


def single_shares(spark, sf_dir) -> DataFrame:
    """One grant per resource and grantee."""
    return access.effective_levels(shares(spark, sf_dir)).select("resource_entity", "resource_id", "grantee", F.when(F.col("level") == 2, "edit").otherwise("view").alias("permission"), F.lit("u0").alias("granted_by"))


@query(f"""
WITH s AS (SELECT resource_entity, resource_id, grantee, coalesce(e, 'view') AS permission FROM {_ONE}),
n AS (SELECT 'orders' AS resource_entity, CAST(k AS VARCHAR) AS resource_id, 'u3' AS grantee FROM (SELECT unnest([3, 18, 33, 41]) AS k))
SELECT coalesce(s.resource_entity, n.resource_entity) AS resource_entity, coalesce(s.resource_id, n.resource_id) AS resource_id, coalesce(s.grantee, n.grantee) AS grantee,
       CASE WHEN n.resource_id IS NULL THEN s.permission WHEN n.resource_id = '18' THEN 'view' WHEN s.permission = 'edit' THEN 'edit' ELSE 'view' END AS permission
FROM s FULL JOIN n ON s.resource_entity = n.resource_entity AND s.resource_id = n.resource_id AND s.grantee = n.grantee""")
def share_grant(spark, sf_dir):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, (3, 18, 33, 41)))).alias("id"))
    return access.grant(single_shares(spark, sf_dir), rows, "orders", 18, "u3", "view", "u0").drop("granted_by")


@query(f"SELECT resource_entity, resource_id, grantee, coalesce(e, 'view') AS permission FROM {_ONE} WHERE NOT (grantee = 'u3' AND resource_id IN ('3', '18', '33'))")
def share_revoke(spark, sf_dir):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, (3, 18, 33)))).alias("id"))
    return access.revoke(single_shares(spark, sf_dir), rows, "orders", "u3").drop("granted_by")


@query(f"SELECT resource_entity, resource_id, grantee, coalesce(e, 'view') AS permission FROM {_ONE} WHERE CAST(resource_id AS BIGINT) % 2 = 1")
def share_clear(spark, sf_dir):
    gone = t(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.lit("orders").alias("entity"), F.col("o_orderkey").alias("id"))
    return access.without_grants(single_shares(spark, sf_dir), gone).drop("granted_by")


# keys, checksums, encryption, backup


@query("SELECT o_orderkey, 'data/orders/' || o_orderkey AS data_key, 'idx/orders/status/' || o_orderstatus || '/' || o_orderkey AS index_key, 'uniq/orders/status/' || o_orderstatus AS unique_key, CAST(o_orderkey AS VARCHAR) AS id FROM orders")
def record_keys(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    key = scalars.data_key("orders", k)
    return t(spark, sf_dir, "orders").select("o_orderkey", key.alias("data_key"), scalars.index_key("orders", "status", s, k).alias("index_key"), scalars.unique_key("orders", "status", s).alias("unique_key"), scalars.id_of_key(key).alias("id"))


def _crc_sql(text: str) -> str:
    """CRC-32 of a string's bytes, bit by bit."""
    bit = "lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda a, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], {bit}, xor(a, x))"
    codes = f"list_transform(range(0, strlen({text})), lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(list_reduce({codes}, {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


@query(f"SELECT o_orderkey, CAST({_crc_sql("('orders/' || o_orderkey)")} % 256 AS INT) AS data_partition, CAST({_crc_sql("('unique/orders/id/' || o_orderkey)")} % 256 AS INT) AS unique_partition FROM orders")
def partition_crc32(spark, sf_dir):
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", scalars.crc_partition(Config.partitions, "orders", k).alias("data_partition"), scalars.crc_partition(Config.partitions, "unique", "orders", "id", k).alias("unique_partition"))


@query(f"""
SELECT o_orderkey, lower(printf('%08x', {_crc_sql("body")})) || lower(hex(encode(body))) AS stored, true AS intact, o_orderkey % 5 <> 0 AS other_intact
FROM (SELECT o_orderkey, '{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}' AS body FROM orders)""")
def record_integrity(spark, sf_dir):
    """Records behind their checksums, and whether they are intact; every fifth one has a byte more."""
    rows = t(spark, sf_dir, "orders").select("o_orderkey", scalars.checksum(F.to_json(F.struct("o_orderkey", "o_orderstatus"))).alias("bytes"))
    other = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.col("bytes"), F.lit("x").cast("binary"))).otherwise(F.col("bytes"))
    return rows.select("o_orderkey", F.lower(F.hex("bytes")).alias("stored"), scalars.verified(F.col("bytes")).alias("intact"), scalars.verified(other).alias("other_intact"))


def mixed(spark, sf_dir) -> DataFrame:
    """event_id and v, JSON values of different types, as VARIANT."""
    k = F.col("event_id")
    text = F.when(k % 6 == 0, "null").when(k % 6 == 1, F.when(k % 4 == 1, "true").otherwise("false")).when(k % 6 == 2, (k % 50 - 20).cast("string")).when(k % 6 == 3, ((k % 40 - 20) / 4.0).cast("string")).when(k % 6 == 4, F.concat(F.lit('"t'), k % 30, F.lit('"'))).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return t(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v"))


@query("""
SELECT event_id, CAST(row_number() OVER (ORDER BY CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 3 ELSE 2 END, CASE k WHEN 1 THEN CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END WHEN 2 THEN event_id % 50 - 20 WHEN 3 THEN (event_id % 40 - 20) / 4.0 WHEN 5 THEN event_id + 0.5 END NULLS FIRST, CASE k WHEN 4 THEN 't' || event_id % 30 END NULLS FIRST, event_id) AS BIGINT) AS place
FROM (SELECT event_id, event_id % 6 AS k FROM events)""")
def sort_mixed(spark, sf_dir):
    """Places of values of different types: null, booleans, numbers, text."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(scalars.order_of(F.col("v")))]
    rows = mixed(spark, sf_dir).select("event_id", *keys)
    return mutate.sequenced(rows, [F.col("k0"), F.col("k1"), F.col("k2"), F.col("event_id")]).select("event_id", F.col("sequence").alias("place"))


@query("""
SELECT event_id, CASE k WHEN 0 THEN hex(encode('null')) WHEN 1 THEN hex(encode(CASE WHEN event_id % 4 = 1 THEN 'true' ELSE 'false' END)) WHEN 2 THEN printf('%016X', CAST(event_id % 50 - 20 + 9223372036854775808::HUGEINT AS UBIGINT)) WHEN 4 THEN hex(encode('t' || event_id % 30))
  ELSE printf('%016X', CASE WHEN b >= 0 THEN CAST(b + 9223372036854775808::HUGEINT AS UBIGINT) ELSE CAST(-1 - b AS UBIGINT) END) END AS key
FROM (SELECT event_id, event_id % 6 AS k, CAST(CAST(CAST(CASE event_id % 6 WHEN 3 THEN (event_id % 40 - 20) / 4.0 ELSE event_id + 0.5 END AS DOUBLE) AS BIT) AS BIGINT) AS b FROM events)""")
def index_values(spark, sf_dir):
    """Index keys of values of different types."""
    rows = mixed(spark, sf_dir)
    return rows.select("event_id", F.when(F.col("event_id") % 6 == 3, scalars.sortable_double(F.try_variant_get("v", "$", "double"))).otherwise(scalars.index_value(F.col("v"))).alias("key"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 100")
def index_backfill(spark, sf_dir):
    """A filter on a copy that is sorted by the indexed field."""
    return listing.where(listing.sorted_copy(t(spark, sf_dir, "orders"), ["o_custkey"]), predicates.parse_filters("o_orderstatus=F,o_custkey<100")).select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (ORDER BY s_suppkey - 5) AS BIGINT) AS place FROM supplier")
def sortable_keys(spark, sf_dir):
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", scalars.sortable_long(F.col("s_suppkey") - 5).alias("key"))
    return mutate.sequenced(rows, [F.col("key")]).withColumnRenamed("sequence", "place").drop("key")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, true AS hidden FROM customer")
def vault_roundtrip(spark, sf_dir):
    key = F.lit("0123456789abcdef").cast("binary")
    plain = t(spark, sf_dir, "customer")
    sealed = scalars.seal_fields(plain, key, "customer", "c_mktsegment", "c_custkey").withColumn("hidden", ~F.col("c_name").contains("Customer"))
    return scalars.unseal_fields(sealed, plain.schema, key, "customer", "c_mktsegment", "c_custkey")


@query("SELECT o_orderkey, status, o_totalprice, CAST(1 AS BIGINT) AS _version FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders)")
def backup_roundtrip(spark, sf_dir):
    rows = nulled(spark, sf_dir).select("o_orderkey", "status", "o_totalprice", F.lit(4).cast("bigint").alias("_version"))
    path = constraints.new_folder(spark, "backup")
    backup.backup({"orders": rows, "nation": t(spark, sf_dir, "nation")}, path)
    return backup.restore(spark, path, {"orders": rows.schema})["orders"]


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey || ',"a ""quoted"", cell"' ELSE c_custkey || ',' || c_mktsegment END AS value FROM customer""")
def csv_export(spark, sf_dir):
    k = F.col("c_custkey")
    return export.csv_lines(t(spark, sf_dir, "customer").select(k, F.when(k % 3 == 0, 'a "quoted", cell').otherwise(F.col("c_mktsegment")).alias("text")))


@query("SELECT CAST(i AS VARCHAR) AS id, repeat('x', 20) || '_' || i AS field_0, repeat('x', 20) || '_' || i AS field_1 FROM (SELECT unnest(range(500)) AS i)")
def bench_records(spark, sf_dir):
    return scalars.bench_records(spark, 500, 2, 20)


# streams, run over what is there and read back


def _streamed(spark, stream: DataFrame, name: str) -> DataFrame:
    folder = constraints.new_folder(spark, name)
    streams.to_table(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"SELECT event_id, subscription_id FROM {_MATCHED}")
def route_stream(spark, sf_dir):
    events = streams.read_folder(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("entity"), F.concat(F.lit("users/"), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("topic"))
    return _streamed(spark, streams.routed(events, subscriptions(spark)).select("event_id", "subscription_id"), "route")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def watch_stream(spark, sf_dir):
    return _streamed(spark, listing.where(streams.read_folder(spark, sf_dir, "events"), predicates.parse_filters("event_type=purchase,value>50")).select("event_id", "user_id"), "watch")


@query("SELECT event_id, share_group, 'm' || (row_number() OVER (PARTITION BY share_group ORDER BY event_id) - 1) % 3 AS member FROM (SELECT event_id, event_type AS share_group FROM events)")
def rr_stream(spark, sf_dir):
    events = streams.read_folder(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("share_group"))
    dealt = streams.round_robin(events, {g: ["m2", "m0", "m1"] for g in ("view", "click", "purchase", "signup", "error")}, "share_group", "event_id", "event_id bigint, share_group string")
    return _streamed(spark, dealt, "rr")


@query("SELECT DISTINCT event_id FROM events")
def retry_dedupe_stream(spark, sf_dir):
    events = streams.read_folder(spark, sf_dir, "events").select("event_id", "ts")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return _streamed(spark, streams.deduplicated(twice, "event_id", "ts").select("event_id"), "dedupe")


# requests, parsers, validators and registries

_ALIAS_SQL = {"eq": "o_custkey = 10", "neq": "o_custkey <> 10", "lt": "o_custkey < 10", "lte": "o_custkey <= 10", "gt": "o_custkey > 10", "gte": "o_custkey >= 10", "in": "o_custkey IN (10, 11)", "like": "o_orderstatus = 'F'", "is_null": "o_orderstatus IS NULL", "is_not_null": "o_orderstatus IS NOT NULL"}
_ALIAS_NAMES = (("", "eq"), ("eq", "eq"), ("=", "eq"), ("neq", "neq"), ("ne", "neq"), ("<>", "neq"), ("!=", "neq"), ("lt", "lt"), ("<", "lt"), ("lte", "lte"), ("<=", "lte"), ("gt", "gt"), (">", "gt"), ("gte", "gte"), (">=", "gte"), ("in", "in"), ("like", "like"), ("glob", "like"), ("~", "like"), ("is_null", "is_null"), ("null", "is_null"), ("?", "is_null"), ("is_not_null", "is_not_null"), ("not_null", "is_not_null"), ("!?", "is_not_null"))


@query(f"""
WITH n AS (SELECT {", ".join(f"count(*) FILTER (WHERE {c}) AS n_{k}" for k, c in _ALIAS_SQL.items())} FROM orders),
a AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{o}')" for a, o in _ALIAS_NAMES)}) t(alias, op))
SELECT alias, CASE op {" ".join(f"WHEN '{k}' THEN n_{k}" for k in _ALIAS_SQL)} END AS n FROM a, n""")
def operator_aliases(spark, sf_dir):
    """What each spelling of an operator counts."""
    orders = t(spark, sf_dir, "orders")
    parts = []
    for alias, op in _ALIAS_NAMES:
        field, value = ("o_orderstatus", "F") if op in ("like", "is_null", "is_not_null") else ("o_custkey", [10, 11] if op == "in" else 10)
        parts.append(aggregate.count(orders, (Filter.of(field, alias, value),)).select(F.lit(alias).alias("alias"), "n"))
    return mutate.union_all(parts)


_LITERALS = ("12", "-3", "1.5", "1e3", "true", "false", "True", "text", "", "007", "null", "1.2.3")


@query(f"""SELECT x AS text, CASE WHEN TRY_CAST(x AS BIGINT) IS NOT NULL AND NOT contains(x, '.') AND NOT contains(x, 'e') THEN 'int' WHEN TRY_CAST(x AS DOUBLE) IS NOT NULL AND x <> '' THEN 'float' WHEN x IN ('true', 'false') THEN 'bool' ELSE 'str' END AS kind FROM (SELECT unnest([{", ".join(f"'{x}'" for x in _LITERALS)}]) AS x)""")
def literal_kinds(spark, sf_dir):
    return spark.createDataFrame([(x, type(predicates.literal(x)).__name__) for x in _LITERALS], "text string, kind string")


_PATTERNS_TO_CHECK = ("a", "a/b", "a/+/b", "+", "#", "a/#", "a/#/b", "a+/b", "a/b#", "", "+/+", "#/a", "/", "a//b")


@query(f"""SELECT x AS pattern, x <> '' AND len(list_filter(string_split(x, '/'), lambda l: l NOT IN ('+', '#') AND (contains(l, '+') OR contains(l, '#')))) = 0 AND len(list_filter(string_split(x, '/')[:-2], lambda l: l = '#')) = 0 AS valid
FROM (SELECT unnest([{", ".join(f"'{x}'" for x in _PATTERNS_TO_CHECK)}]) AS x)""")
def pattern_validity(spark, sf_dir):
    return spark.createDataFrame([(x, predicates.valid_pattern(x)) for x in _PATTERNS_TO_CHECK], "pattern string, valid boolean")


def engine(spark, sf_dir) -> Engine:
    """orders with owners and shares, and nation."""
    e = Engine(spark, owners={"orders": "owner"}, shares=shares(spark, sf_dir), derived={"lineitem": ("l_orderkey", "orders")})
    e.add_entity("orders", owned_orders(spark, sf_dir), "o_orderkey").add_entity("nation", t(spark, sf_dir, "nation"), "n_nationkey")
    return e.add_entity("lineitem", t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


_ERRORS = {
    "too_many_filters": "LimitExceeded", "too_many_sorts": "LimitExceeded", "negative_offset": "QuernelError", "unknown_operator": "QuernelError", "malformed_filter": "QuernelError", "malformed_filter_text": "QuernelError", "unknown_field": "SchemaViolation", "internal_entity": "Forbidden",
    "unknown_entity": "NotFound", "unknown_verb": "QuernelError", "bad_entity_name": "QuernelError", "absent_row": "NotFound", "denied_row": "Forbidden", "denied_update": "Forbidden", "denied_delete": "Forbidden", "needs_admin": "Forbidden", "null_into_typed": "SchemaViolation", "include_too_deep": "LimitExceeded", "bad_pattern": "QuernelError", "bad_setting": "QuernelError",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _ERRORS.items()) + ") t(request, error)")
def request_errors(spark, sf_dir):
    """Which error each wrong request meets."""
    e = engine(spark, sf_dir)
    e.add_schema(Schema("nation", {"n_name": scalars.field("string"), "n_regionkey": scalars.field("number")}))
    ask = lambda **r: e.execute({"entity": "orders"} | r)
    one = {"field": "o_custkey", "op": "=", "value": 1}
    first = e.tables["orders"][0].filter("owner != 'u2'").join(e.accessible("orders", "u2").select("o_orderkey"), "o_orderkey", "left_anti").agg(F.min("o_orderkey")).first()[0]
    wrong = {
        "too_many_filters": lambda: ask(op="list", filters=[one] * 17),
        "too_many_sorts": lambda: ask(op="list", sort=[{"field": "o_custkey"}] * 5),
        "negative_offset": lambda: ask(op="list", offset=-1),
        "unknown_operator": lambda: ask(op="list", filters=[one | {"op": "between"}]),
        "malformed_filter": lambda: ask(op="list", filters=[{"value": 1}]),
        "malformed_filter_text": lambda: predicates.parse_filters("=5"),
        "unknown_field": lambda: e.list(ListRequest("nation").where("n_nothing", "=", 1)),
        "internal_entity": lambda: ask(op="list", entity="_shares"),
        "unknown_entity": lambda: ask(op="list", entity="nope"),
        "unknown_verb": lambda: ask(op="dance"),
        "bad_entity_name": lambda: e.add_entity("a/b", e.tables["nation"][0]),
        "absent_row": lambda: ask(op="read", id=-1),
        "denied_row": lambda: ask(op="read", id=first, sender="u2"),
        "denied_update": lambda: ask(op="update", rows=[(first, 1, "u2")], sender="u2"),
        "denied_delete": lambda: ask(op="delete", id=first, sender="u2"),
        "needs_admin": lambda: ask(op="index_add", fields=["o_custkey"], sender="u2"),
        "null_into_typed": lambda: e.add_constraint(ForeignKey("nation", "n_regionkey", "orders", "o_orderkey", OnDelete.SET_NULL)),
        "include_too_deep": lambda: e.list(ListRequest("nation").include("a.b.c.d")),
        "bad_pattern": lambda: e.subscribe("s", "a/#/b"),
        "bad_setting": lambda: parse_pairs("orders"),
    }

    def met(request) -> str:
        try:
            request()
        except QuernelError as error:
            return type(error).__name__
        return "none"

    return spark.createDataFrame([(k, met(f)) for k, f in wrong.items()], "request string, error string")


@query("SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders WHERE o_custkey % 7 = 2 AND o_custkey > 20 ORDER BY o_custkey DESC, o_orderkey LIMIT 25 OFFSET 5)")
def request_page(spark, sf_dir):
    """A list request in its JSON form, held to its sender's own rows."""
    request = {"op": "list", "entity": "orders", "sender": "u2", "filters": [{"field": "o_custkey", "op": ">", "value": 20}], "sort": [{"field": "o_custkey", "direction": "desc"}], "pagination": {"limit": 25, "offset": 5}, "projection": ["o_orderkey", "o_custkey"]}
    return engine(spark, sf_dir).execute(request).select("o_orderkey", "o_custkey")


_CAN = f"SELECT CAST(resource_id AS BIGINT) FROM {_SHARES} WHERE grantee = 'u2'"


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey % 7 <> 2 AND o_orderkey NOT IN ({_CAN})")
def read_denied(spark, sf_dir):
    """The rows that a sender may not view."""
    e = engine(spark, sf_dir)
    return e.tables["orders"][0].join(e.accessible("orders", "u2"), "o_orderkey", "left_anti").select("o_orderkey")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 7 <> 2 AND o_orderkey NOT IN ({_CAN} AND permission = 'edit')")
def update_denied(spark, sf_dir):
    """The children that a sender may not change, by their parents."""
    e = engine(spark, sf_dir)
    return e.tables["lineitem"][0].join(e.accessible("lineitem", "u2", "edit").select("l_orderkey").distinct(), "l_orderkey", "left_anti")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS BIGINT) AS place FROM orders WHERE o_custkey < 300 ORDER BY 2 LIMIT 120")
def agent_cursor(spark, sf_dir):
    """The first rows of a cursor in an order of its own."""
    e = Engine(spark).add_entity("orders", t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    rows = itertools.islice(e.cursor(ListRequest("orders").where("o_custkey", "<", 300).order("o_custkey", True)), 120)
    return spark.createDataFrame([(r.o_orderkey, i) for i, r in enumerate(rows, 1)], "o_orderkey bigint, place bigint")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS place FROM orders WHERE o_custkey < 300 ORDER BY 2 LIMIT 90")
def paged_cursor(spark, sf_dir):
    """Three batches of a cursor that pages by keys."""
    e = Engine(spark).add_entity("orders", t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    pages = e.pages(ListRequest("orders", batch_size=40).where("o_custkey", "<", 300))
    rows = [r for _ in range(3) for r in pages.next_batch(30)]
    return spark.createDataFrame([(r.o_orderkey, i) for i, r in enumerate(rows, 1)], "o_orderkey bigint, place bigint")


@query("SELECT * FROM (VALUES ('s1', 'orders/#', 'broadcast'), ('s3', 'users/+', 'ordered')) t(subscription_id, pattern, mode)")
def subscription_registry(spark, sf_dir):
    e = Engine(spark).subscribe("s1", "orders/#").subscribe("s2", "users/#", share_group="g", mode="ordered").subscribe("s3", "users/+", share_group="g", mode="ordered").unsubscribe("s2")
    return e.subscriptions.select("subscription_id", "pattern", "mode")


@query("SELECT * FROM (VALUES ('owner', 'orders', 'userId', NULL), ('owner', 'tasks', 'by', NULL), ('derived', 'lineitem', 'l_orderkey', 'orders')) t(setting, entity, field, parent)")
def settings(spark, sf_dir):
    rows = [("owner", k, v, None) for k, v in parse_pairs("orders=userId, tasks=by,").items()] + [("derived", k, *v) for k, v in parse_derived("lineitem=l_orderkey>orders").items()]
    return spark.createDataFrame(rows, "setting string, entity string, field string, parent string")


@query("SELECT entity, field FROM (VALUES ('nation', 'n_name'), ('nation', 'n_regionkey'), ('region', 'r_name')) t(entity, field)")
def index_fields(spark, sf_dir):
    """Indexes that are added one after the other are united."""
    e = Engine(spark).add_entity("nation", t(spark, sf_dir, "nation"), "n_nationkey").add_entity("region", t(spark, sf_dir, "region"), "r_regionkey")
    e.add_index("nation", "n_name").add_index("nation", "n_regionkey", "n_name").add_index("region", "r_name")
    return spark.createDataFrame([(k, f) for k, fields in e.indexes.items() for f in fields], "entity string, field string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ' \"é\"' AS data FROM customer")
def document_source(spark, sf_dir):
    """Documents written and read through the Python data source."""
    spark.dataSource.register(stores.DocumentSource)
    path = constraints.new_folder(spark, "documents")
    t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat("c_name", F.lit(' "é"')).alias("data")).write.format("quernel").mode("append").save(path)
    return spark.read.format("quernel").load(path)


@query("SELECT event_id, event_type FROM events")
def event_sink(spark, sf_dir):
    """A stream of events handed to a sink a batch at a time."""
    folder = constraints.new_folder(spark, "sink")
    deliver = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")  # noqa: E731  a batch that comes again replaces itself
    streams.to_outbox(streams.read_folder(spark, sf_dir, "events").select("event_id", "event_type"), deliver, f"{folder}/dead", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("event_id", "event_type")


@query("""SELECT entity, count(*) AS record_count, any_value(owner) AS owner, any_value(parent) AS derived_from FROM (SELECT 'orders' AS entity, 'owner' AS owner, NULL::VARCHAR AS parent FROM orders UNION ALL SELECT 'nation', NULL, NULL FROM nation UNION ALL SELECT 'lineitem', NULL, 'orders' FROM lineitem) GROUP BY 1""")
def catalog_metadata(spark, sf_dir):
    return engine(spark, sf_dir).describe().select("entity", "record_count", "owner", "derived_from")


@query("SELECT 'sealed' AS store, c_custkey, c_name, c_nationkey, c_acctbal, true AS hidden FROM customer UNION ALL SELECT 'parquet', c_custkey, c_name, c_nationkey, c_acctbal, false FROM customer UNION ALL SELECT 'memory', c_custkey, c_name, c_nationkey, c_acctbal, false FROM customer")
def backend_roundtrip(spark, sf_dir):
    """A table through each backend, and whether its names are hidden where it is stored."""
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    plain = backends.ParquetBackend(spark, constraints.new_folder(spark, "store"))
    inner = backends.ParquetBackend(spark, constraints.new_folder(spark, "sealed"))
    out = []
    for name, store, at in (("sealed", backends.SealedBackend(inner, F.lit("0123456789abcdef").cast("binary")), inner), ("parquet", plain, plain), ("memory", m := backends.MemoryBackend(), m)):
        store.write("customer", rows, "c_custkey")
        stored = at.read("customer").select("c_custkey", (~F.col("c_name").startswith("Customer#")).alias("hidden"))
        out.append(store.read("customer").join(stored, "c_custkey").select(F.lit(name).alias("store"), "c_custkey", "c_name", "c_nationkey", "c_acctbal", "hidden"))
    return mutate.union_all(out)
