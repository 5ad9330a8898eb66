"""The registered queries of the engine, and the DuckDB SQL that each must equal."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.engine import CancellationToken, Engine, system_probe
from tessella import errors
from tessella.functions import bloom, generated_id
from tessella.functions.routing import shard_column, shard_of
from tessella.operators.authority import Authority
from tessella.operators.results import Budget
from tessella.plans.parser import parse, parse_one
from tessella.functions.index_key import decode, key_column, part_for, value_column
from tessella.operators.global_index import Index, IndexPart
from tessella.operators.summary import numbered
from tessella.sources.catalog import Column, Table, global_, replace, sharded
from tessella.sources.files import Files
from tessella.sources.importer import ImportPlan, import_sqlite
from tessella.streaming.outbox import Outbox

SHARDS = 4
TABLES = [
    sharded("orders", "o_custkey", "int64"), sharded("lineitem", "l_orderkey", "int64"), sharded("customer", "c_custkey", "int64"), sharded("events", "user_id", "int64"),
    sharded("documents", "source", "text"), sharded("conversations", "conv_id", "int64"), *map(global_, ("region", "nation", "supplier", "part", "labels", "benchmark", "pages")),
]


def attached(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine over the tables where they lie, the named ones or all; nothing is copied."""
    engine = Engine(spark, shards=SHARDS)
    for t in TABLES:
        if not names or t.name in names:
            engine.attach(t, f"{sf_dir}/{t.name}.parquet")
    return engine


_managed: dict[tuple, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder that driver and executors share; the warehouse's default is one only where both are one process."""
    if root := spark.conf.get("spark.checkpoint.dir", ""):
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[") or "spark.sql.warehouse.dir" in dict(spark.sparkContext.getConf().getAll())):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


def managed(spark: SparkSession, sf_dir: str, name: str, key: str, primary: tuple[str, ...], label: str, indexes: tuple[Index, ...] = ()) -> Engine:
    """An engine with its own sharded copy of one table, made once per application, source and label."""
    at = (spark.sparkContext.applicationId, sf_dir, name, label)
    if at not in _managed or not Files(spark).exists(_managed[at]):
        root = f"{shared_root(spark)}/tessella-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:8]}"
        engine = Engine(spark, root, SHARDS)
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        columns = tuple(Column(f.name, f.dataType.simpleString()) for f in rows.schema.fields)
        engine.register_tables([Table(name, "sharded", key, "text" if dict(rows.dtypes)[key] == "string" else "int64", columns=columns, primary=primary)])
        engine.load(name, rows)
        for i in indexes:
            engine.indexes.create(i)
        _managed[at] = root
    return Engine(spark, _managed[at], SHARDS)


ORDER_INDEXES = (
    Index("orders_by_key", "orders", (IndexPart("o_orderkey"),)),
    Index("orders_by_status", "orders", (IndexPart("o_orderstatus"), IndexPart("o_orderpriority"))),
)
EVENT_INDEXES = (Index("events_by_type", "events", (IndexPart("event_type"),)), Index("events_by_ts", "events", (IndexPart("ts"),)), Index("events_by_id", "events", (IndexPart("event_id", True),)))


def orders(spark: SparkSession, sf_dir: str, label: str = "orders") -> Engine:
    return managed(spark, sf_dir, "orders", "o_custkey", ("o_custkey", "o_orderkey"), label, ORDER_INDEXES if label == "orders" else ())


def events(spark: SparkSession, sf_dir: str, label: str = "events") -> Engine:
    return managed(spark, sf_dir, "events", "user_id", ("user_id", "event_id"), label, EVENT_INDEXES if label == "events" else ())


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def statement(name: str, sql: str, oracle: str | None = None, params: list = (), dialect: str = "sqlite") -> None:
    """Registers a read of the accepted subset; the oracle is the same text where DuckDB means the same."""
    table = parse_one(sql, dialect)[0].table
    names = [table.name.folded()] if table else ["region"]
    QUERIES[name] = lambda spark, sf_dir: attached(spark, sf_dir, *names).query(sql, list(params), dialect).frame
    ORACLE_SQL[name] = oracle or sql


def built(name: str, oracle: str | None):
    """Registers a query made by a function."""

    def take(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return take


@built("point_read_orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ?1", [7]).frame


@built("routed_multi_key_or", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 11)")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = $1 OR o_custkey = $2 OR o_custkey = $1", [7, 11], "postgres").frame


@built("text_key_route", "SELECT doc_id, lang FROM documents WHERE source = 'src0'")
def _(spark, sf_dir):
    return managed(spark, sf_dir, "documents", "source", (), "documents").query("SELECT doc_id, lang FROM documents WHERE source = ?", ["src0"]).frame


statement("contradiction_empty", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_custkey = 11")
statement("null_key_empty", "SELECT o_orderkey FROM orders WHERE o_custkey = NULL")
statement("scatter_union_all", "SELECT event_id, user_id, event_type FROM events WHERE value > 1.5")
statement("global_read_nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
statement("table_free_select", "SELECT 1 + 1 AS two, 'a' AS a, 2.5 AS x", "SELECT CAST(2 AS BIGINT) AS two, 'a' AS a, CAST(2.5 AS DOUBLE) AS x")
statement("star_projection", "SELECT * FROM customer WHERE c_acctbal > 9000")
statement("qualified_star", "SELECT c.* FROM customer AS c WHERE c.c_nationkey = 3")
statement("filter_arith", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + l_linenumber - 1 AS v FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
statement("unary_signs", "SELECT o_orderkey, -o_custkey AS neg, +o_custkey AS pos FROM orders WHERE NOT o_custkey > 20")
statement("int_division_null_on_zero", "SELECT o_orderkey, o_orderkey / o_custkey AS q, o_orderkey / (o_custkey - o_custkey) AS z FROM orders", "SELECT o_orderkey, CASE WHEN o_custkey <> 0 THEN o_orderkey // o_custkey END AS q, CAST(NULL AS BIGINT) AS z FROM orders")
statement("float_division", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_quantity / (l_tax - l_tax) AS z FROM lineitem WHERE l_quantity > 45", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, CAST(NULL AS DOUBLE) AS z FROM lineitem WHERE l_quantity > 45")
statement("modulo", "SELECT o_orderkey, o_orderkey % 7 AS m, -o_orderkey % 7 AS n, o_orderkey % 0 AS z FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, (-o_orderkey) % 7 AS n, CAST(NULL AS BIGINT) AS z FROM orders")
statement("comparisons", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 300000 AND o_orderstatus <> 'F' AND o_custkey < 900 AND o_orderkey > 10 AND o_orderpriority = '1-URGENT'")
statement("and_or_three_valued", "SELECT o_orderkey, (CASE WHEN o_custkey > 50 THEN 1 END = 1) OR o_orderstatus = 'O' AS v, (CASE WHEN o_custkey > 50 THEN 1 END = 1) AND o_orderstatus = 'O' AS w FROM orders")
statement("is_null", "SELECT o_orderkey, CASE WHEN o_custkey > 50 THEN o_custkey END IS NULL AS n, CASE WHEN o_custkey > 50 THEN o_custkey END IS NOT NULL AS s FROM orders")
statement("is_true_false", "SELECT o_orderkey, (o_custkey - 5) IS TRUE AS t, (o_custkey > 50) IS NOT TRUE AS u, (CASE WHEN o_custkey > 50 THEN 0 END) IS FALSE AS f FROM orders", "SELECT o_orderkey, (o_custkey <> 5) IS TRUE AS t, (o_custkey > 50) IS NOT TRUE AS u, (CASE WHEN o_custkey > 50 THEN FALSE END) IS FALSE AS f FROM orders")
statement("between_not_between", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 40 AND o_totalprice NOT BETWEEN 50000 AND 100000")
statement("in_not_in_null", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, NULL) OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F')")
statement("not_in_with_null", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, NULL)")
statement("like_ci", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment LIKE 'b%' OR c_name LIKE '%#00000001_'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE 'b%' OR c_name ILIKE '%#00000001_'")
statement("not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%brass'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%brass'")
statement("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS c FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS c FROM orders")
statement("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS c FROM orders")
statement("true_equals_one", "SELECT n_nationkey FROM nation WHERE (n_nationkey > 3) = 1", "SELECT n_nationkey FROM nation WHERE (n_nationkey > 3)")
statement("distinct_flags", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
statement("select_all", "SELECT ALL l_returnflag FROM lineitem WHERE l_linenumber = 7")
statement("count_star", "SELECT COUNT(*) AS n FROM lineitem")
statement("count_column", "SELECT COUNT(CASE WHEN l_linenumber > 3 THEN 1 END) AS n, COUNT(ALL l_tax) AS a FROM lineitem")
statement("count_distinct", "SELECT COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_returnflag) AS f FROM lineitem")
statement("sum_avg_min_max", "SELECT SUM(o_custkey) AS s, AVG(o_custkey) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, MIN(o_orderpriority) AS p, MAX(o_orderdate) AS d FROM orders", "SELECT CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_custkey) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, MIN(o_orderpriority) AS p, MAX(o_orderdate) AS d FROM orders")
statement("sum_distinct", "SELECT SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a FROM lineitem", "SELECT CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, AVG(DISTINCT l_linenumber) AS a FROM lineitem")
statement("sum_of_empty", "SELECT SUM(o_custkey) AS s, COUNT(o_custkey) AS n, MIN(o_custkey) AS m FROM orders WHERE o_custkey < 0", "SELECT CAST(SUM(o_custkey) AS BIGINT) AS s, COUNT(o_custkey) AS n, MIN(o_custkey) AS m FROM orders WHERE o_custkey < 0")
statement("group_by_expr", "SELECT l_linenumber % 3 AS k, COUNT(*) AS n, MIN(l_suppkey) AS s FROM lineitem GROUP BY l_linenumber % 3")
statement("group_by_columns", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS s, MAX(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MAX(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus")
statement("having_agg", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND MAX(o_totalprice) > 1000")
statement("having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING n >= 12", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) >= 12")
statement("having_without_group", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1")
statement("bare_column_with_max", "SELECT o_orderpriority, o_orderkey, MAX(o_orderkey) AS m FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, MAX(o_orderkey) AS o_orderkey, MAX(o_orderkey) AS m FROM orders GROUP BY o_orderpriority")
statement("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT ? OFFSET ?", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", [20, 5], "mysql")
statement("limit_comma", "SELECT o_orderkey, o_custkey FROM orders ORDER BY 2, 1 DESC LIMIT 5, 20", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey DESC LIMIT 20 OFFSET 5")
statement("order_nulls_first", "SELECT o_orderkey, CASE WHEN o_custkey > 50 THEN o_custkey END AS k FROM orders ORDER BY k, o_orderkey LIMIT 50", "SELECT o_orderkey, CASE WHEN o_custkey > 50 THEN o_custkey END AS k FROM orders ORDER BY k NULLS FIRST, o_orderkey LIMIT 50")
statement("order_by_aggregate", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 15")
statement("quoted_names", "SELECT `o_orderkey` AS `Key`, o_custkey FROM `orders` WHERE `orders`.`o_custkey` = 7", 'SELECT o_orderkey AS "Key", o_custkey FROM orders WHERE o_custkey = 7', dialect="mysql")

@built("index_narrowed_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 33 ORDER BY o_totalprice LIMIT 5")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 33 ORDER BY o_totalprice LIMIT 5").frame


@built("global_index_eq", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 100")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = ?", [100]).frame


@built("global_index_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 5, 7, 64, 100, NULL)")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 5, 7, 64, 100, NULL)").frame


@built("index_lookup_rows", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey IN (3, 4, 5)")
def _(spark, sf_dir):
    return orders(spark, sf_dir).indexes.lookup("orders_by_key", [(3,), (4,), (5,)]).select("o_orderkey", "o_custkey", "o_orderpriority")


@built("compound_index_lookup", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'").frame


@built("bloom_prune_miss", "SELECT event_id, user_id FROM events WHERE event_type = 'no such type'")
def _(spark, sf_dir):
    return events(spark, sf_dir).query("SELECT event_id, user_id FROM events WHERE event_type = 'no such type'").frame


@built("minmax_prune_range", "SELECT event_id, user_id, event_type FROM events WHERE event_id BETWEEN 10 AND 60 OR event_id < 5")
def _(spark, sf_dir):
    return events(spark, sf_dir).query("SELECT event_id, user_id, event_type FROM events WHERE event_id BETWEEN 10 AND 60 OR event_id < 5").frame


@built("candidate_verification", "SELECT o_orderkey, 'verified' AS outcome FROM orders WHERE o_orderkey IN (1, 2, 3, 4, 5, 6, 7)")
def _(spark, sf_dir):
    engine = orders(spark, sf_dir)
    return engine.indexes.verify("orders_by_key", [(k,) for k in range(1, 8)]).select(value_column(F.col("key"), 0, "int64").alias("o_orderkey"), "outcome")


@built("index_validation_report", "SELECT 'stale_entry' AS issue, CAST(0 AS BIGINT) AS n WHERE 1 = 0")
def _(spark, sf_dir):
    return orders(spark, sf_dir).indexes.validate("orders_by_key").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@built("admin_count", "SELECT CAST(count(*) AS BIGINT) AS rows FROM orders")
def _(spark, sf_dir):
    return orders(spark, sf_dir).shard_counts("orders").agg(F.sum("rows").alias("rows"))


# fixed values: the kind of a key, the key, the shards of a database, and the shard that has the key there
ROUTES = [("text", "abc", 4, 0), ("text", "customer-42", 6, 1), ("text", "tenant/alpha", 10, 3), ("binary", "000102", 6, 3), ("binary", "000102", 10, 9), ("binary", "000102FF", 63, 23), ("binary", "610062", 6, 1)]


@built("key_routes", f"SELECT * FROM (VALUES {', '.join(map(str, ROUTES))}) t(kind, key, shards, shard)")
def _(spark, sf_dir):
    """The shard of some keys, by the routing column."""
    out = None
    for kind, text, shards, _ in ROUTES:
        value = F.lit(text) if kind == "text" else F.unhex(F.lit(text))
        row = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(text).alias("key"), F.lit(shards).alias("shards"), shard_column(value, kind, shards).alias("shard"))
        out = row if out is None else out.unionByName(row)
    return out


@built("shard_histogram", None)
def _(spark, sf_dir):
    return attached(spark, sf_dir, "orders").shard_counts("orders")


@built("explicit_shard_union", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf_dir):
    engine = orders(spark, sf_dir)
    parts = [engine.inspect(k, "SELECT o_orderkey, o_custkey FROM orders").frame for k in range(SHARDS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@built("admin_page", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 11 OFFSET 5")
def _(spark, sf_dir):
    """A page over one shard's worth of rows; ``sharded_page`` crosses shards."""
    engine = attached(spark, sf_dir)
    engine.attached["nation"] = replace(engine.attached["nation"], primary=("n_nationkey",))
    return engine.page("nation", 5, 10).select("n_nationkey", "n_name")


@built("sharded_page", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey FROM orders LIMIT 600)")
def _(spark, sf_dir):
    """Pages of 200 rows each, one after the other: no row is missing between two, and none stands in both."""
    engine, out = orders(spark, sf_dir), None
    for offset in range(0, 600, 200):
        part = engine.page("orders", offset, 200).select("o_orderkey").limit(200)
        out = part if out is None else out.unionByName(part)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"))


@built("insert_roundtrip", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_custkey = 7 UNION ALL SELECT 900000001, 7, 12.5, NULL UNION ALL SELECT 900000002, 7, 13.0, '5-LOW'")
def _(spark, sf_dir):
    engine = fresh(spark, sf_dir)
    engine.execute("INSERT INTO orders(o_orderkey, o_custkey, o_totalprice, o_orderpriority) VALUES (900000001, ?1, 12.5, NULL), (900000002, ?1, 13, '5-LOW')", [7])
    return engine.query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_custkey = 7").frame


@built("update_cow", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 7 AND o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey < 20")
def _(spark, sf_dir):
    engine = fresh(spark, sf_dir)
    engine.execute("UPDATE orders SET o_totalprice = o_totalprice * 2 WHERE o_custkey = 7 AND o_orderstatus = 'F'")
    return engine.query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey < 20").frame


@built("delete_cow", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_custkey = 7 AND o_totalprice > 100000)")
def _(spark, sf_dir):
    engine = fresh(spark, sf_dir)
    engine.execute("DELETE FROM orders WHERE o_custkey = 7 AND o_totalprice > 100000")
    return engine.query("SELECT o_orderkey, o_custkey FROM orders").frame


@built("transaction_commit", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey = 11")
def _(spark, sf_dir):
    engine = fresh(spark, sf_dir)
    with engine.session() as s:
        s.execute("BEGIN")
        s.execute("DELETE FROM orders WHERE o_custkey = 11")
        s.execute("ROLLBACK")
        s.execute("BEGIN")
        s.execute("UPDATE orders SET o_totalprice = 1 WHERE o_custkey = 11")
        s.execute("COMMIT")
    return engine.query("SELECT COUNT(*) AS n FROM orders WHERE o_custkey = 11 AND o_totalprice = 1").frame


@built("outbox_replay_state", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE NOT o_custkey = 7 UNION ALL SELECT 900000003")
def _(spark, sf_dir):
    """Keys of an index that only the change log keeps up to date."""
    engine = fresh(spark, sf_dir)
    engine.indexes.create(Index("late", "orders", (IndexPart("o_orderkey"),), mode="async"))
    engine.execute("INSERT INTO orders(o_orderkey, o_custkey) VALUES (900000003, 11)")
    engine.execute("DELETE FROM orders WHERE o_custkey = 7")
    Outbox(engine, "late").process()
    return engine.indexes.entries(engine.indexes.get("late")).select(value_column(F.col("key"), 0, "int64").alias("o_orderkey"))


def fresh(spark: SparkSession, sf_dir: str) -> Engine:
    """A copy of orders of its own, for a query that changes it."""
    return managed(spark, sf_dir, "orders", "o_custkey", (), f"changed-{uuid.uuid4().hex[:8]}")


@built("genid_native_decode", "SELECT o_orderkey, 'range' AS kind, CAST(o_custkey % 1024 AS INT) AS owner, o_orderkey + 1 AS sequence FROM orders")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.lit(generated_id.RANGE_MARK) + F.shiftleft(F.col("o_custkey") % 1024, 52) + F.col("o_orderkey") + 1
    kind, owner, sequence = generated_id.range_columns(F.col("v"))
    return rows.select("o_orderkey", value.alias("v")).select("o_orderkey", kind.alias("kind"), owner.alias("owner"), sequence.alias("sequence"))


@built("genid_hilo_decode", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'block' ELSE 'legacy' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS sequence FROM orders")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.when(F.col("o_orderkey") % 2 == 0, F.lit(generated_id.BLOCK_MARK) + F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    kind, sequence = generated_id.block_columns(F.col("v"))
    return rows.select("o_orderkey", value.alias("v")).select("o_orderkey", kind.alias("kind"), sequence.alias("sequence"))


@built("index_key_order", "SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey) AS place FROM orders")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = key_column([(F.col("o_orderstatus"), part_for("string", True)), (F.col("o_totalprice"), part_for("double")), (F.col("o_orderkey"), part_for("bigint"))])
    return numbered(rows.withColumn("k", key), "k", path=f"{shared_root(spark)}/tessella-{spark.sparkContext.applicationId}/order-{uuid.uuid4().hex[:8]}", first=1).select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("n").alias("place"))


@built("catalog_status", f"SELECT * FROM (VALUES {', '.join(f"('{t.name}', '{t.placement}', {SHARDS}, 0, 0, 'open')" for t in TABLES)}) t(table_name, placement, shards, version, folders, state)")
def _(spark, sf_dir):
    return attached(spark, sf_dir).status()


@built("strict_scatter_rows", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    engine = orders(spark, sf_dir)
    engine.strict_scatter = True
    return engine.query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F'").frame


@built("prepared_portal", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 13 AND o_totalprice > 1000")
def _(spark, sf_dir):
    with orders(spark, sf_dir).session() as s:
        handle = s.prepare("p", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 AND o_totalprice > $2", "postgres")
        rows = s.execute_portal(s.bind("b", handle, [13, 1000])).rows
    return spark.createDataFrame(rows, "o_orderkey long, o_totalprice double")


@built("routing_key_read", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 5")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 5", routing_key=7).frame


@built("insert_or_replace", "SELECT CAST(count(*) AS BIGINT) AS n, max(CASE WHEN o_orderkey = 900000009 THEN o_totalprice END) AS v FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 UNION ALL SELECT 900000009, 2.0)")
def _(spark, sf_dir):
    engine = keyed(spark, sf_dir)
    for verb, price in (("INSERT", 1), ("INSERT OR REPLACE", 2), ("INSERT OR IGNORE", 3)):
        engine.execute(f"{verb} INTO orders(o_orderkey, o_custkey, o_totalprice) VALUES (900000009, 7, ?)", [price])
    return engine.query("SELECT COUNT(*) AS n, MAX(CASE WHEN o_orderkey = 900000009 THEN o_totalprice END) AS v FROM orders WHERE o_custkey = 7").frame


def keyed(spark: SparkSession, sf_dir: str) -> Engine:
    return managed(spark, sf_dir, "orders", "o_custkey", ("o_custkey", "o_orderkey"), f"keyed-{uuid.uuid4().hex[:8]}")


@built("generated_ids_insert", "SELECT CAST(x AS BIGINT) AS sequence, 'block' AS kind FROM range(1, 4) t(x)")
def _(spark, sf_dir):
    root = f"{shared_root(spark)}/tessella-{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex[:8]}"
    engine = Engine(spark, root, SHARDS)
    engine.register_tables([sharded("made", "id", "int64", generated="block", generated_column="id")])
    engine.migrate("CREATE TABLE made(id BIGINT PRIMARY KEY AUTO_INCREMENT, v TEXT)", "mysql")
    for v in "abc":
        engine.execute("INSERT INTO made(v) VALUES (?)", [v])
    kind, sequence = generated_id.block_columns(F.col("id"))
    return engine.query("SELECT id FROM made").frame.select(sequence.alias("sequence"), kind.alias("kind"))


@built("partial_index_entries", "SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' AND value > 2")
def _(spark, sf_dir):
    engine = events(spark, sf_dir, f"partial-{uuid.uuid4().hex[:8]}")
    s = engine.indexes.create(Index("clicks", "events", (IndexPart("user_id"), IndexPart("value", True)), predicate="event_type = 'click' AND value > 2", partitions=4))
    return engine.indexes.entries(s).agg(F.count(F.lit(1)).alias("n"))


@built("unique_index_route", "SELECT event_id, user_id FROM events WHERE event_id = 42")
def _(spark, sf_dir):
    engine = events(spark, sf_dir, f"unique-{uuid.uuid4().hex[:8]}")
    engine.indexes.create(Index("one", "events", (IndexPart("event_id"),), unique=True))
    return engine.query("SELECT event_id, user_id FROM events WHERE event_id = 42").frame


@built("summary_figures", "SELECT 'events_by_type' AS index_name, CAST(count(*) AS BIGINT) AS entries, min(event_type) AS least, max(event_type) AS greatest FROM events")
def _(spark, sf_dir):
    engine = events(spark, sf_dir)
    found = engine.indexes.summaries(engine.indexes.get("events_by_type")).values()
    text = lambda k: decode(k)[0][1]
    row = ("events_by_type", sum(s.keys for s in found), min(text(s.least) for s in found), max(text(s.greatest) for s in found))
    return spark.createDataFrame([row], "index_name string, entries long, least string, greatest string")


@built("stale_index_fallback", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 1)")
def _(spark, sf_dir):
    """An asynchronous index that lags still hides no row: the changed shard is read as well."""
    engine = keyed(spark, sf_dir)
    engine.indexes.create(Index("late", "orders", (IndexPart("o_orderkey"),), mode="async"))
    engine.execute("INSERT INTO orders(o_orderkey, o_custkey) VALUES (1, 900000011)")
    return engine.query("SELECT COUNT(*) AS n FROM orders WHERE o_orderkey = 1").frame


@built("sqlite_import", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    with tempfile.TemporaryDirectory() as folder:  # the source file is the driver's alone
        db = sqlite3.connect(f"{folder}/source.db")
        db.execute("CREATE TABLE nation(n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", (tuple(r) for r in rows.toLocalIterator()))
        db.commit()
        db.close()
        root = f"{shared_root(spark)}/tessella-{spark.sparkContext.applicationId}/import-{uuid.uuid4().hex[:8]}"
        import_sqlite(spark, f"{folder}/source.db", root, ImportPlan([sharded("nation", "n_nationkey", "int64")]), SHARDS)
    return Engine(spark, root, SHARDS).query("SELECT n_nationkey, n_name, n_regionkey FROM nation").frame.selectExpr("CAST(n_nationkey AS INT) AS n_nationkey", "n_name", "CAST(n_regionkey AS INT) AS n_regionkey")


@built("compaction_keeps_rows", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM (SELECT o_orderkey FROM orders UNION ALL SELECT 900000021 UNION ALL SELECT 900000022)")
def _(spark, sf_dir):
    engine = keyed(spark, sf_dir)
    for k in (900000021, 900000022):
        engine.execute("INSERT INTO orders(o_orderkey, o_custkey) VALUES (?, 7)", [k])
    engine.compact("orders")
    return engine.query("SELECT COUNT(*) AS n, SUM(o_orderkey) AS s FROM orders").frame


PROBES = [
    ("SHOW server_version_num", "server_version_num", "140000"), ("SHOW server_encoding", "server_encoding", "UTF8"), ("show client_encoding;", "client_encoding", "UTF8"), ("SHOW standard_conforming_strings", "standard_conforming_strings", "on"),
    ("SHOW integer_datetimes", "integer_datetimes", "on"), ("SHOW timezone", "TimeZone", "UTC"), ("SHOW TRANSACTION ISOLATION LEVEL", "transaction_isolation", "serializable"), ("SHOW transaction_read_only", "transaction_read_only", "off"),
    ("SHOW search_path", "search_path", "public"), ("SHOW DateStyle", "DateStyle", "ISO, MDY"), ("SHOW IntervalStyle", "IntervalStyle", "postgres"), ("SHOW extra_float_digits", "extra_float_digits", "1"), ("SHOW default_transaction_isolation", "default_transaction_isolation", "serializable"),
    ("SHOW default_transaction_read_only", "default_transaction_read_only", "off"), ("SHOW session_authorization", "session_authorization", "tessella"), ("SELECT current_database()", "current_database", "default"), ("SELECT pg_catalog.current_schema()", "current_schema", "public"),
    ("SELECT current_user", "current_user", "tessella"), ("SELECT session_user", "session_user", "tessella"), ("SELECT current_setting('TimeZone')", "current_setting", "UTC"), ("SELECT current_setting('server_version_num')", "current_setting", "140000"),
    ("SELECT pg_sleep(1)", "refused", "Unsupported"), ("SELECT version", "refused", "Unsupported"),
]


def quoted(*values: str) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


@built("server_probes", f"SELECT * FROM (VALUES {', '.join(quoted(*x) for x in PROBES)}) t(probe, name, value)")
def _(spark, sf_dir):
    def told(sql: str) -> tuple[str, str]:
        try:
            got = system_probe(spark, sql)
            return got.columns[0], got.first()[0]
        except errors.EngineError as e:
            return "refused", type(e).__name__

    return spark.createDataFrame([(sql, *told(sql)) for sql, *_ in PROBES], "probe string, name string, value string")


def outcomes(name: str, expected: list[tuple[str, str]]):
    """Registers a query of steps and what came of each; a step gives a value or raises an error of the engine."""

    def take(f: Callable[[SparkSession, str], dict[str, Callable[[], object]]]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = []
            for step, act in f(spark, sf_dir).items():
                try:
                    rows.append((step, str(act())))
                except errors.EngineError as e:
                    rows.append((step, type(e).__name__))
            return spark.createDataFrame(rows, "step string, outcome string")

        QUERIES[name] = run
        ORACLE_SQL[name] = f"SELECT * FROM (VALUES {', '.join(quoted(*x) for x in expected)}) t(step, outcome)"

    return take


def made(spark: SparkSession, *migrations: str, tables: tuple[Table, ...]) -> Engine:
    """An engine with small tables of its own."""
    engine = Engine(spark, f"{shared_root(spark)}/tessella-{spark.sparkContext.applicationId}/made-{uuid.uuid4().hex[:8]}", SHARDS)
    engine.register_tables(list(tables))
    for m in migrations:
        engine.migrate(m)
    return engine


SEATS = "CREATE TABLE seats(show INTEGER NOT NULL, seat INTEGER NOT NULL, code TEXT, price REAL CHECK (price >= 0), PRIMARY KEY (show, seat))"


def seats(spark: SparkSession) -> Engine:
    engine = made(spark, SEATS, tables=(sharded("seats", "show", "int64"),))
    engine.load("seats", spark.createDataFrame([(k, 1, f"c{k}", 1.0) for k in range(1, 9)], "show long, seat long, code string, price double"))
    return engine


INSERT = "INSERT INTO seats(show, seat, code, price) VALUES (?1, ?2, ?3, ?4)"


@outcomes("unique_write_refused", [("second of another shard", "UniqueViolation"), ("or ignore", "0"), ("rows", "8"), ("index", "ready"), ("null", "1"), ("second null", "1"), ("update to a taken key", "UniqueViolation"), ("delete, then insert", "1"), ("bulk load", "UniqueViolation"), ("transaction", "UniqueViolation"), ("rows at the end", "10"), ("stale entries", "0")])
def _(spark, sf_dir):
    engine = seats(spark)
    engine.indexes.create(Index("codes", "seats", (IndexPart("code"),), unique=True))
    rows = lambda: engine.count("seats")

    def transaction():
        with engine.session() as session:
            session.execute("BEGIN")
            session.execute(INSERT, [1, 7, "c4", 1.0])
            session.execute("COMMIT")

    return {
        "second of another shard": lambda: engine.execute(INSERT, [900, 1, "c3", 1.0]),
        "or ignore": lambda: engine.execute(INSERT.replace("INSERT", "INSERT OR IGNORE"), [900, 1, "c3", 1.0]).rows_affected,
        "rows": rows,
        "index": lambda: engine.indexes.get("codes").state,
        "null": lambda: engine.execute(INSERT, [1, 2, None, 1.0]).rows_affected,
        "second null": lambda: engine.execute(INSERT, [2, 2, None, 1.0]).rows_affected,
        "update to a taken key": lambda: engine.execute("UPDATE seats SET code = 'c5' WHERE show = 6"),
        "delete, then insert": lambda: engine.execute("DELETE FROM seats WHERE show = 3").rows_affected * engine.execute(INSERT, [901, 1, "c3", 1.0]).rows_affected,
        "bulk load": lambda: engine.load("seats", spark.createDataFrame([(902, 1, "c7", 1.0)], "show long, seat long, code string, price double")),
        "transaction": transaction,
        "rows at the end": rows,
        "stale entries": lambda: engine.indexes.validate("codes").count(),
    }


@outcomes("reservation_states", [("reserve", "pending"), ("again", "pending"), ("by another", "UniqueViolation"), ("route", "[2]"), ("finalize", "finalized"), ("roll back after", "FailedPrecondition"), ("free again", "pending"), ("rolled back", "rolled_back"), ("other keys, same id", "InvalidArgument"), ("lease", "1-10"), ("next lease", "11-15"), ("same lease", "1-10"), ("consumed", "consumed"), ("abandon after", "FailedPrecondition"), ("too many", "InvalidArgument")])
def _(spark, sf_dir):
    engine = seats(spark)
    index = engine.indexes.create(Index("codes", "seats", (IndexPart("code"),), unique=True)).index
    authority, (key,) = Authority(engine, "codes"), engine.indexes.keys(index, [("new",)])
    op = lambda n: bytes(15) + bytes([n])
    lease = lambda x: f"{x.first}-{x.last}"
    return {
        "reserve": lambda: authority.reserve(op(1), key, 2),
        "again": lambda: authority.reserve(op(1), key, 2),
        "by another": lambda: authority.reserve(op(2), key, 1),
        "route": lambda: engine.plan("SELECT 1 FROM seats WHERE code = 'new'").shards,
        "finalize": lambda: authority.finalize(op(1)),
        "roll back after": lambda: authority.rollback(op(1)),
        "free again": lambda: authority.reserve(op(3), key, 1),
        "rolled back": lambda: authority.rollback(op(3)),
        "other keys, same id": lambda: authority.reserve(op(3), b"other", 1),
        "lease": lambda: lease(authority.lease(op(4), "s", 10)),
        "next lease": lambda: lease(authority.lease(op(5), "s", 5)),
        "same lease": lambda: lease(authority.lease(op(4), "s", 10)),
        "consumed": lambda: authority.transition(op(4), "consumed").state,
        "abandon after": lambda: authority.transition(op(4), "abandoned"),
        "too many": lambda: authority.lease(op(6), "s", 65_537),
    }


@outcomes("write_refusals", [("primary key", "UniqueViolation"), ("not null", "NotNullViolation"), ("check", "CheckViolation"), ("null key", "NotNullViolation"), ("two shards", "InvalidQuery"), ("no shard", "InvalidQuery"), ("moved key", "Unsupported"), ("other route", "InvalidQuery"), ("wrong type", "TypeMismatch"), ("or ignore", "0"), ("or replace", "1"), ("update", "1"), ("delete", "1"), ("rows", "7")])
def _(spark, sf_dir):
    engine, run = seats(spark), lambda sql, params=(), **more: lambda: engine.execute(sql, list(params), **more).rows_affected
    other = next(k for k in range(1, 99) if shard_of(k, SHARDS) != shard_of(1, SHARDS))
    return {
        "primary key": run(INSERT, (1, 1, "x", 1.0)),
        "not null": run("INSERT INTO seats(show, code) VALUES (1, 'x')"),
        "check": run(INSERT, (1, 2, "x", -1.0)),
        "null key": run(INSERT, (None, 2, "x", 1.0)),
        "two shards": run(f"INSERT INTO seats(show, seat) VALUES (1, 5), ({other}, 5)"),
        "no shard": run("UPDATE seats SET price = 2"),
        "moved key": run("UPDATE seats SET show = 2 WHERE show = 1"),
        "other route": run("DELETE FROM seats WHERE show = 1", routing_key=other),
        "wrong type": run("DELETE FROM seats WHERE show = 'one'"),
        "or ignore": run(INSERT.replace("INSERT", "INSERT OR IGNORE"), (1, 1, "x", 1.0)),
        "or replace": run(INSERT.replace("INSERT", "INSERT OR REPLACE"), (1, 1, "new", 1.0)),
        "update": run("UPDATE seats SET price = price + 1 WHERE show = 1"),
        "delete": run("DELETE FROM seats WHERE show = 1"),
        "rows": lambda: engine.count("seats"),
    }


@outcomes("migration_steps", [("same source again", "1"), ("other source, same table", "InvalidQuery"), ("if not exists", "2"), ("index", "3"), ("index again by name", "InvalidQuery"), ("index if not exists", "4"), ("unique without the key", "FailedPrecondition"), ("kept", "['by_code']"), ("undeclared", "FailedPrecondition"), ("a read", "InvalidQuery")])
def _(spark, sf_dir):
    engine = made(spark, SEATS, tables=(sharded("seats", "show", "int64"),))

    def migrated(sql):
        engine.migrate(sql)
        return engine.catalog.generation

    return {
        "same source again": lambda: migrated(SEATS),
        "other source, same table": lambda: migrated(SEATS + ";"),
        "if not exists": lambda: migrated(SEATS.replace("TABLE", "TABLE IF NOT EXISTS")),
        "index": lambda: migrated("CREATE INDEX by_code ON seats(code DESC, seat)"),
        "index again by name": lambda: migrated("CREATE INDEX by_code ON seats(price)"),
        "index if not exists": lambda: migrated("CREATE INDEX IF NOT EXISTS by_code ON seats(price)"),
        "unique without the key": lambda: migrated("CREATE UNIQUE INDEX one_code ON seats(code)"),
        "kept": lambda: [i.name for i in engine.catalog.tables["seats"].indexes],
        "undeclared": lambda: migrated("CREATE TABLE halls(id INTEGER)"),
        "a read": lambda: migrated("SELECT 1"),
    }


@outcomes("read_limits", [("rows", "8"), ("too many rows", "LimitExceeded"), ("too many bytes", "LimitExceeded"), ("no time", "DeadlineExceeded"), ("cancelled", "Cancelled"), ("first", "(1, 1)"), ("two more", "2"), ("the rest", "5"), ("then", "None"), ("streamed", "8"), ("as JSON", "8")])
def _(spark, sf_dir):
    engine = seats(spark)
    read = engine.query("SELECT show, seat FROM seats ORDER BY show")
    cursor, token = engine.collect(read).cursor(), CancellationToken()
    token.cancel()
    return {
        "rows": lambda: len(engine.collect(read, Budget(8, 1000)).rows),
        "too many rows": lambda: engine.collect(read, Budget(7, 1000)),
        "too many bytes": lambda: engine.collect(read, Budget(8, 100)),
        "no time": lambda: engine.collect(read, timeout=0),
        "cancelled": lambda: engine.collect(read, token=token),
        "first": lambda: tuple(cursor.fetchone()),
        "two more": lambda: len(cursor.fetchmany(2)),
        "the rest": lambda: len(cursor.fetchall()),
        "then": cursor.fetchone,
        "streamed": lambda: sum(1 for _ in read.stream()),
        "as JSON": lambda: len(engine.collect(read).as_json()["rows"]),
    }


@outcomes("inference_kinds", [("exact", "exact 1"), ("two keys", "multiple 2"), ("contradiction", "contradiction 0"), ("null", "contradiction 0"), ("in", "unconstrained 4"), ("or", "unconstrained 4"), ("no table", "not_applicable 1"), ("text", "TypeMismatch"), ("too large", "NumericOutOfRange"), ("in a branch", "TypeMismatch")])
def _(spark, sf_dir):
    engine = seats(spark)
    one, two = (next(k for k in range(1, 99) if shard_of(k, SHARDS) == n) for n in (0, 1))

    def told(where):
        plan = engine.plan(f"SELECT 1{where and f' FROM seats WHERE {where}'}")
        return f"{plan.inference} {0 if plan.empty else len(plan.targets(SHARDS))}"

    cases = {
        "exact": f"show = {one} AND price > 1", "two keys": f"show = {one} OR {two} = show", "contradiction": f"show = {one} AND show = {two}", "null": "show = NULL", "in": "show IN (1, 2)", "or": "show = 1 OR price > 3",
        "no table": "", "text": "show = 'one'", "too large": "show = 9223372036854775808", "in a branch": "price > 1 OR show = 'x'",
    }
    return {name: lambda where=where: told(where) for name, where in cases.items()}


@outcomes("statement_batches", [("reads", "[1, 1]"), ("a write among them", "InvalidQuery"), ("a write alone", "1"), ("schema", "InvalidQuery"), ("commit without begin", "FailedPrecondition"), ("begin", "transaction"), ("begin again", "FailedPrecondition"), ("failing write", "InvalidQuery"), ("then", "TransactionAborted"), ("rollback", "ready")])
def _(spark, sf_dir):
    engine = seats(spark)
    session = engine.session()

    def begun(sql):
        session.execute(sql)
        return session.state

    return {
        "reads": lambda: [len(r.rows) for r in session.run_batch("SELECT 1; SELECT COUNT(*) FROM seats")],
        "a write among them": lambda: session.run_batch("SELECT 1; DELETE FROM seats WHERE show = 1"),
        "a write alone": lambda: session.execute("DELETE FROM seats WHERE show = 1").rows_affected,
        "schema": lambda: session.execute("CREATE INDEX i ON seats(code)"),
        "commit without begin": lambda: session.execute("COMMIT"),
        "begin": lambda: begun("BEGIN"),
        "begin again": lambda: session.execute("BEGIN"),
        "failing write": lambda: session.execute("INSERT INTO seats(show, nothing) VALUES (1, 1)"),
        "then": lambda: session.execute("SELECT 1").rows,
        "rollback": lambda: begun("ROLLBACK"),
    }


@outcomes("filter_figures", [("none held", "0"), ("all held", "0"), ("rate of an empty filter", "0"), ("saturated", "False True")])
def _(spark, sf_dir):
    keys = [f"key {k}".encode() for k in range(2000)]
    words = bloom.bitmap(keys)
    empty, full = bloom.bitmap([]), ~bloom.bitmap([])
    return {
        "none held": lambda: int(bloom.holds(empty, keys).sum()),
        "all held": lambda: int((~bloom.holds(words, keys)).sum()),
        "rate of an empty filter": lambda: bloom.false_positive_ppm(empty),
        "saturated": lambda: f"{bool(bloom.saturated(words))} {bool(bloom.saturated(full))}",
    }


@outcomes("change_log_states", [("logged", "[1, 1]"), ("behind", "1"), ("applied", "1"), ("again", "0"), ("update and delete", "2"), ("behind then", "0"), ("pruned segments", "0"), ("before the pruned", "FailedPrecondition"), ("stale entries", "0"), ("paused", "4"), ("two appliers", "FailedPrecondition")])
def _(spark, sf_dir):
    engine = seats(spark)
    engine.indexes.create(Index("late", "seats", (IndexPart("code"),), mode="async"))
    box = Outbox(engine, "late")

    def logged():
        engine.execute(INSERT, [1, 2, "fresh", 1.0])
        return [box.log().count(), box.log().first()["cursor"]]

    def changed():
        engine.execute("UPDATE seats SET code = 'other' WHERE show = 1 AND seat = 2")
        engine.execute("DELETE FROM seats WHERE show = 2")
        return box.process()

    def pruned():
        box.prune()
        return box.log().count()

    def paused():
        box.pause()
        return len(box.behind())

    return {
        "logged": logged,
        "behind": lambda: len(box.behind()),
        "applied": box.process,
        "again": box.process,
        "update and delete": changed,
        "behind then": lambda: len(box.behind()),
        "pruned segments": pruned,
        "before the pruned": lambda: box.read(0),
        "stale entries": lambda: engine.indexes.validate("late").count(),
        "paused": paused,
        "two appliers": lambda: box.apply(box.log(), fence=0),
    }


@built("expression_index_entries", "SELECT o_orderkey * 2 + o_custkey AS twice, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, sf_dir):
    """Keys of an index on an expression, over part of the rows, after a write that it follows."""
    engine = orders(spark, sf_dir, f"computed-{uuid.uuid4().hex[:8]}")
    engine.indexes.create(Index("twice", "orders", (IndexPart(expression="o_orderkey * 2 + o_custkey"),), predicate="o_orderstatus = 'F'"))
    engine.execute("INSERT INTO orders(o_orderkey, o_custkey, o_orderstatus) VALUES (900000031, 7, 'F')")
    engine.execute("DELETE FROM orders WHERE o_custkey = 7 AND o_orderkey = 900000031")
    key = value_column(F.col("key"), 0, "int64")
    return engine.indexes.entries(engine.indexes.get("twice")).groupBy(key.alias("twice")).agg(F.count(F.lit(1)).alias("n"))


@outcomes("vacuum_steps", [("updates", "[1, 1]"), ("young", "0"), ("kept versions", "0"), ("rows", "8"), ("left behind", "1"), ("rows then", "8")])
def _(spark, sf_dir):
    engine = seats(spark)
    table = engine.catalog.tables["seats"]
    lost = lambda: len(engine.store.write(table, engine.store.read(table, [0])))  # noqa: E731  a write that nobody published
    return {
        "updates": lambda: [engine.execute("UPDATE seats SET price = ? WHERE show = 1", [p]).rows_affected for p in (2.0, 3.0)],
        "young": lambda: engine.vacuum("seats"),
        "kept versions": lambda: engine.vacuum("seats", 0),
        "rows": lambda: engine.count("seats"),
        "left behind": lambda: lost() and engine.vacuum("seats", 0),
        "rows then": lambda: engine.count("seats"),
    }


@built("parsed_placeholders", "SELECT * FROM (VALUES ('sqlite', 3), ('mysql', 2), ('postgres', 3)) t(dialect, needed)")
def _(spark, sf_dir):
    sources = {"sqlite": "SELECT ?2, ?, ?1", "mysql": "SELECT ?, ?", "postgres": "SELECT $3, $1"}
    return spark.createDataFrame([(d, parse(q, d).parameters[0]) for d, q in sources.items()], "dialect string, needed int")


@built("server_probe", "SELECT 'UTF8' AS server_encoding")
def _(spark, sf_dir):
    return system_probe(spark, "SHOW server_encoding")
