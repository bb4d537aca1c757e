"""Nested differences, versions, ledgers and stream markers on the verification tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff
from ..sources import ledger
from ..sources.store import Store
from ..streaming import ingest
from .bind import Tables, bound
from .loads import _folder

# documents: an order with its lines, and the same order after one of ten changes


def documents(t: Tables) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("double").alias("qty"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(line)).alias("ls"))
    items = F.transform("ls", lambda x: F.struct(x["part"].alias("part"), x["qty"].alias("qty")))
    tags = F.create_map(F.lit("a"), F.col("o_orderpriority"), F.lit("b"), F.col("o_orderstatus"))
    o = t.orders.withColumnRenamed("o_orderkey", "k").join(lines, "k")
    return o.select("k", F.col("o_totalprice").cast("double").alias("total"), F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("k") % 10 == 9, F.col("k") % 11).alias("n")).alias("info"), tags.alias("tags"), items.alias("lines"))


def changed_documents(t: Tables) -> DataFrame:
    m, ls = F.col("k") % 10, F.col("lines")
    none = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit(0.0).alias("qty")))
    more = F.transform(ls, lambda x, i: F.struct(x["part"].alias("part"), F.when(i == 0, x["qty"] + 1).otherwise(x["qty"]).alias("qty")))
    lines = F.when(m == 1, F.reverse(ls)).when(m == 2, F.slice(ls, 1, F.size(ls) - 1)).when(m == 3, F.concat(ls, none)).when(m == 6, more).otherwise(ls)
    tags = F.when(m == 4, F.map_concat("tags", F.create_map(F.lit("c"), F.lit("new")))).when(m == 5, F.map_filter("tags", lambda k, v: k != "b")).otherwise(F.col("tags"))
    total = F.when(m == 0, F.col("total") + 1).when(m == 7, F.col("total") * (1 + 1e-13)).otherwise(F.col("total"))
    info = F.struct(F.col("info.status").alias("status"), F.col("info.n").cast("double").alias("n"))
    return documents(t).select(F.when(m == 8, -F.col("k")).otherwise(F.col("k")).alias("k"), total.alias("total"), info.alias("info"), tags.alias("tags"), lines.alias("lines"))


@bound("""WITH d AS (SELECT o_orderkey AS k, o_orderkey % 10 AS m, ls, len(ls) AS n FROM orders JOIN (SELECT l_orderkey, list(struct_pack(part := l_partkey, qty := l_quantity) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ls FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)
SELECT k, 'total' AS path, 'changed' AS kind FROM d WHERE m = 0 UNION ALL SELECT k, 'lines', 'reordered' FROM d WHERE m = 1 AND list_reverse(ls) <> ls
UNION ALL SELECT k, 'lines[' || (n - 1) || ']', 'missing' FROM d WHERE m = 2 UNION ALL SELECT k, 'lines[' || n || ']', 'added' FROM d WHERE m = 3 UNION ALL SELECT k, 'tags.c', 'added' FROM d WHERE m = 4 UNION ALL SELECT k, 'tags.b', 'missing' FROM d WHERE m = 5
UNION ALL SELECT k, 'lines[0].qty', 'changed' FROM d WHERE m = 6 UNION ALL SELECT k, '', 'missing' FROM d WHERE m = 8 UNION ALL SELECT -k, '', 'added' FROM d WHERE m = 8 UNION ALL SELECT k, 'info.n', 'type' FROM d WHERE m = 9""")
def m5_nested_diff(t: Tables):
    return diff.nested_diff(documents(t), changed_documents(t), ["k"]).select("k", "path", "kind")


@bound("SELECT CASE WHEN event % 100 = 0 THEN 'left' ELSE 'right' END AS side, event, period, CAST(qty AS DOUBLE) AS qty FROM ln WHERE event % 100 IN (0, 1)")
def u3_table_diff(t: Tables):
    """Lines of some orders stand in one table only, those of others in the other; all the rest is equal and stays where it is."""
    d = t.lines().select("event", "period", F.col("qty").cast("double").alias("qty"))
    return diff.table_diff(d.where("event % 100 <> 1"), d.where("event % 100 <> 0"))


@bound("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN CAST(trunc(o_totalprice) AS DOUBLE) WHEN o_orderkey % 4 <> 3 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 3 THEN o_orderpriority END AS priority FROM orders""")
def l1_ledger_load(t: Tables):
    """Three loads: files of two schemas, no new file, and files of two further schemas; each footer is read once."""
    src, store, book = _folder(t, "drifting"), Store(t.spark, _folder(t, "store")), _folder(t, "ledger")
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    o.where("k % 4 = 0").select("k", F.col("price").cast("long").alias("price")).write.parquet(f"{src}/season=1")
    o.where("k % 4 = 1").select("k", "price", "status").write.parquet(f"{src}/season=2")
    ledger.load_drifting(t.spark, src, store, "orders", book)
    if ledger.load_drifting(t.spark, src, store, "orders", book):
        raise AssertionError("a second load of the same files reads none")
    o.where("k % 4 = 2").select(F.col("k").cast("int").alias("k"), "price").write.parquet(f"{src}/season=3")
    o.where("k % 4 = 3").select("priority", "k").write.parquet(f"{src}/season=4/more")
    ledger.load_drifting(t.spark, src, store, "orders", book)
    return store.read("orders").select("k", "price", "status", "priority")


@bound("""SELECT 'first' AS version, 'customer' AS source, CAST(c_custkey AS BIGINT) AS k FROM customer UNION ALL SELECT 'first', 'part', p_partkey FROM part UNION ALL SELECT 'last', 'customer', c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'last', 'part', p_partkey FROM part UNION ALL SELECT 'last', 'part', p_partkey FROM part WHERE p_size > 10""")
def l3_versions(t: Tables):
    """A table is replaced and rows are added to another; who holds the first pointer still reads both as they were."""
    store = Store(t.spark, _folder(t, "versions"))
    c, p = t.customer.select(F.col("c_custkey").cast("long").alias("k"), "c_acctbal"), t.part.select(F.col("p_partkey").cast("long").alias("k"), "p_size")
    first = store.publish({"customer": [store.build("customer", c)], "part": [store.build("part", p)]})
    store.publish({"part": [store.build("part", p.where("p_size > 10"))]}, add=True)
    last = store.publish({"customer": [store.build("customer", store.read("customer").where("c_acctbal > 0"))]})
    rows = [store.read(name, n).select(F.lit(v).alias("version"), F.lit(name).alias("source"), "k") for v, n in (("first", first), ("last", last)) for name in ("customer", "part")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@bound("SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '2024-01-08' THEN 0 ELSE 1 END AS batch FROM events WHERE user_id % 7 <> 0 GROUP BY user_id")
def l5_scope_markers(t: Tables):
    """Users are scopes and their days units; two calls land the units, a user of every seventh waits for one that never comes."""
    base = _folder(t, "scopes")
    units = t.events.select("user_id", F.to_date("ts").alias("day")).distinct()
    never = units.where("user_id % 7 = 0").select("user_id", F.lit("2099-01-01").cast("date").alias("day")).distinct()
    schema = "user_id long, day date"
    land = lambda d: d.select("user_id", F.to_date("ts").alias("day")).write.mode("append").parquet(f"{base}/in")
    scopes = ingest.Scopes(t.spark, f"{base}/store", units.unionByName(never), ["user_id"], ["day"])
    for early in (True, False):
        land(t.events.where("ts < '2024-01-08'" if early else "ts >= '2024-01-08'"))
        ingest.complete_stream(scopes, f"{base}/in", f"{base}/marks", schema)
    return scopes.markers().select("user_id", F.col("batch").cast("int").alias("batch"))
