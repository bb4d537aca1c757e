"""Repairs, loading, flattening, matching and audits on the verification tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import letters
from ..operators import aggregate as agg
from ..operators import audit, joins, match, repair
from ..sources import flatten, load
from ..streaming import ingest
from . import shapes
from .bind import Tables, bound

# repairs


@bound("SELECT o_orderkey AS event, CASE WHEN o_orderkey % 50 = 0 AND o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 50 = 0 AND o_orderstatus = 'F' THEN o_orderstatus ELSE o_orderpriority END AS b, o_orderkey % 50 = 0 AND o_orderstatus = 'F' AS swapped FROM orders")
def r1_swap_sides(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    fixes = o.where("event % 50 = 0").select("event", F.lit("F").alias("a"))
    return repair.swap_sides(o, fixes, "event", "a", "b", "a")


@bound("""WITH s AS (SELECT event, CAST(sum(amount) AS DOUBLE) AS total FROM ln GROUP BY event)
SELECT b1.event, CASE WHEN season = 1998 AND season_type = 2 THEN s.total ELSE CAST(price AS DOUBLE) END AS price FROM b1 LEFT JOIN s ON s.event = b1.event""")
def r2_repair_parent(t: Tables):
    s = t.lines().groupBy("event").agg(agg.total("amount").alias("total"))
    b = t.b1().df.withColumn("price", F.col("price").cast("double"))
    return repair.repair_parent(b, s, ["event"], "price", "total", (F.col("season") == 1998) & (F.col("season_type") == 2)).select("event", "price")


TOT = """tot AS (SELECT entity, opponent, count(*) + CASE WHEN opponent IS NULL AND entity % 7 = 0 THEN 1 ELSE 0 END AS games FROM b1 GROUP BY GROUPING SETS ((entity, opponent), (entity)))"""


@bound(f"WITH {TOT}, s AS (SELECT entity, CAST(sum(games) AS BIGINT) AS g FROM tot WHERE opponent IS NOT NULL GROUP BY entity) SELECT entity, opponent, CASE WHEN opponent IS NULL AND games <> g THEN g ELSE games END AS games, opponent IS NULL AND games <> g AS repaired FROM tot JOIN s USING (entity)")
def r3_rebuild_totals(t: Tables):
    g = t.b1().df.rollup("entity", "opponent").agg(F.count("*").alias("games"), F.grouping_id().alias("level")).where("level < 3").drop("level")
    g = g.withColumn("games", F.col("games") + F.when(F.col("opponent").isNull() & (F.col("entity") % 7 == 0), 1).otherwise(0))
    return repair.rebuild_totals(g, ["entity"], "opponent", ["games"])


@bound("SELECT event, period, part, CAST(amount AS DOUBLE) / nullif(CAST(sum(amount) OVER (PARTITION BY event) AS DOUBLE), 0) AS share FROM ln")
def r4_advanced_game(t: Tables):
    return repair.with_share(t.lines(), ["event"], "amount").select("event", "period", "part", "share")


@bound("SELECT part, CAST(sum(amount * discount) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0) AS weighted, count(*) FILTER (discount > 0) AS volume FROM ln GROUP BY part")
def r5_advanced_season(t: Tables):
    d = t.lines().withColumn("less", F.col("amount") * F.col("discount"))
    return d.groupBy("part").agg(agg.rate("less", "amount", 1.0).alias("weighted"), F.count_if(F.col("discount") > 0).alias("volume"))


@bound("""WITH u AS (SELECT event, part AS entity, sum(qty) AS q, NULL AS helped FROM ln GROUP BY ALL UNION ALL SELECT event, supp, NULL, sum(qty) FILTER (flag = 'R') FROM ln GROUP BY event, supp)
SELECT event, entity, CAST(sum(q) AS DOUBLE) AS q, CAST(sum(helped) AS DOUBLE) AS helped FROM u GROUP BY event, entity""")
def r6_rebuild_lines(t: Tables):
    out = repair.rebuild_lines(t.lines_by_event(), ["event"], [("part", {"q": F.col("qty")}), ("supp", {"helped": F.when(F.col("flag") == "R", F.col("qty"))})])
    return out.select("event", "entity", F.col("q").cast("double").alias("q"), F.col("helped").cast("double").alias("helped"))


@bound("""WITH s AS (SELECT event, CAST(sum(amount) AS DOUBLE) AS total FROM ln GROUP BY event)
SELECT b1.event, CASE WHEN season_type = 3 AND s.event IS NOT NULL THEN s.total WHEN season_type = 3 THEN NULL ELSE CAST(price AS DOUBLE) END AS price, CASE WHEN season_type = 3 AND s.event IS NOT NULL THEN NULL ELSE opponent END AS opponent, season_type = 3 AND s.event IS NOT NULL AS reconstructed FROM b1 LEFT JOIN s ON s.event = b1.event""")
def r7_fill_lines(t: Tables):
    b = t.b1().df.withColumn("price", F.when(F.col("season_type") != 3, F.col("price").cast("double")))
    s = t.lines().groupBy("event").agg(agg.total("amount").alias("price"))
    return repair.fill_lines(b, s, ["event"], ["price", "opponent"], F.col("price").isNull(), ("opponent",)).select("event", "price", "opponent", "reconstructed")


@bound("SELECT CASE WHEN supp % 2 = 1 AND supp > 0 THEN supp - 1 ELSE supp END AS entity, count(*) AS events FROM (SELECT DISTINCT event, CASE WHEN supp % 2 = 1 THEN supp - 1 ELSE supp END AS supp FROM ln) GROUP BY entity")
def r8_merge_identities(t: Tables):
    # each supplier under two ids, the odd one with empty lines, on every event of either
    even = (F.floor(F.col("supp") / 2) * 2).alias("even")
    both = F.explode(F.array(F.col("even"), F.col("even") + 1)).alias("entity")
    fact = t.lines_by_event("event", "supp").select("event", even).distinct().select("event", both).withColumn("minutes", F.when(F.col("entity") % 2 == 0, F.lit(1)))
    dim = t.lines().select(even).distinct().select(both).withColumn("name", F.floor(F.col("entity") / 2).cast("string"))
    out = repair.merge_identities(fact, dim, "entity", "name", ["event"], ["minutes"], F.col("minutes").isNotNull())
    return out.groupBy("entity").agg(F.count("*").alias("events"))


@bound("""WITH d AS (SELECT DISTINCT event FROM ln WHERE period = 1), h AS (SELECT b1.*, d.event IS NOT NULL AS det, least("group", CAST(substr(opponent, 1, 1) AS INTEGER)) AS x, greatest("group", CAST(substr(opponent, 1, 1) AS INTEGER)) AS y FROM b1 LEFT JOIN d ON d.event = b1.event WHERE season_type <> 3),
k AS (SELECT *, bool_or(det) OVER (PARTITION BY season) AS any_det FROM h WHERE CAST(substr(opponent, 1, 1) AS INTEGER) IN (SELECT n_nationkey FROM nation) AND "group" IN (SELECT n_nationkey FROM nation)),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y, day, season ORDER BY CASE WHEN det THEN 0 ELSE 1 END, event) AS rn FROM k WHERE NOT (event % 3 = 0) OR det OR NOT any_det)
SELECT event FROM r WHERE rn = 1""")
def r9_real_events(t: Tables):
    b = t.b1().df.withColumn("other", F.substring("opponent", 1, 1).cast("int"))
    members = t.nation.select("n_nationkey")
    out = repair.real_events(b, t.lines().where("period = 1").select("event"), members, ["event"], "season", ("group", "other"), "day", F.col("season_type") != 3, F.col("event") % 3 == 0)
    return out.select("event")


@bound("""WITH p AS (SELECT event, season, ts, least("group", o) AS x, greatest("group", o) AS y FROM (SELECT *, CAST(substr(opponent, 1, 1) AS INTEGER) AS o FROM b1)),
s AS (SELECT season, x, y, min(struct_pack(t := ts, e := event)) AS f FROM p GROUP BY season, x, y), m AS (SELECT *, unnest([x, y]) AS member FROM s),
n AS (SELECT season, x, y, row_number() OVER (PARTITION BY season, member ORDER BY f, x, y) AS n FROM m), r AS (SELECT season, x, y, CASE WHEN min(n) = max(n) THEN min(n) END AS round FROM n GROUP BY season, x, y)
SELECT p.event, r.round, row_number() OVER (PARTITION BY p.season, p.x, p.y ORDER BY p.ts, p.event) AS game_no FROM p JOIN r ON r.season = p.season AND r.x = p.x AND r.y = p.y""")
def r10_number_series(t: Tables):
    b = t.b1().df.withColumn("other", F.substring("opponent", 1, 1).cast("int"))
    return repair.number_series(b, "group", "other", ["ts", "event"], ["season"]).select("event", "round", "game_no")


@bound("SELECT agreed, count(*) AS n FROM (SELECT CASE WHEN c.n_regionkey = s.n_regionkey THEN c.n_regionkey END AS agreed FROM ln JOIN b1 USING (event) JOIN nation c ON c.n_nationkey = b1.\"group\" JOIN supplier ON s_suppkey = supp JOIN nation s ON s.n_nationkey = s_nationkey) GROUP BY agreed")
def r11_agreed(t: Tables):
    n = t.nation.select("n_nationkey", "n_regionkey")
    d = t.lines().join(t.b1().df.select("event", "group"), "event").join(t.supplier.select(F.col("s_suppkey").alias("supp"), "s_nationkey"), "supp")
    d = d.join(n.select(F.col("n_nationkey").alias("group"), F.col("n_regionkey").alias("ra")), "group").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("rb")), "s_nationkey")
    return d.groupBy(joins.agreed(d, F.col("ra"), F.col("rb")).alias("agreed")).agg(F.count("*").alias("n"))


@bound("WITH s AS (SELECT event, CAST(sum(amount) AS DECIMAL(18,2)) AS p FROM ln GROUP BY event) SELECT b1.event, CAST(price - coalesce(s.p, 0) AS DOUBLE) AS price_gap FROM b1 LEFT JOIN s ON s.event = b1.event")
def r12_gaps(t: Tables):
    s = t.lines().groupBy("event").agg(F.sum("amount").cast("decimal(18,2)").alias("price"))
    return repair.gaps(t.b1().df, s, ["event"], ["price"]).select("event", F.col("price_gap").cast("double").alias("price_gap"))


@bound("""WITH k AS (SELECT event, period, CASE WHEN flag = 'R' THEN 3 ELSE 2 END AS kind, CAST(qty AS BIGINT) AS q FROM ln ), f AS (SELECT * FROM k WHERE kind = 2),
z AS (SELECT * FROM f UNION ALL SELECT * FROM k WHERE kind = 3 AND q <= 28 AND NOT EXISTS (SELECT 1 FROM f WHERE f.event = k.event AND f.q IS NOT DISTINCT FROM k.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY event, period ORDER BY CASE WHEN kind = 2 THEN 0 ELSE 1 END, q DESC) AS rn FROM z) SELECT event, period, kind, q FROM r WHERE rn = 1""")
def r13_dedup_seasons(t: Tables):
    k = t.lines().select("event", "period", F.when(F.col("flag") == "R", 3).otherwise(2).alias("kind"), F.col("qty").cast("long").alias("q"))
    return repair.dedup_seasons(k, ["event", "period"], ["event"], "kind", ["q"], "q", 28, F.col("kind") == 2)


@bound("SELECT event, period, CAST(amount AS DOUBLE) AS amount, season, c_name, n_name, s_name FROM ln LEFT JOIN b1 USING (event) LEFT JOIN customer ON c_custkey = entity LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = supp")
def r14_fact_log(t: Tables):
    d = t.lines().join(t.b1().df.select("event", "season", "entity"), "event", "left").join(t.customer.select(F.col("c_custkey").alias("entity"), "c_name", "c_nationkey"), "entity", "left")
    d = d.join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey", "left").join(t.supplier.select(F.col("s_suppkey").alias("supp"), "s_name"), "supp", "left")
    return d.select("event", "period", F.col("amount").cast("double").alias("amount"), "season", "c_name", "n_name", "s_name")


@bound("SELECT event, CASE WHEN \"group\" = 3 AND season <= 1997 THEN 'Old Three' WHEN \"group\" = 5 AND season BETWEEN 1998 AND 1999 THEN 'Middle Five' WHEN \"group\" = 5 AND season >= 2000 THEN 'Late Five' ELSE n_name END AS name_then FROM b1 JOIN nation ON n_nationkey = \"group\"")
def r15_name_as_of(t: Tables):
    eras = t.spark.createDataFrame([(3, 0, 1997, "Old Three"), (5, 1998, 1999, "Middle Five"), (5, 2000, None, "Late Five")], "group int, first int, last int, name string")
    b = t.b1().df.join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("group"), "n_name")), "group")
    return repair.name_as_of(b, eras, "group", "season", "n_name").select("event", "name_then")


@bound("SELECT k, sum(CASE WHEN home THEN 1 ELSE 0 END)::BIGINT AS home, count(*) AS games FROM (SELECT part AS k, true AS home FROM ln UNION ALL SELECT supp, false FROM ln ) GROUP BY k")
def r16_both_sides(t: Tables):
    s = joins.both_sides(t.lines(), ["event"], {"k": F.col("part"), "home": F.lit(True)}, {"k": F.col("supp"), "home": F.lit(False)})
    return s.groupBy("k").agg(F.count_if("home").alias("home"), F.count("*").alias("games"))


@bound('SELECT "group", season, count(*) AS games FROM b1 WHERE event NOT IN (SELECT arg_max(event, struct_pack(d := ts, e := event)) FROM b1 WHERE won GROUP BY "group", season) GROUP BY ALL')
def r17_exclude_last(t: Tables):
    return joins.exclude_last(t.b1().df, ["group", "season"], ["ts", "event"], F.col("won")).groupBy("group", "season").agg(F.count("*").alias("games"))


@bound("SELECT event, entity, CAST(sum(v) AS DOUBLE) AS value FROM (SELECT event, part AS entity, qty AS v FROM ln WHERE period IN (1, 2) UNION ALL SELECT event, supp, 1 FROM ln WHERE period IN (1, 2) AND flag = 'R') GROUP BY event, entity")
def r18_period_line(t: Tables):
    first = t.lines_by_event("event", "part", "supp", "period", "flag", "qty").where(F.col("period").isin(1, 2))
    out = repair.rebuild_lines(first, ["event"], [("part", {"v": F.col("qty")}), ("supp", {"v": F.when(F.col("flag") == "R", F.lit(1).cast("decimal(18,2)"))})])
    return out.where("v is not null").select("event", "entity", F.col("v").cast("double").alias("value"))


@bound('SELECT "group", CAST(sum(qty) FILTER (p IS NOT NULL) AS DOUBLE) AS known, CAST(sum(qty) FILTER (p IS NULL) AS DOUBLE) AS unassigned FROM (SELECT event, qty, CASE WHEN flag <> \'A\' THEN part END AS p FROM ln WHERE period <= 2) JOIN b1 USING (event) GROUP BY "group"')
def r19_team_period_line(t: Tables):
    d = t.lines().where("period <= 2").join(t.b1().df.select("event", "group"), "event")
    return shapes.team_period_line(d, ["group"], F.when(F.col("flag") != "A", F.col("part")), "qty")


@bound("SELECT event, CASE WHEN len(q) >= 2 THEN q[2] + coalesce(q[4], 0) END AS points FROM (SELECT event, list(CAST(qty AS BIGINT) ORDER BY period, qty) AS q FROM ln GROUP BY event)")
def r20_period_points(t: Tables):
    from ..functions.scalar import listed_sum

    rows = t.lines().groupBy("event").agg(F.array_sort(F.collect_list(F.struct("period", F.col("qty").cast("long").alias("q")))).alias("a"))
    return rows.select("event", listed_sum(F.array_join(F.transform("a", lambda x: x["q"].cast("string")), ","), [2, 4]).alias("points"))


# loading and flattening


@bound("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(trunc(o_totalprice) AS DOUBLE) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderpriority END AS o_orderpriority FROM orders")
def l1_union_by_name(t: Tables):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    base = _folder(t, "drift")
    o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice").cast("long")).write.parquet(f"{base}/season=1")
    o.where("o_orderkey % 3 = 1").drop("o_orderpriority").write.parquet(f"{base}/season=2")
    o.where("o_orderkey % 3 = 2").write.parquet(f"{base}/season=3")
    return load.read_drifting(t.spark, base)


@bound("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY day")
def l5_incremental_ingest(t: Tables):
    base = _folder(t, "ingest")
    t.events.where("ts < '2024-01-08'").write.mode("append").parquet(f"{base}/in")
    ingest.ingest_new(t.spark, f"{base}/in", f"{base}/out", f"{base}/marks", t.events.schema)
    t.events.where("ts >= '2024-01-08'").write.mode("append").parquet(f"{base}/in")
    ingest.ingest_new(t.spark, f"{base}/in", f"{base}/out", f"{base}/marks", t.events.schema)
    return t.spark.read.parquet(f"{base}/out").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@bound("WITH n AS (SELECT p_partkey + (SELECT max(p_partkey) // 2 FROM part) AS p_partkey, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part) SELECT p_partkey, coalesce(n.p_size, p.p_size) AS p_size FROM part p FULL JOIN n USING (p_partkey)")
def l7_upsert(t: Tables):
    p = t.part.select("p_partkey", "p_size")
    half = F.broadcast(p.agg(F.floor(F.max("p_partkey") / 2).cast("long").alias("_half")))
    n = p.join(half).select((F.col("p_partkey") + F.col("_half")).alias("p_partkey"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"))
    return load.upsert(p, n, ["p_partkey"])


@bound("SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def l8_nested_json(t: Tables):
    return t.events.groupBy("user_id", F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


@bound("SELECT event, qty AS q, CAST(period AS BIGINT) AS made, CAST(period + 1 AS BIGINT) AS attempted FROM (SELECT event, period, CASE WHEN qty <> 7 THEN CAST(qty AS DOUBLE) END AS qty FROM ln )")
def l9_zip_stats(t: Tables):
    keys = F.array(F.lit("q"), F.lit("made-attempted"))
    text = F.when(F.col("qty") == 7, F.lit("--")).otherwise(F.col("qty").cast("string"))
    values = F.array(text, F.concat_ws("-", F.col("period"), F.col("period") + 1))
    return t.lines().select("event", *[c.alias(n) for n, c in flatten.zip_stats(keys, values, {"q": "double", "made-attempted": "bigint"}).items()])


@bound("SELECT 2000 AS season, n_name || ':' || CAST(c_custkey % 5 AS VARCHAR) AS team, any_value(r_name) AS conference, any_value(n_name) AS division FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY team")
def l10_hierarchy(t: Tables):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    low = c.groupBy("r_name", "n_name").agg(F.collect_set(F.concat_ws(":", "n_name", F.col("c_custkey") % 5)).alias("entries"))
    mid = low.groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "entries")).alias("children"))
    doc = mid.agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_name").alias("name"), "children")).alias("children"))).alias("json")).withColumn("season", F.lit(2000))
    schema = "children array<struct<name:string, entries:array<string>, children:array<struct<name:string, entries:array<string>>>>>"
    return flatten.flatten_alignment(doc, schema)


@bound("SELECT user_id, " + ", ".join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL) GROUP BY user_id")
def l11_pivot_stats(t: Tables):
    rows = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return flatten.pivot_stats(rows, ["user_id"], "event_type", "value", ["click", "error", "purchase", "signup", "view"])


@bound("""WITH g AS (SELECT entity, season, count(*) AS games, CAST(sum(price) AS DOUBLE) AS total FROM b1 GROUP BY entity, season), s AS (SELECT entity, season, games, CASE WHEN season % 3 <> 0 THEN total END AS total FROM g),
c AS (SELECT *, count(*) OVER (PARTITION BY entity, total IS NULL) AS n FROM s), k AS (SELECT entity, min(games) AS games, sum(total) AS total FROM g WHERE season % 3 = 0 GROUP BY entity)
SELECT c.entity, c.season, CASE WHEN c.total IS NULL AND n = 1 AND c.games = k.games THEN k.total ELSE c.total END AS total, coalesce(c.total IS NULL AND n = 1 AND c.games = k.games AND k.total IS NOT NULL, false) AS filled FROM c LEFT JOIN k USING (entity)""")
def l12_fill_missing(t: Tables):
    g = t.b1().df.groupBy("entity", "season").agg(F.count("*").alias("games"), agg.total("price").alias("total"))
    totals = g.where("season % 3 = 0").groupBy("entity").agg(F.min("games").alias("games"), F.sum("total").alias("total"))
    rows = g.withColumn("total", F.when(F.col("season") % 3 != 0, F.col("total")))
    return repair.fill_missing(rows, totals, ["entity"], "total", "games").select("entity", "season", "total", "filled")


@bound("SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '/en/(\\d+)', 1), '') AS BIGINT) AS id FROM pages")
def l13_url_id(t: Tables):
    return t.pages.select("page_id", flatten.id_from_url(F.col("url"), "en").alias("id"))


@bound("""WITH s AS (SELECT "group", season, count(*) AS n FROM b1 GROUP BY ALL), r AS (SELECT "group", season + 1 AS season, count(*) FILTER (won) AS won FROM b1 GROUP BY ALL) SELECT "group", season, n, won, n_name FROM s LEFT JOIN r USING ("group", season) JOIN nation ON n_nationkey = "group" """)
def l14_merge_rates(t: Tables):
    b = t.b1().df
    rates = b.groupBy("group", (F.col("season") + 1).alias("season")).agg(F.count_if("won").alias("won"))
    names = t.nation.select(F.col("n_nationkey").alias("group"), "n_name")
    return flatten.merge_rates(b.groupBy("group", "season").agg(F.count("*").alias("n")), rates, ["group", "season"], names, "group")


@bound("SELECT season, CAST(\"group\" AS VARCHAR) AS row, CAST(count(*) AS VARCHAR) AS n, CAST(count(*) FILTER (won) AS VARCHAR) AS won FROM b1 GROUP BY season, \"group\"")
def l15_unpack_columns(t: Tables):
    g = t.b1().df.groupBy("season", "group").agg(F.count("*").alias("n"), F.count_if("won").alias("won"))
    column = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("group").cast("string"), F.col(c).cast("string")))).alias(c)
    docs = g.groupBy("season").agg(column("n"), column("won")).select("season", F.to_json(F.struct("n", "won")).alias("text"))
    return flatten.unpack_columns(docs, ["season"], "text", ["n", "won"])


@bound("""WITH e AS (SELECT entity, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day, day AS utc, event FROM b2 WHERE "group" <> 'view'), i AS (SELECT entity, day, min(event) AS ev FROM e GROUP BY ALL HAVING count(DISTINCT event) = 1), u AS (SELECT entity, utc AS day, min(event) AS ev FROM e GROUP BY ALL HAVING count(DISTINCT event) = 1),
r AS (SELECT DISTINCT entity, day FROM b2) SELECT r.entity, r.day, coalesce(i.ev, n.ev, u.ev) AS event FROM r LEFT JOIN i ON i.entity = r.entity AND i.day = r.day LEFT JOIN u n ON n.entity = r.entity AND n.day = r.day + 1 LEFT JOIN u ON u.entity = r.entity AND u.day = r.day""")
def l16_resolve_event(t: Tables):
    from ..functions.scalar import civil_date

    b = t.b2().df
    events = b.where("group <> 'view'").select("entity", civil_date(F.col("ts")).alias("day"), F.col("day").alias("utc_day"), "event")
    return flatten.resolve_event(b.select("entity", "day").distinct(), events, "entity", "day", "event")


@bound("SELECT p_partkey AS part, CASE WHEN n = 1 THEN k END AS id FROM part LEFT JOIN (SELECT p_name, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY p_name) USING (p_name)")
def l17_resolve_names(t: Tables):
    dim = t.part.select(F.col("p_partkey").alias("id"), "p_name")
    return match.resolve_names(t.part.select(F.col("p_partkey").alias("part"), "p_name"), dim, "p_name", "id").select("part", "id")


@bound("SELECT c_custkey AS customer, CASE WHEN n = 1 THEN k END AS id FROM customer LEFT JOIN (SELECT c_name, count(*) AS n, min(c_custkey) AS k FROM customer GROUP BY c_name) USING (c_name)")
def l17_resolve_all_names(t: Tables):
    names = t.customer.select(F.col("c_custkey").alias("id"), "c_name")
    events = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("event"))
    return match.resolve_names(t.customer.select(F.col("c_custkey").alias("customer"), "c_name"), names, "c_name", "id", events).select("customer", "id")


@bound("SELECT entity, lower(regexp_replace(\"group\" || 'NetPts', '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS category, count(*) AS n FROM b2 GROUP BY ALL")
def l18_fingerprint_long(t: Tables):
    return t.b2().df.groupBy("entity", flatten.snake(F.concat("group", F.lit("NetPts"))).alias("category")).agg(F.count("*").alias("n"))


# matching


M1 = """WITH m AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS mention FROM part UNION SELECT p_name FROM part), d AS (SELECT p_partkey AS id, p_name FROM part)
SELECT mention, id, mention = p_name AS exact FROM m JOIN d ON len(list_filter(string_split(mention, ' '), lambda w: NOT list_contains(string_split(p_name, ' '), w))) = 0 AND (mention = p_name OR NOT EXISTS (SELECT 1 FROM part p WHERE p.p_name = m.mention)) WHERE mention <> ''"""


@bound(M1, name="m1_lookup_all_names")
@bound(M1)
def m1_lookup(t: Tables):
    mentions = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("mention")).union(t.part.select("p_name")).distinct()
    return match.lookup(mentions.where("mention <> ''"), t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@bound("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), e AS (SELECT DISTINCT substr(word, 1, 2) || substr(word, 4) AS word FROM w WHERE length(word) > 3)
SELECT e.word, w.word AS near, CAST(damerau_levenshtein(e.word, w.word) AS INTEGER) AS gap FROM e JOIN w ON damerau_levenshtein(e.word, w.word) <= CASE WHEN length(e.word) <= 3 THEN 0 WHEN length(e.word) <= 6 THEN 1 ELSE 2 END""")
def m2_near_spelling(t: Tables):
    words = t.part.select(F.explode(letters(F.col("p_name"))).alias("word")).distinct()
    typed = words.where("length(word) > 3").select(F.concat(F.substring("word", 1, 2), F.expr("substring(word, 4)")).alias("word"))
    return match.near_words(typed, words)


@bound("""WITH c AS (SELECT DISTINCT substr(c_name, 1, 17) AS mention, c_custkey AS id FROM customer), s AS (SELECT DISTINCT entity, season FROM b1), f AS (SELECT c.*, EXISTS (SELECT 1 FROM s WHERE s.entity = id AND s.season = 1996) AS a, EXISTS (SELECT 1 FROM s WHERE s.entity = id AND s.season = (SELECT max(season) FROM s)) AS n FROM c),
g AS (SELECT mention, bool_or(a) AS any_a FROM f GROUP BY mention) SELECT mention, id FROM f JOIN g USING (mention) WHERE (any_a AND a) OR (NOT any_a AND n)""")
def m3_eliminate(t: Tables):
    cands = t.customer.select(F.substring("c_name", 1, 17).alias("mention"), F.col("c_custkey").alias("id"))
    facts = t.b1().df.select(F.col("entity").alias("id"), "season")
    return match.eliminate(cands, facts, "id", "season", 1996)


@bound("SELECT event, CASE WHEN opponent = '1-URGENT' THEN 11 ELSE 22 END AS id FROM b1 WHERE (opponent = '1-URGENT' AND season <= 1998) OR opponent = '5-LOW' AND season >= 1997")
def m4_alias(t: Tables):
    aliases = t.spark.createDataFrame([("1-urgent", 11, 0, 1998), ("5-Low", 22, 1997, None)], "alias string, id int, first int, last int")
    return match.alias_lookup(t.b1().df.select("event", "season", F.col("opponent").alias("mention")), aliases).select("event", "id")


@bound("""WITH a AS (SELECT p_partkey + 3 AS p_partkey, p_brand, p_retailprice FROM part), b AS (SELECT p_partkey, p_brand, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN b.p_brand IS NULL THEN '' WHEN a.p_brand IS NULL THEN '' WHEN a.p_brand <> b.p_brand THEN 'p_brand' ELSE 'p_retailprice' END AS path,
 CASE WHEN a.p_brand IS NULL THEN 'missing' WHEN b.p_brand IS NULL THEN 'added' ELSE 'changed' END AS kind FROM b FULL JOIN a USING (p_partkey)
WHERE a.p_brand IS NULL OR b.p_brand IS NULL OR a.p_brand <> b.p_brand OR abs(a.p_retailprice - b.p_retailprice) > 1e-9 * greatest(1, abs(a.p_retailprice), abs(b.p_retailprice))""")
def m5_keyed_diff(t: Tables):
    b = t.part.select("p_partkey", "p_brand", "p_retailprice")
    a = b.withColumn("p_partkey", F.col("p_partkey") + 3)
    return match.keyed_diff(b, a, ["p_partkey"]).select("p_partkey", "path", "kind")


# audits


@bound("WITH a AS (SELECT season, season_type, count(*) AS orders FROM b1 GROUP BY ALL), b AS (SELECT season, season_type, count(*) AS lines FROM b1 JOIN ln USING (event) GROUP BY ALL) SELECT season, season_type, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM a FULL JOIN b USING (season, season_type)")
def k1_coverage(t: Tables):
    b = t.b1().df
    return audit.coverage({"orders": b, "lines": b.join(t.lines(), "event")}, ["season", "season_type"])


@bound("WITH n AS (SELECT season, count(*) AS rows FROM b1 GROUP BY season), m AS (SELECT median(rows) AS m FROM n WHERE season >= 1996), p AS (SELECT season, rows, CASE WHEN season >= 1996 AND rows < 1.0 * m THEN 'thin' WHEN season < 1996 AND rows >= 1.0 * m THEN 'usable below floor' END AS problem FROM n, m) SELECT * FROM p WHERE problem IS NOT NULL")
def k2_floor(t: Tables):
    return audit.floor_check(t.b1().df, "season", 1996, 1.0)


@bound("""WITH d AS (SELECT DISTINCT season, "group" FROM b1) SELECT season, count(*) AS keys, count(n.k) AS again FROM d LEFT JOIN (SELECT season - 1 AS s, "group" AS k FROM d) n ON n.s = season AND n.k = "group" GROUP BY season HAVING count(*) = count(n.k)""")
def k3_phantom(t: Tables):
    return audit.phantom_seasons(t.b1().df, "season", ["group"])


@bound("WITH n AS (SELECT season, count(DISTINCT entity) AS entities FROM b1 GROUP BY season), l AS (SELECT *, lag(entities) OVER (ORDER BY season) AS before FROM n) SELECT season, entities, before FROM l WHERE entities < 0.99 * before")
def k3_shrinking(t: Tables):
    return audit.shrinking_pool(t.b1().df, "season", "entity", 0.99)


@bound("WITH c AS (SELECT event, count(DISTINCT period) AS n FROM ln GROUP BY event), p AS (SELECT event, count(*) AS n FROM ln GROUP BY event) SELECT season, count(*) FILTER (p.n = c.n) * 100.0 / count(*) AS agree_pct FROM p JOIN c USING (event) JOIN b1 USING (event) GROUP BY season HAVING count(*) FILTER (p.n = c.n) * 100.0 / count(*) < 99")
def k4_disagreement(t: Tables):
    ln = t.lines()
    parent = ln.groupBy("event").agg(F.count("*").alias("n")).join(t.b1().df.select("event", "season"), "event")
    out = audit.disagreement(parent, ln.groupBy("event").agg(F.count_distinct("period").alias("n")), ["event"], "n", ["season"])
    return out.withColumn("agree_pct", F.col("agree_pct").cast("double"))


@bound("SELECT season, count(CASE WHEN won THEN price END) AS p, count(CASE WHEN season_type = 3 THEN opponent END) AS o, count(*) FILTER (NOT won AND season_type <> 3) AS empty FROM b1 GROUP BY season")
def k5_uncleared(t: Tables):
    d = t.b1().df.select("season", F.when(F.col("won"), F.col("price")).alias("p"), F.when(F.col("season_type") == 3, F.col("opponent")).alias("o"))
    return audit.uncleared(d, ["season"], ["p", "o"])


@bound("WITH f AS (SELECT part, count(*) AS n FROM ln GROUP BY part), s AS (SELECT part, count(*) AS n FROM ln WHERE event % 10 <> 0 GROUP BY part) SELECT (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM f)) AS stale, (SELECT count(*) FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM s)) AS missing")
def k6_staleness(t: Tables):
    ln = t.lines()
    return audit.staleness(ln.groupBy("part").agg(F.count("*").alias("n")), ln.where("event % 10 <> 0").groupBy("part").agg(F.count("*").alias("n")))


@bound("SELECT event, CAST(substr(opponent, 1, 1) AS BIGINT) AS said FROM b1 WHERE CAST(substr(opponent, 1, 1) AS BIGINT) <> season_type + 1")
def k7_label_disagreement(t: Tables):
    d = t.b1().df.withColumn("n", F.col("season_type") + 1)
    return audit.label_disagreement(d, "opponent", r"^(\d+)-", "n").select("event", "said")


@bound("SELECT event, period, count(*) AS rows FROM ln GROUP BY ALL HAVING count(*) > 1")
def k8_repeated_keys(t: Tables):
    return audit.repeated_keys(t.lines(), ["event", "period"])


@bound("""WITH e AS (SELECT DISTINCT entity, day FROM b2 WHERE won), r AS (SELECT DISTINCT entity, day FROM b2 WHERE NOT won), n AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.entity = r.entity AND e.day = r.day))
SELECT n.entity, n.day, CAST(date_diff('day', n.day, e.day) AS INTEGER) AS shift FROM n JOIN e ON e.entity = n.entity AND abs(date_diff('day', n.day, e.day)) = 1""")
def k8_neighbour_days(t: Tables):
    b = t.b2().df
    return audit.neighbour_days(b.where("not won").select("entity", "day").distinct(), b.where("won").select("entity", "day"), ["entity"])


@bound("SELECT count(*) AS rows, count(*) FILTER (c_custkey IS NULL) AS unmatched FROM b1 LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = entity")
def k9_unmatched(t: Tables):
    dim = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("entity"), F.col("c_custkey").alias("id"))
    return audit.unmatched_share(t.b1().df.join(dim, "entity", "left"), "id")


@bound("WITH s AS (SELECT season_type AS tier, min(season) AS f, max(season) AS l FROM b1 GROUP BY season_type) SELECT tier, max(f) OVER (ORDER BY tier) AS first, min(l) OVER (ORDER BY tier) AS last FROM s")
def k10_tiers(t: Tables):
    s = t.b1().df.groupBy(F.col("season_type").alias("tier")).agg(F.min("season").alias("f"), F.max("season").alias("l"))
    return audit.tiers(s, "tier", "f", "l")


@bound("SELECT lower(p_name) AS alias, count(DISTINCT p_partkey) AS entities FROM part GROUP BY alias HAVING count(DISTINCT p_partkey) <> 1")
def k11_ambiguous_aliases(t: Tables):
    return audit.ambiguous_aliases(t.part, F.lower("p_name"), "p_partkey")


def _folder(t: Tables, name: str) -> str:
    """A new folder that all executors share: under the checkpoint folder, or a temporary one where none is set and all run on one machine, as in tests."""
    import tempfile
    import uuid

    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir()
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-load-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


