"""Aggregates, windows and cuts on the verification tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import relation, windows
from .bind import Tables, bound

PRICE = "CAST(sum(price) AS DOUBLE)"


@bound(f"SELECT count(*) AS games, {PRICE} AS total_price, {PRICE} / count(price) AS avg_price FROM b1")
def a1_scalar(t: Tables):
    return agg.aggregate(t.b1().df, {"games": ("count", "*"), "total_price": ("sum", "price"), "avg_price": ("avg", "price")})


@bound("SELECT part, CAST(sum(amount * discount) AS DOUBLE) * 100 / nullif(CAST(sum(amount) AS DOUBLE), 0) AS rate FROM ln GROUP BY part")
def a2_rate(t: Tables):
    d = t.lines().withColumn("less", F.col("amount") * F.col("discount"))
    return d.groupBy("part").agg(agg.rate("less", "amount").alias("rate"))


@bound('SELECT "group", count(*) FILTER (w) AS wins, count(*) FILTER (NOT w) AS losses FROM (SELECT "group", CASE WHEN season_type = 2 THEN won END AS w FROM b1) GROUP BY "group"')
def a3_record(t: Tables):
    return t.b1().df.withColumn("won", F.when(F.col("season_type") == 2, F.col("won"))).groupBy("group").agg(*agg.record())


@bound(f"SELECT entity, count(*) AS games, {PRICE} / count(price) AS avg_price, {PRICE} AS total_price, min(season) AS first_season, max(season) AS last_season FROM b1 GROUP BY entity")
def a4_line(t: Tables):
    return t.b1().df.groupBy("entity").agg(*agg.line(["price"]))


@bound("SELECT season, count(*) FILTER (won) AS wins, CAST(sum(price) FILTER (opponent = '1-URGENT') AS DOUBLE) AS urgent FROM b1 GROUP BY season")
def a5_filtered(t: Tables):
    return t.b1().df.groupBy("season").agg(F.count_if("won").alias("wins"), agg.total(F.when(F.col("opponent") == "1-URGENT", F.col("price"))).alias("urgent"))


A6 = {"season": "season", "type": "season_type", "year_month": "strftime(day, '%Y-%m')", "month": "month(day)", "opponent": "opponent", "outcome": "won"}


@bound(" UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({s} AS VARCHAR) AS value, count(*) AS games, {PRICE} AS total_price FROM b1 GROUP BY {s}" for k, s in A6.items()))
def a6_grouped(t: Tables):
    values = {"year_month": F.date_format("day", "yyyy-MM"), "month": F.month("day"), "type": F.col("season_type"), "outcome": F.col("won")}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (values[k] if k in values else F.col(k)).cast("string").alias("value")) for k in A6])
    return t.b1().df.select("price", F.explode(kinds).alias("g")).groupBy("g.kind", "g.value").agg(F.count("*").alias("games"), agg.total("price").alias("total_price"))


@bound(f"SELECT CASE WHEN p IS NULL THEN 'blank' WHEN p >= 200000 THEN 'reached' ELSE 'short' END AS line, count(*) AS games, count(*) FILTER (won) AS wins, {PRICE} AS total_price FROM (SELECT *, CASE WHEN season_type = 2 THEN price END AS p FROM b1) GROUP BY line")
def a7_by_line(t: Tables):
    d = t.b1().df.withColumn("p", F.when(F.col("season_type") == 2, F.col("price")))
    return agg.by_line(d, F.col("p") >= 200000, [F.count_if("won").alias("wins"), agg.total("price").alias("total_price")])


READ = "CASE WHEN season_type = 2 THEN price END"


@bound(f"SELECT entity, CAST(sum({READ}) AS DOUBLE) / nullif(count({READ}), 0) AS avg_price, count({READ}) AS sample FROM b1 GROUP BY entity HAVING count({READ}) >= 8")
def a8_min_sample(t: Tables):
    d = t.b1().df.withColumn("p", F.when(F.col("season_type") == 2, F.col("price")))
    return agg.grouped(d, {"entity": F.col("entity")}, [agg.mean("p").alias("avg_price")], 8, "p")


@bound(f"WITH g AS (SELECT entity, {PRICE} / count(price) AS avg_price, count(*) AS sample FROM b1 WHERE season = 1997 GROUP BY entity), m AS (SELECT max(sample) AS most FROM g) SELECT entity, avg_price, sample FROM g, m WHERE sample >= CASE WHEN most >= 500 THEN 500 ELSE CAST(ceil(most / 2.0) AS BIGINT) END")
def a9_adaptive_minimum(t: Tables):
    return agg.grouped(t.b1().span(season=1997).df, {"entity": F.col("entity")}, [agg.mean("price").alias("avg_price")], 500, adaptive=True)


@bound('SELECT season, CAST(floor(58 * median(n) / 82 + 0.5) AS BIGINT) AS minimum FROM (SELECT season, "group", count(*) AS n FROM b1 GROUP BY ALL) GROUP BY season')
def a10_scaled_minimum(t: Tables):
    return agg.scaled_minimum(t.b1().df, "season", "group", 58)


SEASONS = f"s AS (SELECT entity, season, count(*) AS games, {PRICE} / count(price) AS avg_price, CASE WHEN season % 2 = 0 THEN CAST(sum(price) AS DOUBLE) END AS stored FROM b1 GROUP BY entity, season)"


def seasons(t: Tables):
    g = t.b1().df.groupBy("entity", "season").agg(F.count("*").alias("games"), agg.mean("price").alias("avg_price"), agg.total("price").alias("total"))
    return g.withColumn("stored", F.when(F.col("season") % 2 == 0, F.col("total")))


@bound(f"WITH {SEASONS} SELECT entity, CAST(sum(CAST(stored * games AS DECIMAL(28,4))) AS DOUBLE) / nullif(sum(CASE WHEN stored IS NOT NULL THEN games END), 0) AS mean FROM s GROUP BY entity")
def a11_weighted(t: Tables):
    return seasons(t).groupBy("entity").agg(agg.weighted("stored", "games").alias("mean"))


@bound(f"WITH {SEASONS} SELECT entity, CAST(sum(CAST(coalesce(stored, avg_price * games) AS DECIMAL(28,4))) AS DOUBLE) AS total, CAST(sum(CAST(coalesce(stored, avg_price * games) AS DECIMAL(28,4))) AS DOUBLE) / sum(games) AS average, CAST(sum(games) AS BIGINT) AS games FROM s GROUP BY entity")
def a12_career(t: Tables):
    return agg.career(seasons(t), ["entity"], "stored", "avg_price", "games")


@bound("SELECT part, count(DISTINCT event) AS events, count(*) AS lines FROM ln GROUP BY part")
def a13_distinct(t: Tables):
    return t.lines().groupBy("part").agg(F.count_distinct("event").alias("events"), F.count("*").alias("lines"))


@bound("SELECT entity, count(*) AS seasons FROM (SELECT entity, season FROM b1 GROUP BY ALL HAVING count(*) >= 2 AND sum(price) >= 300000) GROUP BY entity")
def a14_groups_counted(t: Tables):
    return agg.groups_counted(t.b1().df, ["entity", "season"], ["entity"], (F.count("*") >= 2) & (F.sum("price") >= 300000))


@bound("SELECT entity, games, (SELECT count(DISTINCT entity) FROM b1) AS pool FROM (SELECT entity, count(*) AS games FROM b1 GROUP BY entity) ORDER BY games DESC, entity LIMIT 12")
def a15_with_pool(t: Tables):
    return windows.with_pool(t.b1().df.groupBy("entity").agg(F.count("*").alias("games")), [F.desc("games"), F.asc("entity")], 12)


KINDS = ["click", "error", "purchase", "signup", "view"]


@bound("SELECT entity, " + ", ".join(f"max(CAST(value AS DOUBLE)) FILTER (\"group\" = '{k}') AS {k}" for k in KINDS) + " FROM b2 GROUP BY entity")
def a16_pivot(t: Tables):
    return agg.pivot_long(t.b2().df.withColumn("value", F.col("value").cast("double")), ["entity"], "group", "value", KINDS)


@bound("SELECT event, string_agg(period || ':' || CAST(qty AS BIGINT), ',' ORDER BY period, qty) AS items FROM ln GROUP BY event")
def a17_ordered_list(t: Tables):
    rows = agg.ordered_list(t.lines().withColumn("qty", F.col("qty").cast("long")), ["event"], ["period", "qty"])
    return rows.select("event", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["period"], x["qty"])), ",").alias("items"))


@bound("SELECT entity, arg_max(event, struct_pack(p := price, e := event)) AS best, bool_and(won) AS all_won, bool_or(won) AS any_won, median(CAST(price AS DOUBLE)) AS mid FROM b1 GROUP BY entity")
def a18_arg_max_bools(t: Tables):
    return t.b1().df.groupBy("entity").agg(F.max_by("event", F.struct("price", "event")).alias("best"), F.bool_and("won").alias("all_won"), F.bool_or("won").alias("any_won"), F.median(F.col("price").cast("double")).alias("mid"))


@bound("SELECT part, " + ", ".join(f"CAST(sum(amount) FILTER (period = {p}) AS DOUBLE) AS p{p}" for p in (1, 2, 3, 4)) + " FROM ln WHERE period IN (1, 2, 3, 4) GROUP BY part")
def a19_by_period(t: Tables):
    return agg.by_period(t.lines(), ["part"], "period", [1, 2, 3, 4], F.col("amount"))


@bound(f"SELECT entity, opponent, count(*) AS games, {PRICE} AS total_price FROM b1 GROUP BY GROUPING SETS ((entity, opponent), (entity))")
def a20_totals_with_parts(t: Tables):
    from pyspark.sql import functions as f

    r = t.b1().df.rollup("entity", "opponent").agg(f.count("*").alias("games"), agg.total("price").alias("total_price"), f.grouping_id().alias("level"))
    return r.where("level < 3").drop("level")


@bound("WITH a AS (SELECT season, event, count(*) AS n, CAST(sum(qty) AS BIGINT) AS q FROM ln JOIN b1 USING (event) GROUP BY ALL), b AS (SELECT event, count(DISTINCT period) AS n, CAST(sum(qty) FILTER (period <= 6) AS BIGINT) AS q FROM ln GROUP BY event) SELECT season, count(*) FILTER (a.n IS NOT DISTINCT FROM b.n) * 100.0 / count(*) AS n, count(*) FILTER (a.q IS NOT DISTINCT FROM b.q) * 100.0 / count(*) AS q FROM a JOIN b USING (event) GROUP BY season")
def a21_agreement(t: Tables):
    ln = t.lines()
    a = ln.join(t.b1().df.select("event", "season"), "event").groupBy("season", "event").agg(F.count("*").alias("n"), F.sum("qty").cast("long").alias("q"))
    b = ln.groupBy("event").agg(F.count_distinct("period").alias("n"), F.sum(F.when(F.col("period") <= 6, F.col("qty"))).cast("long").alias("q"))
    out = agg.agreement(a, b, ["event"], ["n", "q"], ["season"])
    return out.select("season", F.col("n").cast("double").alias("n"), F.col("q").cast("double").alias("q"))


@bound("WITH d AS (SELECT event, CASE WHEN min(period) = 1 THEN max(qty) END AS figure FROM ln GROUP BY event) SELECT count(*) AS games, count(*) FILTER (d.event IS NULL) AS no_detail, count(*) FILTER (d.event IS NOT NULL AND figure IS NULL) AS blank FROM b1 LEFT JOIN d USING (event)")
def a22_blank_count(t: Tables):
    d = t.lines().groupBy("event").agg(F.when(F.min("period") == 1, F.max("qty")).alias("figure"))
    return agg.blank_count(t.b1().df, d, ["event"], F.col("figure"))


# windows


@bound("SELECT event, period, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY event, period ORDER BY amount DESC, part, supp) AS rn FROM ln) WHERE rn = 1")
def w1_keep_one(t: Tables):
    one = windows.keep_one(t.lines(), ["event", "period"], [F.desc("amount"), F.asc("part"), F.asc("supp")])
    return one.select("event", "period", F.col("amount").cast("double").alias("amount"))


def runs_sql(src: str, keys: str, hit: str, pick: str = "rn2 = 1") -> str:
    return f"""WITH r AS (SELECT {keys}, day, coalesce({hit}, false) AS hit, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event) AS rn, lead(1) OVER (PARTITION BY {keys} ORDER BY ts, event) IS NULL AS final,
 row_number() OVER (PARTITION BY {keys}, coalesce({hit}, false) ORDER BY ts, event) AS rh FROM {src} ),
g AS (SELECT {keys}, count(*) AS length, min(day) AS first_day, max(day) AS last_day, bool_or(final) AS open FROM r WHERE hit GROUP BY {keys}, rn - rh),
p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY length DESC, first_day) AS rn2 FROM g)
SELECT {keys}, length, first_day, last_day, open FROM p WHERE {pick}"""


@bound(runs_sql("b1", "entity", "won"))
def w2_longest_runs(t: Tables):
    return windows.longest_runs(t.b1().df, ["entity"], ["ts", "event"], F.col("won"))


U = """(SELECT entity, day, ts, event, CASE WHEN season_type = 2 THEN won END AS won FROM b1 )"""


@bound(runs_sql(U, "entity", "won"))
def w3_runs_with_unknown(t: Tables):
    d = t.b1().df
    return windows.runs_with_unknown(d.where("season_type = 2"), d.where("season_type <> 2"), ["entity"], ["ts", "event"], "won")


@bound(runs_sql("b1", '"group", season', "price >= 150000"))
def w4_season_runs(t: Tables):
    return windows.longest_runs(t.b1().df, ["group", "season"], ["ts", "event"], F.col("price") >= 150000)


STINTS = """r AS (SELECT *, CASE WHEN lag(opponent) OVER w IS NULL OR lag(opponent) OVER w <> opponent OR season - lag(season) OVER w > 1 THEN 1 ELSE 0 END AS new FROM b1 WINDOW w AS (PARTITION BY entity ORDER BY ts, event)),
k AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts, event ROWS UNBOUNDED PRECEDING) AS stint FROM r),
g AS (SELECT entity, stint, any_value(opponent) AS opponent, min(day) AS first_day, max(day) AS seen_day, max(season) AS season, count(*) AS games FROM k GROUP BY entity, stint),
e AS (SELECT opponent, season, max(day) AS fin FROM b1 GROUP BY opponent, season),
st AS (SELECT entity, CAST(stint AS BIGINT) AS stint, g.opponent, first_day, seen_day, games, coalesce(least(CAST(lead(first_day) OVER (PARTITION BY entity ORDER BY stint) - INTERVAL 1 DAY AS DATE), fin), fin) AS last_day FROM g JOIN e ON e.opponent = g.opponent AND e.season = g.season)"""


@bound(f"WITH {STINTS} SELECT * FROM st")
def w5_stints(t: Tables):
    return windows.stints(t.b1().df, "entity", "opponent", ["ts", "event"], season="season")


@bound(f"WITH {STINTS} SELECT x.entity, x.opponent, greatest(x.first_day, y.first_day) AS first_day, least(x.last_day, y.last_day) AS last_day FROM st x JOIN st y ON y.entity = x.entity + 1 AND x.opponent = y.opponent AND x.first_day <= y.last_day AND y.first_day <= x.last_day")
def w6_overlaps(t: Tables):
    s = windows.stints(t.b1().df, "entity", "opponent", ["ts", "event"], season="season")
    return windows.overlaps(s, s.withColumn("entity", F.col("entity") - 1), ["entity", "opponent"])


@bound('SELECT entity, "group", min(day) AS first_day, max(day) AS last_day FROM b2 GROUP BY ALL')
def w7_spans(t: Tables):
    return windows.spans(t.b2().df, ["entity", "group"])


@bound("SELECT entity, count(*) AS games, CAST(sum(price) AS DOUBLE) AS total_price FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event DESC) AS rn FROM b1 WHERE price >= 50000) WHERE rn <= 5 GROUP BY entity")
def w8_window_last(t: Tables):
    r = t.b1().line("price", ">=", 50000).window("recent", 5)
    return r.df.groupBy("entity").agg(F.count("*").alias("games"), agg.total("price").alias("total_price"))


@bound("SELECT entity, season_type, count(*) AS games FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event DESC) AS rn FROM b1) WHERE rn <= 6 GROUP BY ALL")
def w9_merge_window(t: Tables):
    b = t.b1()
    return relation.merge_window([b.season_type(2), b.season_type(3)], 6).df.groupBy("entity", "season_type").agg(F.count("*").alias("games"))


@bound("SELECT event, count(*) OVER (PARTITION BY season) AS pool, n > 1 AS moved FROM b1 JOIN (SELECT entity, count(DISTINCT opponent) AS n FROM b1 GROUP BY entity) USING (entity)")
def w10_partition_counts(t: Tables):
    d = t.b1().df.select("event", "season", "entity", "opponent")
    pool = d.groupBy("season").agg(F.count("*").alias("pool"))
    groups = d.groupBy("entity").agg((F.min("opponent") < F.max("opponent")).alias("moved"))
    return d.join(pool, "season").join(groups, "entity").select("event", "pool", "moved")


@bound("SELECT p_partkey AS part, cume_dist() OVER (ORDER BY p_retailprice) AS pct, (rank() OVER (ORDER BY p_retailprice) - 1 + count(*) OVER (PARTITION BY p_retailprice) / 2.0) / count(*) OVER () AS mid FROM part")
def w11_percentile(t: Tables):
    p = t.part.select(F.col("p_partkey").alias("part"), "p_retailprice")
    return windows.percentiles(p, "p_retailprice", {"pct": False, "mid": True}).select("part", "pct", "mid")


@bound("SELECT entity, season, games, rank() OVER (PARTITION BY season ORDER BY games DESC) AS rank FROM (SELECT entity, season, count(*) AS games FROM b1 GROUP BY ALL)")
def w12_competition_rank(t: Tables):
    g = t.b1().df.groupBy("entity", "season").agg(F.count("*").alias("games"))
    return windows.competition_rank(g, "games", key=["season"])


# order, cuts


@bound("SELECT event, CAST(price AS DOUBLE) AS price FROM b1 ORDER BY price DESC NULLS LAST, day DESC, event LIMIT 25")
def t1_ordered_rows(t: Tables):
    return t.b1().df.orderBy(F.desc_nulls_last("price"), F.desc("day"), F.asc("event")).limit(25).select("event", F.col("price").cast("double").alias("price"))


def cut_sql(src: str, figure: str, k: int, cols: str, room: int = 10, way: str = "DESC") -> str:
    return f"""WITH f AS ({src}), r AS (SELECT *, rank() OVER (ORDER BY {figure} {way}) AS rank, count(*) OVER (PARTITION BY {figure}) AS ties FROM f WHERE {figure} IS NOT NULL)
SELECT {cols}, rank FROM r WHERE rank <= {k} AND (rank = 1 OR rank + ties - 1 <= {k + room}) ORDER BY rank, {cols.split(",")[0]} LIMIT {k + room}"""


@bound(cut_sql("SELECT entity, count(*) AS games FROM b1 WHERE won GROUP BY entity", "games", 20, "entity, games"))
def t2_top_with_ties(t: Tables):
    g = t.b1().df.where("won").groupBy("entity").agg(F.count("*").alias("games"))
    return windows.top_with_ties(g, "games", 20, order=["entity"]).select("entity", "games", "rank")


@bound("SELECT event, CAST(price AS DOUBLE) AS price FROM b1 ORDER BY price DESC, event LIMIT 10 OFFSET 30")
def t3_page(t: Tables):
    return windows.page(t.b1().df, [F.desc("price"), F.asc("event")], 30, 10).select("event", F.col("price").cast("double").alias("price"))


@bound("SELECT entity, figure FROM (SELECT entity, CAST(min(price) FILTER (won) AS DOUBLE) AS figure FROM b1 GROUP BY entity) ORDER BY figure ASC NULLS LAST, entity LIMIT 15")
def t4_reversed(t: Tables):
    g = t.b1().df.groupBy("entity").agg(F.min(F.when(F.col("won"), F.col("price"))).cast("double").alias("figure"))
    return g.orderBy(F.asc_nulls_last("figure"), F.asc("entity")).limit(15)


@bound("WITH g AS (SELECT entity, count(*) AS games FROM b1 WHERE won GROUP BY entity), c AS (SELECT games FROM g ORDER BY games DESC LIMIT 1 OFFSET 19) SELECT games, (SELECT count(*) FROM g WHERE g.games >= c.games) - 20 AS tied_past FROM c")
def t5_tied_past(t: Tables):
    return windows.tied_past_cut(t.b1().df.where("won").groupBy("entity").agg(F.count("*").alias("games")), "games", 20)


@bound("SELECT entity, \"group\", event FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE \"group\" WHEN 'purchase' THEN 1 ELSE 2 END, ts DESC, event DESC) AS rn FROM b2 WHERE \"group\" IN ('purchase', 'signup')) WHERE rn = 1")
def t6_latest_snapshot(t: Tables):
    d = t.b2().df.withColumn("stamp", F.struct("ts", "event"))
    return windows.latest_snapshot(d, ["entity"], "group", "stamp", ["purchase", "signup"]).select("entity", "group", "event")
