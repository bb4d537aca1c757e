"""The report shapes bound to the verification tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import distance
from ..operators import aggregate as agg
from ..operators import joins, relation, windows
from . import shapes
from .bind import Tables, bound
from .figures import cut_sql, runs_sql

PRICE = "CAST(sum(price) AS DOUBLE)"
AVG = "CAST(sum(price) AS DOUBLE) / nullif(count(price), 0)"


@bound(f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event DESC) AS rn FROM b1 WHERE won) SELECT event, entity, day, {PRICE.replace('sum(price)', 'sum(price) OVER (PARTITION BY entity)')} / count(price) OVER (PARTITION BY entity) AS shown_price FROM l WHERE rn <= 10")
def q1_game_log(t: Tables):
    return shapes.game_log(t.b1().where("won"), ["price"], 10, ["event", "entity", "day"])


@bound(f"SELECT entity, season, count(*) AS games, {AVG} AS avg_price FROM b1 WHERE opponent = '2-HIGH' GROUP BY ALL")
def q2_player_line(t: Tables):
    return shapes.player_line(t.b1().opponent("2-HIGH"), ["price"], ["entity", "season"])


@bound(cut_sql("SELECT entity, count(*) AS games FROM b1 WHERE price >= 200000 GROUP BY entity", "games", 15, "entity, games, (SELECT count(*) FROM f) AS pool"))
def q3_games_counted(t: Tables):
    return shapes.games_counted(t.b1().line("price", ">=", 200000), 15)


@bound("WITH r AS (SELECT *, rank() OVER (ORDER BY price DESC) AS rank, count(*) OVER (PARTITION BY price) AS ties FROM b1 WHERE season = 1998) SELECT event, entity, CAST(price AS DOUBLE) AS price, rank FROM r WHERE rank <= 20 AND (rank = 1 OR rank + ties - 1 <= 30) ORDER BY rank, day, event LIMIT 30")
def q4_single_game_high(t: Tables):
    top = shapes.single_game_high(t.b1().span(season=1998), "price", 20, ["event", "entity", "price"])
    return top.withColumn("price", F.col("price").cast("double"))


@bound(f"SELECT CASE WHEN q IS NULL THEN 'blank' WHEN q >= 100 THEN 'reached' ELSE 'short' END AS line, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, {AVG} AS avg_margin FROM b1 LEFT JOIN (SELECT event, sum(qty) AS q FROM ln GROUP BY event) USING (event) GROUP BY line")
def q5_record_when(t: Tables):
    b = t.b1()
    q = t.lines().groupBy("event").agg(F.sum("qty").alias("q"))
    return shapes.record_when(b.with_df(b.df.join(q, "event", "left")), F.col("q") >= 100, "price")


HALVES = {"outcome": {"wins": "won", "losses": "NOT won"}, "priority": {"urgent": "opponent = '1-URGENT'", "other": "opponent <> '1-URGENT'"}, "month": {f"{m:02d}": f"month(day) = {m}" for m in range(1, 13)}, "never": {"none": "price < 0"}}


@bound("WITH x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{h}' AS half, count(*) AS games, {AVG} AS avg_price FROM b1 WHERE {c}" for k, hs in HALVES.items() for h, c in hs.items()) + ") SELECT * FROM x")
def q6_splits(t: Tables):
    return shapes.splits(t.b1(), {k: {h: F.expr(c) for h, c in hs.items()} for k, hs in HALVES.items()}, ["price"])


@bound(runs_sql("b1", "entity", "price >= 100000") + " ORDER BY length DESC, first_day, entity LIMIT 25")
def q7_streak(t: Tables):
    return windows.longest_runs(t.b1().df, ["entity"], ["ts", "event"], F.col("price") >= 100000, limit=25)


@bound("WITH x AS (SELECT day, sum(value) AS f, bool_or(won) AS w FROM b2 WHERE entity = 3 GROUP BY day), y AS (SELECT day, sum(value) AS f, bool_or(won) AS w FROM b2 WHERE entity = 8 GROUP BY day) SELECT count(*) AS met, CAST(sum(x.f) AS DOUBLE) / count(x.f) AS avg_1, CAST(sum(y.f) AS DOUBLE) / count(y.f) AS avg_2, count(*) FILTER (x.w) AS wins_1, count(*) FILTER (y.w) AS wins_2 FROM x JOIN y USING (day)")
def q8_matchup(t: Tables):
    return shapes.matchup(t.b2(), 3, 8, ["day"], "value")


@bound(f"""WITH g AS (SELECT entity, {AVG} AS figure, count(price) AS sample FROM b1 WHERE season = 1997 GROUP BY entity), m AS (SELECT max(sample) AS most FROM g),
q AS (SELECT g.* FROM g, m WHERE sample >= CASE WHEN most >= 4 THEN 4 ELSE CAST(ceil(most / 2.0) AS BIGINT) END),
r AS (SELECT *, rank() OVER (ORDER BY figure DESC) AS rank, count(*) OVER (PARTITION BY figure) AS ties FROM q), k AS (SELECT * FROM r WHERE rank <= 10 AND (rank = 1 OR rank + ties - 1 <= 20) ORDER BY rank, entity LIMIT 20)
SELECT entity, figure, sample, rank, c_name FROM k JOIN customer ON c_custkey = entity""")
def q9_game_ranking(t: Tables):
    names = t.customer.select(F.col("c_custkey").alias("entity"), "c_name")
    return shapes.game_ranking(t.b1().span(season=1997), "price", 10, 4, names)


SEAS = f"s AS (SELECT entity, season, count(*) AS games, {PRICE} AS total, {AVG} AS average FROM b1 GROUP BY entity, season)"


@bound(f"WITH {SEAS} SELECT * FROM s WHERE season = 1998 AND games >= 3 ORDER BY average DESC, entity LIMIT 25")
def q10_leaderboard(t: Tables):
    return shapes.leaderboard(shapes.season_table(t.b1(), "price"), "average", 1998, 3, 25)


@bound("SELECT entity, CAST(sum(price) AS DOUBLE) / count(*) AS figure, count(*) AS games, count(DISTINCT season) AS seasons FROM b1 GROUP BY entity HAVING count(*) >= 10 ORDER BY figure DESC, entity LIMIT 25")
def q11_career_leaderboard(t: Tables):
    b = t.b1().df.groupBy("entity", "season").agg(F.count("*").alias("games"), F.sum("price").alias("total"))
    return shapes.career_leaderboard(b, 25, 10)


@bound("SELECT season, count(*) AS entities FROM (SELECT entity, season FROM b1 GROUP BY ALL HAVING sum(price) >= 400000) GROUP BY season")
def q12_entities_counted(t: Tables):
    return shapes.entities_counted(t.b1(), "price", 400000)


@bound(cut_sql("SELECT entity, count(*) AS seasons FROM (SELECT entity, season FROM b1 GROUP BY entity, season HAVING sum(price) >= 300000) GROUP BY entity", "seasons", 300, "entity, seasons", 200))
def q13_seasons_counted(t: Tables):
    g = agg.groups_counted(t.b1().df, ["entity", "season"], ["entity"], F.sum("price") >= 300000)
    return windows.top_with_ties(g, "seasons", 300, 200, order=["entity"])


@bound(f"WITH {SEAS} SELECT entity, 1999 AS season, games, total, average, games * 1.0 / (SELECT max(games) FROM s WHERE season = 1999) AS share FROM s WHERE season = 1999")
def q14_season_line(t: Tables):
    s = shapes.season_table(t.b1().span(season=1999), "price")
    most = F.broadcast(s.agg(F.max("games").alias("_m")))
    return s.join(most).select("entity", F.lit(1999).alias("season"), "games", "total", "average", (F.col("games").cast("double") / F.col("_m")).alias("share"))


@bound(f"SELECT entity, season, count(*) AS games, {AVG} AS average FROM b1 GROUP BY GROUPING SETS ((entity, season), (entity))")
def q15_history(t: Tables):
    return shapes.history(t.b1(), "price")


@bound("SELECT season, " + ", ".join(f"CAST(sum(price) FILTER (entity = {e}) AS DOUBLE) / nullif(count(price) FILTER (entity = {e}), 0) AS e{e}" for e in (1, 2, 5)) + " FROM b1 WHERE entity IN (1, 2, 5) GROUP BY season")
def q16_compare(t: Tables):
    return shapes.compare(t.b1(), [1, 2, 5], "price")


@bound("""WITH l AS (SELECT event, CAST(sum(qty) FILTER (period IN (1, 2)) AS DOUBLE) AS figure, CAST(count(*) AS DOUBLE) AS rebuilt FROM ln GROUP BY event), k AS (SELECT event, CAST(count(DISTINCT part) AS DOUBLE) AS stored FROM ln GROUP BY event),
r AS (SELECT b1.event, entity, figure, coalesce(stored, 0) - coalesce(rebuilt, 0) AS gap FROM b1 LEFT JOIN l ON l.event = b1.event LEFT JOIN k ON k.event = b1.event), bad AS (SELECT entity FROM r GROUP BY entity HAVING count(*) FILTER (gap <> 0) > 0.1 * count(*))
SELECT event, entity, figure, gap FROM r WHERE entity NOT IN (SELECT entity FROM bad)""")
def q17_period_log(t: Tables):
    ln = t.lines()
    stored = ln.groupBy("event").agg(F.count_distinct("part").cast("double").alias("stored"))
    parents = t.b1().df.select("event", "entity").join(stored, "event", "left").withColumn("stored", F.coalesce("stored", F.lit(0.0)))
    return shapes.period_log(parents, ln, [1, 2], F.col("qty"), "stored", 0.1)


@bound("SELECT supp, " + ", ".join(f"CAST(sum(qty) FILTER (period = {p}) AS DOUBLE) AS p{p}" for p in range(1, 5)) + " FROM ln WHERE period <= 4 GROUP BY supp")
def q18_quarters(t: Tables):
    return agg.by_period(t.lines(), ["supp"], "period", [1, 2, 3, 4], F.col("qty"))


@bound("WITH g AS (SELECT part, count(*) AS checked, CAST(sum(qty) AS DOUBLE) AS figure FROM ln WHERE period IN (1, 2, 3, 4) GROUP BY part HAVING count(DISTINCT period) = 4) SELECT part, checked, figure, (SELECT CAST(sum(checked) AS BIGINT) FROM g) AS pool_checked FROM g ORDER BY figure DESC, part LIMIT 20")
def q19_period_ranking(t: Tables):
    return shapes.period_ranking(t.lines(), "part", [1, 2, 3, 4], F.col("qty"), 20, every=True)


SIDES = """sd AS (SELECT event, c_nationkey AS team, s_nationkey AS opp, amount, true AS home, flag = 'R' AS won FROM ln JOIN orders ON o_orderkey = event JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = supp
 UNION ALL SELECT event, s_nationkey, c_nationkey, amount, false, flag <> 'R' FROM ln JOIN orders ON o_orderkey = event JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = supp)"""


def sides(t: Tables):
    ln = t.lines().join(t.b1().df.select("event", "group"), "event").join(t.supplier.select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").alias("place")), "supp")
    won = F.col("flag") == "R"
    home = {"team": F.col("group"), "opp": F.col("place"), "home": F.lit(True), "won": won}
    return joins.both_sides(ln, ["event", "amount"], home, {"team": F.col("place"), "opp": F.col("group"), "home": F.lit(False), "won": ~won})


@bound(f"WITH {SIDES} SELECT team, opp, home, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, CAST(sum(amount) AS DOUBLE) AS figure FROM sd GROUP BY ALL")
def q20_team_log(t: Tables):
    return shapes.team_log(sides(t), ["team", "opp", "home"], "amount")


@bound("WITH g AS (SELECT event, CAST(sum(amount * discount) AS DOUBLE) * 100 / nullif(CAST(sum(amount) AS DOUBLE), 0) AS figure FROM ln GROUP BY event HAVING count(*) >= 4), r AS (SELECT *, rank() OVER (ORDER BY figure DESC) AS rank, count(*) OVER (PARTITION BY figure) AS ties FROM g) SELECT event, figure, rank FROM r WHERE rank <= 10 AND (rank = 1 OR rank + ties - 1 <= 20) ORDER BY rank, event LIMIT 20")
def q21_team_high(t: Tables):
    d = t.lines().withColumn("less", F.col("amount") * F.col("discount"))
    g = d.groupBy("event").agg(agg.rate("less", "amount").alias("figure"), F.count("*").alias("n")).where("n >= 4").drop("n")
    return windows.top_with_ties(g, "figure", 10, order=["event"])


@bound(f"WITH {SIDES} SELECT team, CASE WHEN team = opp THEN 'neutral' WHEN home THEN 'home' ELSE 'away' END AS place, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM sd GROUP BY ALL")
def q22_team_splits(t: Tables):
    return shapes.team_splits(sides(t))


@bound(f"WITH {SIDES} SELECT team, CASE WHEN amount >= 40000 THEN 'reached' ELSE 'short' END AS line, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM sd GROUP BY ALL")
def q23_team_record_when(t: Tables):
    return shapes.team_record_when(sides(t), "amount", 40000)


@bound("""WITH s1 AS (SELECT "group", min(day) AS f, max(day) AS l FROM b2 WHERE entity = 3 GROUP BY "group"), s2 AS (SELECT "group", min(day) AS f, max(day) AS l FROM b2 WHERE entity = 8 GROUP BY "group"),
e AS (SELECT b2.*, (SELECT count(*) > 0 FROM b2 x WHERE x.entity = 3 AND x."group" = b2."group" AND x.day = b2.day) AS a, (SELECT count(*) > 0 FROM b2 x WHERE x.entity = 8 AND x."group" = b2."group" AND x.day = b2.day) AS b
 FROM b2 JOIN s1 ON s1."group" = b2."group" AND day BETWEEN s1.f AND s1.l JOIN s2 ON s2."group" = b2."group" AND day BETWEEN s2.f AND s2.l)
SELECT CASE WHEN a AND b THEN 'with all' WHEN NOT a AND NOT b THEN 'without any' ELSE 'with some' END AS presence, count(*) AS games, count(*) FILTER (big) AS wins, count(*) FILTER (NOT big) AS losses FROM (SELECT *, value > 20 AS big FROM e) GROUP BY presence""")
def q24_with_without(t: Tables):
    d = t.b2().df
    who = [d.where(F.col("entity") == e) for e in (3, 8)]
    return shapes.with_without(d.withColumn("won", F.col("value") > 20), who, [windows.spans(w, ["group"]) for w in who])


@bound(runs_sql("b1", '"group", season', "won"))
def q25_team_streak(t: Tables):
    return windows.longest_runs(t.b1().df, ["group", "season"], ["ts", "event"], F.col("won"))


@bound(f"WITH {SIDES} SELECT team, opp, count(*) AS met, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, CAST(sum(amount) AS DOUBLE) AS figure FROM sd WHERE team < opp GROUP BY ALL")
def q26_head_to_head(t: Tables):
    return shapes.head_to_head(sides(t), "amount")


@bound('SELECT "group", season, month(day)::INTEGER AS month, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM b1 GROUP BY ALL')
def q27_team_record(t: Tables):
    return shapes.team_record(t.b1().with_df(t.b1().df.withColumn("month", F.month("day"))), ["group", "season", "month"])


@bound(f'SELECT "group", count(*) AS games, count(p) AS counted, CAST(sum(p) AS DOUBLE) AS total FROM (SELECT "group", CASE WHEN season_type = 2 THEN price END AS p FROM b1) GROUP BY "group"')
def q28_team_total(t: Tables):
    return shapes.team_total(t.b1(), F.when(F.col("season_type") == 2, F.col("price")), ["group"])


@bound('SELECT "group", count(DISTINCT event) AS games, CAST(sum(qty) FILTER (period <= 2) AS DOUBLE) AS half, CAST(sum(qty) AS DOUBLE) AS whole FROM ln JOIN b1 USING (event) GROUP BY "group"')
def q29_team_period(t: Tables):
    d = t.lines().join(t.b1().df.select("event", "group"), "event")
    return shapes.team_period(d, ["group"], "event", F.col("period") <= 2, "qty")


TEAM = f'tm AS (SELECT "group", {AVG} AS pace, CAST(count(*) FILTER (won) AS DOUBLE) / count(*) AS winning, CAST(count(*) FILTER (season_type = 3) AS DOUBLE) / count(*) AS pending FROM b1 GROUP BY "group")'


def team(t: Tables):
    c = lambda x: F.count_if(x).cast("double") / F.count("*")
    return t.b1().df.groupBy("group").agg(agg.mean("price").alias("pace"), c(F.col("won")).alias("winning"), c(F.col("season_type") == 3).alias("pending"))


@bound(f"""WITH {TEAM}, u AS (SELECT "group", 'pace' AS metric, pace AS value, pace AS v FROM tm UNION ALL SELECT "group", 'winning', winning, winning FROM tm UNION ALL SELECT "group", 'pending', pending, -pending FROM tm)
SELECT "group", metric, value, rank() OVER (PARTITION BY metric ORDER BY v DESC) AS rank FROM u""")
def q30_team_line(t: Tables):
    return shapes.ranked_metric(team(t), {"pace": True, "winning": True, "pending": False}, "group")


@bound(f'WITH {TEAM} SELECT "group", winning, rank() OVER (ORDER BY winning DESC) AS rank FROM tm')
def q31_team_ranking(t: Tables):
    return windows.competition_rank(team(t).select("group", "winning"), "winning")


@bound(f"""WITH p AS (SELECT "group", season, count(*) AS played, {AVG} AS average FROM b1 GROUP BY "group", season), l AS (SELECT "group", season, count(DISTINCT entity) AS listed FROM b1 GROUP BY "group", season)
SELECT "group", season, played, CASE WHEN listed = played THEN average END AS average FROM p JOIN l USING ("group", season)""")
def q32_team_history(t: Tables):
    return shapes.team_history(t.b1(), "price")


@bound('SELECT "group", CAST(sum(w) AS BIGINT) AS wins, CAST(sum(l) AS BIGINT) AS losses FROM (SELECT "group", season, count(*) FILTER (won) AS w, count(*) FILTER (NOT won) AS l FROM b1 GROUP BY "group", season) GROUP BY "group"')
def q33_standings(t: Tables):
    text = F.concat_ws("-", F.count_if("won"), F.count_if(~F.col("won")))
    rows = t.b1().df.groupBy("group", "season").agg(text.alias("record"))
    return shapes.standings(rows, "record").groupBy("group").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


@bound("""SELECT n_name AS name, coalesce(w, 0) AS wins, coalesce(l, 0) AS losses FROM nation LEFT JOIN (SELECT "group", count(*) FILTER (won) AS w, count(*) FILTER (NOT won) AS l FROM b1 WHERE day >= DATE '2001-07-30' GROUP BY "group") ON "group" = n_nationkey""")
def q34_records_since(t: Tables):
    groups = t.nation.select(F.col("n_nationkey").alias("group"), F.col("n_name").alias("name"))
    return shapes.records_since(groups, t.b1().calendar("since", "2001-07-30")).select("name", "wins", "losses")


@bound("""WITH s AS (SELECT entity, event, value, row_number() OVER (PARTITION BY entity ORDER BY CASE "group" WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, ts DESC, event DESC) AS rn FROM b2 WHERE "group" IN ('purchase', 'signup', 'view'))
SELECT entity, event, CAST(value AS DOUBLE) AS value, rank() OVER (ORDER BY value DESC) AS rank FROM s WHERE rn = 1""")
def q35_outlook(t: Tables):
    d = t.b2().df.withColumn("stamp", F.struct("ts", "event"))
    s = windows.latest_snapshot(d, ["entity"], "group", "stamp", ["purchase", "signup", "view"])
    return windows.competition_rank(s.select("entity", "event", F.col("value").cast("double").alias("value")), "value")


@bound("""SELECT entity, "group" AS category, n, total, rank() OVER (PARTITION BY entity ORDER BY total DESC) AS rank FROM (SELECT entity, "group", count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM b2 GROUP BY ALL)""")
def q36_ratings(t: Tables):
    g = t.b2().df.groupBy("entity", F.col("group").alias("category")).agg(F.count("*").alias("n"), agg.total("value").alias("total"))
    return windows.competition_rank(g, "total", key=["entity"])


POOL = 'p AS (SELECT entity, "group" AS category, CAST(sum(value) AS DOUBLE) / count(value) AS value FROM b2 GROUP BY ALL HAVING count(*) >= 8)'


@bound(f"WITH {POOL} SELECT entity, category, value, cume_dist() OVER (PARTITION BY category ORDER BY value) AS pct, max(value) OVER (PARTITION BY category) AS pool_best, count(*) OVER (PARTITION BY category) AS pool_size FROM p")
def q37_fingerprint(t: Tables):
    d = t.b2().df.withColumn("category", F.col("group")).withColumn("one", F.lit(1))
    return shapes.fingerprint(d, "entity", "category", "value", "one", 8)


@bound("WITH g AS (SELECT entity, CAST(sum(value) AS DOUBLE) / count(value) - 25 AS v FROM b2 GROUP BY entity), m AS (SELECT min(v) AS lo, max(v) AS hi FROM g) SELECT entity, CASE WHEN v >= 0 THEN 0.5 + (CASE WHEN hi > 0 THEN v / hi ELSE 0 END) / 2 ELSE 0.5 + (CASE WHEN lo < 0 THEN -(v / lo) ELSE 0 END) / 2 END AS radius FROM g, m")
def q38_radius(t: Tables):
    g = t.b2().df.groupBy("entity").agg((agg.mean("value") - 25).alias("v"))
    m = F.broadcast(g.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    return g.join(m).select("entity", shapes.radius(F.col("v"), F.col("lo"), F.col("hi")).alias("radius"))


@bound("SELECT flag, count(*) AS shots, count(DISTINCT event) AS events, avg(sqrt(CAST(qty AS DOUBLE) * CAST(qty AS DOUBLE) + CAST(period AS DOUBLE) * CAST(period AS DOUBLE))) AS distance FROM ln WHERE NOT (qty = 0 AND period = 0) GROUP BY flag")
def q39_shot_distance(t: Tables):
    s = relation.located(t.lines(), "qty", "period")
    d = distance(F.col("qty").cast("double"), F.col("period").cast("double"))
    return s.groupBy("flag").agg(F.count("*").alias("shots"), F.count_distinct("event").alias("events"), F.avg(d).alias("distance"))


def shot_columns() -> list:
    return [F.col("period"), F.col("qty").cast("double").alias("qty"), (F.col("flag") == "R").alias("made")]


@bound("SELECT event, period, CAST(qty AS DOUBLE) AS qty, flag = 'R' AS made, count(*) OVER (PARTITION BY event) AS total, count(*) FILTER (flag = 'R') OVER (PARTITION BY event) AS good FROM ln WHERE NOT (qty = 0 AND period = 0)")
def q40_located_shots(t: Tables):
    shown = shapes.located_shots(relation.located(t.lines(), "qty", "period"), "event", F.col("flag") == "R", ["period", "part", "supp"], shot_columns())
    return shown.drop("place", "unknown")


@bound("SELECT event, period, CAST(qty AS DOUBLE) AS qty, flag = 'R' AS made, row_number() OVER (PARTITION BY event ORDER BY period, part, supp) AS place, count(*) OVER (PARTITION BY event) AS total, count(*) FILTER (flag = 'R') OVER (PARTITION BY event) AS good, count(*) FILTER (flag = 'N') OVER (PARTITION BY event) AS unknown FROM ln WHERE NOT (qty = 0 AND period = 0)")
def q40_all_located_shots(t: Tables):
    made = F.when(F.col("flag") != "N", F.col("flag") == "R")
    return shapes.located_shots(relation.located(t.lines(), "qty", "period"), "event", made, ["period", "part", "supp"], shot_columns())


@bound("""WITH f AS (SELECT * FROM (VALUES ('orders', 1996, 2001), ('events', 1998, 1999)) v("table", first, part)), q AS (SELECT DISTINCT season, CASE WHEN season % 2 = 0 THEN 'both' ELSE 'orders' END AS question FROM b1)
SELECT question, season, max(first) AS floor, bool_or(season = part) AS partial, season < max(first) AS refused FROM q JOIN f ON f."table" = 'orders' OR q.question = 'both' GROUP BY question, season""")
def q41_coverage_gate(t: Tables):
    floors = t.spark.createDataFrame([("orders", 1996, [2001]), ("events", 1998, [1999])], "table string, first int, partial array<bigint>")
    even = F.col("season") % 2 == 0
    asked = t.b1().df.select("season").distinct().select("season", F.when(even, "both").otherwise("orders").alias("question"), F.when(even, F.array(F.lit("orders"), F.lit("events"))).otherwise(F.array(F.lit("orders"))).alias("tables"))
    return shapes.coverage_gate(asked, floors)


@bound("SELECT entity, min(season) AS first, max(season) AS last, count(*) AS games FROM b1 WHERE entity NOT IN (SELECT entity FROM b1 WHERE season = 1997 AND won) GROUP BY entity")
def q42_redirect(t: Tables):
    b = t.b1()
    return shapes.redirect(b, b.span(season=1997).where("won"))


@bound("SELECT season, count(*) AS games, count(*) FILTER (season_type = 3) AS rebuilt, count(*) FILTER (price > 450000) AS unread FROM b1 GROUP BY season")
def q43_unread_counts(t: Tables):
    b = t.b1()
    d = b.with_df(b.df.withColumn("p", F.when(F.col("price") <= 450000, F.col("price"))))
    return shapes.unread_counts(d, "p", F.col("season_type") == 3, ["season"])


