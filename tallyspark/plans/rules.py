"""Whole rules of repairs, shots, coverage, presence, ratings and fingerprints on the verification tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import court
from ..operators import aggregate as agg
from ..operators import audit, match, repair, windows
from . import shapes
from .bind import Tables, as_double, bound

# combined rows: an entity's seasons by opponent, and a total row that may be wrong

COMBINED = """p AS (SELECT entity, opponent, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (season_type = 3) AS pending, CAST(sum(price) AS DECIMAL(28,2)) AS price FROM b1 WHERE entity % 5 <> 0 GROUP BY entity, opponent),
w AS (SELECT entity, CAST(NULL AS VARCHAR) AS opponent, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (season_type = 3) AS pending, CAST(sum(price) AS DECIMAL(28,2)) AS price FROM b1 GROUP BY entity),
c AS (SELECT entity, opponent, CASE WHEN opponent IS NULL AND entity % 7 = 0 THEN games + 1 WHEN opponent IS NULL AND entity % 11 = 0 THEN NULL ELSE games END AS games, wins, pending, price FROM (SELECT * FROM p UNION ALL SELECT * FROM w)),
s AS (SELECT entity, CAST(sum(games) AS BIGINT) AS games, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(pending) AS BIGINT) AS pending, sum(price) AS price FROM c WHERE opponent IS NOT NULL GROUP BY entity)"""


@bound(f"""WITH {COMBINED}, m AS (SELECT c.*, s.games AS g, s.wins AS ws, s.pending AS ps, s.price AS pr, c.opponent IS NULL AND s.entity IS NOT NULL AND (c.games IS DISTINCT FROM s.games OR c.wins IS DISTINCT FROM s.wins) AS bad FROM c LEFT JOIN s ON s.entity = c.entity)
SELECT entity, opponent, CASE WHEN bad THEN g ELSE games END AS games, CASE WHEN bad THEN ws ELSE wins END AS wins, CAST(CASE WHEN bad THEN pr ELSE price END AS DOUBLE) AS price, CASE WHEN bad THEN round(100.0 * CAST(ws AS DOUBLE) / CAST(nullif(g, 0) AS DOUBLE), 1) ELSE -1.0 END AS win_pct,
 CASE WHEN bad THEN round(CAST(ws AS DOUBLE) / CAST(nullif(ps, 0) AS DOUBLE), 1) ELSE -1.0 END AS ratio, CASE WHEN NOT bad THEN 30 END AS minutes, bad AS repaired FROM m""")
def r3_combined_rows(t: Tables):
    """Every seventh entity's total counts a game too many and every eleventh's none; those of every fifth have no parts and stay."""
    b = t.b1().df
    sums = lambda d: d.agg(F.count("*").alias("games"), F.count_if("won").alias("wins"), F.count_if(F.col("season_type") == 3).alias("pending"), F.sum("price").cast("decimal(28,2)").alias("price"))
    parts, whole = sums(b.where("entity % 5 <> 0").groupBy("entity", "opponent")), sums(b.groupBy("entity")).withColumn("opponent", F.lit(None).cast("string"))
    total = F.col("opponent").isNull()
    rows = parts.unionByName(whole).withColumn("games", F.when(total & (F.col("entity") % 7 == 0), F.col("games") + 1).when(total & (F.col("entity") % 11 == 0), None).otherwise(F.col("games")))
    rows = rows.withColumns({"win_pct": F.lit(-1.0), "ratio": F.lit(-1.0), "minutes": F.lit(30)})
    derived = {"win_pct": (lambda s: 100.0 * s("wins"), "games", 1), "ratio": (lambda s: s("wins"), "pending", 1)}
    out = repair.rebuild_totals(rows, ["entity"], "opponent", ["games", "wins", "pending", "price"], ["games", "wins"], derived, ["minutes"])
    return as_double(out.withColumn("price", F.col("price").cast("decimal(28,2)"))).drop("pending")


@bound("""WITH st AS (SELECT event, part, CASE WHEN event % 3 = 0 THEN NULL WHEN period = 1 THEN NULL ELSE qty END AS q FROM ln), e AS (SELECT event FROM st GROUP BY event HAVING max(q) IS NULL),
u AS (SELECT event, part AS entity, sum(qty) AS q, NULL AS helped FROM ln SEMI JOIN e USING (event) GROUP BY ALL UNION ALL SELECT event, supp, NULL, sum(qty) FILTER (flag = 'R') FROM ln SEMI JOIN e USING (event) GROUP BY event, supp)
SELECT event, entity, CAST(sum(q) AS DOUBLE) AS q, CAST(sum(helped) AS DOUBLE) AS helped FROM u GROUP BY event, entity""")
def r6_empty_parents(t: Tables):
    """Stored lines of every third order are empty, and each first line; only orders all of whose lines are empty are rebuilt."""
    ln = t.lines_by_event()
    stored = ln.select("event", "part", F.when((F.col("event") % 3 == 0) | (F.col("period") == 1), None).otherwise(F.col("qty")).alias("q"))
    out = repair.rebuild_empty(stored, ln, ["event"], "q", [("part", {"q": F.col("qty")}), ("supp", {"helped": F.when(F.col("flag") == "R", F.col("qty"))})])
    return as_double(out.select("event", "entity", "q", "helped"))


# shots: a line is a shot at (quantity, part modulo 48) in its order's season

SHOTS = """sh AS (SELECT ln.event, season, supp, flag, CAST(qty AS DOUBLE) AS x, CAST(CASE WHEN part % 13 = 0 THEN NULL ELSE part % 48 END AS DOUBLE) AS y, CAST(part % 5 AS INTEGER) AS label, CASE WHEN part % 11 = 0 THEN 'Free Throw - 1 of 2' ELSE 'Jump Shot' END AS kind,
 CASE part % 7 WHEN 0 THEN 'makes Three Point jumper' WHEN 1 THEN 'misses two point shot' WHEN 2 THEN NULL ELSE 'makes jumper' END AS words FROM ln JOIN b1 USING (event)),
sd AS (SELECT *, sqrt((x - 25) * (x - 25) + y * y) AS dist, x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0) AS here, (abs(x - 25) >= 22 AND y <= 8.95) OR sqrt((x - 25) * (x - 25) + y * y) >= 23.5 AS far FROM sh),
sv AS (SELECT *, CAST(CASE WHEN kind ILIKE '%free throw%' THEN 1 WHEN label IN (2, 3) THEN label WHEN words ILIKE '%three point%' THEN 3 WHEN words ILIKE '%two point%' THEN 2 WHEN season = 1995 THEN NULL WHEN season <= 1996 THEN 2 WHEN NOT here THEN NULL WHEN far THEN 3 ELSE 2 END AS INTEGER) AS val FROM sd)"""


def shots(t: Tables):
    p = F.col("part")
    d = t.lines_by_event("event", "part", "supp", "flag", "qty").join(t.b1().df.select("event", "season"), "event")
    d = d.select(
        "event", "season", "supp", "flag", F.col("qty").cast("double").alias("x"), F.when(p % 13 != 0, p % 48).cast("double").alias("y"), (p % 5).cast("int").alias("label"), F.when(p % 11 == 0, "Free Throw - 1 of 2").otherwise("Jump Shot").alias("kind"),
        F.when(p % 7 == 0, "makes Three Point jumper").when(p % 7 == 1, "misses two point shot").when(p % 7 == 2, None).otherwise("makes jumper").alias("words"),
    )
    return d, court.shot_value(F.col("kind"), F.col("label"), F.col("words"), F.col("season"), F.col("x"), F.col("y"), untold=(1995,), told_until=1996)


@bound(f"WITH {SHOTS} SELECT season, flag, count(*) AS shots, count(*) FILTER (here) AS located, count(*) FILTER (here AND far) AS beyond FROM sv GROUP BY ALL")
def s9_arc(t: Tables):
    d, _ = shots(t)
    x, y = F.col("x"), F.col("y")
    here = court.has_position(x, y)
    return d.groupBy("season", "flag").agg(F.count("*").alias("shots"), F.count_if(here).alias("located"), F.count_if(here & court.beyond_arc(x, y)).alias("beyond"))


@bound(f"WITH {SHOTS} SELECT season, val AS value, count(*) AS shots FROM sv GROUP BY ALL")
def s9_shot_value(t: Tables):
    d, value = shots(t)
    return d.groupBy("season", value.alias("value")).agg(F.count("*").alias("shots"))


@bound(f"""WITH {SHOTS}, q AS (SELECT * FROM sv WHERE here AND val IS DISTINCT FROM 1) SELECT 'all' AS part, supp, avg(dist) AS distance, count(*) AS shots, count(DISTINCT event) AS events FROM q GROUP BY supp
UNION ALL SELECT 'threes', supp, avg(dist), count(*), count(DISTINCT event) FROM q WHERE val = 3 GROUP BY supp UNION ALL SELECT 'pinned', supp, avg(dist), count(*), count(DISTINCT event) FROM q WHERE event IN (SELECT event FROM b1 WHERE price > 200000) GROUP BY supp""")
def q39_by_value_and_pinned(t: Tables):
    d, value = shots(t)
    x, y = F.col("x"), F.col("y")
    some = t.b1().df.where("price > 200000").select("event")
    parts = {"all": {}, "threes": {"only": 3}, "pinned": {"events": some}}
    out = None
    for name, more in parts.items():
        one = shapes.shot_distances(d, ["supp"], value, x, y, **more).select(F.lit(name).alias("part"), "supp", "distance", "shots", "events")
        out = one if out is None else out.unionByName(one)
    return out


# audits and names


@bound("""WITH a AS (SELECT season, season_type, count(*) AS orders FROM b1 GROUP BY ALL), l AS (SELECT season, season_type, count(*) AS lines FROM b1 JOIN ln USING (event) GROUP BY ALL), e AS (SELECT season, season_type, orders + 2 AS want FROM a UNION ALL SELECT 2050, 2, 10),
k AS (SELECT coalesce(a.season, e.season) AS season, coalesce(a.season_type, e.season_type) AS season_type, orders, lines, want FROM a FULL JOIN l USING (season, season_type) FULL JOIN e ON e.season = a.season AND e.season_type = a.season_type)
SELECT season, season_type, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, CASE WHEN season_type = 3 THEN 1 ELSE 0 END AS settled, CASE WHEN season % 4 <> 0 THEN want END AS expected,
 CASE WHEN season % 4 <> 0 THEN greatest(want - coalesce(orders, 0) - CASE WHEN season_type = 3 THEN 1 ELSE 0 END, 0) END AS missing, season % 4 = 0 AS complete FROM k""")
def k1_report(t: Tables):
    """Two orders more are expected of each group than there are, of which one will never come in the second type; every fourth season has a marker; a group that nothing has come of is listed."""
    b = t.b1().df
    by = ["season", "season_type"]
    n = b.groupBy(*by).agg(F.count("*").alias("n"))
    later = t.spark.createDataFrame([(2050, 2, 10)], "season long, season_type int, n long")
    settled = n.where("season_type = 3").withColumn("n", F.lit(1).cast("long"))
    out = audit.coverage_report({"orders": b, "lines": b.join(t.lines(), "event")}, by, "orders", n.withColumn("n", F.col("n") + 2).unionByName(later), settled, n.where("season % 4 = 0"))
    return out.withColumn("settled", F.col("settled").cast("int"))


@bound("""WITH n AS (SELECT DISTINCT event, part AS id, split_part(p_name, ' ', 2) AS name FROM ln JOIN part ON p_partkey = part) SELECT x.name, x.id, y.id AS id_2, count(*) AS events FROM n x JOIN n y ON x.event = y.event AND x.name = y.name AND x.id < y.id GROUP BY ALL""")
def k9_identity_pairs(t: Tables):
    dim = t.part.select(F.col("p_partkey").alias("part"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))
    return audit.identity_pairs(t.lines(), dim, "part", "name", ["event"], t.rows("lineitem"))


@bound("""WITH c AS (SELECT DISTINCT substr(c_name, 1, 17) AS mention, c_custkey AS id, c_custkey % 40 + 1 AS subject FROM customer), s AS (SELECT DISTINCT entity, season, "group" FROM b1)
SELECT mention, id, subject FROM c WHERE EXISTS (SELECT 1 FROM s x JOIN s y ON x.season = y.season AND x."group" = y."group" WHERE x.entity = c.id AND y.entity = c.subject)""")
def m3_companions(t: Tables):
    cands = t.customer.select(F.substring("c_name", 1, 17).alias("mention"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40 + 1).alias("subject")).distinct()
    return match.companions(cands, t.b1().df.select(F.col("entity").alias("id"), "season", "group"))


# presence, ratings, fingerprints

PRESENCE = """ev AS (SELECT "group", day, CAST(sum(value) AS DOUBLE) - 300 AS margin FROM b2 GROUP BY ALL), bx AS (SELECT "group", day, entity, CAST(max(value) AS DOUBLE) AS value, bool_or(event % 2 = 0) AS starter FROM b2 WHERE day(day) % 5 <> 0 GROUP BY ALL),
sp AS (SELECT entity, "group", min(day) AS f, max(day) AS l FROM b2 WHERE entity IN (3, 8, 12) GROUP BY ALL), ins AS (SELECT "group", max(f) AS f, min(l) AS l FROM sp GROUP BY "group" HAVING count(*) = 3),
g AS (SELECT ev.*, EXISTS (SELECT 1 FROM bx WHERE bx."group" = ev."group" AND bx.day = ev.day) AS known, (SELECT count(*) FROM bx WHERE bx."group" = ev."group" AND bx.day = ev.day AND (entity = 3 OR entity = 8 AND value >= 20 OR entity = 12 AND starter)) AS held,
 EXISTS (SELECT 1 FROM bx WHERE bx."group" = ev."group" AND bx.day = ev.day AND entity = 7) AS beside, (SELECT max(value) FROM bx WHERE bx."group" = ev."group" AND bx.day = ev.day AND entity = 5) AS own FROM ev JOIN ins ON ins."group" = ev."group" AND day BETWEEN f AND l)"""


@bound(f"""WITH {PRESENCE} SELECT CASE WHEN NOT known THEN 'unknown' WHEN held = 3 THEN 'all' WHEN held = 0 THEN 'none' ELSE 'some' END AS presence, count(*) AS games, count(*) FILTER (margin > 0) AS wins, count(*) FILTER (NOT margin > 0) AS losses, avg(margin) AS avg_margin, count(own) AS subject_games, sum(own) / nullif(count(own), 0) AS avg_value
FROM g WHERE NOT known OR beside GROUP BY presence""")
def q24_presence(t: Tables):
    """Days of a group with one companion who played, one who reached a line and one who started, beside a fourth; every fifth day has no detail."""
    d = t.b2().df
    events = d.groupBy("group", "day").agg((F.sum("value").cast("double") - 300).alias("margin")).withColumn("won", F.col("margin") > 0)
    box = d.where(F.dayofmonth("day") % 5 != 0).groupBy("group", "day", "entity").agg(F.max("value").cast("double").alias("value"), F.bool_or(F.col("event") % 2 == 0).alias("starter"))
    mates = [shapes.Companion(3), shapes.Companion(8, "reached", "value", 20), shapes.Companion(12, "started")]
    spans = [windows.spans(d.where(F.col("entity") == c.entity), ["group"]) for c in mates]
    return shapes.presence(events, box, ["group", "day"], mates, spans, [shapes.Companion(7)], subject=5, figures=["value"])


@bound("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event) AS a, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event DESC) AS z FROM b2)
SELECT 'first' AS which, entity, event, "group" AS category, CAST(value AS DOUBLE) AS value FROM r WHERE a = 1 UNION ALL SELECT 'latest', entity, event, "group", CAST(value AS DOUBLE) FROM r WHERE z = 1""")
def q36_event_ratings(t: Tables):
    d = t.b2().df.withColumnRenamed("group", "category")
    one = lambda which, first: as_double(shapes.event_line(d, "entity", ["category", "value"], ["ts", "event"], first)).select(F.lit(which).alias("which"), "entity", "event", "category", "value")
    return one("first", True).unionByName(one("latest", False))


PRINTS = """pr AS (SELECT entity, "group" AS category, 100.0 * CAST(sum(value) AS DOUBLE) / CAST(nullif(count(*), 0) AS DOUBLE) AS value, count(*) >= 8 AS in_pool FROM b2 GROUP BY ALL)"""


@bound(f"""WITH {PRINTS} SELECT entity, category, value, in_pool, (SELECT count(*) FROM pr p WHERE p.in_pool AND p.category = pr.category AND p.value <= pr.value) / (SELECT CAST(count(*) AS DOUBLE) FROM pr p WHERE p.in_pool AND p.category = pr.category) AS pct,
 (SELECT avg(value) FROM pr p WHERE p.in_pool AND p.category = pr.category) AS pool_mean, (SELECT max(value) FROM pr p WHERE p.in_pool AND p.category = pr.category) AS pool_best, (SELECT count(*) FROM pr p WHERE p.in_pool AND p.category = pr.category) AS pool_size FROM pr""")
def q37_season_pool(t: Tables):
    """Entities with few rows are measured against the pool too, though they are not of it."""
    d = t.b2().df.withColumn("category", F.col("group")).withColumn("one", F.lit(1))
    return shapes.fingerprints(d, "entity", "category", "value", "one", 8)


@bound("""WITH l AS (SELECT entity, event, ts, "group" AS category, CAST(value AS DOUBLE) AS value, value >= 5 AS in_pool FROM b2), z AS (SELECT entity, arg_max(event, struct_pack(t := ts, e := event)) AS event FROM b2 GROUP BY entity)
SELECT l.entity, l.event, category, value, in_pool, (SELECT count(*) FILTER (p.value < l.value) + count(*) FILTER (p.value = l.value) / 2.0 FROM l p WHERE p.in_pool AND p.category = l.category) / (SELECT CAST(count(*) AS DOUBLE) FROM l p WHERE p.in_pool AND p.category = l.category) AS pct,
 (SELECT avg(value) FROM l p WHERE p.in_pool AND p.category = l.category) AS pool_mean, (SELECT max(value) FROM l p WHERE p.in_pool AND p.category = l.category) AS pool_best, (SELECT count(*) FROM l p WHERE p.in_pool AND p.category = l.category) AS pool_size FROM l JOIN z ON z.entity = l.entity AND z.event = l.event""")
def q37_event_pool(t: Tables):
    d = t.b2().df.withColumn("category", F.col("group"))
    return shapes.event_fingerprints(d, "entity", "event", "category", "value", "value", 5, ["ts"])


@bound(f"""WITH {PRINTS}, c AS (SELECT * FROM pr WHERE entity IN (3, 8, 12)), g AS (SELECT category, max(value) - min(value) AS gap, arg_min(entity, struct_pack(v := -value, e := entity)) AS leader FROM c GROUP BY category)
SELECT category, gap, CASE WHEN gap > 0 THEN leader END AS leader, CASE WHEN (SELECT max(gap) FROM g) > 0 THEN gap / (SELECT max(gap) FROM g) ELSE 0.0 END AS share FROM g""")
def q37_comparison_gaps(t: Tables):
    return shapes.comparison_gaps(q37_season_pool(t), [3, 8, 12], "entity", "category")
