"""Derived metrics, scalar functions, load steps and whole-document flattening on the verification tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import match, relation, repair, windows
from ..sources import flatten, load
from ..sources.store import Store
from .bind import Tables, bound
from .loads import _folder

# box lines: an order is a game, its return flags are sides

BOX = """bx AS (SELECT ln.event, season, season_type, flag AS team, part AS entity, CAST(qty AS BIGINT) AS minutes, CAST(period + 5 AS BIGINT) AS fga, CAST(period AS BIGINT) AS fgm, CAST(period // 2 AS BIGINT) AS fg3m,
 CAST(supp % 4 AS BIGINT) AS fta, CAST(supp % 2 AS BIGINT) AS ftm, CAST(floor(amount / 1000) AS BIGINT) AS points, part % 3 AS oreb, part % 5 AS dreb, supp % 7 AS ast, supp % 3 AS stl, part % 2 AS blk, CAST(period % 6 AS BIGINT) AS fouls, part % 4 AS tov
 FROM ln JOIN b1 ON b1.event = ln.event)"""
# fixed values: how a line's figures weigh in its score, in tenths, and a free throw in the plays that it uses
SCORE = "list_inner_product([points, fgm, fga, fta - ftm, oreb, dreb, stl, ast, blk, fouls, tov]::DOUBLE[], [10, 4, -7, -4, 7, 3, 10, 7, 7, -4, -10]::DOUBLE[]) / 10"
#: Lines with their tries (shots and trips to the free-throw line), the plays that they used, and both their side's plays and minutes.
PLAYED = """us AS (SELECT *, CAST(fga + 0.44 * fta AS DOUBLE) AS tries, CAST(fga + 0.44 * fta + tov AS DOUBLE) AS used FROM bx),
sd AS (SELECT *, sum(used) OVER side AS side_used, CAST(sum(minutes) OVER side AS DOUBLE) AS side_minutes FROM us WINDOW side AS (PARTITION BY event, season, team))"""


def box(t: Tables) -> DataFrame:
    d = t.lines_by_event("event", "part", "supp", "period", "qty", "amount", "flag").join(t.b1().df.select("event", "season", "season_type"), "event")
    c = F.col
    made = {
        "minutes": c("qty"), "fga": c("period") + 5, "fgm": c("period"), "fg3m": F.floor(c("period") / 2), "fta": c("supp") % 4, "ftm": c("supp") % 2, "points": F.floor(c("amount") / 1000), "oreb": c("part") % 3,
        "dreb": c("part") % 5, "ast": c("supp") % 7, "stl": c("supp") % 3, "blk": c("part") % 2, "fouls": c("period") % 6, "tov": c("part") % 4,
    }
    return d.select("event", "season", "season_type", c("flag").alias("team"), c("part").alias("entity"), "period", *[x.cast("long").alias(n) for n, x in made.items()])


@bound(f"""WITH {BOX.replace("flag AS team,", "flag AS team, period,")}, {PLAYED}
SELECT event, period, points / nullif(2 * tries, 0) AS true_shooting, (fgm + fg3m / 2.0) / nullif(CAST(fga AS DOUBLE), 0) AS effective_shooting,
 20 * (used / nullif(side_used, 0)) / nullif(minutes / side_minutes, 0) AS usage, {SCORE} AS line_score FROM sd""")
def r4_box_metrics(t: Tables):
    return repair.advanced_game(box(t), ["event", "season", "team"]).select("event", "period", "true_shooting", "effective_shooting", "usage", "line_score")


@bound(f"""WITH {BOX}, {PLAYED}
SELECT entity, season, season_type, count(points) AS lines, CAST(sum(fga) AS BIGINT) AS attempts, sum(fga) + 0.44::DOUBLE * sum(fta) AS tries, sum(points) / nullif(2 * (sum(fga) + 0.44::DOUBLE * sum(fta)), 0) AS true_shooting,
 sum(fgm + fg3m / 2.0) / nullif(CAST(sum(fga) AS DOUBLE), 0) AS effective_shooting, 20 * sum(used * side_minutes) / nullif(sum(minutes * side_used), 0) AS usage, avg({SCORE}) AS mean_line_score
FROM sd GROUP BY entity, season, season_type""")
def r5_season_metrics(t: Tables):
    return repair.advanced_season(box(t), ["event", "season", "team"], ["season", "season_type", "entity"])


@bound(f"""WITH {BOX}, s AS (SELECT team, season, CAST(sum(points) AS DOUBLE) AS p, CAST(sum(minutes) AS DOUBLE) AS a, count(DISTINCT event) AS g, CAST(sum(fga) - sum(oreb) + sum(tov) + 0.44 * sum(fta) AS DOUBLE) AS n FROM bx GROUP BY ALL)
SELECT team, season, n AS possessions, n / g AS pace, 100 * p / n AS offensive_rating, 100 * a / n AS defensive_rating, 100 * (p - a) / n AS net_rating FROM s""")
def s14_ratings(t: Tables):
    s = box(t).groupBy("team", "season").agg(*[F.sum(c).cast("double").alias(c) for c in ("points", "minutes", "fga", "oreb", "tov", "fta")], F.count_distinct("event").alias("games"))
    used = scalar.possessions(F.col("fga"), F.col("oreb"), F.col("tov"), F.col("fta"))
    return s.withColumn("possessions", used).withColumns(scalar.ratings(F.col("points"), F.col("minutes"), F.col("possessions"), F.col("games"))).select("team", "season", "possessions", "pace", "offensive_rating", "defensive_rating", "net_rating")


@bound("SELECT CAST(CASE WHEN qty >= 10 THEN 1 ELSE 0 END + CASE WHEN period >= 10 THEN 1 ELSE 0 END + CASE WHEN part >= 10 THEN 1 ELSE 0 END AS INTEGER) AS reached, count(*) AS games FROM ln GROUP BY reached")
def n21_tens(t: Tables):
    return t.lines().groupBy(relation.tens(["qty", "period", "part"]).cast("int").alias("reached")).agg(F.count("*").alias("games"))


@bound("""WITH r AS (SELECT event, opponent, "group" % 2 AS c, dense_rank() OVER (PARTITION BY season, "group" ORDER BY day) AS round FROM b1)
SELECT opponent, CASE WHEN c = 0 THEN 'east' ELSE 'west' END AS conference, count(*) AS games FROM r WHERE round = 2 AND c = 1 GROUP BY ALL""")
def n17_round(t: Tables):
    b = t.b1()
    conference = F.when(F.col("group") % 2 == 0, "east").otherwise("west").alias("conference")
    rounds = b.df.select("event", conference, F.dense_rank().over(Window.partitionBy("season", "group").orderBy("day")).alias("round"))
    return b.in_round(rounds, ["event"], 2, "west").df.groupBy("opponent", conference).agg(F.count("*").alias("games"))


@bound("""WITH p AS (SELECT event, season, ts, CASE WHEN event % 10 = 0 THEN 1 END AS given, least("group", o) AS x, greatest("group", o) AS y FROM (SELECT *, CAST(substr(opponent, 1, 1) AS INTEGER) AS o FROM b1))
SELECT event, coalesce(given, row_number() OVER (PARTITION BY season, x, y ORDER BY ts, event)) AS game_no FROM p""")
def r10_given_numbers(t: Tables):
    b = t.b1().df.withColumns({"other": F.substring("opponent", 1, 1).cast("int"), "given": F.when(F.col("event") % 10 == 0, 1)})
    return repair.number_series(b, "group", "other", ["ts", "event"], ["season"], "given").select("event", "game_no")


@bound("""WITH s AS (SELECT entity, opponent, min(day) AS a, max(day) AS b FROM b1 GROUP BY ALL)
SELECT x.entity, x.opponent, greatest(x.a, y.a) AS first_day, least(x.b, y.b) AS last_day FROM s x JOIN s y ON y.entity = x.entity + 1 AND y.opponent = x.opponent AND x.a <= y.b AND y.a <= x.b""")
def w6_all_overlaps(t: Tables):
    s = windows.spans(t.b1().df, ["entity", "opponent"])
    return windows.overlaps(s, s.withColumn("entity", F.col("entity") - 1), ["entity", "opponent"])


# scalar functions


@bound("SELECT CAST(year(ts) + CASE WHEN month(ts) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS season, count(*) AS games FROM b1 GROUP BY ALL")
def s2_season(t: Tables):
    return t.b1().df.groupBy(scalar.season_of(F.col("ts")).alias("season")).agg(F.count("*").alias("games"))


@bound("SELECT isodow(day) AS weekday, CAST(make_date(year(day), month(day), 1) AS DATE) AS month, count(*) AS games FROM b1 WHERE day BETWEEN DATE '1996-02-01' AND DATE '1996-02-01' + INTERVAL 89 DAY GROUP BY ALL")
def s3_date_parts(t: Tables):
    day = F.col("day")
    rows = t.b1().df.where(day.between(F.lit("1996-02-01").cast("date"), F.date_add(F.lit("1996-02-01").cast("date"), 89)))
    return rows.groupBy((F.weekday(day) + 1).cast("long").alias("weekday"), F.make_date(F.year(day), F.month(day), F.lit(1)).alias("month")).agg(F.count("*").alias("games"))


@bound("""SELECT p_partkey AS part, coalesce(p_type = 'PROMO' OR (p_name ILIKE '%WIDGET%' AND p_name NOT ILIKE 'cold%'), false) AS one, coalesce(p_type ILIKE 'econ%' OR p_type ILIKE '%ard', false) AS two FROM part""")
def s4_class_tests(t: Tables):
    one = (F.col("p_type") == "PROMO") | scalar.of_class(F.col("p_name"), ("%WIDGET%",), ("cold%",))
    return t.part.select(F.col("p_partkey").alias("part"), F.coalesce(one, F.lit(False)).alias("one"), scalar.of_class(F.col("p_type"), ("econ%", "%ard")).alias("two"))


@bound("SELECT p_partkey AS part, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[3] AS third, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n FROM part")
def s5_split_index(t: Tables):
    parts = F.split("p_name", " ")
    return t.part.select(F.col("p_partkey").alias("part"), F.try_element_at(parts, F.lit(1)).alias("first"), F.try_element_at(parts, F.lit(3)).alias("third"), F.size(parts).cast("long").alias("n"))


@bound("SELECT p_partkey AS part, TRY_CAST(trim(replace(substr(p_brand, 6), '#', ' ')) AS BIGINT) AS brand, TRY_CAST(p_name AS BIGINT) AS none, CAST(p_size AS VARCHAR) AS size FROM part")
def s7_casts(t: Tables):
    brand = F.trim(F.replace(F.expr("substring(p_brand, 6)"), F.lit("#"), F.lit(" "))).try_cast("long")
    return t.part.select(F.col("p_partkey").alias("part"), brand.alias("brand"), F.col("p_name").try_cast("long").alias("none"), F.col("p_size").cast("string").alias("size"))


@bound("SELECT event, period, nullif(CAST(qty AS BIGINT), 1) AS some, coalesce(nullif(CAST(qty AS BIGINT), 1), 0) AS filled, nullif(flag, 'N') IS DISTINCT FROM nullif(flag, 'R') AS differs, greatest(CAST(qty AS BIGINT), part) AS most, least(CAST(qty AS BIGINT), part) AS least FROM ln")
def s8_nulls(t: Tables):
    q = F.col("qty").cast("long")
    some = F.nullif(q, F.lit(1).cast("long"))
    differs = ~F.nullif("flag", F.lit("N")).eqNullSafe(F.nullif("flag", F.lit("R")))
    return t.lines().select("event", "period", some.alias("some"), F.coalesce(some, F.lit(0)).alias("filled"), differs.alias("differs"), F.greatest(q, "part").alias("most"), F.least(q, "part").alias("least"))


FOLDED = "regexp_replace(trim(regexp_replace(strip_accents(lower(translate(c_name, 'aeousrCt', 'áěőüšřĊț') || [' Jr.', ' sr', ' III', ' V', '-Ö', '  x', ''][CAST(c_custkey % 7 + 1 AS INTEGER)])), '[-\\s]+', ' ', 'g')), ' (jr\\.?|sr\\.?|ii|iii|iv|v)$', '')"


@bound(f"SELECT c_custkey AS customer, {FOLDED} AS folded FROM customer")
def s10_decomposed_name(t: Tables):
    ends = F.array(*[F.lit(x) for x in (" Jr.", " sr", " III", " V", "-Ö", "  x", "")])
    name = F.concat(F.translate("c_name", "aeousrCt", "áěőüšřĊț"), F.element_at(ends, (F.col("c_custkey") % 7 + 1).cast("int")))
    return t.customer.select(F.col("c_custkey").alias("customer"), scalar.folded_name(name).alias("folded"))


@bound("SELECT p_partkey AS part, len(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda w: starts_with(w, 'wi'))) > 0 AS begins FROM part")
def s11_word_start(t: Tables):
    return t.part.select(F.col("p_partkey").alias("part"), scalar.starts_word(F.col("p_name"), "Wi").alias("begins"))


WORDS = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"


@bound(f"""WITH {WORDS}, e AS (SELECT DISTINCT replace(substr(word, 1, 2) || substr(word, 4, 1) || substr(word, 3, 1) || substr(word, 5), 'd', 'č') AS word FROM w)
SELECT e.word, w.word AS near, CAST(damerau_levenshtein(e.word, w.word) AS INTEGER) AS gap FROM e JOIN w ON damerau_levenshtein(e.word, w.word) <= CASE WHEN length(e.word) <= 3 THEN 0 WHEN length(e.word) <= 6 THEN 1 ELSE 2 END""")
def s12_byte_edits(t: Tables):
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    turned = F.concat(F.substring("word", 1, 2), F.substring("word", 4, 1), F.substring("word", 3, 1), F.expr("substring(word, 5)"))
    return match.near_words(words.select(F.replace(turned, F.lit("d"), F.lit("č")).alias("word")), words)


@bound(f"""WITH {WORDS}, t AS (SELECT word, CASE WHEN length(word) > 3 THEN substr(word, 1, 2) || substr(word, 4) ELSE word END AS typed FROM w),
m AS (SELECT DISTINCT a.typed || ' ' || b.typed AS mention, a.typed AS x, b.typed AS y FROM part JOIN t a ON a.word = string_split(p_name, ' ')[1] JOIN t b ON b.word = string_split(p_name, ' ')[2]),
g AS (SELECT DISTINCT mention, u.tok, w.word, damerau_levenshtein(u.tok, w.word) AS gap FROM m, unnest([x, y]) AS u(tok), w WHERE damerau_levenshtein(u.tok, w.word) <= CASE WHEN length(u.tok) <= 3 THEN 0 WHEN length(u.tok) <= 6 THEN 1 ELSE 2 END),
h AS (SELECT mention, p_partkey AS id, tok, min(gap) AS gap FROM g JOIN part ON list_contains(string_split(p_name, ' '), g.word) GROUP BY ALL)
SELECT h.mention, id, CAST(sum(gap) AS BIGINT) AS gap FROM h JOIN (SELECT mention, count(DISTINCT tok) AS n FROM (SELECT mention, unnest([x, y]) AS tok FROM m) GROUP BY mention) c ON c.mention = h.mention GROUP BY h.mention, id, n HAVING count(*) = n""")
def m2_near_names(t: Tables):
    typed = lambda c: F.when(F.length(c) > 3, F.concat(F.substring(c, F.lit(1), F.lit(2)), F.substring(c, F.lit(4), F.length(c)))).otherwise(c)
    parts = F.split("p_name", " ")
    mentions = t.part.where(F.size(parts) > 1).select(F.concat_ws(" ", typed(parts[0]), typed(parts[1])).alias("mention"))
    return match.near_spelling(mentions, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@bound("SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS label FROM events")
def s15_struct_json(t: Tables):
    s = F.struct(F.col("event_type").alias("kind"), F.from_json("props", "k int")["k"].alias("k"))
    return t.events.withColumn("s", s).select("user_id", F.col("s.kind").alias("event_type"), "s.k", F.concat_ws(":", "s.kind", "s.k").alias("label"))


# loads


@bound("""SELECT 'orders' AS source, CAST(o_orderkey AS BIGINT) AS k FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'again', o_orderkey FROM orders UNION ALL SELECT 'both', o_orderkey FROM orders UNION ALL SELECT 'both', p_partkey FROM part UNION ALL SELECT 'part', p_partkey FROM part""")
def l2_partial_reload(t: Tables):
    """A table is loaded again with all its rows, the other stays, and the derived table follows both."""
    src, dst = _folder(t, "source"), _folder(t, "target")
    orders, part = t.orders.select(F.col("o_orderkey").alias("k")), t.part.select(F.col("p_partkey").alias("k"))
    orders.where("k % 2 = 0").write.parquet(f"{src}/orders")
    part.write.parquet(f"{src}/part")
    step = [("both", lambda have: have["orders"].unionByName(have["part"]))]
    load.load(t.spark, src, dst, ["orders", "part"], step)
    old = _folder(t, "kept")
    Store(t.spark, dst).read("orders").write.parquet(old)
    orders.where("k % 2 = 1").write.mode("append").parquet(f"{src}/orders")
    have = load.load(t.spark, src, dst, ["orders", "part"], step, only=["orders"])
    named = {"orders": t.spark.read.parquet(old), "again": have["orders"], "both": have["both"], "part": have["part"]}
    out = None
    for name, d in named.items():
        one = d.select(F.lit(name).alias("source"), "k")
        out = one if out is None else out.unionByName(one)
    return out


@bound("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def l3_atomic_publish(t: Tables):
    """The second publication replaces the first one whole."""
    path = _folder(t, "published")
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    load.publish(c, path)
    load.publish(load.read(t.spark, path).where("c_acctbal > 0"), path)
    return load.read(t.spark, path)


@bound("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_shippriority END AS priority FROM (SELECT *, o_orderkey % 11 AS o_shippriority FROM orders)")
def l4_ragged_rows(t: Tables):
    """Ragged JSON lines land; keys that are missing are null."""
    base = _folder(t, "ragged")
    k = F.col("o_orderkey")
    rows = t.orders.select(F.struct(k.alias("k"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 5 != 0, k % 11).alias("priority")).alias("r"))
    rows.select(F.to_json("r").alias("value")).write.text(f"{base}/landed")
    load.load_rows(t.spark, f"{base}/landed", "k bigint, status string, priority bigint", f"{base}/table")
    return t.spark.read.parquet(f"{base}/table")


@bound('SELECT DISTINCT CASE WHEN r_regionkey = 0 THEN \'part\' ELSE \'region\' END AS "table" FROM region')
def l6_changed_tables(t: Tables):
    """Of three tables one gets a file and one is written anew; those two are to be loaded again."""
    base = _folder(t, "tracked")
    for name in ("nation", "part", "region"):
        getattr(t, name).write.parquet(f"{base}/{name}")
    seen = _folder(t, "manifest")
    load.manifest(t.spark, base).write.parquet(seen)
    t.part.limit(1).write.mode("append").parquet(f"{base}/part")
    t.region.write.mode("overwrite").parquet(f"{base}/region")
    return load.changed_tables(load.manifest(t.spark, base), t.spark.read.parquet(seen))


# documents: an order as a game summary, its lines as athletes and plays


def summaries(t: Tables) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    team = lambda c: F.struct(c.cast("string").alias("id"))
    # lines come together as they are, and are put in words within their document
    lines = t.lines_by_event("event", "part", "supp", "period", "flag", "qty").withColumn("qty", F.col("qty").cast("long")).withColumnRenamed("qty", "q")
    lines = lines.groupBy("event").agg(F.collect_list(F.struct("part", "supp", "period", "flag", "q")).alias("lines"), F.sum("q").alias("score"))
    g = lines.join(t.b1().df.select("event", "season", "season_type", "group", "won"), "event")
    athlete = lambda l: F.struct(
        F.struct(l["part"].cast("string").alias("id"), F.concat(F.lit("Part "), l["part"].cast("string")).alias("displayName"), F.concat(F.lit("P"), l["part"].cast("string")).alias("shortName")).alias("athlete"),
        (l["period"] == 1).alias("starter"), F.lit(False).alias("didNotPlay"), F.array(l["q"].cast("string"), F.concat_ws("-", l["period"], l["period"] + 1)).alias("stats"),
    )
    play = lambda l: F.struct(
        F.concat_ws("-", "event", l["period"], l["part"]).alias("id"), F.struct(l["flag"].alias("text")).alias("type"), F.struct(l["period"].cast("long").alias("number")).alias("period"), (l["flag"] == "R").alias("scoringPlay"),
        (l["q"] > 25).alias("shootingPlay"), l["q"].alias("scoreValue"), team(l["supp"]).alias("team"), F.array(F.struct(F.struct(l["part"].cast("string").alias("id")).alias("athlete"))).alias("participants"),
        F.struct(l["period"].cast("double").alias("x"), l["q"].cast("double").alias("y")).alias("coordinate"),
    )
    g = g.withColumns({"athletes": F.transform("lines", athlete), "plays": F.transform("lines", play)})
    home, away = F.col("group"), F.col("group") + 100
    side = lambda w, c, won, score: F.struct(F.lit(w).alias("homeAway"), won.alias("winner"), score.cast("string").alias("score"), team(c).alias("team"), F.array(F.struct(F.lit("7").alias("displayValue")), F.struct(score.cast("string").alias("displayValue"))).alias("linescores"))
    header = F.struct(s("event").alias("id"), F.struct(F.col("season").alias("year"), F.col("season_type").cast("long").alias("type")).alias("season"), F.array(F.struct(F.lit("2000-01-01").alias("date"), F.lit(False).alias("neutralSite"), F.array(side("away", away, ~F.col("won"), F.lit(1)), side("home", home, F.col("won"), F.col("score"))).alias("competitors"))).alias("competitions"))
    stat = F.struct(F.lit("total").alias("name"), s("score").alias("displayValue"), F.lit("Total").alias("label"))
    players = F.struct(team(home).alias("team"), F.array(F.struct(F.array(F.lit("points"), F.lit("fieldGoalsMade-fieldGoalsAttempted")).alias("keys"), F.col("athletes"))).alias("statistics"))
    boxscore = F.struct(F.array(F.struct(team(home).alias("team"), F.lit("home").alias("homeAway"), F.array(stat).alias("statistics"))).alias("teams"), F.array(players).alias("players"))
    win = F.array(F.struct((F.col("score") % 100 / 100).alias("homeWinPercentage"), F.lit(0.0).alias("tiePercentage"), s("event").alias("playId")))
    return g.select(F.to_json(F.struct(header.alias("header"), boxscore.alias("boxscore"), "plays", win.alias("winprobability"))).alias("json"))


def summary(name: str, columns: list[str]):
    def run(t: Tables) -> DataFrame:
        out = flatten.flatten_summary(summaries(t), stats={"points": "bigint", "fieldGoalsMade-fieldGoalsAttempted": "bigint"})[name]
        return out.select(*columns) if name != "team_box" else out.select(*columns, F.col("stats")["total"].alias("total"))

    return run


LB = """lb AS (SELECT CAST(ln.event AS VARCHAR) AS event_id, season, CAST(season_type AS BIGINT) AS season_type, CAST("group" AS VARCHAR) AS home, CAST("group" + 100 AS VARCHAR) AS away, won, part, supp, ln.period, flag, CAST(qty AS BIGINT) AS q FROM ln JOIN b1 ON b1.event = ln.event),
gm AS (SELECT event_id, season, season_type, home, away, won, CAST(sum(q) AS BIGINT) AS score FROM lb GROUP BY ALL)"""
PLAY = "event_id || '-' || CAST(period AS VARCHAR) || '-' || CAST(part AS VARCHAR)"
for _name, _columns, _sql in [
    ("games", ["event_id", "season", "season_type", "home_team_id", "away_team_id", "home_score", "away_score", "winner_team_id", "home_linescores"], "SELECT event_id, season, season_type, home AS home_team_id, away AS away_team_id, score AS home_score, CAST(1 AS BIGINT) AS away_score, CASE WHEN won THEN home ELSE away END AS winner_team_id, '7,' || CAST(score AS VARCHAR) AS home_linescores FROM gm"),
    ("player_box", ["event_id", "season", "team_id", "opponent_team_id", "athlete_id", "starter", "points", "fieldGoalsMade", "fieldGoalsAttempted"], 'SELECT event_id, season, home AS team_id, away AS opponent_team_id, CAST(part AS VARCHAR) AS athlete_id, period = 1 AS starter, q AS points, CAST(period AS BIGINT) AS "fieldGoalsMade", CAST(period + 1 AS BIGINT) AS "fieldGoalsAttempted" FROM lb'),
    ("team_box", ["event_id", "season", "team_id", "home_away"], "SELECT event_id, season, home AS team_id, 'home' AS home_away, CAST(score AS VARCHAR) AS total FROM gm"),
    ("plays", ["event_id", "play_id", "period", "team_id", "athlete_id", "type", "scoring_play"], f"SELECT event_id, {PLAY} AS play_id, CAST(period AS BIGINT) AS period, CAST(supp AS VARCHAR) AS team_id, CAST(part AS VARCHAR) AS athlete_id, flag AS type, flag = 'R' AS scoring_play FROM lb"),
    ("shots", ["event_id", "play_id", "made", "points_attempted", "coordinate_x", "coordinate_y"], f"SELECT event_id, {PLAY} AS play_id, flag = 'R' AS made, q AS points_attempted, CAST(period AS DOUBLE) AS coordinate_x, CAST(q AS DOUBLE) AS coordinate_y FROM lb WHERE q > 25"),
    ("win_probability", ["event_id", "play_id", "home_win_pct"], "SELECT event_id, event_id AS play_id, CAST(score % 100 AS DOUBLE) / 100 AS home_win_pct FROM gm"),
    ("players", ["athlete_id", "display_name", "short_name"], "SELECT DISTINCT CAST(part AS VARCHAR) AS athlete_id, 'Part ' || CAST(part AS VARCHAR) AS display_name, 'P' || CAST(part AS VARCHAR) AS short_name FROM lb"),
    ("glossary", ["name", "label"], "SELECT DISTINCT 'total' AS name, 'Total' AS label FROM gm"),
]:
    bound(f"WITH {LB} {_sql}", f"l8_{_name}")(summary(_name, _columns))


@bound("SELECT entity, CAST(sum(value) FILTER (\"group\" = 'view') AS DOUBLE) AS view_off, CAST(count(*) FILTER (\"group\" = 'view') AS DOUBLE) AS view_def, CAST(sum(value) FILTER (\"group\" = 'click') AS DOUBLE) AS click_off, CAST(count(*) FILTER (\"group\" = 'click') AS DOUBLE) AS click_def FROM b2 GROUP BY entity")
def l18_fingerprint_wide(t: Tables):
    one = lambda k: F.struct(F.sum(F.when(F.col("group") == k, F.col("value"))).cast("double").alias("off"), F.count_if(F.col("group") == k).cast("double").alias("def"))
    d = t.b2().df.groupBy("entity").agg(F.struct(one("view").alias("view"), one("click").alias("click")).alias("fingerprint"))
    return flatten.flatten_fingerprint(d, ["entity"], ["view", "click"], ["off", "def"])


@bound("SELECT event, period, CAST(amount AS DOUBLE) AS amount, season, c_name, s_name FROM ln LEFT JOIN b1 USING (event) LEFT JOIN customer ON c_custkey = entity LEFT JOIN supplier ON s_suppkey = supp")
def r14_whole_log(t: Tables):
    names = [(t.customer.select(F.col("c_custkey").alias("entity"), "c_name"), "entity"), (t.supplier.select(F.col("s_suppkey").alias("supp"), "s_name"), "supp")]
    d = repair.fact_log(t.lines(), t.b1().df.select("event", "season", "entity"), names)
    return d.select("event", "period", F.col("amount").cast("double").alias("amount"), "season", "c_name", "s_name")
