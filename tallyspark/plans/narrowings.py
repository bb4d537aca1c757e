"""Narrowings, joins and set operations on the verification tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import distance, folded_name, listed_sum, two_parts
from ..operators import aggregate as agg
from ..operators import joins, relation, repair, windows
from .bind import Tables, as_double, bound

SUM = 'count(*) AS games, CAST(sum(price) AS DOUBLE) AS total_price'


def tally(rel, col: str = "price", by: str | None = None) -> DataFrame:
    out = (rel.df.groupBy(by) if by else rel.df.groupBy()).agg(F.count("*").alias("games"), agg.total(col).alias(f"total_{col}"))
    return out


def season_sql(where: str, by: str = "season") -> str:
    return f"SELECT {by}, {SUM} FROM b1 WHERE {where} GROUP BY {by}"


@bound(season_sql("price IS NOT NULL AND price <> 0"))
def n1_played(t: Tables):
    return tally(t.b1().with_df(t.b1().df.withColumn("price", F.nullif("price", F.lit(0)))).played("price"), by="season")


@bound(season_sql("season_type IN (3)"))
def n2_season_type(t: Tables):
    return tally(t.b1().season_type(3), by="season")


@bound(season_sql("season BETWEEN 1997 AND 2000 AND season <> 1999"))
def n3_span(t: Tables):
    return tally(t.b1().span(since=1996, floor=1997, until=2000, phantom=(1999,)), by="season")


@bound(season_sql("(season_type = 3 AND year(day) BETWEEN 1996 AND 1998) OR (season_type <> 3 AND season BETWEEN 1996 AND 1998)"))
def n4_civil_year_span(t: Tables):
    return tally(t.b1().civil_year_span(3, 1996, 1998), by="season")


@bound("""WITH s AS (SELECT entity, season, row_number() OVER (PARTITION BY entity ORDER BY season) AS n FROM (SELECT DISTINCT entity, season FROM b1))
SELECT b1.entity, count(*) AS games, CAST(sum(price) AS DOUBLE) AS total_price FROM b1 JOIN s ON s.entity = b1.entity AND s.season = b1.season AND n = 2 GROUP BY b1.entity""")
def n5_ordinal_season(t: Tables):
    return tally(t.b1().ordinal_season(2), by="entity")


@bound(season_sql("opponent = '1-URGENT' AND \"group\" = 3"))
def n6_opponent_group(t: Tables):
    return tally(t.b1().opponent("1-URGENT").group(3), by="season")


@bound("""SELECT l_returnflag AS flag, count(*) AS games, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey = s_nationkey AND o_orderpriority <> '5-LOW' GROUP BY l_returnflag""")
def n7_venue(t: Tables):
    o = t.b1().df.select("event", F.col("group").alias("own"), (F.col("opponent") == "5-LOW").alias("neutral"))
    rows = t.lines().join(o, "event").join(t.supplier.select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").alias("place")), "supp")
    return tally(relation.Rel(rows).venue("home", "own", "place", "neutral"), "amount", "flag")


@bound("SELECT flag, count(*) AS games, CAST(sum(amount) AS DOUBLE) AS total_amount FROM ln WHERE period = 1 GROUP BY flag")
def n8_flag(t: Tables):
    return tally(relation.Rel(t.lines()).flag("period", 1), "amount", "flag")


@bound(season_sql("price >= 100000 AND price < 300000"))
def n9_line(t: Tables):
    return tally(t.b1().line("price", ">=", 100000).line("price", "<", 300000), by="season")


@bound(season_sql("event IN (SELECT event FROM ln WHERE qty >= 45)"))
def n10_detail_line(t: Tables):
    return tally(t.b1().detail_line(t.lines(), ["event"], F.col("qty"), ">=", 45), by="season")


@bound(season_sql("event IN (SELECT event FROM ln WHERE period IN (1, 2) GROUP BY event HAVING sum(qty) >= 60)"))
def n11_period_line(t: Tables):
    return tally(t.b1().period_line(t.lines(), ["event"], "period", [1, 2], F.col("qty"), ">=", 60), by="season")


@bound("""SELECT entity, count(*) AS games, CAST(sum(value) AS DOUBLE) AS total_value FROM b2 WHERE day IN (SELECT day FROM b2 WHERE entity = 7 AND won) GROUP BY entity""")
def n12_companion(t: Tables):
    b = t.b2()
    return tally(b.companion(b.df.where("entity = 7 and won"), ["day"]), "value", "entity")


@bound("""WITH s AS (SELECT "group", min(day) AS f, max(day) AS l FROM b2 WHERE entity = 7 GROUP BY "group")
SELECT b2.entity, count(*) AS games, CAST(sum(value) AS DOUBLE) AS total_value FROM b2 JOIN s ON s."group" = b2."group" AND day BETWEEN f AND l
WHERE NOT EXISTS (SELECT 1 FROM b2 x WHERE x.entity = 7 AND x.day = b2.day AND x."group" = b2."group") GROUP BY b2.entity""")
def n13_without(t: Tables):
    b = t.b2()
    his = b.df.where("entity = 7")
    return tally(b.without(his, ["group", "day"], windows.spans(his, ["group"])), "value", "entity")


@bound("SELECT entity, count(*) AS games, CAST(sum(value) AS DOUBLE) AS total_value FROM b2 WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-11 05:00:00' GROUP BY entity")
def n14_on_day(t: Tables):
    return tally(t.b2().on_day("2024-01-10", "America/New_York"), "value", "entity")


@bound("""SELECT kind, count(*) AS games, CAST(sum(price) AS DOUBLE) AS total_price FROM (
 SELECT 'weekday' AS kind, price FROM b1 WHERE isodow(day) = 5 UNION ALL SELECT 'month', price FROM b1 WHERE month(day) = 12
 UNION ALL SELECT 'month_day', price FROM b1 WHERE month(day) = 12 AND day(day) = 25 UNION ALL SELECT 'nth_weekday', price FROM b1 WHERE month(day) = 11 AND isodow(day) = 4 AND day(day) BETWEEN 22 AND 28
 UNION ALL SELECT 'since', price FROM b1 WHERE day >= DATE '1999-03-01' UNION ALL SELECT 'between', price FROM b1 WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'
 UNION ALL SELECT 'season_since', price FROM b1 WHERE day >= make_date(season, 2, 1)) GROUP BY kind""")
def n15_calendar(t: Tables):
    b = t.b1()
    asked = {"weekday": 5, "month": 12, "month_day": (12, 25), "nth_weekday": (11, 4, 4), "since": "1999-03-01", "between": ("1997-01-01", "1997-06-30"), "season_since": (2, 1)}
    # one pass: each row with the situations that it is in
    flags = [F.when(_cond(b, k, v), F.lit(k)) for k, v in asked.items()]
    rows = b.df.select("price", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("games"), agg.total("price").alias("total_price"))


def _cond(b, kind, value):
    """The condition that a calendar narrowing adds, taken as a column."""
    got = {}

    class Only(relation.Rel):
        def where(self, cond):
            got["c"] = cond
            return self

    Only(b.df, b.roles).calendar(kind, value)
    return got["c"]


@bound("""SELECT season, count(*) AS games, CAST(sum(price) AS DOUBLE) AS total_price FROM b1 WHERE "group" IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA') GROUP BY season""")
def n16_aligned(t: Tables):
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return tally(t.b1().aligned(dim, {"group": "n_nationkey"}, "r_name", "ASIA"), by="season")


NUMBERED = """num AS (SELECT *, row_number() OVER (PARTITION BY season, "group", opponent ORDER BY ts, event) AS game_no FROM b1)"""


@bound(f"WITH {NUMBERED} SELECT season, {SUM} FROM num WHERE game_no = 3 GROUP BY season")
def n17_series_game(t: Tables):
    from pyspark.sql import Window

    b = t.b1()
    num = b.df.select("event", F.row_number().over(Window.partitionBy("season", "group", "opponent").orderBy("ts", "event")).alias("game_no"))
    return tally(b.series_game(num, ["event"], 3), by="season")


@bound(season_sql("entity IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"))
def n18_entity_in(t: Tables):
    return tally(t.b1().entity_in(t.customer, "c_custkey", "c_mktsegment", ["BUILDING", "MACHINERY"]), by="season")


@bound("""SELECT season, count(*) AS games, CAST(sum(price) AS DOUBLE) AS total_price FROM b1 WHERE EXISTS (SELECT 1 FROM b1 x WHERE x.entity = b1.entity AND x.season = b1.season AND x.opponent = '2-HIGH') GROUP BY season""")
def n19_participated(t: Tables):
    b = t.b1()
    return tally(b.pinned(b.df.where("opponent = '2-HIGH'").select("entity", "season")), by="season")


@bound(season_sql("opponent IN ('1-URGENT', '2-HIGH') AND entity IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"))
def n20_where_in(t: Tables):
    rich = t.customer.where("c_acctbal > 5000").select("c_custkey")
    return tally(t.b1().where_in("opponent", ["1-URGENT", "2-HIGH"]).where_in("entity", rich), by="season")


@bound("""SELECT CAST(CASE WHEN qty >= 10 THEN 1 ELSE 0 END + CASE WHEN amount >= 30000 THEN 1 ELSE 0 END + CASE WHEN discount >= 0.05 THEN 1 ELSE 0 END AS INTEGER) AS reached, count(*) AS games FROM ln GROUP BY reached""")
def n21_derived(t: Tables):
    flags = sum((F.when(F.col(c) >= v, 1).otherwise(0) for c, v in (("qty", 10), ("amount", 30000), ("discount", 0.05))), F.lit(0))
    return relation.derived(relation.Rel(t.lines()), {"reached": flags}).df.groupBy("reached").agg(F.count("*").alias("games"))


@bound("""SELECT season, count(*) AS games, count(CASE WHEN season_type <> 3 THEN price END) AS readable, CAST(sum(CASE WHEN season_type <> 3 THEN price END) AS DOUBLE) AS total_price FROM b1 GROUP BY season""")
def n22_blank(t: Tables):
    b = relation.derived(t.b1(), {"rebuilt": F.col("season_type") == 3})
    return relation.blank(b, ["price"], "rebuilt").df.groupBy("season").agg(F.count("*").alias("games"), F.count("price").alias("readable"), agg.total("price").alias("total_price"))


@bound("SELECT flag, count(*) AS games FROM ln WHERE NOT (discount = 0 AND qty = 1) AND period = 2 GROUP BY flag")
def n23_located(t: Tables):
    return relation.located(t.lines().withColumn("x", F.col("qty") - 1), "x", "discount", "period", 2).groupBy("flag").agg(F.count("*").alias("games"))


@bound("""WITH top AS (SELECT event FROM ln GROUP BY event HAVING count(*) >= 6)
SELECT season, count(*) AS games, CAST(sum(price) AS DOUBLE) AS total_price FROM b1 JOIN top USING (event) GROUP BY season""")
def n24_pinned(t: Tables):
    return tally(t.b1().pinned(t.lines().groupBy("event").count().where("count >= 6").select("event")), by="season")


@bound(season_sql("season = (SELECT least(max(season), 2001) FROM b1 WHERE season_type <> 3)"))
def n25_default_season(t: Tables):
    return tally(t.b1().latest_season(2001, F.col("season_type") != 3), by="season")


@bound("SELECT season, CASE WHEN season >= 1998 THEN CAST(avg(CAST(price AS DOUBLE)) AS BIGINT) END AS metric, count(*) AS games FROM b1 GROUP BY season")
def n26_floor_metric(t: Tables):
    rows = t.b1().df.groupBy("season").agg(F.round(F.avg(F.col("price").cast("double"))).cast("long").alias("metric"), F.count("*").alias("games"))
    return relation.floor_metric(rows, "season", {"metric": 1998})


# joins


@bound("SELECT season, count(*) AS line_rows, CAST(sum(amount) AS DOUBLE) AS total_amount FROM ln JOIN b1 USING (event) GROUP BY season")
def j1_inner(t: Tables):
    return t.lines().join(t.b1().df.select("event", "season"), "event").groupBy("season").agg(F.count("*").alias("line_rows"), agg.total("amount").alias("total_amount"))


@bound("SELECT entity, coalesce(c_mktsegment, 'none') AS segment, count(*) AS games FROM b1 LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = entity GROUP BY ALL")
def j2_left_fallback(t: Tables):
    dim = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    return t.b1().df.join(dim, "entity", "left").groupBy("entity", F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.count("*").alias("games"))


@bound("""WITH l AS (SELECT season, count(*) AS n FROM b1 GROUP BY season), r AS (SELECT season, count(DISTINCT event) AS n FROM ln JOIN b1 USING (event) GROUP BY season)
SELECT season, coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n FROM l FULL JOIN r USING (season) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def j3_reconcile(t: Tables):
    b = t.b1().df.select("event", "season")
    return joins.reconcile(b.groupBy("season").agg(F.count("*").alias("n")), t.lines().join(b, "event").groupBy("season").agg(F.count_distinct("event").alias("n")), ["season"], "n")


@bound("SELECT opponent, count(*) AS games FROM b1 WHERE EXISTS (SELECT 1 FROM ln WHERE ln.event = b1.event AND flag = 'R') GROUP BY opponent")
def j4_semi(t: Tables):
    return t.b1().df.join(t.lines().where("flag = 'R'").select("event"), "event", "left_semi").groupBy("opponent").agg(F.count("*").alias("games"))


@bound("SELECT season, count(*) AS games FROM b1 WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.event = b1.event) GROUP BY season")
def j5_missing_detail(t: Tables):
    return joins.missing_detail(t.b1().df, t.lines(), ["event"]).groupBy("season").agg(F.count("*").alias("games"))


@bound("""WITH s AS (SELECT entity, "group", min(day) AS f, max(day) AS l FROM b2 WHERE won OR "group" = 'signup' GROUP BY ALL)
SELECT b2.entity, count(*) AS games FROM b2 JOIN s ON s.entity = b2.entity AND day BETWEEN f AND l GROUP BY b2.entity""")
def j6_within_spans(t: Tables):
    b = t.b2().df
    s = windows.spans(b.where("won or group = 'signup'"), ["entity", "group"]).drop("group")
    return joins.within_spans(b, s, ["entity"]).groupBy("entity").agg(F.count("*").alias("games"))


PAIR = """WITH d AS (SELECT DISTINCT event, part, supp FROM ln) SELECT x.part, y.part AS part_2, count(*) AS games FROM d x JOIN d y ON x.event = y.event AND y.part > x.part AND x.supp {0} y.supp GROUP BY ALL HAVING count(*) >= 1"""


@bound(PAIR.format("<>"))
def j7_paired(t: Tables):
    d = t.lines().select("event", "part", "supp").distinct()
    return joins.paired(d, ["event"], "part", "supp").groupBy("part", "part_2").agg(F.count("*").alias("games"))


@bound("SELECT x.s_suppkey AS supp, y.s_suppkey AS supp_2, x.s_nationkey AS nation FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND y.s_suppkey > x.s_suppkey")
def j8_ordered_pairs(t: Tables):
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supp"))
    return joins.paired(s, ["nation"], "supp").select("supp", "supp_2", "nation")


@bound("""SELECT entity, arg_max(opponent, struct_pack(t := ts, e := event)) AS opponent, count(DISTINCT opponent) > 1 AS moved FROM b1 GROUP BY entity""")
def j9_latest_group(t: Tables):
    return joins.latest_group(t.b1().df, "entity", "opponent", ["ts", "event"])


@bound("""WITH a AS (SELECT entity, season, min(opponent) AS v FROM b1 WHERE won GROUP BY ALL), n AS (SELECT entity, season - 1 AS season, v FROM a), o AS (SELECT entity, max(opponent) AS v FROM b1 GROUP BY entity)
SELECT event, coalesce(a.v, n.v, o.v) AS v FROM b1 LEFT JOIN a ON a.entity = b1.entity AND a.season = b1.season LEFT JOIN n ON n.entity = b1.entity AND n.season = b1.season LEFT JOIN o ON o.entity = b1.entity""")
def j10_first_match(t: Tables):
    b = t.b1().df
    a = b.where("won").groupBy("entity", "season").agg(F.min("opponent").alias("v"))
    nxt = a.select("entity", (F.col("season") - 1).alias("season"), "v")
    other = b.groupBy("entity").agg(F.max("opponent").alias("v"))
    return joins.first_match(b.select("event", "entity", "season"), [(a, ["entity", "season"]), (nxt, ["entity", "season"]), (other, ["entity"])], "v").select("event", "v")


@bound("""WITH a AS (SELECT event, CASE WHEN opponent <> '5-LOW' THEN opponent END AS o FROM b1), k AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE '2-HIGH' END AS o FROM customer)
SELECT count(*) AS games, count(a.o) AS named FROM a WHERE EXISTS (SELECT 1 FROM k WHERE k.o IS NOT DISTINCT FROM a.o)""")
def j11_null_safe(t: Tables):
    a = t.b1().df.select("event", F.when(F.col("opponent") != "5-LOW", F.col("opponent")).alias("o"))
    k = t.customer.select(F.when(F.col("c_mktsegment") != "BUILDING", "2-HIGH").alias("o")).distinct()
    return joins.null_safe(a, k, ["o"]).agg(F.count("*").alias("games"), F.count("o").alias("named"))


@bound("""WITH n AS (SELECT "group", CAST(sum(price) AS DOUBLE) AS total FROM b1 GROUP BY "group")
SELECT n_name AS name, total, (SELECT count(*) FROM n m WHERE m.total > n.total) AS above FROM n JOIN nation ON n_nationkey = "group" """)
def j12_count_above(t: Tables):
    n = t.b1().df.groupBy("group").agg(agg.total("price").alias("total")).join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("group"), F.col("n_name").alias("name"))), "group")
    return windows.competition_rank(n, "total").select("name", "total", (F.col("rank") - 1).alias("above"))


# set operations


@bound("SELECT k, sum(n)::BIGINT AS n FROM (SELECT part AS k, count(*) AS n FROM ln GROUP BY part UNION ALL SELECT supp, count(*) FROM ln GROUP BY supp) GROUP BY k")
def u1_union_all(t: Tables):
    one = lambda c: t.lines().groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    return one("part").unionByName(one("supp")).groupBy("k").agg(F.sum("n").alias("n"))


@bound("SELECT entity AS id FROM b1 WHERE won UNION SELECT entity FROM b2 WHERE won")
def u2_union_distinct(t: Tables):
    return t.b1().df.where("won").select(F.col("entity").alias("id")).union(t.b2().df.where("won").select("entity")).distinct()


@bound("""WITH f AS (SELECT event, period FROM ln), s AS (SELECT event, period FROM ln WHERE period <= 5)
SELECT (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM f)) AS stale, (SELECT count(*) FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM s)) AS missing""")
def u3_staleness(t: Tables):
    from ..operators.audit import staleness

    f = t.lines().select("event", "period")
    return staleness(f, f.where("period <= 5"))


@bound("SELECT DISTINCT entity FROM b1 WHERE won INTERSECT SELECT entity FROM b1 WHERE price > 400000")
def u4_membership(t: Tables):
    b = t.b1().df
    return b.where("won").select("entity").distinct().join(b.where("price > 400000").select("entity"), "entity", "left_semi")


@bound("SELECT v.label, count(*) AS games FROM b1 JOIN (VALUES ('1-URGENT', 'top'), ('2-HIGH', 'top'), ('5-LOW', 'bottom')) v(opponent, label) USING (opponent) GROUP BY v.label")
def u5_inline_values(t: Tables):
    v = t.spark.createDataFrame([("1-URGENT", "top"), ("2-HIGH", "top"), ("5-LOW", "bottom")], "opponent string, label string")
    return t.b1().df.join(F.broadcast(v), "opponent").groupBy("label").agg(F.count("*").alias("games"))


# scalar functions


@bound("""SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day, count(*) AS games FROM events GROUP BY day""")
def s1_civil_date(t: Tables):
    from ..functions.scalar import civil_date

    return t.events.groupBy(civil_date(F.col("ts")).alias("day")).agg(F.count("*").alias("games"))


@bound("SELECT event, CAST(list_sum([TRY_CAST(x AS BIGINT) FOR x IN list_slice(string_split(periods, ','), 2, 3)]) AS BIGINT) AS total FROM (SELECT event, string_agg(CAST(CAST(qty AS BIGINT) AS VARCHAR), ',' ORDER BY period, qty) AS periods FROM ln GROUP BY event)")
def s6_listed_sum(t: Tables):
    rows = t.lines().groupBy("event").agg(F.array_sort(F.collect_list(F.struct("period", F.col("qty").cast("long").alias("q")))).alias("a"))
    return rows.select("event", listed_sum(F.array_join(F.transform("a", lambda x: x["q"].cast("string")), ","), [2, 3]).alias("total"))


@bound(r"""SELECT entity, TRY_CAST(nullif(regexp_extract(r, '^\s*(\d+)\s*-\s*(\d+)\s*$', 1), '') AS BIGINT) AS wins, TRY_CAST(nullif(regexp_extract(r, '^\s*(\d+)\s*-\s*(\d+)\s*$', 2), '') AS BIGINT) AS losses
FROM (SELECT entity, CASE WHEN count(*) > 12 THEN 'n/a' ELSE CAST(count(*) FILTER (won) AS VARCHAR) || '-' || CAST(count(*) FILTER (NOT won) AS VARCHAR) END AS r FROM b1 GROUP BY entity)""")
def s13_record_text(t: Tables):
    r = t.b1().df.groupBy("entity").agg(F.when(F.count("*") > 12, "n/a").otherwise(F.concat_ws("-", F.count_if("won"), F.count_if(~F.col("won")))).alias("r"))
    w, l = two_parts(F.col("r"))  # noqa: E741
    return r.select("entity", w.alias("wins"), l.alias("losses"))


@bound("SELECT flag, count(*) AS games, count(*) FILTER (sqrt(CAST(qty AS DOUBLE) * CAST(qty AS DOUBLE) + CAST(period AS DOUBLE) * CAST(period AS DOUBLE)) >= 25) AS far FROM ln GROUP BY flag")
def s9_distance(t: Tables):
    d = distance(F.col("qty").cast("double"), F.col("period").cast("double"))
    return t.lines().groupBy("flag").agg(F.count("*").alias("games"), F.count_if(d >= 25).alias("far"))


@bound("SELECT DISTINCT lower(replace(c_name, '#', ' ')) AS folded FROM customer")
def s10_folded_name(t: Tables):
    return t.customer.select(folded_name(F.regexp_replace("c_name", "#", " ")).alias("folded")).distinct()


@bound("""SELECT p_partkey AS part, list_aggregate(regexp_extract_all(lower(p_name), '[a-z]+'), 'string_agg', ' ') AS words, list_contains(regexp_extract_all(lower(p_name), '[a-z]+'), 'ring') AS whole FROM part""")
def s11_words(t: Tables):
    from ..functions.scalar import letters

    w = letters(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("part"), F.array_join(w, " ").alias("words"), F.array_contains(w, "ring").alias("whole"))
