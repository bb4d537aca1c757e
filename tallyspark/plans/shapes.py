"""Report shapes over relations: logs, splits, records, rankings, comparisons, period figures, pools."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import court
from ..functions.scalar import ratio, two_parts
from ..operators import aggregate as agg
from ..operators import windows
from ..operators.joins import within_spans
from ..operators.relation import Rel


def game_log(rel: Rel, measures: list[str], n: int, columns: list[str]) -> DataFrame:
    """Each entity's last n rows, newest first, each with the averages over exactly the rows shown."""
    w = Window.partitionBy(rel.name("entity"))
    shown = rel.window("recent", n).df
    return shown.select(*columns, *[(F.sum(m).over(w).cast("double") / F.nullif(F.count(m).over(w), F.lit(0))).alias(f"shown_{m}") for m in measures])


def player_line(rel: Rel, measures: list[str], by: list[str]) -> DataFrame:
    return rel.df.groupBy(*by).agg(F.count("*").alias("games"), *[agg.mean(m).alias(f"avg_{m}") for m in measures])


def games_counted(rel: Rel, k: int, room: int = 10) -> DataFrame:
    """Entities by how many narrowed rows they have, ties kept, with the pool's size."""
    n = rel.df.groupBy(rel.name("entity")).agg(F.count("*").alias("games"))
    pool = F.broadcast(n.agg(F.count("*").alias("pool")))
    return windows.top_with_ties(n, "games", k, room, order=[rel.name("entity")]).join(pool)


def single_game_high(rel: Rel, figure: str, k: int, columns: list[str]) -> DataFrame:
    return windows.top_with_ties(rel.df, figure, k, order=[rel.name("day"), rel.name("event")]).select(*columns, "rank")


def record_when(rel: Rel, cond: Column, margin: str) -> DataFrame:
    return agg.by_line(rel.df, cond, [*agg.record(rel.name("won")), agg.mean(margin).alias("avg_margin")])


def splits(rel: Rel, kinds: dict[str, dict[str, Column]], measures: list[str]) -> DataFrame:
    """All kinds of split in one aggregate, no row multiplied; every half of a kind is shown, also without rows."""
    halves = [(k, v, c) for k, of in kinds.items() for v, c in of.items()]
    sums = [x for i, (_, _, c) in enumerate(halves) for x in (F.count_if(c).alias(f"_n{i}"), *[agg.mean(F.when(c, F.col(m))).alias(f"_{m}{i}") for m in measures])]
    shown = [F.struct(F.lit(k).alias("kind"), F.lit(v).alias("half"), F.col(f"_n{i}").alias("games"), *[F.col(f"_{m}{i}").alias(f"avg_{m}") for m in measures]) for i, (k, v, _) in enumerate(halves)]
    return rel.df.agg(*sums).select(F.inline(F.array(*shown)))


def matchup(rel: Rel, a, b, shared: list[str], figure: str) -> DataFrame:
    """Two entities' figures on the days or events that they share."""
    e = rel.name("entity")
    one = lambda x, s: rel.df.where(F.col(e) == x).groupBy(*shared).agg(F.sum(figure).alias(f"f{s}"), F.bool_or(rel.name("won")).alias(f"w{s}"))
    both = one(a, 1).join(one(b, 2), shared)
    return both.agg(F.count("*").alias("met"), agg.mean("f1").alias("avg_1"), agg.mean("f2").alias("avg_2"), F.count_if("w1").alias("wins_1"), F.count_if("w2").alias("wins_2"))


def game_ranking(rel: Rel, figure: str, k: int, min_rows: int, names: DataFrame | None = None) -> DataFrame:
    """Entities by their mean figure, those with too few rows left out, ties kept; the minimum adapts to small pools."""
    e = rel.name("entity")
    g = agg.grouped(rel.df, {e: F.col(e)}, [agg.mean(figure).alias("figure")], min_rows, figure, adaptive=True)
    top = windows.top_with_ties(g, "figure", k, order=[e])
    return top if names is None else top.join(names, e)


def season_table(rel: Rel, figure: str) -> DataFrame:
    return rel.df.groupBy(rel.name("entity"), rel.name("season")).agg(F.count("*").alias("games"), agg.total(figure).alias("total"), agg.mean(figure).alias("average"))


def leaderboard(seasons: DataFrame, metric: str, season: int, floor: int, k: int, entity: str = "entity") -> DataFrame:
    rows = seasons.where((F.col("season") == season) & (F.col("games") >= floor))
    return rows.orderBy(F.desc_nulls_last(metric), F.asc(entity)).limit(k)


def career_leaderboard(seasons: DataFrame, k: int, floor: int, entity: str = "entity") -> DataFrame:
    c = seasons.groupBy(entity).agg(ratio(F.sum("total"), F.sum("games")).alias("figure"), F.sum("games").alias("games"), F.count("*").alias("seasons"))
    return c.where(F.col("games") >= floor).orderBy(F.desc_nulls_last("figure"), F.asc(entity)).limit(k)


def entities_counted(rel: Rel, figure: str, least) -> DataFrame:
    """How many entities' season totals reach a line, season by season."""
    e, s = rel.name("entity"), rel.name("season")
    return agg.groups_counted(rel.df, [e, s], [s], F.sum(figure) >= least, "entities")


def history(rel: Rel, figure: str) -> DataFrame:
    """Each entity's seasons, and its career as a row whose season is null."""
    e, s = rel.name("entity"), rel.name("season")
    r = rel.df.rollup(e, s).agg(F.count("*").alias("games"), agg.mean(figure).alias("average"), F.grouping_id().alias("_level"))
    return r.where("_level < 3").drop("_level")


def compare(rel: Rel, entities: list, figure: str) -> DataFrame:
    """Up to four entities side by side, season by season."""
    if not 2 <= len(entities) <= 4:
        raise ValueError("two to four entities can be compared")
    e = F.col(rel.name("entity"))
    return rel.df.where(e.isin(*entities)).groupBy(rel.name("season")).agg(*[agg.mean(F.when(e == x, F.col(figure))).alias(f"e{x}") for x in entities])


def period_log(parents: DataFrame, parts: DataFrame, periods: list[int], value: Column, stored: str, worst: float) -> DataFrame:
    """Each event's period figure, with how far its whole rebuilt figure is from the stored one; groups with too many such gaps are refused."""
    line = parts.groupBy("event").agg(F.sum(F.when(F.col("period").isin(*periods), value)).cast("double").alias("figure"), F.count("*").cast("double").alias("rebuilt"))
    rows = parents.join(line, "event", "left").withColumn("gap", F.col(stored) - F.coalesce("rebuilt", F.lit(0.0)))
    bad = rows.groupBy("entity").agg((F.count_if(F.col("gap") != 0) > worst * F.count("*")).alias("refused"))
    return rows.join(bad.where("not refused").select("entity"), "entity", "left_semi").select("event", "entity", "figure", "gap")


def period_ranking(parts: DataFrame, by: str, periods: list[int], value: Column, k: int, every: bool = False) -> DataFrame:
    """A period figure ranked, with the rows behind each and behind the pool; ``every`` asks for a figure in each period."""
    wide = parts.where(F.col("period").isin(*periods)).groupBy(by).agg(F.count("*").alias("checked"), F.sum(value).cast("double").alias("figure"), F.count_distinct("period").alias("_in"))
    some = (wide.where(F.col("_in") == len(periods)) if every else wide).drop("_in")
    pool = F.broadcast(some.agg(F.sum("checked").alias("pool_checked")))
    return some.orderBy(F.desc_nulls_last("figure"), F.asc(by)).limit(k).join(pool)


def with_without(events: DataFrame, sides: list[DataFrame], stints: list[DataFrame]) -> DataFrame:
    """A group's record with and without companions, on days on which all of them belong to it."""
    rows = events
    for s in stints:
        rows = rows.join(s.select(F.col("group").alias("_g"), F.col("first_day").alias("_f"), F.col("last_day").alias("_l")), (F.col("group") == F.col("_g")) & F.col("day").between(F.col("_f"), F.col("_l")), "left_semi")
    for i, s in enumerate(sides):
        rows = rows.join(s.select("group", "day").distinct().withColumn(f"_in{i}", F.lit(1)), ["group", "day"], "left")
    there = sum((F.coalesce(F.col(f"_in{i}"), F.lit(0)) for i in range(len(sides))), F.lit(0))
    which = F.when(there == len(sides), "with all").when(there == 0, "without any").otherwise("with some")
    return rows.groupBy(which.alias("presence")).agg(F.count("*").alias("games"), *agg.record())


@dataclass(frozen=True)
class Companion:
    """An entity and its role in an event: played, started, bench, or reached (``figure`` at least ``least``)."""

    entity: object
    role: str = "played"
    figure: str | None = None
    least: float | None = None

    def holds(self, entity: str, played: Column, starter: str) -> Column:
        own = (F.col(entity) == self.entity) & played
        if self.role == "reached":
            return F.coalesce(own & (F.col(self.figure) >= self.least), F.lit(False))
        roles = {"played": own, "started": own & F.col(starter), "bench": own & ~F.col(starter)}
        return F.coalesce(roles[self.role], F.lit(False))


def presence(events: DataFrame, box: DataFrame, on: list[str], mates: list[Companion], spans: list[DataFrame], beside: list[Companion] | None = None, subject=None, figures: list[str] | None = None, played: Column | None = None, entity: str = "entity", group: str = "group", day: str = "day", starter: str = "starter") -> DataFrame:
    """A group's record by how many companions held their roles: all, some, none, and ``unknown`` events, which have no detail at all.

    Events count on days on which all companions belong to the group (``spans``
    of each: group, first_day, last_day). Events in which one of ``beside`` did
    not hold its role count nowhere. With a ``subject``, its events and mean
    figures in each set, over those it played. Each event's detail is read
    once: roles are bits of one number, put together by one aggregate.
    """
    beside, figures = list(beside or ()), list(figures or ())
    bits = [*mates, *beside]
    if len(bits) > 62:
        raise ValueError("62 roles at most")
    played = F.lit(True) if played is None else F.coalesce(played, F.lit(False))
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c.holds(entity, played, starter), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(bits)])
    own = (F.col(entity) == subject) & played if subject is not None else F.lit(False)
    detail = box.groupBy(*on).agg(F.bit_or(mask).alias("_mask"), F.count_if(played).alias("_known"), F.bool_or(own).alias("_own"), *[F.max(F.when(own, F.col(f))).alias(f"_f_{f}") for f in figures])
    inside = reduce(lambda a, b: windows.overlaps(a, b, [group]), [s.select(group, "first_day", "last_day") for s in spans])
    rows = within_spans(events, inside.withColumnsRenamed({"first_day": "_first", "last_day": "_last"}), [group], day, "left_semi", "_first", "_last").join(detail, on, "left")
    known = F.coalesce(F.col("_known") > 0, F.lit(False))
    full, extra = (1 << len(mates)) - 1, ((1 << len(beside)) - 1) << len(mates)
    rows = rows.where(~known | (F.col("_mask").bitwiseAND(F.lit(extra)) == extra))
    held = F.col("_mask").bitwiseAND(F.lit(full))
    which = F.when(~known, "unknown").when(held == full, "all").when(held == 0, "none").otherwise("some")
    of_subject = [F.count_if("_own").alias("subject_games"), *[agg.mean(F.when(F.col("_own"), F.coalesce(f"_f_{f}", F.lit(0)))).alias(f"avg_{f}") for f in figures]] if subject is not None else []
    return rows.groupBy(which.alias("presence")).agg(F.count("*").alias("games"), *agg.record(), agg.mean("margin").alias("avg_margin"), *of_subject)


def team_record(rel: Rel, by: list[str]) -> DataFrame:
    return rel.df.groupBy(*by).agg(F.count("*").alias("games"), *agg.record(rel.name("won")))


def team_log(sides: DataFrame, by: list[str], figure: str) -> DataFrame:
    """Each side's events by ``by``, with its record and its total of a box figure over exactly those."""
    return sides.groupBy(*by).agg(F.count("*").alias("games"), *agg.record(), agg.total(figure).alias("figure"))


def team_splits(sides: DataFrame, team: str = "team", opp: str = "opp", home: str = "home") -> DataFrame:
    """Each team's record at home, away, and where neither side is at home (one id on both sides)."""
    place = F.when(F.col(team) == F.col(opp), "neutral").when(F.col(home), "home").otherwise("away")
    return sides.groupBy(team, place.alias("place")).agg(F.count("*").alias("games"), *agg.record())


def team_record_when(sides: DataFrame, figure: str, least, team: str = "team") -> DataFrame:
    """Each team's record where a figure reaches a line, falls short of it, or is unknown (blank)."""
    f = F.col(figure)
    line = F.when(f.isNull(), "blank").when(f >= least, "reached").otherwise("short")
    return sides.groupBy(team, line.alias("line")).agg(F.count("*").alias("games"), *agg.record())


def head_to_head(sides: DataFrame, figure: str, last: int | None = None, order: list[str] | None = None, team: str = "team", opp: str = "opp") -> DataFrame:
    """Each pair of teams once, by the smaller: meetings, record and figure, over the last meetings by ``order`` if asked."""
    rows = sides.where(F.col(team) < F.col(opp))
    if last is not None:
        if not order:
            raise ValueError("a window of meetings needs an order")
        newest = Window.partitionBy(team, opp).orderBy(*[F.desc_nulls_last(c) for c in order])
        rows = rows.withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= last).drop("_at")
    return rows.groupBy(team, opp).agg(F.count("*").alias("met"), *agg.record(), agg.total(figure).alias("figure"))


def team_total(rel: Rel, figure: Column, by: list[str]) -> DataFrame:
    """A figure's sum, with the games behind it and how many of them it could be read in."""
    return rel.df.groupBy(*by).agg(F.count("*").alias("games"), F.count(figure).alias("counted"), agg.total(figure).alias("total"))


def team_period(parts: DataFrame, by: list[str], event: str, in_period: Column, value: str) -> DataFrame:
    """A figure in some periods beside the whole, and the events behind both."""
    return parts.groupBy(*by).agg(F.count_distinct(event).alias("games"), agg.total(F.when(in_period, F.col(value))).alias("half"), agg.total(value).alias("whole"))


def team_period_line(parts: DataFrame, by: list[str], player: Column, value: str, roster: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """A team's period figure, what has no player apart; with a roster, its members without a row are counted at zero rows."""
    out = parts.groupBy(*by).agg(agg.total(F.when(player.isNotNull(), F.col(value))).alias("known"), agg.total(F.when(player.isNull(), F.col(value))).alias("unassigned"))
    if roster is None:
        return out
    idle = roster.join(parts.select(*on).distinct(), on, "left_anti").groupBy(*by).agg(F.count("*").alias("idle"))
    return out.join(idle, by, "full").withColumn("idle", F.coalesce("idle", F.lit(0)))


def team_history(rel: Rel, figure: str) -> DataFrame:
    """Each team's seasons; the mean is shown only where as many entities are listed as rows were played."""
    g = rel.df.groupBy(rel.name("group"), rel.name("season")).agg(F.count("*").alias("played"), agg.mean(figure).alias("average"), F.count_distinct(rel.name("entity")).alias("listed"))
    return g.select(rel.name("group"), rel.name("season"), "played", F.when(F.col("listed") == F.col("played"), F.col("average")).alias("average"))


def located_shots(rows: DataFrame, event: str, made: Column, order: list[str], columns: list[Column]) -> DataFrame:
    """Located shots in their event's total order, with the shots, makes and unknown outcomes of the event; ``made`` is null where unknown."""
    w = Window.partitionBy(event)
    place = F.row_number().over(w.orderBy(*order)).cast("long")
    d = rows.withColumn("_made", made)
    return d.select(event, *columns, place.alias("place"), F.count("*").over(w).alias("total"), F.count_if("_made").over(w).alias("good"), F.count_if(F.col("_made").isNull()).over(w).alias("unknown"))


def ranked_metric(df: DataFrame, metrics: dict[str, bool], key: str) -> DataFrame:
    """Long form: each group's value and rank in every metric; True: more is better."""
    rows = agg.unpivot(df, [key], list(metrics), "metric", "value").where("value is not null")
    better = F.col("metric").isin(*[m for m, up in metrics.items() if up])
    signed = rows.withColumn("_v", F.when(better, F.col("value")).otherwise(-F.col("value")))
    return windows.competition_rank(signed, "_v", key=["metric"]).drop("_v")


def standings(rows: DataFrame, text: str) -> DataFrame:
    w, l = two_parts(F.col(text))  # noqa: E741
    return rows.withColumns({"wins": w, "losses": l})


def records_since(groups: DataFrame, rel: Rel) -> DataFrame:
    """Every group's record over narrowed rows, also of groups without any."""
    r = rel.df.groupBy(rel.name("group")).agg(*agg.record(rel.name("won")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return groups.join(r, rel.name("group"), "left").select(*groups.columns, zero("wins"), zero("losses"))


def fingerprint(long: DataFrame, entity: str, category: str, value: str, weight: str, floor: int) -> DataFrame:
    """Each entity's value by category with its percentile in the pool of entities with enough rows, and the pool's best and size (``fingerprints`` has also those outside it)."""
    per = long.groupBy(entity, category).agg(agg.mean(value).alias("value"), F.sum(weight).alias("_n"))
    pool = per.where(F.col("_n") >= floor).drop("_n")
    w = windows.percentile(pool, "value", key=[category])
    about = pool.groupBy(category).agg(F.max("value").alias("pool_best"), F.count("*").alias("pool_size"))
    return w.join(about, category)


def fingerprints(long: DataFrame, entity: str, category: str, value: str, weight: str, floor, times: float = 100.0) -> DataFrame:
    """Each entity's value by category, in ``times`` units of weight, with its percentile among the entities of enough weight, their mean, best and number; ``in_pool`` says whether it is one of them."""
    per = long.groupBy(entity, category).agg(ratio(F.sum(value), F.sum(weight), times).alias("value"), F.sum(weight).alias("_n")).withColumn("in_pool", F.coalesce(F.col("_n") >= floor, F.lit(False))).drop("_n")
    return _against(per, per.where("in_pool"), category, False)


def event_fingerprints(rows: DataFrame, entity: str, event: str, category: str, value: str, weight: str, floor, order: list[str], first: bool = False) -> DataFrame:
    """The values of each entity's latest (or first) event, against all entities' events of enough weight; ties count half, as most do nothing in most categories."""
    chosen = (F.min if first else F.max)(F.struct(*order, event)).alias("_at")
    at = rows.groupBy(entity).agg(chosen).select(entity, F.col(f"_at.{event}").alias(event))
    long = rows.select(entity, event, category, F.col(value).cast("double").alias("value"), F.coalesce(F.col(weight) >= floor, F.lit(False)).alias("in_pool"))
    return _against(long.join(at, [entity, event], "left_semi"), long.where("in_pool"), category, True)


def _against(rows: DataFrame, pool: DataFrame, category: str, midrank: bool) -> DataFrame:
    about = pool.groupBy(category).agg(F.avg("value").alias("pool_mean"), F.max("value").alias("pool_best"), F.count("value").alias("pool_size"))
    return windows.percentile_in(rows, pool, "value", [category], midrank).join(about, category, "left")


def comparison_gaps(prints: DataFrame, entities: list, entity: str, category: str) -> DataFrame:
    """For entities side by side, each category's spread, who leads it (nobody where all are equal), and the spread's share of the widest."""
    g = prints.where(F.col(entity).isin(*entities)).groupBy(category).agg((F.max("value") - F.min("value")).alias("gap"), F.min_by(entity, F.struct(-F.col("value"), F.col(entity))).alias("leader"))
    widest = F.broadcast(g.agg(F.max("gap").alias("_widest")))
    return g.join(widest).select(category, "gap", F.when(F.col("gap") > 0, F.col("leader")).alias("leader"), F.when(F.col("_widest") > 0, F.col("gap") / F.col("_widest")).otherwise(0.0).alias("share"))


def event_line(df: DataFrame, entity: str, columns: list[str], order: list[str], first: bool = False) -> DataFrame:
    """Each entity's line of its first or latest event."""
    pick = (F.min if first else F.max)(F.struct(*order, *columns)).alias("_at")
    return df.groupBy(entity).agg(pick).select(entity, *[F.col(f"_at.{c}").alias(c) for c in dict.fromkeys([*order, *columns])])


def shot_distances(shots: DataFrame, by: list[str], value: Column, x: Column, y: Column, only: int | None = None, events: DataFrame | None = None, event: str = "event") -> DataFrame:
    """Mean distance from the rim, shots and events, of located shots that are no free throws; of one shot value, or over pinned events, if asked."""
    rows = shots if events is None else shots.join(events.select(event).distinct(), event, "left_semi")
    rows = rows.withColumn("_value", value).where(court.has_position(x, y)).where(~F.col("_value").eqNullSafe(F.lit(1)))
    rows = rows if only is None else rows.where(F.col("_value") == only)
    # an event's shots are summed first, so that its count needs no shuffle where shots are dealt by event
    one = rows.groupBy(*by, event).agg(F.sum(court.rim_distance(x, y)).alias("_far"), F.count("*").alias("_n"))
    return one.groupBy(*by).agg((F.sum("_far") / F.sum("_n")).alias("distance"), F.sum("_n").alias("shots"), F.count(event).alias("events"))


def radius(c: Column, low: Column, high: Column) -> Column:
    """A value on the way from the pool's least to its greatest; below 0 on the half that negative values have."""
    up = F.when(high > 0, c / high).otherwise(0.0)
    down = F.when(low < 0, -(c / low)).otherwise(0.0)
    return F.when(c >= 0, 0.5 + up / 2).otherwise(0.5 + down / 2)


def coverage_gate(asked: DataFrame, floors: DataFrame, table: str = "table") -> DataFrame:
    """A question is refused below the latest first season of the tables it reads; partial seasons get a note."""
    t = asked.select("question", "season", F.explode("tables").alias(table)).join(F.broadcast(floors), table)
    g = t.groupBy("question", "season").agg(F.max("first").alias("floor"), F.bool_or(F.array_contains("partial", F.col("season"))).alias("partial"))
    return g.withColumn("refused", F.col("season") < F.col("floor"))


def redirect(rel: Rel, narrowed: Rel) -> DataFrame:
    """For entities that narrowing leaves without a row: where they do have rows."""
    e, s = rel.name("entity"), rel.name("season")
    base = rel.df.groupBy(e).agg(F.min(s).alias("first"), F.max(s).alias("last"), F.count("*").alias("games"))
    return base.join(narrowed.df.select(e), e, "left_anti")


def unread_counts(rel: Rel, figure: str, rebuilt: Column, by: list[str]) -> DataFrame:
    return rel.df.groupBy(*by).agg(F.count("*").alias("games"), F.count_if(rebuilt).alias("rebuilt"), F.count_if(F.col(figure).isNull()).alias("unread"))


