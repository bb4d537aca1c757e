"""Repairs and derived tables: pure DataFrame steps in the order in which a load applies them."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .ranges import FEW, dealt, numbered
from .windows import keep_one


def swap_sides(df: DataFrame, fixes: DataFrame, key: str, a: str, b: str, served: str) -> DataFrame:
    """Rows of listed keys get two columns swapped, but only while they are still served with the value that is wrong."""
    f = fixes.select(F.col(key), F.col(served).alias("_wrong"))
    out = df.join(f, key, "left")
    hit = F.col("_wrong").isNotNull() & (F.col(a) == F.col("_wrong"))
    x, y = F.when(hit, F.col(b)).otherwise(F.col(a)), F.when(hit, F.col(a)).otherwise(F.col(b))
    return out.withColumns({"_x": x, "_y": y, "swapped": F.coalesce(hit, F.lit(False))}).withColumns({a: F.col("_x"), b: F.col("_y")}).drop("_wrong", "_x", "_y")


def repair_parent(parent: DataFrame, child_sums: DataFrame, on: list[str], column: str, rebuilt: str, fault: Column) -> DataFrame:
    """A parent's figure is replaced by the one from its children where a fault holds; without children it is null there."""
    out = parent.join(child_sums.select(*on, rebuilt), on, "left")
    return out.withColumn(column, F.when(fault, F.col(rebuilt)).otherwise(F.col(column)))


def rebuild_totals(df: DataFrame, key: list[str], part: str, sums: list[str], check: list[str] | None = None, derived: dict[str, tuple[Callable[[Callable[[str], Column]], Column], str, int]] | None = None, unknown: list[str] | None = None) -> DataFrame:
    """Total rows (null part) that disagree with their parts are rebuilt from them, as a whole; ``repaired`` says so.

    A total is wrong if a figure of ``check`` (all sums, if not given) is not
    the parts' sum, also where it is null; without parts it stays as it is.
    ``derived`` figures are a numerator of the sums over one of them, rounded:
    ``{"pct": (lambda s: 100.0 * s("made"), "tried", 1)}``; null where that is 0
    or unknown. ``unknown`` figures, which no part proves, become null.
    """
    # parts of one key have one row each; a null key has no total of its own
    parts = df.where(F.col(part).isNotNull()).groupBy(*key).agg(F.lit(True).alias("_there"), *[F.sum(c).alias(f"_{c}") for c in sums])
    out = df.join(parts, key, "left")
    differs = [~F.col(c).eqNullSafe(F.col(f"_{c}")) & (F.col(f"_{c}").isNotNull() if check is None else F.lit(True)) for c in check or sums]
    wrong = F.col(part).isNull() & F.col("_there").isNotNull() & reduce(or_, differs, F.lit(False))
    out = out.withColumn("repaired", wrong)
    new = {c: F.col(f"_{c}") for c in sums} | {c: F.lit(None) for c in unknown or ()}
    for name, (numerator, below, digits) in (derived or {}).items():
        new[name] = F.round(ratio(numerator(lambda c: F.col(f"_{c}").cast("double")), F.col(f"_{below}").cast("double")), digits)
    return out.withColumns({c: F.when(F.col("repaired"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_there", *[f"_{c}" for c in sums])


def with_share(df: DataFrame, event: list[str], value: str, name: str = "share") -> DataFrame:
    """Each row's share of its event's total."""
    return df.withColumn(name, ratio(F.col(value), F.sum(value).over(Window.partitionBy(*event))))


BOX = ("minutes", "fga", "fgm", "fg3m", "fta", "ftm", "points", "oreb", "dreb", "ast", "stl", "blk", "fouls", "tov")


def _with_team(box: DataFrame, team: list[str]) -> DataFrame:
    """Box lines (columns BOX) with their side's minutes and plays, and their own plays; one window, no join."""
    w = Window.partitionBy(*team)
    used = lambda f: f("fga") + F.lit(0.44) * f("fta") + f("tov")
    of_team = lambda c: F.sum(F.col(c)).over(w)
    return box.withColumns({"_used": used(F.col).cast("double"), "_team_used": used(of_team).cast("double"), "_team_minutes": of_team("minutes").cast("double")})


def line_score() -> Column:
    """A line's figures weighed into one; exact where they are integers."""
    c, x = F.col, lambda v: F.lit(Decimal(v))
    out = c("points") + x("0.4") * c("fgm") - x("0.7") * c("fga") - x("0.4") * (c("fta") - c("ftm")) + x("0.7") * c("oreb") + x("0.3") * c("dreb")
    return (out + c("stl") + x("0.7") * c("ast") + x("0.7") * c("blk") - x("0.4") * c("fouls") - c("tov")).cast("double")


def advanced_game(box: DataFrame, team: list[str]) -> DataFrame:
    """Box lines with true_shooting, effective_shooting, usage and line_score; ``team`` is the key of a side in an event. Null without attempts, and usage without minutes."""
    d = _with_team(box, team)
    s = shooting(F.col("fgm"), F.col("fga"), F.col("fg3m"), F.col("points"), F.col("fta"), 1.0)
    usage = F.when(F.col("minutes") > 0, ratio(F.col("_used") * F.col("_team_minutes") / 5.0, F.col("minutes") * F.col("_team_used"), 100.0))
    return d.withColumns(s | {"usage": usage, "line_score": line_score()}).drop("_used", "_team_used", "_team_minutes")


def advanced_season(box: DataFrame, team: list[str], key: list[str]) -> DataFrame:
    """Season lines: each metric a ratio of sums beside the volume that it qualifies on."""
    d = _with_team(box, team)
    total = lambda c: F.sum(F.col(c)).cast("double")
    tried = total("fga") + 0.44 * total("fta")
    return d.groupBy(*key).agg(
        F.count("points").alias("lines"), F.sum("fga").cast("long").alias("attempts"), tried.alias("tries"), ratio(total("points"), 2.0 * tried).alias("true_shooting"),
        ratio(total("fgm") + 0.5 * total("fg3m"), total("fga")).alias("effective_shooting"), ratio(F.sum(F.col("_used") * F.col("_team_minutes") / 5.0), F.sum(F.col("minutes").cast("double") * F.col("_team_used")), 100.0).alias("usage"), F.avg(line_score()).alias("mean_line_score"),
    )


def fact_log(lines: DataFrame, events: DataFrame, names: list[tuple[DataFrame, str]], event: str = "event") -> DataFrame:
    """Fact lines with their event's columns and, by each key in turn, the columns of a dimension; every line stays."""
    out = lines.join(events, event, "left")
    for dim, key in names:
        out = out.join(dim, key, "left")
    return out


def shooting(made: Column, attempts: Column, threes: Column, points: Column, free: Column, times: float = 100.0) -> dict[str, Column]:
    """True and effective shooting as ratios, null without attempts."""
    return {"true_shooting": ratio(points, 2 * (attempts + F.lit(0.44) * free), times), "effective_shooting": ratio(made + F.lit(0.5) * threes, attempts, times)}


def rebuild_lines(events: DataFrame, key: list[str], actors: list[tuple[str, dict[str, Column]]], roster: DataFrame | None = None) -> DataFrame:
    """Lines from child events: each actor column with the figures it is credited with, put together and summed by entity and key."""
    names = list(dict.fromkeys(n for _, m in actors for n in m))
    kind = "decimal(28,2)"
    credit = lambda col, m: F.struct(F.col(col).alias("entity"), *[(m[n] if n in m else F.lit(None)).cast(kind).alias(n) for n in names])
    # lines stay where their key is: a row for each actor, summed once
    parts = events.select(*key, F.explode(F.array(*[credit(col, m) for col, m in actors])).alias("_c")).select(*key, "_c.*").where("entity is not null")
    out = parts.groupBy(*key, "entity").agg(*[F.sum(n).alias(n) for n in names])
    return out if roster is None else out.join(roster, [*key, "entity"], "left_semi")


def rebuild_empty(stored: DataFrame, events: DataFrame, key: list[str], figure: str, actors: list[tuple[str, dict[str, Column]]], roster: DataFrame | None = None) -> DataFrame:
    """Lines from child events of those parents only whose stored lines all lack a figure; a parent with one line that has it is left alone, and so is one without lines."""
    empty = stored.groupBy(*key).agg(F.max(figure).alias("_most")).where("_most is null").select(*key)
    return rebuild_lines(events.join(empty, key, "left_semi"), key, actors, roster)


def fill_lines(stored: DataFrame, rebuilt: DataFrame, on: list[str], columns: list[str], empty: Column, unproven: tuple[str, ...] = ()) -> DataFrame:
    """Where a stored line is empty, the rebuilt one stands for it and is flagged; figures nobody proves are null there."""
    r = rebuilt.select(*on, *[F.col(c).alias(f"_{c}") for c in columns if c not in unproven], F.lit(True).alias("_there"))
    out = stored.join(r, on, "left").withColumn("reconstructed", empty & F.coalesce(F.col("_there"), F.lit(False)))
    new = {c: F.when(F.col("reconstructed"), F.lit(None) if c in unproven else F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return out.withColumns(new).drop("_there", *[f"_{c}" for c in columns if c not in unproven])


def merge_identities(fact: DataFrame, dim: DataFrame, entity: str, name: str, event: list[str], figures: list[str], played: Column) -> DataFrame:
    """Ids that share a name and an event are one entity, if every event they share is safe: one line is empty, or both are equal.

    The id with most played events, then events, then the least, stands for the name. Of an event's two rows the one that played stays, then the one under the standing id.

    Every step on lines is by event, so lines dealt by event (``ranges.dealt``) are not dealt again, but where the names are too many to be held by every task.
    """
    few = dim.count() <= FEW
    named = fact.join(F.broadcast(dim.select(entity, name)) if few else dim.select(entity, name), entity)
    if not few:
        named = dealt(named, fact.count(), *event)
    least = [f(c).alias(f"{a}{c}") for c in figures for a, f in (("_lo_", F.min), ("_hi_", F.max), ("_n_", F.count))]
    each = named.groupBy(name, *event, entity).agg(*least, F.count("*").alias("_rows"), F.count_if(played).alias("_played"))
    most = [x for c in figures for x in (F.min(f"_lo_{c}").alias(f"_lo_{c}"), F.max(f"_hi_{c}").alias(f"_hi_{c}"), F.sum(f"_n_{c}").alias(f"_n_{c}"))]
    twins = each.groupBy(name, *event).agg(F.count(entity).alias("ids"), *most, F.sum("_rows").alias("_rows"), F.sum("_played").alias("_played"))
    safe = F.lit(True)
    for c in figures:  # all null, or none and all equal
        safe = safe & ((F.col(f"_n_{c}") == 0) | ((F.col(f"_n_{c}") == F.col("_rows")) & (F.col(f"_lo_{c}") == F.col(f"_hi_{c}"))))
    shared = twins.where("ids = 2").groupBy(name).agg(F.bool_and(safe | (F.col("_played") <= 1)).alias("ok")).where("ok").select(name)
    order = named.groupBy(name, entity).agg(F.count_if(played).alias("p"), F.count("*").alias("n"))
    best = keep_one(order, [name], [F.desc("p"), F.desc("n"), F.asc(entity)]).select(name, F.col(entity).alias("_main")).join(shared, name, "left_semi")
    best = F.broadcast(best) if few else best
    out = named.join(best, name, "left").withColumn("_own", F.coalesce(F.col("_main") == F.col(entity), F.lit(True)))
    out = out.withColumn("_was", F.col(entity)).withColumn(entity, F.coalesce("_main", entity))
    return keep_one(out, [entity, *event], [F.coalesce(played, F.lit(False)).desc(), F.col("_own").desc(), F.col("_was").asc()]).drop("_main", "_own", "_was")


def real_events(events: DataFrame, detail: DataFrame, members: DataFrame, event: list[str], season: str, sides: tuple[str, str], day: str, decided: Column, dated_only: Column) -> DataFrame:
    """Decided events of known members; one that has a day but no time stays only with detail, or in a season that has none at all; one for each pair and day, the one with detail first."""
    seen = detail.select(*event).distinct().withColumn("_detail", F.lit(True))
    has = events.where(decided).join(seen, event, "left").withColumn("_detail", F.coalesce("_detail", F.lit(False)))
    for s in sides:
        has = has.join(members.select(F.col(members.columns[0]).alias(s)), s, "left_semi")
    any_ = has.groupBy(season).agg(F.bool_or("_detail").alias("_any"))
    has = has.join(any_, season).where(~dated_only | F.col("_detail") | ~F.col("_any"))
    a, b = F.least(*sides), F.greatest(*sides)
    rows = has.withColumns({"_a": a, "_b": b})
    return keep_one(rows, ["_a", "_b", day, season], [F.col("_detail").desc(), *[F.col(c).asc() for c in event]]).drop("_a", "_b", "_any", "_detail")


def number_series(events: DataFrame, a: str, b: str, order: list[str], season: list[str], given: str | None = None) -> DataFrame:
    """Each pair's series numbered from both sides; the round where both agree, and each event's number in its series, or the ``given`` one where there is one."""
    pair = [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]
    series = events.select(*season, *pair, *order).groupBy(*season, "x", "y").agg(F.min(F.struct(*order)).alias("_first"))
    side = series.select(*season, "x", "y", "_first", F.explode(F.array("x", "y")).alias("member"))
    nth = numbered(side.withColumn("_at", F.col(f"_first.{order[0]}")), [*season, "member"], ["_at", "_first", "x", "y"], "_n")
    rounds = nth.groupBy(*season, "x", "y").agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    rounds = rounds.select(*season, "x", "y", F.when(F.col("lo") == F.col("hi"), F.col("lo")).cast("long").alias("round"))
    rows = events.withColumns({"x": pair[0], "y": pair[1]})
    no = F.row_number().over(Window.partitionBy(*season, "x", "y").orderBy(*order)).cast("long")
    no = F.coalesce(F.col(given).cast("long"), no) if given else no
    return rows.withColumn("game_no", no).join(rounds, [*season, "x", "y"])


def gaps(fact: DataFrame, rebuilt: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Stored less rebuilt for each figure, of events that the rebuilt frame covers; nothing rebuilt counts 0."""
    r = rebuilt.select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    return fact.join(r, on, "left").select(*on, *[(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(f"{c}_gap") for c in columns])


def dedup_seasons(df: DataFrame, key: list[str], sibling: list[str], kind: str, figures: list[str], games: str, most: int, combined: Column) -> DataFrame:
    """Rows of the second kind that are impossible or equal their sibling go; then one row of each key, the combined one first."""
    first = df.where(F.col(kind) == 2).select(*[F.col(c).alias(f"_{c}") for c in (*sibling, *figures)])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*sibling, *figures)]
    second = df.where((F.col(kind) == 3) & (F.col(games) <= most)).join(first, same, "left_anti")
    return keep_one(df.where(F.col(kind) != 3).unionByName(second), key, [combined.desc(), F.col(games).desc(), *[F.col(c).asc_nulls_first() for c in figures]])


def name_as_of(df: DataFrame, eras: DataFrame, key: str, season: str, current: str) -> DataFrame:
    """The name that held in a row's season; eras are open at the end."""
    e = eras.select(F.col(key).alias("_k"), F.col("first").alias("_f"), F.coalesce("last", F.lit(9999)).alias("_l"), F.col("name").alias("_n"))
    return df.join(e, (F.col(key) == F.col("_k")) & F.col(season).between(F.col("_f"), F.col("_l")), "left").withColumn("name_then", F.coalesce("_n", current)).drop("_k", "_f", "_l", "_n")


def fill_missing(rows: DataFrame, totals: DataFrame, key: list[str], value: str, games: str) -> DataFrame:
    """A blank figure takes the total of its key, only where exactly one row of the key is blank and its games are the total's."""
    w = Window.partitionBy(*key, F.col(value).isNull())
    t = totals.select(*key, F.col(value).alias("_total"), F.col(games).alias("_games"))
    out = rows.withColumn("_n", F.count("*").over(w)).join(t, key, "left")
    ok = F.col(value).isNull() & (F.col("_n") == 1) & (F.col(games) == F.col("_games"))
    return out.withColumn("filled", F.coalesce(ok & F.col("_total").isNotNull(), F.lit(False))).withColumn(value, F.when(ok, F.col("_total")).otherwise(F.col(value))).drop("_n", "_total", "_games")
