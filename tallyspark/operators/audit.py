"""Data-quality audits: a row for each problem, none when clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diff import table_diff
from .ranges import dealt


def coverage(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Rows of each table by group, from one grouped scan of each."""
    out = None
    for name, df in tables.items():
        n = df.groupBy(*by).agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, by, "full")
    return out.fillna(0, list(tables))


def coverage_report(tables: dict[str, DataFrame], by: list[str], counted: str, expected: DataFrame, settled: DataFrame, markers: DataFrame) -> DataFrame:
    """``coverage``, with what the groups should hold of the table ``counted``.

    ``expected`` and ``settled`` have a column n by group: how many units there
    should be, and how many are known never to come. A group with a marker is
    complete and is taken at its word: nothing is expected of it. ``missing`` is
    what is neither there nor settled. A group that is only expected is shown.
    """
    of = lambda d, name: d.groupBy(*by).agg(F.sum("n").alias(name))
    out = coverage(tables, by).join(of(expected, "_want"), by, "full").join(of(settled, "settled"), by, "left")
    out = out.join(markers.select(*by).distinct().withColumn("_done", F.lit(True)), by, "left")
    done = F.col("_done").isNotNull()
    have = F.coalesce(counted, F.lit(0)) + F.coalesce("settled", F.lit(0))
    want = F.when(~done, F.coalesce("_want", F.lit(0)))
    return out.select(*by, *[F.coalesce(t, F.lit(0)).alias(t) for t in tables], F.coalesce("settled", F.lit(0)).alias("settled"), want.alias("expected"), F.when(~done, F.greatest(want - have, F.lit(0))).alias("missing"), done.alias("complete"))


def floor_check(df: DataFrame, season: str, floor: int, share: float = 0.55) -> DataFrame:
    """Seasons from the floor on with too few rows against the median season, and usable seasons below it."""
    n = df.groupBy(season).agg(F.count("*").alias("rows"))
    med = F.broadcast(n.where(F.col(season) >= floor).agg(F.median("rows").alias("_median")))
    rows = n.join(med)
    ok = F.col("rows") >= share * F.col("_median")
    problem = F.when((F.col(season) >= floor) & ~ok, "thin").when((F.col(season) < floor) & ok, "usable below floor")
    return rows.withColumn("problem", problem).where("problem is not null").drop("_median")


def phantom_seasons(df: DataFrame, season: str, key: list[str]) -> DataFrame:
    """Seasons all of whose keys stand in the next one as well."""
    a = df.select(season, *key).distinct()
    nxt = a.select((F.col(season) - 1).alias(season), *key).withColumn("_same", F.lit(1))
    return a.join(nxt, [season, *key], "left").groupBy(season).agg(F.count("*").alias("keys"), F.count("_same").alias("again")).where("keys = again")


def shrinking_pool(df: DataFrame, season: str, entity: str, share: float = 0.9) -> DataFrame:
    """Seasons with fewer distinct entities than the share of the one before."""
    n = df.groupBy(season).agg(F.count_distinct(entity).alias("entities"))  # a row per season
    before = F.lag("entities").over(Window.orderBy(season))
    return n.withColumn("before", before).where(F.col("entities") < share * F.col("before"))


def disagreement(parent: DataFrame, child: DataFrame, on: list[str], col: str, by: list[str], least: float = 99.0) -> DataFrame:
    """Groups in which fewer parents than asked agree with their children's sum."""
    both = parent.join(child.select(*on, F.col(col).alias("_sum")), on)
    share = both.groupBy(*by).agg((F.count_if(F.col(col) == F.col("_sum")) * 100.0 / F.count("*")).alias("agree_pct"))
    return share.where(F.col("agree_pct") < least)


def uncleared(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """How many rows still have a figure in columns that should be cleared, and how many have none in any."""
    none = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()
    return df.groupBy(*by).agg(*[F.count(c).alias(c) for c in columns], F.count_if(none).alias("empty"))


def staleness(fresh: DataFrame, stored: DataFrame, ranges: int = 1024) -> DataFrame:
    """How many rows only one of the two tables holds, repeated rows counted: only ranges of rows whose digests differ are compared row by row."""
    sides = table_diff(stored, fresh, ranges)
    return sides.agg(F.count_if(F.col("side") == "left").alias("stale"), F.count_if(F.col("side") == "right").alias("missing"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def label_disagreement(df: DataFrame, label: str, pattern: str, number: str) -> DataFrame:
    """Rows whose supplied label names another number than the computed one."""
    said = F.nullif(F.regexp_extract(label, pattern, 1), F.lit("")).try_cast("long")
    return df.withColumn("said", said).where(F.col("said").isNotNull() & ~F.col("said").eqNullSafe(F.col(number).cast("long")))


def neighbour_days(rows: DataFrame, events: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """Rows without an event on their day that have one the day before or after."""
    e = events.select(*key, F.col(day).alias("_d")).distinct()
    none = rows.join(e.withColumnRenamed("_d", day), [*key, day], "left_anti")
    near = none.withColumn("_d", F.explode(F.array(F.date_sub(day, 1), F.date_add(day, 1))))
    return near.join(e, [*key, "_d"]).withColumn("shift", F.date_diff("_d", day)).drop("_d")


def unmatched_share(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("unmatched"))


def identity_pairs(fact: DataFrame, dim: DataFrame, entity: str, name: str, event: list[str], rows: int | None = None) -> DataFrame:
    """Two ids of one name that stand in one event: the name, both ids and how many events they share.

    Lines get their names by id and then meet by name and event, each time
    dealt over tasks of a bounded size; ``rows`` is how many lines there are,
    counted if not given.
    """
    rows = fact.count() if rows is None else rows
    named = dealt(fact.select(F.col(entity).alias("_id"), *event), rows, "_id").join(dim.select(F.col(entity).alias("_id"), F.col(name).alias("name")), "_id").where("name is not null")
    # most events have one id of a name: only those with more are paired, each id with the greater ones
    held = dealt(named, rows, "name", *event).groupBy("name", *event).agg(F.array_sort(F.collect_set("_id")).alias("_ids")).where(F.size("_ids") > 1)
    firsts = held.select("name", "_ids", F.posexplode("_ids").alias("_i", "id"))
    both = firsts.select("name", "id", F.explode(F.slice("_ids", F.col("_i") + 2, F.size("_ids"))).alias("id_2"))
    return dealt(both, rows, "id", "id_2").groupBy("name", "id", "id_2").agg(F.count("*").alias("events"))


def tiers(coverage_table: DataFrame, tier: str, first: str, last: str) -> DataFrame:
    """For cumulative sets of tables: each tier can use the latest of the first seasons and the earliest of the last ones so far."""
    w = Window.orderBy(tier).rowsBetween(Window.unboundedPreceding, 0)  # a row per tier
    per = coverage_table.groupBy(tier).agg(F.max(first).alias("f"), F.min(last).alias("l"))
    return per.select(tier, F.max("f").over(w).alias("first"), F.min("l").over(w).alias("last"))


def ambiguous_aliases(aliases: DataFrame, alias: Column, entity: str) -> DataFrame:
    return aliases.groupBy(alias.alias("alias")).agg(F.count_distinct(entity).alias("entities")).where("entities <> 1")
