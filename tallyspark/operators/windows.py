"""Runs, stints, ranks and tie-aware cuts, none of which sends a large table to one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import LARGE, ranged

#: Ranges of values that are counted apart, of a whole table and of each key.
RANGES, KEY_RANGES = 256, 64


def keep_one(df: DataFrame, key: list[str], prefer: list[Column]) -> DataFrame:
    """The preferred row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*prefer))).where("_rn = 1").drop("_rn")


def longest_runs(df: DataFrame, keys: list[str], order: list[str], hit: Column, best_per_key: bool = True, limit: int | None = None, day: str = "day", large: int = LARGE) -> DataFrame:
    """Longest unbroken runs of hits: keys, length, first and last day, and whether the run reaches its key's last row.

    A row whose hit is unknown breaks a run; of equally long runs of a key the
    first stands. A key of more than ``large`` rows is dealt into ranges of its
    order: each finds its own runs, and only those at the ends of ranges are
    joined, in order. The first column of ``order`` is a number, day or time.
    """
    rows, split = ranged(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), keys, order[0], large)
    own = [*keys, "_range"]
    w = Window.partitionBy(*own).orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    rows = rows.withColumn("_isle", F.col("_rn") - F.row_number().over(Window.partitionBy(*own, "_hit").orderBy(*order)))
    runs = rows.where("_hit").groupBy(*own, "_isle").agg(F.count("*").alias("length"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.min("_rn").alias("_at"), F.bool_or("_last").alias("open"))
    if split:
        runs = _joined_runs(runs, rows.groupBy(*own).agg(F.lit(1).alias("_some")), keys)
    runs = runs.select(*keys, "length", "first_day", "last_day", "open")
    if best_per_key:
        best = F.min(F.struct((-F.col("length")).alias("l"), "first_day", "last_day", "open")).alias("_b")
        runs = runs.groupBy(*keys).agg(best).select(*keys, (-F.col("_b.l")).alias("length"), "_b.first_day", "_b.last_day", "_b.open")
    return runs if limit is None else runs.orderBy(F.desc("length"), F.asc("first_day"), *keys).limit(limit)


def _joined_runs(runs: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of ranges as runs of keys: a run that ends with its range goes on in the next one that begins with a run."""
    of_key = Window.partitionBy(*keys).orderBy("_range")  # a row a range
    own = [*keys, "_range"]
    ranges = ranges.select(*[F.col(c).alias(f"_of_{c}") for c in own], F.row_number().over(of_key).alias("_no"), F.lead(F.lit(1)).over(of_key).isNull().alias("_final"))
    runs = runs.join(ranges, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in own]))
    inner = runs.where("_at > 1 and not open").withColumn("open", F.lit(False))
    ends = runs.where("_at = 1 or open")
    w = Window.partitionBy(*keys).orderBy("_no", "_at")  # two rows a range at most
    goes_on = (F.col("_at") == 1) & F.lag("open").over(w) & (F.lag("_no").over(w) == F.col("_no") - 1)
    ends = ends.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    ends = ends.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = ends.groupBy(*keys, "_run").agg(F.sum("length").alias("length"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.bool_or(F.col("open") & F.col("_final")).alias("open"))
    cols = [*keys, "length", "first_day", "last_day", "open"]
    return inner.select(*cols).unionByName(whole.select(*cols))


def runs_with_unknown(df: DataFrame, unknown: DataFrame, keys: list[str], order: list[str], hit: str, **more) -> DataFrame:
    """Runs where events whose figures are unknown stand in the sequence and break it."""
    both = df.select(*keys, *order, "day", F.col(hit).alias("hit")).unionByName(unknown.select(*keys, *order, "day", F.lit(None).cast("boolean").alias("hit")))
    return longest_runs(both, keys, order, F.col("hit"), **more)


def stints(df: DataFrame, entity: str, group: str, order: list[str], day: str = "day", season: str | None = None, season_gap: int = 1) -> DataFrame:
    """An entity's stretches with one group: a new one at a change of group or a gap of seasons.

    ``last_day`` is the group's last day in the season of the stint's last row
    (of all where there are no seasons), or the eve of the next stint, if that
    comes first; ``seen_day`` is the day of its own last row.
    """
    w = Window.partitionBy(entity).orderBy(*order)
    before = F.lag(group).over(w)
    new = F.lag(F.lit(1)).over(w).isNull() | ~before.eqNullSafe(F.col(group))
    if season:
        new = new | (F.col(season) - F.lag(season).over(w) > season_gap)
    rows = df.withColumn("_new", new.cast("int")).withColumn("stint", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = [F.max(season).alias("_season")] if season else []
    out = rows.groupBy(entity, "stint", group).agg(F.min(day).alias("first_day"), F.max(day).alias("seen_day"), F.count("*").alias("games"), *of)
    ends = df.groupBy(group, *([F.col(season).alias("_season")] if season else [])).agg(F.max(day).alias("_end"))
    nxt = F.date_sub(F.lead("first_day").over(Window.partitionBy(entity).orderBy("stint")), 1)
    closed = out.withColumn("_next", nxt).join(ends, [group, *(["_season"] if season else [])])
    return closed.withColumn("last_day", F.least("_next", "_end")).select(entity, "stint", group, "first_day", "seen_day", "games", "last_day")


def overlaps(a: DataFrame, b: DataFrame, on: list[str], first: str = "first_day", last: str = "last_day") -> DataFrame:
    """Where two sets of spans of one key meet."""
    x = a.select(*on, F.col(first).alias("_f1"), F.col(last).alias("_l1"))
    y = b.select(*on, F.col(first).alias("_f2"), F.col(last).alias("_l2"))
    both = x.join(y, on).where("_f1 <= _l2 and _f2 <= _l1")
    return both.select(*on, F.greatest("_f1", "_f2").alias(first), F.least("_l1", "_l2").alias(last))


def spans(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def _value_counts(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Each value's count, and how many rows lie below it (within the key), by ranges of values in parallel: no pool goes to one task."""
    return _running(df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_ties")), value, key)


def _running(counts: DataFrame, value: str, key: list[str]) -> DataFrame:
    """What ``_value_counts`` gives, from values that are counted already."""
    below = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = KEY_RANGES if key else RANGES
    cuts = counts.groupBy(*key).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 1000).alias("_cuts"))
    same = lambda other: [F.col(f"c.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in key]
    # one row a key; without a key one row, which is broadcast
    near = counts.alias("c").join(cuts.alias("q") if key else F.broadcast(cuts.alias("q")), reduce(and_, same("q")) if key else None)
    ranged = near.select(*[F.col(f"c.{k}") for k in key], value, "_ties", F.size(F.filter("_cuts", lambda c: c <= F.col(value))).alias("_range"))
    sizes = ranged.groupBy(*key, "_range").agg(F.sum("_ties").alias("_n"))  # at most n rows a key
    before = sizes.select(*key, "_range", below(Window.partitionBy(*key).orderBy("_range"), "_n").alias("_before"), F.sum("_n").over(Window.partitionBy(*key)).alias("_all"))
    within = ranged.withColumn("_under", below(Window.partitionBy(*key, "_range").orderBy(value), "_ties"))
    both = within.alias("c").join(before.alias("b") if key else F.broadcast(before.alias("b")), reduce(and_, same("b"), F.col("c._range") == F.col("b._range")))
    return both.select(*[F.col(f"c.{k}") for k in key], value, "_ties", (F.col("_under") + F.col("_before")).alias("_below"), "_all")


def competition_rank(df: DataFrame, value: str, descending: bool = True, key: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank; ties share one and rows without the value have none."""
    c = _value_counts(df, value, key or [])
    rank = F.col("_all") - F.col("_below") - F.col("_ties") + 1 if descending else F.col("_below") + 1
    return df.join(c.select(*(key or []), value, rank.cast("long").alias(name)), [*(key or []), value], "left").select(*df.columns, name)


def percentile(df: DataFrame, value: str, key: list[str] | None = None, midrank: bool = False, name: str = "pct") -> DataFrame:
    """The share of the pool that is at most a row's value; with ``midrank`` half of the ties count."""
    return percentiles(df, value, {name: midrank}, key)


def percentiles(df: DataFrame, value: str, names: dict[str, bool], key: list[str] | None = None) -> DataFrame:
    """Several percentiles of one value, by name whether half of the ties count, from one count of the pool."""
    key = key or []
    share = lambda half: ((F.col("_below") + (F.col("_ties") / 2 if half else F.col("_ties"))) / F.col("_all")).cast("double")
    c = _value_counts(df, value, key).select(*key, value, *[share(half).alias(n) for n, half in names.items()])
    return df.join(c, [*key, value], "left").select(*df.columns, *names)


def percentile_in(df: DataFrame, pool: DataFrame, value: str, key: list[str] | None = None, midrank: bool = False, name: str = "pct") -> DataFrame:
    """The share of a pool that is at most a row's value, for rows that need not be of the pool; null where the pool is empty.

    Values of both stand in one sequence, those of rows counting nothing, so a
    row's rank among the pool is its value's running count.
    """
    key = key or []
    one = lambda d, w: d.where(F.col(value).isNotNull()).select(*key, value, F.lit(w).alias("_w"))
    counts = one(pool, 1).unionByName(one(df, 0)).groupBy(*key, value).agg(F.sum("_w").alias("_ties"))
    c = _running(counts, value, key)
    ties = F.col("_ties") / 2 if midrank else F.col("_ties")
    share = ((F.col("_below") + ties) / F.nullif(F.col("_all"), F.lit(0))).cast("double")
    return df.join(c.select(*key, value, share.alias(name)), [*key, value], "left").select(*df.columns, name)


def cut_bounds(df: DataFrame, figure: str, k: int, room: int = 10, descending: bool = True) -> DataFrame:
    """The figures that a cut at k keeps, with rank and ties: k rows at most.

    Whole tie groups stay if they fit in k + room; a last group that does not fit goes whole; the first one always stays.
    """
    way = F.col(figure).desc() if descending else F.col(figure).asc()
    counts = df.where(F.col(figure).isNotNull()).groupBy(figure).agg(F.count("*").alias("ties")).orderBy(way).limit(k)
    rank = F.coalesce(F.sum("ties").over(Window.orderBy(way).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return counts.withColumn("rank", rank.cast("long")).where((F.col("rank") <= k) & ((F.col("rank") == 1) | (F.col("rank") + F.col("ties") - 1 <= k + room)))


def top_with_ties(df: DataFrame, figure: str, k: int, room: int = 10, descending: bool = True, order: list[str] | None = None) -> DataFrame:
    """The first k rows by a figure, with their rank; see ``cut_bounds`` for ties."""
    keep = F.broadcast(cut_bounds(df, figure, k, room, descending).select(figure, "rank"))
    return df.join(keep, figure).orderBy("rank", *(order or [])).limit(k + room).select(*df.columns, "rank")


def tied_past_cut(df: DataFrame, figure: str, k: int, descending: bool = True) -> DataFrame:
    """One row: the k-th figure, and how many rows with it stand past the cut."""
    way = F.col(figure).desc() if descending else F.col(figure).asc()
    counts = df.where(F.col(figure).isNotNull()).groupBy(figure).agg(F.count("*").alias("ties")).orderBy(way).limit(k)
    upto = F.sum("ties").over(Window.orderBy(way).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("_upto", upto).where(F.col("_upto") >= k).orderBy("_upto").limit(1)
    return rows.select(figure, (F.col("_upto") - k).alias("tied_past"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def with_pool(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows, each with the number of all of them."""
    n = F.broadcast(df.agg(F.count("*").alias("pool")))
    return df.orderBy(*order).limit(limit).join(n)


def latest_snapshot(df: DataFrame, key: list[str], kind: str, stamp: str, kinds: list[str]) -> DataFrame:
    """The newest row of each key, of the first kind in the list that has any."""
    place = F.array_position(F.lit(kinds), F.col(kind))
    return keep_one(df.where(F.col(kind).isin(*kinds)), key, [place.asc(), F.col(stamp).desc_nulls_last()])
