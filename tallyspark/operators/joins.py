"""Joins that the report shapes are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: list[str], col: str) -> DataFrame:
    """Keys whose tallies differ, one that is missing counting 0."""
    a, b = left.select(*key, F.col(col).alias("left_n")), right.select(*key, F.col(col).alias("right_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, key, "full").select(*key, zero("left_n"), zero("right_n")).where("left_n <> right_n")


def missing_detail(events: DataFrame, detail: DataFrame, on: list[str]) -> DataFrame:
    return events.join(detail.select(*on), on, "left_anti")


def within_spans(events: DataFrame, spans: DataFrame, keys: list[str], day: str = "day", kind: str = "inner", first: str = "first_day", last: str = "last_day", bins: int = 256) -> DataFrame:
    """Events on days inside a span of the same key.

    The days that events have are cut into ``bins`` stretches; a span stands in
    each that it touches, an event in its own, and they meet by key and
    stretch, so a key with very many spans and events is many tasks. An event
    has one stretch, so each pair meets once. ``kind``: inner (each pair, with
    the columns of the span), left, left_semi or left_anti.
    """
    num = lambda c: F.unix_date(F.to_date(c))
    about = F.broadcast(events.agg(F.min(num(day)).alias("_lo"), F.max(num(day)).alias("_hi")))
    width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / bins), F.lit(1))
    stretch = lambda c: F.floor((c - F.col("_lo")) / width)
    s = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in dict.fromkeys([*spans.columns, first, last]) if c not in keys and (c in (first, last) or c not in events.columns)])
    lo, hi = F.greatest(num(first), F.col("_lo")), F.least(num(last), F.col("_hi"))
    s = s.join(about).where(lo <= hi).withColumn("_bin", F.explode(F.sequence(stretch(lo), stretch(hi)))).drop("_lo", "_hi")
    e = events.join(about).withColumn("_own", stretch(num(day))).drop("_lo", "_hi")
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_own") == F.col("_bin"), F.col(day).between(F.col(first), F.col(last))]
    return e.join(s, on, kind).drop("_own", "_bin", *[f"_{k}" for k in keys])


def paired(df: DataFrame, event: list[str], entity: str, side: str | None = None, same: bool = False, ordered: bool = True) -> DataFrame:
    """Two entities of one event: columns of the second get the suffix _2. ``side``: on the same or the opposite one."""
    other = df.select(*event, *[F.col(c).alias(f"{c}_2") for c in df.columns if c not in event])
    out = df.join(other, event).where((F.col(f"{entity}_2") > F.col(entity)) if ordered else (F.col(f"{entity}_2") != F.col(entity)))
    if side:
        out = out.where((F.col(side) == F.col(f"{side}_2")) if same else (F.col(side) != F.col(f"{side}_2")))
    return out


def latest_group(df: DataFrame, entity: str, group: str, order: list[str]) -> DataFrame:
    """Each entity's group at its last event, and whether it has had several."""
    return df.groupBy(entity).agg(F.max_by(group, F.struct(*order)).alias(group), (F.count_distinct(group) > 1).alias("moved"))


def first_match(df: DataFrame, steps: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """The value from the first dimension that has the row's key; dimensions hold a key once."""
    names = []
    for i, (dim, on) in enumerate(steps):
        names.append(f"_v{i}")
        df = df.join(dim.select(*on, F.col(value).alias(f"_v{i}")), on, "left")
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def unique_index(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Key to value where the key has one value only; an ambiguous key resolves to nothing."""
    return df.groupBy(*key).agg(F.min(value).alias(value), F.max(value).alias("_hi")).where(F.col(value) == F.col("_hi")).drop("_hi")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], kind: str = "left_semi") -> DataFrame:
    cond = [left[c].eqNullSafe(right[c]) for c in on]
    return left.join(right, cond, kind)


def both_sides(df: DataFrame, shared: list[str], home: dict[str, Column], away: dict[str, Column]) -> DataFrame:
    """Two rows for each event, one from each side's view."""
    sides = F.array(*[F.struct(*[c.alias(n) for n, c in s.items()]) for s in (home, away)])
    return df.select(*shared, F.explode(sides).alias("_s")).select(*shared, "_s.*")


def agreed(df: DataFrame, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & (a == b), a)


def exclude_last(df: DataFrame, group: list[str], order: list[str], flag: Column) -> DataFrame:
    """Each group's last flagged row goes."""
    last = df.where(flag).groupBy(*group).agg(F.max(F.struct(*order)).alias("_last")).select(*group, "_last.*")
    return df.join(last, [*group, *order], "left_anti")
