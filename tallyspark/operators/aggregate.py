"""Aggregates over relations: ratios of sums, records, samples, weights, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio

HOW = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median}


def total(c: str | Column) -> Column:
    """A sum that does not depend on the order of rows: decimals are summed and the sum is a double."""
    return F.sum(c).cast("double")


def mean(c: str | Column) -> Column:
    """The sum over the count, of rows that have the figure."""
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def aggregate(df: DataFrame, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: name → (how, column)."""
    return df.agg(*[measure(h, c).alias(n) for n, (h, c) in measures.items()])


def measure(how: str, c: str) -> Column:
    return {"sum": total, "avg": mean}.get(how, HOW.get(how))(F.col(c) if c != "*" else F.lit(1))


def rate(num: str, den: str, times: float = 100.0) -> Column:
    return ratio(F.sum(num), F.sum(den), times)


def record(won: str = "won") -> list[Column]:
    """Wins and losses; a row without an outcome is neither."""
    return [F.count_if(F.col(won)).alias("wins"), F.count_if(~F.col(won)).alias("losses")]


def line(measures: list[str], season: str = "season") -> list[Column]:
    return [F.count("*").alias("games"), *[f(m).alias(f"{n}_{m}") for m in measures for n, f in (("avg", mean), ("total", total))], F.min(season).alias("first_season"), F.max(season).alias("last_season")]


def grouped(df: DataFrame, by: dict[str, Column], measures: list[Column], min_rows: int = 0, readable: str | None = None, adaptive: bool = False) -> DataFrame:
    """Groups with their measures and ``sample``, the rows that the measure can read.

    With ``adaptive``, a minimum that no group reaches becomes half of the most that any has.
    """
    sample = F.count(F.col(readable)) if readable else F.count("*")
    out = df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(*measures, sample.alias("sample"))
    if not min_rows:
        return out
    if not adaptive:
        return out.where(F.col("sample") >= min_rows)
    most = F.broadcast(out.agg(F.max("sample").alias("_most")))
    need = F.when(F.col("_most") >= min_rows, F.lit(min_rows)).otherwise(F.ceil(F.col("_most") / 2))
    return out.join(most, F.col("sample") >= need).drop("_most")


def by_line(df: DataFrame, cond: Column, measures: list[Column]) -> DataFrame:
    """Three groups: the line is reached, is short, or is blank because the figure is unknown."""
    which = F.when(cond, "reached").when(~cond, "short").otherwise("blank")
    return df.groupBy(which.alias("line")).agg(F.count("*").alias("games"), *measures)


def scaled_minimum(df: DataFrame, season: str, group: str, base: int, full: int = 82) -> DataFrame:
    """For each season, the base times the median number of rows a group has, over a full schedule's, halves up."""
    per = df.groupBy(season, group).agg(F.count("*").alias("n"))
    return per.groupBy(season).agg(F.floor(F.lit(base) * F.median("n") / full + 0.5).cast("long").alias("minimum"))


def weighted(value: str | Column, weight: str | Column) -> Column:
    """Weighted mean; weights count only where the value is there."""
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return ratio(F.sum((v * w).cast("decimal(28,4)")), F.sum(F.when(v.isNotNull(), w)))


def career(df: DataFrame, by: list[str], stored: str, avg: str, games: str) -> DataFrame:
    """Totals from seasons: the stored total, or else the average times the games; the mean only over seasons that have one."""
    t = F.coalesce(F.col(stored).cast("double"), F.col(avg).cast("double") * F.col(games)).cast("decimal(28,4)")
    return df.groupBy(*by).agg(total(t).alias("total"), ratio(F.sum(t), F.sum(F.when(t.isNotNull(), F.col(games)))).alias("average"), F.sum(games).alias("games"))


def groups_counted(df: DataFrame, inner: list[str], outer: list[str], having: Column, name: str = "seasons") -> DataFrame:
    """How many inner groups that pass each outer group has."""
    return df.groupBy(*inner).agg(having.alias("_ok")).where("_ok").groupBy(*outer).agg(F.count("*").alias(name))


def pivot_long(df: DataFrame, key: list[str], category: str, value: str, categories: list[str], agg=F.max) -> DataFrame:
    """Long rows to one wide row for each key, the categories being known."""
    return df.groupBy(*key).agg(*[agg(F.when(F.col(category) == c, F.col(value))).alias(c) for c in categories])


def unpivot(df: DataFrame, key: list[str], columns: list[str], name: str = "category", value: str = "value") -> DataFrame:
    return df.unpivot(key, columns, name, value)


def ordered_list(df: DataFrame, by: list[str], columns: list[str], name: str = "items") -> DataFrame:
    """Each group's rows as a list of structs in the order of the columns."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def by_period(parts: DataFrame, key: list[str], period: str, periods: list[int], value: Column) -> DataFrame:
    """The same sum for several periods side by side, from one pass."""
    return parts.where(F.col(period).isin(*periods)).groupBy(*key).agg(*[F.sum(F.when(F.col(period) == p, value)).cast("double").alias(f"p{p}") for p in periods])


def agreement(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], by: list[str]) -> DataFrame:
    """The share of keys, in percent, on which two frames' figures are equal, for each column and group."""
    right = b.select(*key, *[F.col(c).alias(f"{c}_b") for c in columns])
    both = a.join(right, key)
    return both.groupBy(*by).agg(*[(F.count_if(F.col(c).eqNullSafe(F.col(f"{c}_b"))) * 100.0 / F.count("*")).alias(c) for c in columns])


def blank_count(df: DataFrame, detail: DataFrame, on: list[str], figure: Column) -> DataFrame:
    """How many rows have no detail row, or one whose figure is missing."""
    d = detail.select(*on, F.lit(1).alias("_there"), figure.alias("_figure"))
    both = df.join(d, on, "left")
    return both.agg(F.count("*").alias("games"), F.count_if(F.col("_there").isNull()).alias("no_detail"), F.count_if(F.col("_there").isNotNull() & F.col("_figure").isNull()).alias("blank"))
