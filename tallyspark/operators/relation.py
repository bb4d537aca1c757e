"""A fact relation and the narrowings that compose over it.

A relation is a DataFrame and the names of the columns that play the roles:
entity, event, season, season_type, ts, day, group, opponent, won. Every
narrowing gives a new relation, adds to what stands and overwrites nothing.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_range, nth_weekday
from .joins import within_spans

OPS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "=": operator.eq}
ROLES = {r: r for r in ("entity", "event", "season", "season_type", "ts", "day", "group", "opponent", "won")}


def compare(c: Column, op: str, value) -> Column:
    if op not in OPS:
        raise ValueError(f"unknown comparison {op}")
    return OPS[op](c, value)


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    roles: dict = field(default_factory=dict)

    def name(self, role: str) -> str:
        return self.roles.get(role, ROLES[role])

    def col(self, role: str) -> Column:
        return F.col(self.name(role))

    def where(self, cond: Column | str) -> Rel:
        return replace(self, df=self.df.where(cond))

    def with_df(self, df: DataFrame) -> Rel:
        return replace(self, df=df)

    # rows
    def played(self, recorded: str, rebuilt: str | None = None, invert: bool = False) -> Rel:
        """Rows with the figure recorded; with ``rebuilt``, also rows that flag admits; inverted: what is missing."""
        ok = F.col(recorded).isNotNull()
        if rebuilt:
            ok = ok | F.coalesce(F.col(rebuilt), F.lit(False))
        return self.where(~ok if invert else ok)

    # seasons
    def season_type(self, *types: int) -> Rel:
        return self.where(self.col("season_type").isin(*types))

    def span(self, season: int | None = None, since: int | None = None, until: int | None = None, floor: int | None = None, phantom: tuple[int, ...] = ()) -> Rel:
        s, out = self.col("season"), self
        if season is not None:
            out = out.where(s == season)
        lows = [x for x in (since, floor) if x is not None]
        if lows:
            out = out.where(s >= max(lows))
        if until is not None:
            out = out.where(s <= until)
        return out.where(~s.isin(*phantom)) if phantom else out

    def civil_year_span(self, type_: int, first: int, last: int | None = None) -> Rel:
        """Rows of one type by the civil year of their day, all other types by their season."""
        top = last if last is not None else 9999
        t = self.col("season_type")
        return self.where(((t == type_) & F.year(self.col("day")).between(first, top)) | ((t != type_) & self.col("season").between(first, top)))

    def ordinal_season(self, n: int) -> Rel:
        """Each entity's n-th season on record."""
        e, s = self.name("entity"), self.name("season")
        order = F.row_number().over(Window.partitionBy(e).orderBy(s))
        nth = self.df.select(e, s).distinct().withColumn("_n", order).where(F.col("_n") == n).drop("_n")
        return self.with_df(self.df.join(nth, [e, s], "left_semi"))

    def latest_season(self, most: int | None = None, decided: Column | None = None) -> Rel:
        """Rows of the latest season that has decided events, no later than ``most``."""
        s = self.name("season")
        base = self.df if decided is None else self.df.where(decided)
        last = base.agg(F.max(s).alias("_last"))
        if most is not None:
            last = last.select(F.least("_last", F.lit(most)).alias("_last"))
        return self.with_df(self.df.join(F.broadcast(last), F.col(s) == F.col("_last")).drop("_last"))

    # values
    def opponent(self, value) -> Rel:
        return self.where(self.col("opponent") == value)

    def group(self, value) -> Rel:
        return self.where(self.col("group") == value)

    def venue(self, which: str, own: str, place: str, neutral: str | None = None) -> Rel:
        """Home rows are those whose own side is the place's; rows at a neutral place are neither."""
        home = F.col(own) == F.col(place)
        out = self.where(home if which == "home" else ~home)
        return out.where(~F.coalesce(F.col(neutral), F.lit(False))) if neutral else out

    def flag(self, col: str, value) -> Rel:
        return self.where(F.col(col) == value)

    def line(self, col: str | Column, op: str, value) -> Rel:
        return self.where(compare(F.col(col) if isinstance(col, str) else col, op, value))

    def where_in(self, col: str, values) -> Rel:
        if isinstance(values, DataFrame):
            return self.with_df(self.df.join(values.select(F.col(values.columns[0]).alias(col)), col, "left_semi"))
        return self.where(F.col(col).isin(*values))

    def entity_in(self, dim: DataFrame, key: str, col: str, values) -> Rel:
        """Rows of entities whose attribute is one of the values."""
        some = dim.where(F.col(col).isin(*values)).select(F.col(key).alias(self.name("entity")))
        return self.with_df(self.df.join(some, self.name("entity"), "left_semi"))

    def aligned(self, dim: DataFrame, on: dict[str, str], kind: str, value) -> Rel:
        """Rows whose columns (values of ``on``) meet a dimension row of that kind."""
        some = dim.where(F.col(kind) == value).select(*[F.col(d).alias(f) for f, d in on.items()])
        return self.with_df(self.df.join(some, list(on), "left_semi"))

    # other rows
    def pinned(self, events: DataFrame) -> Rel:
        keys = [c for c in events.columns if c in self.df.columns]
        return self.with_df(self.df.join(events.select(*keys).distinct(), keys, "left_semi"))

    def detail_line(self, detail: DataFrame, on: list[str], figure: Column, op: str, value) -> Rel:
        """Events with a detail row whose figure passes."""
        return self.with_df(self.df.join(detail.where(compare(figure, op, value)).select(*on).distinct(), on, "left_semi"))

    def period_line(self, parts: DataFrame, on: list[str], period: str, periods: list[int], figure: Column, op: str, value) -> Rel:
        """Events whose sum over the chosen periods passes; the events' own keys narrow the parts before they are summed."""
        own = self.df.select(*on).distinct()
        total = parts.where(F.col(period).isin(*periods)).join(own, on, "left_semi").groupBy(*on).agg(F.sum(figure).alias("_total"))
        return self.with_df(self.df.join(total.where(compare(F.col("_total"), op, value)).select(*on), on, "left_semi"))

    def companion(self, others: DataFrame, on: list[str], present: bool = True) -> Rel:
        """Rows whose event has a row of the companion (already narrowed to its role), or has none."""
        return self.with_df(self.df.join(others.select(*on).distinct(), on, "left_semi" if present else "left_anti"))

    def without(self, others: DataFrame, on: list[str], stints: DataFrame, group: str = "group", first: str = "first_day", last: str = "last_day") -> Rel:
        """Rows without the companion, but only on days inside one of its stints with the row's group."""
        absent = self.companion(others, on, present=False).df
        span = stints.select(F.col(group).alias(self.name("group")), F.col(first).alias("_first"), F.col(last).alias("_last"))
        return self.with_df(within_spans(absent, span, [self.name("group")], self.name("day"), "left_semi", "_first", "_last"))

    def series_game(self, numbered: DataFrame, on: list[str], n: int, col: str = "game_no") -> Rel:
        return self.with_df(self.df.join(numbered.where(F.col(col) == n).select(*on), on, "left_semi"))

    def in_round(self, rounds: DataFrame, on: list[str], n: int, conference: str | None = None) -> Rel:
        """Rows whose event is of round ``n``, and of a conference if one is named; ``rounds`` has the columns round and conference."""
        some = rounds.where(F.col("round") == n)
        some = some if conference is None else some.where(F.col("conference") == conference)
        return self.with_df(self.df.join(some.select(*on), on, "left_semi"))

    # dates
    def on_day(self, day: str, zone: str = "UTC") -> Rel:
        begin, end = day_range(day, zone)
        return self.where((self.col("ts") >= begin) & (self.col("ts") < end))

    def calendar(self, kind: str, value) -> Rel:
        d = self.col("day")
        conds = {
            "weekday": lambda: F.weekday(d) + 1 == value,
            "month": lambda: F.month(d) == value,
            "month_day": lambda: (F.month(d) == value[0]) & (F.dayofmonth(d) == value[1]),
            "nth_weekday": lambda: nth_weekday(d, *value),
            "since": lambda: d >= F.lit(value).cast("date"),
            "between": lambda: d.between(F.lit(value[0]).cast("date"), F.lit(value[1]).cast("date")),
            # from a month and day of the season's own first or second year on
            "season_since": lambda: d >= F.make_date((self.col("season") - F.when(F.lit(value[0]) >= 10, 1).otherwise(0)).cast("int"), F.lit(value[0]), F.lit(value[1])),
        }
        if kind not in conds:
            raise ValueError(f"unknown calendar situation {kind}")
        return self.where(conds[kind]())

    # windows come after every narrowing
    def window(self, which: str, n: int, order: list[str] | None = None, per_entity: bool = True) -> Rel:
        """The most recent or the first n rows of each entity, or of the whole relation."""
        keys = order or [self.name("ts"), self.name("event")]
        by = [F.col(k).desc_nulls_last() if which == "recent" else F.col(k).asc_nulls_last() for k in keys]
        if not per_entity:
            return self.with_df(self.df.orderBy(*by).limit(n))
        rank = F.row_number().over(Window.partitionBy(self.name("entity")).orderBy(*by))
        return self.with_df(self.df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn"))


def merge_window(rels: list[Rel], n: int, kind: str = "season_type") -> Rel:
    """Several relations of one entity merged by time, the last n of each entity kept."""
    df = rels[0].df
    for r in rels[1:]:
        df = df.unionByName(r.df)
    return rels[0].with_df(df).window("recent", n)


def derived(rel: Rel, flags: dict[str, Column]) -> Rel:
    return rel.with_df(rel.df.withColumns(flags))


def tens(columns: list[str], at_least=10) -> Column:
    """How many of the figures reach a mark; a missing figure does not."""
    return sum((F.coalesce((F.col(c) >= at_least).cast("int"), F.lit(0)) for c in columns), F.lit(0))


def blank(rel: Rel, columns: list[str], flag: str) -> Rel:
    """Figures that are unproven on flagged rows read as null."""
    return rel.with_df(rel.df.withColumns({c: F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(c)) for c in columns}))


def located(shots: DataFrame, x: str, y: str, value: str | None = None, points: int | None = None) -> DataFrame:
    """Rows with a place that is not the origin, which stands for none; of one value, if asked."""
    out = shots.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~((F.col(x) == 0) & (F.col(y) == 0)))
    return out if value is None else out.where(F.col(value) == points)


def floor_metric(df: DataFrame, season: str, first_seasons: dict[str, int]) -> DataFrame:
    """Metrics read as null before the first season in which they hold."""
    return df.withColumns({m: F.when(F.col(season) >= first, F.col(m)) for m, first in first_seasons.items()})
