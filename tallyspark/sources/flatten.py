"""Nested documents to flat rows, with declared schemas and built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import number, two_parts
from ..operators.windows import keep_one

TEAM = "struct<id:string,abbreviation:string,displayName:string,location:string,name:string>"
HEADER = f"""header: struct<id:string, season:struct<year:bigint,type:bigint>, competitions:array<struct<date:string, neutralSite:boolean,
  competitors:array<struct<id:string,homeAway:string,winner:boolean,score:string,team:{TEAM},linescores:array<struct<displayValue:string>>>>>>>"""
TEAMS = f"boxscore: struct<teams:array<struct<team:{TEAM},homeAway:string,statistics:array<struct<name:string,displayValue:string,label:string>>>>>"
PLAYERS = f"""boxscore: struct<players:array<struct<team:{TEAM},statistics:array<struct<keys:array<string>,
  athletes:array<struct<athlete:struct<id:string,displayName:string,shortName:string>,starter:boolean,didNotPlay:boolean,stats:array<string>>>>>>>>"""
PLAYS = """plays: array<struct<id:string,type:struct<text:string>,text:string,period:struct<number:bigint>,clock:struct<displayValue:string>,homeScore:bigint,awayScore:bigint,
  scoringPlay:boolean,shootingPlay:boolean,scoreValue:bigint,team:struct<id:string>,participants:array<struct<athlete:struct<id:string>>>,coordinate:struct<x:double,y:double>>>"""
WIN = "winprobability: array<struct<homeWinPercentage:double,tiePercentage:double,playId:string>>"


def zip_stats(keys: Column, values: Column, names: dict[str, str]) -> dict[str, Column]:
    """Columns from a list of keys beside a list of values; a ``made-attempted`` key fills both of its names."""
    m = F.map_from_arrays(keys, values)
    out: dict[str, Column] = {}
    for key, kind in names.items():
        v = F.try_element_at(m, F.lit(key))
        if "-" in key:
            out[key.split("-")[0]], out[key.split("-")[1]] = two_parts(v)
        else:
            out[key] = number(v).cast(kind)
    return out


def flatten_summary(docs: DataFrame, json: str = "json", stats: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """One document a game to: games, player_box, team_box, plays, shots, win_probability, players, glossary.

    Each frame parses the parts of the documents that it shows, and carries a row's own values only.
    """
    ids = ["event_id", "season", "season_type"]
    of_event = (F.col("d.header.id").alias("event_id"), F.col("d.header.season.year").alias("season"), F.col("d.header.season.type").alias("season_type"))
    parsed = lambda *parts: docs.select(F.from_json(json, f"struct<{', '.join(parts)}>").alias("d"))
    side = lambda w: F.try_element_at(F.filter("c.competitors", lambda x: x["homeAway"] == w), F.lit(1))
    first = F.try_element_at("d.header.competitions", F.lit(1)).alias("c")

    lines = lambda s: F.array_join(F.transform(F.col(f"{s}.linescores"), lambda x: x["displayValue"]), ",")
    winner = F.when(F.col("home.winner"), F.col("home.team.id")).when(F.col("away.winner"), F.col("away.team.id"))
    base = parsed(HEADER).select(*of_event, first).withColumns({"home": side("home"), "away": side("away")})
    games = base.select(
        *ids, F.col("c.date").alias("date"), F.col("home.team.id").alias("home_team_id"), F.col("away.team.id").alias("away_team_id"),
        F.col("home.score").try_cast("long").alias("home_score"), F.col("away.score").try_cast("long").alias("away_score"), winner.alias("winner_team_id"),
        lines("home").alias("home_linescores"), lines("away").alias("away_linescores"), F.col("c.neutralSite").alias("neutral_site"),
    )

    sides = parsed(HEADER, PLAYERS).select("d.boxscore.players", *of_event, first).select("players", *ids, side("home")["team"]["id"].alias("home"), side("away")["team"]["id"].alias("away"))
    teams = sides.select(*ids, "home", "away", F.explode("players").alias("t"))
    group = teams.select(*ids, F.col("t.team.id").alias("team_id"), F.when(F.col("t.team.id") == F.col("home"), F.col("away")).otherwise(F.col("home")).alias("opponent_team_id"), F.explode("t.statistics").alias("s"))
    who = group.select(*ids, "team_id", "opponent_team_id", F.col("s.keys").alias("k"), F.explode("s.athletes").alias("a"))
    wanted = stats or {"minutes": "bigint", "points": "bigint", "rebounds": "bigint", "assists": "bigint", "fieldGoalsMade-fieldGoalsAttempted": "bigint"}
    values = F.when(F.size("a.stats") == F.size("k"), F.col("a.stats"))
    box = who.select(*ids, "team_id", "opponent_team_id", F.col("a.athlete.id").alias("athlete_id"), F.col("a.starter").alias("starter"), F.col("a.didNotPlay").alias("did_not_play"), *[c.alias(n) for n, c in zip_stats(F.col("k"), values, wanted).items()])

    team_rows = parsed(HEADER, TEAMS).select(*of_event, F.explode("d.boxscore.teams").alias("t"))
    team_box = team_rows.select(*ids, F.col("t.team.id").alias("team_id"), F.col("t.homeAway").alias("home_away"), F.map_from_entries(F.transform("t.statistics", lambda s: F.struct(s["name"], s["displayValue"]))).alias("stats"))

    play = parsed(HEADER, PLAYS).select(*of_event, F.explode("d.plays").alias("p"))
    people = F.transform("p.participants", lambda x: x["athlete"]["id"])
    plays = play.select(
        *ids, F.col("p.id").alias("play_id"), F.col("p.period.number").alias("period"), F.col("p.clock.displayValue").alias("clock"), F.col("p.team.id").alias("team_id"), F.try_element_at(people, F.lit(1)).alias("athlete_id"),
        F.array_join(people, ",").alias("participant_athlete_ids"), F.col("p.type.text").alias("type"), F.col("p.text").alias("text"), F.col("p.scoringPlay").alias("scoring_play"), F.col("p.homeScore").alias("home_score"), F.col("p.awayScore").alias("away_score"),
    )
    shots = play.where("p.shootingPlay").select(*ids, F.col("p.id").alias("play_id"), F.try_element_at(people, F.lit(1)).alias("athlete_id"), F.col("p.team.id").alias("team_id"), F.col("p.period.number").alias("period"), F.coalesce("p.scoringPlay", F.lit(False)).alias("made"), F.col("p.type.text").alias("shot_type"), F.col("p.scoreValue").alias("points_attempted"), F.col("p.coordinate.x").alias("coordinate_x"), F.col("p.coordinate.y").alias("coordinate_y"))
    win = parsed(HEADER, WIN).select(*of_event, F.explode("d.winprobability").alias("w")).select(*ids, F.col("w.playId").alias("play_id"), F.col("w.homeWinPercentage").alias("home_win_pct"), F.col("w.tiePercentage").alias("tie_pct"))

    # an athlete's latest document; of several lines there, the greatest names
    named = parsed(HEADER, PLAYERS).select(F.col("d.header.id").alias("event_id"), F.explode("d.boxscore.players").alias("t")).select("event_id", F.explode("t.statistics").alias("s")).select("event_id", F.explode("s.athletes.athlete").alias("a"))
    latest = named.groupBy(F.col("a.id").alias("athlete_id")).agg(F.max(F.struct("event_id", F.col("a.displayName").alias("n"), F.col("a.shortName").alias("s"))).alias("m"))
    players = latest.select("athlete_id", F.col("m.n").alias("display_name"), F.col("m.s").alias("short_name"))
    glossary = parsed(TEAMS).select(F.explode("d.boxscore.teams").alias("t")).select(F.explode("t.statistics").alias("s")).select(F.col("s.name").alias("name"), F.col("s.label").alias("label")).distinct()
    return {"games": games, "player_box": box, "team_box": team_box, "plays": plays, "shots": shots, "win_probability": win, "players": players, "glossary": glossary}


def flatten_alignment(docs: DataFrame, schema: str, json: str = "json") -> DataFrame:
    """season, conference, division, team: two levels of children down to entries; a team's first place wins."""
    top = docs.select("season", F.from_json(json, schema).alias("d")).select("season", F.posexplode("d.children").alias("i", "a"))
    low = top.select("season", "i", F.col("a.name").alias("conference"), F.posexplode_outer("a.children").alias("j", "b"), F.col("a.entries").alias("own"))
    rows = low.select("season", "i", "j", "conference", F.col("b.name").alias("division"), F.posexplode(F.coalesce("b.entries", "own")).alias("k", "team"))
    return keep_one(rows, ["season", "team"], [F.asc("i"), F.asc("j"), F.asc("k")]).select("season", "team", "conference", "division")


def pivot_stats(df: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long category rows to one wide row; the first value that is there wins."""
    return df.groupBy(*key).pivot(name, names).agg(F.first(value, ignorenulls=True))


def id_from_url(c: Column, part: str) -> Column:
    """The number after a path part of an address, null where there is none."""
    return F.nullif(F.regexp_extract(c, rf"/{part}/(\d+)", 1), F.lit("")).try_cast("long")


def merge_rates(totals: DataFrame, rates: DataFrame, key: list[str], teams: DataFrame | None = None, label: str = "abbreviation") -> DataFrame:
    """Totals with their rates on a composite key; a short team name is mapped by its dimension."""
    out = totals.join(rates, key, "left")
    return out if teams is None else out.join(teams, label, "left")


def unpack_columns(df: DataFrame, key: list[str], text: str, columns: list[str]) -> DataFrame:
    """Column-oriented JSON, {column: {row: value}}, held in a string, to a row for each row label."""
    m = df.select(*key, F.from_json(text, "map<string,map<string,string>>").alias("m"))
    cells = m.select(*key, F.explode("m").alias("column", "cells")).select(*key, "column", F.explode("cells").alias("row", "value"))
    return cells.groupBy(*key, "row").pivot("column", columns).agg(F.first("value"))


def resolve_event(rows: DataFrame, events: DataFrame, group: str, day: str, event: str) -> DataFrame:
    """Rows of (group, civil date) to events: that day, else the next, else the same day in UTC; an ambiguous key resolves to nothing."""
    def index(d: str) -> DataFrame:
        return events.groupBy(group, F.col(d).alias("_d")).agg(F.count_distinct(event).alias("_n"), F.min(event).alias("_e")).where("_n = 1").drop("_n")

    local, utc = index(day), index("utc_day")
    tries = ((local, F.col(day)), (utc, F.date_add(day, 1)), (utc, F.col(day)))
    out = rows
    for i, (ix, at) in enumerate(tries):
        out = out.withColumn("_at", at).join(ix.select(F.col(group), F.col("_d").alias("_at"), F.col("_e").alias(f"_e{i}")), [group, "_at"], "left").drop("_at")
    return out.withColumn(event, F.coalesce("_e0", "_e1", "_e2")).drop("_e0", "_e1", "_e2")


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"))


def flatten_fingerprint(df: DataFrame, key: list[str], categories: list[str], sides: list[str]) -> DataFrame:
    """A struct of categories and sides to one column for each."""
    return df.select(*key, *[F.col(f"fingerprint.{c}.{s}").alias(f"{c}_{s}") for c in categories for s in sides])
