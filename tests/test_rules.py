"""Shots, combined rows, empty parents, coverage, identities, presence and pools on rows chosen to break a naive rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import court
from tallyspark.operators import audit, match, repair, windows
from tallyspark.plans import shapes
from tallyspark.plans.shapes import Companion


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_beyond_the_arc(spark):
    at = [(25.0, 23.5, True), (25.0, 23.0, False), (3.0, 5.0, True), (3.0, 8.96, True), (4.0, 5.0, False), (47.0, 8.95, True), (25.0, 0.0, False)]
    got = spark.createDataFrame(at, "x double, y double, far boolean").select("far", court.beyond_arc(F.col("x"), F.col("y")).alias("got"))
    assert all(r.far == r.got for r in got.collect())


@pytest.mark.parametrize(
    ("kind", "label", "text", "season", "x", "y", "want"),
    [
        ("Free Throw", 3, "three point", 2024, 25.0, 30.0, 1), ("Jump Shot", 3, "two point", 2024, 25.0, 1.0, 3), ("Jump Shot", 0, "a Three Point try", 2002, None, None, 3), (None, None, "two point", 2002, None, None, 2),
        ("Jump Shot", 0, "jumper", 2002, 25.0, 30.0, None), ("Jump Shot", 0, None, 2012, 25.0, 30.0, 2), ("Jump Shot", 0, None, 2013, 25.0, 30.0, 3), ("Jump Shot", 0, None, 2013, 25.0, 3.0, 2), ("Jump Shot", 0, None, 2013, 0.0, 0.0, None), ("Jump Shot", 0, None, 2013, None, 3.0, None),
    ],
)
def test_shot_value(spark, kind, label, text, season, x, y, want):
    d = spark.createDataFrame([(kind, label, text, season, x, y)], "kind string, label int, words string, season int, x double, y double")
    assert d.select(court.shot_value(*[F.col(c) for c in d.columns])).first()[0] == want


def test_combined_rows_are_rebuilt_whole(spark):
    s = "k int, part string, games int, made int, tried int, pct double, minutes int"
    data = [
        (1, "a", 2, 1, 3, 33.3, 5), (1, "b", 2, None, 5, None, 5), (1, None, 5, 2, 8, 25.0, 10),  # wrong: games
        (2, "a", 1, 0, 0, None, 1), (2, None, None, None, None, 9.0, 1),  # wrong: nothing there; no attempts
        (3, None, 7, 7, 7, 7.0, 7),  # no parts
        (4, "a", 1, 1, 2, 50.0, 3), (4, None, 1, 1, 9, 11.1, 3),  # right in what decides
    ]
    out = repair.rebuild_totals(spark.createDataFrame(data, s), ["k"], "part", ["games", "made", "tried"], ["games", "made"], {"pct": (lambda x: 100.0 * x("made"), "tried", 1)}, ["minutes"])
    got = {r.k: (r.games, r.made, r.tried, r.pct, r.minutes, r.repaired) for r in out.where("part is null").collect()}
    assert got == {1: (4, 1, 8, 12.5, None, True), 2: (1, 0, 0, None, None, True), 3: (7, 7, 7, 7.0, 7, False), 4: (1, 1, 9, 11.1, 3, False)}
    assert out.where("part is not null and repaired").count() == 0


def test_only_wholly_empty_parents_are_rebuilt(spark):
    stored = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, None), (2, 2, 0)], "event int, who int, minutes int")
    plays = spark.createDataFrame([(1, 1, 2), (1, None, 3), (2, 1, 2), (3, 1, 9)], "event int, who int, points int")
    assert rows(repair.rebuild_empty(stored, plays, ["event"], "minutes", [("who", {"points": F.col("points")})]).select("event", "entity", F.col("points").cast("int"))) == [(1, 1, 2)]


def test_coverage_against_expected_and_markers(spark):
    n = lambda *r: spark.createDataFrame([*r], "season int, n long")
    games = spark.createDataFrame([(1,), (1,), (2,), (4,)], "season int")
    out = audit.coverage_report({"games": games, "lines": games.where("season = 1")}, ["season"], "games", n((1, 5), (2, 9), (3, 4), (4, 1)), n((1, 1)), spark.createDataFrame([(2,)], "season int"))
    assert rows(out) == [(1, 2, 2, 1, 5, 2, False), (2, 1, 0, 0, None, None, True), (3, 0, 0, 0, 4, 4, False), (4, 1, 0, 0, 1, 0, False)]


def test_identity_pairs_and_companions(spark):
    fact = spark.createDataFrame([(1, 7), (2, 7), (1, 8), (2, 8), (2, 8), (3, 9), (4, 7)], "id int, event int")
    dim = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, None)], "id int, name string")
    assert rows(audit.identity_pairs(fact, dim, "id", "name", ["event"])) == [("A", 1, 2, 2)]
    cands = spark.createDataFrame([("curry", 1, 9), ("curry", 2, 9), ("lee", 3, 9)], "mention string, id int, subject int")
    facts = spark.createDataFrame([(9, 2000, "x"), (1, 2000, "x"), (2, 2001, "x"), (2, 2000, "y"), (None, 2000, "x")], "id int, season int, group string")
    assert rows(match.companions(cands, facts)) == [("curry", 1, 9)]


def test_presence_by_role_and_unknown(spark):
    day = lambda i: dt.date(2000, 1, i)
    events = spark.createDataFrame([("g", day(i), i % 2 == 0, float(i)) for i in range(1, 9)] + [("h", day(2), True, 1.0)], "group string, day date, won boolean, margin double")
    box = spark.createDataFrame([
        ("g", day(1), 1, True, 10, True), ("g", day(1), 2, True, 30, True),  # all
        ("g", day(2), 1, True, 10, True), ("g", day(2), 2, True, 19, True),  # some: 2 short of the line
        ("g", day(3), 1, False, 10, True), ("g", day(3), 2, None, None, True),  # none: 1 off the bench
        ("g", day(4), 9, True, 1, True), ("g", day(5), 1, True, 1, False),  # none; not played is no detail
        ("g", day(7), 2, True, 40, True), ("g", day(7), 1, True, 40, True), ("g", day(8), 1, True, 1, True),  # 8 is past a span
    ], "group string, day date, entity int, starter boolean, pts int, played boolean")
    spans = [spark.createDataFrame([("g", day(1), day(b))], "group string, first_day date, last_day date") for b in (9, 7)]
    mates = [Companion(1, "started"), Companion(2, "reached", "pts", 20)]
    out = shapes.presence(events, box, ["group", "day"], mates, spans, subject=2, figures=["pts"], played=F.col("played"))
    assert rows(out) == [("all", 2, 0, 2, 4.0, 2, 35.0), ("none", 2, 1, 1, 3.5, 1, 0.0), ("some", 1, 1, 0, 2.0, 1, 19.0), ("unknown", 2, 1, 1, 5.5, 0, None)]
    beside = shapes.presence(events, box, ["group", "day"], mates[:1], spans, beside=[Companion(2)], played=F.col("played"))
    assert {(r.presence, r.games) for r in beside.collect()} == {("all", 3), ("none", 1), ("unknown", 2)}
    with pytest.raises(ValueError):
        shapes.presence(events, box, ["day"], [Companion(i) for i in range(63)], spans)


def test_outsiders_are_ranked_in_a_pool(spark):
    pool = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 4.0)], "k string, v double")
    d = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate([("a", 0.0), ("a", 2.0), ("a", 3.0), ("a", 9.0), ("b", 1.0), ("a", None)])], "i int, k string, v double")
    assert [r.pct for r in windows.percentile_in(d, pool, "v", ["k"]).orderBy("i").collect()] == [0.0, 0.75, 0.75, 1.0, None, None]
    assert [r.pct for r in windows.percentile_in(d, pool, "v", ["k"], midrank=True).orderBy("i").collect()] == [0.0, 0.5, 0.75, 1.0, None, None]
    assert [r.pct for r in windows.percentile_in(d.drop("k"), pool.limit(0), "v").orderBy("i").collect()] == [None] * 6


def test_fingerprints_of_seasons_and_events(spark):
    long = spark.createDataFrame([(1, "x", 5, 10), (1, "x", 5, 10), (2, "x", 1, 40), (3, "x", 9, 1), (3, "y", 0, 1)], "e int, c string, v int, w int")
    got = {(r.e, r.c): (r.value, r.in_pool, r.pct, r.pool_mean, r.pool_size) for r in shapes.fingerprints(long, "e", "c", "v", "w", 20).collect()}
    assert got == {(1, "x"): (50.0, True, 1.0, 26.25, 2), (2, "x"): (2.5, True, 0.5, 26.25, 2), (3, "x"): (900.0, False, 1.0, 26.25, 2), (3, "y"): (0.0, False, None, None, None)}
    prints = shapes.fingerprints(long, "e", "c", "v", "w", 20)
    assert rows(shapes.comparison_gaps(prints, [1, 2], "e", "c")) == [("x", 47.5, 1, 1.0)] and rows(shapes.comparison_gaps(prints, [1], "e", "c")) == [("x", 0.0, None, 0.0)]
    events = spark.createDataFrame([(1, 10, 1, "x", 0.0, 30), (1, 11, 2, "x", 0.0, 5), (2, 10, 1, "x", 2.0, 30), (2, 12, 3, "x", 0.0, 30)], "e int, ev int, ts int, c string, v double, w int")
    assert {(r.e, r.ev, r.pct, r.in_pool) for r in shapes.event_fingerprints(events, "e", "ev", "c", "v", "w", 20, ["ts"]).collect()} == {(1, 11, 1 / 3, False), (2, 12, 1 / 3, True)}
    assert {(r.e, r.ev) for r in shapes.event_fingerprints(events, "e", "ev", "c", "v", "w", 20, ["ts"], first=True).collect()} == {(1, 10), (2, 10)}
