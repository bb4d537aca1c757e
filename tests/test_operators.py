"""Rows chosen to break a naive rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalar
from tallyspark.operators import aggregate, audit, joins, match, relation, repair, windows
from tallyspark.operators.relation import Rel


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def games(spark):
    d = dt.date
    data = [(1, 10, 2000, d(2000, 1, 1), "a", True, 5), (2, 10, 2000, d(2000, 1, 2), "a", True, None), (3, 10, 2000, d(2000, 1, 3), "b", True, 7), (4, 11, 2000, d(2000, 1, 1), "a", False, 0), (5, 11, 2002, d(2002, 1, 1), "a", None, 9)]
    return Rel(spark.createDataFrame(data, "event int, entity int, season int, day date, group string, won boolean, pts int"))


def test_narrowings_commute(games):
    a = games.line("pts", ">=", 5).span(season=2000).df
    b = games.span(season=2000).line("pts", ">=", 5).df
    assert rows(a) == rows(b) and a.count() == 2


def test_unknown_comparison_is_refused(games):
    with pytest.raises(ValueError):
        games.line("pts", "!", 1)


def test_window_is_taken_after_narrowing(games):
    assert [r.event for r in games.line("pts", ">=", 0).window("recent", 1, ["day", "event"]).df.orderBy("event").collect()] == [3, 5]


def test_a_missing_outcome_is_neither_win_nor_loss(games):
    assert rows(games.df.agg(*aggregate.record())) == [(3, 1)]


def test_the_line_has_three_groups(games):
    got = dict(rows(aggregate.by_line(games.df, F.col("pts") >= 5, []).select("line", "games")))
    assert got == {"reached": 3, "short": 1, "blank": 1}


def test_a_rate_is_a_ratio_of_sums(spark):
    d = spark.createDataFrame([(1, 1), (1, 9), (0, 0)], "made int, tried int")
    assert d.agg(aggregate.rate("made", "tried").alias("r")).first()[0] == pytest.approx(20.0)
    assert d.where("tried = 0").agg(aggregate.rate("made", "tried").alias("r")).first()[0] is None


def test_an_unknown_row_breaks_a_run(spark):
    d = dt.date
    known = spark.createDataFrame([(1, i, d(2000, 1, i), True) for i in (1, 2, 4, 5, 6)], "entity int, ts int, day date, hit boolean")
    unknown = spark.createDataFrame([(1, 3, d(2000, 1, 3))], "entity int, ts int, day date")
    got = windows.runs_with_unknown(known, unknown, ["entity"], ["ts"], "hit").collect()
    assert [(r.length, r.first_day, r.open) for r in got] == [(3, d(2000, 1, 4), True)]


@pytest.mark.parametrize(("values", "k", "room", "want"), [([9, 8, 8, 7], 2, 0, [9]), ([9, 8, 8, 7], 2, 1, [9, 8, 8]), ([5] * 6, 2, 1, [5, 5, 5]), ([], 3, 2, []), ([None, 4], 3, 2, [4])])
def test_ties_at_the_cut(spark, values, k, room, want):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    assert [r.v for r in windows.top_with_ties(d, "v", k, room, order=["i"]).orderBy("rank", "i").collect()] == want


def test_ranks_and_percentiles(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "v double")
    assert rows(windows.competition_rank(d, "v").where("v is not null"), "rank") == [(4.0, 1), (2.0, 2), (2.0, 2), (1.0, 4)]
    assert rows(windows.percentile(d, "v").where("v is not null"), "v") == [(1.0, 0.25), (2.0, 0.75), (2.0, 0.75), (4.0, 1.0)]
    assert windows.percentile(d, "v", midrank=True).where("v = 2").first().pct == 0.5


def test_stints_split_at_a_season_gap_and_close_before_the_next(spark):
    d = dt.date
    data = [(1, "a", 1, 2000, d(2000, 1, 1)), (1, "a", 2, 2000, d(2000, 1, 5)), (1, "b", 3, 2000, d(2000, 2, 1)), (1, "a", 4, 2003, d(2003, 1, 1)), (2, "a", 5, 2003, d(2003, 3, 1))]
    f = spark.createDataFrame(data, "entity int, group string, event int, season int, day date")
    got = windows.stints(f, "entity", "group", ["day", "event"], season="season").where("entity = 1").orderBy("stint")
    assert [(r.group, r.first_day, r.last_day) for r in got.collect()] == [("a", d(2000, 1, 1), d(2000, 1, 5)), ("b", d(2000, 2, 1), d(2000, 2, 1)), ("a", d(2003, 1, 1), d(2003, 3, 1))]


def test_absence_counts_only_inside_tenure(spark):
    d = dt.date
    f = Rel(spark.createDataFrame([(9, "a", d(2000, 1, i)) for i in range(1, 6)], "entity int, group string, day date"))
    his = spark.createDataFrame([("a", d(2000, 1, 2)), ("a", d(2000, 1, 4))], "group string, day date")
    assert [r.day.day for r in f.without(his, ["group", "day"], windows.spans(his, ["group"])).df.collect()] == [3]


def test_swap_only_while_still_wrong(spark):
    g = spark.createDataFrame([(1, "x", "y"), (2, "y", "x")], "id int, home string, away string")
    fix = spark.createDataFrame([(1, "x"), (2, "x")], "id int, home string")
    assert rows(repair.swap_sides(g, fix, "id", "home", "away", "home").select("id", "home", "swapped"), "id") == [(1, "y", True), (2, "y", False)]


def test_identity_merge(spark):
    # 1 and 2 share a name and event 7 (2 has an empty line); 3 and 4 share a name but no event; 5 and 6 differ on a shared event
    fact = spark.createDataFrame([(1, 7, 30), (2, 7, None), (2, 8, 12), (1, 9, 5), (3, 7, 1), (4, 8, 1), (5, 7, 3), (6, 7, 4)], "id int, event int, pts int")
    dim = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "C"), (6, "C")], "id int, name string")
    got = rows(repair.merge_identities(fact, dim, "id", "name", ["event"], ["pts"], F.col("pts").isNotNull()).select("id", "event", "pts"), "id", "event")
    assert got == [(1, 7, 30), (1, 8, 12), (1, 9, 5), (3, 7, 1), (4, 8, 1), (5, 7, 3), (6, 7, 4)]


def test_real_events(spark):
    e = spark.createDataFrame([
        (1, 2000, "a", "b", "d1", "a", False), (2, 2000, "b", "a", "d1", "a", False),  # one pair and day: the one with detail stays
        (3, 2000, "a", "c", "d2", None, False), (4, 2000, "a", "?", "d3", "a", False),  # undecided; unknown member
        (5, 2000, "a", "c", "d4", "a", True), (6, 1999, "a", "c", "d4", "a", True),  # only a date: no detail in a season that has some; a season without any
    ], "event int, season int, home string, away string, day string, winner string, dated boolean")
    detail = spark.createDataFrame([(2,)], "event int")
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "team string")
    got = repair.real_events(e, detail, members, ["event"], "season", ("home", "away"), "day", F.col("winner").isNotNull(), F.col("dated"))
    assert [r.event for r in got.orderBy("event").collect()] == [2, 6]


def test_name_lookup_prefers_the_whole_name(spark):
    dim = spark.createDataFrame([(1, "Ann Lee"), (2, "Ann Lee Poe"), (3, "Bo Lee")], "id int, name string")
    m = spark.createDataFrame([("lee ann",), ("ann lee",), ("lee",), ("",), (None,)], "mention string")
    got = rows(match.lookup(m, dim).select("mention", "id"))
    assert got == [("ann lee", 1), ("lee", 1), ("lee", 2), ("lee", 3), ("lee ann", 1), ("lee ann", 2)]


@pytest.mark.parametrize(("a", "b", "n"), [("jokci", "jokic", 1), ("ca", "abc", 2), ("", "ab", 2), ("same", "same", 0), ("abcd", "badc", 2)])
def test_edits(a, b, n):
    assert match.edits(a, b) == n


def test_near_spelling_keeps_the_budget(spark):
    dim = spark.createDataFrame([(1, "Nikola Jokic"), (2, "Bob Iok")], "id int, name string")
    m = spark.createDataFrame([("jokci",), ("nikolla jokic",), ("bop",)], "mention string")
    assert rows(match.near_spelling(m, dim)) == [("jokci", 1, 1), ("nikolla jokic", 1, 1)]


def test_keyed_diff_kinds(spark):
    s = "k int, a double, l array<int>, z string"
    b = spark.createDataFrame([(1, 1.0, [1, 2], "x"), (2, 1.0, [1], "x"), (3, None, [1], "x"), (4, 2.0, [1], "x"), (6, 1.0, [1], "x")], s)
    a = spark.createDataFrame([(1, 1.0 + 1e-12, [2, 1], "x"), (2, 1.0, [1], "x"), (3, 1.0, [1], "x"), (5, 2.0, [1], "x"), (6, 1.1, [2], "y")], s)
    assert rows(match.keyed_diff(b, a, ["k"]).select("k", "path", "kind")) == [(1, "l", "reordered"), (3, "a", "type"), (4, "", "missing"), (5, "", "added"), (6, "a", "changed")]


def test_scalars(spark):
    d = spark.createDataFrame([("28,27,,25", " 7-14 ", "2024-03-10T07:30Z", "Dončić-Smith Jr.", "--")], "q string, r string, t string, n string, b string")
    w, l = scalar.two_parts(F.col("r"))  # noqa: E741
    got = d.select(scalar.listed_sum(F.col("q"), [1, 3, 9]), scalar.listed_sum(F.col("q"), [9]), w, l, scalar.civil_date(scalar.stamp(F.col("t"))), scalar.folded_name(F.col("n")), scalar.number(F.col("b"))).first()
    assert tuple(got) == (28, None, 7, 14, dt.date(2024, 3, 10), "doncic smith", None)


def test_placeless_rows_are_not_located(spark):
    d = spark.createDataFrame([(0, 0), (0, 3), (None, 1)], "x int, y int")
    assert relation.located(d, "x", "y").count() == 1


def test_ambiguous_index_resolves_to_nothing(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 3)], "k string, v int")
    assert rows(joins.unique_index(d, ["k"], "v")) == [("b", 3)]


def test_audits_are_empty_when_clean(spark):
    d = spark.createDataFrame([(2000, 1), (2000, 2), (2001, 1), (2001, 3)], "season int, k int")
    assert audit.repeated_keys(d, ["season", "k"]).count() == 0 and audit.phantom_seasons(d, "season", ["k"]).count() == 0
    assert rows(audit.staleness(d, d)) == [(0, 0)]


def test_resolve_names_takes_the_established_id_of_a_shared_event(spark):
    from tallyspark.operators import match

    dim = spark.createDataFrame([(1, "Ann"), (2, "Ann"), (3, "Bob"), (4, "Bob"), (5, "Cy")], "id int, name string")
    events = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 12), (4, 13)], "id int, event int")
    rows = spark.createDataFrame([("Ann",), ("ann",), ("Bob",), ("Cy",)], "name string")
    assert {r.name: r.id for r in match.resolve_names(rows, dim, "name", "id", events).collect()} == {"Ann": 2, "ann": 2, "Bob": None, "Cy": 5}


def test_folding_is_decomposition(spark):
    """Every lower-case letter of the Latin blocks, against the decomposition of Python's own tables; all suffix forms."""
    import unicodedata

    letters = [chr(i) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(i).islower()]
    plain = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in letters}
    d = spark.createDataFrame([(c, f"x{c}y") for c in letters], "c string, n string").select("c", scalar.folded_name(F.col("n")).alias("f"))
    for r in d.collect():
        if len(plain[r.c]) == 1:
            assert r.f == f"x{plain[r.c]}y"
    names = ["A B Jr.", "A B jr", "A B Sr", "A B II", "A B III", "A  B IV", "A-B V", " A B "]
    assert {r.f for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalar.folded_name(F.col("n")).alias("f")).collect()} == {"a b"}


def test_edits_count_bytes():
    assert match.edits("č", "c") == 2 and match.edits("jokci", "jokic") == 1 and match.edits("ab", "ba") == 1


def test_folders_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from tallyspark.plans.loads import _folder

    conf = SimpleNamespace(get=lambda *_: None)
    t = SimpleNamespace(spark=SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)))
    with pytest.raises(ValueError):
        _folder(t, "x")


SIDE = "event int, team int, opp int, home boolean, won boolean, amount int"


def test_team_shapes_keep_blank_neutral_and_last_meetings(spark):
    from tallyspark.plans import shapes

    s = spark.createDataFrame([(1, 1, 2, True, True, 10), (2, 1, 2, False, False, None), (3, 1, 2, True, None, 30), (4, 5, 5, True, True, 1)], SIDE)
    assert {(r.team, r.line, r.games, r.wins, r.losses) for r in shapes.team_record_when(s, "amount", 20).collect()} == {(1, "short", 1, 1, 0), (1, "blank", 1, 0, 1), (1, "reached", 1, 0, 0), (5, "short", 1, 1, 0)}
    assert {(r.team, r.place, r.games) for r in shapes.team_splits(s).collect()} == {(1, "home", 2), (1, "away", 1), (5, "neutral", 1)}
    assert [(r.team, r.opp, r.met, r.wins, r.losses, r.figure) for r in shapes.head_to_head(s, "amount", last=2, order=["event"]).collect()] == [(1, 2, 2, 0, 1, 30.0)]
    assert shapes.head_to_head(s, "amount").first().met == 3
    with pytest.raises(ValueError):
        shapes.head_to_head(s, "amount", last=2)


def test_period_line_with_roster_counts_idle_members(spark):
    from tallyspark.plans import shapes

    parts = spark.createDataFrame([("a", 1, 5), ("a", None, 2)], "grp string, player int, v int")
    roster = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "grp string, player int")
    out = shapes.team_period_line(parts, ["grp"], F.col("player"), "v", roster, ["grp", "player"])
    assert {tuple(r) for r in out.collect()} == {("a", 5.0, 2.0, 1), ("b", None, None, 1)}


def test_splits_show_empty_halves_and_shots_count_unknown(spark):
    from tallyspark.plans import shapes

    d = spark.createDataFrame([(1, True, 2.0), (2, None, 4.0)], "event int, won boolean, p double")
    kinds = {"outcome": {"won": F.col("won"), "lost": ~F.col("won")}, "any": {"all": F.lit(True)}}
    for frame, want in ((d, {("outcome", "won", 1, 2.0), ("outcome", "lost", 0, None), ("any", "all", 2, 3.0)}), (d.limit(0), {("outcome", "won", 0, None), ("outcome", "lost", 0, None), ("any", "all", 0, None)})):
        assert {tuple(r) for r in shapes.splits(Rel(frame), kinds, ["p"]).collect()} == want
    shots = spark.createDataFrame([(1, 1, True), (1, 2, None), (1, 3, False)], "event int, at int, good boolean")
    out = shapes.located_shots(shots, "event", F.col("good"), ["at"], [F.col("at")])
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, 3, 1, 1), (1, 2, 2, 3, 1, 1), (1, 3, 3, 3, 1, 1)]


def test_ranks_within_keys_by_ranges_against_plain_ranks(spark):
    import random

    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(300), 7, 7])) for _ in range(3000)]
    d = spark.createDataFrame([(i, k, None if v is None else float(v)) for i, (k, v) in enumerate(data)], "i int, k string, v double")
    pool = {k: [v for x, v in data if x == k and v is not None] for k in ("a", "b")}
    for r in windows.competition_rank(d, "v", key=["k"]).collect():
        assert r["rank"] == (None if r.k is None or r.v is None else 1 + sum(x > r.v for x in pool[r.k]))
    every = [v for _, v in data if v is not None]
    for r in windows.percentile(d, "v").collect():
        assert r.pct == (None if r.v is None else sum(x <= r.v for x in every) / len(every))
    assert windows.competition_rank(d.limit(0), "v", key=["k"]).count() == 0
