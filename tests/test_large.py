"""Steps of large tables: how their lines are dealt, and what they carry."""

import re

from pyspark.sql import functions as F

from tallyspark.operators import audit, match, ranges, repair
from tallyspark.plans import derived, shapes
from tallyspark.plans.bind import Tables
from tallyspark.sources import flatten


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def test_tasks_grow_with_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "event")
    assert ranges.dealt(df, 40 * ranges.EACH, "event").rdd.getNumPartitions() == 40


def test_merged_identities_meet_where_their_event_is(spark):
    fact = spark.createDataFrame([(1, 7, 5), (2, 7, None), (1, 8, 4), (3, 8, 4), (3, 9, None)], "id long, event long, pts int")
    dim = spark.createDataFrame([(1, "A"), (2, "A"), (3, "C")], "id long, name string")
    out = repair.merge_identities(ranges.dealt(fact, 40 * ranges.EACH, "event"), dim, "id", "name", ["event"], ["pts"], F.col("pts").isNotNull())
    assert sorted(tuple(r) for r in out.select("id", "event", "pts").collect()) == [(1, 7, 5), (1, 8, 4), (3, 8, 4), (3, 9, None)]
    assert not [x for x in shuffles(out) if "event" in x and "event#" != x.split(",")[0][: len("event#")]]


def test_ids_of_one_name_meet_as_that_name(spark):
    m = spark.createDataFrame([("blua ring",)], "mention string")
    dim = spark.createDataFrame([(1, "blue rod"), (1, "blue ring"), (2, "blue ring"), (2, "blue rod"), (3, "ring blue")], "id long, name string")
    out = match.near_spelling(m, dim)
    assert sorted((r.id, r.gap) for r in out.collect()) == [(1, 1), (2, 1), (3, 1)]
    assert "Generate explode(words" in plan(out) and not re.search(r"Generate explode\(words[^\n]*\[id#", plan(out))


def test_lines_of_actors_are_summed_where_their_event_is(spark):
    lines = spark.createDataFrame([(1, 5, 6, 2), (1, 6, None, 3), (2, 5, 5, 1)], "event long, a long, b long, n int")
    out = repair.rebuild_lines(ranges.dealt(lines, 40 * ranges.EACH, "event"), ["event"], [("a", {"n": F.col("n")}), ("b", {"m": F.lit(1)})])
    got = sorted((r.event, r.entity, None if r.n is None else int(r.n), None if r.m is None else int(r.m)) for r in out.collect())
    assert got == [(1, 5, 2, None), (1, 6, 3, 1), (2, 5, 1, 1)]
    assert len(shuffles(out)) == 1


def test_identity_pairs_of_several_ids(spark):
    fact = spark.createDataFrame([(i, e) for e in (1, 2) for i in (1, 2, 3, 1, 4) if (i, e) != (3, 2)], "id long, event long")
    dim = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, None)], "id long, name string")
    out = audit.identity_pairs(fact, dim, "id", "name", ["event"], 40 * ranges.EACH)
    assert sorted(tuple(r) for r in out.collect()) == [("A", 1, 2, 2), ("A", 1, 3, 1), ("A", 2, 3, 1)]
    assert all(x.endswith(" 40") for x in shuffles(out) if "event" in x)


def test_shots_of_an_event_are_summed_first(spark):
    d = spark.createDataFrame([(1, 1, 25.0, 1.0), (1, 1, 25.0, 3.0), (1, 2, 25.0, 2.0), (2, 1, 25.0, 5.0)], "supp long, event long, x double, y double")
    out = shapes.shot_distances(ranges.dealt(d, 40 * ranges.EACH, "event"), ["supp"], F.lit(2), F.col("x"), F.col("y"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2.0, 3, 2), (2, 5.0, 1, 1)]
    assert len(shuffles(out)) == 2


def test_sides_of_a_large_table_are_whole_in_their_task(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Tables, "rows", lambda self, name: 40 * ranges.EACH)
    assert [x for x in shuffles(derived.r5_season_metrics(Tables(spark, sf_dir))) if re.fullmatch(r"event#\d+L?, 40", x)]


def test_documents_gather_lines_once_and_frames_parse_their_own_parts(spark, sf_dir):
    docs = derived.summaries(Tables(spark, sf_dir))
    assert plan(docs).count("partial_collect_list(") == 1
    frames = flatten.flatten_summary(spark.createDataFrame([("{}",)], "json string"))
    assert "scoringPlay" not in plan(frames["glossary"]) and "athletes" not in plan(frames["plays"]) and "athletes" in plan(frames["player_box"])
    assert "Window" not in plan(frames["players"])
