import json

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import flatten, load
from tallyspark.streaming import ingest


def rows(df):
    return [tuple(r) for r in df.orderBy(*df.columns).collect()]


def test_drifting_files(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(1, 5, 2000)], "id long, v long, season long").write.parquet(f"{p}/season=1")
    spark.createDataFrame([(2, 0.5)], "id int, v double").write.parquet(f"{p}/season=2")
    spark.range(1).select(F.lit(3).cast("long").alias("id"), F.lit(None).cast("void").alias("v")).withColumn("v", F.lit(None).cast("string")).write.parquet(f"{p}/season=3")
    df = load.read_drifting(spark, p, {"v": "double"})
    assert dict(df.dtypes) == {"id": "bigint", "v": "double", "season": "bigint"} and rows(df) == [(1, 5.0, 2000), (2, 0.5, None), (3, None, None)]


def test_publish_swaps_and_partial_load_leaves_the_rest(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    for t in ("a", "b"):
        spark.createDataFrame([(1,)], "x int").write.parquet(f"{src}/{t}")
    step = [("both", lambda have: have["a"].unionByName(have["b"]))]
    assert load.load(spark, src, dst, ["a", "b"], step)["both"].count() == 2
    before = rows(load.manifest(spark, dst).where("table = 'b'").select("path", "mtime"))
    seen = load.manifest(spark, dst)
    seen = spark.createDataFrame(seen.collect(), seen.schema)
    spark.createDataFrame([(2,), (3,)], "x int").write.mode("append").parquet(f"{src}/a")
    have = load.load(spark, src, dst, ["a", "b"], step, only=["a"])
    assert have["both"].count() == 4 and rows(load.manifest(spark, dst).where("table = 'b'").select("path", "mtime")) == before
    assert rows(load.changed_tables(load.manifest(spark, dst), seen)) == [("a",), ("both",)]


def test_ragged_rows(spark, tmp_path):
    p = str(tmp_path / "r")
    load.write_rows(spark, [{"a": 1}, {"b": "x"}], "a int, b string", p)
    assert sorted(map(str, rows(spark.read.parquet(p)))) == ["(1, None)", "(None, 'x')"]
    with pytest.raises(ValueError):
        load.write_rows(spark, [{"c": 1}], "a int, b string", p)


def test_upsert_keeps_what_the_new_row_lacks(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int"), spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, s string, n int")
    assert rows(load.upsert(old, new, ["k"])) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for i in range(2):
        spark.createDataFrame([(i,)], "x int").write.mode("append").parquet(src)
        ingest.ingest_new(spark, src, out, mark, "x int")
    assert rows(spark.read.parquet(out)) == [(0,), (1,)]


def test_complete_scopes(spark):
    e = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "scope string, unit int")
    got = ingest.complete_scopes(e, e.where("scope = 't'"), ["scope"], ["unit"])
    assert rows(got) == [("t",)] and rows(ingest.new_units(e, e.where("unit = 1"), ["scope", "unit"])) == [("s", 2)]


DOC = {
    "header": {"id": "7", "season": {"year": 2024, "type": 2}, "competitions": [{"date": "2024-01-01T00:00Z", "neutralSite": False, "competitors": [
        {"id": "1", "homeAway": "home", "winner": True, "score": "100", "team": {"id": "1"}, "linescores": [{"displayValue": "28"}, {"displayValue": "72"}]},
        {"id": "2", "homeAway": "away", "winner": False, "score": "90", "team": {"id": "2"}, "linescores": []}]}]},
    "boxscore": {
        "teams": [{"team": {"id": "1"}, "homeAway": "home", "statistics": [{"name": "assists", "displayValue": "20", "label": "Assists"}]}],
        "players": [{"team": {"id": "1"}, "statistics": [{"keys": ["minutes", "fieldGoalsMade-fieldGoalsAttempted"], "athletes": [
            {"athlete": {"id": "11", "displayName": "A B"}, "starter": True, "didNotPlay": False, "stats": ["30", "7-14"]},
            {"athlete": {"id": "12", "displayName": "C D"}, "starter": False, "didNotPlay": True, "stats": []}]}]}]},
    "plays": [{"id": "p1", "type": {"text": "Jump Shot"}, "period": {"number": 1}, "scoringPlay": True, "shootingPlay": True, "scoreValue": 2, "team": {"id": "1"}, "participants": [{"athlete": {"id": "11"}}, {"athlete": {"id": "12"}}], "coordinate": {"x": 1.0, "y": 2.0}},
              {"id": "p2", "type": {"text": "Foul"}, "period": {"number": 1}}],
    "winprobability": [{"homeWinPercentage": 0.6, "tiePercentage": 0.0, "playId": "p1"}],
}


def test_summary_documents(spark):
    t = flatten.flatten_summary(spark.createDataFrame([(json.dumps(DOC),), ("{}",), (None,)], "json string"), stats={"minutes": "bigint", "fieldGoalsMade-fieldGoalsAttempted": "bigint"})
    g = t["games"].where("event_id = '7'").first()
    assert (g.home_score, g.winner_team_id, g.home_linescores) == (100, "1", "28,72")
    box = {r.athlete_id: r for r in t["player_box"].collect()}
    assert (box["11"].fieldGoalsMade, box["11"].fieldGoalsAttempted, box["11"].opponent_team_id) == (7, 14, "2") and box["12"].minutes is None and box["12"].did_not_play
    assert [(r.play_id, r.athlete_id, r.participant_athlete_ids) for r in t["plays"].orderBy("play_id").collect()] == [("p1", "11", "11,12"), ("p2", None, "")] or t["plays"].count() == 2
    assert t["shots"].count() == 1 and t["win_probability"].count() == 1 and t["players"].count() == 2 and t["glossary"].first().label == "Assists"


def test_landed_rows_with_an_unknown_key_are_refused(spark, tmp_path):
    spark.createDataFrame([('{"a": 1}',), ('{"b": "x", "c": 2}',)], "value string").write.text(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        load.load_rows(spark, str(tmp_path / "in"), "a int, b string", str(tmp_path / "out"))
    load.load_rows(spark, str(tmp_path / "in"), "a int, b string, c int", str(tmp_path / "out"))
    assert sorted(map(str, rows(spark.read.parquet(str(tmp_path / "out"))))) == ["(1, None, None)", "(None, 'x', 2)"]


def test_many_files_are_grouped_by_footers(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(200).repartition(40).write.parquet(f"{p}/a")
    spark.range(5).selectExpr("id", "cast(id as double) as v").write.parquet(f"{p}/b c")
    assert sorted(map(len, load.by_schema(spark, p)))[-1] == 40 and load.read_drifting(spark, p).count() == 205
