"""Near-duplicate embeddings against all pairs."""

import math

import numpy as np
import pytest

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import embedding_dedup as ed  # noqa: E402
from tallyspark.llm import queries  # noqa: E402

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def plain(rows, least=0.95):
    """The same by a double loop over rows."""
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for x, i in enumerate(ok):
        for j in ok[x + 1 :]:
            if len(rows[i][1]) == len(rows[j][1]) and ed.cosine(np.array(rows[i][1], float), np.array(rows[j][1], float)) >= least:
                links[i].add(j)
                links[j].add(i)
    low = {i: rows[i][0] for i in range(len(rows))}
    moved = True
    while moved:
        moved = False
        for i in ok:
            m = min([low[i], *(low[j] for j in links[i])])
            if m != low[i]:
                low[i], moved = m, True
    return sorted(((k, len(links[i]), low[i], k is None or k == low[i]) for i, (k, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def clouds(seed, n, dim=16, groups=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    return [(int(i), [float(x) for x in np.float32(centres[r.integers(groups)] + r.normal(size=dim) * r.choice([0.02, 0.15, 0.3, 2.0]))]) for i in r.permutation(n)]


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.queries()["op11_embedding_near_dedup"](spark, sf_dir)) == plain(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [5.0]), (12, [-5.0]), (13, [7.0])]
    rows += [(20, [1.0, 0.0, 0.0, 0.0]), (21, [19.0, math.sqrt(39.0), 0.0, 0.0]), (22, [0.0, 0.0, 3.0, 4.0]), (23, [0.0, 0.0, 3.0, 3.9])]
    if kind == "double":
        rows += [(30, [1e300, 1e300, 0.0, 0.0, 0.0]), (31, [1e-300, 1.1e-300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, cid int, v string")
    cast = [(i, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
    assert got(ed.near_vectors(df)) == plain(cast)
    assert ed.near_vectors(df.limit(0)).count() == 0
    assert got(ed.near_vectors(df.where("vec_id = 1"))) == [(1, 0, 1, True)]


def test_text_ids_many_tiles_cells_and_balls(spark, monkeypatch):
    monkeypatch.setattr(ed, "TRIED", 500)
    rows = [(f"v{i:05d}", v) for i, v in clouds(3, 900)]
    base = rows[0][1]
    r = np.random.default_rng(5)
    rows += [(f"w{i:05d}", [float(x) for x in np.float32(np.array(base) + r.normal(size=16) * 0.01)]) for i in range(300)]  # near copies
    rows += [(f"x{i:05d}", base) for i in range(200)]  # copies
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>").repartition(7)
    assert got(ed.near_vectors(df, tile=100)) == plain(rows)
    assert got(ed.near_vectors(df, least=0.8, tile=64)) == plain(rows, 0.8)
    turn = np.eye(16)
    cells = ed.Cells(np.array([v for _, v in rows]), turn, 0.95, len(rows), 100)
    assert cells.depth == 4 and cells.balls  # so the balls were at work above


def test_leading_dimensions_rule_out_most_pairs():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 64)) * np.linspace(2, 0.1, 64)
    u = ed.unit(x)
    turn = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    left, seen = ed.Rotated(x, np.ascontiguousarray(turn)), []
    pairs = sum(len(i) for i, _ in ed.linked(left, left, 0.95, True, seen))
    assert sum(seen) < 0.05 * 600 * 599 / 2 and pairs == int((np.triu(u @ u.T, 1) >= 0.95).sum())
    assert all(np.abs(left.y @ left.y.T - u @ u.T).max() < 1e-12 for _ in (0,))


def test_forest():
    f = ed.Forest(6)
    assert f.join(np.array([0, 1, 0, 4]), np.array([1, 2, 2, 5]), step=2) == [(0, 1), (1, 2), (4, 5)]
