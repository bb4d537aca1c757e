"""Inputs that once ended a job, lost rows or grew a list; texts of megabytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import decontaminate, importance, language_id, near_dedup, pieces, queries, suffix_dedup, token_counts, topk_search, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string"


def test_token_counts_of_very_long_runs(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a b " + " \n" * 600_000 + "c", "x" * 1_000_000, "word " * 1_000_000]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_languages_of_long_labelled_texts_only(spark):
    r = np.random.default_rng(0)
    cyr, lat = [chr(c) for c in range(0x430, 0x450)], [chr(c) for c in range(97, 123)]
    long = lambda letters: " ".join("".join(r.choice(letters, 6)) for _ in range(60_000))
    rows = [(i, long(cyr if i % 2 else lat), "c" if i % 2 else "l") for i in range(6)] + [(10, "".join(cyr[:9]), None), (11, "abc def", None), (12, "7 !", None), (13, None, "l")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x.lang_pred for x in language_id.identify(docs, language_id.train(docs)).collect()}
    assert got == {i: "c" if i % 2 else "l" for i in range(6)} | {10: "c", 11: "l", 12: "und", 13: "und"}


def test_landmark_columns_are_bounded(monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 28)
    grams = language_id.Grams()
    marks = language_id.Landmarks([np.concatenate(grams.of(t)) for t in ("abcd", "abce")])
    assert marks.rows.shape == (2, 14)
    k = marks.kernel(["abcd"], grams, marks.columns())
    assert 0.5 < k[0, 1] <= k[0, 0] <= 1 + 1e-6


def test_each_language_has_a_text(spark):
    rows = [(i, f"text {i} of many", f"l{i % 40}") for i in range(4000)]
    model = language_id.train(spark.createDataFrame(rows, DOCS), sample=40)
    assert len(model[2]) == 40


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [float(i), 1.0]) for i in range(8)] + [(i, [0.1 * i, 0.0]) for i in range(1, 6)] + [(0, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {}
    for q, v in rows:
        if q % 50 == 0:
            for c, w in rows:
                if c != q:
                    s = sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, w, strict=True))
                    want[q, c] = max(s, want.get((q, c), s))
    best = sorted(((-s, c) for (_, c), s in want.items()))[:5]
    assert [(-r.score, r.vec_id) for r in topk_search.top_k(df).orderBy("rank").collect()] == best
    with pytest.raises(TypeError):
        topk_search.top_k(df.withColumn("vec_id", F.col("vec_id").cast("string")))


def test_spans_of_copies_are_one_list(spark):
    text = "".join(chr(97 + int(x)) for x in np.random.default_rng(1).integers(0, 26, 3000))
    docs = spark.createDataFrame([(5, text)] * 60 + [(None, text)] * 60 + [(6, text[:400] + "-" + text[900:1500])], "doc_id long, text string")
    spans = suffix_dedup.repeated_spans(docs).collect()
    assert len(spans) == 3 and max(len(r.spans) for r in spans) < 600
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.substring_digests(docs).collect()} == {(5, 3000), (None, 3000), (6, 1000)}


def test_text_ids(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [("b", " ".join(words)), ("a", " ".join(words) + " end"), ("c", "quite another text " * 20), (None, " ".join(words)), ("d", None)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    near = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert near == {("a", "a", True), ("b", "a", False), ("c", "c", True), (None, None, True), ("d", "d", True)}
    twice = spark.createDataFrame([("x", "ab" * 200), ("y", "cd" + "ab" * 150), (None, "short")], "doc_id string, text string")
    numbers = spark.createDataFrame([(1, "ab" * 200), (2, "cd" + "ab" * 150), (None, "short")], "doc_id long, text string")
    key = {1: "x", 2: "y", None: None}
    plain = {(key[r.doc_id], r.n_removed, r.kept_sha256) for r in suffix_dedup.substring_digests(numbers).collect()}
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.substring_digests(twice).collect()} == plain


def test_megabytes(spark):
    r = np.random.default_rng(2)
    texts = [" " * 1_000_000, "z" * 1_000_000, "\n" * 1_000_000, " ".join(f"w{x}" for x in r.integers(0, 10**6, 150_000)), "漢字かな" * 80_000, "short text of a few words"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS).repartition(6)
    bench = spark.createDataFrame([(1, "short text of a few words"), (2, "z" * 1_000_000)], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, toxic int")
    bpe, model = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
    runs = {
        "hit": decontaminate.decontaminate(docs, bench), "tokens": token_counts.count_tokens(docs, bpe), "toxic": toxicity.score(docs, toxicity.train(docs, labels)), "near": near_dedup.near_duplicates(docs, 2),
        "language": language_id.identify(docs, language_id.train(docs)), "pieces": pieces.piece_digests(docs, model), "suffix": suffix_dedup.substring_digests(docs), "draw": importance.resample(docs, bench),
    }
    got = {k: {r.doc_id: r for r in d.collect()} for k, d in runs.items()}
    assert all(sorted(v) == list(range(6)) for v in got.values())
    assert [got["hit"][i].contaminated for i in range(6)] == [False, True, False, False, False, True]
    assert [got["suffix"][i].n_removed for i in range(6)] == [1_000_000, 1_000_000, 1_000_000, 0, len((texts[4]).encode()), 0]
    assert [got["draw"][i].n_features for i in range(6)] == [0, 1, 0, 150_000, 1, 6]


def test_cells_out_of_reach_are_not_searched():
    r = np.random.default_rng(9)
    centres = r.normal(0, 900, (12, 8))
    v = np.floor(centres[r.integers(0, 12, 3000)] + r.normal(0, 9, (3000, 8)))
    norm2 = float((v * v).sum(axis=1).max())
    pivots = topk_search._spread(topk_search.longer(v[:1000], norm2), 16)
    d = topk_search.distances(v, norm2, pivots)
    cell = topk_search.nearest(d)
    n = np.bincount(cell, minlength=16)
    lo, hi = (np.array([f(d[cell == c], axis=0) if n[c] else np.full(16, np.nan) for c in range(16)]) for f in (np.min, np.max))
    q = v[:100]
    scores = q @ v.T
    scores[np.arange(100), np.arange(100)] = -np.inf
    worst = np.sort(scores, axis=1)[:, -5]
    to = topk_search.reachable(q, worst, norm2, pivots, n, lo, hi)
    assert all(to[i, cell[j]] for i in range(100) for j in np.flatnonzero(scores[i] >= worst[i])) and to.mean() < 0.7
    assert topk_search.reachable(q, np.full(100, -np.inf), norm2, pivots, n, lo, hi)[:, n > 0].all()


@pytest.mark.parametrize("spread", [4.0, 300.0])
def test_top_k_of_clustered_vectors_in_small_blocks(spark, spread):
    r = np.random.default_rng(int(spread))
    centres = r.normal(0, 2, (9, 6))
    v = (centres[r.integers(0, 9, 700)] + r.normal(0, spread / 256, (700, 6))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    w = np.floor(256 * v.astype(np.float64))
    got = {}
    for x in topk_search.top_k(df, every=10, query_block=8, block=30, pivots=9).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q in range(0, 700, 10):
        s = w @ w[q]
        best = sorted((j for j in range(700) if j != q), key=lambda j: (-s[j], j))[:5]
        assert sorted(got[q]) == [(i, j, int(s[j])) for i, j in enumerate(best, 1)]
