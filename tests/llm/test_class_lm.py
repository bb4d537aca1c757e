"""What op8's lookup of rare words moves and writes, and answers that cross batches."""

import os
import random
import time

import pytest

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import class_lm  # noqa: E402


def shuffled(spark):
    """Bytes that this session's tasks have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    time.sleep(0.3)
    spark.range(1).count()  # brings the store up to date
    sc.listenerBus().waitUntilEmpty()
    return sum(e.totalShuffleWrite() for e in map(sc.statusStore().executorList(False).apply, range(sc.statusStore().executorList(False).size())))


def size_of(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet"))


def texts(n, words, seed):
    r = random.Random(seed)
    return [" ".join(f"w{int(1.5 ** (r.random() * 25))}" if r.random() < 0.7 else f"{r.choice('nv')}{r.randrange(50_000)}" for _ in range(r.randrange(words))) for _ in range(n)]


def test_lookup_moves_less_than_the_slices(spark, monkeypatch):
    """Looking rare words up shuffles and writes less than the slices take; words travel once, with their counts."""
    monkeypatch.setattr(class_lm, "HELD", 500)
    tables, own = {}, class_lm.written

    def written(df, name):
        before = shuffled(spark)
        out = own(df, name)
        tables[name] = size_of(out._path), shuffled(spark) - before
        return out

    monkeypatch.setattr(class_lm, "written", written)
    docs = spark.createDataFrame(list(enumerate(texts(3000, 300, 1))), "doc_id long, text string").repartition(8)
    assert class_lm.class_lm(docs).count() == 3000
    slices = tables["lm-slices"][0]
    assert tables["lm-rare"][1] > 0
    assert tables["lm-resolved"][1] < slices
    assert tables["lm-resolved"][0] < slices / 2


def test_answers_cross_batches(spark, monkeypatch):
    """The same scores when a word's rows, and the answers to a slice, come in many batches."""
    monkeypatch.setattr(class_lm, "HELD", 12)
    docs = spark.createDataFrame([*enumerate([*texts(60, 40, 2), "only here", "only here"]), (None, "only here, too"), (99, None)], "doc_id long, text string").repartition(3)
    score = lambda: sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in class_lm.class_lm(docs).collect())
    want = score()
    monkeypatch.setattr(class_lm, "ASKED", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = score()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 64 and [x[:4] for x in got] == [x[:4] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[4:] == pytest.approx(b[4:])
