"""Importance resampling against its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import importance, queries  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, n=1, buckets=10000, percent=10, least=20, seed=2024):
    """The same by plain counts, row by row."""

    def grams(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    own = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(x for _, _, g in own for x in g), Counter(x for y in target for x in grams(y)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, words, g in own:
        w = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(enough[: len(enough) * percent // 100], 1):
        ranks.setdefault(r, []).append(k)
    return sorted(((r[0], *r[2:], ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_query_equals_plain_counts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(queries.queries()["op13_importance_resampling"](spark, sf_dir)) == plain(docs, bench)


def test_odd_rows_ties_and_longer_runs(spark):
    long = "w" * 300_000 + " " + "\t\n" * 200_000 + "x " * 100_000
    texts = [(0, None), (1, ""), (2, "\x00 ,;"), (3, "One two THREE É日本 two-one"), (3, "One two THREE É日本 two-one"), (None, "a b a b " * 6), (None, "a b a b " * 6), (7, long), *((i, f"alpha beta x{i % 3} " * 8) for i in range(10, 60))]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id long, text string, cells string, rank int, score int")
    bench = ["alpha beta alpha", None, "", "a b"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    for n, buckets, percent, least in ((1, 10000, 10, 20), (3, 97, 50, 2), (2, 1, 100, 0)):
        assert got(importance.resample(docs, target, n, buckets, percent, least)) == plain(texts, bench, n, buckets, percent, least)


def test_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two")], "doc_id string, text string")
    none = docs.limit(0)
    assert importance.resample(none, none).count() == 0
    out = {r.doc_id: r for r in importance.resample(docs, none.select("text"), percent=50, min_words=1).collect()}
    assert sorted(r.rank or 0 for r in out.values()) == [0, 1] and out["a"].n_features == 2


def test_spans():
    p = importance.span_pattern(2)
    assert [m.span() for m in p.finditer(b"ab c de", overlapped=True)] == [(0, 4), (3, 7)]
