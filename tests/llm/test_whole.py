"""Whole results of operators that SQL cannot say, against plain brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import queries, toxicity  # noqa: E402
from tallyspark.llm._common import scratch, shared_dir, written  # noqa: E402

SF = "/root/testdata/sf0.01"


def words(fold):
    return [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]+", fold)]


def plain_toxicity(docs, labels):
    """Scores by plain search of every pattern at every word; the curve by gradient steps to its minimum."""
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known[i] = max(y, known.get(i, 0))
    first = {}
    for i, t in docs:
        if i in known and t is not None and (t not in first or i < first[t]):
            first[t] = i
    rows = [(known[i], toxicity.fold(t)) for t, i in first.items()]
    one, zero = Counter(), Counter()
    for y, f in rows:
        own = {w for _, w in words(f)}
        for x in own | {w[:n] + "*" for w in own for n in (4, 5, 6, 7, 8) if len(w) > n}:
            (one if y else zero)[x] += 1
    n1 = sum(y for y, _ in rows)
    lexicon = toxicity.choose(one, zero, n1, len(rows) - n1)

    def hits(f):
        ws = words(f)
        out = []
        for k, (_, w) in enumerate(ws):
            for p, weight in lexicon.items():
                stems = {p.rstrip("*"), p.rstrip("*").replace("l", "i")}
                if any(w.startswith(s) if p[-1] == "*" else w == s for s in stems):
                    out.append((f"{ws[k - 1][1] if k else ''} {w}", weight))
        return out

    seen = [(y, hits(f), 1.0 + f.count(" ") + f.count("\n")) for y, f in rows]
    every, toxic = Counter(p for _, h, _ in seen for p in {x for x, _ in h}), Counter(p for y, h, _ in seen if y for p in {x for x, _ in h})
    excused = {p for p, n in every.items() if n >= 3 and not toxic[p]}
    total = lambda h: sum(w for p, w in h if p not in excused)
    shape = lambda s, n: np.array([1.0, np.log1p(s), np.log1p(s / np.sqrt(n))])
    x, y = np.array([shape(total(h), n) for _, h, n in seen]), np.array([float(y > 0) for y, _, _ in seen])
    w = np.zeros(3)
    for _ in range(200_000):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 0.05 * w
        w -= g / (0.25 * (x * x).sum() + 0.05)
        if np.abs(g).max() < 1e-7:
            break
    out = {}
    for i, t in docs:
        f = toxicity.fold(t or "")
        out[i] = 1 / (1 + np.exp(-shape(total(hits(f)), 1.0 + f.count(" ") + f.count("\n")) @ w))
    return out


def test_toxicity_scores_against_plain_search(spark):
    docs = queries.table(spark, SF, "documents")
    labels = queries.table(spark, SF, "labels")
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, SF).collect()}
    seen = [(r.doc_id, r.toxic) for r in labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).collect()]
    want = plain_toxicity([(r.doc_id, r.text) for r in docs.collect()], seen)
    # phrases look back 60 characters, so a far word before a hit may differ; none does here
    assert max(abs(got[i].score - p) for i, p in want.items()) < 1e-4
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    held = {r.doc_id: r.toxic for r in labels.collect() if got[r.doc_id].held_out}
    caught = sum(got[i].predicted for i, y in held.items() if y)
    assert caught > 0.7 * sum(held.values()) and caught > 0.95 * sum(got[i].predicted for i in held)


def plain_pipeline(docs, bench, encode):
    """The five stages over plain lists."""
    docs = [(i, t) for i, t in docs if t is not None and re.search(r"[^\W\d_]", t)]
    low = lambda t: t.translate({i: i + 32 for i in range(65, 91)})
    sets = []
    for _, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(t)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and comp[a] != comp[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]), key=lambda c: docs[c][0])
                comp = [x if c == y else c for c in comp]
    docs = [docs[c] for c in sorted(set(comp))]
    raw = [t.encode() for _, t in docs]
    count = Counter(d[k : k + 200] for d in raw for k in range(len(d) - 199))
    kept = []
    for (i, _), d in zip(docs, raw, strict=True):
        gone = np.zeros(len(d) + 1, int)
        for k in range(len(d) - 199):
            if count[d[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        left = bytes(b for b, g in zip(d, np.cumsum(gone), strict=False) if not g).decode("utf-8", "ignore")
        if left or not gone.any():
            kept.append((i, left))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = {tuple(w[k : k + min(10, len(w))]) for w in map(split, bench) if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    clean = [(i, t) for i, t in kept if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))]
    return {i: encode(t) for i, t in clean}


def test_pipeline_against_plain_stages(spark, sf_dir):
    pipe = pytest.importorskip("corpus_pipeline")
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))

    def encode(t):
        ids = [*sp.encode(t), sp.eos_id()]
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    want = plain_pipeline(docs, [r.text for r in queries.table(spark, sf_dir, "benchmark").collect()], encode)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipe.run(spark, sf_dir).collect()}
    assert got == want and len(want) < len(docs)


def tables(spark):
    p = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + "/tables")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()


def test_a_run_leaves_only_what_its_result_reads(spark, sf_dir):
    pipe = pytest.importorskip("corpus_pipeline")
    before = tables(spark)
    out = pipe.run(spark, sf_dir)
    left = tables(spark) - before
    assert out.count() > 0 and len(left) == 1 and next(iter(left)).startswith("SentencePiece")
    before = tables(spark)
    queries.op6_near_dedup(spark, sf_dir).count()
    queries.op10_suffix_dedup(spark, sf_dir).count()
    assert {x.split("-")[0] for x in tables(spark) - before} == {"sketch", "classes", "cc", "ends", "spans"}
    before = tables(spark)
    queries.op11_embedding_near_dedup(spark, sf_dir).count()
    assert {x.split("-")[0] for x in tables(spark) - before} == {"vectors", "links", "cc"}
    before = tables(spark)
    queries.op12_prefix_trie(spark, sf_dir).count()
    assert {x.split("-")[0] for x in tables(spark) - before} == {"ends", "nodes", "subtrees", "digests"}


def test_scratch_deletes_also_after_a_failure(spark):
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        written(spark.range(1), "a")
        raise ZeroDivisionError
    with scratch(spark):
        with scratch(spark) as keep:
            kept = written(spark.range(2), "b")
            written(spark.range(3), "c")
            keep(kept)
        assert kept.count() == 2 and len(tables(spark) - before) == 1
    assert tables(spark) == before
