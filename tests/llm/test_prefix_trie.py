"""The prefix trie against all prefixes in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import prefix_trie, queries  # noqa: E402

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str
    )


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, pos int, k1 string, part string")


def test_query_equals_all_prefixes(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert got(queries.queries()["op12_prefix_trie"](spark, sf_dir)) == plain(rebuilt(conversations(rows)))


@pytest.mark.parametrize(("block", "long", "span"), [(4, 100_000, 4096), (1, 3, 2), (3, 6, 1)])
def test_copies_nulls_and_long_conversations(spark, monkeypatch, block, long, span):
    monkeypatch.setattr(prefix_trie, "RANGE", span)
    r = random.Random(block)
    rows = [(c, i, r.choice(["user", "assistant"]), r.choice(["a", "é日", "", "hello there"])) for c in range(40) for i in range(r.choice([1, 2, 5, 9, 14]))]
    rows += [(c, i, "user", f"same {i}") for c in range(50, 80) for i in range(12)]  # copies
    rows += [(100, i, None, "x" * (i % 3)) for i in range(60)] + [(101, i, None, "x" * (i % 3)) for i in range(60)]
    rows += [(7, None, "system", None), (None, 1, "user", "nobody"), (None, None, None, None), (8, 3, "user", "again"), (8, 3, "user", "again"), (-3, 0, "user", "a")]
    df = made(spark, rows)
    turns = prefix_trie.ordered(df, long=long)
    convs = conversations([x for x in rows if x[0] != 8]) | {}
    eight = sorted(((t is not None, t or 0, a or "", b or "") for c, t, a, b in rows if c == 8), key=lambda x: x[:3])
    assert [x.pos for x in turns.where("conv_id = 8").orderBy("pos").collect()] == list(range(1, len(eight) + 1))
    only = made(spark, [x for x in rows if x[0] != 8])  # ties stand in the order of digests
    assert got(prefix_trie.trie(prefix_trie.ordered(only, long=long), block)) == plain(convs)
    want = {c: ts for c, ts in rebuilt(convs).items() if c >= 0}
    assert got(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.ordered(only.where("conv_id >= 0 or conv_id is null"), long=long)), block)) == plain(want)


def test_empty_table_and_one_turn(spark):
    none = made(spark, [(1, 1, "user", "x")]).limit(0)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.ordered(none))).count() == 0
    assert got(prefix_trie.trie(prefix_trie.ordered(made(spark, [(4, None, None, "é")])))) == plain({4: [("", "é")]})
