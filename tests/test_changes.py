"""Nested differences, digests, versions, ledgers, stream markers, runs in ranges, near spellings, spans in bins."""

import datetime as dt
import itertools
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators import audit, diff, joins, match, windows
from tallyspark.operators.ranges import numbered, ranged
from tallyspark.sources import ledger, load
from tallyspark.sources.store import Store
from tallyspark.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# nested differences

DOC = "k int, a double, s struct<x: int, y: struct<z: string>>, m map<string, array<int>>, l array<struct<p: int, q: double>>"


def found(spark, b, a, sb=DOC, sa=DOC):
    return [tuple(r)[1:3] for r in diff.nested_diff(spark.createDataFrame(b, sb), spark.createDataFrame(a, sa), ["k"]).orderBy("k", "path").collect()]


def test_every_kind_of_difference(spark):
    base = (1, 1.0, (1, ("u",)), {"f": [1, 2], "g": []}, [(1, 1.0), (2, 2.0), (2, 2.0)])
    same = (1, 1.0 + 1e-13, (1, ("u",)), {"g": [], "f": [1, 2]}, [(1, 1.0), (2, 2.0 - 1e-13), (2, 2.0)])
    assert found(spark, [base], [same]) == []
    other = (1, None, (2, ("v",)), {"f": [2, 1], "h": [3]}, [(2, 2.0), (1, 1.0 + 1e-13), (2, 2.0)])
    assert found(spark, [base], [other]) == [("a", "changed"), ("l", "reordered"), ("m.f", "reordered"), ("m.g", "missing"), ("m.h", "added"), ("s.x", "changed"), ("s.y.z", "changed")]
    longer = (1, float("nan"), None, {"f": [1, 5], "g": []}, [(1, 1.5), (2, 2.0)])
    assert found(spark, [base], [longer]) == [("a", "changed"), ("l[0].q", "changed"), ("l[2]", "missing"), ("m.f[1]", "changed"), ("s", "changed")]
    assert found(spark, [longer], [longer]) == []  # a NaN is a NaN
    assert found(spark, [base], [(2, *base[1:])]) == [("", "missing"), ("", "added")]
    assert found(spark, [(1, None, None, None, None)], [(1, None, None, None, None)]) == []


def test_a_changed_item_is_not_a_reordered_list(spark):
    s = "k int, l array<struct<p: int, q: double>>"
    assert found(spark, [(1, [(1, 1.0), (1, 1.0), (2, 2.0)])], [(1, [(2, 2.0), (1, 1.0), (2, 2.0)])], s, s) == [("l[0].p", "changed"), ("l[0].q", "changed")]
    nested = "k int, l array<array<int>>"
    assert found(spark, [(1, [[1, 2], [3]])], [(1, [[3], [1, 2]])], nested, nested) == [("l", "reordered")]
    assert found(spark, [(1, [[1, 2], [3]])], [(1, [[2, 1], [3]])], nested, nested) == [("l[0]", "reordered")]
    assert found(spark, [(1, [None, [3]])], [(1, [[3], None])], nested, nested) == [("l", "reordered")]


def test_unlike_types_and_columns_of_one_side(spark):
    assert found(spark, [(1, 5, "x", 2)], [(1, 5.0, None, 3)], "k int, n int, gone string, z int", "k int, n double, new string, z int") == [("gone", "missing"), ("n", "type"), ("z", "changed")]
    assert found(spark, [(1, None)], [(1, 5.0)], "k int, n int", "k int, n double") == [("n", "changed")]
    assert diff.nested_diff(spark.createDataFrame([], DOC), spark.createDataFrame([], DOC), ["k"]).count() == 0


def walk(path, x, y):
    """The same rules over plain values, to compare with."""
    if x is None or y is None:
        return [] if x is None and y is None else [(path, "changed")]
    if isinstance(x, dict):
        out = []
        for k in sorted({*x, *y}):
            p = f"{path}.{k}" if path else k
            out += [(p, "missing")] if k not in y else [(p, "added")] if k not in x else walk(p, x[k], y[k])
        return out
    if isinstance(x, list):
        out = [d for i, (u, v) in enumerate(zip(x, y, strict=False)) for d in walk(f"{path}[{i}]", u, v)]
        if len(x) == len(y) and out and any(not any(walk("", u, v) for u, v in zip(x, p, strict=True)) for p in itertools.permutations(y)):
            return [(path, "reordered")]
        out += [(f"{path}[{i}]", "missing") for i in range(len(y), len(x))]
        return out + [(f"{path}[{i}]", "added") for i in range(len(x), len(y))]
    return [] if abs(x - y) <= 1e-9 * max(1, abs(x), abs(y)) else [(path, "changed")]


def test_random_documents_against_a_plain_walk(spark):
    r = random.Random(4)
    num = lambda: r.choice([1.0, 2.0, 1.0 + 1e-12, None])
    item = lambda: r.choice([None, {"p": num(), "l": [num() for _ in range(r.randrange(3))]}])
    doc = lambda: {"v": num(), "ls": r.choice([None, [item() for _ in range(r.randrange(5))]]), "m": {k: [num()] for k in "abc" if r.random() < 0.7}}
    kind = T._parse_datatype_string("k int, d struct<v: double, ls: array<struct<p: double, l: array<double>>>, m: map<string, array<double>>>")
    pairs = []
    for _ in range(300):
        a, b = doc(), doc()
        if a["ls"] and r.random() < 0.6:
            b["ls"] = r.sample(a["ls"], len(a["ls"]))
        pairs.append((a, b))
    left, right = (spark.createDataFrame([(i, p[s]) for i, p in enumerate(pairs)], kind) for s in (0, 1))
    got = sorted((x.k, x.path, x.kind) for x in diff.nested_diff(left, right, ["k"]).collect())
    assert got == sorted((i, p, k) for i, (a, b) in enumerate(pairs) for p, k in walk("d", a, b))


# digests of tables


def test_table_differences(spark):
    s = "a int, b string, c array<int>"
    left = spark.createDataFrame([(1, "x", [1]), (1, "x", [1]), (None, "y", None), (3, None, [None])], s)
    right = spark.createDataFrame([(1, "x", [1]), (None, "y", None), (3, None, []), (4, "z", [2])], s)
    assert rows(diff.table_diff(left, right).select("side", "a")) == [("left", 1), ("left", 3), ("right", 3), ("right", 4)]
    assert rows(audit.staleness(right, left)) == [(2, 2)] and rows(audit.staleness(left, left)) == [(0, 0)]
    swapped = spark.createDataFrame([(None, 5)], "a int, b int"), spark.createDataFrame([(5, None)], "a int, b int")
    assert diff.table_diff(*swapped).count() == 2
    assert rows(audit.staleness(left.limit(0), left)) == [(4, 0)] and diff.unequal_ranges(left, left).count() == 0


# versions


def test_readers_never_see_a_missing_or_mixed_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    parts = [{t: [store.build(t, spark.range(3).select(F.lit(i).alias("v")).coalesce(1))] for t in ("a", "b")} for i in range(3)]
    store.publish(parts[0])
    seen, stop = [], threading.Event()

    def reader():
        own = Store(spark, str(tmp_path / "s"))
        while not stop.is_set():
            n, now = own.current()
            seen.append((n, now["tables"]["a"], now["tables"]["b"]))

    t = threading.Thread(target=reader)
    t.start()
    for i in range(50):
        store.publish(parts[i % 3])
    stop.set()
    t.join()
    assert {(tuple(a), tuple(b)) for _, a, b in seen} <= {(tuple(p["a"]), tuple(p["b"])) for p in parts}
    assert [n for n, _, _ in seen] == sorted(n for n, _, _ in seen) and store.current()[0] == 51
    assert rows(store.read("a")) == [((50 - 1) % 3,)] * 3


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    one = Store(spark, root)
    part = one.build("t", spark.range(1))
    threads = [threading.Thread(target=lambda i=i: [Store(spark, root).publish({f"t{i}-{k}": [part]}) for k in range(5)]) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(one.current()[1]["tables"]) == 20 and one.numbers() == list(range(1, 21))


def test_an_unfinished_pointer_and_old_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), patience=0.2)
    for i in range(3):
        store.publish({"a": [store.build("a", spark.range(i + 1))]})
    building = store.build("a", spark.range(9))
    (tmp_path / "s" / "_current" / f"{4:020d}").write_text('{"tables"')  # its writer died
    assert store.current()[0] == 3 and store.read("a").count() == 3 and store.read("a", 2).count() == 2
    assert len(store.clean(keep=3, grace=0)) == 2 and store.read("a").count() == 3  # the part of 1 and the one without a pointer
    assert store.publish({"a": [building]}) == 5
    with pytest.raises(KeyError):
        store.read("nothing")


# the ledger


def test_a_second_load_reads_new_footers_only(spark, tmp_path, monkeypatch):
    src, store, book = str(tmp_path / "in"), Store(spark, str(tmp_path / "s")), str(tmp_path / "book")
    spark.range(50).selectExpr("id", "id % 2 as v").repartition(10).write.parquet(f"{src}/a b")
    assert ledger.load_drifting(spark, src, store, "t", book, size=4) == 10 and store.read("t").count() == 50
    assert ledger.load_drifting(spark, src, store, "t", book, size=4) == 0
    spark.range(50).selectExpr("id", "cast(id as double) / 2 as v", "'x' as w").repartition(5).write.parquet(f"{src}/c")
    taken = []
    plain = ledger.footers
    monkeypatch.setattr(ledger, "footers", lambda files: (taken.append(files.count()), plain(files))[1])
    assert ledger.load_drifting(spark, src, store, "t", book, size=2) == 5 and taken == [2, 2, 1]
    out = store.read("t")
    assert dict(out.dtypes) == {"id": "bigint", "v": "double", "w": "string"} and out.count() == 100
    assert ledger.held(spark, book).count() == 15


def test_a_stopped_load_goes_on_and_a_changed_file_rebuilds(spark, tmp_path, monkeypatch):
    src, store, book = str(tmp_path / "in"), Store(spark, str(tmp_path / "s")), str(tmp_path / "book")
    spark.range(6).repartition(3).write.parquet(f"{src}/a")
    monkeypatch.setattr(store, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        ledger.load_drifting(spark, src, store, "t", book)
    monkeypatch.undo()
    assert store.current()[0] == 0 and ledger.load_drifting(spark, src, store, "t", book) == 3 and store.read("t").count() == 6
    spark.range(100, 104).coalesce(1).write.mode("overwrite").parquet(f"{src}/a")
    assert ledger.load_drifting(spark, src, store, "t", book) == 1 and rows(store.read("t")) == [(100,), (101,), (102,), (103,)]
    assert ledger.load_drifting(spark, src, store, "t", book) == 0
    spark.range(1).write.mode("append").parquet(f"{src}/a")
    assert ledger.load_drifting(spark, src, store, "t", book) >= 1 and store.read("t").count() == 5


def test_footers_are_read_where_only_spark_can(spark, tmp_path):
    """A file system that pyarrow does not know."""
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tests.link./data", f"file://{tmp_path}")
    assert load.read_drifting(spark, "viewfs://tests/data/t").count() == 3


# scopes of a stream


def test_markers_once_whatever_stops(spark, tmp_path):
    src, store, marks = (str(tmp_path / x) for x in ("in", "store", "marks"))
    expected = spark.createDataFrame([(s, u) for s in "abc" for u in range(3)], "s string, u int")
    scopes = ingest.Scopes(spark, store, expected, ["s"], ["u"])
    put = lambda *units: spark.createDataFrame([*units], "s string, u int").coalesce(1).write.mode("append").parquet(src)
    put(("a", 0), ("a", 1), ("a", 1), ("b", 0), ("z", 0))
    ingest.complete_stream(scopes, src, marks, "s string, u int")
    assert rows(scopes.markers()) == []
    put(("a", 2), ("b", 1))
    real, calls = ingest.Scopes._put, []

    def stopped(self, df, name, batch):
        calls.append(name)
        if name == "markers" and calls.count("markers") == 1:
            raise RuntimeError("stopped before the marker")
        return real(self, df, name, batch)

    ingest.Scopes._put = stopped
    try:
        with pytest.raises(Exception, match="stopped"):
            ingest.complete_stream(scopes, src, marks, "s string, u int")
        assert rows(scopes.markers()) == []
        put(("b", 2), ("a", 2), ("c", 0))
        ingest.complete_stream(scopes, src, marks, "s string, u int")  # the stopped batch first, then the new file
    finally:
        ingest.Scopes._put = real
    assert rows(scopes.markers()) == [("a", 1), ("b", 2)]
    assert scopes.table("landed").count() == 7 and rows(scopes.open(expected.select("s").distinct())) == [("c",)]


# runs in ranges


def plain_runs(data):
    """Key to the first of its longest runs: (length, first day, last day, open)."""
    out = {}
    for k in {d[0] for d in data}:
        own, run, best = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2])), [], []
        for i, d in enumerate(own):
            run = [*run, i] if d[3] else []
            if len(run) > len(best):
                best = run
        if best:
            out[k] = (len(best), own[best[0]][4], own[best[-1]][4], best[-1] == len(own) - 1)
    return out


@pytest.mark.parametrize("share", [0.02, 0.5, 0.97, 1.0])
def test_runs_of_a_large_key_by_ranges(spark, share):
    r = random.Random(share)
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(i // 3)
    data = [(k, i // 2, i, r.choice([None, False]) if r.random() > share else True, day(i)) for k, n in (("hot", 3000), ("cold", 40), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, ts int, e int, hit boolean, day date")
    assert ranged(df, ["k"], "ts", large=500)[1] and not ranged(df, ["k"], "ts")[1]
    want = plain_runs(data)
    for large in (500, 1_000_000):
        got = windows.longest_runs(df, ["k"], ["ts", "e"], F.col("hit"), large=large)
        assert {x.k: (x.length, x.first_day, x.last_day, x.open) for x in got.collect()} == want
    every = [windows.longest_runs(df, ["k"], ["ts", "e"], F.col("hit"), best_per_key=False, large=n) for n in (500, 1_000_000)]
    assert rows(every[0]) == rows(every[1])


def test_of_equal_runs_the_first_stands(spark):
    df = spark.createDataFrame([(1, i, dt.date(2000, 1, i + 1), h) for i, h in enumerate([True, True, False, True, True])], "k int, ts int, day date, hit boolean")
    assert [(r.length, r.first_day, r.open) for r in windows.longest_runs(df, ["k"], ["ts"], F.col("hit")).collect()] == [(2, dt.date(2000, 1, 1), False)]


def test_places_within_large_keys(spark):
    r = random.Random(5)
    data = [(k, r.randrange(300), i) for k, n in (("hot", 2000), ("cold", 30), (None, 4)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, ts int, e int")
    want = {}
    for k in ("hot", "cold", None):
        want |= {(k, e): i for i, (_, _, e) in enumerate(sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2])), 1)}
    for large in (100, 1_000_000):
        assert {(x.k, x.e): x.n for x in numbered(df, ["k"], ["ts", "e"], "n", large).collect()} == want


def test_a_large_key_is_many_tasks(spark):
    df = spark.range(20_000).selectExpr("1 as k", "id as ts", "id % 7 > 0 as hit", "date_add(date '2000-01-01', cast(id as int)) as day")
    got, split = ranged(df, ["k"], "ts", large=1000)
    sizes = [r["count"] for r in got.groupBy("k", "_range").count().collect()]
    assert split and len(sizes) == 64 and max(sizes) < 2 * 20_000 / 64


# names


def test_near_edits_equal_the_plain_distance(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcé") for _ in range(r.randrange(7))) for _ in range(700)]
    pairs = [(r.choice(words), r.choice(words)) for _ in range(3000)]
    for _ in range(3000):  # near ones
        w = list(r.choice(words))
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w) + 1)
            kind = r.randrange(3)
            w[i : i + (kind > 0)] = [r.choice("abcé")] if kind < 2 else []
            if len(w) > 1 and r.random() < 0.5:
                i = r.randrange(len(w) - 1)
                w[i], w[i + 1] = w[i + 1], w[i]
        pairs.append((r.choice(words), "".join(w)) if r.random() < 0.1 else ("".join(w), "".join(w[:-1] + w[-1:])))
        pairs.append((r.choice(words), "".join(w)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", match.near_edits(F.col("a"), F.col("b")).alias("n"))
    for x in got.collect():
        want = match.edits(x.a, x.b)
        assert x.n == want if want <= 2 else x.n > 2, (x.a, x.b, x.n, want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_word_of_all_names_multiplies_nothing(spark):
    dim = spark.range(2000).selectExpr("id", "concat('common ', char(97 + id % 26), char(97 + (id div 26) % 26), char(97 + id div 676)) as name")
    m = spark.createDataFrame([("common aaa",), ("bba common",), ("common zzz",), ("common nowhere",)], "mention string")
    out = match.lookup(m, dim)
    assert {(r.mention, r.id, r.exact) for r in out.collect()} == {("common aaa", 0, True), ("bba common", 27, False)}


def test_lookup_against_plain_sets(spark):
    r = random.Random(2)
    words = ["ann", "bo", "cy", "lee", "poe", "lee-poe"]
    names = [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(60)]
    mentions = {" ".join(r.choice([*words, "zed"]) for _ in range(r.randrange(0, 3))) for _ in range(60)}
    split = lambda t: t.replace("-", " ").split()
    want = set()
    for m in mentions:
        own = split(m)
        whole = {i for i, n in enumerate(names) if own and split(n) == own}
        want |= {(m, i, True) for i in whole} or {(m, i, False) for i, n in enumerate(names) if own and set(own) <= set(split(n))}
    got = match.lookup(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    assert {tuple(x) for x in got.collect()} == want


def test_near_spelling_against_plain_words(spark):
    r = random.Random(6)
    words = ["ann", "anna", "bob", "lester", "lesley", "poe", "jokic", "common", "commons"]
    names = [" ".join(r.sample(words, r.randrange(1, 4))) for _ in range(80)]
    typed = ["comon", "lestre", "jokci", "bob", "anns", "lesleyy", "zzzzzzz", "ann"]
    mentions = {" ".join(r.choice(typed) for _ in range(r.randrange(0, 3))) for _ in range(40)}
    budget = lambda w: 0 if len(w) <= 3 else 1 if len(w) <= 6 else 2
    want = set()
    for m in mentions:
        own = set(m.split())
        for i, n in enumerate(names):
            best = [min((match.edits(w, x) for x in n.split() if match.edits(w, x) <= budget(w)), default=None) for w in own]
            if own and None not in best:
                want.add((m, i, sum(best)))
    got = match.near_spelling(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    assert {tuple(x) for x in got.collect()} == want


# spans in bins


@pytest.mark.parametrize("bins", [1, 7, 256])
def test_spans_meet_each_day_once(spark, bins):
    r = random.Random(bins)
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(i)
    events = [(i, r.choice("ab"), day(r.randrange(400)) if r.random() < 0.95 else None) for i in range(200)]
    spans = [(j, r.choice("abc"), day(a := r.randrange(-100, 500)), day(a + r.choice([-1, 0, 3, 90, 5000]))) for j in range(60)]
    e = spark.createDataFrame(events, "i int, k string, day date")
    s = spark.createDataFrame([*spans, (99, "a", None, day(3))], "j int, k string, first_day date, last_day date")
    want = {(i, j) for i, k, d in events for j, q, a, b in spans if d and k == q and a <= d <= b}
    assert sorted((x.i, x.j) for x in joins.within_spans(e, s, ["k"], bins=bins).collect()) == sorted(want)
    assert {x.i for x in joins.within_spans(e, s, ["k"], kind="left_semi", bins=bins).collect()} == {i for i, _ in want}
    assert {x.i for x in joins.within_spans(e, s, ["k"], kind="left_anti", bins=bins).collect()} == {i for i, _, _ in events} - {i for i, _ in want}
    assert joins.within_spans(e.limit(0), s, ["k"]).count() == 0
