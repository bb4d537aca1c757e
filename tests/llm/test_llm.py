"""The operators against brute force, libraries and odd rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import chat_format, class_lm, decontaminate, language_id, near_dedup, pieces, queries, suffix_dedup, token_counts, topk_search, toxicity  # noqa: E402
from tallyspark.llm._common import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, t string, key string, spans string, n int"


def docs_of(spark, texts, first=0):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "w", 5) for i, t in enumerate(texts, first)], DOCS)


def odd(spark):
    """Null, empty and repeated rows, a null id."""
    rows = [(0, None), (1, ""), (2, "a b c " * 80), (2, "a b c " * 80), (None, "a b c " * 80), (3, "  \t\n"), (4, "é日本🎉 x\u0000y"), (5, "w" * 3000)]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "w", 5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.queries()[name], queries.SQL[name])


def test_odd_rows_and_empty_tables(spark):
    model, bpe = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("byte_bpe_50k.json")
    bench = spark.createDataFrame([(1, "a b c a b c a b c a b"), (2, None), (3, ""), (4, "é日本🎉 x")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0), (2, 1), (9, 1), (None, 0), (1, None)], "doc_id long, toxic int")
    runs = {
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "tokens": lambda d: token_counts.count_tokens(d, bpe),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "near": lambda d: near_dedup.near_duplicates(d, 2),
        "language": lambda d: language_id.identify(d, language_id.train(d)),
        "lm": lambda d: class_lm.class_lm(d),
        "pieces": lambda d: pieces.piece_digests(d, model),
        "suffix": lambda d: suffix_dedup.substring_digests(d),
        "removed": lambda d: suffix_dedup.remove_repeats(d),
        "clean": lambda d: decontaminate.clean(d, bench),
        "spans": lambda d: decontaminate.clean(d, bench, mode="spans"),
    }
    got = {k: f(odd(spark)).collect() for k, f in runs.items()}
    for k in ("decontaminate", "tokens", "toxicity", "near", "language", "lm", "pieces", "suffix", "spans"):
        assert len(got[k]) == 8, k
    for k, f in runs.items():
        assert f(docs_of(spark, []).limit(0)).collect() == [], k
    hit = {(r.doc_id, r.n_words): r for r in got["decontaminate"]}
    assert hit[2, 240].n_hit == 239 and hit[None, 240].n_items == 1 and hit[4, 3].contaminated and not hit[0, 0].contaminated
    assert hit[0, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert {(r.doc_id, r.n_tokens) for r in got["tokens"]} >= {(0, 0), (1, 0)}
    near = {r.doc_id: r for r in got["near"]}
    assert near[None].component_id is None and near[0].n_shingles == 0 and near[3].component_id == 3 and near[2].kept
    assert {r.doc_id: r.lang_pred for r in got["language"]}[3] == "und"
    gone = Counter((r.doc_id, r.n_removed) for r in got["suffix"])
    assert gone[2, 480] == 2 and gone[None, 480] == 1 and gone[5, 3000] == 1 and gone[1, 0] == 1
    assert {r.doc_id for r in got["removed"]} == {0, 1, 3, 4} and {r.doc_id for r in got["clean"]} == {0, 1, 3, 5}


def test_cut_spans_leave_the_separators(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    got = decontaminate.clean(docs_of(spark, ["A: One, TWO! three", None]), bench, mode="spans").orderBy("doc_id").collect()
    assert [r.text for r in got] == ["A: , ! three", None] and got[0].hits == "x"


def test_token_counts_equal_the_library_and_use_the_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    path, r = queries.tokenizer("byte_bpe_50k.json"), random.Random(2)
    texts = ["<|endoftext|> a<|endoftext|>", "it's  we'LL 12345  x y z", "​́é" * 9, "a" * 700] + ["".join(r.choice(" ab'stABé日١\n\t\r\x1c\u0085.,!-") for _ in range(60)) for _ in range(150)]
    lib, cache = Tokenizer.from_file(path), str(tmp_path / "cache")
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for n in (len(texts) - 1, len(texts)):
        d = docs_of(spark, texts).where(F.col("doc_id") < n)
        assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(d, path, cache).collect()} == {i: w for i, w in want.items() if i < n}
        assert spark.read.parquet(cache).count() == len(set(texts[:n]))  # each text once, only the new one appended


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, (400, 9))
    v[60:90] = v[60]  # ties
    bad = [(1000, None), (1001, [float("nan")] * 9), (1002, [None] + [1.0] * 8), (1003, [float("inf")] * 9), (None, [1.0] * 9), (1050, [2.0, 3.0]), (0, v[0].tolist())]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk_search.top_k(d, 5, 20, query_block=7, block=64).collect()
    w = np.floor(v * 256)
    for q in range(0, 400, 20):
        s = w @ w[q]
        want = sorted((-int(s[i]), i) for i in range(400) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_toxicity_is_found_through_disguises(spark, sf_dir):
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    lexicon = {"clown": 3.0, "idiot": 3.0, "achlich*": 3.0}
    model = (lexicon, frozenset({"not idiot"}), np.array([-4.0, 3.0, 0.5]))
    texts = ["you are an idiot and a clown", "you 1d10t and cl0wn", "you c1own, id!ot", "іdіot clоwn", "achlichung achlichst", "not idiot at all", "clowns in 100 towns", ""]
    got = [r.weight for r in toxicity.score(docs_of(spark, texts), model).orderBy("doc_id").collect()]
    assert got == [6.0, 6.0, 6.0, 6.0, 6.0, 0.0, 0.0, 0.0]
    fitted = toxicity.train(docs, labels)
    assert 0 <= toxicity.score(docs, fitted).agg(F.min("score")).first()[0]


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    tox = queries.op4_toxicity(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (tox.predicted == tox.toxic).mean() > 0.9
    lang = queries.op7_language_id(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang.lang_pred == lang.lang).mean() > 0.97


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "a\\\\#<:\n", "", "### user:\n", "é🎉"]
    rows = [(c, i, r, t, "k") for c in (1, 2) for i, t in enumerate(said) for r in ("user", "assistant")] + [(3, 0, None, None, "k"), (None, 0, "assistant", "x", "k")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(5)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(chat_format.canonical_turns(d))).collect()}
    for c in (1, 2):
        own = sorted((i, f"{r}\n{t}") for k, i, r, t, _ in rows if k == c)
        assert got[c].turns_sha256 == hashlib.sha256("".join(x + "\n" for _, x in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest() and got[c].loss_chars == len("".join(said))
    assert got[3].n_turns == 1 and got[None].loss_chars == 1
    assert chat_format.read_back(chat_format.format_turns(chat_format.canonical_turns(d.limit(0)))).count() == 0


def test_layouts_have_fingerprints(spark):
    recs = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
            {"prompt": "q", "completion": "a"}, {"instruction": "q", "input": None, "output": "a"}, {"other": 1}, [1]]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)] + [(9, None), (8, "{")], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat_format.canonical_json(d, "record").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(4)) and all(got[i][0][0] == "unknown" for i in (4, 5, 8, 9))
    typed = spark.createDataFrame([(1, "q", "a"), (2, "q", None)], "conv_id long, prompt string, response string")
    assert [(r.conv_id, r.role) for r in chat_format.canonical_turns(typed).orderBy("conv_id", "turn").collect()] == [(1, "user"), (1, "assistant"), (2, "user")]
    with pytest.raises(ValueError):
        chat_format.canonical_turns(typed.select("conv_id", "prompt"))


def test_hostile_records_and_extra_fields(spark):
    deep, base = "[" * 100_000 + "]" * 100_000, '{"role": "user", "text": "t", "turn": %s}'
    bad = ['{"messages": ' + deep + "}", base % '"abc"', base % "1e999", base % "99999999999999999999", '{"prompt": "\\ud800", "completion": "x"}', base % "2"]
    d = spark.createDataFrame(list(enumerate(bad)), "conv_id long, record string")
    got = {r.conv_id: (r.turn, r.role, r.text) for r in chat_format.canonical_json(d, "record").collect()}
    assert got[5] == (2, "user", "t") and all(got[i] == (-1, "unknown", bad[i]) for i in range(5))
    more = '{"messages": [{"role": "user", "content": "q", "name": "n"}], "input": "x"}'
    assert [(r.role, r.text) for r in chat_format.canonical_json(spark.createDataFrame([(1, more)], "conv_id long, record string"), "record").collect()] == [("user", "q")]
    typed = spark.createDataFrame([(1, [("user", "q", "n")], "x")], "conv_id long, messages array<struct<role:string,content:string,name:string>>, input string")
    assert [(r.role, r.text) for r in chat_format.canonical_turns(typed).collect()] == [("user", "q")]


def test_chat_pieces_cut_anywhere(spark):
    said = ["\\\\### Assistant: </turn> ok\\n", "\\n\\n", "", "#\\\\<:é🎉" * 9]
    d = spark.createDataFrame([(c, i, r, t) for c in (1, 2) for i, t in enumerate(said) for r in ("assistant", "user")], "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, chat_format.read_back(chat_format.format_turns(d)).collect()))
    for piece in (1, 2, 3, 7):
        assert sorted(map(tuple, chat_format.read_back(chat_format.format_turns(d, piece)).collect())) == whole
    assert whole[0][1] == 8 and whole[0][3] == sum(map(len, said))
    with pytest.raises(ValueError):
        chat_format.Reader().feed("### user:\nx</turn>\n", None)


def brute_near(texts, k, sim=0.8):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [len(s) for s in sets], comp


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 12, 40, 150, 700]))]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 14))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    texts += ["Same  text", "same text", "x", "X", ""]
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # buckets of several blocks
    n, comp = brute_near(texts, 2)
    got = near_dedup.near_duplicates(docs_of(spark, texts), 2).orderBy("doc_id").collect()
    assert [x.n_shingles for x in got] == n and [x.component_id for x in got] == comp


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(80)] + [(7, 7), (None, 3)]
    boss = {}

    def find(x):
        while boss.setdefault(x, x) != x:
            x = boss[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            boss[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in boss}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(3)
    for n, t in ((12, 64), (300, 4), (4000, 1)):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[: n * 9 // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        a, b = near_dedup.registers(x, t), near_dedup.registers(y, t)
        want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(near_dedup.estimates(a[None], b[None], np.array([n]), np.array([len(y)]))[0, 0] - want) < 0.15


def test_class_lm_base_and_gain(spark, sf_dir, sample):
    got = {r.doc_id: r for r in queries.op8_class_lm(spark, sf_dir).collect()}
    tok = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w] + ["\n"]
    c = Counter(w for i, t in sample.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in sample.items():
        w, r = tok(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(2)
    kind = np.r_[0, rng.integers(1, 4, 60)]
    follows = np.array([[0, 5, 1, 1], [1, 1, 9, 1], [1, 1, 1, 9], [9, 9, 1, 1]])
    pairs = rng.poisson(follows[kind][:, kind]).astype(float)

    def gain(cls):
        hot = np.eye(4)[cls]
        big = hot.T @ pairs @ hot
        f = lambda x: (x * np.log(np.maximum(x, 1e-9))).sum()
        return f(big) - f(big.sum(axis=0)) - f(big.sum(axis=1))

    cls = class_lm.exchange(pairs, 4)
    assert cls[0] == 0 and (cls[1:] > 0).all() and gain(cls) >= gain(kind) - 1e-6


def test_toxic_words_of_few_toxic_texts_are_learned(spark):
    """A word in fewer toxic than clean texts by count, but far more often by share."""
    texts = [(i, f"plain words number{i} here" + (" vile" if i < 20 else ""), 1 if i < 8 else 0) for i in range(800)]
    d = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    assert any(f.startswith("vil") for f in toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))[0])


def test_best_classes_gain_is_the_likelihood():
    """The class chosen for a word alone is the one of the largest likelihood when the table is counted anew."""
    rng = np.random.default_rng(3)
    n, m = rng.poisson(2.0, (40, 40)).astype(float), class_lm.CLASSES
    cls = np.r_[0, rng.integers(1, 6, 39)]
    table = lambda c: np.eye(m)[c].T @ n @ np.eye(m)[c]
    own = np.diag(n)
    counts = np.c_[(n - np.diag(own)) @ np.eye(m)[cls], (n - np.diag(own)).T @ np.eye(m)[cls], own]
    new = class_lm.best_classes(cls, counts, table(cls))
    for w in range(1, 40):
        by = [class_lm.likelihood(table(np.r_[cls[:w], k, cls[w + 1 :]])) for k in range(1, m)]
        assert by[new[w] - 1] == pytest.approx(max(by), abs=1e-6)


def test_class_lm_against_plain_counts(spark, monkeypatch):
    """Scores from the classes that were found, counted and summed in plain Python; most words are not held."""
    for name, n in (("TOP", 5), ("HELD", 12), ("BLOCK", 4), ("FAN", 2)):
        monkeypatch.setattr(class_lm, name, n)
    r = random.Random(9)
    texts = [" ".join(r.choice([f"n{r.randrange(9)}", f"v{r.randrange(9)}"]) + r.choice(["", "", "s"]) for _ in range(r.randrange(30))) for _ in range(60)]
    d = docs_of(spark, texts).repartition(5)
    docs = d.select(F.col("doc_id").alias("i"), F.lit(False).alias("held_out"), (F.col("doc_id") % 4 > 0).alias("learn"), F.col("text").alias("t"))
    coded = class_lm.encode(docs)
    model, held, rare, slices = class_lm.learned(coded, 6)
    assert 0 < held.top <= 12 and rare.count() > 8
    cls = dict(zip(held.wh.tolist(), held.cls.tolist(), strict=True)) | {x.wh: x.cls for x in rare.collect()} | {int(class_lm.END): 0}
    h = lambda w: int(class_lm.END) if w == "\n" else int(class_lm.word_hashes([w]).view(np.int64)[0])
    of = lambda w: cls.get(h(w), held.group_cls[class_lm.groups_of([w])[0]])
    tok = {i: [*t.split(), "\n"] for i, t in enumerate(texts)}
    learn = [t for i, t in tok.items() if i % 4]
    n = Counter(w for t in learn for w in t)
    assert len(cls) == len(n)
    big = np.zeros((6, 6))
    for t in learn:
        for a, b in zip(["\n", *t], t, strict=False):
            big[of(a), of(b)] += 1
    into = big.sum(axis=0)
    prior = (into + 1) / (into.sum() + 6)
    places = np.bincount([*cls.values(), *held.group_cls], minlength=6)
    prob = lambda a, b: (big[of(a), of(b)] + 8.0 * prior[of(b)]) / (big[of(a)].sum() + 8.0) * (n[b] + 0.5) / (into[of(b)] + 0.5 * places[of(b)])
    for x in class_lm.score_texts(slices, model).collect():
        t = tok[x.doc_id]
        assert x.score == pytest.approx(sum(math.log10(prob(a, b)) for a, b in zip(["\n", *t], t, strict=False)))
    assert np.allclose((10.0**model.move).sum(axis=1), 1)


def test_pieces_equal_the_library(spark, sample):
    import sentencepiece as spm

    path, r = queries.tokenizer("piece_bpe_32k.model"), random.Random(3)
    texts = list(sample.values())[:80] + ["".join(r.choice("ab cdeéèß \n\t▁  aabb日本🎉\x00​0123.,THE the") for _ in range(r.randrange(60))) for _ in range(600)] + ["a" * 4000, "ab" * 2000, " " * 90, "▁ x", "", "</s><unk>"]
    sp, m = spm.SentencePieceProcessor(model_file=path), pieces.pieces(path)
    want = sp.encode(texts)
    assert m.encode(texts) == want
    got = {x.doc_id: x for x in pieces.piece_digests(docs_of(spark, texts), path).collect()}
    for i, ids in enumerate(want):
        ids = [*ids, sp.eos_id()]
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    enc = pieces.encode_texts(docs_of(spark, texts), path)
    assert {x.doc_id: x.text for x in pieces.decode_ids(enc, path).collect()} == {i: sp.decode(ids) for i, ids in enumerate(want)}


def test_suffix_arrays():
    r = random.Random(5)
    for _ in range(2000):
        s = [r.randrange(1, r.choice([2, 3, 5, 9])) for _ in range(r.randrange(1, 60))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        cov = np.zeros(len(d) + 1, int)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                cov[k : k + length] = 1
        kept = bytes(b for b, c in zip(d, cov, strict=False) if not c)
        out.append((len(d), int(cov.sum()), int((np.diff(np.r_[0, cov]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [24_000, 3, 1])
def test_repeats_against_every_window(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 3: large groups are dealt by cores; 1: down to single strings
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    r = random.Random(6)
    say = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    shared = [say(n) for n in (150, 199, 200, 230, 400, 900)]
    texts = [say(r.randrange(300)) + "".join(r.choice(shared)[r.randrange(20) :] + say(r.randrange(120)) for _ in range(r.randrange(4))) for _ in range(40)]
    texts += ["ab" * 400, "x" * 450, "x" * 199, shared[4], shared[4], "", None, "z" * 200]
    got = suffix_dedup.substring_digests(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got] == brute_repeats(texts, 200)


def test_pipeline(spark, sf_dir):
    pipe = pytest.importorskip("corpus_pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    a = pipe.language(spark, docs, sf_dir)
    assert a.columns == pipe.COLUMNS and a.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    b = pipe.near_copies(spark, a, sf_dir)
    rows = {r.doc_id: r.text for r in a.collect()}
    _, comp = brute_near(list(rows.values()), 5)
    ids = list(rows)
    assert {r.doc_id for r in b.collect()} == {ids[c] for c in set(comp)}
    kept = [r for r in b.orderBy("doc_id").collect()]
    c = {r.doc_id: r.text for r in pipe.repeats(spark, b, sf_dir).collect()}
    for r, (n, gone, _, digest) in zip(kept, brute_repeats([r.text for r in kept], 200), strict=True):
        assert (r.doc_id in c) == (n > gone or n == 0) and (r.doc_id not in c or not gone or len(c[r.doc_id].encode()) <= n - gone)
    d = pipe.benchmark(spark, b, sf_dir)
    dirty = decontaminate.decontaminate(b, queries.table(spark, sf_dir, "benchmark")).where("contaminated")
    assert d.count() == b.count() - dirty.count() and dirty.count() > 0
    out = pipe.run(spark, sf_dir)
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256"} and 0 < out.count() <= len(kept)


def test_decontamination_by_shuffle_is_the_same(spark, monkeypatch):
    """Beyond the bound of the broadcast, and with a text of many words, repeated rows and short items."""
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 12, 30])))) for i in range(40)], "item_id long, text string")
    items = {x.item_id: x.text for x in bench.collect()}
    texts = [" ".join(r.choice([*vocab, *items.values()]) for _ in range(n)) for n in (0, 1, 40, 200, 6_000)] + ["!W1,w2;" * 30, None]
    d = docs_of(spark, texts).unionByName(docs_of(spark, texts[2:3], 2))
    one = sorted(map(tuple, decontaminate.decontaminate(d, bench).drop("items").collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    two = sorted(map(tuple, decontaminate.decontaminate(d, bench).drop("items").collect()))
    assert one == two and len(one) == 8 and one[5][1] > 6_000
    assert {x.doc_id for x in decontaminate.clean(d, bench).collect()} == {x[0] for x in one if not x[5]}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Repeated rows, null ids and texts, no labels, and an empty table."""
    pipe = pytest.importorskip("corpus_pipeline")
    long = "".join(random.Random(i).choice("abcdefgh ") for i in range(900))
    rows = [(1, long, None), (1, long, None), (None, "y" + long[::-1], None), (None, "y" + long[::-1], None), (2, None, "en"), (3, "123 ²³ ½", "en"), (4, "", None), (5, "five words are in here", None)]
    d = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], ", ".join(f"{c} {k}" for c, k in zip(pipe.COLUMNS, ("long", "string", "string", "string", "long"), strict=True)))
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, docs in ((3, d), (0, d.limit(0))):
        docs.write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        a = pipe.language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert a.count() == (5 if n else 0)
        out = pipe.run(spark, str(tmp_path)).collect()
        assert sorted(str(r.doc_id) for r in out) == ["1", "5", "None"][: n or 0] and (not n or all(r.n_tokens > 3 for r in out))


def test_language_kernel_is_the_blended_one():
    """Kernel values and the ridge solution against sets and a plain solve."""
    texts = ["the cat sat on the mat", "der Hund läuft im Wald", "THE dog 1 2", "ein Wald"]

    def grams(t):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {t} ".encode())
        return [{b[i : i + n] for i in range(len(b) - n + 1)} for n in (1, 2, 3)]

    want = [[sum(len(a & b) / math.sqrt(len(a) * len(b)) for a, b in zip(grams(x), grams(y), strict=True)) / 3 for y in texts] for x in texts]
    g = language_id.Grams()
    marks = language_id.Landmarks([np.concatenate(g.of(t)) for t in texts])
    got = marks.kernel(texts, g, marks.columns())
    assert np.allclose(got, want, atol=1e-6)
    w, langs = language_id.fit(got, got, ["en", "de", "en", "de"], 0.3)
    assert [langs[k] for k in (got @ w[:-1] + w[-1]).argmax(axis=1)] == ["en", "de", "en", "de"]
    # kernel ridge on all landmarks: z z' is the kernel, with an intercept that is shrunk like the rest
    y = np.array([[-1.0, 1.0], [1.0, -1.0]] * 2)
    k = np.array(want) + 1
    assert np.allclose(got @ w[:-1] + w[-1], k @ np.linalg.solve(k + 0.3 * np.eye(4), y), atol=1e-3)


def test_texts_without_letters_and_languages_without_labels(spark):
    d = spark.createDataFrame([(0, "²³ ½", "en"), (1, "a b c", "en"), (2, "d e f", "de"), (3, "ªº", "en"), (None, "x", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(d, language_id.train(d)).collect()}
    assert got[0] == "und" and {got[1], got[2], got[None]} <= {"en", "de"} and got[3] != "und"
    none = {r.doc_id: r.lang_pred for r in language_id.identify(d, language_id.train(d.withColumn("lang", F.lit(None).cast("string")))).collect()}
    assert none[0] == "und" and none[1] is None


def test_toxic_matches_against_plain_search():
    r = random.Random(5)
    lexicon = {"bad": 1.0, "ill*": 2.0, "vile": 4.0}
    found_by = toxicity.automaton(lexicon)
    for _ in range(300):
        f = toxicity.fold(" ".join(r.choice(["bad", "b4d", "badly", "illness", "1ll", "il", "vile", "v1le", "vi1e", "x", "ßad", "é"]) for _ in range(12)))
        want = sorted((m.start(), p) for p in lexicon for m in re.finditer(r"(?<![^\W\d_])" + p.rstrip("*") + ("" if p[-1] == "*" else r"(?![^\W\d_])"), f))
        got = [(s, p) for s, p in toxicity.matches(f, found_by) if f.startswith(p.rstrip("*"), s)]
        assert sorted(got) == want
        assert toxicity.measure(f, lexicon, frozenset(), want) == (sum(lexicon[p] for _, p in want), 12.0)


def test_long_texts(spark):
    """Hundreds of thousands of characters of one letter, of spaces, of words, of other scripts (megabytes are in test_faults): whole, and in time that grows with them."""
    import sentencepiece as spm
    from tokenizers import Tokenizer

    model, bpe, r = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("byte_bpe_50k.json"), random.Random(7)
    n = 300_000
    texts = ["a" * n, " " * n, "".join(r.choice("abcdefghij") for _ in range(n)), "word " * (n // 5), "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n // 3))]
    d = docs_of(spark, texts).repartition(5)
    sp, lib = spm.SentencePieceProcessor(model_file=model), Tokenizer.from_file(bpe)
    for x in pieces.piece_digests(d, model).collect():
        ids = [*sp.encode(texts[x.doc_id]), sp.eos_id()]
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    for x in token_counts.count_tokens(d, bpe).collect():
        assert x.n_tokens == len(lib.encode(texts[x.doc_id], add_special_tokens=False).ids)
    assert {x.doc_id: x.n_removed for x in suffix_dedup.substring_digests(d.where("doc_id in (0, 3)")).collect()} == {0: n, 3: n}
    assert near_dedup.near_duplicates(d, 5).count() == 5 and class_lm.class_lm(d).count() == 5
    assert {x.doc_id: x.lang_pred for x in language_id.identify(d, language_id.train(d)).collect()}[1] == "und"
    bench = spark.createDataFrame([(1, "word " * 10)], "item_id long, text string")
    assert {x.doc_id: x.n_hit for x in decontaminate.decontaminate(d, bench).collect()} == {0: 0, 1: 0, 2: 0, 3: n // 5, 4: 0}
    turns = d.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    assert {x.conv_id: x.formatted_chars for x in chat_format.read_back(chat_format.format_turns(turns)).collect()} == {i: len(t) + 19 for i, t in enumerate(texts)}


def test_one_digest_is_encoded_once(spark, tmp_path):
    d = docs_of(spark, ["same text"]).select("doc_id", "text").crossJoin(spark.range(700)).drop("id").repartition(7)
    assert token_counts.count_tokens(d, queries.tokenizer("byte_bpe_50k.json"), str(tmp_path / "c")).count() == 700
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_pivots_eliminate_on_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 400, (40, 16))
    v = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 8, (8000, 16)))
    norm2 = float((v * v).sum(axis=1).max())
    pivots = topk_search._spread(topk_search.longer(v[:2000], norm2), 32)
    ids, q = np.arange(8000), v[:60]
    seen: list[int] = []
    got = list(topk_search.search_block(ids[:60], q, topk_search.distances(q, norm2, pivots, query=True), ids, v, topk_search.distances(v, norm2, pivots), norm2, 5, seen=seen))
    for i in range(60):
        s = v @ q[i]
        assert [(b, c) for a, b, c in got if a == i] == [(int(j), int(s[j])) for j in sorted(set(range(8000)) - {i}, key=lambda j: (-s[j], j))[:5]]
    assert sum(seen) < 0.5 * 60 * 8000


def test_top_k_of_no_rows_and_of_huge_components(spark):
    d = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [1e18, 3.0]), (50, [1.0, 1e308])], "vec_id long, embedding array<double>")
    assert topk_search.top_k(d.limit(0)).count() == 0
    got = sorted(map(tuple, topk_search.top_k(d).collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == (1 << 63) - 1
