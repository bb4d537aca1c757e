"""Toxicity by a weighted lexicon.

Words and word beginnings that labelled toxic documents hold far more often
than others become the lexicon; an Aho-Corasick automaton finds them in texts
whose homoglyphs and digit substitutions are folded. Hits inside learned
exception phrases do not count, the sum is set against the text's length, and
a logistic curve turns it into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_sample, small_batches, written

# Letters of other scripts that look like a Latin letter, and signs that stand for a letter inside a word.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһкмтвнгαεορτυνικ", "aeopcyxijsdhkmtbhraeoptuvik") | {i: chr(i - 0xFEE0) for i in range(0xFF10, 0xFF5B)} | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], None)
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
MIXED = re.compile(r"(?<![^\W_])[@$]?[^\W_]*[0134578@$!|](?=[^\W_])[^\W_@$!|]*(?:[@$!|](?=[^\W_])[^\W_]*)*")
HAS_SIGN = re.compile(r"[0134578@$!|]")
HAS_LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)


def fold(text: str) -> str:
    """Lower case, look-alike letters and digits in words replaced; the length may change only by invisible characters."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(HOMOGLYPHS)
    if HAS_SIGN.search(t):
        t = MIXED.sub(lambda m: m[0].translate(SIGNS) if HAS_LETTER.search(m[0]) else m[0], t)
    return t


def features(folded: str) -> set[str]:
    """Distinct words of a text, and their beginnings, marked with a star."""
    words = set(WORD.findall(folded))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def automaton(patterns):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in patterns:
        key = p.rstrip("*")
        for k in {key, key.replace("l", "i")}:  # the digit one stands for either letter
            a.add_word(k, (*(a.get(k) if k in a else ()), p))
    if len(a):
        a.make_automaton()
    return a


def matches(folded: str, found_by) -> list[tuple[int, str]]:
    """(start, pattern) of every hit of an automaton: a word's beginning, and its end too unless the pattern is starred."""
    if not len(found_by) or not folded:
        return []
    out, last = [], len(folded)
    for end, found in found_by.iter(folded):
        for p in found:
            start = end + 1 - len(p.rstrip("*"))
            if (start == 0 or not folded[start - 1].isalpha()) and (p[-1] == "*" or end + 1 == last or not folded[end + 1].isalpha()):
                out.append((start, p))
    return out


def phrase(folded: str, start: int) -> str:
    """The word at ``start`` with the one before it, as exceptions are kept."""
    before = WORD.findall(folded[max(0, start - 60) : start])
    return f"{before[-1] if before else ''} {WORD.match(folded, start)[0]}"


def measure(folded: str, lexicon: dict[str, float], exceptions: frozenset, found: list[tuple[int, str]]) -> tuple[float, float]:
    """Sum of the weights of the hits ``found``, and the text's length in words."""
    total = sum(lexicon[p] for s, p in found if not exceptions or phrase(folded, s) not in exceptions)
    return total, 1.0 + folded.count(" ") + folded.count("\n")


def inputs(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the curve is fitted on: the sum, and the sum for the length."""
    return np.stack([np.ones_like(total), np.log1p(total), np.log1p(total / np.sqrt(length))], axis=1)


def choose(one: Counter, zero: Counter, n1: int, n0: int, most: int = 400) -> dict[str, float]:
    """Weights of the features that speak for label 1 beyond doubt; of a word and its beginnings, the strongest."""
    best = []
    for f, a in one.items():
        b = zero.get(f, 0)
        if a < 4 or a * n0 < 6 * b * n1:
            continue
        p = (a + b) / (n1 + n0)
        part = lambda k, n: (k * np.log(k / (n * p)) if k else 0.0) + ((n - k) * np.log((n - k) / (n * (1 - p))) if n > k else 0.0)
        g = 2 * (part(a, n1) + part(b, n0))
        best.append((g, not f.endswith("*"), len(f), f, float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))))
    best.sort(reverse=True)
    out: dict[str, float] = {}
    for g, _, _, f, w in best:
        if g < max(15.0, 0.02 * best[0][0]) or len(out) >= most:
            break
        stem = f.rstrip("*")
        if not any(stem.startswith(k[:-1]) if k.endswith("*") else k == stem or f.endswith("*") and k.startswith(stem) for k in out):
            out[f] = w
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = 12_000, most: int = 400):
    """(lexicon, exceptions, curve) from about ``sample`` labelled documents at most; the lexicon holds the ``most`` strongest features.

    Equal texts count once. Labels without a document, null labels and null
    texts teach nothing. The sampled ids are few, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("y"))
    some = bounded_sample(known, sample, "_id")
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    rows = written(own.join(F.broadcast(some), "_id").withColumn("k", F.xxhash64("t")), "tox-sample")
    firsts = rows.groupBy("k").agg(F.min("_id").alias("_id"))
    rows = rows.join(firsts, ["k", "_id"], "left_semi").select("y", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[int]] = {}
        for b in small_batches(batches):
            for y, t in zip(b["y"].to_pylist(), b["t"].to_pylist(), strict=True):
                for f in {"", *features(fold(t))}:
                    got.setdefault(f, [0, 0])[1 if y else 0] += 1
        k = list(got)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([got[x][1] for x in k], pa.int64()), pa.array([got[x][0] for x in k], pa.int64())], ["f", "one", "zero"])

    table = written(rows.mapInArrow(count, "f string, one long, zero long").groupBy("f").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")), "tox-features")
    first = table.where("f = ''").first()
    sizes = (first["one"], first["zero"]) if first else (0, 0)
    # by the test of choose(), so that it sees every feature it could take
    table = table.where((F.col("f") != "") & (F.col("one") >= 4) & (F.col("one") * sizes[1] >= 6 * F.col("zero") * sizes[0])).collect()  # of a bounded sample
    one, zero = ({r["f"]: r[c] for r in table} for c in ("one", "zero"))
    lexicon = choose(Counter(one), Counter(zero), *sizes, most) if min(sizes) else {}

    def apply(exceptions: frozenset, with_phrases: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found_by = automaton(lexicon)
            for b in small_batches(batches):
                ys, totals, lens, phrases = [], [], [], []
                for y, t in zip(b["y"].to_pylist(), b["t"].to_pylist(), strict=True):
                    f = fold(t)
                    found = matches(f, found_by)
                    total, n = measure(f, lexicon, exceptions, found)
                    ys.append(y)
                    totals.append(total)
                    lens.append(n)
                    phrases.append(sorted({phrase(f, s) for s, _ in found}) if with_phrases else [])
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(totals, pa.float64()), pa.array(lens, pa.float64()), pa.array(phrases, pa.list_(pa.string()))], ["y", "total", "n", "phrases"])

        return rows.mapInArrow(run, "y int, total double, n double, phrases array<string>")

    seen = apply(frozenset(), True).select("y", F.explode("phrases").alias("p")).groupBy("p").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("one"), F.count("*").alias("all"))
    exceptions = frozenset(r["p"] for r in seen.where("one = 0 and all >= 3").collect())
    fitted = apply(exceptions, False).select("y", "total", "n").collect()
    y, total, n = (np.array([r[c] for r in fitted], float) for c in ("y", "total", "n"))
    return lexicon, exceptions, logistic(inputs(total, n), (y > 0).astype(float))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def score(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """One row per document row: doc_id, score, predicted, and ``weight``, the sum of the counted lexicon hits.

    An empty or null text has no hits and gets the score of none. Rows are
    scored each by itself, so repeated rows and null ids are rows like any other.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, exceptions, curve = sent.value
        found_by = automaton(lexicon)
        for b in small_batches(batches):
            got = [measure(f, lexicon, exceptions, matches(f, found_by)) for f in (fold(t or "") for t in b["t"].to_pylist())]
            total, n = np.array([g[0] for g in got]), np.array([g[1] for g in got])
            p = 1 / (1 + np.exp(-np.clip(inputs(total, n) @ curve, -500, 500)))
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32()), pa.array(total, pa.float64())], ["doc_id", "score", "predicted", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, weight double")
