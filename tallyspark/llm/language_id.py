"""Language identification by string kernels.

The kernel of two texts is the mean, over n-gram lengths 1 to 3, of the
normalised number of n-grams that both hold (presence, not counts). Landmark
texts give a Nyström map; one ridge regression per language is fitted in it.
Scoring is a matrix product of a batch's presence rows with the landmarks:
n-grams that no landmark holds only count in a text's own norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import dealt, small_batches, written

#: Bytes as kinds: a-z (A-Z alike), one kind for all other ASCII characters, and each byte of other characters for itself.
KINDS = 155
KIND = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 101 if b >= 128 else 0 for b in range(256)], np.int32)
#: Where the numbers of n-grams of each length begin.
STARTS = (0, KINDS, KINDS + KINDS**2, KINDS + KINDS**2 + KINDS**3)
#: A landmark is a text, or of a longer one the stretch of so many characters in its middle.
MARK_CHARS = 1 << 14
#: Cells of the landmarks' matrix (4 bytes each); if there were more, the n-grams that most landmarks hold make its columns.
CELLS = 1 << 27


def middle(text: Column) -> Column:
    """What of a text is a landmark."""
    at = F.floor(F.greatest(F.char_length(text) - MARK_CHARS, F.lit(0)) / 2).cast("int")
    return F.substring(text, at + 1, F.lit(MARK_CHARS))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Grams:
    """Distinct n-grams of texts as numbers, in the order of a text; one scratch table for all."""

    def __init__(self):
        self.last = np.zeros(STARTS[3], np.int32)

    def of(self, text: str) -> list[np.ndarray]:
        """The distinct n-grams of each length of a text's UTF-8 bytes, with a space before and after."""
        k = KIND[np.frombuffer((" " + text + " ").encode("utf-8", "replace"), np.uint8)]
        out = []
        for n in (1, 2, 3):
            code = np.full(len(k) - n + 1, STARTS[n - 1], np.int32)
            for j in range(n):
                code += k[j : len(k) - n + 1 + j] * KINDS ** (n - 1 - j)
            place = np.arange(len(code), dtype=np.int32)
            self.last[code] = place
            out.append(code[self.last[code] == place])
        return out


class Landmarks:
    """Presence rows of landmark texts over their own n-grams, and kernels with them."""

    def __init__(self, grams: list[np.ndarray]):
        self.codes, held = np.unique(np.concatenate(grams), return_counts=True)
        if len(self.codes) * len(grams) > CELLS:
            self.codes = np.sort(self.codes[np.lexsort((self.codes, -held))[: CELLS // len(grams)]])
        self.rows = np.zeros((len(grams), len(self.codes)), np.float32)
        cuts = [0, *np.searchsorted(self.codes, STARTS[1:]).tolist()]
        for row, g in zip(self.rows, grams, strict=True):
            own = np.searchsorted(self.codes, g)
            row[own[(own < len(self.codes)) & (self.codes[np.minimum(own, len(self.codes) - 1)] == g)]] = 1
            for a, b, lo, hi in zip(cuts, cuts[1:], STARTS, STARTS[1:], strict=False):
                row[a:b] /= max(1.0, float(np.sqrt(((g >= lo) & (g < hi)).sum())))

    def columns(self) -> np.ndarray:
        """The column of each n-gram, or -1."""
        out = np.full(STARTS[3], -1, np.int32)
        out[self.codes] = np.arange(len(self.codes))
        return out

    def kernel(self, texts: list[str], grams: Grams, columns: np.ndarray) -> np.ndarray:
        """Kernel values of texts with all landmarks."""
        x = np.zeros((len(texts), len(self.codes)), np.float32)
        for row, text in zip(x, texts, strict=True):
            for own in grams.of(text):
                at = columns[own]
                row[at[at >= 0]] = 1 / (3 * np.sqrt(len(own)))
        return (x @ self.rows.T).astype(np.float64)


def fit(kernel: np.ndarray, among: np.ndarray, labels: list[str], ridge: float) -> tuple[np.ndarray, list[str]]:
    """Weights of the kernel values with the landmarks (a last row is the intercept), and the languages.

    ``kernel``: of each text with each landmark; ``among``: of the landmarks with one another.
    """
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    lam, u = np.linalg.eigh(among)
    ok = lam > 1e-6 * lam.max()
    nystrom = u[:, ok] / np.sqrt(lam[ok])
    z = np.hstack([kernel @ nystrom, np.ones((len(kernel), 1))])
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    # each language weighs the same, whatever its share of the sample
    weight = (1 / np.bincount(y, minlength=len(langs)))[y][:, None] * len(y) / len(langs)
    beta = np.linalg.solve(z.T @ (z * weight) + ridge * np.eye(z.shape[1]), z.T @ (target * weight))
    return np.vstack([nystrom @ beta[:-1], beta[-1:]]), langs


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = 2400, landmarks: int = 128, ridge: float = 0.3, languages: int = 1000):
    """Fit on about ``sample`` labelled documents, as many of each language (4 at least); None where there is no labelled document.

    The ``languages`` most frequent values are learned, which is more than
    there are in use; it bounds what the driver holds. Rows of one id and text
    teach once. A landmark is a text, or the middle of one of more than 16,384
    characters; values are of whole texts. What comes to the driver is the n-grams of the landmarks, and
    a row of kernel values for each document of the sample.
    """
    known = docs.where(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.col(doc_id).alias("i"), F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(doc_id, text).alias("k"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(dealt("i", "k")).alias("least")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    sizes = {r["lang"]: r["n"] for r in counts}
    if not sizes:
        return None
    each = max(4, sample // len(sizes))
    # the least number of each language is in, so that none is without a text
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 1.0 if r["n"] <= each else max(each / r["n"], float(np.nextafter(r["least"], 2))))])
    some = known.where(dealt("i", "k") < share[F.col("lang")])
    some = written(some.dropDuplicates(["i", "k"]).select("k", "lang", "t"), "lang-sample")
    rows = sorted((r["lang"], r["k"]) for r in some.select("lang", "k").collect())
    picked = [r for x in sizes for r in [y for y in rows if y[0] == x][: max(1, landmarks // len(sizes))]]
    chosen = some.where(F.col("k").isin([k for _, k in picked])).dropDuplicates(["lang", "k"]).select("lang", "k", middle(F.col("t")).alias("t"))
    texts = [r["t"] for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["k"])) if (r["lang"], r["k"]) in set(picked)]
    grams = Grams()
    marks = Landmarks([np.concatenate(grams.of(t)) for t in texts])
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, columns = Grams(), sent.value.columns()
        for b in small_batches(batches, 64):
            got = sent.value.kernel(b["t"].to_pylist(), own, columns)
            yield pa.RecordBatch.from_arrays([b["lang"], b["k"], pa.array([x.tobytes() for x in got], pa.binary())], ["lang", "k", "v"])

    got = sorted(some.select("k", "lang", "t").mapInArrow(values, "lang string, k long, v binary").collect(), key=lambda r: (r["lang"], r["k"], r["v"]))
    return marks, *fit(np.array([np.frombuffer(r["v"]) for r in got]), marks.kernel(texts, grams, marks.columns()), [r["lang"] for r in got], ridge)


def identify(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id", keep: bool = False) -> DataFrame:
    """Columns doc_id, lang_pred, score (with ``keep``: after all columns of ``docs``).

    ``und`` with score 0 for a text that is null or holds no letter; null with
    score 0 for any other text where no labelled document was there to learn
    from. Rows are scored each by itself: repeated rows and null ids give rows
    like any other.
    """
    own = docs.columns if keep else [doc_id]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = sent.value, Grams()
        columns = m[0].columns() if m else None
        for b in small_batches(batches, 64):
            texts, letters = b["_t"].to_pylist(), b["_has"].to_pylist()
            pred, score = [None if x else "und" for x in letters], [0.0] * len(texts)
            at = [i for i, x in enumerate(letters) if x] if m else []
            if at:
                marks, w, langs = m
                raw = marks.kernel([texts[i] for i in at], grams, columns) @ w[:-1] + w[-1]
                e = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
                e /= e.sum(axis=1, keepdims=True)
                for i, k, p in zip(at, raw.argmax(axis=1), e.max(axis=1), strict=True):
                    pred[i], score[i] = langs[k], float(p)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*own, "lang_pred", "score"])

    fields = [StructField(c, docs.schema[c].dataType) for c in own]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*own, F.col(text).alias("_t"), has_letter(F.col(text)).alias("_has")).mapInArrow(run, schema)
