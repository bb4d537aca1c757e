"""Importance resampling towards a target distribution, by hashed n-grams.

Texts are lower-cased (A-Z), every run of separators becomes one space, and an
overlapped scan with boundary lookarounds gives the span of every run of words;
the bytes of a span are counted by their CRC in a bucket. The gain of a bucket
is the log ratio of its smoothed shares in the target and in the corpus; a
document's weight is its features' mean gain, and Gumbel noise from its id
makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ._common import forget, small_batches, written

#: What each byte becomes: A-Z in lower case, other ASCII characters but letters and digits a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in string.ascii_lowercase + string.digits else 32 for b in range(256))
#: A bucket and how often it occurs.
CELL = np.dtype([("bucket", "<u4"), ("n", "<u8")])


def span_pattern(n: int):
    """Spans of n words of a collapsed text; overlapped, so that each word begins one."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}+" % (n - 1))


class Counter:
    """Bucket counts of texts, as cells in the order of the buckets."""

    def __init__(self, n: int, buckets: int):
        self.patterns, self.buckets = [span_pattern(k) for k in range(1, n + 1)], buckets

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        """How many words a text has, and its cells: no more than there are buckets, however long it is."""
        flat = b" ".join(text.translate(FOLD).split())
        words, found = (flat.count(b" ") + 1 if flat else 0), np.zeros(0, CELL)
        crc, at = zlib.crc32, []
        for p in self.patterns:
            for m in p.finditer(flat, overlapped=True):
                at.append(crc(m.group()))
                if len(at) >= 1 << 20:
                    found, at = self._with(found, at), []
        return words, self._with(found, at)

    def _with(self, found: np.ndarray, at: list[int]) -> np.ndarray:
        bucket, n = np.unique(np.array(at, np.uint64) % np.uint64(self.buckets), return_counts=True)
        more = np.empty(len(bucket), CELL)
        more["bucket"], more["n"] = bucket, n
        return added(found, more, self.buckets) if len(found) else more


def added(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    sums = np.zeros(buckets, np.uint64)
    sums[a["bucket"]] += a["n"]
    sums[b["bucket"]] += b["n"]
    out = np.empty(np.count_nonzero(sums), CELL)
    out["bucket"] = np.flatnonzero(sums)
    out["n"] = sums[out["bucket"]]
    return out


def features(docs: DataFrame, n: int, buckets: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, n_words, n_features and the bucket cells of every text."""
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("cells", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(n, buckets)
        for b in small_batches(batches):
            got = [count.of(t.as_py()) for t in b["t"]]
            sizes = [int(c["n"].sum()) for _, c in got]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([w for w, _ in got], pa.int64()), pa.array(sizes, pa.int64()), pa.array([c.tobytes() for _, c in got], pa.binary())], ["doc_id", "n_words", "n_features", "cells"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, schema)


def totals(cells: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows; a task sends one row a bucket, the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for c in b["cells"]:
                own = np.frombuffer(c.as_py(), CELL)
                sums[own["bucket"]] += own["n"].astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in cells.select("cells").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    k = len(corpus)
    all_s, all_t = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the mean gain of a document's features, rounded down; 0 without features."""
    schema = StructType([*rows.schema.fields[:3], StructField("weight", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = []
            for c, n in zip(b["cells"], b["n_features"].to_pylist(), strict=True):
                own = np.frombuffer(c.as_py(), CELL)
                w.append(int((gain[own["bucket"]] * own["n"].astype(np.int64)).sum()) // n if n else 0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_words"], b["n_features"], pa.array(w, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10000, percent: int = 10, min_words: int = 20, seed: int = 2024, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_features, weight, score, rank.

    Features are all runs of 1 to ``n`` words of whole texts, repeats counted.
    Of the documents with at least ``min_words`` words, ``percent`` in a hundred
    are drawn, rounded down: the highest scores, ties to the smaller id, ranked
    from 1; the others have a null rank. A null or empty text has no features
    and weight 0. A null id counts as an empty one in the noise, and stands
    last among ties. Rows that repeat an id have the same noise; equal rows get
    ranks one after the other. An empty table gives an empty table, an empty
    target the gains of an empty target.

    Texts are scanned once: the bucket cells of each document are written, and
    counted and weighed from there. Scores are whole numbers of a bounded
    range, so ranks come from their histogram (some 100,000 rows at most,
    whatever the corpus) and an order within one score.
    """
    rows = written(features(docs, n, buckets, text, doc_id), "features")
    gain = gains(totals(rows, buckets), totals(features(target.withColumn("_id", F.lit(0)), n, buckets, target_text, "_id"), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed(rows, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    forget(rows)
    enough = scored.where(F.col("n_words") >= min_words)
    drawn = enough.count() * percent // 100
    # a row a score, of which there is a bounded number
    over = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = enough.groupBy("score").agg(F.count("*").alias("n")).withColumn("over", over).where(F.col("over") < drawn).select("score", "over")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())) + F.col("over")
    top = enough.join(F.broadcast(hist), "score").withColumn("rank", place.cast("long"))
    rest = scored.join(F.broadcast(hist.select("score", F.lit(True).alias("_in"))), "score", "left").where(F.col("_in").isNull() | (F.col("n_words") < min_words)).withColumn("rank", F.lit(None).cast("long"))
    cols = ["doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")]
    return top.select(*cols).unionByName(rest.select(*cols))
