"""A Brown class-based bigram model, and the add-one unigram base beside it.

Texts are split once, into written slices of word numbers; word counts over all
training texts are a Spark aggregation by word hash. The most frequent words,
and groups of all other words by their ending, only give every word its first
class. Then all words are exchanged: a round counts the classes beside each
word over all training texts, and each word goes where the likelihood of the
class bigrams is largest. Class transitions and word emissions give the score.
A slice of documents sends its distinct rare words once, with what it counted
beside them, and gets their counts and classes back, packed; what is kept of it
for the score is the class of each token and sums of each text.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, remainder, sweep, written
from .shingles import coded, split_words, word_hashes

#: Words with a first class of their own, groups that give all others theirs (and unseen words their only one), classes, and the most words whose counts and classes every task holds.
TOP, GROUPS, CLASSES, HELD = 512, 255, 48, 100_000
#: The end of a text, which no word can be.
END = np.array([xxhash.xxh3_64_intdigest("\n")], np.uint64).view(np.int64)[0]
DELTA, ALPHA = 0.5, 8.0
#: Exchange ends with the round that gains fewer nats a token than this.
SETTLED = 0.002
#: Held words whose counts (classes after it, classes before it, itself after itself) travel together, and rows that are added up by one task.
BLOCK, FAN = 256, 256
#: Answers to slices that a task gathers before it packs them.
ASKED = 1_000_000


def groups_of(words: list[str]) -> np.ndarray:
    """The group of each word: its last two characters, hashed."""
    h = xxhash.xxh32_intdigest
    return np.fromiter((h(w[-2:]) % GROUPS for w in words), np.int64, len(words))


def slices(batches, most_rows: int = 2048, most_bytes: int = 8 << 20):
    """Runs of a batch's rows of bounded number and text size; a longer text is a slice of its own."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b["t"]), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, s in enumerate(size):
            if i > at and (i - at >= most_rows or held + s > most_bytes):
                yield b.slice(at, i - at)
                at, held = i, 0
            held += s
        if b.num_rows > at:
            yield b.slice(at)


def packed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def numbers(b: bytes, size: int, kind: type = np.uint32) -> np.ndarray:
    """What ``packed`` has packed: the places of words in their slice's list, or numbers of another kind."""
    return np.frombuffer(pa.decompress(b, decompressed_size=np.dtype(kind).itemsize * size, codec="zstd", asbytes=True), kind).astype(np.int64) if size else np.empty(0, np.int64)


def encode(docs: DataFrame) -> DataFrame:
    """A row for each slice of ``docs`` (columns i, held_out, learn, t): its distinct words, with the end of a text first, and its texts as places in that list."""
    kind = docs.schema["i"].dataType.simpleString()
    shape = f"key long, words array<long>, grp array<int>, n array<long>, ids array<{kind}>, held array<boolean>, learn array<boolean>, sizes array<long>, seq binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat, counts = split_words(b["t"])
            idx, words = coded(flat)
            # frequent words have small numbers, which pack well
            order = np.argsort(-np.bincount(idx, minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(1, len(words) + 1)
            seq, _ = with_ends(place[idx], counts)
            learn = np.repeat(b["learn"].to_numpy(zero_copy_only=False).astype(bool), counts + 1)
            n = np.bincount(seq[learn], minlength=len(words) + 1)
            one = lambda v, t: pa.array([v], pa.list_(t))
            cols = [
                pa.array([int.from_bytes(os.urandom(8), "little", signed=True)]), one(np.r_[END, word_hashes(words).view(np.int64)[order]], pa.int64()), one(np.r_[-1, groups_of(words)[order]].astype(np.int32), pa.int32()), one(n, pa.int64()),
                *(pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b[c]) for c in ("i", "held_out", "learn")), one(counts + 1, pa.int64()), pa.array([packed(seq.astype(np.uint32))], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["key", "words", "grp", "n", "ids", "held", "learn", "sizes", "seq"])

    return written(docs.select("i", "held_out", "learn", "t").mapInArrow(run, shape), "lm-slices")


def count_words(coded_docs: DataFrame) -> DataFrame:
    """Columns wh, grp, n of all words of the texts that teach; each text adds one end, whose group is -1."""
    rows = coded_docs.select(F.explode(F.arrays_zip("words", "grp", "n")).alias("w")).select("w.*").where("n > 0")
    return rows.groupBy(F.col("words").alias("wh")).agg(F.first("grp").alias("grp"), F.sum("n").alias("n"))


class Held:
    """Counts and classes of the words that every task holds, and the classes of groups."""

    def __init__(self, wh: np.ndarray, n: np.ndarray, cls: np.ndarray, group_cls: np.ndarray, classes: int):
        self.wh, self.n, self.cls, self.group_cls, self.classes, self.top = wh, n, cls, group_cls, classes, len(wh)

    def with_classes(self, cls: np.ndarray) -> Held:
        return Held(self.wh, self.n, cls, self.group_cls, self.classes)

    def of(self, wh: np.ndarray) -> np.ndarray:
        """The place of each word among those held, or -1."""
        if not self.top:
            return np.full(len(wh), -1, np.int64)
        at = np.minimum(np.searchsorted(self.wh, wh), self.top - 1)
        return np.where(self.wh[at] == wh, at, -1)

    def classes_of(self, words: np.ndarray, grp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and class of each word of a slice; words that are not held have their group's class, and the first is the end."""
        at = self.of(words)
        cls = self.group_cls[np.maximum(grp, 0)]
        if self.top:
            cls = np.where(at >= 0, self.cls[at], cls)
        at[0], cls[0] = -1, 0
        return at, cls


def beside(seq: np.ndarray, begin: np.ndarray, learn: np.ndarray, cls: np.ndarray):
    """Of each place that teaches: the word before it (the end, at a text's begin), its own, their classes, and whether they are equal."""
    prev = np.r_[0, seq[:-1]]
    prev[begin] = 0
    a, b = prev[learn], seq[learn]
    return a, b, cls[a], cls[b], a == b


def with_ends(unit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of all texts with an end after each, and where each text begins."""
    ends = np.cumsum(counts)
    return np.insert(unit, ends, 0), np.r_[0, ends[:-1] + np.arange(1, len(counts))] if len(counts) else ends


def count_pairs(coded_docs: DataFrame, top: np.ndarray) -> np.ndarray:
    """How often each unit follows each; a text's first word follows an end. Units are the end, the words ``top``, and the groups of all other words."""
    sent = coded_docs.sparkSession.sparkContext.broadcast(np.sort(top))
    side = 1 + len(top) + GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = sent.value
        total = np.zeros(side * side, np.int64)
        for words, grp, seq, begin, learn in each_slice(batches):
            at = np.minimum(np.searchsorted(top, words), max(len(top) - 1, 0))
            unit = np.where(top[at] == words, 1 + at, 1 + len(top) + grp) if len(top) else 1 + grp
            unit[0] = 0
            u = unit[seq]
            prev = np.r_[0, u[:-1]]
            prev[begin] = 0
            total += np.bincount((prev * side + u)[learn], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    got = coded_docs.select("words", "grp", "learn", "sizes", "seq").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(side * side, np.int64)
    out[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out.reshape(side, side)


def opened(words, grp, sizes, learn, seq):
    """Words, groups, sequence, where texts begin, and which places teach, of a slice."""
    sizes = np.asarray(sizes, np.int64)
    flat = numbers(seq, int(sizes.sum()))
    return np.asarray(words, np.int64), np.asarray(grp, np.int64), flat, np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.asarray(learn, bool), sizes)


def each_slice(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield opened(*(b[c][k].values.to_numpy(zero_copy_only=False) for c in ("words", "grp", "sizes", "learn")), b["seq"][k].as_py())


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int | None = None) -> np.ndarray:
    """Classes of units: each unit in turn goes where the likelihood of the class bigrams is largest, until none moves (or for so many rounds).

    Unit 0, the end of a text, has class 0 for itself.
    """
    n = pairs.astype(np.float64)
    own = n.sum(axis=0)
    order = [int(i) for i in np.argsort(-own, kind="stable") if i]
    cls = np.zeros(len(n), np.int64)
    for k, i in enumerate(order):
        cls[i] = 1 + k % (classes - 1)
    hot = np.eye(classes)[cls]
    big = hot.T @ n @ hot
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    least = max(1e-9, 1e-12 * f(n.sum()))
    for _ in itertools.count() if rounds is None else range(rounds):
        moved = 0
        for i in order:
            if not own[i] and not n[i].any():
                continue
            old = cls[i]
            row, col, self_ = np.bincount(cls, n[i], classes), np.bincount(cls, n[:, i], classes), n[i, i]
            row[old] -= self_
            col[old] -= self_
            big[old] -= row
            big[:, old] -= col
            big[old, old] -= self_
            fb = f(big)
            with_row, with_col = f(big + row) - fb, f(big + col[:, None]) - fb
            both = np.diag(big) + row + col + self_
            gain = with_row.sum(axis=1) - np.diag(with_row) + with_col.sum(axis=0) - np.diag(with_col) + f(both) - np.diag(fb)
            outs, ins = big.sum(axis=1) + col, big.sum(axis=0) + row
            gain -= f(outs + row.sum() + self_) - f(outs) + f(ins + col.sum() + self_) - f(ins)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + least:
                new = int(old)
            big[new] += row
            big[:, new] += col
            big[new, new] += self_
            cls[i] = new
            moved += new != old
        if not moved:
            break
    return cls


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(big: np.ndarray) -> float:
    """Of the class bigrams, in nats, without the part that no class changes."""
    return float(xlogx(big).sum() - xlogx(big.sum(axis=0)).sum() - xlogx(big.sum(axis=1)).sum())


def best_classes(cls: np.ndarray, counts: np.ndarray, big: np.ndarray) -> np.ndarray:
    """Where each word (a row of counts: classes after it, classes before it, itself after itself) goes by itself, all others staying: as a step of exchange()."""
    m, c, every = len(big), len(cls), np.arange(len(cls))
    row, col, self_ = counts[:, :m].astype(float), counts[:, m : 2 * m].astype(float), counts[:, 2 * m].astype(float)
    gain = np.zeros((c, m))
    for mine, other, table in ((row, col, big), (col, row, big.T)):
        w, k = np.nonzero(mine)
        if not len(w):
            continue
        v, base, old = mine[w, k], table[:, k].T.copy(), cls[w]
        base[np.arange(len(w)), old] -= v
        own = np.flatnonzero(k == old)
        base[own] -= other[w[own]]
        base[own, old[own]] -= self_[w[own]]
        base = np.maximum(base, 0)
        more = xlogx(base + v[:, None]) - xlogx(base)
        more[np.arange(len(w)), k] = 0
        at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[at]] += np.add.reduceat(more, at)
    diag, both = np.tile(np.diag(big), (c, 1)), row + col + self_[:, None]
    diag[every, cls] = np.maximum(diag[every, cls] - both[every, cls], 0)
    gain += xlogx(diag + both) - xlogx(diag)
    for side, add in ((big.sum(axis=1), row.sum(axis=1) + self_), (big.sum(axis=0), col.sum(axis=1) + self_)):
        rest = np.tile(side, (c, 1))
        rest[every, cls] = np.maximum(rest[every, cls] - add, 0)
        gain -= xlogx(rest + add[:, None]) - xlogx(rest)
    gain[:, 0] = -np.inf
    new = gain.argmax(axis=1)
    return np.where(gain[every, new] > gain[every, cls] + 1e-9, new, cls)


def held_from(vocab: DataFrame) -> int:
    """The least power of two such that no more than HELD words are as frequent; a histogram of a row per power tells."""
    sizes = vocab.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().orderBy(F.desc("p")).collect()
    least, held = 0, 0
    for r in sizes:
        held += r["count"]
        if held > HELD:
            break
        least = r["p"]
    return 1 << least if sizes and sizes[0]["count"] <= HELD else 1 << 62


def sparse(keys: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """A row of a block's counts: how many cells, their places and their counts, packed."""
    return [pa.array([len(keys)]), pa.array([packed(np.diff(keys, prepend=0).astype(np.uint32))]), pa.array([packed(n.astype(np.int64))])]


def add_sparse(dense: np.ndarray, size: int, keys: bytes, n: bytes) -> None:
    if size:
        raw = pa.decompress(n, decompressed_size=8 * size, codec="zstd", asbytes=True)
        dense[np.cumsum(numbers(keys, size))] += np.frombuffer(raw, np.int64)


CELLS = "block int, part int, size long, cells binary, n binary"
#: Columns of a rare word, and of an answer to a slice.
FOUND = ["wh", "n", "cls", "slice", "size", "places", "counts", "classes"]


def neighbours(coded_docs: DataFrame, held: Held) -> DataFrame:
    """Written: of each task, how often each class stands beside each held word, a row for each block of words; the block -1 is the class bigrams."""
    sent = coded_docs.sparkSession.sparkContext.broadcast(held)
    c, kinds = held.classes, 2 * held.classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = sent.value
        cells, big = np.zeros(h.top * kinds, np.int64), np.zeros(c * c, np.int64)
        for words, grp, seq, begin, learn in each_slice(batches):
            at, cls = h.classes_of(words, grp)
            a, b, ca, cb, same = beside(seq, begin, learn, cls)
            big += np.bincount(ca * c + cb, minlength=c * c)
            a, b = at[a], at[b]
            np.add.at(cells, (a * kinds + np.where(same, 2 * c, cb))[a >= 0], 1)
            np.add.at(cells, (b * kinds + c + ca)[(b >= 0) & ~same], 1)
        part = int.from_bytes(os.urandom(3), "little")
        width = BLOCK * kinds
        for block in range(-1, -(-h.top // BLOCK)):
            own = big if block < 0 else cells[block * width : (block + 1) * width]
            full = np.flatnonzero(own)
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *sparse(full, own[full])], ["block", "part", "size", "cells", "n"])

    return written(coded_docs.select("words", "grp", "learn", "sizes", "seq").mapInArrow(run, CELLS), "lm-round")


def added(rows: DataFrame, width: int, finish, schema: str) -> DataFrame:
    """``finish(block, its counts)`` for each block: tasks' rows are added up in a tree, FAN of them at a time, each task holding one block."""

    def merge(emit):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, dense = None, np.zeros(width, np.int64)
            for b in batches:
                for key, size, cells, n in zip(zip(b["block"].to_pylist(), b["part"].to_pylist(), strict=True), b["size"].to_pylist(), b["cells"].to_pylist(), b["n"].to_pylist(), strict=True):
                    if key != now:
                        if now is not None:
                            yield emit(*now, dense)
                        now = key
                        dense[:] = 0
                    add_sparse(dense, size, cells, n)
            if now is not None:
                yield emit(*now, dense)

        return run

    def again(block: int, part: int, dense: np.ndarray) -> pa.RecordBatch:
        full = np.flatnonzero(dense)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *sparse(full, dense[full])], ["block", "part", "size", "cells", "n"])

    parts = rows.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN)
        rows = rows.withColumn("part", F.pmod("part", F.lit(parts))).repartition("block", "part").sortWithinPartitions("block", "part")
        if parts == 1:
            return rows.mapInArrow(merge(lambda block, part, dense: finish(block, dense)), schema)
        rows = rows.mapInArrow(merge(again), CELLS)


def bigrams(counts: DataFrame, classes: int) -> np.ndarray:
    """The class bigrams that tasks wrote as their block -1."""

    def out(block: int, dense: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(dense)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[at])], ["at", "n"])

    got = added(counts.where("block = -1").select("block", "part", "size", "cells", "n"), classes * classes, out, "at long, n long").toPandas()  # a row for each pair of classes
    big = np.zeros(classes * classes)
    big[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return big.reshape(classes, classes)


def moved(counts: DataFrame, held: Held, big: np.ndarray) -> Held:
    """The held words after each has gone to its best class; what comes to the driver is a class for each."""
    sent = counts.sparkSession.sparkContext.broadcast((held, big))
    kinds = 2 * held.classes + 1

    def best(block: int, dense: np.ndarray) -> pa.RecordBatch:
        h, table = sent.value
        own = h.cls[block * BLOCK : (block + 1) * BLOCK]
        new = best_classes(own, dense.reshape(BLOCK, kinds)[: len(own)], table)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(own)) + block * BLOCK), pa.array(new)], ["at", "cls"])

    got = added(counts.where("block >= 0"), BLOCK * kinds, best, "at long, cls long").toPandas()
    cls = held.cls.copy()
    cls[got["at"].to_numpy(np.int64)] = got["cls"].to_numpy(np.int64)
    return held.with_classes(cls)


def rare_classes(coded_docs: DataFrame, held: Held, big: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Written: wh, n, cls of all other words of the texts that teach, each in its best class beside the held words' settled ones; and the answers to slices.

    Slices count the classes beside their own rare words (a rare neighbour has
    its group's class); a word's counts meet in the order of words, and a task
    holds those of one batch. With its counts a slice sends where the word
    stands in its list, also for words of texts that do not teach; an answer is
    a row of a slice: such places, packed, with the words' counts and classes.
    """
    spark = coded_docs.sparkSession
    sent, table = spark.sparkContext.broadcast(held), spark.sparkContext.broadcast(big)
    c, kinds = held.classes, 2 * held.classes + 1
    names = ["wh", "grp", "n", "e"]

    def rows(wh, grp, n, at, k, count) -> pa.RecordBatch:
        """``at``: of each cell, its word; ``k``, ``count``: its kind and count."""
        e = (k.astype(np.uint64) << np.uint64(48)) | count.astype(np.uint64)
        ends = np.searchsorted(at, np.arange(len(wh) + 1))
        e = pa.Array.from_buffers(pa.binary(), len(wh), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(e.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(wh, pa.int64()), pa.array(grp, pa.int32()), pa.array(n, pa.int64()), e], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, (words, grp, seq, begin, learn) in zip(batch["key"].to_pylist(), each_slice([batch]), strict=True):
                held_at, cls = sent.value.classes_of(words, grp)
                rare = held_at < 0
                rare[0] = False
                a, b, ca, cb, same = beside(seq, begin, learn, cls)
                n = np.bincount(b, minlength=len(words))
                one, two = rare[a], rare[b] & ~same
                cells, m = np.unique(np.concatenate([(a * kinds + np.where(same, 2 * c, cb))[one], (b * kinds + c + ca)[two]]), return_counts=True)
                own = np.flatnonzero(rare)
                out = rows(words[own], grp[own], n[own], np.searchsorted(own, cells // kinds), cells % kinds, m)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(own), key, np.int64)), pa.array(own.astype(np.int32))], [*names, "slice", "pos"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        asks, answers, waiting = [], [], 0

        def summed(b: pa.RecordBatch):
            wh = b["wh"].to_numpy()
            first = np.flatnonzero(np.r_[True, wh[1:] != wh[:-1]])
            word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(wh)]))
            size = pc.binary_length(b["e"]).to_numpy(zero_copy_only=False) // 8
            x = np.frombuffer(b"".join(b["e"].to_pylist()), np.uint64)
            cells, back = np.unique(np.repeat(word, size) * kinds + (x >> np.uint64(48)).astype(np.int64), return_inverse=True)
            m = np.zeros(len(cells), np.int64)
            np.add.at(m, back, (x & np.uint64((1 << 48) - 1)).astype(np.int64))
            return wh[first], b["grp"].to_numpy()[first], np.add.reduceat(b["n"].to_numpy(), first), cells, m

        def placed(wh, grp, n, cells, m) -> Iterator[pa.RecordBatch]:
            """Words with their classes; those who asked for one of them have their answer noted."""
            nonlocal asks, waiting
            # words of no text that teaches have no cells, and no class of their own
            taught = np.flatnonzero(n > 0)
            cells = np.searchsorted(taught, cells // kinds) * kinds + cells % kinds
            wh, grp, n = wh[taught], grp[taught], n[taught]
            old = sent.value.group_cls[np.maximum(grp, 0)]
            new = old.copy()
            ends = np.searchsorted(cells, np.arange(len(wh) + 1) * kinds)
            for at in range(0, len(wh), 1024):
                end = min(at + 1024, len(wh))
                dense = np.zeros((end - at) * kinds, np.int64)
                dense[cells[ends[at] : ends[end]] - at * kinds] = m[ends[at] : ends[end]]
                new[at:end] = best_classes(old[at:end], dense.reshape(-1, kinds), table.value)
            asked, key, pos = (np.concatenate(x) for x in zip(*asks, strict=True))
            asks = []
            if len(wh):
                at = np.minimum(np.searchsorted(wh, asked), len(wh) - 1)
                mine = wh[at] == asked
                answers.append((key[mine], pos[mine], n[at[mine]], new[at[mine]]))
                waiting += int(mine.sum())
                yield pa.RecordBatch.from_arrays([pa.array(wh), pa.array(n), pa.array(new, pa.int32()), *(pa.nulls(len(wh), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], FOUND)

        def told() -> Iterator[pa.RecordBatch]:
            """The answers noted, a row for each slice."""
            nonlocal waiting
            if waiting:
                key, pos, n, cls = (np.concatenate(x) for x in zip(*answers, strict=True))
                order = np.lexsort((pos, key))
                key, pos, n, cls = key[order], pos[order].astype(np.int64), n[order], cls[order].astype(np.int16)
                for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32())), pa.array(key[part[:1]]), *sparse(pos[part], n[part]), pa.array([packed(cls[part])], pa.binary())], FOUND)
            answers.clear()
            waiting = 0

        for b in batches:
            if not b.num_rows:
                continue
            asks.append(tuple(b[x].to_numpy().copy() for x in ("wh", "slice", "pos")))
            b = b.select(names)
            wh, grp, n, cells, m = summed(b if kept is None else pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0])
            # the last word may go on in the next batch
            last = len(wh) - 1
            cut = np.searchsorted(cells, last * kinds)
            kept = rows(wh[last:], grp[last:], n[last:], np.zeros(len(cells) - cut, np.int64), cells[cut:] - last * kinds, m[cut:])
            if last:
                still = [tuple(x[a[0] == wh[last]] for x in a) for a in asks]
                yield from placed(wh[:last], grp[:last], n[:last], cells[:cut], m[:cut])
                asks = [a for a in still if len(a[0])]
            if waiting >= ASKED:
                yield from told()
        if kept is not None:
            yield from placed(*summed(kept))
        yield from told()

    parts = coded_docs.select("key", "words", "grp", "learn", "sizes", "seq").mapInArrow(count, "wh long, grp int, n long, e binary, slice long, pos int")
    out = written(parts.repartition("wh").sortWithinPartitions("wh").mapInArrow(meet, "wh long, n long, cls int, slice long, size long, places binary, counts binary, classes binary"), "lm-rare")
    return out.where("slice is null").select("wh", "n", "cls"), out.where("slice is not null").select("slice", "size", "places", "counts", "classes")


def resolved(coded_docs: DataFrame, held: Held, answers: DataFrame, ends: int) -> DataFrame:
    """Written: the slices with the class of each token instead of the words, and of each text the known tokens and the sums of their logarithms; ``cells`` and the like are the slice's class bigrams.

    What travels of a slice is its tokens and, packed, the counts and classes of its held words; the answers give those of the others.
    """
    sent = coded_docs.sparkSession.sparkContext.broadcast(held)
    c = held.classes
    small = np.uint8 if c <= 256 else np.uint16
    kind = coded_docs.schema["ids"].dataType.simpleString()
    own = ["key", "ids", "held", "learn", "sizes", "seq"]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                words, grp = (b[x][r].values.to_numpy() for x in ("words", "grp"))
                at, cls = sent.value.classes_of(words, grp.astype(np.int64))
                n = np.where(at >= 0, sent.value.n[at] if sent.value.top else 0, 0)
                n[0] = ends
                yield pa.RecordBatch.from_arrays([*(b[x].slice(r, 1) for x in own), pa.array([len(words)]), pa.array([packed(n.astype(np.int64))]), pa.array([packed(cls.astype(np.int16))])], [*own, "words", "counts", "classes"])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in range(left.num_rows):
            sizes = left["sizes"][r].values.to_numpy()
            words = left["words"][r].as_py()
            n, cls = numbers(left["counts"][r].as_py(), words, np.int64), numbers(left["classes"][r].as_py(), words, np.int16)
            for size, places, counts, classes in zip(*(right[x].to_pylist() for x in ("size", "places", "counts", "classes")), strict=True):
                pos = np.cumsum(numbers(places, size))
                n[pos], cls[pos] = numbers(counts, size, np.int64), numbers(classes, size, np.int16)
            seq = numbers(left["seq"][r].as_py(), int(sizes.sum()))
            begin, learn = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(left["learn"][r].values.to_numpy(zero_copy_only=False).astype(bool), sizes)
            *_, ca, cb, _ = beside(seq, begin, learn, cls)
            big = np.bincount(ca * c + cb, minlength=c * c)
            full = np.flatnonzero(big)
            one = lambda v, t: pa.array([v], pa.list_(t))
            add = lambda x: np.add.reduceat(x[seq], begin)
            sums = [one(add((n > 0).astype(np.int64)), pa.int64()), one(add(np.log10(n + 1.0)), pa.float64()), one(add(np.log10(n + DELTA)), pa.float64())]
            cols = [*(left[x].slice(r, 1).combine_chunks() for x in ("ids", "held", "sizes")), *sums, pa.array([packed(cls.astype(small)[seq])], pa.binary()), pa.array([-1], pa.int32()), pa.array([int(left["key"][r].as_py()) & 0xFFFFFF], pa.int32()), *sparse(full, big[full])]
            out.append(pa.table(cols, ["ids", "held", "sizes", "known", "base", "own", "cls", "block", "part", "size", "cells", "n"]))
        return pa.concat_tables(out) if out else None

    shape = f"key long, ids {kind}, held array<boolean>, learn array<boolean>, sizes array<long>, seq binary, words long, counts binary, classes binary"
    rows = coded_docs.select(*own, "words", "grp").mapInArrow(narrow, shape)
    shape = f"ids {kind}, held array<boolean>, sizes array<long>, known array<long>, base array<double>, own array<double>, cls binary, {CELLS}"
    # every slice has a row on the left; an answer is to a slice
    return written(rows.groupBy("key").cogroup(answers.groupBy("slice")).applyInArrow(fill, shape), "lm-resolved")


class Model:
    """Log10 probabilities of transitions and emissions."""

    def __init__(self, held: Held, big: np.ndarray, in_class: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        into, classes = big.sum(axis=0), len(big)
        prior = (into + 1) / (into.sum() + classes)
        self.move = np.log10((big + ALPHA * prior) / (big.sum(axis=1, keepdims=True) + ALPHA))
        # a word of count n has (n + DELTA) of its class; each group in a class leaves one place for words never seen
        places = in_class + np.bincount(held.group_cls, minlength=classes)
        self.share = -np.log10(into + DELTA * np.maximum(places, 1))


def first_classes(coded_docs: DataFrame, words: pd.DataFrame, classes: int) -> Held:
    """The held words (columns wh, grp, n), classed as the most frequent of them and the groups of all others exchange."""
    words = words.sort_values(["n", "wh"], ascending=[False, True])
    top = np.sort(words["wh"].to_numpy(np.int64)[:TOP])
    cls = exchange(count_pairs(coded_docs, top), classes)
    own, groups = cls[1 : 1 + len(top)], cls[1 + len(top) :]
    words = words.sort_values("wh")
    wh = words["wh"].to_numpy(np.int64)
    out = groups[words["grp"].to_numpy(np.int64)]
    if len(top):
        at = np.minimum(np.searchsorted(top, wh), len(top) - 1)
        out = np.where(top[at] == wh, own[at], out)
    return Held(wh, words["n"].to_numpy(np.int64), out, groups, classes)


def learned(coded_docs: DataFrame, classes: int) -> tuple[Model, Held, DataFrame, DataFrame]:
    """The model, the held words, the written table of all others' counts and classes, and that of the slices in these terms."""
    spark = coded_docs.sparkSession
    words = written(count_words(coded_docs), "vocab")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = words.where(F.col("wh") == int(END)).select("n").first()
    held = first_classes(coded_docs, words.where((F.col("n") >= held_from(words)) & (F.col("grp") >= 0)).toPandas(), classes)
    forget(words)
    sweep(spark)
    counts = neighbours(coded_docs, held)
    big = bigrams(counts, classes)
    while True:
        new = moved(counts, held, big)
        forget(counts)
        sweep(spark)
        counts = neighbours(coded_docs, new)
        new_big = bigrams(counts, classes)
        gain = likelihood(new_big) - likelihood(big)
        if gain > 0:
            held, big = new, new_big
        if gain <= SETTLED * int(total):
            break
    forget(counts)
    rare, answers = rare_classes(coded_docs, held, big)
    sweep(spark)
    slices_ = resolved(coded_docs, held, answers, int(end[0]) if end else 0)
    sweep(spark)
    in_class = np.bincount(held.cls, minlength=classes).astype(float)
    in_class[0] += 1
    for r in rare.groupBy("cls").count().collect():  # a row per class
        in_class[r["cls"]] += r["count"]
    return Model(held, bigrams(slices_, classes), in_class, int(total), int(distinct)), held, rare, slices_


def score_texts(slices_: DataFrame, model: Model) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sent = slices_.sparkSession.sparkContext.broadcast(model)
    kind = slices_.schema["ids"].dataType.elementType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        less = float(np.log10(m.total + m.distinct + 1))
        for b in batches:
            for r in range(b.num_rows):
                sizes = b["sizes"][r].values
                begin = np.r_[0, np.cumsum(sizes.to_numpy())[:-1]]
                c = numbers(b["cls"][r].as_py(), int(sizes.to_numpy().sum()), np.uint8 if len(m.move) <= 256 else np.uint16)
                prev = np.r_[0, c[:-1]]
                prev[begin] = 0
                moves = np.add.reduceat(m.move[prev, c] + m.share[c], begin)
                cols = [b["ids"][r].values, b["held"][r].values, sizes, b["known"][r].values, pa.array(np.full(len(begin), m.total)), pa.array(b["base"][r].values.to_numpy() - sizes.to_numpy() * less), pa.array(b["own"][r].values.to_numpy() + moves)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return slices_.select("ids", "held", "sizes", "known", "base", "own", "cls").mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def class_lm(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, held: int = 2, classes: int = CLASSES) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose fold is not ``held``; a row with a null id is in
    no fold: it teaches nothing and is not held out. A null text is empty and
    has one token, its end. Repeated rows count as often as they stand there.
    Without training rows every word is unknown and the model is uniform over classes.
    """
    fold = remainder(F.col(doc_id), folds)
    fields = docs.select(F.col(doc_id).alias("i"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    coded_docs = encode(fields.withColumn("learn", F.col("i").isNotNull() & ~F.col("held_out")))
    model, _, _, slices_ = learned(coded_docs, classes)
    return score_texts(slices_, model)
