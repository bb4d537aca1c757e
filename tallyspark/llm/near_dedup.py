"""Near-duplicate documents by HyperMinHash.

Every document's shingle set is hashed into buckets; a bucket's register holds
the leading-zero count and the first mantissa bits of its smallest hash. Bands
of registers propose candidates, registers estimate their similarity with the
correction for chance collisions, and full sets confirm. Documents with equal
sets are one vertex from the start; links that would join what is joined
already are not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import components, numbered, scratch, small_batches, sweep, written
from .shingles import mix, shingle_sets

REGISTERS, BANDS, ROWS, MANTISSA = 128, 24, 4, 10
EMPTY = 0xFFFF
#: Sets below a size are hashed so many times into the same buckets: the similarity stays, and no bucket is left empty.
REPEATS = ((8, 256), (32, 64), (128, 16), (512, 4))
#: Members that are compared in one piece, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Pairs whose estimate is so far below the threshold are not looked at; about five standard deviations of 128 registers.
MARGIN = 0.18


def repeats(n: int, similarity: float) -> list[int]:
    """How often a set of n shingles is hashed: as its own size wants, and as a larger set that may be similar wants."""
    own = next((t for most, t in REPEATS if n < most), 1)
    more = next((t for most, t in REPEATS if n / similarity < most), 1)
    return [own] if more == own else [own, more]


def registers(h: np.ndarray, times: int) -> np.ndarray:
    """The compressed sketch of a set of distinct hashes."""
    with np.errstate(over="ignore"):
        all_ = mix((h[None, :] ^ (np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[:, None]).ravel())
    all_.sort()
    bucket = all_ >> np.uint64(57)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (all_[first] << np.uint64(7)) >> np.uint64(11)  # 53 bits, exact as doubles
    m, e = np.frexp(rest.astype(np.float64))
    zeros = 53 - e
    bits = np.where(rest > 0, (np.maximum(m * 2 - 1, 0) * (1 << MANTISSA)).astype(np.int64), 0)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[bucket[first].astype(np.int64)] = (zeros << MANTISSA | bits).astype(np.uint16)
    return out


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimated similarity of every row of a with every row of b; na, nb: how many hashes went in."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        either = (a[i] != EMPTY) | (b != EMPTY)
        same = ((a[i] == b) & either).sum(axis=1)
        out[i] = corrected(same, either.sum(axis=1), na[i], nb)
    return out


def corrected(same: np.ndarray, either: np.ndarray, na, nb) -> np.ndarray:
    """Similarity from equal registers of those in use, less the share that is equal by chance."""
    ratio = np.maximum(na, 1) / np.maximum(nb, 1)
    chance = 0.1699 / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return (same / np.maximum(either, 1) - chance) / (1 - chance)


def band_keys(regs: np.ndarray, times: int) -> np.ndarray:
    """One key for each band that holds a register."""
    bands = regs[: BANDS * ROWS].view(np.uint64)
    with np.errstate(over="ignore"):
        keys = mix(bands ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(times)))
    return keys[bands != np.uint64(0xFFFFFFFFFFFFFFFF)].view(np.int64)


SKETCH = "doc_id long, n long, s1 long, s2 long, sketches array<struct<t:int,regs:binary>>"


def sketch(docs: DataFrame, k: int, similarity: float, text: str, doc_id: str) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set, and its sketches; sets too small for an unequal partner have none."""
    least = int(1 / (1 - similarity) + 1e-9) - 1 if similarity < 1 else 1 << 60

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 512):
            n, s1, s2, sk = [], [], [], []
            for h in shingle_sets(b["t"], k):
                n.append(len(h))
                with np.errstate(over="ignore"):
                    s1.append(int(mix(h).sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0)
                    s2.append(int(mix(h ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0)
                sk.append([{"t": t, "regs": registers(h, t).tobytes()} for t in repeats(len(h), similarity)] if len(h) >= least and len(h) else [])
            kind = pa.list_(pa.struct([("t", pa.int32()), ("regs", pa.binary())]))
            yield pa.RecordBatch.from_arrays([b["i"], *(pa.array(x, pa.int64()) for x in (n, s1, s2)), pa.array(sk, kind)], ["doc_id", "n", "s1", "s2", "sketches"])

    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, SKETCH)


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, ts = [], [], []
            for i, t, r in zip(b["id"].to_pylist(), b["t"].to_pylist(), b["regs"].to_pylist(), strict=True):
                got = band_keys(np.frombuffer(r, np.uint16), t)
                keys.append(got)
                ids.append(np.full(len(got), i, np.int64))
                ts.append(np.full(len(got), t, np.int32))
            cat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            yield pa.RecordBatch.from_arrays([cat(keys, pa.int64()), cat(ids, pa.int64()), cat(ts, pa.int32())], ["key", "id", "t"])

    return reps.select("id", "t", "regs").mapInArrow(run, "key long, id long, t int")


class Joined:
    """What is joined to what, among the rows of one group."""

    def __init__(self, labels):
        self.boss = {x: x for x in labels}

    def find(self, x):
        boss = self.boss
        while boss[x] != x:
            boss[x] = x = boss[boss[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.boss[max(a, b)] = min(a, b)
        return a != b


def _grouped(rows: DataFrame, keys: list[str], work, schema: str, names: list[str]) -> DataFrame:
    """``work`` on runs of whole groups of rows, streamed in the order of the keys; groups are bounded, so what is carried on is too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for piece in small_batches([b], 4096):
                held = pa.Table.from_batches([piece] if held is None else [*held.to_batches(), piece])
                last = int(_starts(held, keys)[-1]) if held.num_rows else 0
                if last:
                    yield from work(held.slice(0, last).combine_chunks())
                    held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks())

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _arrays(b: pa.Table, columns: list[str]) -> dict[str, np.ndarray]:
    return {c: b[c].to_numpy() for c in columns} | {"regs": np.frombuffer(b"".join(b["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)}


def _pairs_out(pairs: list) -> pa.RecordBatch:
    out = np.sort(np.array(pairs, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def _tied(rows: DataFrame, cut: float) -> DataFrame:
    """Edges (a, b) that tie together all members of a block of a bucket whose estimates reach the cut: a forest, not all pairs."""

    def work(b: pa.Table) -> Iterator[pa.RecordBatch]:
        x = _arrays(b, ["id", "n"])
        at = _starts(b, ["key", "b"])
        ends = np.r_[at[1:], b.num_rows]
        two = at[ends - at == 2]  # groups of two, most of all, at once
        either = (x["regs"][two] != EMPTY) | (x["regs"][two + 1] != EMPTY)
        same = ((x["regs"][two] == x["regs"][two + 1]) & either).sum(axis=1)
        two = two[corrected(same, either.sum(axis=1), x["n"][two], x["n"][two + 1]) >= cut]
        pairs = list(zip(x["id"][two], x["id"][two + 1], strict=True))
        for a, e in zip(at, ends, strict=True):
            if e - a > 2:
                ids = x["id"][a:e]
                est = estimates(x["regs"][a:e], x["regs"][a:e], x["n"][a:e], x["n"][a:e])
                tree = Joined(range(len(ids)))
                pairs += [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(est >= cut, 1)), strict=True) if tree.join(i, j)]
        yield _pairs_out(pairs)

    return _grouped(rows, ["key", "b"], work, "a long, b long", ["key", "b", "id", "n", "regs"]).distinct()


def _linked(rows: DataFrame, cut: float, similarity: Fraction) -> DataFrame:
    """Confirmed links between components, within pairs of blocks (side 0, 1, or 2 for both).

    Pairs are tried from the most similar estimate down, and not at all once a link has joined them.
    """
    num, den = similarity.numerator, similarity.denominator

    def work(b: pa.Table) -> Iterator[pa.RecordBatch]:
        x = _arrays(b, ["id", "comp", "n", "t", "side"])
        raw = b["set"].to_pylist()
        at = _starts(b, ["key", "p", "q"])
        found = []
        for a, e in zip(at, np.r_[at[1:], b.num_rows], strict=True):
            own = {c: v[a:e] for c, v in x.items()}
            tree, sets = Joined(set(own["comp"].tolist())), {}
            for t in np.unique(own["t"]):
                left, right = np.flatnonzero((own["side"] != 1) & (own["t"] == t)), np.flatnonzero((own["side"] != 0) & (own["t"] == t))
                if not len(left) or not len(right):
                    continue
                est = estimates(own["regs"][left], own["regs"][right], own["n"][left], own["n"][right])
                i, j = np.nonzero((est >= cut) & (own["comp"][left][:, None] != own["comp"][right][None, :]))
                order = np.argsort(-est[i, j], kind="stable")
                for p, q in zip(left[i[order]].tolist(), right[j[order]].tolist(), strict=True):
                    if tree.find(own["comp"][p]) == tree.find(own["comp"][q]):
                        continue
                    for k in (p, q):
                        if k not in sets:
                            sets[k] = np.frombuffer(raw[a + k], np.uint64)
                    common = _common(sets[p], sets[q])
                    if den * common >= num * (len(sets[p]) + len(sets[q]) - common):
                        tree.join(own["comp"][p], own["comp"][q])
                        found.append((own["id"][p], own["id"][q]))
        yield _pairs_out(found)

    return _grouped(rows, ["key", "p", "q"], work, "a long, b long", ["key", "p", "q", "id", "t", "n", "comp", "side", "regs", "set"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) if len(y) else 0


def _starts(b: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    if not b.num_rows:
        return np.empty(0, np.int64)
    new = np.zeros(b.num_rows, bool)
    new[0] = True
    for c in keys:
        v = b[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    num, den = similarity.numerator, similarity.denominator
    a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            good = []
            for x, y in zip(b["sa"].to_pylist(), b["sb"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = _common(x, y)
                good.append(den * common >= num * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float | str = "0.8", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, n_links.

    Documents are linked where the Jaccard similarity of their distinct k-word
    shingles reaches ``similarity``; ``component_id`` is the least id that links
    reach, ``kept`` says that it is the document's own. A document without
    words or text is linked with nothing. Rows that repeat an id get one row
    each. A row whose id is null is linked with nothing and has a null
    component, and is kept. ``n_links`` counts the confirmed links of the
    document's class of equal sets to other classes that the search needed.

    Members of a band bucket whose estimates come near the threshold are tied
    together by a forest of edges, and the edges are confirmed on full sets; a
    large bucket is dealt into blocks by a hash of the members, and after the
    first links into other blocks once more. Then, in buckets whose members
    are still not all joined, the pairs between components are tried block by
    block, each task ending a pair's turn as soon as a link has joined its
    ends. Blocks of one component never meet. Ids that are no whole numbers
    are numbered in their order first.
    """
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        numbers = numbered(docs, doc_id)
        rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("_text")).join(numbers, "key", "left")
        out = near_duplicates(rows.select("_no", "_text"), k, similarity, "_text", "_no")
        name = lambda c: numbers.select(F.col("_no").alias(c), F.col("key").alias(f"_{c}"))
        out = out.join(name("doc_id"), "doc_id", "left").join(name("component_id"), "component_id", "left")
        return out.select(F.col("_doc_id").alias("doc_id"), "n_shingles", F.col("_component_id").alias("component_id"), "kept", "n_links")
    with scratch(docs.sparkSession) as keep:
        return _near_duplicates(docs, k, Fraction(str(similarity)), text, doc_id, keep)


def _near_duplicates(docs: DataFrame, k: int, sim: Fraction, text: str, doc_id: str, keep) -> DataFrame:
    level = float(sim)
    spark = docs.sparkSession
    sk = written(sketch(docs, k, level, text, doc_id), "sketch")
    full = sk.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id")), "classes")
    # a document is the representative of at most one class: the row must hold the class's set
    reps = full.where(F.size("sketches") > 0).join(classes.withColumnRenamed("id", "doc_id"), ["s1", "s2", "n", "doc_id"], "left_semi")
    reps = written(reps.select(F.col("doc_id").alias("id"), "n", F.explode("sketches").alias("s")).select("id", "s.t", "s.regs", (F.col("n") * F.col("s.t")).alias("n")).dropDuplicates(["id", "t"]), "reps")
    bands = written(_bands(reps), "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = written(bands.join(shared, "key"), "members")
    cut = level - MARGIN

    def tied(rows: DataFrame, deal: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(deal), "id"), F.ceil(F.col("size") / BLOCK).cast("long"))
        return _tied(rows.withColumn("b", block).join(reps, ["id", "t"]), cut)

    pairs = written(tied(member, 0), "pairs")
    sweep(spark)
    large = member.where(F.col("size") > BLOCK)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct()
    sets = written(_sets(docs, ends, k, text, doc_id), "sets")
    links = written(_confirm(pairs, sets, sim), "links")
    sweep(spark)
    comp = components(links)
    if not large.isEmpty():
        again = tied(large, 1).join(pairs, ["a", "b"], "left_anti")
        links = links.unionByName(written(_confirm(again, sets, sim), "links"))
        comp = components(links)
    # of a bucket of two the only pair has been tried
    sweep(spark)
    known = sets.select("id", F.length("set").alias("bytes")).join(comp, "id", "left").select("id", "bytes", F.coalesce("component", "id").alias("comp"))
    rows = _between(member.where("size > 2").select("key", "id", "t").join(known, "id"))
    sweep(spark)
    more = written(_linked(rows.join(reps, ["id", "t"]).join(sets, "id"), cut, sim), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        comp = components(links)
    ends = written(links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links")), "ends")
    keep(sk, classes, comp, ends)
    named = classes.join(comp, "id", "left").join(ends, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = sk.select("doc_id", "n", "s1", "s2")
    known = rows.where("n > 0 and doc_id is not null").join(named, ["s1", "s2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "n_links")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(alone)


def _sets(docs: DataFrame, ids: DataFrame, k: int, text: str, doc_id: str) -> DataFrame:
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 512):
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([h.tobytes() for h in shingle_sets(b["t"], k)], pa.binary())], ["id", "set"])

    return own.mapInArrow(run, "id long, set binary").where(F.length("set") > 0).dropDuplicates(["id"])


def _between(own: DataFrame) -> DataFrame:
    """Members of buckets (key, id, t, bytes, comp) that hold several components, as the pairs of blocks in which they meet; blocks are bounded in members and in bytes of sets.

    A component that fills a block has blocks of its own, which do not meet one
    another; all smaller ones of a bucket are dealt together. Buckets of the
    same members count once.
    """
    mixed = own.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("first"))
    once = mixed.where("n > 2 and lo <> hi").groupBy("n", "lo", "hi", "x", "first").agg(F.min("key").alias("key")).select("key")
    own = written(own.join(once, "key"), "between")
    size = own.groupBy("key", "comp").agg(F.sum(F.greatest(F.lit(1 / BLOCK), F.col("bytes") / BLOCK_BYTES)).alias("w"))
    size = size.withColumn("big", F.col("w") >= 1)
    rest = size.where("not big").groupBy("key").agg(F.ceil(F.sum("w") - 1e-9).alias("n"))
    of_big = size.where("big").select("key", "comp", F.ceil("w").alias("n"))
    dealt = F.pmod(F.xxhash64("id"), F.col("n"))
    big = own.join(of_big, ["key", "comp"]).select("key", "id", "t", "comp", F.xxhash64("comp", dealt).alias("block"))
    small = own.join(size.where("not big").select("key", "comp"), ["key", "comp"]).join(rest, "key").select("key", "id", "t", "comp", F.xxhash64(F.lit("small"), dealt).alias("block"))
    own = written(big.withColumn("big", F.lit(True)).unionByName(small.withColumn("big", F.lit(False))), "blocks")
    blocks = own.groupBy("key", "block", "big").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    s, b = blocks.where("not big"), blocks.where("big")
    right = lambda d: d.select("key", F.col("block").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    left = lambda d: d.select("key", F.col("block").alias("p"), "lo", "hi")
    among = left(s).join(right(s), "key").where("p <= q and not (lo = hi and lo2 = hi2 and lo = lo2)")
    across = left(s).join(right(b), "key")
    two = of_big.select("key", "comp").join(of_big.select("key", F.col("comp").alias("comp2")), "key").where("comp < comp2")
    apart = two.join(b.select("key", F.col("lo").alias("comp"), F.col("block").alias("p")), ["key", "comp"]).join(b.select("key", F.col("lo").alias("comp2"), F.col("block").alias("q")), ["key", "comp2"])
    todo = among.select("key", "p", "q").unionByName(across.select("key", "p", "q")).unionByName(apart.select("key", "p", "q"))
    # each pair of blocks asks for its one or two blocks
    asked = todo.select("key", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    side = F.when(F.col("p") == F.col("q"), 2).when(F.col("block") == F.col("p"), 0).otherwise(1)
    return own.join(asked, ["key", "block"]).select("key", "id", "t", "p", "q", side.alias("side"), "comp")
