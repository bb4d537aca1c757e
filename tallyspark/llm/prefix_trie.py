"""Prefix trie of conversations by fixed-length block hashing.

A conversation's turns are cut into blocks of a fixed number of turns, and a
block's digest with the digest of all before it stands for a prefix. Equal
blocks after equal prefixes are grouped first, so copies collapse to one row a
block. Only where different blocks follow one prefix are their turns compared
one by one; a block without siblings becomes a chain of nodes as it is.

Digests are two 64-bit sums (exclusive or) over turns hashed with their
places, so a prefix's digest is a running sum that ranges of a long
conversation can compute apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, scratch, written

#: Turns of a block; blocks of a range of a conversation; turns from which a conversation is put in order by ranges.
BLOCK, RANGE, LONG = 4, 4096, 100_000
#: Ids that are joined in one piece for a node's list.
PIECE = 4096
KEY = ["k1", "k2"]


def ordered(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG) -> DataFrame:
    """conv_id, pos (from 1), d1, d2 (digests of role and text) and nb (UTF-8 bytes of the text) of every turn.

    Turns stand by number, null first, ties by role and digest; a null role or
    text is empty; rows without an id belong to no conversation. A conversation
    of more than ``long`` turns is put in order by ranges, not in one task.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = lambda k: F.xxhash64(F.lit(k), r, t)
    rows = convs.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), digest(1).alias("d1"), digest(2).alias("d2"), F.octet_length(t).cast("long").alias("nb")).where("conv_id is not null")
    by = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("d1"), F.col("d2")]
    cols = ["conv_id", "pos", "d1", "d2", "nb"]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long")
    large = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select("conv_id")
    if large.isEmpty():
        return rows.withColumn("pos", place("conv_id")).select(*cols)
    cut = written(rows.join(large, "conv_id", "left_semi").repartitionByRange("conv_id", *by).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    apart = cut.withColumn("pos", place("conv_id", "part")).join(offset, ["conv_id", "part"]).withColumn("pos", F.col("pos") + F.col("before"))
    return rows.join(large, "conv_id", "left_anti").withColumn("pos", place("conv_id")).select(*cols).unionByName(apart.select(*cols))


def rebuilt(turns: DataFrame, family: int = 5, span: int = 9) -> DataFrame:
    """Every conversation c with its first turns taken from another: the first h turns of c - c % ``family`` (all if fewer), then its own after its first h; h is crc32 of the decimal id modulo ``span``.

    Same columns as ``ordered``; a conversation left without turns has one row with place 0.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % span).cast("long")
    t = turns.withColumn("g", F.col("conv_id") - F.col("conv_id") % family)
    turn = F.struct("pos", "d1", "d2", "nb")
    # span - 1 turns of one conversation at most
    heads = t.where((F.col("conv_id") == F.col("g")) & (F.col("pos") < span)).groupBy("g").agg(F.sort_array(F.collect_list(turn)).alias("head"))
    t = t.join(heads, "g", "left").withColumn("h", h).withColumn("head", F.filter("head", lambda x: x["pos"] <= F.col("h")))
    kind = "array<struct<pos:bigint,d1:bigint,d2:bigint,nb:bigint>>"
    none = F.array().cast(kind)
    led = F.when(F.col("pos") == 1, F.concat(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(0).cast("long").alias("nb"))), F.coalesce("head", none))).otherwise(none)
    own = F.when(F.col("pos") > F.col("h"), F.array(F.struct((F.col("pos") - F.col("h") + F.coalesce(F.size(F.coalesce("head", none)), F.lit(0))).alias("pos"), "d1", "d2", "nb"))).otherwise(none)
    return t.select("conv_id", F.explode(F.concat(led, own).cast(kind)).alias("t")).select("conv_id", "t.*")


def _salted(k: int) -> Column:
    return F.xxhash64(F.lit(k), "pos", "d1", "d2")


def _blocks(turns: DataFrame, size: int) -> DataFrame:
    """conv_id, k (the block's number), its turns (h1, h2, nb), the digests p1, p2 of all before it and k1, k2 with it."""
    t = turns.where("pos > 0").select("conv_id", F.floor((F.col("pos") - 1) / size).alias("k"), "pos", _salted(1).alias("h1"), _salted(2).alias("h2"), "nb")
    b = t.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "nb"))).alias("turns"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))  # a block's turns
    b = b.withColumn("turns", F.transform("turns", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["nb"].alias("nb")))).withColumn("part", F.floor(F.col("k") / RANGE))
    upto = Window.partitionBy("conv_id", "part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("r1", F.bit_xor("x1").over(upto)).withColumn("r2", F.bit_xor("x2").over(upto))
    # what the ranges before add; few conversations have more than one
    whole = b.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("o1"), F.bit_xor("x2").alias("o2"), F.max("k").alias("last"))
    over = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.where((F.col("part") > 0) | (F.col("last") == RANGE - 1)).select("conv_id", "part", F.bit_xor("o1").over(over).alias("o1"), F.bit_xor("o2").over(over).alias("o2")).where("part > 0")
    b = b.join(whole, ["conv_id", "part"], "left")
    plus = lambda a, o: F.col(a).bitwiseXOR(F.coalesce(F.col(o), F.lit(0).cast("long")))
    b = b.select("conv_id", "k", "turns", "x1", "x2", plus("r1", "o1").alias("k1"), plus("r2", "o2").alias("k2"))
    return b.withColumn("p1", F.col("k1").bitwiseXOR(F.col("x1"))).withColumn("p2", F.col("k2").bitwiseXOR(F.col("x2")))


def _turnwise(groups: DataFrame, size: int) -> DataFrame:
    """The nodes along a group of equal blocks: one for each of its turns."""
    upto = lambda p, h, i: F.aggregate(F.slice("turns", 1, i), F.col(p), lambda a, x: a.bitwiseXOR(x[h]))
    node = lambda i: F.struct((F.col("k") * size + i).cast("long").alias("depth"), upto("p1", "h1", i).alias("k1"), upto("p2", "h2", i).alias("k2"), upto("p1", "h1", i - 1).alias("q1"), upto("p2", "h2", i - 1).alias("q2"), F.element_at("turns", i)["nb"].alias("nb"))
    steps = F.transform(F.sequence(F.lit(1), F.size("turns")), node)
    return groups.select("n_convs", "conv_id", F.explode(steps).alias("s")).select("s.*", "n_convs", "conv_id")


def _nodes(blocks: DataFrame, size: int) -> DataFrame:
    """depth, k1, k2, q1, q2 (the parent's), nb, n_convs, conv_id of every node but the root."""
    groups = written(blocks.groupBy("k", "p1", "p2", "turns").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")), "blocks")
    # the first blocks differ anyhow; of later ones those without siblings are chains
    later = groups.where("k > 0").join(groups.where("k > 0").groupBy("k", "p1", "p2").agg(F.count("*").alias("siblings")), ["k", "p1", "p2"])
    chains = _turnwise(later.where("siblings = 1"), size)
    split = _turnwise(groups.where("k = 0").unionByName(later.where("siblings > 1").drop("siblings")), size)
    split = split.groupBy("depth", *KEY, "q1", "q2", "nb").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    out = written(split.unionByName(chains.select(*split.columns)), "nodes")
    forget(groups)
    return out


def _ends(turns: DataFrame) -> DataFrame:
    """The node at which each conversation ends."""
    at = lambda k: F.when(F.col("pos") > 0, _salted(k)).otherwise(F.lit(0).cast("long"))
    return turns.groupBy("conv_id").agg(F.bit_xor(at(1)).alias("k1"), F.bit_xor(at(2)).alias("k2"))


def _id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending and joined by commas.

    Ids are put in order by ranges and joined in pieces wherever their node's
    ids lie; a node's pieces, a row for thousands of ids, are then hashed one
    after the other.
    """
    n = ends.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    alone = n.where("n = 1").select(*KEY, F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    many = ends.join(n.where("n > 1").select(*KEY), KEY, "left_semi")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*key, ids[0])), pa.array([",".join(map(str, ids))], pa.string())], ["k1", "k2", "first", "ids"])

        for b in batches:
            for *k, i in zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            out = []
            for *k, ids in zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if k == key:
                    h.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
            yield rows_of(out)
        if key:
            yield rows_of([(*key, h.hexdigest())])

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["k1", "k2", "ends_sha256"])

    pieces = many.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(join, "k1 long, k2 long, first long, ids string")
    whole = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")
    return alone.unionByName(whole)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """k1, k2, n_leaves, saved: sums over subtrees of nodes (k1, k2, q1, q2, n_leaves, saved), q null at the top.

    Each round a node's sum goes to the ancestor twice as far up as in the
    round before, so there are as many rounds as the depth has binary digits.
    """
    state = written(nodes, "subtrees")
    while not state.where("q1 is not null").isEmpty():
        more = state.where("q1 is not null").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        up = state.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("q1").alias("u1"), F.col("q2").alias("u2"))
        plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        last, state = state, written(state.join(more, KEY, "left").join(up, ["q1", "q2"], "left").select(*KEY, F.col("u1").alias("q1"), F.col("u2").alias("q2"), plus("n_leaves", "l"), plus("saved", "s")), "subtrees")
        forget(last)
    out = state.select(*KEY, "n_leaves", "saved")
    out._path = state._path
    return out


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the digests k1, k2.

    ``turns`` has the columns of ``ordered``; a conversation without turns is
    one row with place 0. A node is a sequence of first turns, its members the
    conversations that begin so; conv_id is the least of them. saved_tokens
    sums (n_convs - 1) * bytes of the last turn's text over the subtree. The
    root, depth 0, has a null parent; without conversations there is none.
    Conversations with equal turns are different members.
    """
    with scratch(turns.sparkSession) as keep:
        return _trie(turns, block, keep)


def _trie(turns: DataFrame, block: int, keep) -> DataFrame:
    turns = written(turns, "turns")
    ends = written(_ends(turns), "ends")
    nodes = _nodes(_blocks(turns, block), block)
    forget(turns)
    kids = nodes.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    own = (F.col("n_convs") - 1) * F.col("nb")
    # a node of one conversation has one leaf and saves nothing: sums are for the others
    shared = nodes.where("n_convs > 1").join(kids, KEY, "left")
    top = F.col("depth") > 1
    sums = _subtrees(shared.select(*KEY, F.when(top, F.col("q1")).alias("q1"), F.when(top, F.col("q2")).alias("q2"), F.coalesce("alone", F.lit(1)).alias("n_leaves"), own.alias("saved")))
    digests = written(_id_digests(ends), "digests")
    keep(ends, nodes, sums, digests)
    lows = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    whole = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    first = F.broadcast(whole.select(F.col("conv_id").alias("root")))
    body = nodes.where("depth > 1").join(lows, ["q1", "q2"]).unionByName(nodes.where("depth = 1").join(first).withColumnRenamed("root", "parent_conv_id").select(*nodes.columns, "parent_conv_id"), allowMissingColumns=True)
    body = body.join(kids.select(*KEY, "n_children"), KEY, "left").join(sums, KEY, "left").join(digests, KEY, "left")
    body = body.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", zero).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), *KEY)
    all_ = nodes.join(kids.select(*KEY, "n_children"), KEY, "left").agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.count_if(F.col("n_children").isNull()), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum(own), zero).alias("saved_tokens"))
    at_root = digests.where("k1 = 0 and k2 = 0").select("ends_sha256")
    root = whole.join(F.broadcast(all_)).join(F.broadcast(at_root), how="left").select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), zero.alias("k1"), zero.alias("k2"))
    return body.unionByName(root)
