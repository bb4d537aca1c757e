"""Removal of long repeated substrings with suffix arrays.

Content-defined anchors (window minima of 32-byte hashes) mark every string of
the given length; only anchors that occur twice lead on. Equal surroundings of
an anchor are counted and collapse; where an anchor has several surroundings,
these are put into a suffix array of 8-byte symbols, built by linear grouping,
and neighbours in it show exactly which strings occur twice. The surroundings of a
very frequent anchor are dealt to several such arrays by what they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import scratch, small_batches, written
from .shingles import mix

GRAM = 32
#: Bytes of a text that are hashed at once.
PIECE = 1 << 19
#: Contexts that go into one suffix array, if their anchors' groups allow it; and the largest group that is not dealt by cores.
TOGETHER, GROUP = 400, 24_000


# -- suffix arrays ---------------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers whose last is the only smallest one, by linear grouping.

    First all suffixes are grouped by their Lyndon prefix: groups are taken
    from the greatest down, each suffix points to the nearest one before it in
    a lower group, and those pointed at move, by how often, to new groups just
    above their own. Then the suffixes come out in order: each one that is
    placed places the suffix before it, and along its pointers those before
    that, at the first free place of their group. No names are given anew, and
    each suffix moves a bounded number of times for each one that points to it.
    """
    n = len(text)
    values = sorted(set(text))
    rank = {v: g for g, v in enumerate(values)}
    group = [rank[v] for v in text]
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    # groups in a list linked both ways, by order; size: members that are still in them
    below = list(range(-1, len(values) - 1))
    above = [*range(1, len(values)), -1]
    size = [len(m) for m in members]
    before = [-1] * n  # the previous smaller suffix
    done = bytearray(n)
    g = len(values) - 1
    while g >= 0:
        own = members[g]
        if size[g] < len(own):
            own = members[g] = [i for i in own if group[i] == g]
        if len(own) == 1:
            i = own[0]
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            done[i] = 1
            if j >= 0 and size[group[j]] > 1:
                by = (((1, group[j]), [j]),)
            else:  # nothing to move, or one suffix that has its group for itself
                g = below[g]
                continue
        elif own:
            own.sort()
            pointed: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and (done[j] or group[j] == g):
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            for i in own:
                done[i] = 1
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                parts.setdefault((times, group[j]), []).append(j)
            # the more often pointed at, the greater: each new group goes right above the old one, below those made before
            by = sorted(parts.items(), reverse=True) if len(parts) > 1 else parts.items()
        else:
            by = ()
        for (_, old), js in by:
            if size[old] == len(js):
                continue  # all that is left of a group stays where it is
            new = len(members)
            members.append(js)
            size.append(len(js))
            size[old] -= len(js)
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = new
            if over >= 0:
                below[over] = new
            for j in js:
                group[j] = new
        g = below[g]
    # first free place of each group, from the lowest
    free = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    out = [-1] * n
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = before[j]
    return out


# -- anchors ---------------------------------------------------------------------------------------


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: of every ``length`` bytes, the first of the 32-byte strings in them with the least hash."""
    n, w = len(data), length - GRAM + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    every, hashes = [], []
    for start in range(0, n - length + 1, PIECE):
        x = np.frombuffer(data, np.uint8, min(n, start + PIECE + length - 1) - start, start).astype(np.uint64)
        x = x[:-1] | x[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        x = x[:-4] | x[4:] << np.uint64(32)
        with np.errstate(over="ignore"):
            m = len(x) - GRAM + 8
            h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
            for at, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
                h ^= h >> np.uint64(29)
                h = (h + x[at : at + m]) * np.uint64(odd)
        h = mix(h)
        key = h >> np.uint64(20) << np.uint64(20) | np.arange(m, dtype=np.uint64)
        low, span = key, 1
        while span * 2 <= w:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        at = (low[np.r_[True, low[1:] != low[:-1]]] & np.uint64((1 << 20) - 1)).astype(np.int64)
        every.append(at + start)
        hashes.append(h[at])
    pos, first = np.unique(np.concatenate(every), return_index=True)
    return pos, np.concatenate(hashes)[first]


def _key(docs: DataFrame, text: Column, doc_id: str) -> list[Column]:
    """d, tag: what tells a row's text from others, its id (a hash of it, if it is no whole number) and a 64-bit hash of the text; without an id, two such hashes."""
    whole = isinstance(docs.schema[doc_id].dataType, IntegralType)
    own = F.col(doc_id).cast("long") if whole else F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.lit("id"), doc_id))
    return [F.coalesce(own, F.xxhash64(F.lit("no id"), text)).alias("d"), F.xxhash64(text).alias("tag")]


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*_key(docs, body, doc_id), body.alias("t"))


def _anchor_rows(docs: DataFrame, length: int, only_hash: bool) -> DataFrame:
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in small_batches(batches):
            ah, ch, own, ps = [], [], [], []
            for k, t in enumerate(b["t"].cast(pa.binary())):
                data = t.as_py()
                pos, h = anchors(data, length)
                ah.append(h)
                if not only_hash:
                    ps.append(pos)
                    own.append(np.full(len(pos), k))
                    ch += [digest(data[max(0, p - reach) : p + length], min(p, reach)) for p in pos.tolist()]
            ah = pa.array(np.concatenate(ah).view(np.int64) if ah else [], pa.int64())
            if only_hash:
                yield pa.RecordBatch.from_arrays([ah], ["ah"])
            elif len(ah):
                own = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([ah, pa.array(np.array(ch, np.uint64).view(np.int64)), b["d"].take(own), b["tag"].take(own), pa.array(np.concatenate(ps), pa.int64())], ["ah", "ch", "d", "tag", "pos"])

    return docs.mapInArrow(run, "ah long" if only_hash else "ah long, ch long, d long, tag long, pos long")


# -- contexts --------------------------------------------------------------------------------------


def repeated_starts(ctx: list[bytes], left: np.ndarray, occ: np.ndarray, pos: np.ndarray, many: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the places (within its document) where a string of ``length`` bytes begins that begins elsewhere too.

    ``left``: bytes before the anchor; ``occ``: the document's number; ``pos``:
    the anchor's place in it; ``many``: that the same context occurs again.
    """
    reach = length - GRAM
    pad = -(-reach // 8) * 8
    wide = pad + -(-length // 8) * 8 + 8
    m, inner = len(ctx), length // 8 - 1
    buf = np.zeros((m, wide), np.uint8)
    lo = pad - left
    hi = lo + np.fromiter(map(len, ctx), np.int64, m)
    for i, c in enumerate(ctx):
        buf[i, lo[i] : hi[i]] = np.frombuffer(c, np.uint8)
    blocks = buf.view(np.uint64)
    col = np.arange(wide // 8)
    whole = (col * 8 >= lo[:, None]) & (col * 8 + 8 <= hi[:, None])
    own, at = np.nonzero(whole)
    symbols, sym = np.unique(blocks[own, at], return_inverse=True)
    # after each context an end of its own, the last the smallest
    sizes = whole.sum(axis=1)
    cut = np.cumsum(sizes)
    seq = np.insert(sym + m, cut, np.arange(m)[::-1])
    owner = np.insert(own, cut, np.arange(m))
    block = np.insert(at, cut, wide)
    order = np.array(suffix_array(seq.tolist()))
    # suffixes whose next ``inner`` symbols lie in one context, in order; equal ones are neighbours
    ends = np.repeat(cut + np.arange(m), sizes + 1)
    order = order[order + inner <= ends[order]]
    if not len(order):
        return [np.empty(0, np.int64)] * m
    windows = np.lib.stride_tricks.sliding_window_view(seq, inner)[order]
    cls = np.cumsum(np.r_[0, (windows[1:] != windows[:-1]).any(axis=1)])
    o_ctx, o_block = owner[order], block[order]
    before = np.where(o_block > 0, blocks[o_ctx, np.maximum(o_block - 1, 0)], 0)
    rest = length - inner * 8  # 8 to 15 bytes around the whole symbols
    keys, parts = [], []
    for o in range(8):
        begin = o_block * 8 - o
        ok = np.flatnonzero((begin >= lo[o_ctx]) & (begin + length <= hi[o_ctx]))
        if not len(ok):
            continue
        tail = rest - o
        after = o_block[ok] + inner
        head = before[ok] & np.uint64(((1 << 64) - 1) ^ ((1 << 64 - 8 * o) - 1) if o else 0)
        one = blocks[o_ctx[ok], after] & np.uint64((1 << 8 * min(tail, 8)) - 1)
        two = blocks[o_ctx[ok], np.minimum(after + 1, wide // 8 - 1)] & np.uint64((1 << 8 * max(tail - 8, 0)) - 1)
        keys.append(np.stack([cls[ok].astype(np.uint64) * np.uint64(8) + np.uint64(o), head, one, two]))
        parts.append(np.stack([o_ctx[ok], begin[ok] - pad + pos[o_ctx[ok]]]))
    if not keys:
        return [np.empty(0, np.int64)] * m
    key, part = np.concatenate(keys, axis=1), np.concatenate(parts, axis=1)
    doc = occ[part[0]]
    by = np.lexsort((part[1], doc, key[3], key[2], key[1], key[0]))
    key, part, doc = key[:, by], part[:, by], doc[by]
    new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
    other = new | np.r_[True, (doc[1:] != doc[:-1]) | (part[1, 1:] != part[1, :-1])]
    # one place may be seen from several anchors, but counts once; a context that occurs again counts for two
    weight = np.where(many[part[0]], 2, other.astype(np.int64))
    first = np.flatnonzero(new)
    twice = np.repeat(np.add.reduceat(weight, first) >= 2, np.diff(np.r_[first, len(new)]))
    at = np.lexsort((part[1][twice], part[0][twice]))
    who, where = part[0][twice][at], part[1][twice][at]
    return np.split(where, np.searchsorted(who, np.arange(1, m)))


def starts(length: int, parts: int) -> list[tuple[int, int]]:
    """How far before an anchor a string may begin, in ranges, first and last of each."""
    step = -(-(length - GRAM + 1) // parts)
    return [(lo, min(lo + step - 1, length - GRAM)) for lo in range(0, length - GRAM + 1, step)]


def narrowed(rows: list[tuple], length: int, parts: int = 8) -> list[tuple]:
    """Rows (anchor, left, context, ...) that may hold a repeated string, each cut to where one can be.

    The strings around an anchor fall into ranges by how far they begin before
    it; all strings of a range hold the same core, so only ranges whose core
    another context has as well are left. Gives (place in rows, left, context).
    """
    ranges = starts(length, parts)
    cores, count = [], {}
    for a, left, c, *_ in rows:
        own = []
        for lo, hi in ranges:
            core = c[left - lo : left + length - hi] if lo <= left and left + length - hi <= len(c) else None
            own.append(None if core is None else hash((a, lo, core)))
            if core is not None:
                count[own[-1]] = count.get(own[-1], 0) + 1
        cores.append(own)
    out = []
    for k, (own, row) in enumerate(zip(cores, rows, strict=True)):
        live = [r for r, key in zip(ranges, own, strict=True) if key is not None and count[key] > 1]
        if live:
            left, begin = row[1], max(0, row[1] - live[-1][1])
            out.append((k, left - begin, row[2][begin : left + length - live[0][0]]))
    return out


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The stretches that strings with these starts, in order, cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + length).tolist(), strict=True))


CONTEXT = "ah long, many boolean, d long, tag long, pos long, lft int, ctx binary"
SPAN = "d long, tag long, a long, b long"


def _contexts(packed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    reach = length - GRAM
    lists = wanted.groupBy("d", "tag").agg(F.collect_list(F.struct("pos", "ah", "many")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in small_batches(batches):
            rows: dict[tuple, tuple] = {}
            for d, tag, z, want in zip(b["d"].to_pylist(), b["tag"].to_pylist(), b["z"].to_pylist(), b["want"].to_pylist(), strict=True):
                data = unpack.decompress(z)
                for x in want:
                    p = x["pos"]
                    rows[d, tag, p] = (x["ah"], x["many"], d, tag, p, min(p, reach), data[max(0, p - reach) : p + length])
            cols = list(zip(*rows.values(), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["ah", "many", "d", "tag", "pos", "lft", "ctx"])

    return packed.join(lists, ["d", "tag"]).select("d", "tag", "z", "want").mapInArrow(run, CONTEXT)


def _packed(rows: DataFrame) -> DataFrame:
    """The texts compressed, as they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in small_batches(batches):
            z = [pack.compress(t.as_py()) for t in b["t"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "t"), pa.array(z, pa.binary())], [*(c for c in b.schema.names if c != "t"), "z"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "t")
    return rows.select(*[c for c in rows.columns if c != "t"], "t").mapInArrow(run, f"{kinds}, z binary")


def _by_suffix_array(ctx: DataFrame, length: int) -> DataFrame:
    """Spans of the contexts that occur once, from suffix arrays of whole anchor groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("ah", "many", "d", "tag", "pos", "lft", "ctx")), strict=True):
                if len(held) >= TOGETHER and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        live = narrowed([(h[0], h[5], h[6]) for h in held], length)
        _, many, d, tag, pos, _, _ = zip(*[held[k] for k, _, _ in live], strict=True) if live else [()] * 7
        lft, ctx = [x[1] for x in live], [x[2] for x in live]
        number: dict[tuple, int] = {}
        occ = np.array([number.setdefault(x, len(number)) for x in zip(d, tag, strict=True)])
        got = repeated_starts(ctx, np.array(lft, np.int64), occ, np.array(pos, np.int64), np.array(many, bool), length) if live else []
        out = [(d[i], tag[i], a, b) for i, s in enumerate(got) if not many[i] for a, b in runs(s, length)]
        return pa.RecordBatch.from_pylist([dict(zip(("d", "tag", "a", "b"), x, strict=True)) for x in out], pa.schema([("d", pa.int64()), ("tag", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))

    return ctx.repartition("ah").sortWithinPartitions("ah").mapInArrow(run, SPAN)


def _cuts(ctx: DataFrame, length: int, parts: int) -> DataFrame:
    """Each context once for every range of starts, cut to it; ah becomes a hash of the anchor, the range and its core, cut one of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, digest = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        ranges = starts(length, parts)
        for b in small_batches(batches):
            out = []
            for ah, many, d, tag, pos, left, c in zip(*(b[x].to_pylist() for x in ("ah", "many", "d", "tag", "pos", "lft", "ctx")), strict=True):
                for lo, hi in ranges:
                    if lo <= left and left + length - hi <= len(c):
                        begin = max(0, left - hi)
                        cut, own = c[begin : left + length - lo], left - begin
                        core = short(c[left - lo : left + length - hi], ah * 1000 + lo & (1 << 64) - 1)
                        out.append((core - (1 << 63), many, d, tag, pos, own, cut, digest(cut, own)))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["ah", "many", "d", "tag", "pos", "lft", "ctx", "cut"])

    return ctx.mapInArrow(run, CONTEXT + ", cut binary")


def _by_core(ctx: DataFrame, length: int, parts: int = 8) -> DataFrame:
    """Spans in groups too large for one task, dealt by what the strings of a range of starts have in common.

    Equal strings begin equally far before their anchor, so they share the
    range and its core, and meet in one of the new groups. Equal cuts are
    counted and collapse, as equal surroundings do; the rest goes into suffix
    arrays. A group that is still too large, of strings that share all but a
    few bytes at their ends, is dealt again by ranges an eighth as wide; a
    range of one start holds one string, which is counted.
    """
    cuts = written(_cuts(ctx, length, parts), "cuts")
    alike = written(cuts.groupBy("ah", "cut").agg(F.count("*").alias("n"), F.max("many").alias("known"), F.min(F.struct("d", "tag", "pos", "lft", "ctx")).alias("m")), "alike")
    again = alike.where("n > 1").select("ah", "cut")
    begin = F.col("pos") - F.col("lft")
    spans = cuts.select("ah", "cut", "many", "d", "tag", begin.alias("a"), (begin + F.length("ctx")).alias("b")).where("not many").join(again, ["ah", "cut"], "left_semi").select("d", "tag", "a", "b")
    mixed = alike.groupBy("ah").agg(F.count("*").alias("kinds")).where("kinds > 1")
    rest = alike.join(mixed, "ah").select("ah", "kinds", F.expr("known or n > 1").alias("many"), "m.*")
    if parts > length - GRAM:  # one string a group: only groups of equal hashes are left
        return spans.unionByName(_by_suffix_array(rest.drop("kinds"), length))
    spans = spans.unionByName(_by_suffix_array(rest.where(F.col("kinds") <= GROUP).drop("kinds"), length))
    large = written(rest.where(F.col("kinds") > GROUP).drop("kinds"), "large")
    return spans if large.isEmpty() else spans.unionByName(_by_core(large, length, parts * 8))


def repeated_spans(docs: DataFrame, length: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Columns d, tag, spans (array of a, b): the stretches of each text that repeated strings cover, in bytes."""
    with scratch(docs.sparkSession) as keep:
        out = _repeated_spans(docs, length, text, doc_id)
        keep(out)
        return out


def _repeated_spans(docs: DataFrame, length: int, text: str, doc_id: str) -> DataFrame:
    rows = _keyed(docs, text, doc_id)
    # written, so that the join below has a plain exchange on either side and a hot anchor can be split
    multi = written(_anchor_rows(rows, length, True).groupBy("ah").count().where("count > 1").select("ah"), "twice")
    seen = written(_anchor_rows(rows, length, False).join(multi, "ah", "left_semi"), "anchors")
    alike = written(seen.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("d", "tag", "pos")).alias("m")), "contexts")
    mixed = alike.groupBy("ah").agg(F.count("*").alias("kinds")).where("kinds > 1")
    again = alike.where("n > 1").select("ah", "ch")
    whole = seen.join(again, ["ah", "ch"], "left_semi").select("d", "tag", F.greatest(F.lit(0).cast("long"), F.col("pos") - (length - GRAM)).alias("a"), (F.col("pos") + length).alias("b"))
    wanted = alike.join(mixed, "ah").select("ah", "kinds", (F.col("n") > 1).alias("many"), "m.d", "m.tag", "m.pos")
    large = wanted.where(F.col("kinds") > GROUP)
    ctx = _contexts(_packed(rows), wanted.where(F.col("kinds") <= GROUP), length)
    spans = whole.unionByName(_by_suffix_array(ctx, length))
    if not large.isEmpty():
        spans = spans.unionByName(_by_core(written(_contexts(_packed(rows), large, length), "large"), length))
    return written(spans.groupBy("d", "tag").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")  # rows that repeat an id and a text repeat their spans


def _cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of the data, how many bytes went, and in how many runs."""
    kept, at, gone, n = [], 0, 0, 0
    end = -1
    for s in spans or ():
        a, b = s["a"], min(s["b"], len(data))
        if a > end:
            n += 1
            if a > at:
                kept.append(data[at:a])
            end = at = a
        if b > end:
            gone += b - end
            end = at = b
    kept.append(data[at:])
    return b"".join(kept), gone, n


def _joined(docs: DataFrame, length: int, text: str, doc_id: str) -> DataFrame:
    """All columns of the rows, the text compressed as z, with the spans of each."""
    spans = repeated_spans(docs, length, text, doc_id)
    body = F.coalesce(F.col(text), F.lit(""))
    d, tag = _key(docs, body, doc_id)
    own = docs.select(d.alias("_d"), tag.alias("_tag"), F.struct(*[c for c in docs.columns if c != text]).alias("_row"), body.alias("t"))
    packed = _packed(own)
    return packed.join(spans.select(F.col("d").alias("_d"), F.col("tag").alias("_tag"), "spans"), ["_d", "_tag"], "left")


def substring_digests(docs: DataFrame, length: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte goes that lies in a string of ``length`` bytes which also begins
    at any other place, in the same document or another; places are judged on
    the input. A null text is empty. A repeated row is another document, so it
    repeats all its strings; null ids are ids like others. Texts shorter than
    ``length`` lose nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in small_batches(batches):
            n, gone, parts, hexes = [], [], [], []
            for z, spans in zip(b["z"].to_pylist(), b["spans"].to_pylist(), strict=True):
                data = unpack.decompress(z)
                kept, removed, k = _cut(data, spans)
                n.append(len(data))
                gone.append(removed)
                parts.append(k)
                hexes.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b["i"], *(pa.array(x, pa.int64()) for x in (n, gone, parts)), pa.array(hexes, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = _joined(docs, length, text, doc_id).select(F.col(f"_row.`{doc_id}`").alias("i"), "z", "spans")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, all columns, without repeated strings; a character cut in the middle goes whole, and so do emptied documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in small_batches(batches):
            out = [_cut(unpack.decompress(z), s)[0].decode("utf-8", "ignore") for z, s in zip(b["z"].to_pylist(), b["spans"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["_row"], pa.array([not s for s in b["spans"].to_pylist()]), pa.array(out, pa.string())], ["_row", "same", "t"])

    rows = _joined(docs, length, text, doc_id).select("_row", "z", "spans")
    kind = rows.schema["_row"].dataType.simpleString()
    cut = rows.mapInArrow(run, f"_row {kind}, same boolean, t string").where("same or t <> ''")
    return cut.select(*[F.col("t").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
