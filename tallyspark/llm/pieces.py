"""SentencePiece BPE encoding by vectorised merge rounds, and its decoding.

A text is cut where no piece of the vocabulary can reach across; each distinct
part is encoded once in a batch, all parts together in flat numpy arrays: one
symbol array, a segment number per symbol, and rounds that find the best pair
of every segment and merge it, until no pair is left.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import small_batches

SPACE = "▁"
NONE = np.int64(1) << 40
#: Distinct parts whose codes a Python worker keeps; beyond them it starts afresh.
KEPT_PARTS = 250_000
#: Characters of parts that are merged in one set of arrays.
ROUND_CHARS = 1 << 20
#: Parts longer than this are merged but not kept.
LONG_PART = 200
#: Segments of more characters than this are merged at many places in a round.
WIDE = 48


def lowest(x: np.ndarray, left: int, right: int) -> np.ndarray:
    """The least of the values from ``left`` places before each to ``right`` places after it."""
    w = left + right + 1
    low, span = np.concatenate([np.full(left, NONE), x, np.full(max(right, 0), NONE)]), 1
    while span * 2 <= w:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    return low[: len(x)]


class Pieces:
    """The vocabulary of one BPE model with byte fallback, as lookup arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models without a character map and white-space cleaning are known here")
        kinds = proto.trainer_spec
        self.dummy_prefix = norm.add_dummy_prefix
        self.names = [p.piece for p in proto.pieces]
        kind = np.array([p.type for p in proto.pieces])  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
        if (kind == 4).any() or (kind == 5).any():
            raise ValueError("user-defined and unused pieces are not known here")
        self.unk, self.eos = kinds.unk_id, kinds.eos_id
        self.byte_fallback = kinds.byte_fallback
        normal = np.flatnonzero(kind == 1)
        scores = np.array([p.score for p in proto.pieces], dtype=np.float32)
        # rank of a piece: the better its score, the smaller; equal scores share a rank, the leftmost pair is then taken
        levels = -np.unique(-scores[normal])
        self.rank = np.full(len(kind), NONE, np.int64)
        self.rank[normal] = np.searchsorted(-levels, -scores[normal])
        self.id_of = {self.names[i]: int(i) for i in normal}
        self.byte_id = np.zeros(256, np.int64)
        for i in np.flatnonzero(kind == 6):
            self.byte_id[int(self.names[i][3:5], 16)] = i
        # symbols: every piece, then characters that are no piece
        pairs = []
        for i in normal:
            name = self.names[i]
            for cut in range(1, len(name)):
                a, b = self.id_of.get(name[:cut]), self.id_of.get(name[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, int(i)))
        pairs.sort()
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_to = np.array([i for _, i in pairs], np.int64)
        # a merged piece is safe if no pair with it comes before it: then its equal pairs may merge in one round
        self.safe = np.ones(len(kind), bool)
        if pairs:
            to_rank = self.rank[self.pair_to]
            for side in (self.pair_key >> 32, self.pair_key & 0xFFFFFFFF):
                self.safe[side[to_rank <= self.rank[side]]] = False
        self.surface = [b"" if k in (2, 3) else bytes([int(n[3:5], 16)]) if k == 6 else n.replace(SPACE, " ").encode() for n, k in zip(self.names, kind, strict=True)]
        self.kind = kind
        self.single = {c: i for c, i in self.id_of.items() if len(c) == 1}
        inner = {(n[i], n[i + 1]) for n in self.id_of for i in range(len(n) - 1)}
        self.inner = np.array(sorted(ord(x) << 32 | ord(y) for x, y in inner) or [-1], np.int64)
        self.longest = max(map(len, self.id_of), default=1)
        self.level_safe = np.ones(len(levels) + 1, bool)
        self.level_safe[self.rank[normal][~self.safe[normal]]] = False
        self.decimal, self.plain = pa.array([b"%d " % i for i in range(len(kind))], pa.binary()), pa.array(self.surface, pa.binary())
        lead = {a for a, b in inner if b == SPACE}
        self.parts_at_space = lead <= {SPACE}
        # line breaks that stand in no longer piece end a part too
        self.split = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.parts_at_space and not any("\n" in p for p in inner) else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.parts_at_space else "(?s).+")

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_to[at], -1)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and how many each part has."""
        text = "".join(parts)
        if not text:
            return np.empty(0, np.int64), np.zeros(len(parts), np.int64)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, back = np.unique(chars, return_inverse=True)
        # characters outside the vocabulary are negative symbols that nothing merges with
        table = np.array([self.single.get(chr(c), -1 - int(c)) for c in kinds], np.int64)
        part = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        # no piece reaches across two characters that stand side by side in none
        near = chars[:-1].astype(np.int64) << 32 | chars[1:]
        at = np.minimum(np.searchsorted(self.inner, near), len(self.inner) - 1)
        cut = np.r_[True, (part[1:] != part[:-1]) | (self.inner[at] != near)]
        seg = np.cumsum(cut) - 1
        size = np.bincount(seg)
        wide = size[seg] > WIDE
        sym, done = table[back], []
        for mine, rounds in ((~wide, self._segment_rounds), (wide, self._window_rounds)):
            if mine.any():
                done += rounds(sym[mine], seg[mine])
        sym, seg = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(seg, kind="stable")
        sym, part = sym[order], part[np.flatnonzero(cut)][seg[order]]
        sym, part = self._known(sym, part)
        return sym, np.bincount(part, minlength=len(parts))

    def _segment_rounds(self, sym: np.ndarray, seg: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rounds on short segments: each merges its best pair, the leftmost of equals, and drops out when none is left."""
        done = []
        to = self._pairs_at(sym, seg, np.arange(len(sym)))
        while True:
            rank = np.where(to >= 0, self.rank[to], NONE)
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[starts, len(seg)])
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = best < NONE
            if not open_.all():  # compaction: segments without a pair leave the arrays
                done.append((sym[~open_], seg[~open_]))
                sym, seg, to, rank, best = sym[open_], seg[open_], to[open_], rank[open_], best[open_]
                if not len(sym):
                    return done
            hit = np.flatnonzero(rank == best)
            first = np.r_[True, seg[hit][1:] != seg[hit][:-1]]
            # besides the leftmost: the same pair again, where no new pair could come first, and not overlapping
            lead = to[hit][np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
            hit = hit[first | (self.safe[lead] & (to[hit] == lead))]
            sym, seg, to = self._joined(sym, seg, to, self._apart(hit, seg))

    def _window_rounds(self, sym: np.ndarray, seg: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rounds on long segments: a pair merges if it is the best as far as pieces reach to either side.

        All that could take one of its symbols before would have to be built
        within that reach, and nothing there comes before the pair itself.
        """
        to = self._pairs_at(sym, seg, np.arange(len(sym)))
        done, reach = [], self.longest
        while True:
            rank = np.where(to >= 0, self.rank[to], NONE)
            best = lowest(rank, reach, reach)
            live = best < NONE
            if live.sum() * 2 < len(live):  # compaction; a stretch without pairs may be reached by new pieces, so only whole segments leave
                starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                open_ = np.repeat(np.minimum.reduceat(rank, starts) < NONE, np.diff(np.r_[starts, len(seg)]))
                done.append((sym[~open_], seg[~open_]))
                sym, seg, to, rank, best = sym[open_], seg[open_], to[open_], rank[open_], best[open_]
                if not len(sym):
                    return done
            hit = np.flatnonzero((rank == best) & (rank < NONE))
            odd = ~self.level_safe[rank[hit]]
            if odd.any():  # what such a pair makes may come before its equals: it must be the first of them
                before = lowest(rank, reach, -1)
                hit = hit[~odd | (rank[hit] < before[hit])]
            # pairs that overlap merge from the left, so a chain whose head must wait waits whole
            chain = np.r_[True, (hit[1:] != hit[:-1] + 1)]
            waits = (hit > 0) & (rank[np.maximum(hit - 1, 0)] == rank[hit])
            head = np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))
            hit = hit[~(waits & chain)[head]]
            if len(hit) * 256 < live.sum():  # long chains of equal pairs whose pieces come before them, as in runs of one character
                return [*done, self._one_by_one(sym, seg)]
            sym, seg, to = self._joined(sym, seg, to, self._apart(hit, seg))

    def _one_by_one(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single merges in their order, from a heap of ranks and places."""
        made = self.pair_of()
        rank, s, own = self.rank.tolist(), sym.tolist(), seg.tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def entry(i: int) -> int | None:
            j = after[i]
            to = made.get(s[i] << 32 | s[j]) if j < n and own[i] == own[j] and s[i] >= 0 and s[j] >= 0 else None
            return None if to is None else rank[to] << 32 | i

        heap = [e for e in map(entry, range(n)) if e is not None]
        heapq.heapify(heap)
        while heap:
            e = heapq.heappop(heap)
            i = e & 0xFFFFFFFF
            if s[i] is None or entry(i) != e:
                continue
            j = after[i]
            s[i], s[j] = made[s[i] << 32 | s[j]], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (e := entry(k)) is not None:
                    heapq.heappush(heap, e)
        left = np.array([x is not None for x in s])
        return np.array([x for x in s if x is not None], np.int64), seg[left]

    def pair_of(self) -> dict[int, int]:
        if not hasattr(self, "pairs"):
            self.pairs = dict(zip(self.pair_key.tolist(), self.pair_to.tolist(), strict=True))
        return self.pairs

    def _joined(self, sym, seg, to, hit):
        """The arrays after the pairs at ``hit`` have merged; only pairs with a merged symbol change."""
        sym = sym.copy()
        sym[hit] = to[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        moved = np.zeros(len(sym), bool)
        moved[hit] = True
        sym, seg, to, moved = sym[keep], seg[keep], to[keep], moved[keep]
        fresh = np.flatnonzero(moved | np.r_[moved[1:], False])
        to[fresh] = self._pairs_at(sym, seg, fresh)
        return sym, seg, to

    def _pairs_at(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = np.minimum(at + 1, len(sym) - 1)
        out = self.merged(sym[at], sym[nxt])
        out[(nxt == at) | (seg[nxt] != seg[at])] = -1
        return out

    @staticmethod
    def _apart(hit: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Of pairs that overlap in a chain, every second one from the left."""
        new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (seg[hit[1:]] != seg[hit[:-1]])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
        return hit[(np.arange(len(hit)) - start) % 2 == 0]

    def _known(self, sym: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as their bytes, or a run of them as one unknown piece."""
        odd = sym < 0
        if not odd.any():
            return sym, part
        if not self.byte_fallback:
            again = np.r_[False, odd[1:] & odd[:-1] & (part[1:] == part[:-1])]
            return np.where(odd, self.unk, sym)[~again], part[~again]
        chars = (-1 - sym[odd]).astype(np.uint32)
        raw = np.frombuffer(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        size = np.ones(len(sym), np.int64)
        size[odd] = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        out, spread = np.repeat(sym, size), np.repeat(odd, size)
        out[spread] = self.byte_id[raw]
        return out, np.repeat(part, size)

    def parts(self, text: str) -> list[str]:
        """The text as the model sees it, cut where no piece reaches across."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self.split.findall(SPACE + text if self.dummy_prefix else text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, without begin and end ids."""
        cut = [self.parts(t) for t in texts]
        distinct = list(dict.fromkeys(p for ps in cut for p in ps))
        code: dict[str, list[int]] = {}
        for some, ids, n in self._in_rounds(distinct):
            code.update(zip(some, (x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])), strict=True))
        return [[i for p in ps for i in code[p]] for ps in cut]

    def digested(self, parts: list[str]) -> Iterator[tuple[str, int, bytes, bytes]]:
        """Each part with its number of ids, these in decimal with a space after each, and its decoded bytes."""
        for some, ids, n in self._in_rounds(parts):
            cuts = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            said = (pc.binary_join(pa.ListArray.from_arrays(cuts, x.take(pa.array(ids))), b"").to_pylist() for x in (self.decimal, self.plain))
            yield from zip(some, n.tolist(), *said, strict=True)

    def _in_rounds(self, parts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        some, size = [], 0
        for p in parts:
            some.append(p)
            size += len(p)
            if size >= ROUND_CHARS:
                yield some, *self.encode_parts(some)
                some, size = [], 0
        if some:
            yield some, *self.encode_parts(some)

    def decode_bytes(self, ids) -> bytes:
        """The decoded text in UTF-8: control ids say nothing, byte pieces join, the first space goes if the model adds one."""
        ids = [i for i in ids if self.kind[i] != 3]
        out, run = [], bytearray()
        for i in ids:
            if self.kind[i] == 6:
                run += self.surface[i]
                continue
            out.append(bytes(run).decode("utf-8", "replace").encode())
            run = bytearray()
            out.append(" ⁇ ".encode() if self.kind[i] == 2 else self.surface[i])
        out.append(bytes(run).decode("utf-8", "replace").encode())
        text = b"".join(out)
        return text[1:] if self.dummy_prefix and ids and self.names[ids[0]].startswith(SPACE) else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_texts(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document row: doc_id and ``ids``, the ids with an end id. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for b in small_batches(batches):
            got = [ids + [m.eos] for ids in m.encode([t or "" for t in b["t"].to_pylist()])]
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.selectExpr(f"`{doc_id}` as i", f"`{text}` as t").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and ``text``, decoded from ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for b in small_batches(batches):
            got = [None if x is None else m.decode_bytes(x).decode() for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(got, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one; repeated rows each give a row, a null id is
    kept. Texts are encoded whole. Digests are fed part by part: neither the
    list of ids nor the decoded text of a very long document is built.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        end = str(m.eos).encode()
        code: dict[str, list] = {}
        for b in small_batches(batches):
            texts = [t or "" for t in b["t"].to_pylist()]
            cut = [m.parts(t) for t in texts]
            missing = [p for p in {p for ps in cut for p in ps} if p not in code]
            if len(code) + len(missing) > KEPT_PARTS:
                code.clear()
                missing = list({p for ps in cut for p in ps})
            for p, *said in m.digested(missing):  # no character's bytes lie in two parts, so a part decodes by itself
                code[p] = said
            n, ids_hex, text_hex = [], [], []
            for ps in cut:
                got = [code[p] for p in ps]
                n.append(sum(x[0] for x in got) + 1)
                ids_hex.append(hashlib.sha256(b"".join(x[1] for x in got) + end).hexdigest())
                plain = b"".join(x[2] for x in got)
                text_hex.append(hashlib.sha256(plain[1:] if m.dummy_prefix and plain[:1] == b" " else plain).hexdigest())
            for p in missing:
                if len(p) > LONG_PART:
                    code.pop(p, None)
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr(f"`{doc_id}` as i", f"`{text}` as t").mapInArrow(run, out)
