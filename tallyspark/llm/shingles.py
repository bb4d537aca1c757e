"""Words and word shingles of texts as 64-bit hashes, in numpy and Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch, one after the other, and how many each text has; a null text has none.

    Words are what ASCII white space leaves apart, A-Z in lower case.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(full))
    return flat, counts


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Index of each word among the distinct ones, and these."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def word_hashes(words: list[str]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a text of fewer words, but not none, is one shingle."""
    flat, counts = split_words(texts)
    idx, words = coded(flat)
    h = word_hashes(words)[idx] if len(words) else np.empty(0, np.uint64)
    ends = np.cumsum(counts)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), np.uint64)
        for j in range(k):  # position-dependent, so that the order of the words counts
            rolled[: max(0, len(h) - j)] += mix(h[j:] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1))
        for n, end in zip(counts, ends, strict=True):
            if n >= k:
                out.append(np.unique(mix(rolled[end - n : end - k + 1])))
            elif n:
                part = sum((mix(h[end - n + j : end - n + j + 1] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1)) for j in range(n)), np.zeros(1, np.uint64))
                out.append(mix(part + np.uint64(n)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
