"""Token counts through a cache of content digests.

The cache holds one row per (content digest, tokenizer digest). A count joins
the documents' digests to it, encodes each text that it lacks once, whatever
number of documents hold that text, and appends what it has encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir, small_batches

#: Texts of these characters alone are split alike by both libraries' patterns; any other text goes to the tokenizers library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞]*")
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others are numbered from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to token counts, as the library for the file gives them."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    slow = lambda text: len(lib.encode(text, add_special_tokens=False).ids)
    fast = _rank_encoding(spec)
    if fast is None:
        return lambda texts: [slow(t) for t in texts]

    def count(text: str) -> int:
        if PLAIN.fullmatch(text):
            try:
                return len(fast.encode(text, allowed_special="all"))
            except ValueError:  # its pattern engine gives up on very long runs of white space
                pass
        return slow(text)

    return lambda texts: [count(t) for t in texts]


def _rank_encoding(spec: dict):
    """The same vocabulary for the library that counts by merge ranks, where the file is a plain byte-level BPE; else None."""
    try:
        import tiktoken
        from public_tokenizers import PATTERN
    except ImportError:
        return None
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    added = spec.get("added_tokens", [])
    if not plain or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    to_byte = _byte_of_char()
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    # the merge order must be the order of ids: then ranks and merges say the same
    order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if order != sorted(order):
        return None
    return tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _read_cache(spark, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", doc_id: str = "doc_id", limit: int = 1024) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is the path of a Parquet table that may not exist yet; without
    one, a new cache is begun in the shared folder. A null text counts as an
    empty one. Repeated rows, and rows that share a text, are encoded once and
    each get a result row; a null id is kept. A job that is run again after a
    failed append may leave a count twice in the cache; readers take one.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body, 256))
    dig = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), digest.alias("content"))
    wanted = dig.groupBy("content").agg(F.min("doc_id").alias("rep"))
    known = _read_cache(spark, cache)
    if known is not None:
        wanted = wanted.join(known.where(F.col("tokenizer") == version), "content", "left_anti")
    where = cache or f"{shared_dir(spark)}/tables/token-cache-{uuid.uuid4().hex}"
    # one row of one document of each missing digest; narrow rows decide, only its text moves, once
    key = lambda c: [F.isnull(c).alias("_none"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_id")]
    held = docs.select(*key(doc_id), body.alias("body"), digest.alias("content")).groupBy("content", "_none", "_id").agg(F.first("body").alias("body"))
    misses = held.join(wanted.select("content", *key("rep")), ["content", "_none", "_id"], "left_semi").select("content", "body")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in small_batches(batches):
            n = count(b["body"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["content"], pa.array([version] * b.num_rows, pa.string()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(where)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(where).where(F.col("tokenizer") == version)
    stored = stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return dig.join(stored, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
