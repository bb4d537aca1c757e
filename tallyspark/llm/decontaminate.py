"""Benchmark decontamination with DataFrame operations only.

The windows of all benchmark items become a small set of hashes that is
broadcast after a check of its size; the documents' windows are hashed in
place, probed against the set, and every hit is verified word by word. A larger
set is joined by shuffle: then only places and hashes move, and words follow
for the places that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, written

#: What stands between words of lower-cased text; splitting there takes a fifth of the time of extracting words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The words in text that still has its capitals.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows that are broadcast at most, and their bytes; a larger set is joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Words of a window that are probed first.
PREFIX = 4


def words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct (item, len, h, win): every n consecutive words of an item; a shorter item, unless empty, is one window."""
    items = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(n))
    at = items.select("item", "ws", size.alias("len"), F.explode(F.sequence(F.lit(0), F.size("ws") - size)).alias("at"))
    win = at.select("item", "len", F.slice("ws", F.col("at") + 1, F.col("len")).alias("win"))
    return win.select("item", "len", F.xxhash64("win").alias("h"), "win").distinct()


def _places(each: Column, sizes: list[int], wanted=None) -> Column:
    """Runs of each of these numbers of words, given as hashes, as (at, m, p), p the run's hash; a run of none stands once, at -1.

    ``wanted``: a test that p must pass.
    """

    def runs(m: int) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(each) - m), lambda i: F.struct(i.alias("at"), F.lit(m).alias("m"), F.xxhash64(F.slice(each, i + 1, F.lit(m))).alias("p")))
        return F.when(F.size(each) >= m, some if wanted is None else F.filter(some, lambda x: wanted(x["p"])))

    none = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("m"), F.lit(0).cast("long").alias("p")))
    return F.concat(none, *[F.coalesce(runs(m), F.slice(none, 1, 0)) for m in sizes])


def _marked(hashes: list[int]):
    """A test that all these hashes pass and about one in 32 of others: a bit table, as an array that stands in the plan."""
    size = 1 << max(10, (len(hashes) // 2).bit_length())
    table = [0] * size
    for h in hashes:
        table[h >> 6 & size - 1] |= 1 << (h & 63)
    bits = F.split(F.lit(",".join(str(x - (x >> 63 << 64)) for x in table)), ",").cast("array<long>")

    def test(p: Column) -> Column:
        word = F.element_at(bits, (F.shiftright(p, 6).bitwiseAND(F.lit(size - 1)) + 1).cast("int"))
        return F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def hits(docs: DataFrame, windows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Verified occurrences: key columns, at (first word, from 0), len, h, win, n_words; and a row of each document with at -1, len 0 and an empty win.

    Every place of a text is probed with the hash of its first words; only
    where that meets is the whole window taken and compared.
    """
    spark = docs.sparkSession
    m = F.least("len", F.lit(PREFIX))
    sure = windows.select("len", "h", "win").distinct()
    begin = sure.select(m.alias("m"), F.xxhash64(F.transform(F.slice("win", F.lit(1), m), lambda w: F.xxhash64(w))).alias("p"), "len").distinct()
    sizes = sorted(r[0] for r in begin.select("m").distinct().collect())  # at most PREFIX of them
    n, size = sure.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0))).first()
    ws = docs.select(*key, words(F.col(text)).alias("ws")).withColumn("each", F.transform("ws", lambda w: F.xxhash64(w)))
    size_of = F.size("ws").cast("long").alias("n_words")
    win = lambda ws, at: F.slice(ws, at, F.col("len")).alias("win")
    if n <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES:
        none, longest = F.array().cast("array<string>"), sure.agg(F.max("len")).first()[0] or 0
        found = _places(F.col("each"), sizes, _marked([r["p"] for r in begin.select("p").distinct().collect()]))
        one = spark.range(1)
        begin = begin.unionByName(one.select(F.lit(0).alias("m"), F.lit(0).cast("long").alias("p"), F.lit(0).alias("len")))
        sure = sure.unionByName(one.select(F.lit(0).alias("len"), F.xxhash64(none).alias("h"), none.alias("win")))
        # no row holds more of a text than a window
        placed = ws.withColumn("x", found).select(*key, size_of, F.explode(F.transform("x", lambda x: F.struct(x["at"].alias("at"), x["m"].alias("m"), x["p"].alias("p"), F.slice("ws", F.greatest(x["at"], F.lit(0)) + 1, F.lit(longest)).alias("head")))).alias("x"))
        near = placed.select(*key, "n_words", "x.*").join(F.broadcast(begin), ["m", "p"]).where(F.col("len") <= F.size("head"))
        near = near.select(*key, "at", "len", "n_words", win("head", F.lit(1))).withColumn("h", F.xxhash64("win"))
        return near.join(F.broadcast(sure), ["len", "h", "win"], "left_semi")
    placed = ws.select(*key, F.size("ws").alias("n"), F.explode(_places(F.col("each"), sizes)).alias("x")).select(*key, "n", "x.*")
    near = placed.join(begin, ["m", "p"]).where(F.col("at") + F.col("len") <= F.col("n"))
    asked = near.groupBy(*key).agg(F.collect_set(F.struct("at", "len")).alias("asked"))
    both = asked.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(key)], "asked")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(key)]
    each = ws.join(both, same).select(*key, "ws", F.explode("asked").alias("x")).select(*key, "ws", "x.*")
    each = each.select(*key, "at", "len", size_of, win("ws", F.greatest("at", F.lit(0)) + 1)).withColumn("h", F.xxhash64("win"))
    whole = ws.select(*key, F.lit(-1).alias("at"), F.lit(0).alias("len"), size_of, F.array().cast("array<string>").alias("win"))
    return each.join(sure, ["len", "h", "win"], "left_semi").unionByName(whole.withColumn("h", F.xxhash64("win")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", doc_id: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document without text has no words. Rows with the same id and text are
    equal and get equal results, each in its own row; a null id is a value like
    any other. Items without words have no windows; several items may share
    one. An item without an id marks words, but stands in no list. Other
    columns of either table are not read.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("k"), F.col(text).alias("text"))
    wins = written(benchmark_windows(benchmark, n, text, item), "windows")
    found = written(hits(d, wins, ["doc_id", "k"]), "hits")  # read three times
    hit = found.where("at >= 0").distinct()
    # words inside any hit: what each hit adds beyond the hits that begin before it
    ahead = Window.partitionBy("doc_id", "k").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    spans = hit.groupBy("doc_id", "k", "at").agg(F.max("len").alias("len"))
    cover = spans.withColumn("seen", F.coalesce(F.max(end).over(ahead), F.lit(0)))
    cover = cover.groupBy("doc_id", "k").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("at", "seen"))).alias("n_hit"))
    which = hit.select("doc_id", "k", "len", "h", "win").distinct().join(wins, ["len", "h", "win"]).where("item is not null")
    which = which.groupBy("doc_id", "k").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    which = which.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k"))
    both = cover.join(which, same, "left").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "n_hit", "items")
    out = found.where("at = -1").select("doc_id", "k", "n_words").join(both, same, "left")
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without what they share with the benchmark: ``documents`` drops whole rows, ``spans`` cuts the hit words.

    The columns of ``docs`` stay. In the mode ``spans``, the separators between cut words stay.
    """
    key = [F.col(doc_id).alias("_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_k")]
    wins = written(benchmark_windows(benchmark, n), "windows")
    hit = hits(docs.select(*key, F.col(text).alias("text")), wins, ["_id", "_k"]).where("at >= 0").select("_id", "_k", "at", "len").distinct()
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.coalesce(F.xxhash64(text), F.lit(0)) == F.col("_k"))
    if mode == "documents":
        return docs.join(hit.select("_id", "_k").distinct(), same, "left_anti")
    at = hit.groupBy("_id", "_k").agg(F.collect_set(F.struct("at", "len")).alias("_spans"))
    out = docs.join(at, same, "left")
    ws = F.regexp_extract_all(F.col(text), F.lit(WORD_ANY_CASE), F.lit(0))
    gaps = F.split(F.col(text), WORD_ANY_CASE, -1)
    inside = lambda i: F.exists("_spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["len"]))
    kept = F.transform(ws, lambda w, i: F.when(inside(i), F.lit("")).otherwise(w))
    cut = F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return out.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut)).select(*docs.columns)
