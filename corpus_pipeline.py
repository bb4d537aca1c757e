"""A corpus from raw documents: known language, no near copies, no repeated passages, no benchmark, encoded.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it kept; all but the last return the columns of ``documents``. Null
texts and ids, repeated rows and empty tables are rows like any other; each
stage says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, language_id, near_dedup, pieces, suffix_dedup
from tallyspark.llm._common import forget, scratch, written
from tallyspark.llm.queries import LENGTH, NGRAM, table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told, null or without a letter, go; a missing language is filled in, if there are labels to learn from."""
    out = language_id.identify(docs.select(*COLUMNS), language_id.train(docs), keep=True)
    return out.where("lang_pred is null or lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id; of rows with the same id and text, or no id and the same text, one stays."""
    keep = near_dedup.near_duplicates(docs, k=5, similarity="0.8").where("kept").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.where("doc_id is not null").join(keep, F.col("doc_id") == F.col("_id"), "left_semi")
    both = named.unionByName(docs.where("doc_id is null"))
    # of one id there are few texts; two hashes tell texts apart
    return both.withColumn("_1", F.xxhash64("text")).withColumn("_2", F.xxhash64(F.lit("again"), "text")).dropDuplicates(["doc_id", "_1", "_2"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in several places are cut out, each of their copies; a document of nothing else goes. Null texts stay."""
    out = suffix_dedup.remove_repeats(docs, LENGTH)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), NGRAM).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: the number and digest of its ids, and the digest of what they decode to; a null text is an empty one."""
    return pieces.piece_digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("suffix-array dedup", repeats), ("benchmark decontamination", benchmark), ("SentencePiece encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again; what a stage needed on its way, and the stage before it, is deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep(docs)
        if last is not None:
            forget(last)
        last = docs
    return docs
