"""A ledger of files and their schemas, so that a tree of drifting files is looked through once.

Each load lists the tree, takes what the ledger does not hold yet by an
anti-join, reads only the footers of those files, in tasks and through Spark's
own file layer, and appends them. Files are read in groups of one schema.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

LEDGER = "path string, mtime timestamp, size long, kind string, load long"
#: Files whose paths are in the driver at once.
SLICE = 4096


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a tree: path, mtime and size, without a look inside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def footers(files: DataFrame) -> DataFrame:
    """path, mtime, size and schema of binary files; only a file's footer leaves the JVM."""
    # the last eight bytes are the footer's length, little-endian, and a magic word
    n = F.expr("int(conv(concat(hex(substring(content, -5, 1)), hex(substring(content, -6, 1)), hex(substring(content, -7, 1)), hex(substring(content, -8, 1))), 16, 10))")
    tail = F.expr("substring(content, -(_n + 8), _n + 8)")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [pq.read_schema(pa.BufferReader(b"PAR1" + t)).remove_metadata().to_string() for t in b["tail"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["path"], b["mtime"], b["size"], pa.array(kinds, pa.string())], ["path", "mtime", "size", "kind"])

    rows = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content").withColumn("_n", n).withColumn("tail", tail)
    return rows.select("path", "mtime", "size", "tail").mapInArrow(read, "path string, mtime timestamp, size long, kind string")


def held(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def _slices(rows: Iterator, size: int) -> Iterator[list]:
    while some := list(islice(rows, size)):
        yield some


def extend(spark: SparkSession, path: str, ledger: str, size: int = SLICE) -> int:
    """Enter the files of a tree that the ledger lacks, or that have changed since; the number of this load, or 0 if there is nothing new."""
    known = held(spark, ledger)
    keys = ["path", "mtime", "size"]
    new = listed(spark, path).join(known.select(*keys), keys, "left_anti")
    load = (known.agg(F.max("load")).first()[0] or 0) + 1
    files = spark.read.format("binaryFile")
    number = F.lit(load).cast("long").alias("load")
    if load == 1:
        footers(files.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)).select("*", number).write.mode("append").parquet(ledger)
        return 0 if held(spark, ledger).isEmpty() else 1
    any_ = False
    for some in _slices(new.select("path").toLocalIterator(), size):
        footers(files.load([r["path"] for r in some])).select("*", number).write.mode("append").parquet(ledger)
        any_ = True
    return load if any_ else 0


def load_drifting(spark: SparkSession, source: str, store: Store, table: str, ledger: str, size: int = SLICE) -> int:
    """Bring a published table up to a tree of drifting files; the number of files read.

    The first call reads all files, a later one those that came since: they
    become further parts of the table, united with the others by column name
    when it is read. If a file of an earlier load has changed or vanished, the
    table is built anew from all files that are there. Files are read in slices
    of one schema, so neither the driver nor a row ever holds the list of a
    large tree, and new parts are published at once, after the last slice. A
    load that stops half-way has published nothing, and the next one reads what
    it would have read.
    """
    keys = ["path", "mtime", "size"]
    first, last = store.current()[1]["state"].get(f"loads of {table}", [0, 0])
    own = held(spark, ledger).where(F.col("load").between(first, last))
    anew = not own.join(listed(spark, source), keys, "left_anti").isEmpty()
    extend(spark, source, ledger, size)
    there = held(spark, ledger).join(listed(spark, source), keys, "left_semi")
    newest = held(spark, ledger).agg(F.max("load")).first()[0] or 0
    if anew:
        newest += 1
        there.dropDuplicates(keys).withColumn("load", F.lit(newest).cast("long")).write.mode("append").parquet(ledger)
        first, last = newest, newest - 1
    todo = held(spark, ledger).where(F.col("load") > last).join(listed(spark, source), keys, "left_semi")
    parts: dict[str, str] = {}
    count = 0
    for kind, rows in groupby(todo.select("kind", "path").orderBy("kind", "path").toLocalIterator(), key=lambda r: r["kind"]):
        for some in _slices(rows, size):
            parts[kind] = store.build(table, spark.read.parquet(*[r["path"] for r in some]), part=parts.get(kind))
            count += len(some)
    if count or anew:
        store.publish({table: list(parts.values())}, add=not anew, state={f"loads of {table}": [first or 1, newest]})
    return count
