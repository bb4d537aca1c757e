"""What the operators share: written intermediate tables, connected components, text columns."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one is set only where none is configured and all run on one machine, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


#: Paths of the tables that the innermost ``scratch`` has to delete.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: a lost executor costs no more than its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    if (own := _made.get()) is not None:
        own.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete a table of ``written``, or of rows of one, that is not read again."""
    path = getattr(df, "_path", None)
    if path is None and (files := df.inputFiles()):
        path = files[0].rsplit("/", 1)[0]
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables written within are deleted at the end, also if it fails, but for those that the function given is called with."""
    own, kept, outer = [], set(), _made.get()
    token = _made.set(own)
    try:
        yield lambda *tables: kept.update(t._path for t in tables)
    finally:
        _made.reset(token)
        for path in own:
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def sweep(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark deletes the shuffle files of steps that have ended."""
    spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: how the queries deal rows into folds (a null id has no fold)."""
    return F.crc32(id_col.cast("string")) % n


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each vertex of ``edges``: columns ``id`` and ``component``.

    Large-star and small-star rounds: each round is two aggregations and joins
    by vertex; neighbour lists are never gathered, so a vertex with very many
    neighbours is only a skewed join key, which adaptive execution splits.
    Each round is written to the shared folder. Null ends are ignored; an empty
    table gives an empty table.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    # every edge as (larger, smaller)
    cur = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before, last = None, None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u itself, is tied to the least neighbour
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        if last is not None:
            forget(last)
        last, cur = cur, written(nxt, "cc")
        state = cur.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out._path = cur._path
    return out


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Each value of a column that is not null, as ``key``, with a number ``_no`` that grows with it; written, so that the numbers stay."""
    ids = df.select(F.col(key).alias("key")).where("key is not null").distinct()
    return written(ids.repartitionByRange("key").sortWithinPartitions("key").withColumn("_no", F.monotonically_increasing_id()), "numbers")


def small_batches(batches, rows: int = 256):
    """Arrow batches cut to few rows, so that work arrays stay small whatever the batch size is."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def dealt(*cols) -> Column:
    """A number from 0 to 1 for each row, by a hash of the columns: equal rows have equal numbers."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *cols), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, most: int, *by: str) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the columns ``by``, which should be distinct; all rows where there are no more than that."""
    n = df.count()
    return df if n <= most else df.where(dealt(*by) < most / n)
