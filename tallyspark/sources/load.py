"""Loading: drifting Parquet trees, publishing, partial reloads, manifests, upserts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ledger
from .store import Store, united


def by_schema(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a tree by the schema in their footers, which tasks read. Paths come to the driver one after the other, as the file index of a scan needs them there; for a tree too large for that, see ``ledger.load_drifting``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    rows = ledger.footers(files).select("kind", "path").orderBy("kind", "path").toLocalIterator()
    return sorted([r["path"] for r in own] for _, own in groupby(rows, key=lambda r: r["kind"]))


def read_drifting(spark: SparkSession, path: str, promote: dict[str, str] | None = None, groups: list[list[str]] | None = None) -> DataFrame:
    """All files of a tree as one table by column name, types promoted, directory names ignored.

    Files are read once for each distinct schema. ``groups`` names the files
    that share a schema, where a writer knows them; otherwise footers tell.
    """
    if groups is None:
        groups = by_schema(spark, path)
    return united([spark.read.option("recursiveFileLookup", "true").parquet(*g) for g in groups], promote)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside the table's old rows, then point to the new ones: a reader (``read``) sees the old table or the new one whole, and a failed write changes nothing."""
    store = Store(df.sparkSession, path)
    store.publish({"rows": [store.build("rows", df, partition_by)]})


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table as ``publish`` last left it."""
    return Store(spark, path).read("rows")


def load(spark: SparkSession, source: str, target: str, tables: list[str], derived: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], only: list[str] | None = None) -> dict[str, DataFrame]:
    """Rebuild the named base tables, or all, then every derived table in its order; all of them become current at once, in the end."""
    store = Store(spark, target)
    parts = {t: [store.build(t, read_drifting(spark, f"{source}/{t}"))] for t in only or tables}
    now = store.current()[1]["tables"]
    have = {t: united([spark.read.parquet(f"{target}/{t}/{p}") for p in parts.get(t) or now[t]]) for t in tables}
    for name, step in derived:
        parts[name] = [store.build(name, step(have))]
        have[name] = spark.read.parquet(f"{target}/{name}/{parts[name][0]}")
    store.publish(parts)
    return have


def write_rows(spark: SparkSession, rows: list[dict], schema: str, path: str) -> None:
    """A few ragged records made on the driver, as in tests, to Parquet (``load_rows`` is for landed files); a missing key is null, a key outside the schema an error."""
    kind = T._parse_datatype_string(schema)
    known = set(kind.names)
    if extra := {k for r in rows for k in r} - known:
        raise ValueError(f"unknown columns {sorted(extra)}")
    spark.createDataFrame([tuple(r.get(c) for c in kind.names) for r in rows], kind).write.mode("append").parquet(path)


def load_rows(spark: SparkSession, landed: str, schema: str, path: str) -> None:
    """Landed JSON lines of ragged records to Parquet, read and checked by tasks; a missing key is null, a key outside the schema an error."""
    kind = T._parse_datatype_string(schema)
    keys = spark.read.text(landed).select(F.explode(F.json_object_keys("value")).alias("k")).distinct()
    extra = sorted(r["k"] for r in keys.where(~F.col("k").isin(kind.names)).limit(20).collect())
    if extra:
        raise ValueError(f"unknown columns {extra}")
    spark.read.schema(kind).json(landed).write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New keys and new values win; old keys stay, and a value that the new row lacks stays too."""
    values = [c for c in old.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in values])
    return old.join(n, key, "full").select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a tree with their time and size; the table is the first folder below the path."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").split(":")[-1]
    return listed.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.regexp_extract("path", rf"\Q{base}\E/+([^/]+)", 1).alias("table"))


def changed_tables(now: DataFrame, before: DataFrame) -> DataFrame:
    """Tables with a file that is new, changed or gone."""
    cols = ["table", "path", "mtime", "size"]
    a, b = now.select(*cols), before.select(*cols)
    return a.exceptAll(b).select("table").union(b.exceptAll(a).select("table")).distinct()
