"""Incremental ingest: units that have landed are skipped, by keys or by a stream's checkpoint."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_units(incoming: DataFrame, landed: DataFrame, key: list[str]) -> DataFrame:
    """Rows of units that have not landed yet."""
    return incoming.join(landed.select(*key).distinct(), key, "left_anti")


def complete_scopes(expected: DataFrame, landed: DataFrame, scope: list[str], unit: list[str]) -> DataFrame:
    """Scopes all of whose expected units have landed."""
    there = landed.select(*scope, *unit).distinct().withColumn("_there", F.lit(True))
    seen = expected.join(there, [*scope, *unit], "left").groupBy(*scope).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("_all"))
    return seen.where("_all").select(*scope)


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema, max_files: int = 1000) -> None:
    """Append all files that came since the last call, exactly once, and stop."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).parquet(source)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


class Scopes:
    """Landed units of scopes, and a marker for each scope all of whose expected units have landed.

    Three tables below ``store``: ``landed`` (one row a unit, once, with the
    batch that brought it), ``progress`` (how many new units a batch brought to
    a scope) and ``markers``. Each batch writes a part of its own of each, named
    by its number, and reads only the parts of earlier batches; so a batch that
    is run again after a stop writes what it wrote before, and a marker stands
    in exactly one part.
    """

    def __init__(self, spark: SparkSession, store: str, expected: DataFrame, scope: list[str], unit: list[str]):
        self.spark, self.store, self.scope, self.unit = spark, store.rstrip("/"), scope, unit
        self.expected = expected.select(*scope, *unit).distinct()
        fields = self.expected.schema.fields
        self.kinds = {"landed": T.StructType(fields), "progress": T.StructType([*fields[: len(scope)], T.StructField("new", T.LongType())]), "markers": T.StructType(fields[: len(scope)])}

    def table(self, name: str) -> DataFrame:
        """A table with the batch of each row; empty before the first batch."""
        kind = T.StructType([*self.kinds[name].fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(kind).option("basePath", f"{self.store}/{name}").parquet(f"{self.store}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], kind)

    def _put(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.store}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: its new units, what they add to their scopes, and the scopes that they complete. Units that are not expected count for nothing."""
        before = lambda name: self.table(name).where(F.col("batch") < batch_id).drop("batch")
        both = [*self.scope, *self.unit]
        fresh = batch.select(*both).distinct().join(self.expected, both, "left_semi").join(before("landed"), both, "left_anti")
        fresh = self._put(fresh, "landed", batch_id)
        new = self._put(fresh.groupBy(*self.scope).agg(F.count("*").alias("new")), "progress", batch_id)
        # only the scopes that this batch touches are counted
        touched = before("progress").join(new.select(*self.scope), self.scope, "left_semi").unionByName(new)
        have = touched.groupBy(*self.scope).agg(F.sum("new").alias("_have"))
        wanted = self.expected.join(new.select(*self.scope), self.scope, "left_semi").groupBy(*self.scope).agg(F.count("*").alias("_want"))
        whole = have.join(wanted, self.scope).where("_have = _want").select(*self.scope)
        self._put(whole.join(before("markers"), self.scope, "left_anti"), "markers", batch_id)

    def markers(self) -> DataFrame:
        """The scopes that are complete, with the batch that completed each."""
        return self.table("markers")

    def open(self, rows: DataFrame) -> DataFrame:
        """Rows whose scope is not complete yet: what is left to fetch."""
        return rows.join(self.markers().select(*self.scope), self.scope, "left_anti")


def complete_stream(scopes: Scopes, source: str, checkpoint: str, schema, max_files: int = 1000, apply=None) -> None:
    """Take all files that came to ``source`` since the last call, and mark the scopes that they complete; a call after a stop goes on where the last one ended.

    ``apply(batch, batch_id)`` is called first with each micro-batch, to land its rows; it must be repeatable.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if apply is not None:
            apply(batch, batch_id)
        scopes.apply(batch, batch_id)

    upsert_stream(scopes.spark, source, checkpoint, schema, each, max_files)


def upsert_stream(spark: SparkSession, source: str, checkpoint: str, schema, apply, max_files: int = 1000) -> None:
    """All files that came since the last call, each micro-batch handed to ``apply(batch, batch_id)``, which must be repeatable."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
