"""Large keys dealt into ranges of their order, so that one key is many tasks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which a key is dealt into ranges, and into how many; a key below a fixed share of all rows is never dealt, which bounds how many are.
LARGE, PARTS, SHARE = 1_000_000, 64, 4096

#: Rows that a task of a large table has, whatever the table's size; and rows of a dimension that every task may hold.
EACH, FEW = 250_000, 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str, each: int = EACH) -> DataFrame:
    """The rows dealt by ``keys`` over as many tasks as a table of ``rows`` rows needs, where that is more than a shuffle has; steps by these keys, or by more, then need no shuffle."""
    tasks = -(-rows // each)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def ranged(df: DataFrame, keys: list[str], by: str, large: int = LARGE, parts: int = PARTS) -> tuple[DataFrame, bool]:
    """The rows with ``_range``, which grows with ``by`` within a key, and whether any key has more than one range.

    Only keys of more than ``large`` rows, and of more than one in 4,096 of all
    rows, have several: their cuts, a bounded table, come to the driver once,
    so every use of the result sees the same ranges. Rows with equal ``by``
    stay in one range; nulls are in the first. ``by`` is a number, day or time.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    most, rows = counts.agg(F.max("_n"), F.sum("_n")).first()
    least = max(large, (rows or 0) // SHARE)
    if (most or 0) <= least:
        return df.withColumn("_range", F.lit(0)), False
    alias = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    equal = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    hot = counts.where(F.col("_n") > least).select(*alias)  # fewer than one row a share
    cuts = df.join(F.broadcast(hot), equal).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
    out = df.join(F.broadcast(cuts), equal, "left")
    place = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.col(by)))
    return out.withColumn("_range", F.when(F.col("_cuts").isNull() | F.col(by).isNull(), 0).otherwise(place)).drop("_cuts", *[f"_k{i}" for i in range(len(keys))]), True


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, large: int = LARGE) -> DataFrame:
    """Each row's place within its key, from 1; a large key is put in order range by range, and the ranges' sizes are added up."""
    rows, split = ranged(df, keys, order[0], large)
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)).cast("long")
    if not split:
        return rows.withColumn(name, place).drop("_range")
    own = [*keys, "_range"]
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    sizes = rows.groupBy(*own).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_of_{c}") for c in own], F.coalesce(before, F.lit(0)).alias("_before"))
    met = rows.withColumn(name, place).join(sizes, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in own]))
    return met.withColumn(name, F.col(name) + F.col("_before")).drop("_before", *[c for o in own for c in (f"_of_{o}",)], "_range")
