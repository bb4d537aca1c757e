"""The operators bound to the verification tables, each with the SQL that says the same.

``b1``: orders as facts (customer, order, October season, priority as opponent,
nation as group, status F as won). ``b2``: events as facts (user, event, day).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import season_of
from ..operators.ranges import dealt
from ..operators.relation import Rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """How many rows a table has, from its files' footers."""
        return getattr(self, name).count()

    def b1(self) -> Rel:
        o = self.orders.join(self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return Rel(o.select(
            F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("entity"), season_of(F.col("o_orderdate")).alias("season"),
            F.when(F.col("o_orderstatus") == "P", 3).otherwise(2).alias("season_type"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("day"),
            F.col("o_orderpriority").alias("opponent"), F.col("c_nationkey").alias("group"), (F.col("o_orderstatus") == "F").alias("won"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        ))

    def b2(self) -> Rel:
        return Rel(self.events.select(
            F.col("event_id").alias("event"), F.col("user_id").alias("entity"), "ts", F.to_date("ts").alias("day"), F.weekofyear("ts").cast("long").alias("season"),
            F.col("event_type").alias("group"), (F.col("event_type") == "purchase").alias("won"), F.col("value").cast("decimal(18,2)").alias("value"), "props",
        ))

    def lines(self) -> DataFrame:
        """Order lines as child events, with exact amounts and their order's season."""
        l = self.lineitem  # noqa: E741
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        return l.select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("period"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"), price.alias("amount"), F.col("l_discount").cast("decimal(18,2)").alias("discount"), F.to_date("l_shipdate").alias("shipped"), F.col("l_returnflag").alias("flag"))

    def lines_by_event(self, *columns: str) -> DataFrame:
        """Lines, or some columns of them, dealt by their order over tasks of a bounded size."""
        l = self.lines()  # noqa: E741
        return dealt(l.select(*columns) if columns else l, self.rows("lineitem"), "event")


B1 = """b1 AS (SELECT o_orderkey AS event, o_custkey AS entity, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS season,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END AS INTEGER) AS season_type, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS opponent, c_nationkey AS "group",
  o_orderstatus = 'F' AS won, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders JOIN customer ON o_custkey = c_custkey)"""
B2 = """b2 AS (SELECT event_id AS event, user_id AS entity, ts, CAST(ts AS DATE) AS day, CAST(weekofyear(ts) AS BIGINT) AS season, event_type AS "group",
  event_type = 'purchase' AS won, CAST(value AS DECIMAL(18,2)) AS value, props FROM events)"""
LINES = """ln AS (SELECT l_orderkey AS event, l_partkey AS part, l_suppkey AS supp, l_linenumber AS period, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
  CAST(l_discount AS DECIMAL(18,2)) AS discount, CAST(l_shipdate AS DATE) AS shipped, l_returnflag AS flag FROM lineitem)"""


def bound(sql: str | None = None, name: str | None = None):
    """Register a query: a function of the tables, and its SQL with the common tables b1, b2 and ln put before it as it needs them."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[key].__name__ = key
        if sql is not None:
            own = [c for n, c in (("b1", B1), ("b2", B2), ("ln", LINES)) if re.search(rf"\b{n}\b", sql)]
            body = sql.strip()
            rest = body[5:] if body[:5].upper() == "WITH " else None
            if rest is not None and rest[:10].upper() == "RECURSIVE ":
                ORACLES[key] = "WITH RECURSIVE " + ", ".join([*own, rest[10:]])
            elif rest is not None:
                ORACLES[key] = "WITH " + ", ".join([*own, rest])
            else:
                ORACLES[key] = ("WITH " + ", ".join(own) + " " if own else "") + body
        return f

    return put


def as_double(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, as results show them."""
    return df.withColumns({c: F.col(c).cast("double") for c, k in df.dtypes if k.startswith("decimal")})
