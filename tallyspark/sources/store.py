"""Published tables: parts that are never changed, and one numbered pointer that says which parts are current.

A build writes new parts beside the old ones and then creates the next pointer.
A pointer is created only if it is absent and is never changed, so a reader
sees all tables as one build left them, however many builds follow; old
parts are deleted later, by ``clean``.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK = {T.ByteType(): 1, T.ShortType(): 2, T.IntegerType(): 3, T.LongType(): 4, T.FloatType(): 5, T.DoubleType(): 6}
POINTERS = "_current"


def promoted(kinds: list[T.DataType]) -> T.DataType:
    """The one type that all values fit in: a column of nulls gives way, numbers widen, anything else is text."""
    some = list(dict.fromkeys(k for k in kinds if not isinstance(k, T.NullType)))
    if not some:
        return T.StringType()
    if len(some) == 1:
        return some[0]
    if all(k in RANK for k in some):
        return T.DoubleType() if any(RANK[k] > 4 for k in some) else max(some, key=RANK.get)
    return T.StringType()


def united(frames: list[DataFrame], promote: dict[str, str] | None = None) -> DataFrame:
    """Frames as one by column name, types promoted; a column that a frame lacks is null there."""
    kinds: dict[str, list[T.DataType]] = {}
    for f in frames:
        for c in f.schema.fields:
            kinds.setdefault(c.name, []).append(c.dataType)
    to = {c: promoted(k) for c, k in kinds.items()} | {c: T._parse_datatype_string(t) for c, t in (promote or {}).items()}
    out = None
    for f in frames:
        one = f.select(*[F.col(f"`{c}`").cast(to[c]).alias(c) if c in f.columns else F.lit(None).cast(to[c]).alias(c) for c in kinds])
        out = one if out is None else out.unionByName(one)
    return out


class Store:
    """The tables below a root folder.

    The root's file system must be able to create a file only if it is absent,
    as HDFS and most object stores are; on S3A this takes its conditional
    writes. A writer that loses the race for a number takes the next one, with
    the winner's tables, so no publication undoes another. A pointer whose
    writer has not ended it within ``patience`` seconds is passed over.
    """

    def __init__(self, spark: SparkSession, root: str, patience: float = 60):
        self.spark, self.root, self.patience = spark, root.rstrip("/"), patience
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def numbers(self) -> list[int]:
        return [int(n) for n in self._names(f"{self.root}/{POINTERS}") if n.isdigit()]

    def _content(self, number: int) -> dict | None:
        """A pointer's tables and state; None while its writer has not ended it, or where it has been cleaned away."""
        try:
            stream = self._fs.open(self._path(f"{self.root}/{POINTERS}/{number:020d}"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception.getClass()):
                return None
            raise
        return json.loads(text) if text.endswith("\n") else None

    def current(self) -> tuple[int, dict]:
        """The newest whole pointer: its number, and ``tables`` (each table's parts) and ``state`` (what loaders keep); 0 and nothing before the first publication."""
        for n in reversed(self.numbers()):
            got = self._content(n)
            if got is not None:
                return n, got
        return 0, {"tables": {}, "state": {}}

    def build(self, name: str, df: DataFrame, partition_by: list[str] | None = None, part: str | None = None) -> str:
        """Write rows as a new part of a table, which no reader sees yet; with ``part``, add to one of this build."""
        part = part or f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.mode("append").parquet(f"{self.root}/{name}/{part}")
        return part

    def publish(self, tables: dict[str, list[str]], add: bool = False, state: dict | None = None) -> int:
        """Make parts current, of all named tables at once, in place of their old ones (with ``add``: after them), with what a loader wants to keep; other tables and states stay as they are."""
        began = time.monotonic()
        while True:
            n, now = self.current()
            following = max([n, *self.numbers()]) + 1
            if following > n + 1 and time.monotonic() < began + self.patience:
                time.sleep(0.05)
                continue
            old = now["tables"]
            new = {"tables": old | {t: [*old.get(t, []), *p] if add else p for t, p in tables.items()}, "state": now["state"] | (state or {})}
            if self._create(following, json.dumps(new) + "\n"):
                return following

    def _create(self, number: int, text: str) -> bool:
        path = f"{self.root}/{POINTERS}/{number:020d}"
        if self._fs.getUri().getScheme() == "file":  # the local file system of Hadoop looks first and creates then
            local = re.sub("^file:/*", "/", path)
            os.makedirs(os.path.dirname(local), exist_ok=True)
            aside = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
            with open(aside, "w") as f:
                f.write(text)
            try:
                os.link(aside, local)
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
            return True
        try:
            out = self._fs.create(self._path(path), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def parts(self, name: str, at: int | None = None) -> list[str]:
        """The folders of a table's current parts, or of those of an older pointer that has not been cleaned away."""
        tables = (self.current()[1] if at is None else self._content(at) or {"tables": {}})["tables"]
        if name not in tables:
            raise KeyError(f"{name} is not published in {self.root}")
        return [f"{self.root}/{name}/{p}" for p in tables[name]]

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """A table as it was published; parts of different columns or types are united by name."""
        parts = self.parts(name, at)
        return united([self.spark.read.parquet(p) for p in parts]) if len(parts) > 1 else self.spark.read.parquet(parts[0])

    def clean(self, keep: int = 2, grace: float = 24 * 3600) -> list[str]:
        """Delete pointers but the newest ``keep``, and parts that none of these names and that are older than ``grace`` seconds: younger ones may be of a build that has not ended, or be read still."""
        numbers = self.numbers()
        kept, gone = numbers[-keep:], numbers[:-keep] if keep else numbers
        used = {(t, p) for n in kept for t, ps in (self._content(n) or {"tables": {}})["tables"].items() for p in ps}
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/{POINTERS}/{n:020d}"), False)
        out = []
        for t in self._names(self.root):
            for p in self._names(f"{self.root}/{t}") if not t.startswith(("_", ".")) else []:
                if (t, p) not in used and re.match(r"\d{20}-", p) and time.time_ns() - int(p[:20]) >= grace * 1e9:
                    self._fs.delete(self._path(f"{self.root}/{t}/{p}"), True)
                    out.append(f"{t}/{p}")
        return out
