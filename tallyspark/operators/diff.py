"""Differences of nested rows, and of whole tables by digests."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "array<struct<path:string,kind:string,before:string,after:string>>"


def same(kind: T.DataType, x: Column, y: Column, tolerance: float) -> Column:
    """Whether two values of a type are equal: floating numbers within the tolerance (a NaN is a NaN), lists in order, maps by key; nulls equal nulls."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        room = F.greatest(F.abs(x), F.abs(y)) * tolerance
        return x.eqNullSafe(y) | F.coalesce(~F.isnan(x) & ~F.isnan(y) & (F.abs(x - y) <= F.greatest(room, F.lit(tolerance))) & (F.abs(x - y) < F.lit(float("inf"))), F.lit(False))
    if isinstance(kind, T.StructType):
        inner = reduce(and_, [same(f.dataType, x[f.name], y[f.name], tolerance) for f in kind.fields], F.lit(True))
    elif isinstance(kind, T.ArrayType):
        inner = (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda a, b: same(kind.elementType, a, b, tolerance)), lambda ok: ok)
    elif isinstance(kind, T.MapType):
        inner = (F.size(x) == F.size(y)) & F.forall(F.map_keys(x), lambda k: F.map_contains_key(y, k) & same(kind.valueType, F.try_element_at(x, k), F.try_element_at(y, k), tolerance))
    else:
        return x.eqNullSafe(y)
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(inner)


def _text(kind: T.DataType, x: Column) -> Column:
    return F.to_json(x) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")


def _one(path: Column, kind: str, before: Column, after: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(kind).alias("kind"), before.cast("string").alias("before"), after.cast("string").alias("after"))).cast(ENTRY)


def _permuted(kind: T.DataType, x: Column, y: Column, tolerance: float) -> Column:
    """Whether each item of one list pairs with an equal item of its own of the other: equal as multisets, else one by one under the tolerance."""
    plain = F.array_sort(F.transform(x, lambda i: F.coalesce(_text(kind, i), F.lit("null")))) == F.array_sort(F.transform(y, lambda i: F.coalesce(_text(kind, i), F.lit("null"))))

    def take(left: Column, item: Column) -> Column:
        """The items not paired yet, less the first that equals this one; none are left of a list in which it has no equal."""
        at = F.array_position(F.transform(left, lambda o: same(kind, item, o, tolerance)), True).cast("int")
        without = F.concat(F.slice(left, 1, F.greatest(at - 1, F.lit(0))), F.slice(left, at + 1, F.size(left)))
        return F.when(left.isNull() | (at == 0), None).otherwise(without)

    return plain | F.coalesce(F.size(F.aggregate(x, y, take)) == 0, F.lit(False))


def _entries(b: T.DataType, a: T.DataType, path: Column, x: Column, y: Column, tolerance: float) -> Column:
    """All differences of two values, as a list in the order of their paths."""
    none = F.array().cast(ENTRY)
    below = lambda name: F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), name)
    if isinstance(b, T.StructType) and isinstance(a, T.StructType):
        parts = []
        for name in sorted({*b.names, *a.names}):
            if name not in a.names:
                parts.append(F.when(x[name].isNotNull(), _one(below(F.lit(name)), "missing", _text(b[name].dataType, x[name]), F.lit(None))).otherwise(none))
            elif name not in b.names:
                parts.append(F.when(y[name].isNotNull(), _one(below(F.lit(name)), "added", F.lit(None), _text(a[name].dataType, y[name]))).otherwise(none))
            else:
                parts.append(_entries(b[name].dataType, a[name].dataType, below(F.lit(name)), x[name], y[name], tolerance))
        inner = F.concat(*parts) if parts else none
    elif isinstance(b, T.MapType) and isinstance(a, T.MapType) and b.keyType == a.keyType:

        def of_key(k: Column) -> Column:
            own, other, at = F.try_element_at(x, k), F.try_element_at(y, k), below(k.cast("string"))
            gone = F.when(~F.map_contains_key(y, k), _one(at, "missing", _text(b.valueType, own), F.lit(None)))
            return gone.when(~F.map_contains_key(x, k), _one(at, "added", F.lit(None), _text(a.valueType, other))).otherwise(_entries(b.valueType, a.valueType, at, own, other, tolerance))

        inner = F.flatten(F.transform(F.array_sort(F.array_union(F.map_keys(x), F.map_keys(y))), of_key))
    elif isinstance(b, T.ArrayType) and isinstance(a, T.ArrayType):
        item = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        both = F.least(F.size(x), F.size(y))
        upto = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
        within = F.flatten(F.transform(upto(F.lit(0), both), lambda i: _entries(b.elementType, a.elementType, item(i), F.get(x, i), F.get(y, i), tolerance)))
        gone = F.flatten(F.transform(upto(both, F.size(x)), lambda i: _one(item(i), "missing", _text(b.elementType, F.get(x, i)), F.lit(None))))
        new = F.flatten(F.transform(upto(both, F.size(y)), lambda i: _one(item(i), "added", F.lit(None), _text(a.elementType, F.get(y, i)))))
        inner = F.concat(within, gone, new)
        if b.elementType == a.elementType:
            moved = (F.size(x) == F.size(y)) & (F.size(within) > 0) & _permuted(b.elementType, x, y, tolerance)
            inner = F.when(moved, _one(path, "reordered", _text(b, x), _text(a, y))).otherwise(inner)
    elif b == a:
        inner = F.when(same(b, x, y, tolerance), none).otherwise(_one(path, "changed", _text(b, x), _text(a, y)))
    else:
        inner = _one(path, "type", _text(b, x), _text(a, y))
    return F.when(x.isNull() & y.isNull(), none).when(x.isNull() | y.isNull(), _one(path, "changed", _text(b, x), _text(a, y))).otherwise(inner)


def nested_diff(before: DataFrame, after: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row for each place at which two tables of nested rows differ: key, path (``a.b[2].c``), kind, before, after.

    Structs and maps are compared by name and key, lists item by item. Kinds:
    ``missing`` and ``added`` for rows (with an empty path), fields, keys and
    last items that only one side has; ``type`` where both sides have a value
    of unlike types (a whole number is not a floating one); ``reordered`` for a
    list that holds the same items in another order; ``changed`` else, also
    where one side is null. Floating numbers are equal within the tolerance,
    absolute below 1 and relative above. A field that only one side's schema
    has counts where it is not null. Keys should be unique and not null: a null
    key equals none, repeated keys are compared in all pairs.

    One join by key; the schema decides the expressions, so nothing is unnested
    into rows before the differences are.
    """
    values = lambda d: [c for c in d.columns if c not in key]
    kinds = lambda d: T.StructType([f for f in d.schema.fields if f.name not in key])
    b = before.select(*key, F.struct(F.lit(True).alias("_"), *values(before)).alias("_b"))
    a = after.select(*key, F.struct(F.lit(True).alias("_"), *values(after)).alias("_a"))
    none = F.lit(None).cast("string")
    whole = F.when(F.col("_a").isNull(), _one(F.lit(""), "missing", none, none)).when(F.col("_b").isNull(), _one(F.lit(""), "added", none, none))
    entries = whole.otherwise(_entries(kinds(before), kinds(after), F.lit(""), F.col("_b"), F.col("_a"), tolerance))
    return b.join(a, key, "full").select(*key, F.explode(entries).alias("_d")).select(*key, "_d.*")


def _terms(df: DataFrame, columns: list[str]) -> list[Column]:
    """What is hashed of a row: nulls apart from values, nested values as text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nested = lambda c: isinstance(kinds[c], (T.StructType, T.ArrayType, T.MapType))
    return [t for c in columns for t in ([F.to_json(F.struct(c), {"ignoreNullFields": "false"})] if nested(c) else [F.isnull(c), F.col(c)])]


def _range(df: DataFrame, ranges: int, columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *_terms(df, columns)), F.lit(ranges))


def digests(df: DataFrame, ranges: int, columns: list[str]) -> DataFrame:
    """A row a range of rows (by a hash of all columns): how many there are, and two sums over them that no order changes."""
    one = [F.xxhash64(F.lit(k), *_terms(df, columns)) for k in (1, 2)]
    rows = df.select(_range(df, ranges, columns).alias("range"), *[h.cast("decimal(20,0)").alias(f"h{k}") for k, h in enumerate(one)])
    return rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("h0").alias("s0"), F.sum("h1").alias("s1"))


def unequal_ranges(left: DataFrame, right: DataFrame, ranges: int = 1024) -> DataFrame:
    """The ranges whose rows differ between two tables, as multisets."""
    cols = left.columns
    both = digests(left, ranges, cols).alias("l").join(digests(right.select(*cols), ranges, cols).alias("r"), "range", "full")
    alike = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("n", "s0", "s1")])
    return both.where(~alike).select("range")


def table_diff(left: DataFrame, right: DataFrame, ranges: int = 1024) -> DataFrame:
    """Rows that only one of two tables of the same columns holds, with ``side`` (left or right), repeated rows counted.

    Ranges of rows are compared by order-free digests first, one small row a
    range; only the rows of ranges that differ are shuffled.
    """
    cols = left.columns
    odd = F.broadcast(unequal_ranges(left, right, ranges))  # a row a range at most
    within = lambda d: d.select(*cols).withColumn("_range", _range(d, ranges, cols)).join(odd, F.col("_range") == F.col("range"), "left_semi")
    both = within(left).withColumn("_w", F.lit(1)).unionByName(within(right).withColumn("_w", F.lit(-1)))
    net = both.groupBy(*cols).agg(F.sum("_w").alias("_w")).where("_w <> 0")
    return net.withColumn("side", F.when(F.col("_w") > 0, "left").otherwise("right")).withColumn("_w", F.explode(F.sequence(F.lit(1), F.abs("_w")))).drop("_w")
