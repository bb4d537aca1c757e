"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are turned into the axes of their second moments, largest first. The
product of two unit vectors is at most the product of their leading parts plus
the product of the lengths of the rest, so leading dimensions alone rule out
nearly all pairs; the others are added a few at a time until the bound falls
below the threshold or all are in. Tiles are cells of the leading axes, and
tiles whose cells lie too far apart never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._common import bounded_sample, components, scratch, small_batches, written

#: Vectors of a tile, and its bytes at most; rows of a tile that are compared at once; cells at most; vectors that cells and balls are taken from.
TILE, TILE_BYTES, STRIP, CELLS, SAMPLE = 8192, 32 << 20, 256, 512, 1 << 15
#: Balls of a cell at most, and how many of its vectors are tried as their centres.
BALLS, TRIED = 4, 2048
#: What single precision may lose in a term of the first bound, and how near to the threshold a cosine is computed once more, term by term.
LOOSE, NEAR = 1.2e-7, 1e-9


def usable(embedding: Column) -> Column:
    """The vector in double precision; null where it is null, all zero or empty, or holds a null or a component that is not finite."""
    v = embedding.cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.when(good, v)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square is too large or too small."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors, summed term by term."""
    dot = own = other = 0.0
    # powers of two change no digit
    for x, y in zip(np.ldexp(a, -np.frexp(np.abs(a).max())[1]).tolist(), np.ldexp(b, -np.frexp(np.abs(b).max())[1]).tolist(), strict=True):
        dot, own, other = dot + x * y, own + x * x, other + y * y
    return dot / math.sqrt(own * other)


def axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Columns are the directions of most length among unit vectors, weighed by their copies; dim * dim sums come to the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in small_batches(batches, 4096):
            u = unit(_matrix(b["v"], b["wide"], dim))
            total += (u * b["n"].to_numpy()[:, None]).T @ u
        i, j = np.nonzero(np.triu(np.ones((dim, dim))))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((dim, dim))
    for r in rows.select("v", "wide", "n").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    value, vector = np.linalg.eigh(out)
    return np.ascontiguousarray(vector[:, np.argsort(-value)])


def _matrix(packed: pa.Array, wide: pa.Array, dim: int) -> np.ndarray:
    """Vectors kept as bytes of single or double precision."""
    if not len(packed):
        return np.zeros((0, dim))
    kind = "<f8" if wide[0].as_py() else "<f4"
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), dim).astype(np.float64)


def stages(dim: int) -> list[int]:
    """After how many dimensions a bound is taken."""
    out = [max(1, min(dim, max(16, dim // 4)))]
    while out[-1] < dim:
        out.append(min(dim, out[-1] * 2))
    return out


class Rotated:
    """Vectors along the axes, and how long their rest is after each stage."""

    def __init__(self, raw: np.ndarray, turn: np.ndarray):
        self.raw, self.at = raw, stages(turn.shape[0])
        self.y = unit(raw) @ turn
        self.rest = {d: np.sqrt((self.y[:, d:] ** 2).sum(axis=1)) for d in self.at}
        lead = self.at[0]
        #: leading parts with the length of the rest as one more component: a product is a bound
        self.lead = np.hstack([self.y[:, :lead], self.rest[lead][:, None]]).astype(np.float32)


def linked(a: Rotated, b: Rotated, least: float, same: bool, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two tiles (of one tile, each pair once) with a cosine of at least ``least``, strip by strip.

    ``seen`` gets how many pairs were left after each stage.
    """
    low = least - max(1e-5, LOOSE * (a.lead.shape[1] + 8))
    for s in range(0, len(a.y), STRIP):
        e = min(s + STRIP, len(a.y))
        first = s if same else 0
        mask = a.lead[s:e] @ b.lead[first:].T >= low
        if same:
            mask &= np.arange(s, e)[:, None] < np.arange(first, len(b.y))[None, :]
        i, j = np.nonzero(mask)
        if seen is not None:
            seen.append(len(i))
        if len(i) > mask.size // 16:  # a dense strip: the rest of the dimensions at once
            product = a.y[s:e] @ b.y[first:].T
            i, j = np.nonzero(mask & (product >= least - NEAR))
            yield _sure(a, b, i + s, j + first, product[i, j], least)
            continue
        i, j = i + s, j + first
        for at in range(0, len(i), 1 << 16):
            yield _confirmed(a, b, i[at : at + (1 << 16)], j[at : at + (1 << 16)], least)


def _sure(a: Rotated, b: Rotated, i: np.ndarray, j: np.ndarray, product: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at or above the threshold; those too near to it are computed term by term."""
    sure = product >= least + NEAR
    for k in np.flatnonzero(~sure):
        sure[k] = cosine(a.raw[i[k]], b.raw[j[k]]) >= least
    return i[sure], j[sure]


def _confirmed(a: Rotated, b: Rotated, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    product, done = np.zeros(len(i)), 0
    for d in a.at:
        product += np.einsum("ij,ij->i", a.y[i, done:d], b.y[j, done:d])
        keep = product + a.rest[d][i] * b.rest[d][j] >= least - NEAR
        i, j, product, done = i[keep], j[keep], product[keep], d
    return _sure(a, b, i, j, product, least)


class Cells:
    """A tree of cuts along the leading axes, and balls of radius half the linking angle, from a bounded sample.

    Neither decides a link: cells tell which tiles may meet, and two members
    of one ball are linked by the triangle inequality of angles.
    """

    def __init__(self, sample: np.ndarray, turn: np.ndarray, least: float, rows: int, size: int):
        self.depth = max(0, min(int(math.log2(CELLS)), math.ceil(math.log2(max(1, rows / size)))))
        y = unit(sample) @ turn if len(sample) else np.zeros((0, turn.shape[0]))
        self.lead = min(turn.shape[0], 12)
        self.cuts: list[np.ndarray] = []
        self.axis: list[np.ndarray] = []
        cell = np.zeros(len(y), np.int64)
        for _ in range(self.depth):
            n = 1 << len(self.cuts)
            axis, cut = np.zeros(n, np.int64), np.zeros(n)
            for c in range(n):
                own = y[cell == c, : self.lead]
                if len(own) > 1:
                    axis[c] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                    cut[c] = np.median(own[:, axis[c]])
            self.axis.append(axis)
            self.cuts.append(cut)
            cell = cell * 2 + (y[np.arange(len(y)), axis[cell]] > cut[cell])
        half = math.cos(math.acos(least) / 2) + NEAR if least < 1 else 2.0
        self.half, self.balls = half, {}
        for c in np.unique(cell):
            own = y[cell == c][:TRIED]
            if len(own) < 16:
                continue
            near = own @ own.T >= half
            centres, left = [], np.ones(len(own), bool)
            while len(centres) < BALLS and left.any():
                k = int(np.argmax((near & left[None, :]).sum(axis=1)))
                got = near[k] & left
                if got.sum() < max(8, len(own) // 16):
                    break
                centres.append(own[k])
                left &= ~got
            if centres:
                self.balls[int(c)] = np.array(centres)

    def of(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its ball there (0: none)."""
        cell, ball = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
        for axis, cut in zip(self.axis, self.cuts, strict=True):
            cell = cell * 2 + (y[np.arange(len(y)), axis[cell]] > cut[cell])
        for c in np.unique(cell).tolist():
            if c in self.balls:
                own = np.flatnonzero(cell == c)
                near = y[own] @ self.balls[c].T
                ball[own] = np.where(near.max(axis=1) >= self.half, near.argmax(axis=1) + 1, 0)
        return cell, ball


def _placed(rows: DataFrame, cells: Cells, turn: np.ndarray) -> DataFrame:
    """Rows with their cell and ball, and their leading coordinates and the length of the rest."""
    dim, lead = turn.shape[0], cells.lead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            y = unit(_matrix(b["v"], b["wide"], dim)) @ turn
            cell, ball = cells.of(y)
            rest = np.sqrt((y[:, lead:] ** 2).sum(axis=1))
            x = np.hstack([y[:, :lead], rest[:, None]])
            xs = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), lead + 1).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["cid"], b["n"], b["v"], b["wide"], pa.array(cell), pa.array(ball), xs], ["cid", "n", "v", "wide", "cell", "ball", "x"])

    return rows.select("cid", "n", "v", "wide").mapInArrow(run, "cid long, n long, v binary, wide boolean, cell long, ball long, x array<double>")


def _meeting(boxes: DataFrame, low: np.ndarray, high: np.ndarray, least: float) -> DataFrame:
    """p, q: which boxes may hold vectors with a product of ``least``; the last coordinate of a box is a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b["box"].to_pylist():
                # the largest product of a coordinate in one interval with one in another
                top = np.maximum(np.maximum(low[i] * low[i:], low[i] * high[i:]), np.maximum(high[i] * low[i:], high[i] * high[i:]))
                gap = np.maximum(0, np.maximum(low[i:, :-1] - high[i, :-1], low[i, :-1] - high[i:, :-1]))
                # of unit vectors, the product is 1 - distance^2 / 2
                ok = np.flatnonzero((top.sum(axis=1) >= least - NEAR) & (1 - (gap**2).sum(axis=1) / 2 >= least - NEAR)) + i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), i)), pa.array(ok)], ["b1", "b2"])

    return boxes.select("box").mapInArrow(run, "b1 long, b2 long")


def _links(rows: DataFrame, dim: int, least: float, size: int) -> DataFrame:
    """a, b, n: forest edges between linked classes (n is 0), and the number n of vectors that a class a is linked to (b is null), of classes of one dimension."""
    spark = rows.sparkSession
    size = max(1, min(size, TILE_BYTES // (8 * dim)))
    turn = axes(rows, dim)
    some = bounded_sample(rows, SAMPLE, "cid").select("v", "wide", "cid").toArrow().sort_by("cid")
    cells = Cells(_matrix(some["v"], some["wide"], dim), turn, least, rows.count(), size)
    placed = written(_placed(rows, cells, turn), "placed")
    lead = cells.lead + 1
    ends = [f(F.col("x")[k]).alias(f"{name}{k}") for name, f in (("lo", F.min), ("hi", F.max)) for k in range(lead)]
    # a row a cell and ball, of which there is a fixed number
    boxes = placed.groupBy("cell", "ball").agg(F.count("*").alias("held"), F.sum("n").alias("whole"), F.min("cid").alias("star"), *ends).orderBy("cell", "ball").collect()
    low = np.array([[b[f"lo{k}"] for k in range(lead)] for b in boxes]).reshape(len(boxes), lead)
    high = np.array([[b[f"hi{k}"] for k in range(lead)] for b in boxes]).reshape(len(boxes), lead)
    tiles = [-(-b["held"] // size) for b in boxes]
    start = np.concatenate([[0], np.cumsum(tiles)]).tolist()
    box = spark.createDataFrame([(i, b["cell"], b["ball"], start[i], tiles[i], b["whole"], b["star"]) for i, b in enumerate(boxes)], "box long, cell long, ball long, start long, tiles long, whole long, star long")
    own = placed.select("cid", "n", "v", "wide", "cell", "ball").join(F.broadcast(box), ["cell", "ball"])
    # within a ball all are linked: one edge a member, and a count
    inside = own.where("ball > 0")
    none = F.lit(None).cast("long")
    stars = inside.select("cid", F.explode(F.array(F.struct(F.col("star").alias("b"), F.lit(0).cast("long").alias("n")), F.struct(none.alias("b"), (F.col("whole") - F.col("n")).alias("n")))).alias("e")).select(F.col("cid").alias("a"), "e.b", "e.n")
    tiled = own.select("cid", "n", "v", "wide", (F.col("start") + F.pmod(F.xxhash64("cid"), F.col("tiles"))).alias("tile"))
    ball = {f"{c}{k}": F.col(c).alias(f"{c}{k}") for c in ("box", "start", "tiles", "ball") for k in (1, 2)}
    side = lambda k: F.broadcast(box.select(*[v for c, v in ball.items() if c.endswith(str(k))]))
    met = _meeting(box, low, high, least).join(side(1), F.col("b1") == F.col("box1")).join(side(2), F.col("b2") == F.col("box2")).where("b1 <> b2 or ball1 = 0")
    # a row a pair of tiles
    span = lambda k: F.explode(F.sequence(F.col(f"start{k}"), F.col(f"start{k}") + F.col(f"tiles{k}") - 1))
    met = met.withColumn("p", span(1)).withColumn("q", span(2)).where("b1 <> b2 or p <= q")
    asked = met.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("tile"))
    parts = max(1, min(start[-1] * (start[-1] + 1) // 2, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    pairs = tiled.join(asked, "tile").select("p", "q", "tile", "cid", "n", "v", "wide").repartition(parts, "p", "q")

    def compare(key, table):
        p, q = key[0].as_py(), key[1].as_py()
        at, cid, n = table["tile"].to_numpy(), table["cid"].to_numpy(), table["n"].to_numpy()
        rows_of = {t: np.flatnonzero(at == t) for t in {p, q}}
        made = {t: Rotated(_matrix(table["v"].take(pa.array(w)), table["wide"], dim), turn) for t, w in rows_of.items()}
        left, right = rows_of[p], rows_of[q]
        counts, tree, edges = np.zeros(table.num_rows), Forest(table.num_rows), []
        for i, j in linked(made[p], made[q], least, p == q):
            i, j = left[i], right[j]
            counts += np.bincount(i, n[j], table.num_rows) + np.bincount(j, n[i], table.num_rows)
            edges += tree.join(i, j)
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        some = np.flatnonzero(counts)
        other = pa.concat_arrays([pa.array(cid[b], pa.int64()), pa.nulls(len(some), pa.int64())])
        return pa.table({"a": np.concatenate([cid[a], cid[some]]), "b": other, "n": np.concatenate([np.zeros(len(a), np.int64), counts[some].astype(np.int64)])})

    return stars.unionByName(pairs.groupBy("p", "q").applyInArrow(compare, "a long, b long, n long"))


class Forest:
    """What is joined to what among the rows of a pair of tiles."""

    def __init__(self, n: int):
        self.boss = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray, step: int = 2048) -> list[tuple[int, int]]:
        """The pairs that join two trees; all others are passed over."""
        out = []
        for at in range(0, len(a), step):
            boss = self.boss
            while (boss[boss] != boss).any():
                boss = boss[boss]
            self.boss = boss
            x, y = a[at : at + step], b[at : at + step]
            apart = boss[x] != boss[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                r, s = i, j
                while boss[r] != r:
                    r = boss[r]
                while boss[s] != s:
                    s = boss[s]
                if r != s:
                    boss[max(r, s)] = min(r, s)
                    out.append((i, j))
        return out


def _packed(rows: DataFrame, single: bool) -> DataFrame:
    """The rows with their number of components, and these as bytes (a negative zero is a zero)."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    to = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            flat, ends = b["v"].flatten().to_numpy().astype(to) + to(0), np.cumsum([0, *b["v"].value_lengths().to_pylist()])
            out = [flat[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["h1"], b["h2"], pa.array(np.diff(ends), pa.int64()), pa.array(out, pa.binary())], ["vec_id", "h1", "h2", "dim", "v"])

    return rows.mapInArrow(run, f"vec_id {kind}, h1 long, h2 long, dim long, v binary")


def near_vectors(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept.

    Vectors link whose cosine in double precision is at least ``least``, which
    is above 0; vectors of different lengths do not link, nor do those that are
    null, zero or hold a null or a component that is not finite. n_links counts
    the other rows that a row is linked to; component_id is the least id that
    links reach; ``kept`` says that it is the row's own. A row is a vector of
    its own whatever its id: rows that repeat an id count one another if their
    vectors link. A row without an id links with nothing, has a null component
    and is kept. Ids may be of any type that has an order.

    Equal vectors are one class from the start. Members of a ball around a
    vector of the sample, whose radius is half the linking angle, are linked by
    the triangle inequality and are only counted, so a large group of near
    copies costs in proportion; balls meet all other tiles. Each length of
    vectors has jobs of its own: a table should have few. A product within 1e-9 of the
    threshold is computed again term by term in the order of the components.
    """
    if not 0 < least <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    with scratch(vectors.sparkSession) as keep:
        return _near_vectors(vectors, least, vec_id, embedding, tile, keep)


def _near_vectors(vectors: DataFrame, least: float, vec_id: str, embedding: str, tile: int, keep) -> DataFrame:
    single = isinstance(vectors.schema[embedding].dataType, ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, FloatType)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), usable(F.col(embedding)).alias("v")).withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v")))
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64(F.lit(2), "v"))
    key = ["h1", "h2"]
    packed = _packed(rows.where("v is not null"), single)
    held = written(packed.groupBy(*key, "dim", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("cid", F.monotonically_increasing_id()).withColumn("wide", F.lit(not single)), "vectors")
    dims = sorted(r["dim"] for r in held.select("dim").distinct().collect())  # a row per length of vectors
    found = None
    for d in dims:
        own = _links(held.where(F.col("dim") == d), d, least, tile)
        found = own if found is None else found.unionByName(own)
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = written(found, "links")
    comp = components(found.where("b is not null"))
    keep(held, found, comp)
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    classes = held.select("cid", "n", "low", *key).join(comp.withColumnRenamed("id", "cid"), "cid", "left").join(counts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least_id = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = classes.join(least_id, "component").select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where("v is not null").select("vec_id", *key).join(classes, key)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
