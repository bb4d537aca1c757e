"""Exact top-k inner products with a pivot table.

Vectors are turned into integers and lengthened by one component, so that the
largest inner product is the nearest neighbour. Every candidate's distances to
many pivots are computed once and kept; for a query, the largest difference to
its own pivot distances is a lower bound of the distance. Candidates are taken
in the order of that bound until it passes the k-th best distance found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import bounded_sample, written

#: Largest integer that a double holds with every smaller one; products beyond it are computed with Python's integers.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def whole(embedding: Column) -> Column:
    """floor(256 x) of each component, exact at any size; null where the vector is null, or holds a null or a component for which that is not finite."""
    d = F.transform(embedding.cast("array<double>"), lambda x: x * 256)
    good = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(d, lambda x: F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x)))


def pack(df: DataFrame, norm2: float, pivots: np.ndarray) -> DataFrame:
    """One row per candidate: the cell of its nearest pivot, and the vector and pivot distances as bytes."""
    piv = df.sparkSession.sparkContext.broadcast(pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            v = np.array(f["v"].tolist(), np.float64).reshape(len(f), -1)
            d = distances(v, norm2, piv.value).astype(np.float32)
            yield pd.DataFrame({"vec_id": f["vec_id"], "cell": nearest(d), "row": [a.tobytes() + b.tobytes() for a, b in zip(v, d, strict=True)]})

    return df.mapInPandas(run, "vec_id long, cell int, row binary")


def nearest(d: np.ndarray) -> np.ndarray:
    """The nearest pivot by distances; the first where they are not comparable."""
    return np.argmin(np.where(np.isnan(d), np.inf, d), axis=1).astype(np.int32)


def cells(cand: DataFrame, dim: int, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many candidates each cell has, and the least and greatest distance of its candidates to each pivot: a row a cell and pivot comes to the driver."""
    step = dim * 8

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, lo, hi = np.zeros(pivots, np.int64), np.full((pivots, pivots), np.inf), np.full((pivots, pivots), -np.inf)
        for f in frames:
            d = np.array([np.frombuffer(r[step:], np.float32) for r in f["row"]], np.float64).reshape(len(f), pivots)
            d = np.where(np.isnan(d), np.inf, d)
            own = f["cell"].to_numpy()
            n += np.bincount(own, minlength=pivots)
            np.minimum.at(lo, own, np.where(np.isinf(d), 0, d))
            np.maximum.at(hi, own, d)
        c, p = np.nonzero((n > 0)[:, None] & np.ones(pivots, bool))
        yield pd.DataFrame({"cell": c, "p": p, "n": n[c], "lo": lo[c, p], "hi": hi[c, p]})

    n, lo, hi = np.zeros(pivots, np.int64), np.full((pivots, pivots), np.inf), np.full((pivots, pivots), -np.inf)
    rows = cand.select("cell", "row").mapInPandas(run, "cell long, p long, n long, lo double, hi double").groupBy("cell", "p").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    for r in rows.collect():
        n[r["cell"]], lo[r["cell"], r["p"]], hi[r["cell"], r["p"]] = r["n"], r["lo"], r["hi"]
    return n, lo, hi


def reachable(q: np.ndarray, worst: np.ndarray, norm2: float, pivots: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each query and cell, whether a candidate of the cell may reach the query's k-th best score so far (minus infinity: all cells)."""
    d = distances(q, norm2, pivots, query=True)
    scale = (q * q).sum(axis=1) + norm2
    out = np.zeros((len(q), len(n)), bool)
    for c in np.flatnonzero(n):
        bound = np.maximum(0, np.maximum(lo[c] - d, d - hi[c])).max(axis=1, initial=0)
        out[:, c] = ~((scale - bound**2) / 2 + slack(scale) < worst)
    return out


def slack(scale):
    """What rounding may take from a bound."""
    return 1e-3 * np.maximum(1.0, np.abs(scale)) ** 0.5 + 1e-5 * scale


def longer(v: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with one more component, so that all have the squared length ``norm2``."""
    with np.errstate(over="ignore", invalid="ignore"):  # a bound that is no number ends no search
        return np.hstack([v, np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1), 0))[:, None]])


def distances(v: np.ndarray, norm2: float, pivots: np.ndarray, query: bool = False) -> np.ndarray:
    x = np.hstack([v, np.zeros((len(v), 1))]) if query else longer(v, norm2)
    with np.errstate(over="ignore", invalid="ignore"):
        d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
        return np.sqrt(np.maximum(d2, 0))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of a query with rows."""
    if not len(c):
        return np.zeros(0)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, len(q)) < EXACT:
        return c @ q
    big = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(r, big, strict=True)) for r in c], object)


def search_block(qid: np.ndarray, q: np.ndarray, qd: np.ndarray, cid: np.ndarray, c: np.ndarray, cd: np.ndarray, norm2: float, k: int, step: int = 256, seen: list[int] | None = None):
    """The k best (query, candidate, score) of each query within one block of candidates, by pivot elimination. ``seen`` gets the number of candidates evaluated for each."""
    repeated = len(np.unique(cid)) < len(cid)
    for i in range(len(qid)):
        own = q[i]
        bound = np.abs(cd - qd[i]).max(axis=1) if cd.shape[1] and cd.shape[1] == qd.shape[1] else np.zeros(len(cid))
        order = np.argsort(bound, kind="stable")
        best_id, best, done = np.zeros(0, np.int64), np.zeros(0), 0
        scale = float((own * own).sum()) + norm2
        for at in range(0, len(order), step):
            take = order[at : at + step]
            if len(best) == k:
                # the largest product that a distance of at least this bound allows; the slack covers rounding
                reach = (scale - max(0.0, float(bound[take[0]])) ** 2) / 2
                if reach + slack(scale) < float(best[-1]):
                    break
            done += len(take)
            take = take[cid[take] != qid[i]]
            s = np.concatenate([best, products(own, c[take])])
            ids = np.concatenate([best_id, cid[take]])
            if len(s) > 4 * k and s.dtype != object and not repeated:
                top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                s, ids = s[top], ids[top]
            o = np.lexsort((ids, -s)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], ids[j])), int)
            if repeated:  # of the vectors of one id the best counts
                o = o[np.sort(np.unique(ids[o], return_index=True)[1])]
            best_id, best = ids[o[:k]], s[o[:k]]
        if seen is not None:
            seen.append(done)
        yield from ((int(qid[i]), int(a), min(max(int(b), -LONG - 1), LONG)) for a, b in zip(best_id, best, strict=True))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = 32, query_block: int = 1024, block: int = 8192) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k largest integer inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own id. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows without an id; a vector is
    compared with those of its own number of components, and empty vectors
    score 0. A score beyond 64 bits is given as the nearest 64-bit number. A row that repeats an id with equal components counts once;
    of an id's different vectors the best counts, as a candidate and as a query. Ids are whole numbers.
    Candidates lie in the cells of their nearest pivots. A query is searched in
    its own cell first; its k-th best score there, and the least and greatest
    distances of each other cell to all pivots, tell which cells it must still
    meet, so a vector goes only where a query can use it. Within a cell, blocks
    of bounded size meet. Pivots come from a bounded sample and only steer the search.
    """
    if not isinstance(vectors.schema[vec_id].dataType, IntegralType):
        raise TypeError("queries are chosen by division of their ids, which must be whole numbers")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(embedding)).alias("v")).where("vec_id is not null and v is not null")
    rows = written(rows.withColumn("h", F.xxhash64("v")).dropDuplicates(["vec_id", "h"]).select("vec_id", "v", F.size("v").alias("dim")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm2"), F.sum(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("q")).collect()  # a row per dimension
    schema = "query_id long, rank int, vec_id long, score long"
    parts = []
    for s in stats:
        if not s["q"]:
            continue
        own = rows.where(F.col("dim") == s["dim"])
        norm2 = float(s["norm2"] or 0.0)
        some = bounded_sample(own, 2000, "vec_id", "v").orderBy("vec_id").select("v").collect()
        points = longer(np.array([r["v"] for r in some], np.float64).reshape(len(some), -1), norm2)
        parts.append(_searched(own, own.where(F.col("vec_id") % every == 0), norm2, _spread(points, pivots), s["dim"], k, query_block, block, s["n"], s["q"]))
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank)
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(own: DataFrame, queries: DataFrame, norm2: float, piv: np.ndarray, dim: int, k: int, query_block: int, block: int, held: int, asking: int) -> DataFrame:
    """query_id, vec_id, score: each query's best of its own cell, and of the cells that its k-th best there leaves in reach."""
    spark = own.sparkSession
    if held <= block:  # one block needs no cells
        zero, parts = F.lit(0), -(-asking // query_block)
        of = F.pmod(F.xxhash64(F.lit("deal"), "vec_id"), F.lit(parts)).cast("int")
        right = pack(own, norm2, piv).select(zero.alias("cell"), F.explode(F.sequence(zero, F.lit(parts - 1))).alias("qb"), zero.alias("cb"), "vec_id", "row")
        return _pairs(right, queries.select(zero.alias("cell"), of.alias("qb"), zero.alias("cb"), "vec_id", "v"), norm2, piv, dim, k)
    cand = written(pack(own, norm2, piv), "candidates")
    n, lo, hi = cells(cand, dim, len(piv))
    sent = spark.sparkContext.broadcast((piv, n, lo, hi))

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries with the cells to search: their own if they have no ``worst`` yet, else the others in reach."""
        pivots, n, lo, hi = sent.value
        for f in frames:
            if not len(f):
                continue
            q = np.array(f["v"].tolist(), np.float64).reshape(len(f), -1)
            home = np.zeros((len(f), len(n)), bool)
            home[np.arange(len(f)), nearest(distances(q, norm2, pivots, query=True))] = True
            to = home if "worst" not in f else reachable(q, f["worst"].to_numpy(np.float64), norm2, pivots, n, lo, hi) & ~home
            i, c = np.nonzero(to)
            yield pd.DataFrame({"vec_id": f["vec_id"].to_numpy()[i], "v": pd.Series([f["v"].iloc[x] for x in i], dtype=object), "cell": c.astype(np.int32)})

    schema = "vec_id long, v array<double>, cell int"
    deal = lambda m: F.pmod(F.xxhash64(F.lit("deal"), "vec_id"), m).cast("int")
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))

    def met(ask: DataFrame) -> DataFrame:
        of = {r["cell"]: r["count"] for r in ask.groupBy("cell").count().collect()}  # a row a cell
        sizes = [(int(c), -(-of[int(c)] // query_block), int(-(-n[c] // block))) for c in of if n[c]]
        if not sizes:
            return spark.createDataFrame([], "query_id long, vec_id long, score long")
        size = F.broadcast(spark.createDataFrame(sizes, "cell int, nq int, nc int"))
        left = ask.join(size, "cell").withColumn("qb", deal(F.col("nq"))).withColumn("cb", upto("nc")).select("cell", "qb", "cb", "vec_id", "v")
        right = cand.join(size, "cell").withColumn("cb", deal(F.col("nc"))).withColumn("qb", upto("nq")).select("cell", "qb", "cb", "vec_id", "row")
        return _pairs(right, left, norm2, piv, dim, k)

    first = written(met(written(queries.select("vec_id", "v").mapInPandas(asked, schema), "asked")), "found")
    best = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    worst = best.withColumn("_at", place).where(F.col("_at") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("worst"))
    again = queries.select("vec_id", "v").join(worst, "vec_id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    return first.unionByName(met(written(again.mapInPandas(asked, schema), "asked")))


def _pairs(cand: DataFrame, ask: DataFrame, norm2: float, piv: np.ndarray, dim: int, k: int) -> DataFrame:
    pivots = ask.sparkSession.sparkContext.broadcast(piv)
    step = dim * 8

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        c = np.array([np.frombuffer(r[:step], np.float64) for r in right["row"]]).reshape(len(right), dim)
        cd = np.array([np.frombuffer(r[step:], np.float32) for r in right["row"]]).reshape(len(right), -1)
        q = np.array(left["v"].tolist(), np.float64).reshape(len(left), dim)
        qd = distances(q, norm2, pivots.value, query=True)
        got = list(search_block(left["vec_id"].to_numpy(), q, qd, right["vec_id"].to_numpy(), c, cd, norm2, k))
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"], dtype="int64")

    # each block of queries meets each block of the cell's candidates once
    keys = ["cell", "qb", "cb"]
    return ask.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """Points far from one another, chosen greedily from the first."""
    picked, far = [0], np.full(len(points), np.inf)
    while len(picked) < min(n, len(points)):
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.minimum(far, ((points - points[picked[-1]]) ** 2).sum(axis=1))
        picked.append(int(far.argmax()))
    return points[picked]
