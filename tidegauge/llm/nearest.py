"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are turned by random rotations and projected to a few dimensions; each rotation, with a shift of its own, gives a Hilbert
ordering. Spark range-partitions every ordering, so each vector gets its place along each curve, and the vectors within WINDOW places of
a query on some curve are its candidates. Along the curves each vector is a code of a byte a component; the windows of all curves merge, and the
nearest by code of each are reranked by their exact distance.

Where neighbours don't stand out (high dimension, even spread), windows alone miss many of them. So an exact check follows:
the distance of a query's K-th candidate bounds its true neighbours, and one pass over all vectors, with the
queries in blocks of a bounded size, brings in those within the bound that the windows missed: of each batch the K nearest at most, ties by id, so
that a vector which many rows share doesn't bring them all.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Rows that repeat a vec_id count once,
by their smallest vector; a query never finds its own id. With fewer than K candidates all are returned; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, rows, table

K = 10
CURVES = 24
DIMS = 16
BITS = 3
WINDOW = 200
#: Vectors from which the scale of each projected axis is taken, at most.
SAMPLE = 4096
#: Of a block of a curve, this many times K are kept by their codes' distance.
KEEP = 3
#: Queries of one block of the exact check; a block is what executors hold at once.
BLOCK = 2048

_PLACED = [("curve", pa.int32()), ("key", pa.int64()), ("vec_id", pa.int64()), ("code", pa.binary())]


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows) below 2**bits on each axis, by the transposed-index method of Skilling (2004)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part, one row an id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    v = v.where(F.forall("v", fine)).where(F.exists("v", lambda e: e != 0))
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    v = v.where(F.size("v") == (common["n"] if common else 0))
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


class Curves:
    """Rotations, shifts and scales of all curves, from a bounded sample."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, seed: int = 3):
        r, d = np.random.default_rng(seed), sample.shape[1]
        dims = min(dims, d)
        self.mean = sample.mean(0)
        # rotations keep to the directions in which the sample spreads most
        _, s, axes = np.linalg.svd(sample - self.mean, full_matrices=False)
        axes, s = axes[: max(dims, min(d, 4 * dims, len(s)))], s[: max(dims, min(d, 4 * dims, len(s)))]
        self.turn = []
        for _ in range(curves):
            q, _ = np.linalg.qr(r.normal(size=(len(axes), min(dims, len(axes)))))
            self.turn.append(axes.T @ q)
        self.low, self.size, self.shift = [], [], []
        self.step = max(float(np.quantile(np.abs(sample - self.mean), 0.999)), 1e-300) / 100
        for t in self.turn:
            p = (sample - self.mean) @ t
            lo, hi = np.quantile(p, [0.005, 0.995], axis=0)
            self.low.append(lo)
            self.size.append(np.maximum(hi - lo, 1e-12).max())
            self.shift.append(r.uniform(0, 0.5, p.shape[1]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.mean) / self.step), -127, 127).astype(np.int8)

    def keys(self, x: np.ndarray, c: int, bits: int) -> np.ndarray:
        p = ((x - self.mean) @ self.turn[c] - self.low[c]) / self.size[c] * 0.5 + self.shift[c] * 0.9
        return hilbert(np.clip(p * (1 << bits), 0, (1 << bits) - 1), bits)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _square(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0)


def _window_block(k: int):
    """Of one block of a curve, the KEEP * k nearest by code for each query that looks at it, ties by id."""

    def run(_, queries, block):
        import pandas as pd

        out: list = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(queries) and len(block):
            q, x = (np.stack([np.frombuffer(c, np.int8) for c in f["code"]]).astype(np.float32) for f in (queries, block))
            ids, places, keep = block["vec_id"].to_numpy(), block["place"].to_numpy(), min(KEEP * k, len(block))
            for i in range(0, len(q), 512):
                d = _square(q[i : i + 512], x)
                own = queries["vec_id"].to_numpy()[i : i + 512]
                far = (ids[None, :] == own[:, None]) | (np.abs(places[None, :] - queries["place"].to_numpy()[i : i + 512][:, None]) > queries["reach"].iloc[0])
                d[far] = np.inf
                for j in range(len(d)):
                    near = np.flatnonzero((d[j] <= np.partition(d[j], keep - 1)[keep - 1]) & np.isfinite(d[j]))
                    near = near[np.lexsort((ids[near], d[j][near]))[:keep]]
                    out[0].append(np.full(len(near), own[j]))
                    out[1].append(ids[near])
        return pd.DataFrame({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1])}).astype("int64")

    return run


def _within(ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int):
    """Vectors within each query's bound (squared): of a batch the k nearest, ties by id."""
    middle = q.mean(0)
    centred = q - middle
    qq = (centred**2).sum(1)

    def run(batches):
        for b in batches:
            x, own = _matrix(b.column("v")), b.column("vec_id").to_numpy()
            if not len(own):
                continue
            c = x - middle
            xx = (c**2).sum(1)
            size = qq[:, None] + xx[None, :]
            # what rounding may add to a distance grows with the vectors' sizes
            i, j = np.nonzero((size - 2 * centred @ c.T <= bound[:, None] * (1 + 1e-9) + 1e-12 * size) & (ids[:, None] != own[None, :]))
            exact = np.zeros(len(i))
            for n in range(q.shape[1]):  # in the components' order, as _distance sums
                exact += (q[i, n] - x[j, n]) ** 2
            o = np.lexsort((own[j], exact, i))
            i, j = i[o], j[o]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield rows([("query_id", pa.int64()), ("vec_id", pa.int64())], query_id=ids[i[best]], vec_id=own[j[best]])

    return run


def _distance(a: str, b: str):
    # summed in the components' order, so that it is the same everywhere
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _ranked(pairs: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """The k nearest of these pairs by query: query_id, rank, vec_id, score."""
    p = pairs.distinct().join(v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(v, "vec_id")
    p = p.select("query_id", "vec_id", _distance("qv", "v").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def placed(v: DataFrame, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """Every vector's place (from 0) along every curve: curve, place, vec_id, code. Written to the shared folder."""
    spark = v.sparkSession
    got = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    x = _matrix(got["v"].combine_chunks()) if got.num_rows else np.zeros((0, 1))
    if not len(x):
        return spark.createDataFrame([], "curve int, place long, vec_id long, code binary")
    turn = Curves(x, curves, dims)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            code = [c.tobytes() for c in turn.codes(x)] if len(x) else []
            for c in range(curves if len(x) else 0):
                yield rows(_PLACED, curve=np.full(len(x), c, np.int32), key=turn.keys(x, c, bits), vec_id=b.column("vec_id"), code=code)

    keyed = v.mapInArrow(run, "curve int, key long, vec_id long, code binary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = table(keyed.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "curve")
    # what stands before each partition's share of a curve; a row for each partition and curve
    share = keyed.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    share = share.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("low"))
    return keyed.join(F.broadcast(share.select("curve", "part", "before")), ["curve", "part"]).select("curve", (F.col("at") + F.col("before")).alias("place"), "vec_id", "code")


def window_neighbours(v: DataFrame, is_query, k: int = K, window: int = WINDOW, curves: int = CURVES) -> DataFrame:
    """Candidates from the curves' windows: query_id, vec_id. v as usable() gives it."""
    p = placed(v, curves).withColumn("block", F.floor(F.col("place") / window))
    near = F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)]))
    q = p.where(is_query).select(F.col("curve").alias("q_curve"), near.alias("q_block"), F.col("place").alias("place"), F.col("vec_id").alias("vec_id"), F.col("code").alias("code"), F.lit(window).alias("reach"))
    return q.groupBy("q_curve", "q_block").cogroup(p.groupBy("curve", "block")).applyInPandas(_window_block(k), "query_id long, vec_id long")


def search(vectors: DataFrame, every: int = 100, k: int = K, window: int = WINDOW, curves: int = CURVES, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query, a vector whose id is divisible by every."""
    spark = vectors.sparkSession
    prepare(spark)
    v = table(usable(vectors), "vectors")
    is_query = F.col("vec_id") % every == 0
    first = table(_ranked(window_neighbours(v, is_query, k, window, curves), v, k), "windows")
    if not exact:
        return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    bounds = first.groupBy("query_id").agg(F.max("score").alias("bound"), F.count("*").alias("n"))
    q = v.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).join(bounds, "query_id", "left").withColumn("bound", F.when(F.col("n") >= k, F.col("bound")).otherwise(float("inf")))
    n = q.count()
    blocks = max(1, -(-n // BLOCK))
    q = table(q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries")
    found = first.select("query_id", "vec_id")
    for b in range(blocks):
        got = q.where(F.col("block") == b).toArrow()
        if got.num_rows:
            near = v.mapInArrow(_within(got["query_id"].to_numpy(), _matrix(got["qv"].combine_chunks()), np.minimum(got["bound"].to_numpy() ** 2, 1e300), k), "query_id long, vec_id long")
            found = found.union(near)
    return _ranked(found, v, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b, 0.0::DOUBLE)) AS score
      FROM u q JOIN u c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""
