"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are spread over shards. A shard projects its vectors on a fixed number
of seeded Gaussian directions and sorts each projection. A query's window in
each projection is centred at the query's own value and widened step by step
(virtual rehashing: no bucket is ever rebuilt). A vector that is within the
windows of at least ALPHA of the projections is verified by its true distance.

A vector at distance d is within a window of half-width h with the chance that
a standard normal value is within h / d. So at half-width h all vectors up to
the radius h / Z cross the threshold with a chance of about CONFIDENCE each; a
query stops when its k-th verified distance is within that radius, or its
windows hold everything. There is no limit to how many vectors are verified.

The queries are the rows that a condition on the id names (all rows without
one). Each meets every shard, in blocks, and the shards' best are merged, so the
work is the number of queries times the number of vectors.

Cases: rows with a null id, and vectors that are null, empty, hold null, NaN,
an infinity or a value of LARGEST or more (whose squares single precision can't
hold), or haven't the dimension that most vectors have (the lowest at a tie),
are left out. Rows of one id aren't each other's neighbours; repeated rows count
once, and rows of one id with other vectors as the nearest of them. Equal
distances go by id. With fewer than k other ids, all are returned. An empty
table, and one without queries, gives no rows. Extra columns, whatever their
names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import narrow, per_batch, settled

K, PROJECTIONS, ALPHA, CONFIDENCE, SEED = 10, 32, 0.5, 0.93, 3
SHARD, QUERIES = 16_384, 8_192
GROWTH, LARGEST = 1.25, 1e18
#: The registered query asks for the rows whose id this divides.
ASKED = 50
SCHEMA = "vec_id bigint, neighbour_id bigint, distance double"


def radius_factor(projections: int, alpha: float, confidence: float) -> float:
    """Z: half-width over radius at which a vector reaches the collision threshold with the confidence."""
    normal = NormalDist()
    p = alpha + normal.inv_cdf(confidence) * (alpha * (1 - alpha) / projections) ** 0.5
    return normal.inv_cdf((1 + min(p, 0.999)) / 2)


class Sorted:
    """The projections of some vectors, each sorted."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, projections: int, seed: int):
        self.x, self.ids = x, ids
        self.squares = (x.astype(np.float64) ** 2).sum(1)
        self.a = np.random.default_rng(seed).normal(size=(x.shape[1], projections)).astype(np.float32)
        p = (x @ self.a).astype(np.float64)
        order = np.argsort(p, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        values = np.take_along_axis(p, order, 0).T
        # All projections in one sorted array, each shifted beyond the one before.
        self.low_end, self.high_end = values.min() - 1, values.max() + 1
        self.shift = np.arange(projections) * 4 * (self.high_end - self.low_end)
        self.flat = (values + self.shift[:, None]).ravel()
        self.base = np.arange(projections) * len(x)

    def typical(self, k: int) -> float:
        """The median distance of a few vectors' k-th neighbour: where the first windows start."""
        some = self.x[:: max(1, len(self.x) // 16)].astype(np.float64)
        d = np.maximum(self.squares + (some**2).sum(1)[:, None] - 2 * some @ self.x.T, 0)
        return float(np.median(np.sqrt(np.partition(d, min(k, d.shape[1] - 1), axis=1)[:, min(k, d.shape[1] - 1)])))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, alpha: float, confidence: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and distances of its nearest, without places of its own id."""
        m = len(self.order)
        z, threshold = radius_factor(m, alpha, confidence), int(np.ceil(alpha * m))
        start = max(0.97 * self.typical(k) * z, (self.high_end - self.low_end) / 200)
        centres = (queries @ self.a).astype(np.float64).clip(self.low_end, self.high_end)
        return [self._search(q, c, o, k, threshold, z, start) for q, c, o in zip(queries.astype(np.float64), centres, own, strict=True)]

    def _search(self, q, centre, own, k, threshold, z, h):
        m, n = self.order.shape
        low = high = np.searchsorted(self.flat, centre + self.shift) - self.base
        count, done = np.zeros(n, np.int64), np.zeros(n, bool)
        places, distances, square = np.zeros(0, np.int64), np.zeros(0), float(q @ q)
        while True:
            reach = np.concatenate([(centre - h).clip(self.low_end), (centre + h).clip(max=self.high_end)])
            edges = np.searchsorted(self.flat, reach + np.tile(self.shift, 2)) - np.tile(self.base, 2)
            first, last = np.minimum(edges[:m], low), np.maximum(edges[m:], high)
            parts = [o[a:b] for o, a, b in zip(self.order, first.tolist(), low.tolist(), strict=True) if a < b]
            parts += [o[a:b] for o, a, b in zip(self.order, high.tolist(), last.tolist(), strict=True) if a < b]
            low, high = first, last
            if parts:
                count += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((count >= threshold) & ~done)
            if len(new):
                done[new] = True
                new = new[self.ids[new] != own]
                rough = self.squares[new] - 2 * (self.x[new] @ q.astype(np.float32))
                if len(new) > 4 * k:  # the exact distance of all that may be among the best
                    by = np.argsort(rough, kind="stable")
                    _, first = np.unique(self.ids[new[by]], return_index=True)
                    if len(first) > 4 * k:  # an id of many rows counts once
                        bound = rough[by[np.sort(first)[4 * k - 1]]]
                        new = new[rough <= bound + 1e-5 * (abs(bound) + square)]
                d = np.sqrt(((self.x[new] - q) ** 2).sum(1))
                places, distances = np.concatenate([places, new]), np.concatenate([distances, d])
                best = np.lexsort((self.ids[places], distances))
                _, once = np.unique(self.ids[places[best]], return_index=True)
                best = best[np.sort(once)[:k]]  # rows that repeat an id take one place
                places, distances = places[best], distances[best]
            if not low.any() and (high == n).all():
                return places, distances
            if len(places) == k and distances[-1] * z <= h:
                return places, distances
            h = min(h * GROWTH, float(distances[-1]) * z * 1.0001) if len(places) == k else h * GROWTH


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id and packed (float32 bytes) of the vectors that take part, and their dimension (0: none)."""
    own = narrow(table, id=id_col, v=vector_col).select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<float>").alias("v"))
    fit = own.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < %r)" % LARGEST)
    top = fit.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = top.d if top else 0

    def make():
        def step(columns):
            flat = columns[1].flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)
            yield {"id": columns[0], "packed": [r.tobytes() for r in flat]}

        return step

    return per_batch(fit.where(F.size("v") == d), make, "id bigint, packed binary") if d else fit.select("id", F.lit(b"").alias("packed")).limit(0), d


def nearest(table: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, alpha: float = ALPHA, confidence: float = CONFIDENCE, seed: int = SEED, shard: int = SHARD, queries: int = QUERIES, asked: Callable[[Column], Column] | None = None) -> DataFrame:
    """vec_id, rank (1 to k), neighbour_id and Euclidean distance (6 places) for every vector whose id fits asked."""
    fit, d = valid_vectors(table, id_col, vector_col)
    if not d:
        return table.sparkSession.createDataFrame([], "vec_id bigint, rank int, neighbour_id bigint, distance double")
    rows = settled(fit.distinct())
    wanted = rows if asked is None else rows.where(asked(F.col("id")))
    shards, blocks = max(1, -(-rows.count() // shard)), max(1, -(-wanted.count() // queries))
    place = F.xxhash64("id", "packed")
    # Each vector goes to its shard once for each block of queries, and as a query to each shard.
    here, block = F.pmod(place, F.lit(shards)), F.pmod(F.shiftright(place, 20), F.lit(blocks))
    data = rows.select(here.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), "id", "packed")
    asking = wanted.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), block.cast("int").alias("block"), F.lit(1).alias("side"), "id", "packed")

    def searched(cell: pa.Table) -> pa.Table:
        # Sorted, as where the first windows start depends on a few rows: the result is the same each time.
        cell = cell.sort_by([("side", "ascending"), ("id", "ascending"), ("packed", "ascending")])
        side, ids = cell["side"].to_numpy(), cell["id"].to_numpy()
        x = np.frombuffer(b"".join(cell["packed"].to_pylist()), np.float32).reshape(-1, d)
        owner, near, distance = [], [], []
        if (side == 0).any() and (side == 1).any():
            index = Sorted(x[side == 0], ids[side == 0], projections, seed)
            for own, (p, far) in zip(ids[side == 1], index.search(x[side == 1], ids[side == 1], k, alpha, confidence), strict=True):
                owner.append(np.full(len(p), own))
                near.append(index.ids[p])
                distance.append(far)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"vec_id": join(owner, np.int64), "neighbour_id": join(near, np.int64), "distance": join(distance, np.float64)})

    found = data.union(asking).groupBy("shard", "block").applyInArrow(searched, SCHEMA)
    once = found.groupBy("vec_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")))
    return ranked.where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asked=lambda i: i % ASKED == 0)
