"""Centroid clustering by Lloyd's rounds under Drake's adaptive bounds, in exact whole numbers.

Components become integers, floor(``scale`` * x). Vectors are written once, in blocks of ``BLOCK``, in a table of buckets by
block. For each vector a second, narrow table holds its centroid, an upper bound of its distance to it, its next
few centroids in order with a lower bound each, and one lower bound for all the rest. When centroids have moved, the
bounds move with them, and a vector needs only as much work as its bounds ask for:

0. its upper bound is below all lower bounds: nothing;
1. it is so once the own distance is measured: one distance;
2. the own distance is below the bound of the rest: distances to the few, which are put in order again;
3. otherwise distances to all centroids, and all bounds anew.

Bounds are floats with some slack and count only where they are strictly apart; decisions between centroids are
made by exact squared distances, so ties go to the smaller number. How many bounds a vector keeps adapts from round
to round: more while many vectors need all distances, fewer while the last of them are hardly looked at.

Each round joins both tables on the block, bucket by bucket, and writes the narrow one anew, with each block's sums of
what entered and left a centroid; those are summed up over all blocks, and only centroids and their sums reach the
driver. The bounds of the round before are dropped. When no centroid moves, later rounds would change nothing.

Defined results: vectors that are null, of another length than ``width``, with null or non-finite components, or with
components so large that a squared distance might not fit a long (|floor(scale * x)| over 2 ** 30 / sqrt(width)) take no
part. Repeated rows are vectors of their own. A row without id is clustered, but starts no centroid. With fewer
vectors than ``k`` there are as many centroids as vectors with an id; without any the result is empty. A sum of
distances that does not fit a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import bucketed, staged, tidied

BLOCK = 4096
#: Values up to which squared distances of up to 256 components are exact in float64.
EXACT = 1 << 21
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
VECTORS = "block long, ids array<long>, x array<int>"
BOUNDS = "block long, cluster array<int>, upper array<double>, near array<int>, low array<double>, rest array<double>, work array<long>, moved array<long>"


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all centroids, both of whole numbers."""
    if x.shape[1] <= 256 and max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def some_distances(x: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own few centroids; -1 is none."""
    out = np.full(which.shape, np.iinfo(np.int64).max)
    for j in range(which.shape[1]):
        at = np.flatnonzero(which[:, j] >= 0)
        out[at, j] = ((x[at] - centroids[which[at, j]]) ** 2).sum(1)
    return out


def _under(d: np.ndarray) -> np.ndarray:
    return d * (1 - 1e-9) - 1e-6


def _over(d: np.ndarray) -> np.ndarray:
    return d * (1 + 1e-9) + 1e-6


class Bounds:
    """The bounds of a block's vectors: arrays by vector, of which ``near`` and ``low`` have a column for each bound kept."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.cluster, self.upper, self.near, self.low, self.rest = cluster, upper, near, low, rest

    @classmethod
    def unknown(cls, n: int, kept: int) -> Bounds:
        """Of vectors without a centroid yet: nothing is certain."""
        return cls(np.full(n, -1), np.full(n, np.inf), np.full((n, kept), -1), np.full((n, kept), np.inf), np.full(n, -np.inf))

    def keep(self, kept: int) -> None:
        """As many bounds a vector; those that go join the rest, new ones are empty until all distances are measured."""
        n, had = self.near.shape
        if kept < had:
            self.rest = np.minimum(self.rest, self.low[:, kept:].min(axis=1))
            self.near, self.low = self.near[:, :kept], self.low[:, :kept]
        elif kept > had:
            self.near = np.concatenate([self.near, np.full((n, kept - had), -1)], axis=1)
            self.low = np.concatenate([self.low, np.full((n, kept - had), np.inf)], axis=1)

    def shift(self, by: np.ndarray) -> None:
        """Centroids have moved ``by`` so much."""
        known = self.cluster >= 0
        self.upper[known] = _over(self.upper[known] + by[self.cluster[known]])
        self.low = np.where(self.near >= 0, _under(self.low - by[self.near]), np.inf)
        self.rest = _under(self.rest - by.max(initial=0.0))

    def renew(self, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Every vector with its nearest centroid; returns how many needed the work of each kind 0 to 3, and of kind 2 how deep they went on."""
        kept = self.near.shape[1]
        work = np.zeros(4 + kept, np.int64)
        least = np.minimum(self.low.min(axis=1, initial=np.inf), self.rest)
        at = np.flatnonzero(~(self.upper < least))
        work[0] = len(x) - len(at)
        own = self.cluster[at] >= 0
        all_of, at = at[~own], at[own]
        self.upper[at] = np.sqrt(some_distances(x[at], centroids, self.cluster[at, None])[:, 0].astype(np.float64))
        sure = _over(self.upper[at]) < least[at]
        work[1], at = int(sure.sum()), at[~sure]
        few = _over(self.upper[at]) < self.rest[at]
        all_of, at = np.concatenate([all_of, at[~few]]), at[few]
        if len(at):
            deep = kept - 1 - np.argmax((self.low[at] <= _over(self.upper[at])[:, None])[:, ::-1], axis=1)
            work[4:] = np.bincount(deep, minlength=kept)[:kept]
            work[2] = len(at)
            which = np.concatenate([self.cluster[at, None], self.near[at]], axis=1)
            self._take(at, which, some_distances(x[at], centroids, which))
        if len(all_of):
            work[3] = len(all_of)
            found = distances(x[all_of], centroids)
            which = np.broadcast_to(np.arange(len(centroids)), found.shape)
            self._take(all_of, which, found)
            place = np.partition(found, kept + 1, axis=1)[:, kept + 1] if found.shape[1] > kept + 1 else None
            self.rest[all_of] = np.inf if place is None else _under(np.sqrt(place.astype(np.float64)))
        return work

    def _take(self, at: np.ndarray, which: np.ndarray, found: np.ndarray) -> None:
        """Centroids ``which`` at exact squared distances, put in order: the first is a vector's own, the next are its bounds."""
        kept = self.near.shape[1]
        order = np.lexsort((np.where(which < 0, np.iinfo(np.int64).max, which), found), axis=1)[:, : kept + 1]
        which, root = np.take_along_axis(which, order, 1), np.sqrt(np.take_along_axis(found, order, 1).astype(np.float64))
        self.cluster[at], self.upper[at] = which[:, 0], root[:, 0]
        n = which.shape[1] - 1
        self.near[at], self.low[at] = -1, np.inf
        self.near[at, :n] = which[:, 1:]
        self.low[at, :n] = np.where(which[:, 1:] >= 0, _under(root[:, 1:]), np.inf)


def _blocks(vectors: DataFrame, scale: int, width: int) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors as integers, numbered apart by task."""

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.floor(scale * part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([number]), _one_list(part.column(0)), _one_list(pa.array(x))], ["block", "ids", "x"])
                number += 1

    return vectors.mapInArrow(pack, VECTORS)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _renewed(joined: DataFrame, centroids: np.ndarray, by: np.ndarray, kept: int) -> DataFrame:
    """Blocks with their bounds to the blocks' bounds after a round; ``moved`` sums up what entered less what left, a count and components by centroid."""
    k, width = centroids.shape

    @tidied
    def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                x = row.column("x").flatten().to_numpy().reshape(-1, width).astype(np.int64)
                if row.column("cluster").null_count:
                    bounds = Bounds.unknown(len(x), kept)
                else:
                    cluster, upper, near, low, rest = (np.array(row.column(c).flatten()) for c in ("cluster", "upper", "near", "low", "rest"))
                    bounds = Bounds(cluster, upper, near.reshape(len(x), -1), low.reshape(len(x), -1), rest)
                    bounds.keep(kept)
                    bounds.shift(by)
                before = bounds.cluster.copy()
                work = bounds.renew(x, centroids)
                moved = np.zeros((k, width + 1), np.int64)
                at = np.flatnonzero(bounds.cluster != before)
                for c in range(k):
                    entered, left = x[at[bounds.cluster[at] == c]], x[at[before[at] == c]]
                    moved[c] = [len(entered) - len(left), *(entered.sum(0) - left.sum(0))]
                whole = [pa.array(v.ravel()) for v in (bounds.cluster.astype(np.int32), bounds.upper, bounds.near.astype(np.int32), bounds.low, bounds.rest, work, moved)]
                yield pa.RecordBatch.from_arrays([row.column("block"), *map(_one_list, whole)], ["block", "cluster", "upper", "near", "low", "rest", "work", "moved"])

    return joined.mapInArrow(renew, BOUNDS)


def _sums(bounds: DataFrame, column: str, n: int) -> np.ndarray:
    """An array column's sums over all blocks, place by place."""
    out = np.zeros(n, np.int64)
    for at, value in bounds.select(F.posexplode(column).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[at] = value
    return out


def _dropped(spark: SparkSession, name: str | None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector after ``rounds`` rounds.

    The first centroids are the vectors whose ``seed`` followed by their id has the smallest SHA-256. ``distance`` is squared.
    """
    spark = vectors.sparkSession
    most = math.isqrt(2**60 // width)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(F.size("v") == width)
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x.cast("double") * scale >= -most) & (x.cast("double") * scale < most + 1)))
    chance = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = v.where("id is not null").select(chance.alias("chance"), "v").orderBy("chance", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.floor(scale * np.array([r["v"] for r in first], np.float64)).astype(np.int64)
    k = len(centroids)
    table, bounds = bucketed(_blocks(v, scale, width), "vectors", "block"), None
    try:
        blocks = spark.table(table)
        kept, by, sums = max(1, -(-k // 4)), np.zeros(k), np.zeros((k, width + 1), np.int64)
        for number in range(rounds + 1):
            joined = blocks.join(spark.table(bounds).drop("work", "moved"), "block") if bounds else blocks.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in BOUNDS.split(", ")[1:-2])))
            before, bounds = bounds, f"bounds_{uuid.uuid4().hex}"
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            _renewed(joined, centroids, by, kept).write.format("parquet").bucketBy(buckets, "block").saveAsTable(bounds)
            _dropped(spark, before)
            if number == rounds:
                break
            now = spark.table(bounds)
            sums += _sums(now, "moved", k * (width + 1)).reshape(k, -1)
            work = _sums(now, "work", 4 + kept)
            kept = adapted(work, kept, k)
            full = sums[:, 0] > 0
            moved = centroids.copy()
            moved[full] = sums[full, 1:] // sums[full, :1]
            by = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(1))
            if not by.any():
                break
            centroids = moved
        final = blocks.join(spark.table(bounds).select("block", "cluster"), "block")
        return _measured(final, centroids)
    finally:
        _dropped(spark, bounds)
        _dropped(spark, table)


def adapted(work: np.ndarray, kept: int, k: int) -> int:
    """How many bounds to keep, after the counts of a round's work: one more if over a tenth needed all distances, one fewer if the last bounds served under a hundredth."""
    n = work[:4].sum()
    if work[3] * 10 > n and work[0] + work[1] + work[2] > 0:
        return min(kept + 1, max(1, k // 2))
    return max(1, kept - 1) if work[4:][-1] * 100 < n and work[3] * 100 < n else kept


def _measured(final: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row for each vector, with exact distances and what holds for its cluster."""
    k, width = centroids.shape

    @tidied
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, own = row.column("x").flatten().to_numpy().reshape(-1, width).astype(np.int64), row.column("cluster").flatten()
                far = ((x - centroids[own.to_numpy()]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), own, pa.array(far)], ["vec_id", "cluster", "distance"])

    found = staged(final.mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters")
    totals: list[int] = [0] * k
    for c, total in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect():
        totals[c] = int(total)
    fits = lambda total: F.lit(total if total < 2**63 else None).cast("long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", "distance", of(map(fits, totals)).alias("cluster_inertia"), fits(sum(totals)).alias("inertia"), of(map(F.lit, names)).alias("centroid_sha256")
    )
