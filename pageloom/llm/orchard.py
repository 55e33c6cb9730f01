"""Centroid clustering in whole numbers, with Orchard's search for the nearest centroid.

Every centroid has a list of the others, nearest first. The search for a vector walks the
list of its current centroid. When it meets a closer one it jumps to that one's list; what
has been compared is marked and not compared again. It stops at the first entry that lies
strictly beyond twice the vector's distance from its current centroid: by the triangle
inequality, no later entry can be as near, so ties are settled exactly, too (the smaller
number wins). All vectors of a batch walk at once.

Components become floor(scale * x); distances, sums and means are whole numbers, so results
depend neither on the order of rows nor on partitions. A task sums its own vectors and hands
on one row a centroid and component; these rows are added by Spark, and what reaches the
driver is one number for each of them. Lists and centroids, k * k + k * dims numbers, go
with the tasks; k is a parameter.

Defined results: vectors that are null, of another length, or hold a null or a non-finite
component are left out. Repeated rows count as often as they occur; identifiers may repeat
and may be null (a null one starts a centroid only after all others). Starts that tie are
ordered by their components. With fewer vectors than k, each starts a centroid. An empty
table gives an empty result. Distances and sums that do not fit into a long are null.
Components too large for 64-bit distances are worked on as Python's whole numbers. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import written

LIMB = 10**18  # sums travel as digits of this base
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class ClusterSettings:
    k: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    start: str = "3:"  # put before an identifier to draw the first centroids


def small(values: np.ndarray) -> bool:
    """Whether 64-bit numbers hold every distance between such vectors."""
    bound = math.isqrt((1 << 60) // max(1, values.shape[-1]))
    return not values.size or bool(np.abs(values).max() < bound)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly."""
    scaled = np.floor(x * scale)
    if small(scaled):
        return scaled.astype(np.int64)
    return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()], dtype=object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


class Orchard:
    """Centroids with their neighbour lists."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        exact = np.array(centroids, dtype=object)
        self.centroids = exact.astype(np.int64) if small(exact) else exact
        self.k = len(centroids)
        apart = np.array([squared(self.centroids, c) for c in self.centroids])
        others = [[j for j in sorted(range(self.k), key=lambda j: (apart[i, j], j)) if j != i] for i in range(self.k)]
        self.lists = np.array(others, dtype=np.int64).reshape(self.k, self.k - 1)
        self.gaps = np.take_along_axis(apart, self.lists, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid; distances worked out."""
        centroids = self.centroids
        if x.dtype != centroids.dtype:
            x, centroids = x.astype(object), centroids.astype(object)
        now, place = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        best = squared(x, centroids[0])
        seen = np.zeros((len(x), self.k), dtype=bool)
        seen[:, 0] = True
        on, compared = np.arange(len(x) if self.k > 1 else 0), len(x)
        while len(on):
            own, at = now[on], place[on]
            reach = (self.gaps[own, at] <= 4 * best[on]).astype(bool)
            on, other = on[reach], self.lists[own, at][reach]
            place[on] += 1
            fresh = ~seen[on, other]
            rows, other = on[fresh], other[fresh]
            seen[rows, other] = True
            found = squared(x[rows], centroids[other])
            compared += len(rows)
            closer = ((found < best[rows]) | (found == best[rows]) & (other < now[rows])).astype(bool)
            rows = rows[closer]
            now[rows], best[rows], place[rows] = other[closer], found[closer], 0
            on = on[place[on] < self.k - 1]
        return now, best, compared


def usable(rows: DataFrame, key: str, vector: str, s: ClusterSettings) -> DataFrame:
    """(key_, v_) of the vectors that take part, written once for all rounds."""
    v = F.col(vector) if dict(rows.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).alias("key_"), v.alias("v_"))
    finite = F.forall("v_", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return written(rows.where((F.size("v_") == s.dims) & finite), "vectors")


def matrix(column: pa.ListArray, s: ClusterSettings) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, s.dims), s.scale)


def starts(vectors: DataFrame, s: ClusterSettings) -> list[tuple[int, ...]]:
    draw = F.sha2(F.concat(F.lit(s.start), F.col("key_").cast("string")), 256)
    first = vectors.select(draw.alias("draw"), "v_").orderBy(F.asc_nulls_last("draw"), "v_").limit(s.k).collect()
    return [tuple(whole(np.array([r.v_], dtype=np.float64), s.scale)[0].tolist()) for r in first]


def moved(vectors: DataFrame, centroids: list[tuple[int, ...]], s: ClusterSettings) -> list[tuple[int, ...]]:
    """Centroids after one round: floors of the means of the vectors nearest to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        sums, counts = np.zeros((len(centroids), s.dims), dtype=object), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column("v_"), s)
            if not len(x):
                continue
            now, _, _ = orchard.nearest(x)
            counts += np.bincount(now, minlength=len(centroids))
            order = np.argsort(now, kind="stable")
            present, first = np.unique(now[order], return_index=True)
            sums[present] += np.add.reduceat(x[order], first, axis=0)
        rows = []
        for c in np.flatnonzero(counts).tolist():
            rows.append((c, -1, 0, int(counts[c])))
            for at, value in enumerate(sums[c].tolist()):
                limb, value = 0, int(value)
                while True:
                    value, low = divmod(value, LIMB) if not -LIMB < value < LIMB else (0, value)
                    rows.append((c, at, limb, low))
                    if not value:
                        break
                    limb += 1
        columns = list(zip(*rows)) or [()] * 4
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["cluster", "at", "limb", "value"])

    parts = vectors.select("v_").mapInArrow(run, "cluster int, at int, limb int, value bigint")
    total = parts.groupBy("cluster", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()
    sums: dict[tuple[int, int], int] = {}
    for r in total:
        sums[r.cluster, r.at] = sums.get((r.cluster, r.at), 0) + int(r.total) * LIMB**r.limb
    return [tuple(sums[c, at] // sums[c, -1] for at in range(s.dims)) if (c, -1) in sums else old for c, old in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: list[tuple[int, ...]], s: ClusterSettings) -> DataFrame:
    """(key_, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids) if centroids else None
        for batch in batches:
            x = matrix(batch.column("v_"), s)
            if not len(x):
                continue
            now, best, _ = orchard.nearest(x)
            far = pa.array([int(d) if d <= LONGEST else None for d in best.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key_"), pa.array(now, pa.int32()), far], names=["key_", "cluster", "distance"])

    return vectors.mapInArrow(run, f"key_ {dict(vectors.dtypes)['key_']}, cluster int, distance bigint")


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: ClusterSettings = ClusterSettings()) -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    s = settings
    vectors = usable(rows, key, vector, s)
    centroids = starts(vectors, s)
    for _ in range(s.rounds if centroids else 0):
        before, centroids = centroids, moved(vectors, centroids, s)
        if centroids == before:  # further rounds would change nothing
            break
    found = written(assigned(vectors, centroids, s), "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("gone"))
    totals = {r.cluster: None if r.gone else int(r.total) for r in sums.collect()}  # one a centroid
    whole_ = None if None in totals.values() else sum(totals.values())
    of_each = [(c, fits(totals.get(c, 0)), fits(whole_), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    table = rows.sparkSession.createDataFrame(of_each, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    named = found.join(F.broadcast(table), "cluster")  # k rows
    return named.select(F.col("key_").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def fits(value: int | None) -> int | None:
    return value if value is not None and value <= LONGEST else None
