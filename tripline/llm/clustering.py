"""Exact integer k-means; bounds from an n-simplex projection spare most comparisons.

A few vectors are pivots. The distances between them place them as the base of
a simplex; the distances of any point to them then fix its apex: its place in
the pivots' flat and its height above it. The apex of each vector is worked
out once and stored with it. With apexes (x, h) and (y, g), two points are at
least ``sqrt(|x - y|^2 + (h - g)^2)`` and at most ``sqrt(|x - y|^2 + (h + g)^2)``
apart, so a centroid whose lower bound is above another one's upper bound is not
the nearest. What is left is compared exactly, in integers. Floating-point
errors only ever keep more centroids, because the bounds are taken with slack.

Each round is one pass over the stored vectors. A task sums its vectors by
cluster before anything is shuffled; the driver sees one sum per cluster and
component, and a bounded sample of vectors for the first centroids and pivots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.operators.workdir import WorkDir

SCALE = 1024
#: Vectors with a larger component are left out: squared distances must fit a long.
LARGEST = 1 << 27
PIVOTS = 12
#: Vectors, in hash order, that pivots are picked from.
SAMPLE = 512
_BLOCK = 4096
_SLACK = 1e-6


def squared_distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances (integers) of every point to every row of ``to``."""
    return np.stack([np.square(points - one).sum(1) for one in to], axis=1) if len(to) else np.zeros((len(points), 0), np.int64)


class Simplex:
    """The base simplex of a few integer vectors, without those that lie (almost) in the flat of others."""

    def __init__(self, pivots: np.ndarray):
        between = squared_distances(pivots, pivots).astype(np.float64)
        self.chosen: list[int] = []
        self._corners = np.zeros((0, 0))
        for at in range(len(pivots)):
            apex = self.apexes(between[at : at + 1, self.chosen])[0] if self.chosen else np.zeros(0)
            if not self.chosen:
                self.chosen.append(at)
            elif apex[-1] ** 2 > _SLACK * between.max():
                size = len(self.chosen) - 1
                corners = np.zeros((size + 1, size + 1))
                corners[:size, :size], corners[size] = self._corners, apex
                self._corners = corners
                self.chosen.append(at)
        self.pivots = pivots[self.chosen]

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """One row per point: its place in the flat and, last, its height; from squared distances to the pivots."""
        if not squared.shape[1]:
            return np.zeros((len(squared), 0))
        corners = self._corners
        wanted = (squared[:, :1] - squared[:, 1:] + np.square(corners).sum(1)) / 2
        place = np.linalg.solve(corners, wanted.T).T if len(corners) else wanted
        height = np.sqrt(np.maximum(squared[:, 0] - np.square(place).sum(1), 0.0))
        return np.column_stack((place, height))

    def project(self, points: np.ndarray) -> np.ndarray:
        return self.apexes(squared_distances(points, self.pivots).astype(np.float64))


def may_be_nearest(apexes: np.ndarray, centroid_apexes: np.ndarray) -> np.ndarray:
    """For every point (row) the centroids that the bounds do not rule out."""
    if not apexes.shape[1]:
        return np.ones((len(apexes), len(centroid_apexes)), bool)
    flat = np.stack([np.square(apexes[:, :-1] - one[:-1]).sum(1) for one in centroid_apexes], axis=1)
    height, other = apexes[:, -1:], centroid_apexes[None, :, -1]
    slack = _SLACK * (1 + np.square(apexes).sum(1)[:, None] + np.square(centroid_apexes).sum(1)[None, :])
    lower, upper = flat + np.square(height - other) - slack, flat + np.square(height + other) + slack
    return lower <= upper.min(1, keepdims=True)


def nearest(points: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Number of the nearest centroid of each point, ties to the smaller number."""
    found = np.zeros(len(points), np.int64)
    centroid_apexes = simplex.project(centroids)
    for start in range(0, len(points), _BLOCK):
        block = points[start : start + _BLOCK]
        possible = may_be_nearest(apexes[start : start + _BLOCK], centroid_apexes)
        number = possible.argmax(1)
        open_rows = np.flatnonzero(possible.sum(1) > 1)
        if len(open_rows):
            possible, best = possible[open_rows], np.full(len(open_rows), np.iinfo(np.int64).max)
            for which in np.flatnonzero(possible.any(0)):
                rows = np.flatnonzero(possible[:, which])
                distance = np.square(block[open_rows[rows]] - centroids[which]).sum(1)
                nearer = distance < best[rows]
                best[rows[nearer]] = distance[nearer]
                number[open_rows[rows[nearer]]] = which
        found[start : start + _BLOCK] = number
    return found


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the points, each the farthest from those before it."""
    if not len(points):
        return points
    chosen, away = [0], np.square(points - points[0]).sum(1)
    while len(chosen) < min(count, len(points)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.square(points - points[chosen[-1]]).sum(1))
    return points[chosen]


def integer_vectors(vectors: DataFrame, dimensions: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``components`` (array of int) of rows with exactly ``dimensions`` finite components."""
    column = F.col(embedding)
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < LARGEST, F.lit(False)))
    return vectors.where((F.size(column) == dimensions) & fits).select(
        F.col(vec_id).alias("vec_id"), F.transform(whole, lambda x: x.cast("int")).alias("components")
    )


def _matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), width).astype(kind, copy=False)


def _with_apexes(kept: DataFrame, simplex: Simplex, dimensions: int) -> DataFrame:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.project(_matrix(batch.column(1), dimensions, np.int64))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(list(apexes), pa.list_(pa.float64()))], ["vec_id", "components", "apex"]
            )

    id_type = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(job, f"vec_id {id_type}, components array<int>, apex array<double>")


def _cluster_sums(stored: DataFrame, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid: the sum of its vectors, by component, and their number."""
    count, dimensions = centroids.shape
    width = len(simplex.chosen)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, dimensions + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(0), dimensions, np.int64)
            number = nearest(points, _matrix(batch.column(1), width, np.float64), centroids, simplex)
            order = np.argsort(number, kind="stable")
            there, starts = np.unique(number[order], return_index=True)
            sums[there, :-1] += np.add.reduceat(points[order], starts, axis=0)
            sums[:, -1] += np.bincount(number, minlength=count)
        there = np.flatnonzero(sums[:, -1])
        if len(there):
            columns = np.repeat(there, dimensions + 1), np.tile(np.arange(dimensions + 1), len(there)), sums[there].ravel()
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["cluster", "component", "total"])

    parts = stored.select("components", "apex").mapInArrow(job, "cluster long, component long, total long")
    found = np.zeros((count, dimensions + 1), np.int64)
    for row in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect():
        found[row["cluster"], row["component"]] = row["total"]
    return found[:, :-1], found[:, -1]


def _assigned(stored: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    dimensions, width = centroids.shape[1], len(simplex.chosen)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), dimensions, np.int64)
            number = nearest(points, _matrix(batch.column(2), width, np.float64), centroids, simplex)
            distance = np.square(points - centroids[number]).sum(1)
            yield pa.record_batch(
                [batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    id_type = stored.schema["vec_id"].dataType.simpleString()
    return stored.mapInArrow(job, f"vec_id {id_type}, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    work: WorkDir,
    clusters: int = 8,
    rounds: int = 10,
    dimensions: int = 64,
    seed: int = 3,
    pivots: int = PIVOTS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``cluster``, ``distance`` (squared) and its cluster's figures.

    Components are ``floor(1024 * x)``. Rows are left out if the vector is
    NULL, has another number of components, one that is NULL or not finite, or
    one of 2^17 or more, whose squared distances would not fit a long.
    Centroids start as the vectors with the smallest hexadecimal sha256 of
    ``seed:vec_id`` (a NULL id is empty there; ties by components), fewer if
    there are fewer vectors. A round moves every centroid that has vectors to
    the floor of their mean; rounds end early once none moves, because nothing
    can change any more. ``cluster_inertia`` and ``inertia`` are the sums of
    distances of the cluster and of all, ``centroid_sha256`` is the digest of the final
    centroid's components, as decimals joined by commas. Repeated rows and ids are
    all kept; an empty table gives an empty result; no other column is read.
    """
    kept = integer_vectors(vectors, dimensions, vec_id, embedding)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    sample = kept.orderBy(order, "components").limit(max(SAMPLE, clusters)).select("components").collect()
    points = np.array([row["components"] for row in sample], np.int64).reshape(len(sample), dimensions)
    centroids, simplex = points[:clusters].copy(), Simplex(spread_out(points[:SAMPLE], pivots))
    stored = work.store(_with_apexes(kept, simplex, dimensions), "vectors")
    for _ in range(rounds if len(centroids) else 0):
        sums, sizes = _cluster_sums(stored, centroids, simplex)
        moved = np.where(sizes[:, None] > 0, sums // np.maximum(sizes, 1)[:, None], centroids)
        if (moved == centroids).all():
            break
        centroids = moved
    assigned = work.store(_assigned(stored, centroids, simplex), "assigned")
    inertia = {row["cluster"]: row["total"] for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    figures = [
        (number, inertia[number], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[number].tolist())).encode()).hexdigest())
        for number in sorted(inertia)
    ]
    schema = "of_cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    by_cluster = F.broadcast(assigned.sparkSession.createDataFrame(figures, schema))  # one row per centroid
    return assigned.join(by_cluster, F.col("cluster") == F.col("of_cluster")).drop("of_cluster")
