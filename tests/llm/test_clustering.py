from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tests.llm.conftest import rows_of
from tripline.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster string, components string, apex string, distance string"


def brute(rows, clusters, rounds, dimensions, seed=3):
    """Plain integer k-means with Python's own numbers."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in vector]))
    key = lambda row: (hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        numbers = assign()
        for c in range(len(centroids)):
            members = [v for (_, v), n in zip(kept, numbers) if n == c]
            if members:
                centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    numbers = assign()
    found = [(i, n, apart(v, centroids[n])) for (i, v), n in zip(kept, numbers)]
    total = sum(d for _, _, d in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, n, d, sum(e for _, m, e in found if m == n), total, sha[n]) for i, n, d in found], key=repr)


def vectors(seed, count, dimensions, centres):
    state = random.Random(seed)
    middles = [[state.gauss(0, 1) for _ in range(dimensions)] for _ in range(centres)]
    return [(n, [x + state.gauss(0, 0.2) for x in state.choice(middles)]) for n in range(count)]


CASES = {
    "groups": (vectors(1, 150, 6, 4), 4, 5, 6),
    "one dimension, ties": ([(n, [float(n % 7)]) for n in range(40)], 5, 4, 1),
    "all the same": ([(n, [0.5, 0.25]) for n in range(20)], 3, 3, 2),
    "on a line": ([(n, [n * 0.1, n * 0.2, n * 0.3]) for n in range(30)], 4, 10, 3),
    "fewer vectors than centroids": ([(1, [1.0, 2.0]), (2, [3.0, -4.0])], 8, 3, 2),
    "large and small": ([(1, [1e5, 0.0]), (2, [-1e5, 0.0]), (3, [0.0, 1e-5]), (4, [0.0, -1e-5]), (5, [99999.0, 1.0])], 3, 4, 2),
    "odd rows": (
        [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []),
         (None, [0.0, 0.0]), (None, [0.1, 0.0]), (1, [1.0, 2.0]), (8, [-0.001, 0.0])], 3, 4, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_clusters_equal_plain_k_means(spark, work, name):
    rows, clusters, rounds, dimensions = CASES[name]
    frame = spark.createDataFrame([(*row, "c", "v", "a", "d") for row in rows], SCHEMA)
    found = clustering.cluster(frame, work, clusters, rounds, dimensions, pivots=4)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(found, *found.columns) == brute(rows, clusters, rounds, dimensions)


def test_components_too_large_are_left_out(spark, work):
    frame = spark.createDataFrame([(1, [1e38], *"abcd"), (2, [1.0], *"abcd")], SCHEMA)
    assert rows_of(clustering.cluster(frame, work, 2, 2, 1), "vec_id", "distance") == [(2, 0)]


def test_no_vectors(spark, work):
    frame = spark.createDataFrame([], SCHEMA)
    assert clustering.cluster(frame, work).count() == 0


@pytest.mark.parametrize("pivots", [0, 1, 2, 7, 12])
def test_bounds_hold_and_spare_comparisons(pivots):
    points = np.array([v for _, v in vectors(2, 400, 10, 6)]) * 1024
    points = np.floor(points).astype(np.int64)
    simplex = clustering.Simplex(clustering.spread_out(points[:64], pivots) if pivots else points[:0])
    centroids = points[::40]
    exact = clustering.squared_distances(points, centroids)
    possible = clustering.may_be_nearest(simplex.project(points), simplex.project(centroids))
    assert possible[np.arange(len(points)), exact.argmin(1)].all()
    assert (clustering.nearest(points, simplex.project(points), centroids, simplex) == exact.argmin(1)).all()
    assert possible.mean() < {0: 1.01, 1: 0.95, 2: 0.9, 7: 0.4, 12: 0.2}[pivots]


def test_apexes_keep_distances_between_pivots_flat():
    points = np.array([[0, 0, 0], [9, 0, 0], [18, 0, 0], [3, 4, 0], [3, 4, 0], [1, 2, 7]], np.int64)
    simplex = clustering.Simplex(points)
    assert simplex.chosen == [0, 1, 3, 5]
    apexes = simplex.project(points)
    found = np.square(apexes[:, None, :] - apexes[None, :, :]).sum(2)
    assert np.allclose(found, clustering.squared_distances(points, points))
