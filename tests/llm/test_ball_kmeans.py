"""Ball k-means next to comparing every vector with every centroid."""

import random
from hashlib import sha256

import numpy as np
import pytest

from boardlens.llm import ball_kmeans as B


def plain(rows, k, rounds, dims, scale=1024, seed=3):
    own = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted((sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), 0, v) for i, v in own)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in own:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c[j] for j in range(len(c))]
    return sorted((repr(i), *nearest(v)[::-1]) for i, v in own), c


@pytest.mark.parametrize(("n", "k", "rounds", "dims", "spread"), [(300, 8, 10, 5, 0.3), (200, 5, 3, 2, 2.0), (3, 8, 2, 4, 1.0), (120, 8, 10, 1, 0.01)])
def test_equals_comparing_everything(spark, n, k, rounds, dims, spread):
    rng = random.Random(n)
    centers = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [round(x + rng.gauss(0, spread), 2) for x in rng.choice(centers)]) for i in range(n)]
    rows += rows[:5] + [(1000, None), (1001, [0.0] * (dims + 1)), (1002, [None] * dims), (1003, [float("nan")] * dims), (1004, [float("inf")] * dims), (None, [0.5] * dims)]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int").repartition(4)
    got, centroids = B.ball_kmeans(df, k, rounds, dims)
    want, c = plain(rows, k, rounds, dims)
    assert centroids.tolist() == c
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want


def test_ties_go_to_the_smaller_number():
    v = np.array([[0, 0], [2, 0], [1, 0], [1, 5]], np.int64)
    centroids = np.array([[2, 0], [0, 0], [0, 0]], np.int64)
    for before in ([0, 0, 0, 0], [1, 1, 1, 1], [2, 2, 2, 2], [2, 1, 0, 2]):
        cluster, distance, _ = B.assign(v, np.array(before), centroids)
        assert cluster.tolist() == [1, 0, 0, 0] and distance.tolist() == [0, 0, 1, 26]


def test_settled_balls_compare_few_neighbours():
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (50, 16))
    own = rng.integers(0, 50, 5000)
    v = centers[own] + rng.integers(-60, 60, (5000, 16))
    cluster, distance, computed = B.assign(v, own, centers)
    every = ((v[:, None] - centers[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert computed < 1.2 * len(v)


def test_the_start_does_not_matter():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-50, 50, (400, 3)), rng.integers(-50, 50, (7, 3))
    every = ((v[:, None] - c[None]) ** 2).sum(2)
    for start in (np.zeros(400, np.int64), rng.integers(0, 7, 400)):
        cluster, distance, _ = B.assign(v, start, c)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_empty_table_and_bounds(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert B.ball_kmeans(none)[0].count() == 0
    huge = spark.createDataFrame([(1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in B.ball_kmeans(huge, dims=1)[0].collect()] == [2]
    with pytest.raises(ValueError, match="64 bits"):
        B.ball_kmeans(none, dims=65)
