"""Centroid clusters against plain full comparisons in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlcorpus.llm.centroids import CentroidLists, cluster_vectors, with_inertia


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_equals_full_comparison(kind):
    rng = np.random.default_rng(1)
    for spread, k, width in ((3, 8, 4), (50, 8, 16), (1000, 40, 64), (1, 5, 3), (1000, 1, 64)):
        x, c = rng.integers(-spread, spread + 1, (300, width)), rng.integers(-spread, spread + 1, (k, width))
        if k > 4:
            c[3] = c[1]  # equal centroids: the smaller number wins
        number, distance, exact = CentroidLists(c.astype(kind)).nearest(x.astype(kind))
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
        assert exact <= 300 * k
    # Far groups: the frontier sum passes the best distance before all centroids are met.
    c = rng.integers(-5, 5, (64, 32)) + np.arange(64)[:, None] * 1000
    x = rng.integers(-5, 5, (500, 32)) + rng.integers(0, 64, 500)[:, None] * 1000
    number, _, exact = CentroidLists(c.astype(kind)).nearest(x.astype(kind))
    assert (number == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all() and exact < 500 * 8


def slow_clusters(rows, k, rounds, width, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-1 << 62, min(1 << 62, x)) for x in v]) for i, v in kept]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        homes = [nearest(v)[1] for _, v in kept]
        moved = []
        for n, c in enumerate(centroids):
            own = [v for (_, v), h in zip(kept, homes) if h == n]
            moved.append([sum(x) // len(own) for x in zip(*own)] if own else c)
        centroids = moved
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    top = (1 << 63) - 1
    inertia = {n: sum(min(d, top) for _, h, d in out if h == n) for n in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = min(sum(inertia.values()), top)
    return sorted(((i, h, min(d, top), min(inertia[h], top), total, sha[h]) for i, h, d in out), key=str)


@pytest.mark.parametrize("odd", [False, True])
def test_operator_equals_plain_version(spark, workspace, odd):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(300)]
    rows += [(i, [0.5] * 5) for i in range(300, 420)] + [(7, [0.1] * 5), (7, [0.1] * 5), (7, [0.2] * 5), (None, [1.0] * 5)]
    rows += [(500, None), (501, []), (502, [1.0] * 4), (503, [1.0] * 6), (504, [1.0, None, 1.0, 1.0, 1.0]),
             (505, [float("nan")] * 5), (506, [float("inf")] * 5)]
    if odd:
        rows += [(600, [1e9] * 5), (601, [-3e12, 1e300, 0.0, -1e300, 5.0]), (602, [2.0 ** 40] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("distance", F.lit("x")).withColumn(
        "_v", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(6)
    got = with_inertia(*cluster_vectors(frame, workspace, 8, 10, 5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_clusters(rows, 8, 10, 5)
    few = with_inertia(*cluster_vectors(frame.where("vec_id in (500, 7)"), workspace, 8, 10, 5))
    assert sorted((tuple(r) for r in few.collect()), key=str) == slow_clusters([r for r in rows if r[0] in (500, 7)], 8, 10, 5)
    none = with_inertia(*cluster_vectors(frame.limit(0), workspace, 8, 10, 5))
    assert none.columns == got.columns and none.count() == 0


def test_tasks_send_sums_only(spark, workspace):
    """Whatever share of the vectors one cluster holds, a task hands on a row for each centroid and component."""
    rows = [(i, [1.0, 1.0] if i % 3 else [float(i), 0.0]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assigned, centroids = cluster_vectors(frame, workspace, 3, 4, 2)
    assert assigned.count() == 3000 and len(centroids) == 3
