import hashlib
import math

import numpy as np
import pytest

from trackloom.llm.sort_means import clusters_with_inertia, reassign, sort_means

SHAPE = "vec_id long, embedding array<double>, cluster string, v string"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == c]
            centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    last = [(i, *nearest(v)) for i, v in kept]
    per = {}
    for _, d, c in last:
        per[c] = per.get(c, 0) + d
    return sorted(((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in last), key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SHAPE)
    return sorted((tuple(r) for r in clusters_with_inertia(df, **options).collect()), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.1, (400, 5)) + rng.normal(0, 1, (6, 5))[rng.integers(0, 6, 400)])]
    assert found(spark, rows, k=8, rounds=6, dims=5) == brute(rows, 8, 6, 5)


def test_odd_rows_repeats_and_ties(spark):
    rows = [(i, [float(i % 3), float(-i % 2)]) for i in range(40)] + [(1, [1.0, -1.0])] * 3
    rows += [(50, None), (51, [1.0]), (52, [1.0, 2.0, 3.0]), (53, [None, 1.0]), (54, [float("nan"), 1.0]), (55, [float("-inf"), 1.0]), (None, [0.5, 0.25]), (56, [])]
    assert found(spark, rows, k=8, rounds=4, dims=2) == brute(rows, 8, 4, 2)


def test_few_vectors_none_and_large_ones(spark):
    rows = [(7, [1.0, 2.0]), (8, [3.0, 4.0])]
    assert found(spark, rows, k=8, rounds=3, dims=2) == brute(rows, 8, 3, 2)
    assert found(spark, [], k=8, rounds=3, dims=2) == []
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e6, 0.0])], dims=2)
    out, centroids = sort_means(spark.createDataFrame([(1, None, "a", "b")], SHAPE), dims=2)
    assert out.count() == 0 and centroids.shape == (0, 2)


def test_scan_stops_only_strictly_beyond_twice_the_distance():
    # The vector lies midway between its centroid 1 and centroid 0, which is exactly twice as far: a tie for number 0.
    cluster, distance = reassign(np.array([[5]]), np.array([1]), np.array([[10], [0]]))
    assert cluster.tolist() == [0] and distance.tolist() == [25]


def test_every_start_finds_the_nearest():
    rng = np.random.default_rng(9)
    x, c = rng.integers(-20, 20, (500, 2)), rng.integers(-20, 20, (12, 2))
    want = ((x[:, None] - c[None]) ** 2).sum(2)
    for old in range(12):
        cluster, distance = reassign(x, np.full(500, old), c)
        assert (cluster == want.argmin(1)).all() and (distance == want.min(1)).all()
