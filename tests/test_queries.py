import itertools
import math

import numpy as np
import pytest

import __spark_entry__
from trackloom import queries
from trackloom.ml import models
from trackloom.queries import ORACLES, QUERIES

from .oracle import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    same_rows(spark, SF, QUERIES[name], ORACLES[name])


def test_ward_clusters_are_nearest_to_the_centres_of_all_vectors(spark):
    """At this size the pool of templates is the whole table."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    centers = models.ward(x, 6)[1]
    got = {r["vec_id"]: r["cluster"] for r in QUERIES["ward_clusters"](spark, SF).collect()}
    own = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    assert len(got) == len(rows) and len(set(got.values())) == 6
    # The numbers of clusters depend on the order of the pool.
    assert len({(got[r["vec_id"]], int(c)) for r, c in zip(rows, own)}) == 6


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


# ---- queries without SQL against brute force


def frames_of(spark):
    out = {}
    for r in queries.tracks(spark, SF).collect():
        out.setdefault((r["group"], r["sequence"], r["frame"]), []).append(r)
    return out


def brute_hull(points):
    """Area inside the edges that have all points on one side."""
    p = sorted(set(points))
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = [(a, b) for a, b in itertools.permutations(p, 2) if all(side(a, b, c) >= 0 for c in p)]
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in edges) / 2


def test_group_area(spark):
    got = {(r["group"], r["sequence"], r["frame"]): r for r in QUERIES["group_area"](spark, SF).collect()}
    for k, rows in frames_of(spark).items():
        assert got[k]["n_ids"] == len(rows)
        if len(rows) >= 3:
            assert got[k]["area"] == pytest.approx(brute_hull([(r["X"], r["Y"]) for r in rows]), abs=1e-3)
        else:
            assert got[k]["area"] is None


def brute_alpha(points, alpha):
    """Area and number of the triangles with an empty circumcircle that is smaller than alpha."""
    area, n = 0.0, 0
    for a, b, c in itertools.combinations(sorted(set(points)), 3):
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        if abs(d) < 1e-9:
            continue
        sq = [p[0] ** 2 + p[1] ** 2 for p in (a, b, c)]
        x = (sq[0] * (b[1] - c[1]) + sq[1] * (c[1] - a[1]) + sq[2] * (a[1] - b[1])) / d
        y = (sq[0] * (c[0] - b[0]) + sq[1] * (a[0] - c[0]) + sq[2] * (b[0] - a[0])) / d
        r = math.hypot(a[0] - x, a[1] - y)
        if r < alpha and all(math.hypot(p[0] - x, p[1] - y) > r - 1e-9 for p in points if p not in (a, b, c)):
            area, n = area + abs(d) / 4, n + 1
    return area, n


def test_alpha_areas(spark):
    got = {(r["group"], r["sequence"], r["frame"]): r for r in QUERIES["alpha_areas"](spark, SF).collect()}
    for k, rows in frames_of(spark).items():
        area, n = brute_alpha([(r["X"], r["Y"]) for r in rows], 40.0)
        assert got[k]["n_triangles"] == n and (got[k]["area"] or 0) == pytest.approx(area, abs=1e-3)


def test_template_rows(spark):
    t = queries.tracks(spark, SF)
    counts = {(r["group"], r["sequence"]): r["count"] for r in t.groupBy("group", "sequence").count().collect()}
    rows = QUERIES["template_rows"](spark, SF).collect()
    total = sum(counts.values())
    per = {}
    for r in rows:
        per.setdefault((r["group"], r["sequence"]), set()).add((r["id"], r["frame"]))
    assert sum(map(len, per.values())) == len(rows) <= 300
    assert all(abs(len(v) - counts[k] * min(1, 300 / total)) <= 1 + counts[k] / total * len(counts) for k, v in per.items())


def test_kmeans_clusters_are_nearest_to_their_means(spark):
    found = {r["vec_id"]: r["cluster"] for r in QUERIES["kmeans_clusters"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, own = np.array([r["embedding"] for r in rows], float), np.array([found[r["vec_id"]] for r in rows])
    names = np.unique(own)
    means = np.stack([x[own == c].mean(0) for c in names])
    nearest = names[((x[:, None] - means[None]) ** 2).sum(2).argmin(1)]
    assert (nearest == own).mean() > 0.95


def test_pose_distance_pca(spark):
    rows, n = [], queries.POINTS
    for k, own in frames_of(spark).items():
        for a, b in itertools.permutations(own, 2):
            p = np.array([(r[f"poseX{i}"], r[f"poseY{i}"]) for r in (a, b) for i in range(n)])
            d = [np.hypot(*(p[i] - p[j])) for i in range(2 * n) for j in range(i + 1, 2 * n)]
            rows.append(((*k, min(a["id"], b["id"]), max(a["id"], b["id"]), int(a["id"] > b["id"])), d))
    x = np.array([d for _, d in rows])
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = {(r["group"], r["sequence"], r["frame"], r["id1"], r["id2"], r["perspective"]): [r[f"PC{i}"] for i in range(6)] for r in QUERIES["pose_distance_pca"](spark, SF).collect()}
    assert got.keys() == {k for k, _ in rows}
    ours = np.array([got[k] for k, _ in rows], float)
    # A component's sign is free, and so is where its zero lies.
    spread = (x - x.mean(0)) @ axes[:6].T
    assert np.allclose(np.sort((ours - ours.mean(0)).std(0))[::-1], spread.std(0), rtol=0.02)
    for i in range(2):
        assert abs(np.corrcoef(ours[:, i], spread[:, i])[0, 1]) > 0.999
