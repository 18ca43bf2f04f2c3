"""The map of templates and the places of other rows on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.ml import models, tsne
from trackloom.queries import QUERIES


def clusters(n, k, d, seed=0):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, k, n)
    return rng.normal(scale=6, size=(k, d))[own] + rng.normal(size=(n, d)), own


def kept(high, low, at, k=15):
    """Share of the k nearest on the map that are among the 5k nearest of the data."""
    out = []
    for i in at:
        order = [np.argsort(((v - v[i]) ** 2).sum(1))[1:] for v in (high, low)]
        out.append(len(set(order[0][: 5 * k]) & set(order[1][:k])) / k)
    return float(np.mean(out))


def test_repulsion_on_the_grid_is_that_of_all_pairs():
    y = np.random.default_rng(3).normal(scale=8, size=(400, 2))
    grid = tsne.Grid.around(y)
    got = grid.at(grid.field(y), y)
    q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
    want = np.stack([q.sum(1), (q * q).sum(1), (q * q) @ y[:, 0], (q * q) @ y[:, 1]], 1)
    assert got[:, 0].sum() == pytest.approx(want[:, 0].sum(), rel=0.01) and np.median(np.abs(got[:, 0] / want[:, 0] - 1)) < 0.02
    force = lambda s: y * s[:, 1:2] - s[:, 2:]
    assert np.abs(force(got) - force(want)).max() < 0.05 * np.abs(force(want)).max()


def test_affinities_have_the_perplexity():
    d = np.sort(np.random.default_rng(0).uniform(0, 9, (50, 60)), 1)
    p = tsne.affinities(d, 12.0)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-(p * np.log(p)).sum(1)), 12, rtol=1e-4)


def test_neighbour_graph_is_symmetric_and_nearest(spark):
    x, _ = clusters(300, 3, 4)
    starts, j, p = tsne.neighbour_graph(spark, x, 5.0)
    i = np.repeat(np.arange(300), np.diff(np.append(starts, len(j))))
    full = np.zeros((300, 300))
    full[i, j] = p
    assert np.allclose(full, full.T) and full.sum() == pytest.approx(1) and not full.diagonal().any()
    nearest = np.argsort(((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(300, np.inf)), 1)[:, :15]
    assert all(full[a, b] > 0 for a in range(300) for b in nearest[a, :5])


def test_map_of_20000_templates_keeps_neighbours(spark):
    x, own = clusters(20_000, 12, 8)
    y = tsne.tsne(x, 10.0, 200)
    assert y.shape == (20_000, 2) and np.isfinite(y).all()
    at = np.arange(0, 20_000, 400)
    near = [np.argsort(((y - y[i]) ** 2).sum(1))[1:16] for i in at]
    assert np.mean([(own[n] == own[i]).mean() for i, n in zip(at, near)]) > 0.95
    assert kept(x, y, at, 30) > 0.25


def test_new_rows_land_among_their_own(spark):
    x, own = clusters(900, 5, 6)
    y = models.tsne(x[:600], 15.0, 300)
    df = spark.createDataFrame([(i, int(own[i]), *map(float, x[i])) for i in range(600, 900)] + [(-1, 0, None, *[0.0] * 5)], "i long, own int, " + ", ".join(f"f{c} double" for c in range(6)))
    rows = models.tsne_map(df, [f"f{c}" for c in range(6)], x[:600], y).collect()
    assert len(rows) == 300
    hit = [own[:600][np.argsort(((y - [r["tsne_x"], r["tsne_y"]]) ** 2).sum(1))[:5]] == r["own"] for r in rows]
    assert np.mean(hit) > 0.95
    # A row moved: places are not just the mean of its neighbours' places.
    still = models.tsne_map(df, [f"f{c}" for c in range(6)], x[:600], y, rounds=0).collect()
    assert any(abs(a["tsne_x"] - b["tsne_x"]) > 1e-3 for a, b in zip(rows, still))


def test_few_templates_and_equal_ones(spark):
    assert tsne.tsne(np.ones((2, 3))).tolist() == [[0, 0], [0, 0]]
    assert np.isfinite(tsne.tsne(np.ones((10, 3)), 3.0, 50)).all()


def test_query_keeps_neighbours_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    places = {r["vec_id"]: (r["tsne_x"], r["tsne_y"]) for r in QUERIES["tsne_places"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").where(F.col("embedding").isNotNull()).collect()
    assert len(places) == len(rows)
    high, low = np.array([r["embedding"] for r in rows]), np.array([places[r["vec_id"]] for r in rows])
    assert kept(high, low, range(0, len(rows), 10)) > 2 * 5 * 15 / len(rows)
