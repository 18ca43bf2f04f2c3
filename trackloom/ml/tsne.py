"""t-SNE of a bounded pool of templates by a sparse neighbour graph, and places for any number of rows on its map.

Affinities come from each template's nearest templates only, found in tasks; the repulsion between all of them is
interpolated from a grid, on which it is a convolution. So a round costs the edges of the graph and the grid, not the
square of the pool. Rows outside the pool move on the finished map, which stays as it is: drawn by their nearest templates,
driven off by the grid's field, in tasks and independently of one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nearest templates for each unit of perplexity; rows whose distances a task holds at once.
NEIGHBOURS, ROWS = 3, 256
#: Boxes of the grid on either axis, no more than this many; interpolation nodes of a box.
BOXES, NODES = 100, 3
#: Values of the pool that are broadcast at most, 256 MB.
MOST_VALUES = 1 << 25


def _nearest(x: np.ndarray, pool: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k nearest of the pool, nearest first, and their squared distances; `skip` is each row's own place."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ pool.T + (pool * pool).sum(1)[None], 0)
    if skip is not None:
        d[np.arange(len(x)), skip] = np.inf
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    far = np.take_along_axis(d, near, 1)
    order = np.lexsort((near, far), axis=1)
    return np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)


def affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Weights of neighbours at squared distances d, rows that sum to 1 with the entropy of that perplexity."""
    goal = np.log(min(perplexity, d.shape[1]))
    d = d - d.min(1, keepdims=True)
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    beta = 1 / np.maximum(d.mean(1), 1e-12)
    for _ in range(60):
        w = np.exp(-d * beta[:, None])
        s = w.sum(1)
        entropy = np.log(s) + beta * (d * w).sum(1) / s
        low, high = np.where(entropy > goal, beta, low), np.where(entropy > goal, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    w = np.exp(-d * beta[:, None])
    return w / w.sum(1, keepdims=True)


def neighbour_graph(spark: SparkSession, points: np.ndarray, perplexity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symmetric affinities as (starts of rows, columns, weights), which sum to 1. Tasks hold the pool and ROWS rows."""
    n = len(points)
    if points.size > MOST_VALUES:
        raise ValueError(f"a pool of {points.size} values is no bounded pool; draw fewer templates")
    k = min(n - 1, max(1, int(NEIGHBOURS * perplexity)))
    pool = spark.sparkContext.broadcast(points)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in part["id"]:
                rows = np.arange(at * ROWS, min(n, (at + 1) * ROWS))
                near, d = _nearest(pool.value[rows], pool.value, k, rows)
                yield pd.DataFrame({"i": rows, "j": list(near), "p": list(affinities(d, perplexity))})

    blocks = spark.range(-(-n // ROWS)).repartition(spark.sparkContext.defaultParallelism)
    found = blocks.mapInPandas(run, "i long, j array<long>, p array<double>").toPandas().sort_values("i")
    pool.unpersist()
    i, j, p = np.repeat(np.arange(n), k), np.concatenate(found["j"].to_list()), np.concatenate(found["p"].to_list())
    # Both directions of an edge add up in one place each.
    at, inverse = np.unique(np.concatenate([i * n + j, j * n + i]), return_inverse=True)
    weight = np.bincount(inverse, np.concatenate([p, p])) / (2 * n)
    return np.searchsorted(at // n, np.arange(n)), at % n, weight


@dataclass
class Grid:
    """Nodes around the places y on which sums over all places are kept."""

    low: np.ndarray
    width: float
    boxes: int

    @classmethod
    def around(cls, y: np.ndarray, margin: float = 0.0) -> Grid:
        low, high = y.min(0), y.max(0)
        side = max(float((high - low).max()), 1e-6) * (1 + 2 * margin)
        boxes = int(np.clip(np.ceil(2 * side), 20, BOXES))
        return cls((low + high) / 2 - side / 2, side / boxes * (1 + 1e-9), boxes)

    def weights(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat positions of the NODES x NODES nodes around each place, and their Lagrange weights."""
        at = np.clip((y - self.low) / self.width, 0, self.boxes - 1e-9)
        box = at.astype(int)
        nodes = (np.arange(NODES) + 0.5) / NODES
        inside = at - box
        each = np.ones((len(y), 2, NODES))
        for a in range(NODES):
            for b in range(NODES):
                if a != b:
                    each[:, :, a] *= (inside - nodes[b]) / (nodes[a] - nodes[b])
        n = self.boxes * NODES
        x0, y0 = (box * NODES).T
        cells = ((x0[:, None] + np.arange(NODES))[:, :, None] * n + (y0[:, None] + np.arange(NODES))[:, None, :]).reshape(len(y), -1)
        return cells, (each[:, 0, :, None] * each[:, 1, None, :]).reshape(len(y), -1)

    def field(self, y: np.ndarray) -> np.ndarray:
        """On every node, the sums over all places of q and of q*q times 1, x and y, where q = 1 / (1 + distance squared)."""
        n = self.boxes * NODES
        cells, w = self.weights(y)
        charges = [np.bincount(cells.ravel(), (w * c[:, None]).ravel(), n * n).reshape(n, n) for c in (np.ones(len(y)), y[:, 0], y[:, 1])]
        step = np.arange(2 * n)
        step = np.minimum(step, 2 * n - step) * (self.width / NODES)
        q = 1 / (1 + step[:, None] ** 2 + step[None] ** 2)
        spectra = [np.fft.rfft2(c, (2 * n, 2 * n)) for c in charges]
        q1, q2 = np.fft.rfft2(q), np.fft.rfft2(q * q)
        both = [spectra[0] * q1, *[s * q2 for s in spectra]]
        return np.stack([np.fft.irfft2(s, (2 * n, 2 * n))[:n, :n].ravel() for s in both], 1)

    def at(self, field: np.ndarray, y: np.ndarray) -> np.ndarray:
        cells, w = self.weights(y)
        return np.einsum("nk,nkc->nc", w, field[cells])


def _start(points: np.ndarray, seed: int) -> np.ndarray:
    x = points - points.mean(0)
    _, axes = np.linalg.eigh(x.T @ x)
    y = x @ axes[:, ::-1][:, :2] if x.shape[1] > 1 else np.hstack([x, np.zeros((len(x), 1))])
    return y / max(y[:, 0].std(), 1e-12) * 1e-4 + np.random.default_rng(seed).normal(scale=1e-6, size=y.shape)


def tsne(points: np.ndarray, perplexity: float = 30.0, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """Places in two dimensions of a pool of templates; fewer than three stay at the origin."""
    n = len(points)
    if n < 3:
        return np.zeros((n, 2))
    starts, j, p = neighbour_graph(SparkSession.active(), np.asarray(points, float), min(perplexity, max(1.0, (n - 1) / NEIGHBOURS)))
    i = np.repeat(np.arange(n), np.diff(np.append(starts, len(j))))
    y, early = _start(np.asarray(points, float), seed), rounds // 4
    move, gain, rate = np.zeros_like(y), np.ones_like(y), max(50.0, n / 12)
    for t in range(rounds):
        grid = Grid.around(y)
        near = grid.at(grid.field(y), y)
        repel = (y * near[:, 1:2] - near[:, 2:]) / max(near[:, 0].sum() - n, 1e-12)
        apart = y[i] - y[j]
        pull = ((12.0 if t < early else 1.0) * p / (1 + (apart * apart).sum(1)))[:, None] * apart
        grad = 4 * (np.add.reduceat(pull, starts, axis=0) - repel)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if t < early else 0.8) * move - rate * gain * grad
        y = y + move
    return y - y.mean(0)


def tsne_map(df: DataFrame, columns: list[str], templates: np.ndarray, embedded: np.ndarray, k: int = 10, rounds: int = 100, rate: float = 0.5, furthest: float = 0.25) -> DataFrame:
    """Adds tsne_x and tsne_y to the rows of finite columns: a row starts at the mean of its k nearest templates' places,
    weighted by affinity, and then moves for `rounds` steps of at most `furthest` among all templates, which stay. The
    templates are a bounded pool, so they go to every task, as does the field of their repulsion."""
    k = min(k, len(templates))
    grid = Grid.around(embedded, 0.2)
    field = grid.field(embedded)
    pool = df.sparkSession.sparkContext.broadcast((np.asarray(templates, float), embedded, grid, field))

    def places(x: np.ndarray) -> np.ndarray:
        own, fixed, grid, field = pool.value
        near, d = _nearest(x, own, k)
        p = affinities(d, max(1.0, k / NEIGHBOURS))
        y, move = (fixed[near] * p[:, :, None]).sum(1), np.zeros((len(x), 2))
        for _ in range(rounds):
            sums = grid.at(field, y)
            apart = y[:, None] - fixed[near]
            pull = ((p / (1 + (apart * apart).sum(2)))[:, :, None] * apart).sum(1)
            move = 0.8 * move - rate * (pull - (y * sums[:, 1:2] - sums[:, 2:]) / np.maximum(sums[:, :1], 1e-12))
            size = np.hypot(*move.T)[:, None]
            move = np.where(size > furthest, move * furthest / np.maximum(size, 1e-12), move)
            y = y + move
        return y

    @F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    def place(rows: pd.Series) -> pd.DataFrame:
        x = np.stack(rows.to_list()) if len(rows) else np.zeros((0, len(columns)))
        out = [places(x[a : a + ROWS]) for a in range(0, len(x), ROWS)]
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2)), columns=["x", "y"])

    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    out = df.withColumn("_at", place(F.array(*[F.col(c).cast("double") for c in columns])))
    return out.withColumns({"tsne_x": F.col("_at.x"), "tsne_y": F.col("_at.y")}).drop("_at")
