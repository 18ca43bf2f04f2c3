"""Representative rows of each sequence: evenly spaced, by k-means of the pose, or clips around such rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ANGLE, ENTRY, FRAME, ID, X, Y, order_column, pose_pairs
from ..functions.numbers import forward, leftward
from .summaries import uniform_rows


def canonical_pose(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds every keypoint relative to X, Y and turned by -ANGLE, and returns the names of those columns."""
    out = {}
    for x, y in pose_pairs(df.columns):
        dx, dy = F.col(x) - F.col(X), F.col(y) - F.col(Y)
        out |= {f"_c{x}": forward(dx, dy, F.col(ANGLE)), f"_c{y}": leftward(dx, dy, F.col(ANGLE))}
    return df.withColumns(out), list(out)


def centre_rows(points: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """Rows nearest to the centres of k clusters, one a cluster that isn't empty, sorted; Lloyd's rounds from centres
    drawn in proportion to their squared distance."""
    if k >= len(points):
        return np.arange(len(points))
    rng = np.random.default_rng(seed)
    centres = points[[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        share = near / near.sum() if near.sum() > 0 else None
        centres = np.vstack([centres, points[rng.choice(len(points), p=share)]])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
    norms = (points * points).sum(1)
    for _ in range(rounds):
        far = norms[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)
        own = far.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    far = ((points[:, None] - centres[None]) ** 2).sum(2) if len(points) * k < 1 << 20 else far
    own = far.argmin(1)
    return np.unique([np.flatnonzero(own == c)[far[own == c, c].argmin()] for c in np.unique(own)])


def spans(seeds: np.ndarray, rows: int, length: int) -> list[int]:
    """Starts of disjoint runs of `length` rows at the seeds; one that overlaps the run before begins at its end."""
    out: list[int] = []
    for s in sorted(min(int(s), rows - length) for s in seeds):
        s = max(s, out[-1] + length if out else 0)
        if s + length <= rows:
            out.append(s)
    return out


def subsample(df: DataFrame, target: int = 300, method: str = "kmeans", clip: int = 8, seed: int = 42, drop_missing: bool = True) -> DataFrame:
    """About `target` rows of each sequence, all columns as they are.

    `uniform` takes every k-th row; `kmeans` the rows nearest to the centres of `target` clusters of canonical poses;
    `clips` runs of `clip` rows that begin at the centres of target / clip clusters. Rows with a missing position, angle
    or keypoint are no centres, and with `drop_missing` don't come back. Sequences of `target` rows or less come back
    whole. A task holds one sequence.
    """
    if method not in ("uniform", "kmeans", "clips"):
        raise ValueError(f"no method {method!r}")
    names = df.columns
    needed = [c for c in (X, Y, ANGLE, *[c for p in pose_pairs(names) for c in p]) if c in names]
    if drop_missing:
        for c in needed:
            df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    if method == "uniform":
        return uniform_rows(df, target)
    if not {X, Y, ANGLE} <= set(names) or not pose_pairs(names):
        raise ValueError("k-means and clips need X, Y, ANGLE and keypoints")
    posed, features = canonical_pose(df)
    order = [order_column(names), *([ID] if ID in names else [])]

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, kind="stable")
        enough = target if method == "kmeans" else clip - 1
        if len(own) <= enough:
            return own[names]
        x = own[features].to_numpy(float)
        known = np.flatnonzero(np.isfinite(x).all(1))
        k = target if method == "kmeans" else max(1, min(target // clip, len(own) // clip))
        rows = known[centre_rows(x[known], k, seed)] if len(known) else np.arange(0, len(own), max(1, len(own) // k))[:k]
        if method == "clips":
            rows = np.concatenate([np.arange(s, s + clip) for s in spans(rows, len(own), clip)])
        return own.iloc[rows][names]

    entry = [c for c in ENTRY if c in names]
    return posed.groupBy(*entry).applyInPandas(pick, df.schema)


def uniform_frames(df: DataFrame, n: int) -> DataFrame:
    """(group, sequence, frame): n frames of each sequence at even distances from its first to its last one."""
    entry = [c for c in ENTRY if c in df.columns]
    frames = df.groupBy(*entry).agg(F.array_sort(F.collect_set(FRAME)).alias("_f"))
    size = F.size("_f")
    place = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at("_f", (F.rint(i * (size - 1) / F.lit(max(1, n - 1))) + 1).cast("int")))
    return frames.select(*entry, F.explode(F.when(size <= n, F.col("_f")).otherwise(F.array_distinct(place))).alias(FRAME))


def kmeans_frames(df: DataFrame, features: list[str], n: int, seed: int = 42) -> DataFrame:
    """(group, sequence, frame): of each sequence the n frames nearest to the centres of n clusters of its feature rows;
    where clusters share a frame, those farthest from all chosen fill up. A task holds one sequence."""
    entry = [c for c in ENTRY if c in df.columns]
    rows = df.select(*entry, FRAME, *[F.col(c).cast("double").alias(c) for c in features])

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        own = own.dropna().drop_duplicates(FRAME).sort_values(FRAME)
        x = own[features].to_numpy(float)
        chosen = list(centre_rows(x, n, seed))
        while len(chosen) < min(n, len(own)):
            chosen.append(int(((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1).argmax()))
        return own.iloc[sorted(chosen)][[*entry, FRAME]]

    return rows.groupBy(*entry).applyInPandas(pick, rows.select(*entry, FRAME).schema)
