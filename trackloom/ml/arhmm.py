"""Autoregressive hidden Markov model over tracks: states that each predict a row from the one before it.

Tracks are dealt to blocks of BLOCK rows. What a block does to the distribution over states is a product of matrices, one
a row; such products are associative, so each block gives one small scaled matrix, the matrices of a track are scanned for
what enters each block from either side, and the blocks finish on their own. The most likely path is found the same way
with maxima of sums in place of sums of products. A task holds a block, or one matrix for each block of a track.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ENTRY, FRAME, ID

BLOCK = 4_096
TRACK = (*ENTRY, ID)


def _blocks(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """(keys, block, last, frames, x): blocks of rows in order. A block holds `size` steps, so it shares its first row with the
    last of the block before; rows with a value that is missing or not finite are left out."""
    keys = [c for c in TRACK if c in df.columns]
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    w = Window.partitionBy(*keys)
    p, n = F.col("_p"), F.col("_n")
    rows = df.select(*keys, FRAME, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    rows = rows.withColumns({"_p": F.row_number().over(w.orderBy(FRAME)) - 1, "_n": F.count(F.lit(1)).over(w)})
    at = F.array_distinct(F.array(F.floor(F.greatest(p - 1, F.lit(0)) / size), F.floor(F.least(p, F.greatest(n - 2, F.lit(0))) / size)))
    dealt = rows.withColumn("block", F.explode(at)).withColumn("last", F.floor(F.greatest(n - 2, F.lit(0)) / size))
    packed = dealt.groupBy(*keys, "block", "last").agg(F.array_sort(F.collect_list(F.struct("_p", FRAME, "x"))).alias("r"))
    return packed.select(*keys, "block", "last", F.col(f"r.{FRAME}").alias("frames"), F.flatten("r.x").alias("x"))


def _log_emissions(x: np.ndarray, model: dict) -> np.ndarray:
    """Log density of each row after the first, given the one before it, by state."""
    inputs, y = np.hstack([x[:-1], np.ones((len(x) - 1, 1))]), x[1:]
    out = np.empty((len(y), len(model["weights"])))
    for k, (w, c) in enumerate(zip(model["weights"], model["cov"])):
        chol = np.linalg.cholesky(c)
        z = np.linalg.solve(chol, (y - inputs @ w).T)
        out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(chol)).sum() - 0.5 * y.shape[1] * math.log(2 * math.pi)
    return out


def _points(flat: np.ndarray, model: dict) -> np.ndarray:
    return (np.asarray(flat, float).reshape(-1, len(model["mean"])) - model["mean"]) / model["scale"] @ model["axes"]


def transfer(e: np.ndarray, a: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    """The product of a @ diag(e) over rows, up to a factor; `first` is the model's start where the block begins a track."""
    m = np.diag(e[0]) if first is not None else a * e[0]
    if first is not None:
        m = first[:, None] * m  # a diagonal: each state starts by its own share
    for row in e[1:]:
        m = (m @ a) * row
        m /= max(m.max(), 1e-300)
    return m / max(m.max(), 1e-300)


def best_transfer(e: np.ndarray, a: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    """The best log score from each state before the block to each at its end."""
    k = len(a)
    m = np.where(np.eye(k, dtype=bool), (first + e[0])[:, None], -np.inf) if first is not None else a + e[0]
    for row in e[1:]:
        m = (m[:, :, None] + a[None]).max(1) + row
    return m


def statistics(x: np.ndarray, model: dict, enters: np.ndarray | None, leaves: np.ndarray) -> dict:
    """Sufficient statistics of one block: `enters` is the distribution over states at its first row, None at the start of a
    track; `leaves` is how well each state at its end explains what follows."""
    log_e = _log_emissions(x, model)
    top = log_e.max(1, keepdims=True)
    e, a, start = np.exp(log_e - top), model["transition"], model["start"]
    n, k = e.shape
    f, c, b = np.empty((n, k)), np.empty(n), np.empty((n, k))
    before = enters
    for t in range(n):
        f[t] = (start if before is None else before @ a) * e[t]
        c[t] = max(f[t].sum(), 1e-300)
        f[t] /= c[t]
        before = f[t]
    b[-1] = leaves
    for t in range(n - 2, -1, -1):
        b[t] = a @ (e[t + 1] * b[t + 1])
        b[t] /= max(b[t].max(), 1e-300)
    g = f * b
    g /= np.maximum(g.sum(1, keepdims=True), 1e-300)
    into, out = (f[:-1], e[1:] * b[1:]) if enters is None else (np.vstack([enters, f[:-1]]), e * b)
    each = np.maximum(np.einsum("ti,ij,tj->t", into, a, out), 1e-300)
    xi = np.einsum("ti,tj->ij", into / each[:, None], out) * a
    inputs, y = np.hstack([x[:-1], np.ones((n, 1))]), x[1:]
    return {"start": g[0] if enters is None else np.zeros(k), "xi": xi, "mass": g.sum(0), "xx": np.einsum("tk,ti,tj->kij", g, inputs, inputs), "xy": np.einsum("tk,ti,tj->kij", g, inputs, y), "yy": np.einsum("tk,ti,tj->kij", g, y, y), "ll": float((np.log(c) + top[:, 0]).sum())}


def path_between(e: np.ndarray, a: np.ndarray, score: np.ndarray, end: int) -> np.ndarray:
    """The best states of a block whose last one is `end`; `score` is that of its first row's states."""
    best, back = score, []
    for row in e[1:]:
        to = best[:, None] + a
        back.append(to.argmax(0))
        best = to.max(0) + row
    path = [end]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return np.array(path[::-1], np.int32)


def _scanned(blocks: DataFrame, keys: list[str], matrix: Callable, scan: Callable) -> DataFrame:
    """The blocks with `left` and `right`, what scan(matrices of a track) says enters each from either side."""
    key = T.StructType([blocks.schema[c] for c in keys])
    shape = T.StructType([*key, blocks.schema["block"], T.StructField("m", T.ArrayType(T.DoubleType()))])
    sides = T.StructType([*key, blocks.schema["block"], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("left", "right")]])

    def matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[[*keys, "block"]].assign(m=[matrix(x, b).ravel() for x, b in zip(part["x"], part["block"])])

    def both(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block").reset_index(drop=True)
        k = math.isqrt(len(own["m"][0])) if len(own) else 0
        left, right = scan([np.asarray(m).reshape(k, k) for m in own["m"]])
        return own[[*keys, "block"]].assign(left=left, right=right)

    found = blocks.select(*keys, "block", "x").mapInPandas(matrices, shape).groupBy(*keys).applyInPandas(both, sides)
    same = [blocks[c].eqNullSafe(found[c]) for c in keys] + [blocks["block"] == found["block"]]
    return blocks.join(found, same).select(*[blocks[c] for c in blocks.columns], "left", "right")


def _sums(left: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = left @ m
    return out / max(out.sum(), 1e-300)


def _around(matrices: list[np.ndarray]) -> tuple[list, list]:
    """The distribution that enters each block, nothing for the first, and what each block's end is worth to those after it."""
    k = len(matrices[0])
    left, right = [np.array([])], [np.ones(k)]
    for i, m in enumerate(matrices[:-1]):
        left.append(_sums(np.ones(k) if i == 0 else left[-1], m))
    for m in reversed(matrices[1:]):
        r = m @ right[-1]
        right.append(r / max(r.max(), 1e-300))
    return left, right[::-1]


def _along(matrices: list[np.ndarray]) -> tuple[list, list]:
    """Best scores that enter each block, nothing for the first, and the state that each ends in on the best path."""
    left = [np.array([])]
    for i, m in enumerate(matrices):
        left.append((m if i == 0 else left[-1][:, None] + m).max(0))
    ends = [int(left[-1].argmax())]
    for i in range(len(matrices) - 1, 0, -1):
        ends.append(int((left[i] + matrices[i][:, ends[-1]]).argmax()))
    return left[:-1], [np.array([float(e)]) for e in reversed(ends)]


def arhmm_fit(df: DataFrame, columns: list[str], states: int, rounds: int = 20, sticky: float = 10.0, seed: int = 0, tolerance: float = 1e-4, components: int | None = None, size: int = BLOCK) -> dict:
    """EM over all tracks; each round's statistics are summed on the executors, and the M step is a few small regressions
    on the driver. With `components`, rows are first projected to that many principal components of the standardised
    columns, scaled to unit variance; tracks of fewer than three rows say nothing."""
    keys = [c for c in TRACK if c in df.columns]
    rng = np.random.default_rng(seed)
    r = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model = {"mean": np.array([r[f"m_{c}"] for c in columns], float), "scale": np.array([r[f"s_{c}"] or 1.0 for c in columns]), "axes": np.eye(len(columns))}
    if components is not None and components < len(columns):
        model["axes"] = _axes(df, columns, model, components)
    d = model["axes"].shape[1]
    model |= {"weights": np.vstack([np.eye(d), np.zeros((1, d))])[None].repeat(states, 0) + rng.normal(scale=0.1, size=(states, d + 1, d)), "cov": np.eye(d)[None].repeat(states, 0), "start": np.full(states, 1 / states)}
    model["transition"] = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    shapes = {"start": (states,), "xi": (states, states), "mass": (states,), "xx": (states, d + 1, d + 1), "xy": (states, d + 1, d), "yy": (states, d, d), "ll": ()}
    blocks = _blocks(df, columns, size).where((F.col("last") > 0) | (F.size("frames") > 2)).persist()
    last, s = -math.inf, None
    for _ in range(rounds):
        current = {k: v.copy() for k, v in model.items()}

        def matrix(x, block, current=current) -> np.ndarray:
            log_e = _log_emissions(_points(x, current), current)
            return transfer(np.exp(log_e - log_e.max(1, keepdims=True)), current["transition"], current["start"] if block == 0 else None)

        def step(parts: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            for part in parts:
                total = 0.0
                for x, left, right in zip(part["x"], part["left"], part["right"]):
                    own = statistics(_points(x, current), current, np.asarray(left) if len(left) else None, np.asarray(right))
                    total = total + np.concatenate([np.ravel(own[k]) for k in shapes])
                if len(part):
                    yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        sides = _scanned(blocks, keys, matrix, _around)
        table = sides.select("x", "left", "right").mapInPandas(step, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
        if not len(table):
            break
        flat, at, s = table["v"].to_numpy(), 0, {}
        for k, shape in shapes.items():
            n = int(np.prod(shape))
            s[k] = flat[at : at + n].reshape(shape)
            at += n
        for k in range(states):
            xx = s["xx"][k] + 1e-6 * np.eye(d + 1)
            w = np.linalg.solve(xx, s["xy"][k])
            c = (s["yy"][k] - w.T @ s["xy"][k] - s["xy"][k].T @ w + w.T @ s["xx"][k] @ w) / max(s["mass"][k], 1e-9)
            model["weights"][k], model["cov"][k] = w, (c + c.T) / 2 + 1e-4 * np.eye(d)
        a = s["xi"] + 1e-10 + sticky * np.eye(states)
        model["transition"], model["start"] = a / a.sum(1, keepdims=True), (s["start"] + 1e-10) / (s["start"] + 1e-10).sum()
        if abs(float(s["ll"]) - last) <= tolerance * max(1.0, abs(last)):
            break
        last = float(s["ll"])
    blocks.unpersist()
    keep = np.flatnonzero(s["mass"] > 1e-3 * s["mass"].sum()) if s else np.arange(states)
    model["weights"], model["cov"], model["start"] = model["weights"][keep], model["cov"][keep], model["start"][keep] / model["start"][keep].sum()
    a = model["transition"][np.ix_(keep, keep)]
    model["transition"], model["log_likelihood"] = a / a.sum(1, keepdims=True), last
    return model


def _axes(df: DataFrame, columns: list[str], model: dict, components: int) -> np.ndarray:
    """Directions of the greatest spread of the standardised columns, each divided by its spread."""
    d = len(columns)

    def outer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = (part.to_numpy(float) - model["mean"]) / model["scale"]
            x = x[np.isfinite(x).all(1)]
            yield pd.DataFrame({"i": np.arange(d * d + 1), "v": np.append((x.T @ x).ravel(), len(x))})

    found = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(outer, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    if not len(found) or found[-1] == 0:
        return np.eye(d)[:, :components]
    spread, axes = np.linalg.eigh(found[:-1].reshape(d, d) / found[-1])
    order = np.argsort(spread)[::-1][:components]
    return axes[:, order] / np.sqrt(np.maximum(spread[order], 1e-12))


def arhmm_decode(df: DataFrame, columns: list[str], model: dict, size: int = BLOCK) -> DataFrame:
    """The most likely state (`syllable`) of each row; the first row of a track takes the first decoded state, and that of
    a track of one row is 0."""
    keys = [c for c in TRACK if c in df.columns]
    blocks = _blocks(df, columns, size)
    a, start = np.log(model["transition"]), np.log(model["start"])
    matrix = lambda x, block: best_transfer(_log_emissions(_points(x, model), model), a, start if block == 0 else None)
    long, single = blocks.where(F.size("frames") > 1), blocks.where(F.size("frames") == 1)
    out = T.StructType([*[df.schema[c] for c in (*keys, FRAME)], T.StructField("syllable", T.IntegerType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, r in part.iterrows():
                e = _log_emissions(_points(r["x"], model), model)
                score = (start if not len(r["left"]) else (np.asarray(r["left"])[:, None] + a).max(0)) + e[0]
                path = path_between(e, a, score, int(r["right"][0]))
                frames = np.asarray(r["frames"])
                # A block's first row belongs to the block before it, if there is one.
                path, frames = (np.append(path[0], path), frames) if not len(r["left"]) else (path, frames[1:])
                yield pd.DataFrame({c: [r[c]] * len(frames) for c in keys} | {FRAME: frames, "syllable": path})

    found = _scanned(long, keys, matrix, _along).select(*keys, "frames", "x", "left", "right").mapInPandas(run, out)
    return found.union(single.select(*keys, F.get("frames", F.lit(0)), F.lit(0)))
