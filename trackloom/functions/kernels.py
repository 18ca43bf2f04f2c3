"""NumPy kernels for what column expressions can't say, run by Spark over Arrow batches or groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ENTRY, ID, order_column
from ..windows import rows_of


def _hull(points: np.ndarray) -> float | None:
    """Area of the convex hull by the monotone chain; None for fewer than three points or points on a line."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return None
    chain: list = []
    for part in (p, p[::-1]):
        own: list = []
        for q in part:
            while len(own) > 1 and (own[-1][0] - own[-2][0]) * (q[1] - own[-2][1]) <= (own[-1][1] - own[-2][1]) * (q[0] - own[-2][0]):
                own.pop()
            own.append(q)
        chain += own[:-1]
    c = np.array(chain)
    area = 0.5 * abs(np.dot(c[:, 0], np.roll(c[:, 1], -1)) - np.dot(c[:, 1], np.roll(c[:, 0], -1)))
    return float(area) if area > 0 else None


@F.pandas_udf(T.DoubleType())
def hull_area(points: pd.Series) -> pd.Series:
    return pd.Series([_hull(np.array([[p["x"], p["y"]] for p in own], float).reshape(-1, 2)) for own in points])


@F.pandas_udf(T.DoubleType())
def arctangent(y: pd.Series, x: pd.Series) -> pd.Series:
    """The direction of (x, y) by the C library. Java's arctangent differs from it in the last bit now and then, which decides
    whether a turn is half a circle."""
    return pd.Series(np.frompyfunc(math.atan2, 2, 1)(y.to_numpy(float), x.to_numpy(float)).astype(float))


def _components(ids: list[int], links: list[dict]) -> list[list[int]]:
    """Sorted members of each component."""
    root = {int(i): int(i) for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for link in links:
        low, high = sorted((find(link["a"]), find(link["b"])))
        root[high] = low
    out: dict[int, list[int]] = {}
    for i in sorted(root):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def grouped(ids: pd.Series, links: pd.Series) -> pd.Series:
    """For each frame the sorted members of its groups, from all ids and the pairs that are linked."""
    return pd.Series([_components(list(own), [] if pairs is None else list(pairs)) for own, pairs in zip(ids, links)])


def savgol(x: np.ndarray, window: int, polyorder: int, deriv: int = 0) -> np.ndarray:
    """Savitzky-Golay smoothing; the ends are fitted by one polynomial each. Short inputs come back unchanged."""
    if len(x) < window:
        return x.copy()
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), polyorder + 1, increasing=True).astype(float)
    fit = np.linalg.pinv(basis)
    out = np.convolve(x, fit[deriv][::-1], "same")
    for at, part in ((slice(0, half), x[:window]), (slice(len(x) - half, len(x)), x[-window:])):
        poly = fit @ part
        where = np.arange(-half, 0) if at.start == 0 else np.arange(1, half + 1)
        out[at] = np.vander(where, polyorder + 1, increasing=True) @ poly
    return out


def gaussian(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing along the first axis with repeated edges."""
    half = int(truncate * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    padded = np.pad(x, [(half, half)] + [(0, 0)] * (x.ndim - 1), mode="edge")
    return np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 0, padded)


#: Rows of a track that a task holds, besides those that its kernel reaches beyond them.
RANGE = 16_384


def per_range(df: DataFrame, f, schema: T.StructType, reach: int, by: list[str] | None = None, size: int | None = None) -> DataFrame:
    """Applies f to ranges of `size` ordered rows of each individual (or of `by`) of each sequence, with the `reach` rows on
    either side that the track has; f returns a row for every row it got, in order, and those of the range itself stay.

    f sees the ends of a range as the ends of a track, so `reach` is how far a row's result may depend on others. A track
    longer than a range goes to several tasks, and rows near an edge go to two of them.
    """
    size = size or RANGE
    by = [c for c in (by if by is not None else [ID])]
    keys = [c for c in (*ENTRY, *by) if c in df.columns]
    track = Window.partitionBy(*keys)
    p, n = F.col("_p"), F.col("_n")
    df = df.withColumns({"_p": F.row_number().over(rows_of(df.columns, by)) - 1, "_n": F.count(F.lit(1)).over(track)})
    first, last = F.greatest(F.lit(0), F.floor((p - reach) / size)), F.least(F.floor((n - 1) / size), F.floor((p + reach) / size))
    dealt = df.withColumn("_range", F.explode(F.sequence(first, last))).drop("_n")

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_p", kind="stable").reset_index(drop=True)
        inner = (own["_p"] // size == key[-1]).to_numpy()
        return f(own.drop(columns=["_p", "_range"]))[inner]

    return dealt.groupBy(*keys, "_range").applyInPandas(run, schema)


def per_stream(df: DataFrame, f, schema: T.StructType, reach: int, by: list[str] | None = None, size: int | None = None) -> DataFrame:
    """As `per_range`, but a task reads the rows of its tracks once, in order, and holds a range and the rows beside it.

    The rows are neither dealt anew nor sorted anew where they come from a window over the same tracks. f gets a range with
    the rows beside it, the slice of the range's own rows, and the Arrow types of the columns, and returns Arrow batches of
    what these give, which go on together until they are a quarter of a range. The rows are numbered over the track, and a
    track that didn't come whole fails.
    """
    size = size or RANGE
    by = [c for c in (by if by is not None else [ID])]
    keys = [c for c in (*ENTRY, *by) if c in df.columns]
    rows = df.withColumn("_p", F.row_number().over(rows_of(df.columns, by)) - 1).sortWithinPartitions(*keys, order_column(df.columns))

    def tracks(batches):
        """(track, piece of its rows), where pieces of one track follow each other."""
        for batch in batches:
            code = batch.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(batch), int)
            edges = np.flatnonzero(np.diff(code)) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)]):
                if a < b:
                    yield tuple(None if pd.isna(v) else v for v in batch[keys].iloc[a]), batch.iloc[a:b]

    def found(batches, types: dict):
        track, own, at, done = None, None, 0, 0

        def given(to: int) -> list[pa.RecordBatch]:
            first = max(at, done - reach)
            part = own.iloc[first - at : to + reach - at].reset_index(drop=True)
            return f(part.drop(columns="_p"), slice(done - first, to - first), types)

        def rest():
            nonlocal done
            if own["_p"].max() + 1 != at + len(own):
                raise ValueError(f"the rows of track {track} came apart")
            while done < at + len(own):
                to = min(done + size, at + len(own))
                yield from given(to)
                done = to

        for name, piece in tracks(batches):
            if own is not None and name == track:
                own = pd.concat([own, piece], ignore_index=True)
            else:
                if own is not None:
                    yield from rest()
                track, own, at, done = name, piece, 0, 0
            while at + len(own) - done >= size + reach:
                yield from given(done + size)
                done += size
            gone = max(0, done - reach - at)
            own, at = own.iloc[gone:], at + gone
        if own is not None:
            yield from rest()

    def run(batches):
        types: dict = {}

        def read():
            for batch in batches:
                types.update({x.name: x.type for x in batch.schema})
                yield batch.to_pandas()

        held: list[pa.RecordBatch] = []
        for batch in found(read(), types):
            held.append(batch)
            if sum(b.num_rows for b in held) * 4 >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def smooth_columns(df: DataFrame, columns: list[str], window: int, polyorder: int, size: int | None = None) -> DataFrame:
    """Savitzky-Golay over each track; missing values count as 0 and are missing again afterwards."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        for c in columns:
            x = own[c].to_numpy(float)
            bad = ~np.isfinite(x)
            y = savgol(np.where(bad, 0.0, x), window, polyorder)
            y[bad] = np.nan
            own[c] = pd.Series(y).astype(object).where(~bad, None)
        return own

    return per_range(df, run, df.schema, window, size=size)


def temporal_stack(df: DataFrame, columns: list[str], half: int = 60, skip: int = 5, sigma: float = 30.0, pool: bool = True, pool_stats: tuple[str, ...] = ("mean",), fps: float = 30.0, seconds: float = 0.5, size: int | None = None) -> DataFrame:
    """Gaussian-smoothed columns at offsets -half..half in steps of skip rows (`x__t+05`), ends repeated, and Gaussian
    pools over a window of seconds (`x__pool_mean`)."""
    offsets = list(range(-half, half + 1, skip))
    names = [f"{c}__t{o:+03d}" for o in offsets for c in columns] + [f"{c}__pool_{s}" for s in pool_stats for c in columns if pool]
    keys = [f for f in df.schema if f.name in (*ENTRY, ID, "id1", "id2", "perspective", "frame", "time")]
    schema = T.StructType(keys + [T.StructField(n, T.DoubleType()) for n in names])
    window = max(1, round(seconds * fps))
    pool_sigma = max(1.0, seconds * fps / 6)
    truncate = max(1.0, window / (2 * pool_sigma))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = own[columns].to_numpy(float)
        smooth = gaussian(x, sigma)
        at = np.clip(np.arange(len(x))[:, None] + np.array(offsets), 0, len(x) - 1)
        parts = [smooth[at].reshape(len(x), -1)]
        if pool:
            mean = gaussian(x, pool_sigma, truncate)
            var = np.maximum(gaussian(x * x, pool_sigma, truncate) - mean * mean, 0)
            parts += [{"mean": mean, "var": var, "std": np.sqrt(var)}[s] for s in pool_stats]
        return pd.concat([own[[f.name for f in keys]], pd.DataFrame(np.concatenate(parts, 1), columns=names)], axis=1)

    by = [c for c in (ID, "id1", "id2", "perspective") if c in df.columns]
    reach = half + 1 + int(max(4.0 * sigma, truncate * pool_sigma) + 0.5)
    return per_range(df.select(*[f.name for f in keys], *columns), run, schema, reach, by, size)


def morlet_kernel(scale: float, bandwidth: float = 1.5, center: float = 1.0) -> np.ndarray:
    """The complex Morlet wavelet at a scale in rows, as weights of the rows around one (from before it to after it): its
    integral over each row's share of the support from -8 to 8, times the root of the scale.

    The integral is a running sum over 4,096 points, and a row reads the point at or before its edge.
    """
    x = np.linspace(-8, 8, 4096)
    psi = np.exp(-(x**2) / bandwidth) * np.exp(2j * np.pi * center * x) / np.sqrt(np.pi * bandwidth)
    step = x[1] - x[0]
    total = np.conj(np.cumsum(psi) * step)
    edges = (np.arange(scale * (x[-1] - x[0]) + 1) / (scale * step)).astype(int)
    shares = np.diff(np.concatenate([[0], total[edges[edges < len(x)]], [0]]))
    return np.sqrt(scale) * shares


def frequencies(f_min: float, f_max: float, n: int) -> np.ndarray:
    """n frequencies from f_min to f_max, evenly apart in octaves."""
    return 2.0 ** np.linspace(np.log2(f_min), np.log2(f_max), n)


def _power(n: float) -> int:
    return 1 << int(np.ceil(np.log2(n)))


class _Weights:
    """Sums of the rows around each row by each of several kernels, rows that aren't there being 0; products of spectra in
    blocks of rows that lie over each other. A block of all columns is transformed once for the kernels of about one length,
    and a track that is shorter than a kernel is one block, so it costs little; the kernels' spectra are kept."""

    #: Numbers that a product of spectra has, about, so that it stays in a core's cache.
    HELD = 1 << 15

    def __init__(self, kernels: list[np.ndarray]):
        self.kernels, self.spectra = kernels, {}
        self.lengths = sorted({_power(len(k)) for k in kernels})

    def _spectrum(self, i: int, size: int, most: int) -> np.ndarray:
        """Of kernel i around row 0 of a ring of `size` rows, without what is `most` rows or more from it."""
        if (i, size) not in self.spectra:
            # The kernel's middle, the later one of two, weighs the row itself.
            away = np.arange(len(self.kernels[i])) - len(self.kernels[i]) // 2
            near = np.abs(away) < most
            ring = np.zeros(size, complex)
            ring[-away[near]] = self.kernels[i][near]
            self.spectra[i, size] = np.fft.fft(ring)
        return self.spectra[i, size]

    def each(self, x: np.ndarray, inner: slice):
        """(number of a kernel, columns, sums) of the rows `inner` of x, which has a row for each column."""
        start, stop, _ = inner.indices(x.shape[1])
        for length in self.lengths:
            short = x.shape[1] <= length
            most = _power(x.shape[1]) if short else length
            size = 2 * most if short else max(1024, 4 * length)
            # A block's own rows are those that no kernel reaches around the ring.
            margin, own = (0, size) if short else (length // 2, size - length)
            heads = [0] if short else range(start - margin, stop - margin, own)
            blocks = np.zeros((len(x), len(heads), size))
            for j, at in enumerate(heads):
                part = x[:, max(0, at) : at + size]
                blocks[:, j, max(0, -at) : max(0, -at) + part.shape[1]] = part
            step = max(1, self.HELD // (len(heads) * size))
            for c in range(0, len(x), step):
                spectra = np.fft.fft(blocks[c : c + step])
                for i, kernel in enumerate(self.kernels):
                    if _power(len(kernel)) == length:
                        sums = np.fft.ifft(spectra * self._spectrum(i, size, most))[:, :, margin : margin + own].reshape(len(spectra), -1)
                        yield i, slice(c, c + len(spectra)), sums[:, start:stop] if short else sums[:, : stop - start]


def _weighted(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return next(sums for _, _, sums in _Weights([kernel]).each(x[None], slice(None)))[0]


def pair_wavelet(df: DataFrame, columns: list[str], fps: float = 30.0, f_min: float = 0.2, f_max: float = 5.0, n: int = 25, bandwidth: float = 1.5, center: float = 1.0, floor: float = -3.0, size: int | None = None, views: tuple[dict[str, str], ...] = ()) -> DataFrame:
    """Log power of a complex Morlet transform of each column at n frequencies (`W_x_f0`), from below by `floor`. A row's
    value depends on 8 periods' worth of rows to either side; values that are missing count as 0.

    With `views` a row of df, of a pair id_A and id_B, gives one row for each of them, of that perspective: a view tells
    which columns of df are id1, id2 and `columns`. A column that several views share is transformed once.
    """
    kernels = [morlet_kernel(fps / (f * center), bandwidth, center) for f in frequencies(f_min, f_max, n)]
    names = [f"W_{c}_f{i}" for c in columns for i in range(n)]
    keys = [f for f in df.schema if f.name in (*ENTRY, ID, "id1", "id2", "perspective", "frame", "time")]
    shared = [f.name for f in keys]
    if views:
        keys += [T.StructField("perspective", T.IntegerType(), False), *[T.StructField(c, df.schema[views[0][c]].dataType) for c in ("id1", "id2")]]
    schema = T.StructType(keys + [T.StructField(x, T.FloatType()) for x in names])
    used = sorted({view[c] for view in views for c in columns}) if views else list(columns)

    weights = _Weights(kernels)
    where = {c: i for i, c in enumerate(used)}

    def run(own: pd.DataFrame, inner: slice, types: dict) -> list[pa.RecordBatch]:
        x = np.nan_to_num(np.array([own[c].to_numpy(float) for c in used]))
        own = own.iloc[inner].reset_index(drop=True)
        powers = np.empty((len(used), n, len(own)), np.float32)
        for i, at, sums in weights.each(x, inner):
            powers[at, i] = np.maximum(np.log(sums.real**2 + sums.imag**2 + np.finfo(float).tiny), floor)
        as_arrow = lambda c: pa.Array.from_pandas(own[c], type=types[c])
        out = []
        for i, view in enumerate(views or [{c: c for c in columns}]):
            ids = [pa.array(np.full(len(own), i, np.int32)), as_arrow(view["id1"]), as_arrow(view["id2"])] if views else []
            values = [pa.array(row) for c in columns for row in powers[where[view[c]]]]
            out.append(pa.RecordBatch.from_arrays([*map(as_arrow, shared), *ids, *values], names=schema.names))
        return out

    by = ["id_A", "id_B"] if views else [c for c in (ID, "id1", "id2", "perspective") if c in df.columns]
    return per_stream(df.select(*shared, *(by if views else []), *used), run, schema, max(map(len, kernels)), by, size)


def triangles(points: np.ndarray) -> np.ndarray:
    """Delaunay triangulation of distinct points by insertion; for the points of one frame."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return np.zeros((0, 3, 2))
    span = max(np.ptp(p, axis=0).max(), 1e-9) * 1e3
    mid = p.mean(0)
    q = np.vstack([p, mid + [[-3 * span, -span], [3 * span, -span], [0, 3 * span]]])
    n = len(p)

    def circle(t: tuple) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = q[list(t)] - mid
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-30:
            return 0.0, 0.0, np.inf
        ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        return ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2

    open_ = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        x, y = q[i] - mid
        bad = [t for t, (cx, cy, r2) in open_.items() if (x - cx) ** 2 + (y - cy) ** 2 <= r2 * (1 + 1e-12)]
        edges: dict[tuple, int] = {}
        for t in bad:
            del open_[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                edges[e] = edges.get(e, 0) + 1
        for (a, b), times in edges.items():
            if times == 1:
                t = tuple(sorted((a, b, i)))
                open_[t] = circle(t)
    return np.array([q[list(t)] for t in open_ if max(t) < n]).reshape(-1, 3, 2)


def _alpha(points: np.ndarray, alpha: float) -> tuple[float | None, int]:
    """Area of the triangles whose circumradius is below alpha, and how many there are."""
    t = triangles(points)
    a, b, c = (np.hypot(*(t[:, i] - t[:, j]).T) for i, j in ((0, 1), (1, 2), (0, 2)))
    area = 0.5 * np.abs((t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0]))
    with np.errstate(divide="ignore", invalid="ignore"):
        keep = (area > 0) & (a * b * c / (4 * area) < alpha)
    return (float(area[keep].sum()) if keep.any() else None), int(keep.sum())


def alpha_shape(points, alpha: float):
    """(area, n_triangles) of the alpha shape of an array of structs x, y."""

    @F.pandas_udf(T.StructType([T.StructField("area", T.DoubleType()), T.StructField("n_triangles", T.IntegerType())]))
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_alpha(np.array([[p["x"], p["y"]] for p in own], float).reshape(-1, 2), alpha) for own in column], columns=["area", "n_triangles"])

    return run(points)
