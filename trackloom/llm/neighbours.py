"""Approximate nearest neighbours by inner product, from low-dimensional stable projections in kd-trees.

Vectors get one more component that gives all the same length, so the largest inner product is the least Euclidean
distance; then a Gaussian matrix, which is 2-stable, projects them to DIMENSIONS. A kd-tree over a bounded sample of
projected vectors deals all vectors to cells, and within its task each cell is a kd-tree of small leaves. A query
verifies the vectors of the leaves nearest in projection by the true product, then all vectors whose projection is
nearer than where the stopping test holds: beyond it, a vector at the k-th distance or nearer would have been projected
nearer with probability CONFIDENCE, by the chi-square distribution of projected squared distances. Each query first searches the
cell it falls into, then those other cells that the test doesn't rule out with what it has found.

Equal vectors are one class, with as many of its smallest ids as a result can hold, so copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, frugal

DIMENSIONS = 10
CONFIDENCE = 0.97
#: Projected vectors from which the tree over cells is built; vectors of a cell; queries of a block; vectors of a leaf.
FITTED = 20_000
CELL, LEAST_CELLS = 32_768, 8
BLOCK = 4_096
LEAF = 128
#: Leaves that are verified before the stopping test is made.
FIRST = 4
#: Visits of a batch that is passed on.
VISITS = 8_192


def chi_square(x: np.ndarray, m: int = DIMENSIONS) -> np.ndarray:
    """Distribution function of the chi-square distribution with an even number m of degrees of freedom."""
    half = np.minimum(x / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(p: float, m: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), m) < p else (low, mid)
    return high


def splits(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A complete kd-tree as a heap of (dimension, value): halves at the median of the widest dimension."""
    tree: list[tuple[int, float]] = []
    level = [points]
    while len(level) < cells:
        below = []
        for own in level:
            d = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
            v = float(np.median(own[:, d])) if len(own) else 0.0
            tree.append((d, v))
            below += [own[own[:, d] <= v], own[own[:, d] > v]]
        level = below
    return tree


def locate(points: np.ndarray, tree: list[tuple[int, float]], cells: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if not tree:
        return at
    dims, values = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
    for _ in range(int(math.log2(cells))):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] > values[at])
    return at - (cells - 1)


class Cells:
    """The boxes of the cells' vectors and of all nodes above them, as a heap; empty nodes are out of reach."""

    def __init__(self, cells: int, names: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.cells = cells
        self.low, self.high = np.full((2 * cells - 1, DIMENSIONS), np.inf), np.full((2 * cells - 1, DIMENSIONS), -np.inf)
        self.low[names + cells - 1], self.high[names + cells - 1] = low, high
        for i in range(cells - 2, -1, -1):
            self.low[i] = np.minimum(self.low[2 * i + 1], self.low[2 * i + 2])
            self.high[i] = np.maximum(self.high[2 * i + 1], self.high[2 * i + 2])

    def far(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance of each point and the box of its node."""
        gap = np.maximum(np.maximum(self.low[nodes] - points, points - self.high[nodes]), 0)
        return (gap * gap).sum(1)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The cell that a descent to the nearer child reaches."""
        at = np.zeros(len(points), np.int64)
        for _ in range(int(math.log2(self.cells))):
            left = 2 * at + 1
            at = left + (self.far(points, left + 1) < self.far(points, left))
        return at - (self.cells - 1)

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of all cells whose squared distance is below the point's reach, by a descent of the tree."""
        who, at = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(int(math.log2(self.cells)) + 1):
            near = self.far(points[who], at) < reach[who]
            who, at = who[near], at[near]
            if level < int(math.log2(self.cells)):
                who, at = np.repeat(who, 2), (2 * at[:, None] + [1, 2]).ravel()
        return who, at - (self.cells - 1)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    out, stack = [], [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        d = int(np.ptp(points[own], axis=0).argmax())
        order = own[np.argpartition(points[own, d], len(own) // 2)]
        stack += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def search(vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_points: np.ndarray, worst: np.ndarray, k: int, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of these vectors for each query: positions of queries, ids, products.

    worst: each query's k-th product so far, or -inf. spare: |q|**2 + M**2, from which a product follows as half of
    what the squared distance leaves. The vectors of the FIRST leaves nearest to the query are verified; the k-th
    distance then sets how near a vector must be projected to be looked at, which rules out leaves by their boxes and
    vectors by their own projections.
    """
    leaves = _leaves(points)
    sizes = np.array([len(i) for i in leaves])
    order = np.concatenate(leaves)
    vectors, points, ids = vectors[order], points[order], ids[order]
    starts = np.cumsum(sizes) - sizes
    low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
    norms, limit = (points * points).sum(1), quantile(CONFIDENCE)
    out_q, out_i, out_s = [], [], []
    for q in range(len(queries)):
        p = query_points[q]
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        far = (gap * gap).sum(1)
        nearest = np.argpartition(far, FIRST)[:FIRST] if len(far) > FIRST else np.arange(len(far))
        look = np.zeros(len(ids), bool)
        for i in nearest:
            look[starts[i] : starts[i] + sizes[i]] = True
        s, bar = vectors[look] @ queries[q], worst[q]
        if len(s) >= k:
            bar = max(bar, float(np.partition(s, len(s) - k)[len(s) - k]))
        if bar == -np.inf:
            look[:] = True
        else:
            reach = limit * max(spare[q] - 2 * bar, 1e-12)
            rows = np.flatnonzero(np.repeat(far < reach, sizes))
            look[rows[norms[rows] - 2 * (points[rows] @ p) + p @ p < reach]] = True
        found = np.flatnonzero(look)
        s = (vectors @ queries[q])[found] if 4 * len(found) > len(ids) else vectors[found] @ queries[q]
        i = ids[found]
        if len(s) > k:
            top = s >= np.partition(s, len(s) - k)[len(s) - k]
            s, i = s[top], i[top]
            top = np.lexsort((i, -s))[:k]
            s, i = s[top], i[top]
        out_q.append(np.full(len(s), q))
        out_i.append(i)
        out_s.append(s)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: finite, not zero, of the most common dimension. A vec_id that comes
    with several vectors has the smallest."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (dims[0]["d"] if dims else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, seed: int = 17) -> DataFrame:
    """The k nearest of all rows of `vectors(vec_id, embedding, ...)` for those where `is_query` holds of vec_id.

    Returns query_id, rank (from 1), vec_id and score (inner product in double precision), nearest first, ties to
    the smaller vec_id; a query's own row is no candidate; all candidates come if there are fewer than k. Vectors
    that are null, zero, not finite or of another dimension than most take no part (see `usable`). Rows that
    repeat count once. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(usable(vectors), "rows")
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = scratch.write(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.element_at("ids", 1)), "classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, longest, width = classes.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    n, longest, width = n, longest or 1.0, width or 1
    cells = 1 << max(math.ceil(math.log2(max(1, n / CELL))), int(math.log2(LEAST_CELLS)))
    gauss = np.random.Generator(np.random.PCG64(seed)).standard_normal((width + 1, DIMENSIONS))

    def project(x: np.ndarray, data: bool) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0)) if data else np.zeros(len(x))
        return x @ gauss[:-1] + rest[:, None] * gauss[-1]

    step = max(1, n // FITTED)
    sample = classes.where(F.pmod(F.xxhash64("class"), F.lit(step)) == 0).select("v").toArrow()
    tree = splits(project(_matrix(sample.column(0), width), True), cells)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            p = project(x, True)
            yield pa.RecordBatch.from_arrays([pa.array(locate(p, tree, cells)), batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), DIMENSIONS).cast(pa.list_(pa.float64()))], ["cell", "class", "v", "p"])

    index = scratch.write(classes.select("class", "v").mapInArrow(frugal(place), "cell long, class long, v array<double>, p array<double>"), "index")
    box = [f(F.element_at("p", i + 1)).alias(f"{s}{i}") for s, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    boxes = index.groupBy("cell").agg(*box).collect()
    names = np.array([b["cell"] for b in boxes], np.int64)
    low, high = (np.array([[b[f"{s}{i}"] for i in range(DIMENSIONS)] for b in boxes]).reshape(-1, DIMENSIONS) for s in ("low", "high"))
    found_cells = spark.sparkContext.broadcast(Cells(cells, names, low, high))

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    asked = scratch.write(asked.join(classes.select("v", "class"), "v").select("query_id", F.col("class").alias("query")), "asked")
    wanted = classes.join(asked.select(F.col("query").alias("class")).distinct(), "class", "left_semi").select(F.col("class").alias("query"), "v")
    limit = quantile(CONFIDENCE)

    def home(batches):
        """Each query with the cell it is in, or near to."""
        for batch in batches:
            cell = found_cells.value.home(project(_matrix(batch.column(1), width), False))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), pa.array(np.full(len(cell), -np.inf))], ["cell", "query", "v", "bar"])

    def others(batches):
        """Each query with the further cells that its k-th product so far doesn't rule out."""
        for batch in batches:
            x, homes, bar = _matrix(batch.column(1), width), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            left = np.maximum((x * x).sum(1) + longest**2 - 2 * bar, 1e-12)
            i, cell = found_cells.value.within(project(x, False), limit * left)
            away = cell != homes[i]
            i, cell = i[away], cell[away]
            for at in range(0, len(i), VISITS):
                own = pa.array(i[at : at + VISITS])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + VISITS]), batch.column(0).take(own), batch.column(1).take(own), pa.array(bar[i[at : at + VISITS]])], ["cell", "query", "v", "bar"])

    def look(key, data: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("cell", pa.int64()), ("query", pa.int64()), ("class", pa.int64()), ("score", pa.float64())])
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = _matrix(data["v"], width), _matrix(queries["v"], width)
        found = search(x, _matrix(data["p"], DIMENSIONS), data["class"].to_numpy(), q, project(q, False), queries["bar"].to_numpy(), k + 1, (q * q).sum(1) + longest**2)
        who = queries["query"].to_numpy()[found[0]]
        return pa.Table.from_arrays([pa.array(np.full(len(who), key[0].as_py())), pa.array(who), pa.array(found[1]), pa.array(found[2])], schema=schema)

    def searched(visits: DataFrame, name: str) -> DataFrame:
        """A task holds one cell and one block of its queries."""
        visits = scratch.write(visits, f"{name}-visits")
        blocks = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        q = visits.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query"), "blocks")).drop("blocks")
        d = index.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        found = d.groupBy("cell", "block").cogroup(q.groupBy("cell", "block")).applyInArrow(look, "cell long, query long, class long, score double")
        return scratch.write(found, name)

    visit = "cell long, query long, v array<double>, bar double"
    near = searched(wanted.mapInArrow(frugal(home), visit), "near")
    held = near.groupBy("query").agg(F.max("cell").alias("cell"), F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("bar"))
    further = searched(wanted.join(held, "query").select("query", "v", "cell", "bar").mapInArrow(frugal(others), visit), "further")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    best = near.union(further).withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k + 1).select("query", "class", "score")
    listed = best.join(classes.select("class", "ids"), "class").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    each = asked.join(listed, "query").select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", F.explode("f.ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
