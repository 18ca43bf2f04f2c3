"""Centroid clustering of whole-number vectors by sort-means, exact in every step.

Each round sorts, for every centroid, the other centroids by their distance from it. A vector starts at the centroid it
was assigned to and scans the others in that order; it stops at the first that lies strictly beyond twice its own
distance, as by the triangle inequality neither that one nor any later one can be nearer, or as near.

Vectors with their assignments are a written table, one a round, of which two exist at a time. What goes through the
driver are the centroids and one row of sums for each of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, frugal

#: Components from here on have squared distances that a long may not hold.
LARGEST = 1 << 27
#: Vectors that a task compares at once.
ROWS = 8_192


def whole_numbers(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v) with v = floor(1024 * x) of the rows that have exactly `dims` components, none null or not finite.
    A component of 131,072 or more in size refuses the table, as its distances may not fit a long."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.when(F.abs(c) < LARGEST / 1024, F.floor(c * 1024)).otherwise(F.raise_error(F.lit("a component is too large for distances in longs"))).cast("long"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt:vec_id, in that order; of equal ids the smaller vector comes
    first, rows without an id come last."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r["v"] for r in rows.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x from c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def reassign(x: np.ndarray, old: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector and its squared distance, ties to the smaller number, by scans from `old`."""
    cluster, distance = old.copy(), np.empty(len(x), np.int64)
    for c in np.unique(old):
        own = np.flatnonzero(old == c)
        apart = squared(centroids, centroids[c])
        order = np.lexsort((np.arange(len(centroids)), apart))
        order = order[order != c]
        anchor = squared(x[own], centroids[c])
        best, at = np.full(len(own), c), anchor.copy()
        for other in order:
            # Distances are squared: beyond twice the distance is beyond four times its square.
            open_ = np.flatnonzero(apart[other] <= 4 * anchor)
            if not len(open_):
                break
            d = squared(x[own[open_]], centroids[other])
            closer = (d < at[open_]) | ((d == at[open_]) & (other < best[open_]))
            best[open_[closer]], at[open_[closer]] = other, d[closer]
        cluster[own], distance[own] = best, at
    return cluster, distance


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, v, cluster, distance) after one round of scans."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                found = reassign(x, part.column("cluster").to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(found[0], pa.int32()), pa.array(found[1])], ["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster").mapInArrow(frugal(run), "vec_id long, v array<long>, cluster int, distance long")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after the assignments of `state`: exact componentwise floor of the mean; an empty one stays."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def sort_means(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3") -> tuple[DataFrame, np.ndarray]:
    """Clusters `vectors(vec_id, embedding, ...)`; returns (vec_id, cluster, distance) and the final centroids.

    Vectors that are null, of another size than `dims`, or that hold a null or a value that isn't finite take no part.
    Rows that repeat count as often as they come, and each returns a row; a null vec_id goes through as null. With fewer
    vectors than k there are as many centroids. Equal centroids: the smaller number gets the vectors. Other columns are
    not read. An empty table gives an empty result and no centroid.
    """
    scratch = Scratch(vectors.sparkSession)
    state = scratch.write(whole_numbers(vectors, dims).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(state, k, salt).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        after = scratch.write(_assigned(state, centroids), "round")
        scratch.drop(state)
        state, centroids = after, _moved(after, centroids)
    if not len(centroids):
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    last = scratch.write(_assigned(state, centroids).drop("v"), "clusters")
    scratch.drop(state)
    return last, centroids


def clusters_with_inertia(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    found, centroids = sort_means(vectors, **options)
    spark = vectors.sparkSession
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(i, s, sum(sums.values()), digest[i]) for i, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a centroid: k rows at most.
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3") -> str:
    """The rows of `clusters_with_inertia` over `embeddings` as SQL, by comparing every vector with every centroid."""
    near = """r{r} AS MATERIALIZED (
  SELECT n, cluster, distance FROM (
    SELECT v.n, c.cluster, d.distance, row_number() OVER (PARTITION BY v.n ORDER BY d.distance, c.cluster) AS first
    FROM v CROSS JOIN c{r} AS c, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance) AS d
  ) WHERE first = 1)"""
    moved = """c{s} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} AS c LEFT JOIN (
    SELECT cluster, list(w ORDER BY i) AS e FROM (
      SELECT r.cluster, u.i, CAST((sum(u.x) - ((sum(u.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS w
      FROM r{r} AS r JOIN u ON r.n = u.n GROUP BY r.cluster, u.i
    ) GROUP BY cluster) AS m ON c.cluster = m.cluster)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [moved.format(r=r, s=r + 1), near.format(r=r + 1)]
    return f"""
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
           WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(x, lambda c: CAST(floor(1024 * c) AS BIGINT)) AS e FROM f),
u AS MATERIALIZED (SELECT n, unnest(e) AS x, unnest(generate_series(1, {dims})) AS i FROM v),
c0 AS MATERIALIZED (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, e) - 1 AS INTEGER) AS cluster, e FROM v) WHERE cluster < {k}),
{", ".join(steps)},
h AS (SELECT cluster, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c{rounds})
SELECT v.vec_id, r.cluster, r.distance, CAST(sum(r.distance) OVER (PARTITION BY r.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(r.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM r{rounds} AS r JOIN v ON r.n = v.n JOIN h ON r.cluster = h.cluster
"""
