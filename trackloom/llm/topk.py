"""Exact top-k by inner product over whole-number vectors, by the three phases of the uniform threshold.

The components are dealt into LISTS parts, and a list holds what its part adds to the score of every candidate.
1. Each list gives its best entries for each query. The candidates met there are scored whole, which gives tau: that many
   of them score tau or more, so nothing below tau can be in the result.
2. Every query and list get a cutoff, the same share of what tau lies below the sum of the lists' own bests: a candidate
   below its cutoff in every list scores below tau in all. Each list gives all entries that reach its cutoff.
3. The candidates of these entries, and no others, are scored whole; the best of them are the result.
Taking scores relative to each list's best needs no sign of them, and keeps cutoffs sharp where lists differ in size.

Lists are scanned in blocks: a task holds one part of ROWS candidates and of QUERIES queries, and what it scores beside
each other are SLAB of these. Equal vectors are one class with as many of its smallest ids as a result can hold, so copies
cost nothing and no two of them are ever paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, frugal

LISTS = 2
ROWS, QUERIES, SLAB = 8_192, 2_048, 128
#: Whole-number scores up to here are exact as doubles, and sums of LISTS of them in a long.
EXACT, LONGEST = 2**53, 2**61
PAIRS = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("list", pa.int32()), ("score", pa.int64())])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v), v = floor(1024 * x), of the vectors that take part: with an id, not null, all components finite. A
    vec_id that comes with several vectors has the smallest. Components whose products may leave a long refuse."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 1024).cast("long")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of whole numbers; where a row is shorter, zeros, which add nothing to a product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Products of all rows of q and x: as doubles, which is faster, if those hold them exactly."""
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else q @ x.T


def _pairs(query, found, lists, score) -> pa.Table:
    return pa.Table.from_arrays([pa.array(query), pa.array(found), pa.array(np.full(len(query), lists, np.int32)), pa.array(score)], schema=PAIRS)


def nearest_exactly(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k highest inner products of floor(1024 * x) for each row of `vectors(vec_id, embedding, ...)` where `is_query`
    holds of vec_id, among all rows but its own: query_id, rank (from 1), vec_id, score, ties to the smaller vec_id.

    All candidates come if there are fewer than k. Vectors that are null or hold a null or a value that isn't finite take
    no part, nor do rows without vec_id; rows that repeat count once (see `usable`). Of vectors of different sizes, the
    shorter lacks components, and those add nothing; an empty one scores 0. Other columns are not read. An empty table
    gives an empty result. Products that may leave a long raise an error.
    """
    spark = vectors.sparkSession
    scratch, most = Scratch(spark), k + 1
    rows = scratch.write(usable(vectors), "rows")
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= most)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.element_at("ids", 1))
    classes = scratch.write(classes.select("class", "ids", "v"), "classes")
    top = F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0))))
    n, width, largest = classes.agg(F.count("*"), F.max(F.size("v")), F.max(top)).first()
    width, largest = width or 0, largest or 0
    if width * largest * largest >= LONGEST:
        raise ValueError("components are too large: their products may not fit a long")
    exact = width * largest * largest < EXACT
    edges = [width * i // LISTS for i in range(LISTS + 1)]
    blocks = max(1, -(-n // ROWS))

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    asked = scratch.write(asked.join(classes.select("v", "class"), "v").select("query_id", F.col("class").alias("query")), "asked")
    wanted = classes.join(asked.select(F.col("query").alias("class")).distinct(), "class", "left_semi")
    wanted = scratch.write(wanted.select(F.col("class").alias("query"), "v"), "wanted")
    q_blocks = max(1, -(-wanted.count() // QUERIES))

    # A block is (row block, query block); both sides are copied to the blocks that they take part in, by arrays of a few
    # numbers, so each vector meets each query once.
    at_row = F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("row_block")
    at_query = F.pmod(F.xxhash64("query"), F.lit(q_blocks)).cast("int").alias("query_block")
    all_rows, all_queries = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(q_blocks - 1))

    def in_lists(df: DataFrame, *names) -> DataFrame:
        """Each row once a list, with that list's part of the vector."""
        parts = F.array(*[F.struct(F.lit(i).alias("list"), F.slice("v", edges[i] + 1, edges[i + 1] - edges[i]).alias("part")) for i in range(LISTS)])
        return df.select(*names, F.inline(parts))

    listed = in_lists(classes.select("class", "v", at_row), "class", "row_block").withColumn("query_block", F.explode(all_queries))
    asking = in_lists(wanted.select("query", "v", at_query), "query", "query_block")
    key = ["list", "row_block", "query_block"]

    def slabs(data: pa.Table, queries: pa.Table, w: int):
        x, c = _matrix(data["part"], w), data["class"].to_numpy()
        q = _matrix(queries["part"], w)
        for at in range(0, len(q), SLAB):
            yield at, c, _scores(q[at : at + SLAB], x, exact)

    def first(key, data: pa.Table, queries: pa.Table) -> pa.Table:
        """The best entries of a block's part of a list."""
        lists, out = key[0].as_py(), [PAIRS.empty_table()]
        ids = queries["query"].to_numpy()
        for at, c, s in slabs(data, queries, edges[lists + 1] - edges[lists]) if data.num_rows else ():
            take = min(most, s.shape[1])
            bar = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
            i, j = np.nonzero(s >= bar[:, None])
            order = np.lexsort((c[j], -s[i, j], i))
            i, j = i[order], j[order]
            fine = np.arange(len(i)) - np.searchsorted(i, i) < take
            out.append(_pairs(ids[at + i[fine]], c[j[fine]], lists, s[i[fine], j[fine]]))
        return pa.concat_tables(out)

    def reaching(key, data: pa.Table, queries: pa.Table) -> pa.Table:
        """All entries of a block's part of a list that reach their query's cutoff."""
        lists, out = key[0].as_py(), [PAIRS.empty_table()]
        ids, need = queries["query"].to_numpy(), queries["need"].to_numpy()
        for at, c, s in slabs(data, queries, edges[lists + 1] - edges[lists]) if data.num_rows else ():
            i, j = np.nonzero(s >= need[at : at + len(s), None])
            out.append(_pairs(ids[at + i], c[j], lists, s[i, j]))
        return pa.concat_tables(out)

    def whole(key, data: pa.Table, queries: pa.Table) -> pa.Table:
        """Scores of a block's candidates, of which a query's best go on. Rows without a class are the queries."""
        ask = queries.filter(queries["class"].is_null()) if queries.num_rows else queries
        pairs = queries.filter(queries["class"].is_valid()) if queries.num_rows else queries
        if not pairs.num_rows:
            return PAIRS.empty_table()
        x, q = _matrix(data["part"], width), _matrix(ask["part"], width)
        c, ids = data["class"].to_numpy(), ask["query"].to_numpy()
        by_c, by_id = np.argsort(c), np.argsort(ids)
        j = by_c[np.searchsorted(c, pairs["class"].to_numpy(), sorter=by_c)]
        i = by_id[np.searchsorted(ids, pairs["query"].to_numpy(), sorter=by_id)]
        i, j = np.divmod(np.unique(i * len(c) + j), len(c))
        s = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + ROWS]], x[j[a : a + ROWS]]) for a in range(0, len(i), ROWS)])
        order = np.lexsort((c[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        fine = np.arange(len(i)) - np.searchsorted(i, i) < most
        return _pairs(ids[i[fine]], c[j[fine]], -1, s[fine])

    shape = "query long, class long, list int, score long"
    blocked = asking.withColumn("row_block", F.explode(all_rows))
    local = listed.groupBy(*key).cogroup(blocked.groupBy(*key)).applyInArrow(first, shape)
    best = F.row_number().over(Window.partitionBy("query", "list").orderBy(F.desc("score"), "class"))
    local = scratch.write(local.withColumn("n", best).where(F.col("n") <= most).drop("n"), "local")

    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    met = local.select("query", "class").distinct().join(classes.select("class", "v"), "class").join(wanted.withColumnRenamed("v", "q"), "query").select("query", product.alias("score"))
    tau = met.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") == most).select("query", F.col("score").alias("tau"))
    own = local.groupBy("query", "list").agg(F.min("score").alias("own"))
    spare = own.groupBy("query").agg(F.sum("own").alias("sum")).join(tau, "query", "left").select("query", (F.col("tau") - F.col("sum")).alias("spare"))
    # The least whole number that is a LISTS-th of the spare or more; fewer candidates than a result holds are all taken.
    share = F.expr(f"(spare + pmod(-spare, {LISTS})) div {LISTS}")
    cutoffs = own.join(spare, "query").select("query", "list", F.coalesce(F.col("own") + share, F.lit(-(2**63))).alias("need"))
    cutoffs = scratch.write(asking.join(cutoffs, ["query", "list"]), "cutoffs")

    entries = listed.groupBy(*key).cogroup(cutoffs.withColumn("row_block", F.explode(all_rows)).groupBy(*key)).applyInArrow(reaching, shape)
    entries = scratch.write(entries, "entries")

    none = F.lit(None).cast("long").alias("class")
    pairs = entries.select("query", "class", F.lit(None).cast("array<long>").alias("part"), at_row, at_query)
    asks = wanted.select("query", none, F.col("v").alias("part"), at_query).withColumn("row_block", F.explode(all_rows)).select(*pairs.columns)
    data = classes.select("class", F.col("v").alias("part"), at_row).withColumn("query_block", F.explode(all_queries))
    totals = data.groupBy(*key[1:]).cogroup(pairs.union(asks).groupBy(*key[1:])).applyInArrow(whole, shape)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))
    totals = totals.withColumn("n", best).where(F.col("n") <= most)

    found = totals.join(classes.select("class", "ids"), "class").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    each = asked.join(found, "query").select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", F.explode("f.ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows by comparing every query with every row.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 10
"""
