"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that depends on doc_id and size alone; a document's
virtual finish time is its source's words up to and including it, divided by the source's target. All documents are
range-sorted by finish time, and the sorted table is cut where its running sum of words reaches the total budget, so
each source gets its target to within about one document. All running sums go through ranges of a sorted table, so
neither a source with a third of all rows nor the table of sources is summed by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, running_totals

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def _targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, total: int, scratch: Scratch) -> DataFrame:
    """Per source its number, size and target: the level rises for all sources by weight, and those that reach
    `most` times their size stop. The level is the largest of those that follow from capping the k sources
    that fill first."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    per = running_totals(per, [F.col("source").asc_nulls_last()], {"source_no": "one"}, scratch, "sources")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", w).withColumn("cap", (most * F.col("source_size")).cast("long"))
    filled = running_totals(per, [most * F.col("source_size") / F.col("w"), F.col("source_no")], {"caps": "cap", "ws": "w"}, scratch, "filled")
    all_w = filled.agg(F.sum("w")).first()[0] or 0
    level = F.try_divide(F.lit(share * total) - (F.col("caps") - F.col("cap")), F.lit(all_w) - (F.col("ws") - F.col("w")))
    top = filled.agg(F.max(level)).first()[0] or 0.0
    return filled.select("source", "source_no", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(top)).alias("target"))


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _served(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    """Each row's doc_id, source, size, source_size, target and taken."""
    scratch = Scratch(docs.sparkSession)
    order = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 16)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), order.alias("at"))
    sized = scratch.write(sized, "sized")
    total = sized.agg(F.sum("size")).first()[0] or 0
    targets = scratch.write(_targets(sized, weights, share, most, total, scratch), "targets")
    known = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("doc_id", "d.source", "size", "at", "source_no", "source_size", "target")
    # Words of a source up to a document: those of all sources before it come off the running sum over all.
    queued = running_totals(known, [F.col(c) for c in ("source_no", "at", "doc_id", "size")], {"upto": "size"}, scratch, "queues")
    heads = queued.groupBy("source_no").agg(F.max("upto").alias("end")).join(targets.select("source_no", F.col("source_size").alias("own")), "source_no")
    heads = scratch.write(heads.select("source_no", (F.col("end") - F.col("own")).alias("head")), "heads")
    queued = scratch.write(queued.join(heads, "source_no").withColumn("served", F.col("upto") - F.col("head")).drop("upto", "head"), "queued")

    # A document's turns: in each further pass its source is served once more from the front.
    turn = lambda p: F.when(F.col("target") > 0, (p * F.col("source_size") + F.col("served")) / F.col("target")).otherwise(0.0)
    place = lambda p: F.struct(turn(p).alias("finish"), "source_no", "at", "doc_id", F.lit(p).alias("pass"))
    turns = queued.select("size", F.explode(F.array(*[place(p) for p in range(most)])).alias("place"))
    line = running_totals(turns, [F.col("place")], {"words": "size"}, scratch, "turns")
    last = line.where(F.col("words") <= share * total).agg(F.max("place").alias("last")).first()["last"]
    if last is None:
        taken = F.lit(0)
    else:
        limit = F.struct(*[F.lit(last[f]).cast(t).alias(f) for f, t in turns.select("place.*").dtypes])
        taken = sum((F.when(place(p) <= limit, F.col("size")).otherwise(0) for p in range(most)), F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document of `docs(doc_id, text, source, ...)`.

    Returns doc_id, size (words), source_size, target (words its source should give) and taken (words the mix
    takes: 0 to `most` times size, always whole documents). Sources in code point order, a null source last,
    weigh `weights` in turn and share `share` times all words; a target stops at `most` times its source's size
    and the excess goes to the others by weight.

    Null and empty texts have size 0 and are taken 0 times. The order of a source depends on `seed`, doc_id and
    size only, so reruns agree; rows alike in doc_id, source and size come one after another. Null doc_ids queue like any
    other, as one doc_id. Other columns are not read, whatever their names. An empty table gives an empty result.
    Texts are counted whole, however long.
    """
    return _served(docs, weights, share, most, seed).drop("source")


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """`docs`, all columns as they are, each row as often as the mix takes it.

    Rows alike in doc_id, source and size are told apart by the hash of their text: the first ones get what the mix
    takes most often. Nulls, empty and very long texts and empty tables are as in `mix_sources`; columns of any name
    come back unchanged.
    """
    scratch = Scratch(docs.sparkSession)
    keys = [F.col("doc_id").alias("key_id"), F.col("source").alias("key_source"), F.col("size").alias("key_size")]
    served = _served(docs, weights, share, most, seed).where("size > 0").select(*keys, F.try_divide("taken", "size").cast("int").alias("copies"))
    served = served.groupBy("key_id", "key_source", "key_size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    served = scratch.write(served.where("copies[0] > 0"), "served")
    # All columns travel as one struct, so that none of them meets a name of this plan.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("key_id"), F.col("source").cast("string").alias("key_source"), _size().alias("key_size"))

    def same(right: DataFrame) -> Column:
        conditions = [rows[c].eqNullSafe(right[c]) for c in ("key_id", "key_source", "key_size")]
        return conditions[0] & conditions[1] & conditions[2]

    once, often = served.where(F.size("copies") == 1), served.where(F.size("copies") > 1)
    taken = rows.join(once, same(once)).select("row", F.get("copies", F.lit(0)).alias("times"))
    if not often.isEmpty():
        alike = rows.join(often, same(often)).select("row", "copies", *[often[c] for c in ("key_id", "key_source", "key_size")])
        first = Window.partitionBy("key_id", "key_source", "key_size").orderBy(F.xxhash64("row.text"))
        taken = taken.union(alike.withColumn("no", F.row_number().over(first)).select("row", F.get("copies", F.col("no") - 1).alias("times")))
    copied = taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return copied.select("row.*")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         substr(sha256('mix:' || CAST(doc_id AS VARCHAR)), 1, 16) AS ord
  FROM documents),
per AS (
  SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
levels AS (
  SELECT *, (1.5e0 * CAST(sum(s) OVER () AS DOUBLE)
             - CAST(coalesce(sum(2 * s) OVER (ORDER BY 2e0 * s / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(w) OVER (ORDER BY 2e0 * s / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
targets AS (
  SELECT source, no, s, least(CAST(2 * s AS DOUBLE), CAST(w AS DOUBLE) * max(level) OVER ()) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.size, d.ord, t.no, t.s, t.target,
         sum(d.size) OVER (PARTITION BY t.no ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT q.*, p, CASE WHEN target > 0 THEN CAST(p * s + served AS DOUBLE) / target ELSE 0e0 END AS finish
  FROM queued q, (VALUES (0), (1)) v(p)),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, no, ord, doc_id, p ROWS UNBOUNDED PRECEDING) AS running,
         1.5e0 * CAST(sum(size) OVER () AS DOUBLE) / 2 AS budget
  FROM turns)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target,
       CAST(sum(CASE WHEN running <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM served GROUP BY doc_id, size, s, target, ord, served.served
"""
