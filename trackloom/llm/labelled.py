"""Bounded samples of labelled rows, for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Steps of a hash threshold: a bounded sample is a fraction of these for any table that fits on disks.
STEPS = 1 << 40


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """About `most` of the rows, the same ones in every run: those whose hashed doc_id falls below a threshold that
    follows from the number of rows; all rows if there are no more than that."""
    n = rows.select("doc_id").count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < int(STEPS * most / n))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(doc_id, text, label), written, of about `most` documents at most that have the label and for which `train`
    holds. A label above 0 counts as 1, any other as 0; a document that has several gets the largest. The chosen ids are no more than that, so they are broadcast
    and the texts are not shuffled."""
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    known = bounded(known.where(train).groupBy("doc_id").agg(F.max("label").alias("label")), most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return Scratch(docs.sparkSession).write(texts.join(F.broadcast(known), "doc_id"), "sample")
