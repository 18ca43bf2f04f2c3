"""From raw documents to encoded training data in five stages, each written as Parquet and read by the next.

Every stage reads all rows that its predecessor kept, whole texts of any length, and returns all columns of documents as
they are, except the last. An empty table goes through as an empty table. What a stage does with nulls, empty texts and
repeated rows is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, exact_dedup, minhash, mixing, quality
from trackloom.llm.labelled import remainder
from trackloom.llm.scratch import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LEAST_QUALITY = 0.7


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores 0.7 or more; it never learns from the held-out quarter. A null or empty
    text is one empty line; rows that repeat stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels, remainder(4) != 2), LEAST_QUALITY)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id; null texts are empty ones, and a null
    doc_id gives way to any other."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of their five-word shingles, that of the smallest doc_id. Texts
    without words link with nothing and stay, as do rows without doc_id."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice. Texts without words are never taken; a null source
    is a source, the last one."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of the ids and of the bytes that they decode to. A null or empty text has no ids; a document
    that the mix took twice comes twice."""
    both = bpe.decode(bpe.encode(docs, VOCABULARY, PATTERN), VOCABULARY)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash", drop_near_copies),
    ("mix", mix),
    ("bpe", encode),
]

#: The quality classifier is a fitted model, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
