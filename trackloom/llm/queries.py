"""The corpus operators as queries over the `documents` and `embeddings` tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import remainder
    from .quality import fit, score_quality

    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit(docs, labels, remainder(4) != 2))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import remainder
    from .toxicity import fit, score_toxicity

    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, fit(docs, labels, remainder(5) != 0))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import held_out, score_texts

    return score_texts(_documents(spark, sf_dir), ~held_out(10, 0))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(_documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import remainder
    from .language import fit, identify

    docs = _documents(spark, sf_dir)
    found = identify(docs, fit(docs, remainder(4) != 2))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import nearest_exactly

    return nearest_exactly(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import digest, periodic_runs, with_repeats

    return digest(periodic_runs(with_repeats(_documents(spark, sf_dir))))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sort_means import clusters_with_inertia

    return clusters_with_inertia(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, dims=64, salt="3")


OP7_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_neighbours, op3_quality, op4_toxicity, op5_suffix_tree, op6_mix, op7_exact_dedup, op8_secrets, op9_bpe, op10_language, op11_topk, op12_periods, op13_sort_means)}


def oracle_sql() -> dict[str, str]:
    from . import mixing, periods, sort_means, topk

    return {
        "op6_mix": mixing.ORACLE_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op11_topk": topk.ORACLE_SQL,
        "op12_periods": periods.ORACLE_SQL,
        "op13_sort_means": sort_means.oracle_sql(),
    }
