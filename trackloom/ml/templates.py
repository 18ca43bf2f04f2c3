"""Bounded, proportional samples of feature rows, from which global models are fitted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ENTRY, feature_columns


def with_quotas(counts: DataFrame, pool: int, most_share: float = 1.0) -> DataFrame:
    """Adds to `counts(..., n)`, one row an entry, how many of its rows go into a pool: in proportion, capped at a share
    of the pool (at least an equal share), the remainder spread over the uncapped. Small entries may get none."""
    total, entries = counts.agg(F.sum("n"), F.count("*")).first()
    if (total or 0) <= pool:
        return counts.withColumn("quota", F.col("n"))
    cap = max(int(max(most_share, 1 / entries) * pool), 1)
    most = F.least(F.lit(cap), F.col("n"))
    first = counts.withColumn("quota", F.least(F.floor(F.col("n") * (pool / total)), most))
    unfilled = F.col("quota") < most
    given, size = first.agg(F.sum("quota"), F.sum(F.when(unfilled, F.col("n")))).first()
    more = F.floor(F.col("n") * ((pool - given) / (size or 1)))
    return first.withColumn("quota", F.when(unfilled, F.least(F.col("quota") + more, most)).otherwise(F.col("quota")))


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def _drawn(seed: int, columns: list[str], df: DataFrame):
    """An order of rows that depends on the seed and their values only."""
    return F.xxhash64(F.lit(seed), *columns, *[c for c in ("frame", "id") if c in df.columns])


def extract_templates(df: DataFrame, pool: int, columns: list[str] | None = None, seed: int = 0, most_share: float = 1.0, strategy: str = "random", templates: int | None = None) -> DataFrame:
    """About `pool` rows, shared among entries in proportion to their complete rows, in an order that depends on the
    seed and the rows' values only. Quotas and rows stay on the executors.

    `farthest_first` then keeps `templates` rows of the pool, each the farthest from those before: every entry's part of
    the pool is thinned to that many in a task of its own, and the last choice is among what these keep. The pool is
    bounded, so one task can hold it.
    """
    if strategy not in ("random", "farthest_first"):
        raise ValueError(f"no strategy {strategy!r}")
    columns = columns or feature_columns(df)
    complete = _complete(df, columns)
    counts = with_quotas(complete.groupBy(*ENTRY).agg(F.count("*").alias("n")), pool, most_share)
    # Row numbers are uniform hashes, so the first `quota` of them lie below this share of all but for a chance of 1e-20; what
    # lies above never leaves its task.
    share = (F.col("quota") + 10 * F.sqrt(F.col("quota")) + 60) / F.greatest(F.col("n"), F.lit(1))
    at = F.shiftrightunsigned(F.col("_h"), 11) / F.lit(float(1 << 53))
    near = complete.withColumn("_h", _drawn(seed, columns, df)).join(counts.withColumn("_share", share).select(*ENTRY, "quota", "_share"), ENTRY).where(at < F.col("_share"))
    order = Window.partitionBy(*ENTRY).orderBy(at, *[c for c in ("frame", "id") if c in df.columns])
    picked = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("quota"))
    picked = picked.select(*[c for c in (*ENTRY, "frame", "id") if c in df.columns], *columns)
    if strategy == "random":
        return picked if templates is None else picked.orderBy(_drawn(seed, columns, df)).limit(templates)
    if templates is None:
        raise ValueError("farthest_first needs a number of templates")

    def spread(own):
        own = own.sort_values([c for c in (*ENTRY, "frame", "id") if c in own.columns], kind="stable")
        return own.iloc[farthest_first(own[columns].to_numpy(float), templates, seed)]

    return picked.groupBy(*ENTRY).applyInPandas(spread, picked.schema).groupBy().applyInPandas(spread, picked.schema)


def provenance(templates: DataFrame) -> DataFrame:
    """Rows of each entry among the templates, and their share of all."""
    counts = templates.groupBy(*ENTRY).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("share", F.try_divide(F.col("n"), F.lit(total)))


def split_by_sequence(df: DataFrame, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds split (train, test): whole sequences go to one side, at least one to each where there are two and the share
    is neither 0 nor 1."""
    entries = df.select(*ENTRY).distinct()
    n = entries.count()
    n_test = 0 if test_share <= 0 or (n <= 1 and test_share < 1) else n if test_share >= 1 else max(1, min(n - 1, round(test_share * n)))
    test = entries.orderBy(F.xxhash64(F.lit(seed), *ENTRY), *ENTRY).limit(n_test).withColumn("split", F.lit("test"))
    return df.join(test, ENTRY, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def labelled_templates(df: DataFrame, columns: list[str], per_class: int | dict[int, int] | None = None, total: int | None = None, strategy: str = "random", pool: int | None = None, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Complete rows of each label in each split (whole sequences, see `split_by_sequence`), at most as many as its target.

    The target is `per_class`, one number or one for each label, or `total` over the number of labels; just one of the
    two is given. `random` draws rows by a hash; `farthest_first` draws `pool` rows of each split and label, the
    target if there is no pool, and keeps those that are farthest from each other.
    """
    if (per_class is None) == (total is None):
        raise ValueError("give either per_class or total")
    if strategy not in ("random", "farthest_first"):
        raise ValueError(f"no strategy {strategy!r}")
    rows = split_by_sequence(_complete(df, columns).where("label is not null"), test_share, seed)
    if total is not None:
        target = F.lit(total // max(1, rows.select("label").distinct().count()))
    elif isinstance(per_class, dict):
        target = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in per_class.items() for x in kv]), F.col("label").cast("int")), F.lit(0)) if per_class else F.lit(0)
    else:
        target = F.lit(per_class)
    held = F.greatest(F.when(target > 0, F.lit(pool)), target) if strategy == "farthest_first" and pool else target
    w = Window.partitionBy("split", "label").orderBy(_drawn(seed, columns, df))
    keys = [c for c in (*ENTRY, "frame", "id") if c in df.columns]
    drawn = rows.withColumns({"_r": F.row_number().over(w), "_target": target.cast("int")}).where(F.col("_r") <= held)
    drawn = drawn.select("split", "label", *keys, *columns, "_target")
    if strategy == "random":
        return drawn.drop("_target")

    def spread(own):
        return own.iloc[farthest_first(own[columns].to_numpy(float), int(own["_target"].iloc[0]), seed)]

    return drawn.groupBy("split", "label").applyInPandas(spread, drawn.schema).drop("_target")


def farthest_first(points: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Indices of k points, each the farthest from those chosen before; for a pool that was drawn already."""
    if k >= len(points):
        return np.arange(len(points))
    chosen = [int(np.random.default_rng(seed).integers(len(points)))]
    near = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)
