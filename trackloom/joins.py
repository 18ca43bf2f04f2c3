"""Joins of track and feature tables. Group and sequence are part of every key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ALIGN, ENTRY, FRAME, ID, individuals


def align(inputs: list[DataFrame], check: bool = True, allow_mixed: bool = False) -> DataFrame:
    """Inner join of tables on the alignment keys that all have.

    Columns that several tables have are suffixed by `__<number of the table>` from the second on. Tables of
    individuals and of pairs need a shared id, and with `check`, which reads the data, at most one table may hold a key
    more than once.
    """
    if len(inputs) == 1:
        return inputs[0]
    keys = [c for c in ALIGN if all(c in df.columns for df in inputs)]
    named = {individuals(df.columns) for df in inputs} - {0}
    if len(named) > 1 and not allow_mixed and ID not in keys and not {"id1", "id2"} <= set(keys):
        raise ValueError("tables of individuals and of pairs share no id column")
    if not keys:
        raise ValueError("the tables share no alignment key")
    on = [c for c in ENTRY if all(c in df.columns for df in inputs)] + keys
    if check and not allow_mixed and _repeating(inputs, on) > 1:
        raise ValueError(f"several tables hold a key of {on} more than once")
    seen = set(on)
    renamed = []
    for i, df in enumerate(inputs):
        columns = [F.col(c) if c in on else F.col(c).alias(f"{c}__{i}" if i and c in seen else c) for c in df.columns if c in on or not (i and c in ENTRY)]
        seen |= set(df.columns)
        renamed.append(df.select(*columns))
    return reduce(lambda a, b: a.join(b, on), renamed)


def _repeating(inputs: list[DataFrame], on: list[str]) -> int:
    """How many of the tables hold a key more than once, in one pass over all their keys."""
    keys = reduce(DataFrame.union, [df.select(*on, F.lit(i).alias("_i")) for i, df in enumerate(inputs)])
    return keys.groupBy(*on, "_i").count().where("count > 1").select("_i").distinct().count()


def pairs(df: DataFrame, carry: list[str], ordered: bool = False, suffixes: tuple[str, str] = ("_A", "_B"), by: list[str] | None = None) -> DataFrame:
    """Pairs of individuals of one frame: id_A < id_B, or all id_A <> id_B if `ordered`. Both sides hash on the same
    keys, so the exchange is reused and the inequality stays a condition of an equi-join."""
    keys = [c for c in (*ENTRY, FRAME, *(by or [])) if c in df.columns]
    a, b = (df.select(*keys, *[F.col(c).alias(f"{c}{s}") for c in (ID, *carry)]) for s in suffixes)
    ids = F.col(f"{ID}{suffixes[0]}"), F.col(f"{ID}{suffixes[1]}")
    return a.join(b, keys).where(ids[0] != ids[1] if ordered else ids[0] < ids[1])


def nearest_pairs_only(pair_table: DataFrame, neighbours: DataFrame, id1: str = "id1", id2: str = "id2") -> DataFrame:
    """Rows of pairs in which either is the other's nearest neighbour; all rows of a frame without any."""
    keys = [c for c in (*ENTRY, FRAME) if c in pair_table.columns]
    nn = neighbours.where("nn_id is not null").select(*keys, F.col(ID).cast("long").alias("_who"), F.col("nn_id").cast("long").alias("_nn"))
    per_frame = nn.groupBy(*keys).agg(F.collect_set(F.struct("_who", "_nn")).alias("_links"))
    link: Column = lambda a, b: F.struct(F.col(a).cast("long").alias("_who"), F.col(b).cast("long").alias("_nn"))
    both = pair_table.join(per_frame, keys, "left")
    near = F.array_contains("_links", link(id1, id2)) | F.array_contains("_links", link(id2, id1))
    return both.where(F.col("_links").isNull() | near).drop("_links")
