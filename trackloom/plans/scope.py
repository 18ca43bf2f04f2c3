"""Which entries (group, sequence) a plan reads, and rows of neighbouring sequences around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ENTRY, GROUP, SEQUENCE, level_names, order_column
from ..joins import align

#: A list of entries up to this long becomes a filter that prunes partitions; a longer one is joined.
INLINE = 1_000


def in_scope(df: DataFrame, groups: list[str] | None = None, sequences: list[str] | None = None, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows of the chosen groups, sequences and entries; an empty selection is an error."""
    for name, chosen in (("groups", groups), ("sequences", sequences), ("entries", entries)):
        if chosen is not None and not chosen:
            raise ValueError(f"an empty selection of {name} selects nothing")
    if groups is not None:
        df = df.where(F.col(GROUP).isin(*groups))
    if sequences is not None:
        df = df.where(F.col(SEQUENCE).isin(*sequences))
    if entries is not None and len(entries) <= INLINE:
        return df.where(F.struct(GROUP, SEQUENCE).isin(*[F.struct(F.lit(g).alias(GROUP), F.lit(s).alias(SEQUENCE)) for g, s in entries]))
    if entries is not None:
        wanted = df.sparkSession.createDataFrame(entries, f"`{GROUP}` string, {SEQUENCE} string").distinct()
        df = df.join(wanted, ENTRY, "left_semi")
    return df


def entries_of(df: DataFrame) -> DataFrame:
    return df.select(*ENTRY).distinct()


def common_entries(tables: list[DataFrame]) -> DataFrame:
    out = entries_of(tables[0])
    for df in tables[1:]:
        out = out.intersect(entries_of(df))
    return out


def query_entries(df: DataFrame, group_contains=None, group_starts=None, group_ends=None, contains=None, starts=None, ends=None) -> DataFrame:
    """Entries by their names; `contains` is a regular expression."""
    out = entries_of(df)
    for c, has, start, end in ((GROUP, group_contains, group_starts, group_ends), (SEQUENCE, contains, starts, ends)):
        if has is not None:
            out = out.where(F.col(c).rlike(has))
        if start is not None:
            out = out.where(F.col(c).startswith(start))
        if end is not None:
            out = out.where(F.col(c).endswith(end))
    return out


def entry_levels(df: DataFrame, names: list[str], separator: str = "__") -> DataFrame:
    return entries_of(df).select(*ENTRY, *level_names(F.col(SEQUENCE), names, separator))


def with_overlap(df: DataFrame, frames: int) -> DataFrame:
    """Adds, to each sequence, the last frames of the one before and the first of the one after, within its group,
    as rows with is_core false. Sequences are in the order of their names; a plan ends by filtering on is_core."""
    order = order_column(df.columns)
    by_group = Window.partitionBy(GROUP).orderBy(SEQUENCE)
    seqs = entries_of(df).withColumns({"_before": F.lag(SEQUENCE).over(by_group), "_after": F.lead(SEQUENCE).over(by_group)})
    # The edges of a sequence come from its distinct frames, ranked with a limit that Spark applies before the exchange.
    numbers = df.select(*ENTRY, order).distinct()
    out = df.withColumn("is_core", F.lit(True))
    for near, ascending in (("_before", False), ("_after", True)):
        links = seqs.where(F.col(near).isNotNull()).select(F.col(GROUP), F.col(SEQUENCE).alias("_to"), F.col(near).alias(SEQUENCE))
        first = Window.partitionBy(*ENTRY).orderBy(F.col(order).asc() if ascending else F.col(order).desc())
        edge = numbers.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= frames).drop("_r")
        rows = df.join(edge, [*ENTRY, order]).join(links, [GROUP, SEQUENCE]).withColumn(SEQUENCE, F.col("_to"))
        out = out.unionByName(rows.select(*df.columns, F.lit(False).alias("is_core")))
    return out


def manifest(tables: list[DataFrame], frames: int = 0, groups: list[str] | None = None, sequences: list[str] | None = None, entries: list[tuple[str, str]] | None = None, where: str | None = None, allow_mixed: bool = False) -> DataFrame:
    """The rows of several tables side by side (see `joins.align`), of the chosen entries, with the neighbouring sequences'
    edge rows around each.

    The selection and the SQL condition `where` reach every table that has the columns; neighbours that aren't chosen lend
    no rows. `origin` is the sequence that a row comes from, as frames of neighbours may be equal, and `is_core` tells own
    rows. An operator runs over the whole, and `core` trims what it returns.
    """
    chosen = [in_scope(df, groups, sequences, entries) for df in tables]
    both = align(chosen, check=not allow_mixed, allow_mixed=allow_mixed)
    both = both.where(where) if where else both
    return with_overlap(both.withColumn("origin", F.col(SEQUENCE)), frames)


def core_bounds(df: DataFrame) -> DataFrame:
    """(group, sequence, core_start, core_end): where an entry's own rows begin and end among all of a manifest's."""
    before = F.count(F.when(~F.col("is_core") & (F.col("origin") < F.col(SEQUENCE)), 1))
    return df.groupBy(*ENTRY).agg(before.alias("core_start"), (before + F.count(F.when(F.col("is_core"), 1))).alias("core_end"))


def core(df: DataFrame) -> DataFrame:
    return df.where("is_core").drop("is_core")


