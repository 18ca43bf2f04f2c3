"""Neighbours of one frame by cells of grids instead of by all pairs.

The square around a frame's positions is cut into 2**level by 2**level cells. A row that looks a distance far meets the
rows of its own cell and of those around it, in the finest grid whose cells are as wide as that, so it meets little more
than its disc holds. At level 0 a frame is one cell; that is where frames of FEW rows or fewer are left, as nine copies of
a row would cost more than its few partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW = 48
#: The finest level; positions are whole numbers of this many bits.
BITS = 20
#: Cells are wider than the distance by this share, which is more than divisions may round.
MARGIN = 1e-6


def placed(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Adds, for rows that have a position, `_ix` and `_iy`, the position in cells of the finest level of its frame's
    square, `_extent`, the square's side, and `_many`, whether the frame has more than FEW such rows."""
    frame = Window.partitionBy(*keys)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    own = {c: F.when(ok, F.col(c)) for c in (x, y)}
    df = df.withColumns({f"_{s}{i}": f(own[c]).over(frame) for i, c in enumerate((x, y)) for s, f in (("low", F.min), ("high", F.max))} | {"_many": F.count(F.when(ok, 1)).over(frame) > FEW})
    df = df.withColumn("_extent", F.greatest(F.col("_high0") - F.col("_low0"), F.col("_high1") - F.col("_low1")))
    at = lambda c, i: F.least(F.lit((1 << BITS) - 1), F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"_low{i}"), F.col("_extent")), F.lit(0.0)) * (1 << BITS))).cast("long")
    return df.withColumns({"_ix": F.when(ok, at(x, 0)), "_iy": F.when(ok, at(y, 1))}).drop("_low0", "_low1", "_high0", "_high1")


def level(reach: Column) -> Column:
    """The finest level whose cells are as wide as `reach`; 0 in a frame of few rows."""
    times = F.try_divide(F.col("_extent"), reach * (1 + MARGIN))
    # A reach of 0 meets equal positions only. Doubles have exact powers of two, so a rounded logarithm is put right.
    fit = F.floor(F.log2(times)).cast("int")
    fit = fit - F.when(F.pow(F.lit(2.0), fit) > times, 1).otherwise(0)
    return F.when(F.col("_many"), F.greatest(F.lit(0), F.least(F.lit(BITS), F.when(reach > 0, fit).otherwise(BITS)))).otherwise(0).cast("int")


def _at(c: str, at: Column) -> Column:
    return F.call_function("shiftright", F.col(c), F.lit(BITS) - at)


def looking(df: DataFrame) -> DataFrame:
    """Each row once for every cell around it at its `_level`: `_cx`, `_cy`. Rows without a position look nowhere, and stay."""
    steps, top = (-1, 0, 1), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    around = F.array(*[F.struct((_at("_ix", F.col("_level")) + i).alias("_cx"), (_at("_iy", F.col("_level")) + j).alias("_cy")) for i in steps for j in steps])
    inside = F.filter(around, lambda c: (c["_cx"] >= 0) & (c["_cx"] < top) & (c["_cy"] >= 0) & (c["_cy"] < top))
    one = F.array(F.struct(F.lit(0).cast("long").alias("_cx"), F.lit(0).cast("long").alias("_cy")))
    cells = F.when(F.col("_ix").isNotNull() & (F.col("_level") > 0), inside).when(F.col("_ix").isNotNull(), one)
    return df.select("*", F.inline_outer(cells))


def seen(df: DataFrame, levels: Column) -> DataFrame:
    """Each row that has a position once for every level of `levels`, in its own cell."""
    each = df.where(F.col("_ix").isNotNull()).withColumn("_level", F.explode(levels))
    return each.withColumns({"_cx": _at("_ix", F.col("_level")), "_cy": _at("_iy", F.col("_level"))})


CELL = ["_level", "_cx", "_cy"]


def _spread(c: Column) -> Column:
    """The bits of a number below 2**32, a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = (c.bitwiseOR(F.shiftleft(c, shift))).bitwiseAND(F.lit(mask))
    return c


def z_order(x: str = "_ix", y: str = "_iy") -> Column:
    """Number of a cell of the finest level along a curve whose neighbours are mostly near."""
    return _spread(F.col(x)).bitwiseOR(F.shiftleft(_spread(F.col(y)), 1))
