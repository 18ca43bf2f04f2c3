"""Windows over the rows of an individual, and what is built from them. Positions count rows unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .columns import ENTRY, ID, order_column
from .functions.numbers import wrap_angle


def rows_of(columns: list[str], by: list[str] | None = None, backward: bool = False) -> WindowSpec:
    """Rows of one individual (or of `by`) of a sequence, in order."""
    keys = [c for c in (*ENTRY, *(by if by is not None else [ID])) if c in columns]
    order = F.col(order_column(columns))
    return Window.partitionBy(*keys).orderBy(order.desc() if backward else order)


def difference(c: Column, w: WindowSpec, n: int = 1) -> Column:
    return c - F.lag(c, n).over(w)


def gradient(c: Column, w: WindowSpec) -> Column:
    """Central difference by row, one-sided at the ends; null if there is one row only."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, after - c).when(last, c - before).otherwise((after - before) / 2)


def without_jump(step: Column) -> Column:
    """What to add to a step of an angle so that it is no jump of half a turn or more."""
    return F.coalesce(F.when(F.abs(step) >= 3.141592653589793, wrap_angle(step) - step), F.lit(0.0))


def with_unwrapped(df: DataFrame, column: str, output: str, w: WindowSpec) -> DataFrame:
    """Adds the angle without jumps of half a turn or more."""
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_move", without_jump(difference(F.col(column), w))).withColumn(output, F.col(column) + F.sum("_move").over(running)).drop("_move")


def islands(df: DataFrame, starts: Column, w: WindowSpec, output: str) -> DataFrame:
    """Numbers runs of rows: `starts` holds where a new one begins."""
    return df.withColumn(output, F.sum(F.coalesce(starts, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def with_nearest_known(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds `_at`, the row's number, and for each column `_l_x` and `_r_x`, the (at, value) of its last value that isn't
    null up to the row and of the next one from it on.

    Both look back over a frame that only grows, the second one in reversed order, so a track costs one step a row.
    """
    ahead, back = (rows_of(df.columns, by, backward) for backward in (False, True))
    df = df.withColumn("_at", F.row_number().over(ahead))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).alias("value"))) for c in columns}
    last = lambda c, w: F.last(known[c], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({f"_l_{c}": last(c, ahead) for c in columns})
    return df.withColumns({f"_r_{c}": last(c, back) for c in columns})


def between(c: str, limit: int | None = None, both: bool = True) -> Column:
    """The value that `interpolated` gives, from what `with_nearest_known` added."""
    left, right = F.col(f"_l_{c}"), F.col(f"_r_{c}")
    after, before = F.col("_at") - left["at"], right["at"] - F.col("_at")
    inner = left["value"] + (right["value"] - left["value"]) * F.try_divide(after, right["at"] - left["at"])
    value = F.coalesce(inner, left["value"], right["value"] if both else F.lit(None))
    if limit is not None:
        near = F.coalesce(after <= limit, F.lit(False))
        value = F.when(near | F.coalesce(before <= limit, F.lit(False)) if both else near, value)
    return F.coalesce(F.col(c), value)


def interpolated(df: DataFrame, columns: list[str], by: list[str] | None = None, limit: int | None = None, both: bool = True) -> DataFrame:
    """Fills nulls linearly by row position over the rows of an individual (or of `by`).

    Without a limit gaps fill forward, tails included, and heads too if `both`. With a limit an inner gap is filled
    that deep from each side (from the left only unless `both`), and heads and tails that deep with the nearest value.
    """
    names = df.columns
    return with_nearest_known(df, columns, by).withColumns({c: between(c, limit, both) for c in columns}).select(*names)


def with_moving_average(df: DataFrame, columns: dict[str, str], window: int, by: list[str] | None = None) -> DataFrame:
    """Adds, for each column of `columns` (output: input), the mean of the known values of `window` rows around each row,
    one more before than after if `window` is even. The track is mirrored at its first and last row, which don't
    repeat; where it is too short for that, the mean is of the rows that there are."""
    left, right = window // 2, window - 1 - window // 2
    w = rows_of(df.columns, by)
    held = F.collect_list(F.struct(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns.values())])).over(w.rowsBetween(-left, left))
    df = df.withColumns({"_at": F.row_number().over(w), "_n": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_held": held})
    start = F.greatest(F.col("_at") - left, F.lit(1))
    mirrored = lambda j: F.when(j < 1, 2 - j).when(j > F.col("_n"), 2 * F.col("_n") - j).otherwise(j)
    df = df.withColumn("_held", F.transform(F.sequence(F.lit(-left), F.lit(right)), lambda o: F.get("_held", (mirrored(F.col("_at") + o) - start).cast("int"))))
    known = lambda i: F.filter(F.transform("_held", lambda s: s[f"v{i}"]), lambda v: v.isNotNull() & ~F.isnan(v))
    mean = lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda t, x: t + x), F.size(v))
    return df.withColumns({out: mean(known(i)) for i, out in enumerate(columns)}).drop("_at", "_n", "_held")


def over(c: Column, frame: WindowSpec, statistic: str = "mean", least: int = 1) -> Column:
    """A statistic of the values of a window's frame, null where fewer than `least` are not null."""
    if statistic == "median":  # Spark has no median over a frame of rows
        d = F.array_sort(F.collect_list(c).over(frame))
        n = F.size(d)
        value = (F.get(d, F.floor((n - 1) / 2).cast("int")) + F.get(d, F.floor(n / 2).cast("int"))) / 2
    else:
        value = {"mean": F.avg, "min": F.min, "max": F.max}[statistic](c).over(frame)
    return F.when(F.count(c).over(frame) >= least, value)


def rolling(c: Column, w: WindowSpec, window: int, statistic: str = "mean", least: int = 1) -> Column:
    """A centred statistic over `window` rows, null where fewer than `least` values are not null."""
    half = window // 2
    return over(c, w.rowsBetween(-half, window - 1 - half), statistic, least)
