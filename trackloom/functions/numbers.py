"""Column expressions with the conventions of missing values: NaN and infinities are null, division by zero is null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PI = math.pi


def scrub(c: Column) -> Column:
    """Null for NaN and infinities."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def scrubbed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`df` with its floating columns, or the named ones, scrubbed."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: scrub(F.col(n)) for n in names if n in df.columns})


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.when(b != 0, b))


def steady_sum(c: Column) -> Column:
    """The sum of doubles as an aggregate, the same in whatever order they come, to the last bit.

    A term is cut into multiples of 2^-10, multiples of 2^-40 below those, and the rest. Sums of multiples are exact (the first
    up to 2^43, the second up to 2^24 terms); the rests, 2^-41 at most each, are too small for the order of theirs to show.
    Beyond that it is as good as a plain sum.
    """
    cut = lambda v, bits: F.when(F.abs(v) < 2.0 ** (52 - bits), F.rint(v * 2.0**bits) / 2.0**bits).otherwise(v)
    high = cut(c, 10)
    middle = cut(c - high, 40)
    return F.sum(high) + (F.sum(middle) + F.sum(c - high - middle))


def wrap_angle(a: Column) -> Column:
    """The same angle in [-pi, pi), but pi for what lies below -pi by less than a double at 2 pi can tell: half a turn back,
    to the last bit, is not less than half a turn. (`pmod` takes its remainder twice and would give -pi.)"""
    rest = (a + F.lit(PI)) % F.lit(2 * PI)
    return F.when(rest < 0, rest + F.lit(2 * PI)).otherwise(rest) - F.lit(PI)


def wrap_degrees(a: Column) -> Column:
    return F.pmod(a + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def forward(dx: Column, dy: Column, heading: Column) -> Column:
    """The component of an offset along a heading."""
    return dx * F.cos(heading) + dy * F.sin(heading)


def leftward(dx: Column, dy: Column, heading: Column) -> Column:
    return dy * F.cos(heading) - dx * F.sin(heading)


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def above(c: Column, threshold: float) -> Column:
    """1.0 where c exceeds the threshold, 0.0 elsewhere, nulls included."""
    return F.coalesce((c > threshold).cast("double"), F.lit(0.0))


def axes(sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column, Column, Column]:
    """Standard deviations along the major and minor axis of a covariance, their ratio, and the major axis's angle.
    The ratio is infinite for points on a line."""
    mid, half = (sxx + syy) / 2, F.hypot((sxx - syy) / 2, sxy)
    major, minor = F.sqrt(F.greatest(mid + half, F.lit(0.0))), F.sqrt(F.greatest(mid - half, F.lit(0.0)))
    ratio_ = F.when(minor > 0, F.try_divide(major, minor)).when(major > 0, float("inf"))
    return major, minor, ratio_, 0.5 * F.atan2(2 * sxy, sxx - syy)


def heading_between(front_x: Column, front_y: Column, rear_x: Column, rear_y: Column) -> Column:
    """The direction from the rear to the front point, null where they are one point."""
    dx, dy = front_x - rear_x, front_y - rear_y
    return F.when((dx != 0) | (dy != 0), F.atan2(dy, dx))


def in_degrees(df: DataFrame, column: str) -> bool:
    """Whether a column of angles holds degrees: some value is beyond a full turn in radians."""
    most = df.agg(F.max(F.abs(scrub(F.col(column))))).first()[0]
    return most is not None and most > 2 * PI
