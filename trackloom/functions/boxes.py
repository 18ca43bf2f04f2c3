"""Boxes around keypoints as column expressions: centre and size in shares of the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import pose_pairs
from .numbers import scrubbed

BOX = ("box_cx", "box_cy", "box_w", "box_h")


def _shares(low: tuple[Column, Column], high: tuple[Column, Column], size: tuple[float, float]) -> list[Column]:
    """Centre and size of a box, cut off at the image."""
    ends = [(F.greatest(a, F.lit(0.0)), F.least(b, F.lit(float(n)))) for a, b, n in zip(low, high, size)]
    share = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return [share((a + b) / 2 / n) for (a, b), n in zip(ends, size)] + [share((b - a) / n) for (a, b), n in zip(ends, size)]


# The default shares and the least padding in pixels.
MARGIN, BODY_SHARE, LEAST_PAD, LENGTH_SHARE, SIDE_SHARE = 0.1, 0.3, 20.0, 0.25, 0.35


def keypoint_boxes(df: DataFrame, width: float, height: float, method: str = "tight", margin: float = MARGIN, head: int | None = None, tail: int | None = None, body_share: float = BODY_SHARE, least_pad: float = LEAST_PAD, length_share: float = LENGTH_SHARE, side_share: float = SIDE_SHARE) -> DataFrame:
    """Adds BOX, the box around each row's keypoints in shares of an image of `width` by `height` pixels; zeros where
    no keypoint is known.

    `tight` adds `margin` of the box's own size on each side. `isotropic` adds the same pixels everywhere: `body_share` of
    the distance of head and tail (of the box's diagonal where one is missing), `least_pad` at least. `oriented` is
    around the axis from tail to head, `length_share` of it longer at both ends and `side_share` wider on both sides; it
    needs both indices, and rows that lack a point get the isotropic box. Indices count pairs in lexical order.
    """
    if method not in ("tight", "isotropic", "oriented"):
        raise ValueError(f"no method {method!r}")
    if method == "oriented" and (head is None or tail is None):
        raise ValueError("an oriented box needs the indices of head and tail")
    points = pose_pairs(df.columns)
    plain = scrubbed(df, [c for p in points for c in p])
    known = [F.col(x).isNotNull() & F.col(y).isNotNull() for x, y in points]
    axis = lambda i: [F.when(k, F.col(p[i])) for k, p in zip(known, points)]
    least, most = (lambda c: F.least(*c) if len(c) > 1 else c[0]), (lambda c: F.greatest(*c) if len(c) > 1 else c[0])
    # Steps are columns of their own, so that their expressions aren't repeated in what follows.
    steps = [{f"_{s}{i}": f(axis(i)) for s, f in (("low", least), ("high", most)) for i in (0, 1)}]
    steps.append({f"_extent{i}": F.col(f"_high{i}") - F.col(f"_low{i}") for i in (0, 1)})
    steps.append({"_body": F.hypot("_extent0", "_extent1")})
    if head is not None and tail is not None:
        end = lambda i, a: F.when(known[i], F.col(points[i][a]))
        steps.insert(0, {f"_{n}{a}": end(i, a) for n, i in (("head", head), ("tail", tail)) for a in (0, 1)})
        steps.insert(1, {"_length": F.hypot(F.col("_head0") - F.col("_tail0"), F.col("_head1") - F.col("_tail1"))})
        steps.append({"_body": F.coalesce(F.when(F.col("_length") > 0, F.col("_length")), F.col("_body"))})
    if method == "tight":
        steps.append({f"_pad{i}": F.col(f"_extent{i}") * margin for i in (0, 1)})
    else:
        steps.append({f"_pad{i}": F.greatest(F.col("_body") * body_share, F.lit(float(least_pad))) for i in (0, 1)})
    shares = _shares(*(tuple(F.col(f"_{s}{i}") + sign * F.col(f"_pad{i}") for i in (0, 1)) for s, sign in (("low", -1), ("high", 1))), (width, height))
    steps.append(dict(zip(BOX, shares)))
    if method == "oriented":
        steps.append({f"_u{i}": (F.col(f"_head{i}") - F.col(f"_tail{i}")) / F.nullif(F.col("_length"), F.lit(0.0)) for i in (0, 1)})
        side = (-F.col("_u1"), F.col("_u0"))
        corner = lambda i: [F.col(f"_{n}{i}") + (s * F.col(f"_u{i}") * length_share + t * side[i] * side_share) * F.col("_length") for n, s in (("head", 1), ("tail", -1)) for t in (1, -1)]
        steps.append({f"_{n}{i}": f(*corner(i)) for n, f in (("from", F.least), ("to", F.greatest)) for i in (0, 1)})
        turned = _shares(*(tuple(F.col(f"_{n}{i}") for i in (0, 1)) for n in ("from", "to")), (width, height))
        steps.append({n: F.when(F.col("_length") > 1e-6, t).otherwise(F.col(n)) for n, t in zip(BOX, turned)})
    for step in steps:
        plain = plain.withColumns(step)
    return plain.withColumns({n: F.coalesce(F.when(F.col("_low0").isNotNull(), F.col(n)), F.lit(0.0)) for n in BOX}).select(*df.columns, *BOX)
