"""Approach and avoidance, and segments in which two individuals interact."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ANGLE, ENTRY, FRAME, ID, X, Y
from ..functions.numbers import scrubbed
from ..joins import pairs
from ..windows import difference, rows_of, with_moving_average

TINY = 1e-12


def approach_avoidance(df: DataFrame, distance: float = 200.0, approach_speed: float = 5.0, avoid_speed: float = 5.0, cos_approach: float = 0.8, cos_avoid: float = 0.5, window: int = 10, least: int = 5, orientation_gate: float | None = 0.866, consecutive: int = 1, fps: float | None = None, smooth_window: int | None = None) -> DataFrame:
    """For each pair id1 < id2 and frame: aa_event_12 (1 where id1 approaches and id2 avoids), aa_event_21, and their
    maximum as aa_event and label_id.

    A frame is a candidate if the two are no further apart than `distance`, both are fast enough, the approacher moves
    towards the other and the avoider away; with a gate the approacher also looks where it moves. An event needs
    `least` candidates within the last `window` frames, this one included. Velocity needs a step of `consecutive`
    frames; it is per second if fps is given. With `smooth_window` distance, speeds and cosines are averaged over that
    many rows of the pair first (see `windows.with_moving_average`).
    """
    df = scrubbed(df, [X, Y, ANGLE])
    w = rows_of(df.columns)
    step = F.coalesce(difference(F.col(FRAME), w) == consecutive, F.lit(False))
    rate = F.lit(float(fps or 1.0))
    df = df.withColumns({"_vx": F.when(step, difference(F.col(X), w) * rate), "_vy": F.when(step, difference(F.col(Y), w) * rate)})
    both = pairs(df, [X, Y, "_vx", "_vy", *([ANGLE] if ANGLE in df.columns else [])], suffixes=("1", "2"))
    dx, dy = F.col(f"{X}2") - F.col(f"{X}1"), F.col(f"{Y}2") - F.col(f"{Y}1")
    both = both.withColumns({"_dx": dx, "_dy": dy, "_d": F.hypot(dx, dy), "_s1": F.hypot("_vx1", "_vy1"), "_s2": F.hypot("_vx2", "_vy2")})

    def cosine(s: int, sign: int):
        along = sign * (F.col(f"_vx{s}") * F.col("_dx") + F.col(f"_vy{s}") * F.col("_dy"))
        return along / F.greatest(F.col("_d") * F.col(f"_s{s}"), F.lit(TINY))

    gated = orientation_gate is not None and ANGLE in df.columns
    ahead = lambda s: (F.col(f"_vx{s}") * F.cos(f"{ANGLE}{s}") + F.col(f"_vy{s}") * F.sin(f"{ANGLE}{s}")) / F.greatest(F.col(f"_s{s}"), F.lit(TINY))
    both = both.withColumns({"_raw": F.col("_s1").isNotNull() & F.col("_s2").isNotNull()})
    both = both.withColumns({f"_cos{s}{sign > 0}": cosine(s, sign) for s in (1, 2) for sign in (1, -1)} | ({f"_ahead{s}": ahead(s) for s in (1, 2)} if gated else {}))
    if smooth_window:
        measured = ["_d", "_s1", "_s2", *[c for c in both.columns if c.startswith(("_cos", "_ahead"))]]
        both = with_moving_average(both, {c: c for c in measured}, smooth_window, ["id1", "id2"])

    def candidate(a: int, b: int, sign: int):
        c = F.col("_raw") & (F.col("_d") > 0) & (F.col("_d") <= distance) & (F.col(f"_s{a}") >= approach_speed) & (F.col(f"_s{b}") >= avoid_speed)
        c = c & (F.col(f"_cos{a}{sign > 0}") >= cos_approach) & (F.col(f"_cos{b}{sign > 0}") >= cos_avoid)
        if gated:
            c = c & (F.col(f"_ahead{a}") >= orientation_gate)
        return F.coalesce(c.cast("int"), F.lit(0))

    both = both.withColumns({"_c12": candidate(1, 2, 1), "_c21": candidate(2, 1, -1)})
    keys = [c for c in ENTRY if c in both.columns]
    recent = Window.partitionBy(*keys, "id1", "id2").orderBy(FRAME).rangeBetween(-(window - 1), 0)
    event = lambda c: F.when((F.col(c) == 1) & (F.sum(c).over(recent) >= min(least, window)), 1).otherwise(0)
    both = both.withColumns({"aa_event_12": event("_c12"), "aa_event_21": event("_c21")})
    any_ = F.greatest("aa_event_12", "aa_event_21")
    return both.select(*keys, FRAME, "id1", "id2", any_.alias("label_id"), any_.alias("aa_event"), "aa_event_12", "aa_event_21")


def event_table(aa: DataFrame, least: int = 1) -> DataFrame:
    """Runs of active rows, contiguous in the order of rows: start, end, duration, direction (12 or 21) and roles."""
    keys = [c for c in ENTRY if c in aa.columns] + ["id1", "id2"]
    w = Window.partitionBy(*keys).orderBy(FRAME)
    # Both directions are numbered in the pair's own order; only active rows are doubled.
    run = {d: F.row_number().over(w) - F.sum(f"aa_event_{d}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for d in ("12", "21")}
    active = aa.select(*keys, FRAME, "aa_event_12", "aa_event_21").withColumns({f"_run_{d}": r for d, r in run.items()}).where("aa_event_12 = 1 or aa_event_21 = 1")
    either = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"aa_event_{d}").alias("_on"), F.col(p).alias("approacher_id"), F.col(q).alias("avoider_id"), F.col(f"_run_{d}").alias("_run")) for d, p, q in (("12", "id1", "id2"), ("21", "id2", "id1"))])
    rows = active.select(*keys, FRAME, F.explode(either).alias("e")).select(*keys, FRAME, "e.*")
    runs = rows.where("_on = 1").groupBy(*keys, "direction", "approacher_id", "avoider_id", "_run")
    runs = runs.agg(F.min(FRAME).alias("start_frame"), F.max(FRAME).alias("end_frame"), F.count("*").alias("duration")).where(F.col("duration") >= least)
    return runs.select(*keys, "start_frame", "end_frame", "duration", "direction", "approacher_id", "avoider_id")


def pair_interaction_filter(df: DataFrame, shift: float = 15.0, most_distance: float = 40.0, facing: bool = True, most_angle: float = 80.0, least_run: int = 250, padding: int = 10, structure: int = 25, px_scale: float = 1.0) -> DataFrame:
    """The frames of segments in which a pair interacts: one row per frame and segment.

    Points shifted ahead of both individuals are closer than `most_distance` and, with `facing`, their headings are
    opposite to within `most_angle` degrees. The sequence of yes and no is closed, then opened, over `structure` rows;
    runs of `least_run` rows or more are padded by rows at both ends. interaction_end is the last frame included.
    """
    df = scrubbed(df, [X, Y, ANGLE])
    ahead = {"_px": F.col(X) + shift * px_scale * F.cos(ANGLE), "_py": F.col(Y) + shift * px_scale * F.sin(ANGLE)}
    both = pairs(df.withColumns(ahead), ["_px", "_py", ANGLE], suffixes=("1", "2"))
    close = F.hypot(F.col("_px1") - F.col("_px2"), F.col("_py1") - F.col("_py2")) < most_distance * px_scale
    if facing:
        turn = F.abs(F.col(f"{ANGLE}1") - F.col(f"{ANGLE}2"))
        turn = F.pmod(turn, F.lit(2 * math.pi))
        close = close & (math.pi - F.least(turn, 2 * math.pi - turn) < math.radians(most_angle))
    keys = [c for c in ENTRY if c in both.columns] + ["id1", "id2"]
    w = Window.partitionBy(*keys).orderBy(FRAME)
    both = both.select(*keys, FRAME, F.coalesce(close.cast("int"), F.lit(0)).alias("_on")).withColumns({"_row": F.row_number().over(w), "_rows": F.count("*").over(Window.partitionBy(*keys))})
    before, after = structure // 2, structure - 1 - structure // 2
    # Outside of the sequence nothing is on.
    inside = (F.col("_row") > before) & (F.col("_row") <= F.col("_rows") - after)
    grow = lambda c: F.max(c).over(w.rowsBetween(-before, after))
    shrink = lambda c: F.when(inside, F.min(c).over(w.rowsBetween(-before, after))).otherwise(0)
    for f in (grow, shrink, shrink, grow):
        both = both.withColumn("_on", f("_on"))
    # A row is long if one of the `least_run` stretches of that many rows that hold it is all on; by running sums, as sorting by
    # runs would hold the rows of a task again.
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    most = max(1, least_run)
    both = both.withColumn("_sum", F.sum("_on").over(running))
    full = F.coalesce((F.lead("_sum", most - 1).over(w) - F.col("_sum") + F.col("_on") == most).cast("int"), F.lit(0))
    both = both.withColumn("_full", full).withColumn("_fulls", F.sum("_full").over(running))
    both = both.withColumn("_long", (F.col("_fulls") > F.coalesce(F.lag("_fulls", most).over(w), F.lit(0))).cast("int"))
    starts = F.when((F.col("_long") == 1) & (F.coalesce(F.lag("_long").over(w), F.lit(0)) == 0), 1).otherwise(0)
    both = both.withColumn("_start", starts).withColumn("_segment", F.when(F.col("_long") == 1, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    # A row belongs to every segment that has a row within the padding.
    near = F.array_distinct(F.collect_list("_segment").over(w.rowsBetween(-padding, padding)))
    each = both.select(*keys, FRAME, near.alias("_near")).select(*keys, FRAME, F.explode("_near").alias("segment"))
    span = Window.partitionBy(*keys, "segment")
    return each.select(*keys, FRAME, "segment", F.min(FRAME).over(span).alias("interaction_start"), F.max(FRAME).over(span).alias("interaction_end"))
