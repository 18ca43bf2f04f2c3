"""Features of whole groups in each frame, and of the groups that individuals form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ANGLE, ENTRY, FRAME, ID, TIME, X, Y
from ..functions.numbers import above, axes, cross, forward, leftward, ratio, scrub, scrubbed
from ..windows import difference, rows_of
from .kinematics import chunks
from .neighbours import unit_headings


def frame_aggregate(df: DataFrame, column: str, agg: str = "mean", output: str | None = None, where: str | None = None, threshold: float | None = None, absolute: bool = False) -> DataFrame:
    """One row per frame: an aggregate of a column over its rows. With a threshold the column becomes 1.0 above it and
    0.0 elsewhere; std has n - 1 in the denominator; the sum of nothing is 0. The time is the frame's smallest, as rows have
    no order here; the rows of a frame have one time."""
    value = scrub(F.col(column))
    value = F.abs(value) if absolute else value
    value = above(value, threshold) if threshold is not None else value
    f = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}[agg]
    df = df.where(where) if where else df
    keys = [c for c in (*ENTRY, FRAME) if c in df.columns]
    time = [F.min(TIME).alias(TIME)] if TIME in df.columns else []
    return df.groupBy(*keys).agg(*time, f(value).alias(output or f"{column}_{agg}"))


def state(rotation, polarization):
    """Milling, Swarm or Polarized where both are clearly high or low, else Transitional; Undefined if one is missing."""
    low, high = (lambda c: c < 0.35), (lambda c: c > 0.65)
    known = F.when(low(rotation) & high(polarization), "Polarized").when(low(rotation) & low(polarization), "Swarm").when(high(rotation) & low(polarization), "Milling").otherwise("Transitional")
    return F.when(rotation.isNull() | polarization.isNull(), "Undefined").otherwise(known)


def collective_motion(df: DataFrame, fps: float = 30.0, heading_source: str = "auto", subgroup: str | None = None, least: int = 3, max_gap: int = 1, least_speed: float = 0.0, speed: str | None = None, where: str | None = None, area: bool = False) -> DataFrame:
    """Order of each frame's group: polarization, rotation about its centroid, angular velocity, state, the centroid's
    position and motion, shape. `where` filters rows before headings are taken.

    Values that relate members are null below `least` of them; the centroid's velocity is the mean of its members'
    steps that are at most `max_gap` frames long and stay in the subgroup.
    """
    df = df.where(where) if where else df
    df = unit_headings(scrubbed(df, [X, Y, ANGLE] + ([speed] if speed else [])), heading_source)
    keys = [c for c in (*ENTRY, FRAME, *([subgroup] if subgroup else [])) if c in df.columns]
    w = rows_of(df.columns)
    gap = difference(F.col(FRAME), w)
    same = (gap > 0) & (gap <= max_gap)
    if subgroup:
        same = same & (F.lag(subgroup).over(w) == F.col(subgroup))
    dt = gap / F.lit(float(fps))
    df = df.withColumns({"_vx": F.when(same, ratio(difference(F.col(X), w), dt)), "_vy": F.when(same, ratio(difference(F.col(Y), w), dt))})
    df = df.where(F.col(X).isNotNull() & F.col(Y).isNotNull())
    moving = F.col("_vx").isNotNull() & F.col("_vy").isNotNull()
    frame = Window.partitionBy(*keys)
    df = df.withColumns({"_cx": F.avg(X).over(frame), "_cy": F.avg(Y).over(frame), "_mvx": F.avg(F.when(moving, F.col("_vx"))).over(frame), "_mvy": F.avg(F.when(moving, F.col("_vy"))).over(frame)})
    df = df.withColumns({"_rx": F.col(X) - F.col("_cx"), "_ry": F.col(Y) - F.col("_cy")}).withColumn("_r", F.hypot("_rx", "_ry"))
    aimed = F.col("ux").isNotNull() & F.col("uy").isNotNull()
    turn = cross(ratio(F.col("_rx"), F.col("_r")), ratio(F.col("_ry"), F.col("_r")), F.col("ux"), F.col("uy"))
    swing = ratio(cross(F.col("_rx"), F.col("_ry"), F.col("_vx") - F.col("_mvx"), F.col("_vy") - F.col("_mvy")), F.col("_r") * F.col("_r"))
    aggs = [F.min(TIME).alias(TIME)] if TIME in df.columns else []
    aggs += [
        F.count("*").alias("n_ids"),
        F.count(F.when(aimed, 1)).alias("n_ids_heading"),
        F.count(F.when(F.col("_r") == 0, 1)).alias("n_at_centroid"),
        F.count(F.when(moving, 1)).alias("n_centroid_common"),
        F.sum(F.when(aimed, F.col("ux"))).alias("_sx"),
        F.sum(F.when(aimed, F.col("uy"))).alias("_sy"),
        F.count(turn).alias("_nt"),
        F.sum(turn).alias("_turn"),
        F.avg(swing).alias("group_angvel"),
        F.first("_cx").alias("centroid_x"),
        F.first("_cy").alias("centroid_y"),
        F.first("_mvx").alias("_mvx"),
        F.first("_mvy").alias("_mvy"),
        F.avg(F.col("_rx") * F.col("_rx")).alias("_sxx"),
        F.avg(F.col("_ry") * F.col("_ry")).alias("_syy"),
        F.avg(F.col("_rx") * F.col("_ry")).alias("_sxy"),
        F.max("heading_source").alias("heading_source"),
    ]
    if speed:
        aggs.append(F.avg(speed).alias("mean_speed"))
    if area:
        aggs.append(F.collect_set(F.struct(F.col(X).alias("x"), F.col(Y).alias("y"))).alias("_points"))
    out = df.groupBy(*keys).agg(*aggs)
    enough, headed = F.col("n_ids") >= least, (F.col("n_ids") >= least) & (F.col("n_ids_heading") >= least)
    major, minor, elongation, axis = axes(F.col("_sxx"), F.col("_syy"), F.col("_sxy"))
    out = out.withColumns(
        {
            "polarization": F.when(headed, ratio(F.hypot("_sx", "_sy"), F.col("n_ids_heading"))),
            "mean_heading": F.when(headed, F.atan2("_sy", "_sx")),
            "rotation_signed": F.when(headed & (F.col("_nt") > 0), ratio(F.col("_turn"), F.col("n_ids_heading"))),
            "group_angvel": F.when(enough, F.col("group_angvel")),
            "centroid_speed": F.hypot("_mvx", "_mvy"),
            "sd_major": F.when(enough, major),
            "sd_minor": F.when(enough, minor),
            "elongation": F.when(enough, elongation),
            "principal_axis_angle": F.when(enough, axis),
        }
    )
    out = out.withColumn("rotation", F.abs("rotation_signed")).withColumn("centroid_heading", F.when(F.col("centroid_speed") > least_speed, F.atan2("_mvy", "_mvx")))
    out = out.withColumn("state", state(F.col("rotation"), F.col("polarization")))
    if area:
        from ..functions.kernels import hull_area

        out = out.withColumn("area", F.when(enough, hull_area(F.col("_points")))).withColumn("density", F.when(F.col("area") > 0, ratio(F.col("n_ids"), F.col("area"))))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def fission_fusion(df: DataFrame, cutoff: float = 50.0, window: int = 5, least_event: int = 1) -> DataFrame:
    """The groups that individuals form: (frame, id) for every id of the sequence and every frame of it, with
    group_membership (the group's smallest id), group_size and event (-1 without one).

    Two individuals are linked where their distance, averaged over `window` rows around the frame, is below the
    cutoff; groups are the components. An event is a run of consecutive frames in which a group keeps its members and
    whose last and first frames are `least_event` or more apart. Duplicate rows keep one; absent individuals are alone.
    """
    from ..functions.kernels import grouped

    df = scrubbed(df, [X, Y])
    entry = [c for c in ENTRY if c in df.columns]
    known = F.struct(F.col(X).isNotNull(), X, Y)
    df = df.groupBy(*entry, FRAME, ID).agg(F.max_by(F.struct(F.col(X).alias("x"), F.col(Y).alias("y")), known).alias("p"))
    # One row per frame: its number among the frames of the sequence, and the run of consecutive frames that it is in.
    by_frame = Window.partitionBy(*entry).orderBy(FRAME)
    frames = df.select(*entry, FRAME).distinct()
    frames = frames.withColumns({"_at": F.row_number().over(by_frame), "_new": F.coalesce((F.col(FRAME) - F.lag(FRAME).over(by_frame) != 1).cast("int"), F.lit(1))})
    frames = frames.withColumn("_run", F.sum("_new").over(by_frame)).drop("_new")
    # The distance of a pair counts in each frame whose window holds it, so a pair's mean over a window is one sum.
    there = df.join(frames, [*entry, FRAME]).where(F.col("p.x").isNotNull() & F.col("p.y").isNotNull())
    a, b = (there.select(*entry, "_at", F.col(ID).cast("long").alias(i), F.col("p").alias(p)) for i, p in (("a", "pa"), ("b", "pb")))
    apart = a.join(b, [*entry, "_at"]).where("a < b").select(*entry, "a", "b", "_at", F.hypot(F.col("pa.x") - F.col("pb.x"), F.col("pa.y") - F.col("pb.y")).alias("d"))
    half = window // 2
    spread = apart.select(*entry, "a", "b", "d", F.explode(F.sequence(F.col("_at") - half, F.col("_at") + half)).alias("_at"))
    links = spread.groupBy(*entry, "_at", "a", "b").agg(F.avg("d").alias("d")).where(F.col("d") < cutoff)
    links = links.groupBy(*entry, "_at").agg(F.collect_list(F.struct("a", "b")).alias("_links"))
    ids = df.groupBy(*entry).agg(F.array_sort(F.collect_set(F.col(ID).cast("long"))).alias("_ids"))
    frames = frames.join(links, [*entry, "_at"], "left").join(ids, entry)
    groups = frames.withColumn("_groups", grouped(F.col("_ids"), F.col("_links"))).select(*entry, FRAME, "_run", F.explode("_groups").alias("members"))
    same = Window.partitionBy(*entry, "_run", "members").orderBy(FRAME)
    groups = groups.withColumn("_new", F.coalesce((F.col(FRAME) - F.lag(FRAME).over(same) != 1).cast("int"), F.lit(1))).withColumn("_part", F.sum("_new").over(same))
    part = Window.partitionBy(*entry, "_run", "members", "_part")
    groups = groups.withColumns({"_first": F.min(FRAME).over(part), "_lasts": F.max(FRAME).over(part) - F.min(FRAME).over(part) >= least_event})
    # Events are numbered by the start of the run, then members, then their own start; what doesn't last comes after.
    order = Window.partitionBy(*entry).orderBy(F.desc("_lasts"), "_run", "members", "_first")
    groups = groups.withColumn("event", F.when(F.col("_lasts"), F.dense_rank().over(order) - 1).otherwise(-1))
    return groups.select(*entry, FRAME, F.explode("members").alias(ID), F.array_min("members").alias("group_membership"), F.size("members").alias("group_size"), "event")


def centroid_frame(df: DataFrame, group: str | None = "event", speed: str | None = None, heading: str | None = None) -> DataFrame:
    """Adds each row's place relative to its group's centroid in its frame: distance_from_centroid, xrot_to_centroid and
    yrot_to_centroid (ahead and to the left in the direction of the group's circular mean of `heading`, unturned without
    one), and with `speed` dev_speed_to_mean, the difference from the group's mean speed."""
    keys = [c for c in (*ENTRY, *([group] if group else []), FRAME) if c in df.columns]
    frame = Window.partitionBy(*keys)
    df = scrubbed(df, [X, Y])
    dx, dy = (F.col(c) - F.avg(c).over(frame) for c in (X, Y))
    turned = heading is not None and heading in df.columns
    mean = F.atan2(F.avg(F.sin(heading)).over(frame), F.avg(F.cos(heading)).over(frame)) if turned else F.lit(0.0)
    df = df.withColumns({"_dx": dx, "_dy": dy, "_h": mean})
    out = {"distance_from_centroid": F.hypot("_dx", "_dy"), "xrot_to_centroid": forward(F.col("_dx"), F.col("_dy"), F.col("_h")), "yrot_to_centroid": leftward(F.col("_dx"), F.col("_dy"), F.col("_h"))}
    if speed:
        out["dev_speed_to_mean"] = F.col(speed) - F.avg(speed).over(frame)
    return df.withColumns(out).drop("_dx", "_dy", "_h")


def fission_fusion_metrics(df: DataFrame, group: str | None = "event", seconds: float | None = None, frames: int | None = None) -> DataFrame:
    """Per individual and group size: the share of its frames, mean and median length of its stays, the share of
    frames in which it is the outermost member (ties to 1e-9 count as equal), and that share weighted by size.

    With `seconds` or `frames` the same for each chunk of that length, with its number (chunk_id) and its first and last
    frame; a stay ends where a chunk does.
    """
    chunked = seconds is not None or frames is not None
    if chunked:
        df = chunks(df, seconds, frames, "chunk_id")
    entry = [c for c in (*ENTRY, *(["chunk_id"] if chunked else [])) if c in df.columns]
    keys = [*entry, *([group] if group and group in df.columns else []), FRAME]
    frame = Window.partitionBy(*keys)
    if "group_size" not in df.columns:
        df = df.withColumn("group_size", F.count("*").over(frame))
    df = centroid_frame(df, group)
    rank = F.count("distance_from_centroid").over(frame.orderBy(F.round("distance_from_centroid", 9)).rangeBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_outer", F.col("distance_from_centroid").isNotNull() & (rank == F.col("group_size")))
    w = rows_of(df.columns, [ID, "chunk_id"])
    df = df.withColumn("_new", F.coalesce((F.col("group_size") != F.lag("group_size").over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_stay", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stays = df.groupBy(*entry, ID, "group_size", "_stay").agg((F.max(FRAME) - F.min(FRAME) + 1).alias("_length"), F.count("*").alias("_rows"), F.count(F.when(F.col("_outer"), 1)).alias("_outer"), F.min(FRAME).alias("_from"), F.max(FRAME).alias("_to"))
    out = stays.groupBy(*entry, ID, "group_size").agg(F.sum("_rows").alias("_rows"), F.avg("_length").alias("avg_duration_frame"), F.median("_length").alias("med_duration_frame"), F.sum("_outer").alias("_outer"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    share = F.col("_rows") / F.sum("_rows").over(Window.partitionBy(*entry, ID))
    outer = F.col("_outer") / F.col("_rows")
    chunk = Window.partitionBy(*entry)
    ends = [F.min("_from").over(chunk).alias("chunk_start_frame"), F.max("_to").over(chunk).alias("chunk_end_frame")] if chunked else []
    return out.select(*entry, *ends, ID, "group_size", share.alias("fractime_norm2"), "avg_duration_frame", "med_duration_frame", outer.alias("ftime_periphery"), (outer * F.col("group_size")).alias("ftime_periphery_norm"))
