"""Summaries per individual, binned responses, and columns that come from dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ENTRY, FRAME, ID, ensure_columns
from ..functions.numbers import ratio, scrubbed, steady_sum
from ..windows import difference, rows_of

# Columns and prefixes that hold lengths. A column may name a point behind a #, as in X#head.
LENGTHS = ("X", "Y", "SPEED", "VX", "VY", "AX", "AY", "speed", "vx", "vy")
LENGTH_PREFIXES = ("poseX", "poseY", "bbox_", "midline_")


def _spread(c: str) -> tuple[Column, Column]:
    iqr = F.percentile(c, 0.75) - F.percentile(c, 0.25)
    return ratio(F.stddev_pop(c), F.avg(c)), ratio(iqr, F.median(c))


def social_motion_summary(df: DataFrame, fps: float = 30.0, speed: str = "speed", least_group: int = 2, burst_coast: bool = False) -> DataFrame:
    """One row per individual: alignment with and position of the nearest neighbour, speed relative to it and to its
    group, dispersion of speed, magnitude of acceleration and jerk, and optionally burst-and-coast gait.

    Social measures use rows with a neighbour in groups of `least_group` or more.
    """
    df = scrubbed(df)
    entry = [c for c in ENTRY if c in df.columns]
    w = rows_of(df.columns)
    social = F.col("nn_id").isNotNull()
    if "group_size" in df.columns:
        social = social & (F.col("group_size") >= least_group)
    own = df.select(*entry, FRAME, F.col(ID).cast("long").alias("_nn"), F.col(speed).alias("_nn_speed"))
    df = df.withColumn("_nn", F.col("nn_id").cast("long")).join(own, [*entry, FRAME, "_nn"], "left")
    if "group_membership" in df.columns:
        df = df.withColumn("_group_speed", F.avg(speed).over(Window.partitionBy(*entry, FRAME, "group_membership")))
    dt = difference(F.col(FRAME), w) / F.lit(float(fps))
    df = df.withColumn("_accel", F.when(dt > 0, difference(F.col(speed), w) / dt))
    df = df.withColumn("_jerk", F.when((dt > 0) & F.lag(FRAME, 2).over(w).isNotNull(), difference(F.col("_accel"), w) / dt))
    df = df.withColumns({"_absa": F.abs("_accel"), "_absj": F.abs("_jerk"), "_pos": F.when(F.lag(FRAME).over(w).isNotNull(), F.coalesce(F.col("_accel") > 0, F.lit(False)))})
    df = df.withColumn("_kick", F.col("_pos") & (F.lead("_pos").over(w) == False))  # noqa: E712
    x, y = F.col("nn_delta_x_ego"), F.col("nn_delta_y_ego")
    length = F.hypot(x, y)
    s = lambda c: F.when(social, c)
    aggs = {
        "nn_align": F.avg(s(F.cos("nn_delta_angle"))),
        "frac_nn_ahead": F.avg(s(F.coalesce((x > 0).cast("double"), F.lit(0.0)))),
        "nn_bearing_x": F.avg(s(ratio(x, length))),
        "nn_bearing_y": F.avg(s(ratio(y, length))),
        "speed_match_nn": F.avg(s(F.abs(F.col(speed) - F.col("_nn_speed")))),
    }
    if "group_membership" in df.columns:
        aggs["speed_match_group"] = F.avg(s(F.abs(F.col(speed) - F.col("_group_speed"))))
    aggs["speed_cv"], aggs["speed_rcv"] = _spread(speed)
    for name, c in (("accel", "_absa"), ("jerk", "_absj")):
        aggs[f"{name}_mean"], aggs[f"{name}_med"] = F.avg(c), F.median(c)
        aggs[f"{name}_cv"], aggs[f"{name}_rcv"] = _spread(c)
    if burst_coast:
        seconds = (F.max(FRAME) - F.min(FRAME)) / F.lit(float(fps))
        aggs["kick_rate"] = F.when(F.count("_accel") > 0, ratio(F.count(F.when(F.col("_kick"), 1)), seconds))
        aggs["burst_coast_ratio"] = F.when(F.count("_accel") > 0, F.avg(F.col("_pos").cast("double")))
    return df.groupBy(*entry, ID).agg(*[v.alias(k) for k, v in aggs.items()])


def quantile_category(df: DataFrame, source: str, output: str, quantile: float = 0.75, above: bool = True, accuracy: int | None = None) -> DataFrame:
    """Adds `output`: whether a row's `source` is above (or not above) its entry's quantile; false where it is missing.

    The quantile is exact, interpolated between values. With `accuracy` it is that of a mergeable sketch, whose size does
    not grow with the entry: a value whose rank is off by 1 / accuracy of the rows at most.
    """
    entry = [c for c in ENTRY if c in df.columns]
    known = F.col(source).cast("double")
    known = F.when(~F.isnan(known), known)
    edge = F.percentile(known, F.lit(quantile)) if accuracy is None else F.percentile_approx(known, quantile, accuracy)
    edges = df.groupBy(*entry).agg(edge.alias("_edge"))
    side = known > F.col("_edge") if above else known <= F.col("_edge")
    return df.join(edges, entry).withColumn(output, F.coalesce(side, F.lit(False))).drop("_edge")


def _bin(v: Column, low: float, width: float, bins: int, closed: bool) -> Column:
    """Number of the bin, null outside; `closed` puts the right edge into the last bin."""
    i = F.floor((v - low) / width).cast("int")
    i = F.when(closed & (v == low + width * bins), bins - 1).otherwise(i)
    return F.when((i >= 0) & (i < bins), i)


def nn_delta_bins(df: DataFrame, bins: int = 45, most: float = 14.0, most_for_mean: float = 5.0, antisymmetric: bool = True, focal: str | None = None, neighbor: str | None = None, group_size: str | None = None) -> DataFrame:
    """Mean turn and change of speed by the neighbour's position: 1-D means and 2-D sums and counts, with a row for
    every bin, for all rows and, with `neighbor`, for each category of neighbour.

    Edges lie between -most and most (`bins` of them in x, one more in y). Turns bin over y for neighbours less than
    `most_for_mean` ahead, mirrored with the opposite sign if `antisymmetric`; speed bins over x for neighbours up to
    half as far aside. 1-D bins leave out the right edge, 2-D bins include it; 2-D speed is always mirrored.
    """
    df = scrubbed(df, ["neighbor_x", "neighbor_y", "dangle", "dspeed"]).where("neighbor_x is not null and neighbor_y is not null and dangle is not null and dspeed is not null")
    entry = [c for c in ENTRY if c in df.columns]
    names = {"center_category": focal, "neighbor_category": neighbor, "group_size": group_size}
    text = {k: F.col(c).cast("string") if c else F.lit("all") for k, c in names.items()}
    base = df.select(*entry, *[text[k].alias(k) for k in names], F.col("neighbor_x").alias("x"), F.col("neighbor_y").alias("y"), "dangle", "dspeed")
    if neighbor:
        base = base.unionByName(base.withColumn("neighbor_category", F.lit("all")))
    width, width_y = 2 * most / (bins - 1), 2 * most / bins
    x, y, turn, speed = (F.col(c) for c in ("x", "y", "dangle", "dspeed"))
    line = lambda v: _bin(v, -most, width, bins - 1, F.lit(False))
    ahead, beside = (x >= 0) & (x <= most_for_mean), F.abs(y) <= most_for_mean / 2

    def one(metric: str, inside: Column, at: Column, value: Column) -> Column:
        return F.struct(F.lit("1d").alias("dim"), F.lit(metric).alias("metric"), F.when(inside, line(at)).alias("i"), F.lit(-1).alias("j"), value.alias("v"))

    def two(metric: str, across: Column, value: Column) -> Column:
        return F.struct(F.lit("2d").alias("dim"), F.lit(metric).alias("metric"), _bin(x, -most, width, bins - 1, F.lit(True)).alias("i"), _bin(across, -most, width_y, bins, F.lit(True)).alias("j"), value.alias("v"))

    # Everything that a row adds to, in one array, so one aggregation covers all bins; the last item keeps the group.
    adds = [one("turn", ahead, y, turn), one("speed", beside, x, speed), two("turn", y, turn), two("speed", y, speed), two("speed", -y, speed)]
    adds += [one("turn", ahead, -y, -turn), two("turn", -y, -turn)] if antisymmetric else []
    adds.append(F.struct(F.lit("").alias("dim"), F.lit("").alias("metric"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("v")))
    keep = [*entry, *names]
    each = base.select(*keep, F.explode(F.array(*adds)).alias("a")).select(*keep, "a.*").where("i is not null and j is not null")
    sums = each.groupBy(*keep, "dim", "metric", "i", "j").agg(steady_sum(F.col("v")).alias("s"), F.count("*").alias("n"))
    # The empty bins join the sums of their group in one row and are summed with them, without a further exchange.
    empty = lambda dim, metric, i, j: F.struct(F.lit(dim).alias("dim"), F.lit(metric).alias("metric"), i.alias("i"), j.alias("j"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    to = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    line_of = lambda metric: F.transform(to(bins - 1), lambda i: empty("1d", metric, i, F.lit(-1)))
    square_of = lambda metric: F.flatten(F.transform(to(bins - 1), lambda i: F.transform(to(bins), lambda j: empty("2d", metric, i, j))))
    grid = [f(metric) for f in (line_of, square_of) for metric in ("turn", "speed")]
    listed = sums.groupBy(*keep).agg(F.collect_list(F.struct("dim", "metric", "i", "j", "s", "n")).alias("a"))
    full = listed.select(*keep, F.explode(F.concat("a", *grid)).alias("a")).select(*keep, "a.*").where("dim <> ''")
    out = full.groupBy(*keep, "dim", "metric", "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    flat = F.col("dim") == "1d"
    return out.select(*keep, "dim", "metric", F.when(flat, F.col("i")).alias("bin_idx"), F.when(flat, ratio(F.col("s"), F.col("n"))).alias("value"), F.when(~flat, F.col("i")).alias("bin_x"), F.when(~flat, F.col("j")).alias("bin_y"), F.when(~flat, F.col("s")).alias("sum_value"), F.when(~flat, F.col("n")).alias("count"))


def scale_to_cm(df: DataFrame, calibration: DataFrame, suffix: str = "_cm", columns: list[str] | None = None) -> DataFrame:
    """Adds each length column, or each of `columns`, in centimetres. `calibration(group, sequence, cm_per_pixel)`; an
    entry whose scale is missing or isn't positive fails, as do names that the table lacks and a table without lengths."""
    ensure_columns(df, columns or [])
    lengths = columns or [c for c in df.columns if c.split("#")[0] in LENGTHS or c.startswith(LENGTH_PREFIXES)]
    if not lengths:
        raise ValueError("the table has no column that holds a length")
    entry = [c for c in ENTRY if c in df.columns]
    joined = df.join(calibration.select(*entry, F.col("cm_per_pixel").cast("double").alias("cm_per_pixel")), entry, "left")
    scale = F.when(F.col("cm_per_pixel") > 0, F.col("cm_per_pixel")).otherwise(F.raise_error(F.lit("an entry has no usable cm_per_pixel")).cast("double"))
    return joined.withColumns({f"{c}{suffix}": F.col(f"`{c}`") * scale for c in lengths}).drop("cm_per_pixel")


def id_tag_columns(df: DataFrame, tags: DataFrame, fields: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Adds tag fields of each individual; null where it has none. `tags(group, sequence, id, fields...)`."""
    entry = [c for c in ENTRY if c in df.columns]
    renames = renames or {}
    return df.join(tags.select(*entry, ID, *[F.col(f).alias(renames.get(f, f)) for f in fields]), [*entry, ID], "left")


def aligned_labels(frames: DataFrame, events: DataFrame, default: int = 0, symmetric: bool = False) -> DataFrame:
    """Adds the label of each frame; of several events the last (by `event`) wins. With `symmetric` only events with
    id1 <= id2 count."""
    entry = [c for c in ENTRY if c in frames.columns]
    events = events.where("id1 <= id2") if symmetric else events
    last = events.groupBy(*entry, FRAME).agg(F.max_by("label", "event").alias("label"))
    return frames.join(last, [*entry, FRAME], "left").withColumn("label", F.coalesce("label", F.lit(default)))


def dense_labels(events: DataFrame, lengths: DataFrame, default: int = 0) -> DataFrame:
    """A label for every frame from 0 to n_frames - 1 of each entry of `lengths(group, sequence, n_frames)`."""
    frames = lengths.select(*ENTRY, F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias(FRAME))
    return aligned_labels(frames, events, default)


def exclude_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns that exist is true; null is not true."""
    for c in columns:
        if c in df.columns:
            df = df.where(~F.coalesce(F.col(c).cast("boolean"), F.lit(False)))
    return df


def uniform_rows(df: DataFrame, target: int) -> DataFrame:
    """Every k-th row of a sequence, `target` of them at most; small sequences come back whole."""
    entry = [c for c in ENTRY if c in df.columns]
    w = Window.partitionBy(*entry)
    df = df.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(FRAME, *([ID] if ID in df.columns else []))) - 1})
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return df.where((F.col("_n") <= target) | ((F.col("_r") % stride == 0) & (F.floor(F.col("_r") / stride) < target))).drop("_n", "_r")


def labels_of(events: DataFrame, individual: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events in which an individual takes part, from `start` to `end`, both included."""
    out = events.where((F.col("id1") == individual) | (F.col("id2") == individual))
    out = out.where(F.col(FRAME) >= start) if start is not None else out
    return out.where(F.col(FRAME) <= end) if end is not None else out


def labels_at(events: DataFrame, frame: int) -> DataFrame:
    return events.where(F.col(FRAME) == frame)


def last_labels(df: DataFrame, label: str, order: str | None = None) -> DataFrame:
    """(group, sequence, id1, id2, frame, label): one label for each frame of an individual (id2 null), of a pair (smaller
    id first) and of the whole sequence (both null), the last by `order` where a frame has several."""
    entry = [c for c in ENTRY if c in df.columns]
    a, b = ((F.col(c).cast("long") if c in df.columns else F.lit(None).cast("long")) for c in ("id1", "id2"))
    if "id1" not in df.columns and ID in df.columns:
        a = F.col(ID).cast("long")
    low, high = F.when(b.isNotNull(), F.least(a, b)).otherwise(a), F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
    rows = df.select(*entry, low.alias("id1"), high.alias("id2"), FRAME, F.col(label).alias("label"), F.col(order or label).alias("_order"))
    return rows.where("label is not null").groupBy(*entry, "id1", "id2", FRAME).agg(F.max_by("label", "_order").alias("label"))
