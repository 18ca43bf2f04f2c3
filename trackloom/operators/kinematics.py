"""Motion of single individuals: speed, heading, smoothing, responses over a lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ANGLE, ENTRY, FRAME, ID, TIME, X, Y, order_column, pose_pairs
from ..functions.numbers import forward, leftward, ratio, scrubbed, wrap_angle
from ..windows import between, difference, interpolated, over, rows_of, with_nearest_known


def time_step(columns: list[str], w, n: int = 1, fps: float | None = None) -> Column:
    """Seconds to the row n before: frames over fps if fps is given, else the time column, else n. Zero is null."""
    if fps and FRAME in columns:
        dt = difference(F.col(FRAME), w, n) / F.lit(float(fps))
    elif TIME in columns:
        dt = difference(F.col(TIME), w, n)
    else:
        dt = F.when(F.lag(F.lit(1), n).over(w).isNotNull(), F.lit(float(n)))
    return F.when(dt != 0, dt)


def speed_angvel(df: DataFrame, step: int = 1, fps: float | None = None, smooth_window: int | None = None, polyorder: int = 2) -> DataFrame:
    """Adds speed, vx, vy and angvel to the keys of each row, with step > 1 also speed_step and angvel_step, and with
    `smooth_window` also speed_smooth, the speed after a Savitzky-Golay filter over that many rows (see
    `kernels.smooth_columns`)."""
    w = rows_of(df.columns)
    out = [c for c in (*ENTRY, ID, FRAME, TIME) if c in df.columns]
    for n, suffix in ((1, ""), (step, "_step")):
        if suffix and step == 1:
            continue
        dt = time_step(df.columns, w, n, fps)
        dx, dy = difference(F.col(X), w, n), difference(F.col(Y), w, n)
        new = {f"speed{suffix}": ratio(F.hypot(dx, dy), dt)}
        if not suffix:
            new |= {"vx": ratio(dx, dt), "vy": ratio(dy, dt)}
        if ANGLE in df.columns:
            new[f"angvel{suffix}"] = ratio(wrap_angle(difference(F.col(ANGLE), w, n)), dt)
        df = df.withColumns(new)
        out += new
    df = df.select(*out)
    if smooth_window:
        from ..functions.kernels import smooth_columns

        df = smooth_columns(df.withColumn("speed_smooth", F.col("speed")), ["speed_smooth"], smooth_window, polyorder)
    return df


def heading(df: DataFrame, method: str = "two_point", front: int = 0, rear: int = 1, output: str = ANGLE) -> DataFrame:
    """Adds a heading from keypoints: the direction from `rear` to `front`, or the principal axis of all points,
    turned so that it points to `front`. Indices count the pose pairs in lexical order."""
    points = pose_pairs(df.columns)
    (fx, fy), (rx, ry) = points[front], points[rear]
    dx, dy = F.col(fx) - F.col(rx), F.col(fy) - F.col(ry)
    if method == "two_point":
        return df.withColumn(output, F.when((dx != 0) | (dy != 0), F.atan2(dy, dx)))
    finite = F.filter(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in points]), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    df = df.withColumn("_p", finite).withColumn("_n", F.size("_p"))
    mean = lambda f: ratio(F.aggregate("_p", F.lit(0.0), lambda a, p: a + f(p)), F.col("_n"))
    df = df.withColumns({"_mx": mean(lambda p: p["x"]), "_my": mean(lambda p: p["y"])})
    cov = lambda a, b: mean(lambda p: (p[a] - F.col(f"_m{a}")) * (p[b] - F.col(f"_m{b}")))
    axis = 0.5 * F.atan2(2 * cov("x", "y"), cov("x", "x") - cov("y", "y"))
    df = df.withColumn("_axis", F.when(F.col("_n") >= 2, axis))
    flip = (F.col(fx) - F.col("_mx")) * F.cos("_axis") + (F.col(fy) - F.col("_my")) * F.sin("_axis") < 0
    return df.withColumn(output, F.when(F.coalesce(flip, F.lit(False)), wrap_angle(F.col("_axis") + 3.141592653589793)).otherwise(F.col("_axis"))).drop("_p", "_n", "_mx", "_my", "_axis")


def bad_frames(df: DataFrame, threshold: float, fps: float | None = None, expand: int = 2) -> DataFrame:
    """Adds bad_frame: steps longer than the threshold (per second if fps is given), spread over neighbouring rows."""
    w = rows_of(df.columns)
    step = F.hypot(difference(F.col(X), w), difference(F.col(Y), w))
    jump = F.coalesce((step > threshold / (fps or 1.0)).cast("int"), F.lit(0))
    return df.withColumn("_jump", jump).withColumn("bad_frame", F.max("_jump").over(w.rowsBetween(-expand, expand)) == 1).drop("_jump")


def trajectory_smooth(df: DataFrame, threshold: float, fps: float | None = None, expand: int = 2, pose: bool = False, savgol_window: int = 0, polyorder: int = 2) -> DataFrame:
    """Replaces positions of bad frames by linear interpolation; optionally smooths by Savitzky-Golay."""
    df = bad_frames(df, threshold, fps, expand)
    columns = [X, Y] + ([c for pair in pose_pairs(df.columns) for c in pair] if pose else [])
    df = df.withColumns({c: F.when(~F.col("bad_frame"), F.col(c)) for c in columns})
    df = interpolated(df, columns)
    if savgol_window:
        from ..functions.kernels import smooth_columns

        df = smooth_columns(df, columns, savgol_window, polyorder)
    return df


def nn_delta_response(df: DataFrame, lag: int = 4, fps: float = 30.0, speed: str = "speed", backward: bool = False, lag_column: str | None = None, wrap: bool = True, per_frame: bool = True, per_second: bool = True, tags: list[str] | None = None) -> DataFrame:
    """Change of position, angle and speed over the next `lag` frames, with the neighbour's position in the own frame.

    A row stays if the row `lag` rows on is `lag` frames on. `lag_column` gives each row its own lag; values that are
    null or below 1 mean `lag`. Each of `tags` also comes as neighbor_<tag>, that of the nearest neighbour in the frame.
    """
    if tags:
        at = [c for c in (*ENTRY, FRAME) if c in df.columns]
        theirs = df.select(*at, F.col(ID).cast("long").alias("_who"), *[F.col(t).alias(f"neighbor_{t}") for t in tags])
        df = df.withColumn("_who", F.col("nn_id").cast("long")).join(theirs, [*at, "_who"], "left")
    w = rows_of(df.columns)
    carried = [X, Y, ANGLE, speed]
    if lag_column is None:
        moves = [("", 1)] + ([("_back", -1)] if backward else [])
        for suffix, sign in moves:
            at = {c: F.lead(F.col(c), sign * lag).over(w) for c in (FRAME, *carried)}
            df = df.withColumns({f"_{c}{suffix}": v for c, v in at.items()})
        df = df.withColumn("_lag", F.lit(lag)).where(F.col(f"_{FRAME}") - F.col(FRAME) == lag)
    else:
        own = F.rint(F.col(lag_column)).cast("int")
        df = df.withColumn("_lag", F.when(own >= 1, own).otherwise(lag)).withColumn("_row", F.row_number().over(w))
        keys = [c for c in (*ENTRY, ID) if c in df.columns]
        later = df.select(*keys, F.col("_row").alias("_to"), *[F.col(c).alias(f"_{c}") for c in (FRAME, *carried)])
        df = df.withColumn("_to", F.col("_row") + F.col("_lag")).join(later, [*keys, "_to"]).where(F.col(f"_{FRAME}") - F.col(FRAME) == F.col("_lag"))
    turn = F.col(f"_{ANGLE}") - F.col(ANGLE)
    turn = wrap_angle(turn) if wrap else turn
    turn = turn / F.col("_lag") if per_frame else turn
    out = {"dx": F.col(f"_{X}") - F.col(X), "dy": F.col(f"_{Y}") - F.col(Y), "dt": F.col("_lag") / F.lit(float(fps)), "dangle": turn * F.lit(float(fps)) if per_second else turn, "dspeed": F.col(f"_{speed}") - F.col(speed)}
    if backward and lag_column is None:
        out |= {"dx_back": F.col(X) - F.col(f"_{X}_back"), "dy_back": F.col(Y) - F.col(f"_{Y}_back"), "dspeed_back": F.col(speed) - F.col(f"_{speed}_back")}
    if {"nn_delta_x_ego", "nn_delta_y_ego"} <= set(df.columns):
        out |= {"neighbor_x": F.col("nn_delta_x_ego"), "neighbor_y": F.col("nn_delta_y_ego")}
    elif {"nn_delta_x", "nn_delta_y"} <= set(df.columns):
        out |= {"neighbor_x": forward(F.col("nn_delta_x"), F.col("nn_delta_y"), F.col(ANGLE)), "neighbor_y": leftward(F.col("nn_delta_x"), F.col("nn_delta_y"), F.col(ANGLE))}
    df = df.withColumns(out)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def chunks(df: DataFrame, seconds: float | None = None, frames: int | None = None, output: str = "chunk") -> DataFrame:
    """Adds the number of the tumbling chunk of seconds or frames since the sequence's first row."""
    c, size = (TIME, seconds) if seconds else (FRAME, frames)
    start = F.min(c).over(Window.partitionBy(*[k for k in ENTRY if k in df.columns]))
    return df.withColumn(output, F.floor((F.col(c) - start) / F.lit(size)))


def time_range(df: DataFrame, start_frame=None, end_frame=None, start_time=None, end_time=None) -> DataFrame:
    """Rows in the half-open ranges; the filter reaches the scan."""
    for c, low, high in ((FRAME, start_frame, end_frame), (TIME, start_time, end_time)):
        if low is not None:
            df = df.where(F.col(c) >= low)
        if high is not None:
            df = df.where(F.col(c) < high)
    return df


def frame_range(fps: float | None, start_frame: int | None = None, end_frame: int | None = None, start_time: float | None = None, end_time: float | None = None) -> tuple[int | None, int | None]:
    """The frames that a range given in frames or seconds begins and ends at; each end has one unit, and seconds need
    the frames per second."""
    out = []
    for name, frame, time in (("start", start_frame, start_time), ("end", end_frame, end_time)):
        if frame is not None and time is not None:
            raise ValueError(f"{name}_frame and {name}_time exclude each other")
        if time is not None and fps is None:
            raise ValueError(f"{name}_time needs the frames per second")
        out.append(frame if time is None else int(time * fps))
    return out[0], out[1]


def clean_tracks(df: DataFrame, columns: list[str], limit: int = 10, edge_limit: int = 2, most_missing: float = 0.5) -> DataFrame:
    """Scrubs and fills the columns of each track: gaps linearly up to `limit` rows from either side, heads and tails
    with the nearest value up to `edge_limit` rows, then drops rows in which more than `most_missing` of the columns
    are still missing, and gives the rest the column's median over the track."""
    names = df.columns
    df = with_nearest_known(scrubbed(df, columns), columns)
    inner = lambda c: F.col(f"_l_{c}").isNotNull() & F.col(f"_r_{c}").isNotNull()
    df = df.withColumns({c: F.when(inner(c), between(c, limit)).otherwise(between(c, edge_limit)) for c in columns}).select(*names)
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    df = df.where(missing <= most_missing * len(columns))
    track = Window.partitionBy(*[c for c in (*ENTRY, ID) if c in names])
    return df.withColumns({c: F.coalesce(F.col(c), F.median(c).over(track)) for c in columns})


def confidence_filter(df: DataFrame, threshold: float = 0.6, max_gap: int | None = None) -> DataFrame:
    """Drops keypoints whose confidence (poseP*) is below the threshold and fills gaps of up to `max_gap` rows."""
    points = [(x, y, x.replace("poseX", "poseP")) for x, y in pose_pairs(df.columns) if x.replace("poseX", "poseP") in df.columns]
    df = df.withColumns({c: F.when(F.col(p) >= threshold, F.col(c)) for x, y, p in points for c in (x, y)})
    return interpolated(df, [c for x, y, _ in points for c in (x, y)], limit=max_gap, both=False)


def movement_smooth(df: DataFrame, window: int = 5, method: str = "rolling", statistic: str = "median", least: int = 1, polyorder: int = 2, centroid: bool = True, pose: bool = True) -> DataFrame:
    """Smooths X and Y (`centroid`) and the keypoints (`pose`) of each individual.

    `rolling`: a centred statistic (mean, median, min, max) of what is known among `window` frames of the sequence, those
    in which any individual has a row; null where fewer than `least` are known. `savgol`: Savitzky-Golay over the
    individual's rows.
    """
    columns = [c for c in ((X, Y) if centroid else ()) if c in df.columns] + ([c for p in pose_pairs(df.columns) for c in p] if pose else [])
    df = scrubbed(df, columns)
    if method == "savgol":
        from ..functions.kernels import smooth_columns

        return smooth_columns(df, columns, window, polyorder)
    if method != "rolling":
        raise ValueError(f"no method {method!r}")
    entry = [c for c in ENTRY if c in df.columns]
    names, half = df.columns, window // 2
    frames = F.dense_rank().over(Window.partitionBy(*entry).orderBy(order_column(names)))
    w = Window.partitionBy(*entry, *([ID] if ID in names else [])).orderBy("_frame").rangeBetween(-half, window - 1 - half)
    return df.withColumn("_frame", frames).withColumns({c: over(F.col(c), w, statistic, least) for c in columns}).select(*names)
