"""Nearest neighbours and local order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ANGLE, ENTRY, FRAME, ID, TIME, X, Y
from ..functions.numbers import cross, forward, leftward, ratio, scrubbed, wrap_angle
from ..windows import difference, rows_of
from . import grid


def nearest_neighbor(df: DataFrame) -> DataFrame:
    """For each row the nearest other individual of its frame, ties to the smaller id, with offsets in world and own
    frame. Rows without finite position have no neighbour and are none; without ANGLE offsets aren't rotated.

    In frames of many rows, a row looks no further than the nearer of its two neighbours along a space-filling curve, and
    so meets the rows of nine cells of about that width (see `grid`).
    """
    df = scrubbed(df, [X, Y, ANGLE])
    turned = ANGLE in df.columns
    keys = [c for c in (*ENTRY, FRAME) if c in df.columns]
    carried = [c for c in (TIME, ANGLE) if c in df.columns]
    frame = Window.partitionBy(*keys)
    placed = grid.placed(df.select(*keys, ID, X, Y, *carried), keys, X, Y)
    # Rows that repeat an id are one individual, so a neighbour on the curve may be the row's own; it bounds nothing then.
    curve = frame.orderBy(*[F.when(F.col("_many"), c) for c in (grid.z_order(), F.col(X), F.col(Y))], ID)
    away = lambda f: F.when(f(ID, 1).over(curve) != F.col(ID), F.hypot(f(X, 1).over(curve) - F.col(X), f(Y, 1).over(curve) - F.col(Y)))
    reach = F.coalesce(F.least(away(F.lag), away(F.lead)), F.col("_extent") * 2)
    # Of rows at one spot no one needs more than two individuals: the smallest id, or the next if that is its own.
    before = [F.struct(*[F.lag(c, n).over(curve).alias(c) for c in (ID, X, Y)]) for n in (1, 2)]
    at_spot = (before[0][X] == F.col(X)) & (before[1][X] == F.col(X)) & (before[0][Y] == F.col(Y)) & (before[1][Y] == F.col(Y))
    spare = F.col("_many") & at_spot & (before[0][ID] != F.col(ID)) & (before[1][ID] != before[0][ID])
    placed = placed.withColumns({"_reach": F.when(F.col("_many"), reach), "_spare": F.coalesce(spare, F.lit(False))}).withColumn("_level", grid.level(F.col("_reach")))
    placed = placed.withColumn("_levels", F.collect_set(F.when(F.col("_ix").isNotNull(), F.col("_level"))).over(frame))
    theirs = grid.seen(placed.where(~F.col("_spare")), F.col("_levels")).select(*keys, *grid.CELL, F.col(ID).alias("nn"), F.col(X).alias("_x"), F.col(Y).alias("_y"), *([F.col(ANGLE).alias("nn_angle")] if turned else [])).alias("b")
    a = grid.looking(placed).select(*keys, ID, X, Y, *carried, *grid.CELL).alias("a")
    others = F.col(f"a.{ID}") != F.col("b.nn")
    for k in (*keys, *grid.CELL):
        others = others & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    both = a.join(theirs, others, "left").select(*[F.col(f"a.{c}").alias(c) for c in (*keys, ID, X, Y, *carried)], "nn", "_x", "_y", *(["b.nn_angle"] if turned else []))
    dx, dy = F.col("_x") - F.col(X), F.col("_y") - F.col(Y)
    best = F.min(F.when(F.col("nn").isNotNull(), F.struct((dx * dx + dy * dy).alias("d2"), "nn", dx.alias("dx"), dy.alias("dy"), *(["nn_angle"] if turned else []))))
    df = both.groupBy(*keys, ID).agg(*[F.first(c).alias(c) for c in carried], best.alias("_nn"))
    dx, dy, theta = F.col("_nn.dx"), F.col("_nn.dy"), F.col(ANGLE) if turned else F.lit(0.0)
    out = {"nn_id": F.col("_nn.nn").cast("double"), "nn_delta_x": dx, "nn_delta_y": dy, "nn_dist": F.sqrt("_nn.d2"), "nn_delta_x_ego": forward(dx, dy, theta), "nn_delta_y_ego": leftward(dx, dy, theta)}
    if turned:
        out["nn_delta_angle"] = wrap_angle(F.col("_nn.nn_angle") - F.col(ANGLE))
    out["nn_ego_unrotated"] = F.lit(not turned)
    return df.withColumns(out).drop("_nn", ANGLE)


def unit_headings(df: DataFrame, source: str = "auto") -> DataFrame:
    """Adds ux, uy and heading_source: from ANGLE where the sequence has one, else from the last step."""
    w = rows_of(df.columns)
    dx, dy = difference(F.col(X), w), difference(F.col(Y), w)
    length = F.hypot(dx, dy)
    vx, vy = ratio(dx, length), ratio(dy, length)
    if ANGLE not in df.columns or source == "velocity":
        return df.withColumns({"ux": vx, "uy": vy, "heading_source": F.lit("velocity")})
    if source == "angle":
        return df.withColumns({"ux": F.cos(ANGLE), "uy": F.sin(ANGLE), "heading_source": F.lit("angle")})
    has = F.max(F.col(ANGLE).isNotNull()).over(Window.partitionBy(*[c for c in ENTRY if c in df.columns]))
    pick = lambda a, b: F.when(has, a).otherwise(b)
    return df.withColumns({"ux": pick(F.cos(ANGLE), vx), "uy": pick(F.sin(ANGLE), vy), "heading_source": pick(F.lit("angle"), F.lit("velocity"))})


def local_order(df: DataFrame, radius: float, heading_source: str = "auto", shells: int = 6, peripheral: int = 5, least: int = 1, subgroup: str | None = None, scale: DataFrame | None = None) -> DataFrame:
    """Order around each individual: who is within the radius, how aligned they are, how they turn about the group's
    centre, and the same by shell of distance from that centre.

    The disc is closed and holds the individual itself. Rows without finite position have counts of -1 and no values;
    with `subgroup`, only members of the same subgroup count, and negative subgroups have none. With `scale`, rows of body
    scale, the radius is in means of the sequence's scale; a sequence without one fails.
    """
    df = unit_headings(scrubbed(df, [X, Y, ANGLE]), heading_source)
    keys = [c for c in (*ENTRY, FRAME, *([subgroup] if subgroup else [])) if c in df.columns]
    ok = F.col(X).isNotNull() & F.col(Y).isNotNull() & (F.col(subgroup) >= 0 if subgroup else F.lit(True))
    frame = Window.partitionBy(*keys)
    df = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    df = df.withColumns({"_rx": F.when(F.col("_ok"), F.col(X) - F.avg(F.when(F.col("_ok"), F.col(X))).over(frame)), "_ry": F.when(F.col("_ok"), F.col(Y) - F.avg(F.when(F.col("_ok"), F.col(Y))).over(frame))})
    df = df.withColumn("dist_to_center", F.hypot("_rx", "_ry"))
    # At the centre no direction is radial.
    df = df.withColumn("radial_rotation", cross(ratio(F.col("_rx"), F.col("dist_to_center")), ratio(F.col("_ry"), F.col("dist_to_center")), F.col("ux"), F.col("uy")))
    df = df.withColumn("_far", F.row_number().over(frame.orderBy(F.desc_nulls_last("dist_to_center"), ID)))
    df = df.withColumn("outer_radius", F.when(F.col("_ok"), F.median(F.when(F.col("_far") <= peripheral, F.col("dist_to_center"))).over(frame)))
    shell = F.greatest(F.lit(0), F.least(F.lit(shells - 1), F.floor(F.try_divide(F.col("dist_to_center"), F.col("outer_radius") / shells)).cast("int")))
    df = df.withColumn("shell_index", F.when(F.col("outer_radius") > 0, shell).otherwise(-1))
    in_shell = Window.partitionBy(*keys, "shell_index")
    df = df.withColumns({"shell_n": F.when(F.col("shell_index") >= 0, F.count("*").over(in_shell)).otherwise(-1), "shell_rotation": F.when(F.col("shell_index") >= 0, F.avg("radial_rotation").over(in_shell))})

    df = df.withColumn("local_radius", F.lit(float(radius)))
    if scale is not None:
        entry = [c for c in ENTRY if c in df.columns]
        means = scale.groupBy(*entry).agg(F.avg("body_scale").alias("_scale"))
        size = F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(F.raise_error(F.lit("a sequence has no body scale")).cast("double"))
        df = df.join(means, entry, "left").withColumn("local_radius", F.col("local_radius") * size)
    df = grid.placed(df.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in (X, Y)}), keys, X, Y).withColumn("_level", grid.level(F.col("local_radius")))
    own = [c for c in (TIME, "local_radius", "heading_source", "dist_to_center", "radial_rotation", "outer_radius", "shell_index", "shell_n", "shell_rotation") if c in df.columns]
    a = grid.looking(df).select(*keys, ID, "_ok", F.col(X).alias("x_A"), F.col(Y).alias("y_A"), *own, *grid.CELL).alias("a")
    b = grid.seen(df, F.array("_level")).select(*keys, *grid.CELL, F.col(ID).alias("id_B"), F.col(X).alias("x_B"), F.col(Y).alias("y_B"), F.col("ux").alias("ux_B"), F.col("uy").alias("uy_B"), F.col("radial_rotation").alias("rr_B")).alias("b")
    dx, dy = F.col("x_B") - F.col("x_A"), F.col("y_B") - F.col("y_A")
    same = F.col("a._ok") & (dx * dx + dy * dy <= F.col("a.local_radius") * F.col("a.local_radius"))
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    for k in grid.CELL:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    disc = a.join(b, same, "left").select(*[F.col(f"a.{c}").alias(c) for c in (*keys, ID, *own)], "id_B", "ux_B", "uy_B", "rr_B")
    aimed = F.col("ux_B").isNotNull() & F.col("uy_B").isNotNull()
    out = disc.groupBy(*keys, ID).agg(
        *[F.first(c).alias(c) for c in own],
        (F.count("id_B") - 1).alias("n_local_neighbors"),
        F.when(F.count("id_B") > 0, F.count(F.when(aimed & (F.col(ID) != F.col("id_B")), 1))).otherwise(-1).alias("n_local_headings"),
        F.avg(F.when(aimed, F.col("ux_B"))).alias("local_heading_x"),
        F.avg(F.when(aimed, F.col("uy_B"))).alias("local_heading_y"),
        F.avg("rr_B").alias("local_rotation"),
    )
    thick = F.col("n_local_headings") >= least
    out = out.withColumns({c: F.when(thick, F.col(c)) for c in ("local_heading_x", "local_heading_y", "local_rotation")})
    return out.withColumn("local_polarization", F.hypot("local_heading_x", "local_heading_y"))
