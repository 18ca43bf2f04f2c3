"""The operators as queries over the driver's tables, and the same rows as SQL for DuckDB.

`TRACKS` turns `events` into trajectories; its text runs in both engines. Doubles are rounded to 4 digits on both
sides, as sums depend on the order of their terms, by arithmetic that both engines do alike. `OPERATORS` has the same
results as they come.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import boxes, kernels
from .functions.numbers import heading_between
from .joins import align, nearest_pairs_only
from .ml import models, templates
from .operators import groups, interactions, kinematics, neighbours, pairs, sampling, summaries
from .plans import scope, values
from .sources import labels, readers, writers
from .windows import interpolated, rolling, rows_of, with_moving_average

FPS = 25.0
POINTS = 7

TRACKS = (
    """
select concat('g', cast(user_id % 3 as varchar(8))) as grp, cast(cast(ts as date) as varchar(10)) as seq, user_id % 8 as id,
  cast(row_number() over (partition by user_id % 3, cast(ts as date), user_id % 8 order by ts, event_id) - 1 as bigint) as frame,
  cast(event_id * event_id % 99991 * 7919 % 99991 as double) / 997.0e0 as x, cast(event_id * event_id % 99989 * event_id % 99989 as double) / 997.0e0 as y,
  cast(event_id * 31337 % 6283 as double) / 1000.0e0 - 3.1415e0 as a, event_id
from events"""
)
_POSE = ", ".join(f"x + cast(event_id * {13 + 7 * k} % 41 as double) / 10.0e0 - 2.0e0 as px{k}, y + cast(event_id * {29 + 5 * k} % 37 as double) / 10.0e0 - 1.8e0 as py{k}" for k in range(POINTS))
WITH_TRACKS = f"WITH tr AS ({TRACKS}), t AS (SELECT *, cast(frame as double) / {FPS:.1f}e0 AS tm, {_POSE} FROM tr)"
ENTRY_SQL = 'grp AS "group", seq AS "sequence"'
WIN = "PARTITION BY grp, seq, id ORDER BY frame"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a track table with seven keypoints."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    t = spark.sql(TRACKS.replace("from events", "from {events}"), events=events)
    pose = {f"pose{c}{k}": F.expr(e) for k, pair in enumerate(zip(*[iter(_POSE.split(", "))] * 2)) for c, e in zip("XY", (p.rsplit(" as ", 1)[0] for p in pair))}
    t = t.withColumns(pose).withColumn("time", F.col("frame").cast("double") / F.lit(FPS))
    return t.withColumnsRenamed({"grp": "group", "seq": "sequence", "x": "X", "y": "Y", "a": "ANGLE"})


def tidy(df: DataFrame) -> DataFrame:
    """Rounded doubles without negative zeros; floats as doubles."""
    wide = {f.name: F.floor(F.col(f.name).cast("double") * 1e4 + 0.5) / 1e4 for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(wide)


def r(e: str) -> str:
    return f"floor(CAST({e} AS DOUBLE) * 1e4 + 0.5e0) / 1e4"


def wrap(e: str) -> str:
    return f"(({e}) + pi() - floor((({e}) + pi()) / (2 * pi())) * (2 * pi()) - pi())"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, rounded: bool = True):
    """Registers a query; one without SQL may return its rows as they come, not rounded and floats as floats."""

    def add(f):
        QUERIES[f.__name__], OPERATORS[f.__name__] = (lambda spark, sf_dir: tidy(f(spark, sf_dir))) if rounded else f, f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _thin(df: DataFrame) -> DataFrame:
    return df.select("group", "sequence", "id", "frame", "time", "X", "Y", "ANGLE")


# ---- single individuals

_SPEED = f"""{WITH_TRACKS}, d AS (
  SELECT *, frame - lag(frame) OVER w AS df, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, a - lag(a) OVER w AS da,
    frame - lag(frame, 3) OVER w AS df3, x - lag(x, 3) OVER w AS dx3, y - lag(y, 3) OVER w AS dy3, a - lag(a, 3) OVER w AS da3
  FROM t WINDOW w AS ({WIN})),
s AS (SELECT *, sqrt(dx * dx + dy * dy) * {FPS} / nullif(df, 0) AS speed, dx * {FPS} / nullif(df, 0) AS vx, dy * {FPS} / nullif(df, 0) AS vy,
    {wrap('da')} * {FPS} / nullif(df, 0) AS angvel, sqrt(dx3 * dx3 + dy3 * dy3) * {FPS} / nullif(df3, 0) AS speed3, {wrap('da3')} * {FPS} / nullif(df3, 0) AS angvel3 FROM d)"""


@query(f"""{_SPEED} SELECT {ENTRY_SQL}, id, frame, {r('tm')} AS "time", {r('speed')} AS speed, {r('vx')} AS vx, {r('vy')} AS vy, {r('angvel')} AS angvel,
  {r('speed3')} AS speed_step, {r('angvel3')} AS angvel_step FROM s""")
def speed_angvel(spark, sf_dir):
    return kinematics.speed_angvel(_thin(tracks(spark, sf_dir)), step=3, fps=FPS)


@query(f"""{_SPEED} SELECT {ENTRY_SQL}, frame, {r('min(tm)')} AS "time", {r('avg(speed)')} AS speed_mean FROM s GROUP BY grp, seq, frame""")
def frame_mean_speed(spark, sf_dir):
    return groups.frame_aggregate(kinematics.speed_angvel(_thin(tracks(spark, sf_dir)), fps=FPS), "speed", "mean")


_AGGS = (("median", {}, "median(x)"), ("min", {}, "min(x)"), ("std", {}, "stddev_samp(x)"), ("sum", {"threshold": 50.0}, "sum(CASE WHEN x > 50 THEN 1e0 ELSE 0e0 END)"), ("max", {"absolute": True}, "max(abs(x))"), ("count", {"where": "X > 20 and not Y > 90"}, "count(CASE WHEN x > 20 AND NOT y > 90 THEN x END)"))


@query(f"{WITH_TRACKS} " + " UNION ALL ".join(f"""SELECT {ENTRY_SQL}, frame, '{name}' AS agg, {r(sql)} AS value FROM t GROUP BY grp, seq, frame{' HAVING count(CASE WHEN x > 20 AND NOT y > 90 THEN 1 END) > 0' if name == 'count' else ''}""" for name, _, sql in _AGGS))
def frame_aggregates(spark, sf_dir):
    t = tracks(spark, sf_dir)
    parts = [groups.frame_aggregate(t, "X", name, "value", **options).select("group", "sequence", "frame", F.lit(name).alias("agg"), F.col("value").cast("double").alias("value")) for name, options, _ in _AGGS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {r('CASE WHEN px0 <> px1 OR py0 <> py1 THEN atan2(py0 - py1, px0 - px1) END')} AS ANGLE FROM t""")
def heading_two_point(spark, sf_dir):
    return kinematics.heading(tracks(spark, sf_dir)).select("group", "sequence", "id", "frame", "ANGLE")


_MX, _MY = (f"(({' + '.join(f'p{c}{k}' for k in range(POINTS))}) / {POINTS})" for c in "xy")
_COV = {a + b: "(" + " + ".join(f"(p{a}{k} - m{a}) * (p{b}{k} - m{b})" for k in range(POINTS)) + f") / {POINTS}" for a, b in ("xx", "yy", "xy")}


@query(f"""{WITH_TRACKS}, m AS (SELECT *, {_MX} AS mx, {_MY} AS my FROM t), c AS (SELECT *, 0.5 * atan2(2 * ({_COV['xy']}), ({_COV['xx']}) - ({_COV['yy']})) AS ax FROM m)
SELECT {ENTRY_SQL}, id, frame, {r(f"CASE WHEN (px0 - mx) * cos(ax) + (py0 - my) * sin(ax) < 0 THEN {wrap('ax + pi()')} ELSE ax END")} AS ANGLE FROM c""")
def heading_pca(spark, sf_dir):
    return kinematics.heading(tracks(spark, sf_dir), "pca").select("group", "sequence", "id", "frame", "ANGLE")


_DIST = ", ".join(f"sqrt((px{i} - px{j}) ^ 2 + (py{i} - py{j}) ^ 2)" for i in range(POINTS) for j in range(i + 1, POINTS))


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, frame, id, {r('tm')} AS "time", {r(f'list_aggregate([{_DIST}], $$median$$)')} AS body_scale FROM t""")
def body_scale(spark, sf_dir):
    return pairs.body_scale(tracks(spark, sf_dir))


def _calibration(spark, sf_dir):
    return tracks(spark, sf_dir).select("group", "sequence").distinct().withColumn("cm_per_pixel", F.when(F.col("group") == "g0", 0.5).otherwise(0.25))


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {', '.join(f"""{r(f"{e} * CASE WHEN grp = 'g0' THEN 0.5e0 ELSE 0.25e0 END")} AS "{n}_cm\"""" for n, e in (('X', 'x'), ('Y', 'y'), ('X#head', 'px3'), ('poseY1', 'py1'), ('speed', 'x * a'), ('vx', 'y * a')))} FROM t""")
def scale_to_cm(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "X", "Y", "ANGLE", F.col("poseX3").alias("X#head"), "poseY1", (F.col("X") * F.col("ANGLE")).alias("speed"), (F.col("Y") * F.col("ANGLE")).alias("vx"))
    out = summaries.scale_to_cm(t, _calibration(spark, sf_dir))
    return out.select("group", "sequence", "id", "frame", *[c for c in out.columns if c.endswith("_cm")])


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, CASE WHEN id % 2 = 0 THEN concat('tag', CAST(id AS VARCHAR)) END AS label FROM t""")
def id_tag_columns(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame")
    tags = t.select("group", "sequence", "id").distinct().where("id % 2 = 0").withColumn("tag", F.concat(F.lit("tag"), F.col("id").cast("string")))
    return summaries.id_tag_columns(t, tags, ["tag"], {"tag": "label"})


@query(f"""{WITH_TRACKS}, f AS (SELECT DISTINCT grp, seq, frame FROM t), e AS (SELECT grp, seq, frame, arg_max(id, event_id) AS label FROM t WHERE y > 60 GROUP BY grp, seq, frame)
SELECT {ENTRY_SQL}, frame, coalesce(label, 0) AS label FROM f LEFT JOIN e USING (grp, seq, frame)""")
def label_alignment(spark, sf_dir):
    t = tracks(spark, sf_dir)
    events = t.where("Y > 60").select("group", "sequence", "frame", F.col("event_id").alias("event"), F.col("id").alias("label"))
    return summaries.aligned_labels(t.select("group", "sequence", "frame").distinct(), events)


@query(f"""{WITH_TRACKS}, n AS (SELECT grp, seq, max(frame) + 3 AS n FROM t GROUP BY grp, seq), g AS (SELECT grp, seq, unnest(range(0, n)) AS frame FROM n),
e AS (SELECT grp, seq, frame, arg_max(id, event_id) AS label FROM t WHERE y > 80 GROUP BY grp, seq, frame)
SELECT {ENTRY_SQL}, frame, coalesce(label, -1) AS label FROM g LEFT JOIN e USING (grp, seq, frame)""")
def dense_labels(spark, sf_dir):
    t = tracks(spark, sf_dir)
    events = t.where("Y > 80").select("group", "sequence", "frame", F.col("event_id").alias("event"), F.col("id").alias("label"))
    return summaries.dense_labels(events, t.groupBy("group", "sequence").agg((F.max("frame") + 3).alias("n_frames")), -1)


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, floor((tm - min(tm) OVER (PARTITION BY grp, seq)) / 0.1e0) AS chunk FROM t""")
def chunked(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "time")
    return kinematics.chunks(t, seconds=0.1).select("group", "sequence", "id", "frame", F.col("chunk").cast("double").alias("chunk"))


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {r('x')} AS "X" FROM t WHERE frame >= 1 AND frame < 3 AND tm < 0.09""")
def time_range(spark, sf_dir):
    return kinematics.time_range(tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "time", "X"), 1, 3, end_time=0.09).drop("time")


_GAPPY = f"""{WITH_TRACKS}, g AS (SELECT grp, seq, id, frame, CASE WHEN event_id % 3 = 0 THEN x END AS v FROM t),
n AS (SELECT *, row_number() OVER (w) AS p, last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS v0,
  first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM g WINDOW w AS ({WIN})),
q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS p0,
  first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM n WINDOW w AS ({WIN}))"""
_FILLED = "coalesce(v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1)"


@query(f"""{_GAPPY} SELECT {ENTRY_SQL}, id, frame, {r(f'coalesce(v, {_FILLED})')} AS free, {r(f'coalesce(v, CASE WHEN p - p0 <= 1 OR p1 - p <= 1 THEN {_FILLED} END)')} AS limited FROM q""")
def interpolation(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", F.when(F.col("event_id") % 3 == 0, F.col("X")).alias("free")).withColumn("limited", F.col("free"))
    return interpolated(interpolated(t, ["free"]), ["limited"], limit=1)


@query(f"""{WITH_TRACKS}, j AS (SELECT *, CASE WHEN sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) > 60 THEN 1 ELSE 0 END AS j FROM t WINDOW w AS ({WIN}))
SELECT {ENTRY_SQL}, id, frame, max(j) OVER ({WIN} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS bad_frame FROM j""")
def bad_frames(spark, sf_dir):
    return kinematics.bad_frames(_thin(tracks(spark, sf_dir)), 60.0, expand=1).select("group", "sequence", "id", "frame", "bad_frame")


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {r('CASE WHEN count(x) OVER w >= 2 THEN median(x) OVER w END')} AS rolled FROM t WINDOW w AS ({WIN} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_median(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "X")
    return t.withColumn("rolled", rolling(F.col("X"), rows_of(t.columns), 5, "median", 2)).drop("X")


# ---- neighbours and pairs

_NN = f"""{WITH_TRACKS}, c AS (
  SELECT f.grp, f.seq, f.frame, f.id, f.tm, f.a, n.id AS nid, n.x - f.x AS dx, n.y - f.y AS dy, n.a AS na,
    row_number() OVER (PARTITION BY f.grp, f.seq, f.frame, f.id ORDER BY (n.x - f.x) * (n.x - f.x) + (n.y - f.y) * (n.y - f.y), n.id) AS k
  FROM t f LEFT JOIN t n ON f.grp = n.grp AND f.seq = n.seq AND f.frame = n.frame AND f.id <> n.id),
nn AS (SELECT *, dx * cos(a) + dy * sin(a) AS ex, dy * cos(a) - dx * sin(a) AS ey, {wrap('na - a')} AS dang FROM c WHERE k = 1)"""


@query(f"""{_NN} SELECT {ENTRY_SQL}, frame, id, {r('tm')} AS "time", {r('nid')} AS nn_id, {r('dx')} AS nn_delta_x, {r('dy')} AS nn_delta_y, {r('sqrt(dx * dx + dy * dy)')} AS nn_dist,
  {r('ex')} AS nn_delta_x_ego, {r('ey')} AS nn_delta_y_ego, {r('dang')} AS nn_delta_angle, false AS nn_ego_unrotated FROM nn""")
def nearest_neighbor(spark, sf_dir):
    return neighbours.nearest_neighbor(_thin(tracks(spark, sf_dir)))


_HEAD = f"""{WITH_TRACKS}, b AS (SELECT *, degrees(atan2(py5 - py3, px5 - px3)) AS body FROM t),
p AS (SELECT f.grp, f.seq, f.frame, f.id AS focal_id, n.id AS target_id, f.body, degrees(atan2(n.py3 - f.py3, n.px3 - f.px3)) AS bearing, sqrt((n.px3 - f.px3) ^ 2 + (n.py3 - f.py3) ^ 2) AS dist
  FROM b f JOIN b n ON f.grp = n.grp AND f.seq = n.seq AND f.frame = n.frame AND f.id <> n.id),
fc AS (SELECT *, abs(bearing - body + 180 - floor((bearing - body + 180) / 360) * 360 - 180) AS diff FROM p),
fd AS (SELECT *, round(diff, 9) AS rd, diff < 60 AND dist < 70 AS facing FROM fc)"""


@query(f"""{_HEAD} SELECT {ENTRY_SQL}, frame, focal_id, target_id, {r('body')} AS body_angle_deg, {r('bearing')} AS bearing_deg, {r('diff')} AS angle_diff_deg, {r('dist')} AS distance, facing AS is_facing FROM fd""")
def pair_facing(spark, sf_dir):
    return pairs.pair_facing(tracks(spark, sf_dir), 60.0, 70.0)


@query(f"""{_HEAD}, g AS (SELECT grp, seq, frame, focal_id, arg_min(target_id, (rd, target_id)) FILTER (facing) AS target_id, min(diff) FILTER (facing) AS diff FROM fd GROUP BY grp, seq, frame, focal_id),
k AS (SELECT *, CASE WHEN focal_id < 3 THEN 'a' WHEN focal_id < 6 THEN 'b' END AS fg, CASE WHEN target_id < 3 THEN 'a' WHEN target_id < 6 THEN 'b' END AS tg FROM g)
SELECT {ENTRY_SQL}, frame, focal_id, target_id, {r('diff')} AS angle_diff_deg, fg AS focal_group, tg AS target_group,
  CASE WHEN target_id IS NULL THEN 'none' WHEN fg IS NULL OR tg IS NULL THEN 'unknown' WHEN fg = tg THEN 'in_group' ELSE 'out_group' END AS attention_type FROM k""")
def attention_target(spark, sf_dir):
    return pairs.attention_target(pairs.pair_facing(tracks(spark, sf_dir), 60.0, 70.0), {i: "ab"[i // 3] for i in range(6)})


def _gradient(c: str, w: str) -> str:
    return f"CASE WHEN lag(1) OVER {w} IS NULL THEN lead({c}) OVER {w} - {c} WHEN lead(1) OVER {w} IS NULL THEN {c} - lag({c}) OVER {w} ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END"


def _pair_sql(source: str) -> str:
    """The pair features of `source(grp, seq, frame, id, cx, cy, ux, uy, th)`."""
    sides = ", ".join(f"{s}.{c} AS {c}{s}" for s in "AB" for c in ("id", "cx", "cy", "ux", "uy", "th"))
    steps = ", ".join(f"CASE WHEN abs(th{s} - lag(th{s}) OVER w) >= pi() THEN {wrap(f'th{s} - lag(th{s}) OVER w')} - (th{s} - lag(th{s}) OVER w) ELSE 0 END AS mv{s}" for s in "AB")
    turns = ", ".join(f"th{s} + sum(coalesce(mv{s}, 0)) OVER (PARTITION BY grp, seq, idA, idB ORDER BY frame ROWS UNBOUNDED PRECEDING) AS tu{s}" for s in "AB")
    grads = ", ".join(f"({_gradient(f'{c}{s}', 'w')}) * {FPS} AS v{c}{s}" for s in "AB" for c in ("cx", "cy", "tu"))

    def seen(a, b, sign, k):
        d = f"({sign} * (cxB - cxA))", f"({sign} * (cyB - cyA))"
        v = {s: (f"vcx{s}", f"vcy{s}") for s in "AB"}
        along, aside = (lambda p, s: f"{p[0]} * ux{s} + {p[1]} * uy{s}"), (lambda p, s: f"{p[1]} * ux{s} - {p[0]} * uy{s}")
        size = lambda p: f"sqrt({p[0]} * {p[0]} + {p[1]} * {p[1]})"
        values = [size(v[a]), along(v[a], a), aside(v[a], a), f"vtu{a}", f"cos(th{a})", f"sin(th{a})", size(d), along(d, a), aside(d, a), "cos(tuB - tuA)", f"sin({sign} * (tuB - tuA))", size(v[b]), along(v[b], b), aside(v[b], b), f"vtu{b}"]
        columns = ", ".join(f"{r(f'CAST({e} AS FLOAT)')} AS \"{n}\"" for n, e in zip(pairs.PAIR_FEATURES, values))
        return f"SELECT {ENTRY_SQL}, frame, {k} AS perspective, id{a} AS id1, id{b} AS id2, {columns} FROM pg WHERE vcxA IS NOT NULL AND vcxB IS NOT NULL"

    return f"""pp AS (SELECT A.grp, A.seq, A.frame, {sides} FROM {source} A JOIN {source} B ON A.grp = B.grp AND A.seq = B.seq AND A.frame = B.frame AND A.id < B.id),
ps AS (SELECT *, {steps} FROM pp WINDOW w AS (PARTITION BY grp, seq, idA, idB ORDER BY frame)), pt AS (SELECT *, {turns} FROM ps),
pg AS (SELECT *, {grads} FROM pt WINDOW w AS (PARTITION BY grp, seq, idA, idB ORDER BY frame)) {seen('A', 'B', 1, 0)} UNION ALL {seen('B', 'A', -1, 1)}"""


@query(f"{WITH_TRACKS}, src AS (SELECT grp, seq, frame, id, x AS cx, y AS cy, cos(a) AS ux, sin(a) AS uy, a AS th FROM t), " + _pair_sql("src"))
def pair_position(spark, sf_dir):
    return pairs.pair_position(_thin(tracks(spark, sf_dir)).drop("time"), FPS)


@query(
    f"{WITH_TRACKS}, src AS (SELECT grp, seq, frame, id, {_MX} AS cx, {_MY} AS cy, (px3 - px6) / (sqrt((px3 - px6) ^ 2 + (py3 - py6) ^ 2) + 1e-8) AS ux, (py3 - py6) / (sqrt((px3 - px6) ^ 2 + (py3 - py6) ^ 2) + 1e-8) AS uy, atan2(py3 - py6, px3 - px6) AS th FROM t), "
    + _pair_sql("src")
)
def pair_egocentric(spark, sf_dir):
    return pairs.pair_egocentric(tracks(spark, sf_dir).drop("time"), FPS)


_PB = ", ".join(f"sqrt((n.px{k} - f.x) ^ 2 + (n.py{k} - f.y) ^ 2) / s.scale" for k in range(POINTS))


_PXY = ", ".join(f"list_sort([{', '.join(e.format(k=k) for k in range(POINTS))}]) AS {c}p" for c, e in (("x", "((n.px{k} - f.x) * cos(f.a) + (n.py{k} - f.y) * sin(f.a)) / s.scale"), ("y", "((n.py{k} - f.y) * cos(f.a) - (n.px{k} - f.x) * sin(f.a)) / s.scale")))


@query(f"""{WITH_TRACKS}, s AS (SELECT grp, seq, avg(list_aggregate([{_DIST}], $$median$$)) AS scale FROM t GROUP BY grp, seq),
o AS (SELECT f.grp, f.seq, f.frame, f.id AS id1, n.id AS id2, ((n.x - f.x) * cos(f.a) + (n.y - f.y) * sin(f.a)) / s.scale AS rx, ((n.y - f.y) * cos(f.a) - (n.x - f.x) * sin(f.a)) / s.scale AS ry, {wrap('n.a - f.a')} AS rt, list_sort([{_PB}]) AS d, {_PXY}
  FROM t f JOIN t n ON f.grp = n.grp AND f.seq = n.seq AND f.frame = n.frame AND f.id <> n.id JOIN s ON s.grp = f.grp AND s.seq = f.seq)
SELECT {ENTRY_SQL}, frame, id1, id2, {r('rx')} AS dx, {r('ry')} AS dy, {r('rt')} AS dtheta, {r('d[1]')} AS dist_min, {r('d[4]')} AS dist_median, {r('d[7]')} AS dist_max, {r('d[1]')} AS near_0, {r('d[2]')} AS near_1, {r('d[3]')} AS near_2,
  {r('d[2] + 0.5e0 * (d[3] - d[2])')} AS dist_q25, {', '.join(f"{r(f'{c}p[{i}]')} AS {c}_{n}" for c in 'xy' for n, i in (('min', 1), ('median', 4), ('max', 7)))} FROM o""")
def orientation_relative(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return pairs.orientation_relative(t, pairs.body_scale(t), quantiles=(0.25,))


@query(f"""{_NN}, pr AS (SELECT A.grp, A.seq, A.frame, A.id AS id1, B.id AS id2 FROM t A JOIN t B ON A.grp = B.grp AND A.seq = B.seq AND A.frame = B.frame AND A.id < B.id)
SELECT {ENTRY_SQL}, frame, id1, id2 FROM pr p WHERE EXISTS (SELECT 1 FROM nn WHERE nn.grp = p.grp AND nn.seq = p.seq AND nn.frame = p.frame AND ((nn.id = p.id1 AND nn.nid = p.id2) OR (nn.id = p.id2 AND nn.nid = p.id1)))""")
def nearest_pairs(spark, sf_dir):
    from .joins import pairs as pair_rows

    t = _thin(tracks(spark, sf_dir))
    both = pair_rows(t, [], suffixes=("1", "2"))
    return nearest_pairs_only(both, neighbours.nearest_neighbor(t))


_RADIUS = 30.0
_LOCAL = f"""{WITH_TRACKS}, c AS (SELECT grp, seq, frame, id, tm, x, y, cos(a) AS ux, sin(a) AS uy, x - avg(x) OVER w AS rx, y - avg(y) OVER w AS ry FROM t WINDOW w AS (PARTITION BY grp, seq, frame)),
e AS (SELECT *, sqrt(rx * rx + ry * ry) AS dc FROM c), f AS (SELECT *, CASE WHEN dc > 0 THEN rx / dc * uy - ry / dc * ux END AS rr, row_number() OVER (PARTITION BY grp, seq, frame ORDER BY dc DESC, id) AS far FROM e),
g AS (SELECT *, median(CASE WHEN far <= 3 THEN dc END) OVER (PARTITION BY grp, seq, frame) AS outer_r FROM f),
h AS (SELECT *, CASE WHEN outer_r > 0 THEN CAST(greatest(0, least(3, floor(dc / (outer_r / 4)))) AS INT) ELSE -1 END AS sh FROM g),
s AS (SELECT *, CASE WHEN sh >= 0 THEN count(*) OVER q ELSE -1 END AS sn, CASE WHEN sh >= 0 THEN avg(rr) OVER q END AS sr FROM h WINDOW q AS (PARTITION BY grp, seq, frame, sh)),
l AS (SELECT A.grp, A.seq, A.frame, A.id, count(*) - 1 AS nb, count(*) FILTER (B.id <> A.id) AS nh, avg(B.ux) AS hx, avg(B.uy) AS hy, avg(B.rr) AS lr
  FROM s A JOIN s B ON A.grp = B.grp AND A.seq = B.seq AND A.frame = B.frame WHERE (B.x - A.x) * (B.x - A.x) + (B.y - A.y) * (B.y - A.y) <= {_RADIUS * _RADIUS} GROUP BY ALL)"""


@query(f"""{_LOCAL} SELECT {ENTRY_SQL}, frame, id, {r('tm')} AS "time", {r(str(_RADIUS))} AS local_radius, 'angle' AS heading_source, {r('dc')} AS dist_to_center, {r('rr')} AS radial_rotation, {r('outer_r')} AS outer_radius, sh AS shell_index, sn AS shell_n, {r('sr')} AS shell_rotation,
  nb AS n_local_neighbors, nh AS n_local_headings, {r('CASE WHEN nh >= 1 THEN hx END')} AS local_heading_x, {r('CASE WHEN nh >= 1 THEN hy END')} AS local_heading_y, {r('CASE WHEN nh >= 1 THEN lr END')} AS local_rotation,
  {r('CASE WHEN nh >= 1 THEN sqrt(hx * hx + hy * hy) END')} AS local_polarization FROM s JOIN l USING (grp, seq, frame, id)""")
def local_order(spark, sf_dir):
    return neighbours.local_order(_thin(tracks(spark, sf_dir)), _RADIUS, shells=4, peripheral=3)


# ---- groups

_COLLECT = f"""{WITH_TRACKS}, v AS (SELECT *, frame - lag(frame) OVER w AS gap, x - lag(x) OVER w AS sx, y - lag(y) OVER w AS sy FROM t WINDOW w AS ({WIN})),
m AS (SELECT *, CASE WHEN gap = 1 THEN sx * {FPS} END AS vx, CASE WHEN gap = 1 THEN sy * {FPS} END AS vy FROM v),
c AS (SELECT *, cos(a) AS ux, sin(a) AS uy, x - avg(x) OVER w AS rx, y - avg(y) OVER w AS ry, avg(x) OVER w AS cx, avg(y) OVER w AS cy, avg(vx) OVER w AS mvx, avg(vy) OVER w AS mvy FROM m WINDOW w AS (PARTITION BY grp, seq, frame)),
d AS (SELECT *, sqrt(rx * rx + ry * ry) AS rr FROM c),
g AS (SELECT grp, seq, frame, min(tm) AS tm, count(*) AS n, count(*) FILTER (rr = 0) AS nc, count(vx) AS nv, sum(ux) AS sx, sum(uy) AS sy, sum(CASE WHEN rr > 0 THEN rx / rr * uy - ry / rr * ux END) AS turn, count(CASE WHEN rr > 0 THEN 1 END) AS nt,
  avg(CASE WHEN rr > 0 THEN (rx * (vy - mvy) - ry * (vx - mvx)) / (rr * rr) END) AS av, first(cx) AS cx, first(cy) AS cy, first(mvx) AS mvx, first(mvy) AS mvy, avg(rx * rx) AS xx, avg(ry * ry) AS yy, avg(rx * ry) AS xy FROM d GROUP BY grp, seq, frame),
e AS (SELECT *, (xx + yy) / 2 AS mid, sqrt(((xx - yy) / 2) ^ 2 + xy * xy) AS half, CASE WHEN n >= 3 THEN sqrt(sx * sx + sy * sy) / n END AS pol, CASE WHEN n >= 3 AND nt > 0 THEN turn / n END AS rot, sqrt(mvx * mvx + mvy * mvy) AS cs FROM g)"""


@query(f"""{_COLLECT} SELECT {ENTRY_SQL}, frame, {r('tm')} AS "time", n AS n_ids, n AS n_ids_heading, nc AS n_at_centroid, nv AS n_centroid_common, {r('CASE WHEN n >= 3 THEN av END')} AS group_angvel, {r('cx')} AS centroid_x, {r('cy')} AS centroid_y, 'angle' AS heading_source,
  {r('pol')} AS polarization, {r('CASE WHEN n >= 3 THEN atan2(sy, sx) END')} AS mean_heading, {r('rot')} AS rotation_signed, {r('cs')} AS centroid_speed, {r('CASE WHEN n >= 3 THEN sqrt(mid + half) END')} AS sd_major,
  {r('CASE WHEN n >= 3 THEN sqrt(greatest(mid - half, 0)) END')} AS sd_minor, {r('abs(rot)')} AS rotation, {r('CASE WHEN cs > 0 THEN atan2(mvy, mvx) END')} AS centroid_heading, {r('CASE WHEN n >= 3 THEN 0.5 * atan2(2 * xy, xx - yy) END')} AS principal_axis_angle,
  CASE WHEN pol IS NULL OR rot IS NULL THEN 'Undefined' WHEN abs(rot) < 0.35 AND pol > 0.65 THEN 'Polarized' WHEN abs(rot) < 0.35 AND pol < 0.35 THEN 'Swarm' WHEN abs(rot) > 0.65 AND pol < 0.35 THEN 'Milling' ELSE 'Transitional' END AS state FROM e""")
def collective_motion(spark, sf_dir):
    return groups.collective_motion(_thin(tracks(spark, sf_dir)), FPS).drop("elongation")


@query()
def group_area(spark, sf_dir):
    out = groups.collective_motion(_thin(tracks(spark, sf_dir)), FPS, area=True)
    return out.select("group", "sequence", "frame", "n_ids", "area", "density", "elongation")


_FUSION = f"""WITH RECURSIVE tr AS ({TRACKS}), fr AS (SELECT grp, seq, frame, row_number() OVER w AS k, frame - lag(frame) OVER w AS gap FROM (SELECT DISTINCT grp, seq, frame FROM tr) WINDOW w AS (PARTITION BY grp, seq ORDER BY frame)),
f AS (SELECT grp, seq, frame, k, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY grp, seq ORDER BY frame) AS run FROM fr),
p AS (SELECT A.grp, A.seq, f.k, A.id AS a, B.id AS b, sqrt((A.x - B.x) ^ 2 + (A.y - B.y) ^ 2) AS d FROM tr A JOIN tr B ON A.grp = B.grp AND A.seq = B.seq AND A.frame = B.frame AND A.id < B.id JOIN f ON f.grp = A.grp AND f.seq = A.seq AND f.frame = A.frame),
l AS (SELECT f.grp, f.seq, f.frame, a, b FROM p JOIN f ON f.grp = p.grp AND f.seq = p.seq AND f.k BETWEEN p.k - 1 AND p.k + 1 GROUP BY ALL HAVING avg(d) < 40),
e AS (SELECT * FROM l UNION ALL SELECT grp, seq, frame, b, a FROM l),
reach(grp, seq, frame, a, b) AS (SELECT f.grp, f.seq, f.frame, i.id, i.id FROM f JOIN (SELECT DISTINCT grp, seq, id FROM tr) i ON f.grp = i.grp AND f.seq = i.seq
  UNION SELECT r.grp, r.seq, r.frame, r.a, e.b FROM reach r JOIN e ON e.grp = r.grp AND e.seq = r.seq AND e.frame = r.frame AND e.a = r.b),
m AS (SELECT grp, seq, frame, a AS id, min(b) AS g, count(*) AS n, list_sort(list(b)) AS members FROM reach GROUP BY grp, seq, frame, a),
q AS (SELECT DISTINCT m.grp, m.seq, m.frame, run, members FROM m JOIN f ON m.grp = f.grp AND m.seq = f.seq AND m.frame = f.frame),
q1 AS (SELECT *, frame - lag(frame) OVER (PARTITION BY grp, seq, run, members ORDER BY frame) AS gap FROM q), q2 AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY grp, seq, run, members ORDER BY frame) AS part FROM q1),
q3 AS (SELECT *, min(frame) OVER w AS first, max(frame) OVER w - min(frame) OVER w >= 1 AS lasts FROM q2 WINDOW w AS (PARTITION BY grp, seq, run, members, part)),
q4 AS (SELECT *, CASE WHEN lasts THEN dense_rank() OVER (PARTITION BY grp, seq ORDER BY lasts DESC, run, members, first) - 1 ELSE -1 END AS event FROM q3)"""


@query(f"""{_FUSION} SELECT {ENTRY_SQL.replace('grp', 'm.grp').replace('seq AS', 'm.seq AS')}, m.frame, m.id, m.g AS group_membership, m.n AS group_size, event FROM m JOIN q4 ON m.grp = q4.grp AND m.seq = q4.seq AND m.frame = q4.frame AND m.members = q4.members""")
def fission_fusion(spark, sf_dir):
    return groups.fission_fusion(_thin(tracks(spark, sf_dir)), 40.0, 3)


@query(f"""{WITH_TRACKS}, c AS (SELECT *, count(*) OVER w AS gs, x - avg(x) OVER w AS rx, y - avg(y) OVER w AS ry FROM t WINDOW w AS (PARTITION BY grp, seq, frame)), d AS (SELECT *, sqrt(rx * rx + ry * ry) AS dc FROM c),
k AS (SELECT *, count(*) OVER (PARTITION BY grp, seq, frame ORDER BY round(dc, 9) RANGE UNBOUNDED PRECEDING) = gs AS outermost, CASE WHEN gs = lag(gs) OVER ({WIN}) THEN 0 ELSE 1 END AS nw FROM d),
s AS (SELECT *, sum(nw) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS stay FROM k), u AS (SELECT grp, seq, id, gs, stay, max(frame) - min(frame) + 1 AS len, count(*) AS n, count(*) FILTER (outermost) AS o FROM s GROUP BY ALL),
v AS (SELECT grp, seq, id, gs, sum(n) AS n, avg(len) AS av, median(len) AS md, sum(o) AS o FROM u GROUP BY ALL)
SELECT {ENTRY_SQL}, id, gs AS group_size, {r('n / sum(n) OVER (PARTITION BY grp, seq, id)')} AS fractime_norm2, {r('av')} AS avg_duration_frame, {r('md')} AS med_duration_frame, {r('o / n')} AS ftime_periphery, {r('o / n * gs')} AS ftime_periphery_norm FROM v""")
def fission_fusion_metrics(spark, sf_dir):
    return groups.fission_fusion_metrics(_thin(tracks(spark, sf_dir)))


def _social(spark, sf_dir):
    t = _thin(tracks(spark, sf_dir))
    speed = kinematics.speed_angvel(t, fps=FPS).select("group", "sequence", "id", "frame", "speed")
    return align([t.drop("time"), speed, neighbours.nearest_neighbor(t).drop("time")], check=False)


_SOCIAL = f"""{_SPEED}, c AS (
  SELECT f.grp, f.seq, f.frame, f.id, n.id AS nid, n.x - f.x AS dx, n.y - f.y AS dy, f.a, n.a AS na,
    row_number() OVER (PARTITION BY f.grp, f.seq, f.frame, f.id ORDER BY (n.x - f.x) * (n.x - f.x) + (n.y - f.y) * (n.y - f.y), n.id) AS k
  FROM t f LEFT JOIN t n ON f.grp = n.grp AND f.seq = n.seq AND f.frame = n.frame AND f.id <> n.id),
nn AS (SELECT *, dx * cos(a) + dy * sin(a) AS ex, dy * cos(a) - dx * sin(a) AS ey, {wrap('na - a')} AS dang FROM c WHERE k = 1),
so AS (SELECT s.grp, s.seq, s.frame, s.id, s.x, s.y, s.a, s.speed, nn.nid, nn.ex, nn.ey, nn.dang, o.speed AS nspeed FROM s JOIN nn USING (grp, seq, frame, id) LEFT JOIN s o ON o.grp = s.grp AND o.seq = s.seq AND o.frame = s.frame AND o.id = nn.nid)"""
_DT = f"nullif((frame - lag(frame) OVER ({WIN})) / {FPS}, 0)"


@query(f"""{_SOCIAL}, ac AS (SELECT *, (speed - lag(speed) OVER ({WIN})) / {_DT} AS ac FROM so), je AS (SELECT *, abs(ac) AS aa, abs(ac - lag(ac) OVER ({WIN})) / {_DT} AS aj FROM ac)
SELECT {ENTRY_SQL}, id, {r('avg(CASE WHEN nid IS NOT NULL THEN cos(dang) END)')} AS nn_align, {r('avg(CASE WHEN nid IS NOT NULL THEN CASE WHEN ex > 0 THEN 1e0 ELSE 0e0 END END)')} AS frac_nn_ahead,
  {r('avg(ex / nullif(sqrt(ex * ex + ey * ey), 0))')} AS nn_bearing_x, {r('avg(ey / nullif(sqrt(ex * ex + ey * ey), 0))')} AS nn_bearing_y, {r('avg(abs(speed - nspeed))')} AS speed_match_nn, {r('stddev_pop(speed) / nullif(avg(speed), 0)')} AS speed_cv,
  {r('(quantile_cont(speed, 0.75) - quantile_cont(speed, 0.25)) / nullif(median(speed), 0)')} AS speed_rcv,
  {', '.join(f"{r(f'avg({c})')} AS {n}_mean, {r(f'median({c})')} AS {n}_med, {r(f'stddev_pop({c}) / nullif(avg({c}), 0)')} AS {n}_cv, {r(f'(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / nullif(median({c}), 0)')} AS {n}_rcv" for n, c in (('accel', 'aa'), ('jerk', 'aj')))}
FROM je GROUP BY grp, seq, id""")
def social_motion_summary(spark, sf_dir):
    return summaries.social_motion_summary(_social(spark, sf_dir), FPS)


_RESPONSE = f"""{_SOCIAL}, rs AS (SELECT *, lead(frame, 2) OVER w AS f2, lead(x, 2) OVER w - x AS rdx, lead(y, 2) OVER w - y AS rdy, {wrap(f'lead(a, 2) OVER w - a')} / 2 * {FPS} AS dangle, lead(speed, 2) OVER w - speed AS dspeed FROM so WINDOW w AS ({WIN})),
rp AS (SELECT * FROM rs WHERE f2 - frame = 2)"""


@query(f"""{_RESPONSE} SELECT {ENTRY_SQL}, id, frame, {r('rdx')} AS dx, {r('rdy')} AS dy, {r(f'2 / {FPS}')} AS dt, {r('dangle')} AS dangle, {r('dspeed')} AS dspeed, {r('ex')} AS neighbor_x, {r('ey')} AS neighbor_y FROM rp""")
def nn_delta_response(spark, sf_dir):
    return kinematics.nn_delta_response(_social(spark, sf_dir), 2, FPS).select("group", "sequence", "id", "frame", "dx", "dy", "dt", "dangle", "dspeed", "neighbor_x", "neighbor_y")


_KEYS = "grp, seq, metric, kind, i, j"


def _bins_sql(response: str, rows: str) -> str:
    """Bins of the rows (grp, seq, cc, nc, bx, by_, dangle, dspeed) that the SQL `rows` selects, for every pair of categories."""
    return f"""{response}, b AS ({rows}),
tn AS (SELECT grp, seq, cc, nc, bx, by_, dangle AS v FROM b UNION ALL SELECT grp, seq, cc, nc, bx, -by_, -dangle FROM b), sp AS (SELECT grp, seq, cc, nc, bx, by_, dspeed AS v FROM b UNION ALL SELECT grp, seq, cc, nc, bx, -by_, dspeed FROM b),
gs AS (SELECT DISTINCT grp, seq, cc, nc FROM b),
o1 AS (SELECT 'turn' AS metric, grp, seq, cc, nc, CAST(floor((by_ + 60) / 20e0) AS INT) AS i, v FROM tn WHERE bx >= 0 AND bx <= 40 UNION ALL SELECT 'speed', grp, seq, cc, nc, CAST(floor((bx + 60) / 20e0) AS INT), dspeed FROM b WHERE abs(by_) <= 20),
o2 AS (SELECT 'turn' AS metric, grp, seq, cc, nc, bx, by_, v FROM tn UNION ALL SELECT 'speed', grp, seq, cc, nc, bx, by_, v FROM sp),
o3 AS (SELECT metric, grp, seq, cc, nc, CASE WHEN bx = 60 THEN 5 ELSE CAST(floor((bx + 60) / 20e0) AS INT) END AS i, CASE WHEN by_ = 60 THEN 6 ELSE CAST(floor((by_ + 60) / (120e0 / 7)) AS INT) END AS j, v FROM o2),
l1 AS (SELECT * FROM gs, (VALUES ('turn'), ('speed')) m(metric), range(0, 6) x(i)), l2 AS (SELECT * FROM gs, (VALUES ('turn'), ('speed')) m(metric), range(0, 6) x(i), range(0, 7) y(j)),
a1 AS (SELECT metric, grp, seq, cc, nc, i, avg(v) AS v FROM o1 GROUP BY ALL), a2 AS (SELECT metric, grp, seq, cc, nc, i, j, sum(v) AS s, count(*) AS n FROM o3 GROUP BY ALL)
SELECT {ENTRY_SQL}, cc AS center_category, nc AS neighbor_category, 'all' AS group_size, '1d' AS dim, metric, CAST(i AS INT) AS bin_idx, {r('v')} AS value, CAST(NULL AS INT) AS bin_x, CAST(NULL AS INT) AS bin_y, CAST(NULL AS DOUBLE) AS sum_value, CAST(NULL AS BIGINT) AS "count" FROM l1 LEFT JOIN a1 USING (metric, grp, seq, cc, nc, i)
UNION ALL SELECT grp, seq, cc, nc, 'all', '2d', metric, NULL, NULL, CAST(i AS INT), CAST(j AS INT), {r('coalesce(s, 0)')}, coalesce(n, 0) FROM l2 LEFT JOIN a2 USING (metric, grp, seq, cc, nc, i, j)"""


_BINNED = "ex AS bx, ey AS by_, dangle, dspeed FROM rp WHERE ex IS NOT NULL AND dangle IS NOT NULL AND dspeed IS NOT NULL"


@query(_bins_sql(_RESPONSE, f"SELECT grp, seq, 'all' AS cc, 'all' AS nc, {_BINNED}"))
def nn_delta_bins(spark, sf_dir):
    response = kinematics.nn_delta_response(_social(spark, sf_dir), 2, FPS)
    return summaries.nn_delta_bins(response, bins=7, most=60.0, most_for_mean=40.0)


_FAST = _RESPONSE.replace("rs AS (SELECT *, lead", """fq AS (SELECT *, coalesce(speed > quantile_cont(speed, 0.6) OVER (PARTITION BY grp, seq), false) AS fast FROM so),
sf AS (SELECT f.*, n.fast AS nfast FROM fq f LEFT JOIN fq n ON f.grp = n.grp AND f.seq = n.seq AND f.frame = n.frame AND f.nid = n.id), rs AS (SELECT *, lead""").replace("FROM so WINDOW w", "FROM sf WINDOW w").replace(f"/ 2 * {FPS} AS dangle", "/ 2 * 24.0 AS dangle")
_FAST_ROWS = f"SELECT grp, seq, CAST(fast AS VARCHAR) AS cc, CAST(nfast AS VARCHAR) AS nc, {_BINNED}"


@query(_bins_sql(_FAST, f"{_FAST_ROWS} UNION ALL {_FAST_ROWS.replace('CAST(nfast AS VARCHAR)', chr(39) + 'all' + chr(39))}"))
def nn_delta_bins_by_speed(spark, sf_dir):
    fast = summaries.quantile_category(_social(spark, sf_dir), "speed", "fast", 0.6)
    # At 24 frames a second the means of a few turns, which are whole thousandths, don't end in the middle of two roundings.
    response = kinematics.nn_delta_response(fast, 2, 24.0, tags=["fast"])
    return summaries.nn_delta_bins(response, bins=7, most=60.0, most_for_mean=40.0, focal="fast", neighbor="neighbor_fast")


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {r('x')} AS "X", x > quantile_cont(x, 0.75) OVER (PARTITION BY grp, seq) AS far FROM t""")
def quantile_categories(spark, sf_dir):
    return summaries.quantile_category(tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "X"), "X", "far")


# ---- interactions


def _candidate(p: str, q: str, sign: int) -> str:
    along = lambda s: f"{sign} * (vx{s} * dx + vy{s} * dy) / greatest(d * s{s}, 1e-12)"
    return f"CASE WHEN d > 0 AND d <= 90 AND s{p} >= 5 AND s{q} >= 5 AND {along(p)} >= 0.2 AND {along(q)} >= 0.1 AND (vx{p} * cos(a{p}) + vy{p} * sin(a{p})) / greatest(s{p}, 1e-12) >= -0.5 THEN 1 ELSE 0 END"


_AA = f"""{WITH_TRACKS}, v AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 THEN x - lag(x) OVER w END AS vx, CASE WHEN frame - lag(frame) OVER w = 1 THEN y - lag(y) OVER w END AS vy FROM t WINDOW w AS ({WIN})),
p AS (SELECT A.grp, A.seq, A.frame, A.id AS id1, B.id AS id2, B.x - A.x AS dx, B.y - A.y AS dy, sqrt((B.x - A.x) ^ 2 + (B.y - A.y) ^ 2) AS d, A.vx AS vx1, A.vy AS vy1, B.vx AS vx2, B.vy AS vy2, A.a AS a1, B.a AS a2, sqrt(A.vx * A.vx + A.vy * A.vy) AS s1, sqrt(B.vx * B.vx + B.vy * B.vy) AS s2
  FROM v A JOIN v B ON A.grp = B.grp AND A.seq = B.seq AND A.frame = B.frame AND A.id < B.id),
c AS (SELECT *, {_candidate('1', '2', 1)} AS c12, {_candidate('2', '1', -1)} AS c21 FROM p),
aa AS (SELECT *, CASE WHEN c12 = 1 AND sum(c12) OVER w >= 1 THEN 1 ELSE 0 END AS e12, CASE WHEN c21 = 1 AND sum(c21) OVER w >= 1 THEN 1 ELSE 0 END AS e21 FROM c WINDOW w AS (PARTITION BY grp, seq, id1, id2 ORDER BY frame RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))"""


def _aa(spark, sf_dir):
    return interactions.approach_avoidance(_thin(tracks(spark, sf_dir)), 90.0, 5.0, 5.0, 0.2, 0.1, 3, 1, -0.5)


@query(f"{_AA} SELECT {ENTRY_SQL}, frame, id1, id2, greatest(e12, e21) AS label_id, greatest(e12, e21) AS aa_event, e12 AS aa_event_12, e21 AS aa_event_21 FROM aa")
def approach_avoidance(spark, sf_dir):
    return _aa(spark, sf_dir)


def _runs(d: str, p: str, q: str) -> str:
    return f"""SELECT {ENTRY_SQL}, id1, id2, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS duration, '{d}' AS direction, {p} AS approacher_id, {q} AS avoider_id
FROM (SELECT *, row_number() OVER w - sum(e{d}) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM aa WINDOW w AS (PARTITION BY grp, seq, id1, id2 ORDER BY frame)) WHERE e{d} = 1 GROUP BY grp, seq, id1, id2, run"""


@query(f"{_AA} {_runs('12', 'id1', 'id2')} UNION ALL {_runs('21', 'id2', 'id1')}")
def approach_events(spark, sf_dir):
    return interactions.event_table(_aa(spark, sf_dir))


_PAIR_W = "PARTITION BY grp, seq, id1, id2 ORDER BY frame"
_NEAR = f"{_PAIR_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"


def _morph(source: str, out: str, grow: bool) -> str:
    e = f"max(o) OVER ({_NEAR})" if grow else f"CASE WHEN k > 1 AND k < n THEN min(o) OVER ({_NEAR}) ELSE 0 END"
    return f"{out} AS (SELECT grp, seq, id1, id2, frame, k, n, {e} AS o FROM {source})"


@query(f"""{WITH_TRACKS}, q AS (SELECT *, x + 5 * cos(a) AS qx, y + 5 * sin(a) AS qy FROM t), pr AS (SELECT A.grp, A.seq, A.frame, A.id AS id1, B.id AS id2, sqrt((A.qx - B.qx) ^ 2 + (A.qy - B.qy) ^ 2) < 60 AS near, abs(A.a - B.a) AS da FROM q A JOIN q B ON A.grp = B.grp AND A.seq = B.seq AND A.frame = B.frame AND A.id < B.id),
o0 AS (SELECT *, CASE WHEN near AND pi() - least(da, 2 * pi() - da) < radians(150) THEN 1 ELSE 0 END AS o, row_number() OVER ({_PAIR_W}) AS k, count(*) OVER (PARTITION BY grp, seq, id1, id2) AS n FROM pr),
{_morph('o0', 'o1', True)}, {_morph('o1', 'o2', False)}, {_morph('o2', 'o3', False)}, {_morph('o3', 'o4', True)},
ru AS (SELECT *, k - sum(o) OVER ({_PAIR_W} ROWS UNBOUNDED PRECEDING) AS run FROM o4), se AS (SELECT grp, seq, id1, id2, n, min(k) AS k0, max(k) AS k1 FROM ru WHERE o = 1 GROUP BY grp, seq, id1, id2, n, run HAVING max(k) - min(k) + 1 >= 3),
sg AS (SELECT *, greatest(1, k0 - 1) AS f0, least(n, k1 + 1) AS f1, row_number() OVER (PARTITION BY grp, seq, id1, id2 ORDER BY k0) - 1 AS segment FROM se)
SELECT s.grp AS "group", s.seq AS "sequence", s.id1, s.id2, o.frame, segment, min(o.frame) OVER w AS interaction_start, max(o.frame) OVER w AS interaction_end FROM sg s JOIN o4 o ON s.grp = o.grp AND s.seq = o.seq AND s.id1 = o.id1 AND s.id2 = o.id2 AND o.k BETWEEN f0 AND f1
WINDOW w AS (PARTITION BY s.grp, s.seq, s.id1, s.id2, segment)""")
def pair_interaction_filter(spark, sf_dir):
    return interactions.pair_interaction_filter(_thin(tracks(spark, sf_dir)), 5.0, 60.0, True, 150.0, 3, 1, 3)


# ---- filters, joins, sets


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {r('x')} AS "X", {r('x * 2')} AS "X__1" FROM t""")
def aligned_inputs(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "X")
    return align([t, t.withColumn("X", F.col("X") * 2)])


@query(f"""{WITH_TRACKS}, k AS (SELECT *, count(*) OVER (PARTITION BY grp, seq) AS n, row_number() OVER (PARTITION BY grp, seq ORDER BY frame, id) - 1 AS p FROM t)
SELECT {ENTRY_SQL}, id, frame FROM k WHERE n <= 10 OR (p % greatest(1, n // 10) = 0 AND p // greatest(1, n // 10) < 10)""")
def uniform_rows(spark, sf_dir):
    return summaries.uniform_rows(tracks(spark, sf_dir).select("group", "sequence", "id", "frame"), 10)


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame FROM t WHERE NOT x > 70 AND NOT y > 70""")
def excluded_rows(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", (F.col("X") > 70).alias("far"), (F.col("Y") > 70).cast("int").alias("high"))
    return summaries.exclude_rows(t, ["far", "high", "missing"]).drop("far", "high")




# ---- entries


@query(f"""{WITH_TRACKS}, e AS (SELECT grp, seq, lag(seq) OVER w AS bef, lead(seq) OVER w AS aft FROM (SELECT DISTINCT grp, seq FROM t) WINDOW w AS (PARTITION BY grp ORDER BY seq)),
k AS (SELECT *, dense_rank() OVER (PARTITION BY grp, seq ORDER BY frame) AS fr, dense_rank() OVER (PARTITION BY grp, seq ORDER BY frame DESC) AS la FROM t)
SELECT {ENTRY_SQL}, id, frame, true AS is_core FROM t UNION ALL SELECT e.grp, e.seq, k.id, k.frame, false FROM k JOIN e ON k.grp = e.grp AND k.seq = e.bef WHERE la <= 2
UNION ALL SELECT e.grp, e.seq, k.id, k.frame, false FROM k JOIN e ON k.grp = e.grp AND k.seq = e.aft WHERE fr <= 2""")
def overlapping_sequences(spark, sf_dir):
    return scope.with_overlap(tracks(spark, sf_dir).select("group", "sequence", "id", "frame"), 2)


@query(f"""{WITH_TRACKS}, e AS (SELECT grp, seq, lag(seq) OVER w AS bef, lead(seq) OVER w AS aft FROM (SELECT DISTINCT grp, seq FROM t) WINDOW w AS (PARTITION BY grp ORDER BY seq)),
k AS (SELECT *, dense_rank() OVER (PARTITION BY grp, seq ORDER BY frame) AS fr, dense_rank() OVER (PARTITION BY grp, seq ORDER BY frame DESC) AS la FROM t),
m AS (SELECT grp, seq, seq AS origin, id, frame, x, y, true AS is_core FROM t UNION ALL SELECT e.grp, e.seq, k.seq, k.id, k.frame, k.x, k.y, false FROM k JOIN e ON k.grp = e.grp AND k.seq = e.bef WHERE la <= 3
UNION ALL SELECT e.grp, e.seq, k.seq, k.id, k.frame, k.x, k.y, false FROM k JOIN e ON k.grp = e.grp AND k.seq = e.aft WHERE fr <= 3) SELECT {ENTRY_SQL}, origin, id, frame, {r('x')} AS "X", {r('y')} AS "Y", is_core FROM m""")
def manifest_rows(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return scope.manifest([t.select("group", "sequence", "id", "frame", "X"), t.select("group", "sequence", "id", "frame", "Y")], 3)


@query(f"""{WITH_TRACKS}, f AS (SELECT grp, seq, list_sort(list(DISTINCT frame)) AS l FROM t GROUP BY grp, seq), u AS (SELECT grp, seq, l, unnest(range(0, 4)) AS i FROM f)
SELECT DISTINCT {ENTRY_SQL}, l[1 + CAST(CASE WHEN len(l) <= 4 THEN least(i, len(l) - 1) ELSE round_even(i * (len(l) - 1) / 3e0, 0) END AS BIGINT)] AS frame FROM u""")
def picked_frames(spark, sf_dir):
    return sampling.uniform_frames(tracks(spark, sf_dir), 4)


@query(f"""{WITH_TRACKS} SELECT DISTINCT {ENTRY_SQL} FROM t WHERE regexp_matches(seq, '-0[12]-') AND seq LIKE '%1' AND grp LIKE 'g%'""")
def queried_entries(spark, sf_dir):
    return scope.query_entries(tracks(spark, sf_dir), group_starts="g", contains="-0[12]-", ends="1")


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame FROM t WHERE grp IN ('g0', 'g2')""")
def scoped_rows(spark, sf_dir):
    return scope.in_scope(tracks(spark, sf_dir).select("group", "sequence", "id", "frame"), groups=["g0", "g2"])


@query(f"""{WITH_TRACKS} SELECT DISTINCT {ENTRY_SQL}, split_part(seq, '-', 1) AS "year", split_part(seq, '-', 2) AS "month", split_part(seq, '-', 3) AS "day" FROM t""")
def entry_levels(spark, sf_dir):
    return scope.entry_levels(tracks(spark, sf_dir), ["year", "month", "day"], "-")


# ---- global models over the embeddings table


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


WIDTH = 64
_FEATURES = [f"e{i}" for i in range(WIDTH)]


def _wide(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(_FEATURES)])


_PROTO = """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY label, pos),
p AS (SELECT label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)"""


@query(f"{_PROTO} SELECT label, CAST(pos - 1 AS INT) AS pos, {r('x')} AS value FROM p")
def embedding_prototypes(spark, sf_dir):
    return models.prototypes(_embeddings(spark, sf_dir)).select("label", F.posexplode("prototype").alias("pos", "value"))


@query(f"""{_PROTO}, n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM e GROUP BY vec_id), s AS (SELECT e.vec_id, p.label, sum(CAST(e.x AS DOUBLE) * p.x) / any_value(n.n) / 0.07 AS z FROM e JOIN p USING (pos) JOIN n ON n.vec_id = e.vec_id GROUP BY e.vec_id, p.label),
w AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS w FROM s) SELECT vec_id, label, {r('w / sum(w) OVER (PARTITION BY vec_id)')} AS probability FROM w""")
def prototype_scores(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return models.prototype_scores(e, models.prototypes(e), "vec_id")


_E = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(WIDTH))


@query(f"""WITH e AS (SELECT vec_id, label, {_E} FROM embeddings) SELECT vec_id, label, {', '.join(f"{r(f'(e{i} - avg(e{i}) OVER ()) / stddev_pop(e{i}) OVER ()')} AS e{i}" for i in range(WIDTH))} FROM e""")
def scaled_features(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    return models.Scaler.fit(wide, _FEATURES).apply(wide)


_CENTERS = [[round(0.1 * (((i * (k + 2)) % 5) - 2), 1) for i in range(WIDTH)] for k in range(3)]
_NEAR = f"""WITH e AS (SELECT vec_id, label, {_E} FROM embeddings), d AS (SELECT *, {', '.join('(' + ' + '.join(f'(e{i} - ({v}e0)) * (e{i} - ({v}e0))' for i, v in enumerate(c)) + f') AS d{k}' for k, c in enumerate(_CENTERS))} FROM e),
c AS (SELECT vec_id, label, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM d)"""


@query(f"{_NEAR} SELECT vec_id, cluster FROM c")
def centroid_assignment(spark, sf_dir):
    return models.nearest_centroid(_wide(spark, sf_dir), _FEATURES, np.array(_CENTERS)).select("vec_id", "cluster")


@query(f"{_NEAR} SELECT label AS truth, cluster AS predicted, count(*) AS n FROM c GROUP BY ALL")
def cluster_contingency(spark, sf_dir):
    return models.contingency(models.nearest_centroid(_wide(spark, sf_dir), _FEATURES, np.array(_CENTERS)), "label", "cluster")


@query()
def kmeans_clusters(spark, sf_dir):
    wide, columns = _wide(spark, sf_dir), _FEATURES
    return models.nearest_centroid(wide, columns, models.kmeans(wide, columns, 8)).select("vec_id", "cluster")


@query()
def ward_clusters(spark, sf_dir):
    """Fitted on a pool of 2,000 templates at most, drawn by label; all rows are assigned."""
    wide = _wide(spark, sf_dir)
    pool = templates.extract_templates(wide.withColumns({"group": F.lit("all"), "sequence": F.col("label").cast("string")}), 2_000, _FEATURES)
    return models.nearest_centroid(wide, _FEATURES, models.ward(pool.select(*_FEATURES).toPandas().to_numpy(), 6)[1]).select("vec_id", "cluster")


@query()
def tsne_places(spark, sf_dir):
    """The map is of a pool of 2,000 templates at most, drawn by label; all rows get their place on it."""
    wide = _wide(spark, sf_dir)
    pool = templates.extract_templates(wide.withColumns({"group": F.lit("all"), "sequence": F.col("label").cast("string")}), 2_000, _FEATURES)
    points = pool.select(*_FEATURES).toPandas().to_numpy()
    return models.tsne_map(wide, _FEATURES, points, models.tsne(points, 20.0)).select("vec_id", "label", "tsne_x", "tsne_y")


@query(f"""{_NEAR}, n AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM c GROUP BY ALL), a AS (SELECT label, sum(n) AS n FROM n GROUP BY label), b AS (SELECT cluster, sum(n) AS n FROM n GROUP BY cluster), t AS (SELECT sum(n) AS n FROM n),
h AS (SELECT (SELECT -sum(a.n / t.n * ln(a.n / t.n)) FROM a, t) AS ha, (SELECT -sum(b.n / t.n * ln(b.n / t.n)) FROM b, t) AS hb, (SELECT sum(n.n / t.n * ln(t.n * n.n / (a.n * b.n))) FROM n JOIN a USING (label) JOIN b USING (cluster), t) AS mi,
  (SELECT sum(n * (n - 1) / 2) FROM n) AS pn, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb, (SELECT n * (n - 1) / 2 FROM t) AS pt, (SELECT sum(m) FROM (SELECT max(n) AS m FROM n GROUP BY label)) AS top, (SELECT n FROM t) AS n),
lm AS (SELECT label, coalesce(max(n) FILTER (cluster = 0), 0) AS n0, coalesce(max(n) FILTER (cluster = 1), 0) AS n1, coalesce(max(n) FILTER (cluster = 2), 0) AS n2 FROM n GROUP BY label),
ma AS (SELECT max(p.n0 + q.n1 + s.n2) AS m FROM lm p JOIN lm q ON p.label <> q.label JOIN lm s ON s.label <> p.label AND s.label <> q.label),
ek AS (SELECT a.n AS x, b.n AS y, t.n AS n, unnest(range(CAST(greatest(1, a.n + b.n - t.n) AS BIGINT), CAST(least(a.n, b.n) AS BIGINT) + 1))::DOUBLE AS k FROM a, b, t),
em AS (SELECT sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS emi FROM ek),
v AS (SELECT 'ami' AS measure, (mi - emi) / ((ha + hb) / 2 - emi) AS value FROM h, em UNION ALL SELECT 'matched_accuracy', m / n FROM h, ma UNION ALL SELECT 'homogeneity' AS measure, mi / ha AS value FROM h UNION ALL SELECT 'completeness', mi / hb FROM h UNION ALL SELECT 'v_measure', 2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb) FROM h UNION ALL SELECT 'ari', (pn - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt) FROM h UNION ALL SELECT 'purity', (SELECT sum(m) FROM (SELECT max(n) AS m FROM n GROUP BY cluster)) / n FROM h)
SELECT measure, {r('value')} AS value FROM v""")
def cluster_agreement(spark, sf_dir):
    near = models.nearest_centroid(_wide(spark, sf_dir), _FEATURES, np.array(_CENTERS)).select(F.lit("g").alias("group"), F.lit("s").alias("sequence"), F.col("vec_id").alias("frame"), "cluster", "label")
    found = models.dataset_agreement(near.drop("label"), near.drop("cluster"))["metrics"]
    return spark.createDataFrame([(k, float(found[k])) for k in ("ami", "matched_accuracy", "homogeneity", "completeness", "v_measure", "ari", "purity")], "measure string, value double")


@query(f"""{WITH_TRACKS}, c AS (SELECT grp, seq, count(*) AS n FROM t GROUP BY grp, seq), a AS (SELECT *, sum(n) OVER () AS total FROM c), b AS (SELECT *, least(floor(n * (300e0 / total)), least(300, n)) AS q, least(300, n) AS most FROM a),
d AS (SELECT *, sum(q) OVER () AS given, sum(CASE WHEN q < most THEN n END) OVER () AS room FROM b), e AS (SELECT *, CASE WHEN total <= 300 THEN n WHEN q < most THEN least(q + floor(n * ((300 - given) / room)), most) ELSE q END AS quota FROM d)
SELECT {ENTRY_SQL}, CAST(quota AS BIGINT) AS n, {r('quota / sum(quota) OVER ()')} AS share FROM e WHERE quota > 0""")
def template_provenance(spark, sf_dir):
    return templates.provenance(templates.extract_templates(_thin(tracks(spark, sf_dir)).drop("time"), 300, ["X", "Y"]))


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {r('x')} AS "X" FROM t""")
def trimmed_rows(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "X")
    return scope.core(scope.manifest([t], 4)).drop("origin")


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, count(*) AS n_rows, CASE WHEN max(frame) >= 10 THEN 'new' ELSE 'old' END AS state FROM t GROUP BY grp, seq""")
def replaced_index(spark, sf_dir):
    rows = tracks(spark, sf_dir).groupBy("group", "sequence").agg(F.count("*").alias("n_rows"), F.max("frame").alias("last"))
    old, new = rows.withColumn("state", F.lit("old")), rows.where("last >= 10").withColumn("state", F.lit("new"))
    return writers.append_index(old.drop("last"), new.drop("last"), ["group", "sequence"])


@query()
def template_rows(spark, sf_dir):
    return templates.extract_templates(_thin(tracks(spark, sf_dir)).drop("time"), 300, ["X", "Y"])


# ---- kernels over tracks


def _fill_sql(source: str, columns: dict[str, str]) -> str:
    """CTE q: for each column of `source` its value v, row p and count n of the track, and (v0, p0), (v1, p1) of the last
    and next known value."""
    parts = [f"{e} AS v_{c}" for c, e in columns.items()]
    at = "last_value(CASE WHEN v_{c} IS NOT NULL THEN {e} END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS {o}0_{c}, first_value(CASE WHEN v_{c} IS NOT NULL THEN {e} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {o}1_{c}"
    known = ", ".join(at.format(c=c, e=e, o=o) for c in columns for e, o in ((f"v_{c}", "v"), ("p", "p")))
    return f"""g0 AS (SELECT *, row_number() OVER ({WIN}) AS p, count(*) OVER (PARTITION BY grp, seq, id) AS n, {', '.join(parts)} FROM {source}), q AS (SELECT *, {known} FROM g0 WINDOW w AS ({WIN}))"""


def _between_sql(c: str, limit: int | None = None, both: bool = True) -> str:
    value = f"coalesce(v0_{c} + (v1_{c} - v0_{c}) * (p - p0_{c}) / nullif(p1_{c} - p0_{c}, 0), v0_{c}{f', v1_{c}' if both else ''})"
    near = f"p - p0_{c} <= {limit}" + (f" OR p1_{c} - p <= {limit}" if both else "")
    return f"coalesce(v_{c}, {value if limit is None else f'CASE WHEN {near} THEN {value} END'})"


def _savgol_sql(c: str, arr: str, window: int, polyorder: int) -> str:
    """Savitzky-Golay of the list `arr` of a track's values at its row p of n, where c is known; the ends are fitted once each."""
    basis = np.vander(np.arange(window) - window // 2, polyorder + 1, increasing=True).astype(float)
    smooth, half = basis @ np.linalg.pinv(basis), window // 2
    fit = lambda row, start: "(" + " + ".join(f"({smooth[row, j]:.17e}) * coalesce({arr}[CAST({start} AS BIGINT) + {j}], 0)" for j in range(window)) + ")"
    ends = " ".join(f"WHEN p = {i + 1} THEN {fit(i, '1')} WHEN p = n - {i} THEN {fit(window - 1 - i, f'n - {window - 1}')}" for i in range(half))
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN n < {window} THEN {c} {ends} ELSE {fit(half, f'p - {half}')} END"


_BAD = f"""{WITH_TRACKS}, j AS (SELECT *, CASE WHEN sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) > 60 THEN 1 ELSE 0 END AS j FROM t WINDOW w AS ({WIN})),
bd AS (SELECT *, max(j) OVER ({WIN} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS bad FROM j), {_fill_sql('bd', {'x': 'CASE WHEN NOT bad THEN x END', 'y': 'CASE WHEN NOT bad THEN y END'})},
fi AS (SELECT *, {_between_sql('x')} AS fx, {_between_sql('y')} AS fy FROM q), li AS (SELECT *, list(fx) OVER w AS lx, list(fy) OVER w AS ly FROM fi WINDOW w AS ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"""{_BAD} SELECT {ENTRY_SQL}, id, frame, {r('fx')} AS "X", {r('fy')} AS "Y", bad AS bad_frame FROM fi""")
def trajectory_filled(spark, sf_dir):
    return kinematics.trajectory_smooth(_thin(tracks(spark, sf_dir)), 60.0, expand=1).drop("time", "ANGLE")


@query(f"""{_BAD} SELECT {ENTRY_SQL}, id, frame, {r('tm')} AS "time", {r('a')} AS "ANGLE", bad AS bad_frame, {r(_savgol_sql('fx', 'lx', 5, 2))} AS "X", {r(_savgol_sql('fy', 'ly', 5, 2))} AS "Y" FROM li""")
def trajectory_smooth(spark, sf_dir):
    return kinematics.trajectory_smooth(_thin(tracks(spark, sf_dir)), 60.0, expand=1, savgol_window=5)


@query(f"""{_SPEED}, k AS (SELECT *, row_number() OVER ({WIN}) AS p, count(*) OVER (PARTITION BY grp, seq, id) AS n, list(speed) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM s)
SELECT {ENTRY_SQL}, id, frame, {r('speed')} AS speed, {r(_savgol_sql('speed', 'l', 5, 2))} AS speed_smooth FROM k""")
def speed_smooth(spark, sf_dir):
    out = kinematics.speed_angvel(_thin(tracks(spark, sf_dir)), fps=FPS, smooth_window=5)
    return out.select("group", "sequence", "id", "frame", "speed", "speed_smooth")


@query(f"""{WITH_TRACKS}, k AS (SELECT *, row_number() OVER ({WIN}) AS p, count(*) OVER (PARTITION BY grp, seq, id) AS n, list(x) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM t)
SELECT {ENTRY_SQL}, id, frame, {r('list_avg(list_transform(range(-2, 3), lambda o: l[CASE WHEN p + o < 1 THEN 2 - p - o WHEN p + o > n THEN 2 * n - p - o ELSE p + o END]))')} AS averaged FROM k WHERE n > 2""")
def moving_average(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "X")
    rows = F.count(F.lit(1)).over(Window.partitionBy("group", "sequence", "id"))
    return with_moving_average(t, {"averaged": "X"}, 5).withColumn("n", rows).where("n > 2").drop("X", "n")


def _kernel(sigma: float, truncate: float) -> tuple[int, str]:
    half = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return half, "[" + ", ".join(f"{v:.17e}" for v in k / k.sum()) + "]"


def _stack_sql() -> str:
    pool_sigma = max(1.0, 0.5 * FPS / 6)
    window = max(1, round(0.5 * FPS))
    (h, ker), (ph, pker) = _kernel(1.0, 4.0), _kernel(pool_sigma, max(1.0, window / (2 * pool_sigma)))
    conv = lambda arr, half, kernel, at: f"list_sum(list_transform(range({-half}, {half + 1}), lambda o: ({kernel})[o + {half + 1}] * {arr}[least(greatest({at} + o, 1), n)]))"
    lists = ", ".join(f"list({e}) OVER w AS l{c}" for c, e in (("x", "x"), ("y", "y"), ("xx", "x * x"), ("yy", "y * y")))
    outs = [f'{r(conv(f"l{c}", h, ker, f"least(greatest(p + ({o}), 1), n)"))} AS "{n}__t{o:+03d}"' for o in range(-4, 5, 2) for c, n in (("x", "X"), ("y", "Y"))]
    pools = ", ".join(f"{conv(f'l{c}', ph, pker, 'p')} AS m{c}, {conv(f'l{c}{c}', ph, pker, 'p')} AS s{c}" for c in "xy")
    outs += [f'{r(e.format(c=c))} AS "{n}__pool_{k}"' for k, e in (("mean", "m{c}"), ("std", "sqrt(greatest(s{c} - m{c} * m{c}, 0))"), ("var", "greatest(s{c} - m{c} * m{c}, 0)")) for c, n in (("x", "X"), ("y", "Y"))]
    return f"""{WITH_TRACKS}, k AS (SELECT *, row_number() OVER ({WIN}) AS p, count(*) OVER (PARTITION BY grp, seq, id) AS n, {lists} FROM t WINDOW w AS ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, {pools} FROM k) SELECT {ENTRY_SQL}, id, frame, {r('tm')} AS "time", {', '.join(outs)} FROM m"""


@query(_stack_sql())
def temporal_stack(spark, sf_dir):
    return kernels.temporal_stack(_thin(tracks(spark, sf_dir)), ["X", "Y"], 4, 2, 1.0, pool_stats=("mean", "std", "var"), fps=FPS)


_BANDS = (1.0, 4.0, 3)


def _wavelet_sql() -> str:
    """Convolutions of each track's lists with the kernels as literal lists, at frequencies that keep them short."""
    weights = [kernels.morlet_kernel(FPS / f) for f in kernels.frequencies(*_BANDS)]
    literal = lambda v: "[" + ", ".join(f"{x:.17e}" for x in v) + "]::DOUBLE[]"
    lists = ", ".join(f"{literal(part)} AS {c}{i}" for i, k in enumerate(weights) for c, part in (("re", k.real), ("im", k.imag)))

    def part(c: str, i: int, kind: str) -> str:
        middle = len(weights[i]) // 2
        first, last = f"greatest(1, p - {middle})", f"least(n, p + {len(weights[i]) - 1 - middle})"
        return f"list_sum(list_transform(range({first}, {last} + 1), lambda j: {kind}{i}[j - p + {middle + 1}] * l{c}[j]))"

    outs = [f"""{r(f"CAST(greatest(ln(power + 2.2250738585072014e-308), -3) AS FLOAT)").replace('power', f'({part(c, i, "re")} ^ 2 + {part(c, i, "im")} ^ 2)')} AS "W_{c.upper()}_f{i}\"""" for c in "xy" for i in range(len(weights))]
    return f"""{WITH_TRACKS}, ke AS (SELECT {lists}), k AS (SELECT *, row_number() OVER ({WIN}) AS p, count(*) OVER (PARTITION BY grp, seq, id) AS n, list(x) OVER w AS lx, list(y) OVER w AS ly FROM t WINDOW w AS ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT {ENTRY_SQL}, id, frame, {r('tm')} AS "time", {', '.join(outs)} FROM k, ke"""


@query(_wavelet_sql())
def track_wavelet(spark, sf_dir):
    return kernels.pair_wavelet(_thin(tracks(spark, sf_dir)), ["X", "Y"], FPS, *_BANDS)


@query(rounded=False)
def pair_wavelet(spark, sf_dir):
    # 375 values a row, which take more disk as rounded doubles.
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = pairs.position_sides(_thin(tracks(spark, sf_dir)).drop("time"), FPS, partitions=dealt)
    return kernels.pair_wavelet(sides, list(pairs.PAIR_FEATURES), FPS, views=pairs.VIEWS)


@query()
def pose_distance_pca(spark, sf_dir):
    from .joins import pairs as pair_rows

    t = tracks(spark, sf_dir)
    points = [(f"poseX{i}", f"poseY{i}") for i in range(POINTS)]
    # (A, B) is perspective 0 and (B, A) is 1; both are fitted.
    both = pair_rows(t, [c for p in points for c in p], ordered=True)
    out = models.pair_distance_pca(both, points)
    ids = F.least("id_A", "id_B").alias("id1"), F.greatest("id_A", "id_B").alias("id2")
    return out.select("group", "sequence", "frame", *ids, *[f"PC{i}" for i in range(6)], (F.col("id_A") > F.col("id_B")).cast("int").alias("perspective"))


@query()
def syllables(spark, sf_dir):
    t = _thin(tracks(spark, sf_dir)).drop("time")
    return models.arhmm_decode(t, ["X", "Y"], models.arhmm_fit(t, ["X", "Y"], 3))


_CLEAN = {c: f"coalesce(v_{c}, CASE WHEN v0_{c} IS NOT NULL AND v1_{c} IS NOT NULL THEN {_between_sql(c, 2)} ELSE {_between_sql(c, 1)} END)" for c in "xy"}


@query(f"""{WITH_TRACKS}, {_fill_sql('t', {'x': 'CASE WHEN event_id % 4 <> 0 THEN x END', 'y': 'CASE WHEN event_id % 3 <> 0 THEN y END'})}, c AS (SELECT *, {_CLEAN['x']} AS cx, {_CLEAN['y']} AS cy FROM q), d AS (SELECT * FROM c WHERE cx IS NOT NULL OR cy IS NOT NULL)
SELECT {ENTRY_SQL}, id, frame, {', '.join(f'{r(f"coalesce(c{c}, median(c{c}) OVER (PARTITION BY grp, seq, id))")} AS "{c.upper()}"' for c in 'xy')} FROM d""")
def cleaned_tracks(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", F.when(F.col("event_id") % 4 != 0, F.col("X")).alias("X"), F.when(F.col("event_id") % 3 != 0, F.col("Y")).alias("Y"))
    return kinematics.clean_tracks(t, ["X", "Y"], 2, 1)


_SURE = {f"{c}{k}": f"CASE WHEN event_id * {k + 3} % 10 >= 6 THEN p{c}{k} END" for k in range(POINTS) for c in "xy"}


@query(f"""{WITH_TRACKS}, {_fill_sql('t', _SURE)} SELECT {ENTRY_SQL}, id, frame, {', '.join(f'{r(_between_sql(c, 1, both=False))} AS "pose{c[0].upper()}{c[1:]}"' for c in _SURE)} FROM q""")
def confidence_filter(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumns({f"poseP{k}": F.col("event_id") * (k + 3) % 10 / 10.0 for k in range(POINTS)})
    out = kinematics.confidence_filter(t, 0.6, 1)
    return out.select("group", "sequence", "id", "frame", *[f"pose{c}{k}" for k in range(POINTS) for c in "XY"])


@query(f"""{_SOCIAL}, rw AS (SELECT s.*, e.event_id, row_number() OVER (PARTITION BY s.grp, s.seq, s.id ORDER BY s.frame) AS p FROM so s JOIN t e ON s.grp = e.grp AND s.seq = e.seq AND s.id = e.id AND s.frame = e.frame),
ow AS (SELECT *, CASE WHEN event_id % 3 >= 1 THEN event_id % 3 ELSE 2 END AS k FROM rw)
SELECT a.grp AS "group", a.seq AS "sequence", a.id, a.frame, {r('b.x - a.x')} AS dx, {r('b.y - a.y')} AS dy, {r(f'a.k / {FPS}')} AS dt, {r(f"{wrap('b.a - a.a')} / a.k * {FPS}")} AS dangle, {r('b.speed - a.speed')} AS dspeed
FROM ow a JOIN ow b ON a.grp = b.grp AND a.seq = b.seq AND a.id = b.id AND b.p = a.p + a.k WHERE b.frame - a.frame = a.k""")
def variable_lag_response(spark, sf_dir):
    lags = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", (F.col("event_id") % 3).alias("lag"))
    t = _social(spark, sf_dir).join(lags, ["group", "sequence", "id", "frame"])
    return kinematics.nn_delta_response(t, 2, FPS, lag_column="lag").select("group", "sequence", "id", "frame", "dx", "dy", "dt", "dangle", "dspeed")


@query(f"""{_SPEED}, e AS (SELECT grp, seq, frame, arg_max(event_id % 4, event_id) AS label FROM t WHERE y > 30 AND id <= (id + 1) % 8 GROUP BY grp, seq, frame)
SELECT s.grp AS "group", s.seq AS "sequence", s.id, s.frame, {r('s.tm')} AS "time", {r('s.x')} AS "X", {r('s.speed')} AS "speed", {r('s.x')} AS "X-1", coalesce(label, 0) AS "labels-high" FROM s LEFT JOIN e USING (grp, seq, frame) WHERE s.frame >= 1 AND s.frame < 4""")
def loaded_values(spark, sf_dir):
    t = _thin(tracks(spark, sf_dir))
    ids = F.col("id").alias("id1"), ((F.col("id") + 1) % 8).alias("id2")
    events = tracks(spark, sf_dir).where("Y > 30").select("group", "sequence", "frame", (F.col("event_id") % 4).alias("label"), F.col("event_id").alias("event"), *ids)
    speed = kinematics.speed_angvel(t, fps=FPS)
    sources = [values.Values(t, "X"), values.Values(speed, "speed"), values.Values(t, "X"), values.Labels(events, "high")]
    return values.load_values(sources, fps=FPS, start_frame=1, end_time=4 / FPS)


@query(f"""{WITH_TRACKS}, v AS (SELECT grp, seq, frame, event_id, event_id % 4 AS label, id % 2 AS a, CASE WHEN event_id % 3 > 0 THEN id % 3 END AS b FROM t)
SELECT {ENTRY_SQL}, CASE WHEN b IS NULL THEN a ELSE least(a, b) END AS id1, CASE WHEN b IS NOT NULL THEN greatest(a, b) END AS id2, frame, arg_max(label, event_id) AS label FROM v GROUP BY ALL""")
def last_labels(spark, sf_dir):
    pair = (F.col("id") % 2).alias("id1"), F.when(F.col("event_id") % 3 > 0, F.col("id") % 3).alias("id2")
    events = tracks(spark, sf_dir).select("group", "sequence", "frame", "event_id", (F.col("event_id") % 4).alias("label"), *pair)
    return summaries.last_labels(events, "label", "event_id")


_HELD = """SELECT grp, seq, id AS id1, frame, CASE WHEN event_id % 3 = 2 THEN 'rest' ELSE 'walk' END AS name, CASE WHEN event_id % 3 = 2 THEN 2 ELSE 1 END AS label, frame + unnest(range(0, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 1 END)) AS f FROM t WHERE event_id % 3 > 0"""


@query(f"""{WITH_TRACKS}, h AS ({_HELD}) SELECT {ENTRY_SQL}, f AS frame, label, name, id1, CAST(-1 AS BIGINT) AS id2, count(*) AS n FROM h GROUP BY ALL""")
def converted_labels(spark, sf_dir):
    """Label files, one a sequence, as Spark would read them from a folder, through the label conversion."""
    t = tracks(spark, sf_dir)
    behaviour = F.element_at(F.array(F.lit("fly"), F.lit("walk"), F.lit("rest")), (F.col("event_id") % 3 + 1).cast("int"))
    kind, last = F.when(F.col("event_id") % 2 == 0, "STATE").otherwise("POINT"), F.col("frame") + 2
    line = F.concat_ws("\t", F.lit("o"), F.concat(F.lit("s"), "id"), behaviour, kind, (F.col("frame") / 4).cast("string"), (last / 4).cast("string"), F.lit("4"))
    head = "\t".join(["Observation id", "Subject", "Behavior", "Behavior type", "Start (s)", "Stop (s)", "FPS"])
    files = t.groupBy("group", "sequence").agg(F.concat_ws("\n", F.lit(head), F.collect_list(line)).cast("binary").alias("content"))
    index = files.select(F.concat_ws("/", "group", "sequence").alias("path"), "*", F.lit("boris_csv").alias("src_format"))
    events, _ = labels.convert_labels(spark, index, labels.converter_of("boris_csv", "behavior"), subjects={f"s{i}": i for i in range(8)}, behaviors=["walk", "rest"])
    return events.groupBy("group", "sequence", "frame", "label", "name", "id1", "id2").agg(F.count("*").alias("n"))


def _box_sql(method: str) -> str:
    """Boxes in an image of 100 by 100 around keypoints that are all known; head 3 and tail 6."""
    ends = {c: (f"least({', '.join(f'p{c}{k}' for k in range(POINTS))})", f"greatest({', '.join(f'p{c}{k}' for k in range(POINTS))})") for c in "xy"}
    pad = {c: f"({b} - {a}) * 0.1e0" for c, (a, b) in ends.items()} if method == "tight" else dict.fromkeys("xy", "greatest(len * 0.3e0, 20e0)")
    low, high = {c: f"{ends[c][0]} - {pad[c]}" for c in "xy"}, {c: f"{ends[c][1]} + {pad[c]}" for c in "xy"}
    if method == "oriented":
        side = {"x": ("hx", "-uy"), "y": ("hy", "ux")}
        at = {c: [f"(p{c}{p} + {s} * u{c} * 0.25e0 * len + {t} * {side[c][1]} * 0.35e0 * len)" for p, s in ((3, 1), (6, -1)) for t in (1, -1)] for c in "xy"}
        low, high = ({c: f"CASE WHEN len > 1e-6 THEN {f}({', '.join(at[c])}) ELSE {plain[c]} END" for c in "xy"} for f, plain in (("least", low), ("greatest", high)))
    a, b = {c: f"greatest({low[c]}, 0e0)" for c in "xy"}, {c: f"least({high[c]}, 100e0)" for c in "xy"}
    share = lambda e: r(f"least(greatest({e}, 0e0), 1e0)")
    outs = [f"{share(f'({a[c]} + {b[c]}) / 2 / 100')} AS box_c{c}" for c in "xy"] + [f"{share(f'({b[c]} - {a[c]}) / 100')} AS box_{n}" for c, n in (("x", "w"), ("y", "h"))]
    return f"SELECT {ENTRY_SQL}, id, frame, '{method}' AS method, {', '.join(outs)} FROM g"


_AXIS = "g AS (SELECT *, sqrt((px3 - px6) ^ 2 + (py3 - py6) ^ 2) AS len, (px3 - px6) / nullif(sqrt((px3 - px6) ^ 2 + (py3 - py6) ^ 2), 0) AS ux, (py3 - py6) / nullif(sqrt((px3 - px6) ^ 2 + (py3 - py6) ^ 2), 0) AS uy FROM t)"


@query(f"{WITH_TRACKS}, {_AXIS} " + " UNION ALL ".join(map(_box_sql, ("tight", "isotropic", "oriented"))))
def keypoint_boxes(spark, sf_dir):
    t = tracks(spark, sf_dir)
    keys = ["group", "sequence", "id", "frame"]
    each = [boxes.keypoint_boxes(t, 100, 100, m, head=3, tail=6).select(*keys, F.lit(m).alias("method"), *boxes.BOX) for m in ("tight", "isotropic", "oriented")]
    return each[0].union(each[1]).union(each[2])


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {r('CASE WHEN px3 <> px6 OR py3 <> py6 THEN atan2(py3 - py6, px3 - px6) END')} AS heading FROM t""")
def heading_of_points(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return t.select("group", "sequence", "id", "frame", heading_between(F.col("poseX3"), F.col("poseY3"), F.col("poseX6"), F.col("poseY6")).alias("heading"))


@query(f"""{WITH_TRACKS}, d AS (SELECT *, dense_rank() OVER (PARTITION BY grp, seq ORDER BY frame) AS g FROM t)
SELECT {ENTRY_SQL}, id, frame, {', '.join(f'{r(f"CASE WHEN count({c}) OVER w >= 2 THEN median({c}) OVER w END")} AS "{n}"' for c, n in [("x", "X"), ("y", "Y"), *((f"p{a}{k}", f"pose{a.upper()}{k}") for k in range(POINTS) for a in "xy")])}
FROM d WINDOW w AS (PARTITION BY grp, seq, id ORDER BY g RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def movement_smooth(spark, sf_dir):
    return kinematics.movement_smooth(tracks(spark, sf_dir).drop("time", "ANGLE", "event_id"), 5, least=2)


@query(f"""{_SPEED}, c AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, avg(speed) OVER w AS ms, atan2(avg(sin(a)) OVER w, avg(cos(a)) OVER w) AS h FROM s WINDOW w AS (PARTITION BY grp, seq, frame))
SELECT {ENTRY_SQL}, id, frame, {r('sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))')} AS distance_from_centroid, {r('(x - cx) * cos(h) + (y - cy) * sin(h)')} AS xrot_to_centroid, {r('(y - cy) * cos(h) - (x - cx) * sin(h)')} AS yrot_to_centroid, {r('speed - ms')} AS dev_speed_to_mean FROM c""")
def centroid_frame(spark, sf_dir):
    t = _thin(tracks(spark, sf_dir))
    speed = kinematics.speed_angvel(t, fps=FPS).select("group", "sequence", "id", "frame", "speed")
    both = align([t.drop("time"), speed], check=False)
    return groups.centroid_frame(both, None, "speed", "ANGLE").select("group", "sequence", "id", "frame", "distance_from_centroid", "xrot_to_centroid", "yrot_to_centroid", "dev_speed_to_mean")


@query(f"""{WITH_TRACKS}, b AS (SELECT *, (frame - min(frame) OVER (PARTITION BY grp, seq)) // 4 AS ch FROM t), c AS (SELECT *, count(*) OVER w AS gs, x - avg(x) OVER w AS rx, y - avg(y) OVER w AS ry FROM b WINDOW w AS (PARTITION BY grp, seq, frame)), d AS (SELECT *, sqrt(rx * rx + ry * ry) AS dc FROM c),
k AS (SELECT *, count(*) OVER (PARTITION BY grp, seq, frame ORDER BY round(dc, 9) RANGE UNBOUNDED PRECEDING) = gs AS outermost, CASE WHEN gs = lag(gs) OVER (PARTITION BY grp, seq, id, ch ORDER BY frame) THEN 0 ELSE 1 END AS nw FROM d),
s AS (SELECT *, sum(nw) OVER (PARTITION BY grp, seq, id, ch ORDER BY frame ROWS UNBOUNDED PRECEDING) AS stay FROM k), u AS (SELECT grp, seq, ch, id, gs, stay, max(frame) - min(frame) + 1 AS len, count(*) AS n, count(*) FILTER (outermost) AS o, min(frame) AS f0, max(frame) AS f1 FROM s GROUP BY ALL),
v AS (SELECT grp, seq, ch, id, gs, sum(n) AS n, avg(len) AS av, median(len) AS md, sum(o) AS o, min(f0) AS f0, max(f1) AS f1 FROM u GROUP BY ALL)
SELECT {ENTRY_SQL}, ch AS chunk_id, min(f0) OVER (PARTITION BY grp, seq, ch) AS chunk_start_frame, max(f1) OVER (PARTITION BY grp, seq, ch) AS chunk_end_frame, id, gs AS group_size, {r('n / sum(n) OVER (PARTITION BY grp, seq, ch, id)')} AS fractime_norm2, {r('av')} AS avg_duration_frame, {r('md')} AS med_duration_frame, {r('o / n')} AS ftime_periphery, {r('o / n * gs')} AS ftime_periphery_norm FROM v""")
def fission_fusion_chunks(spark, sf_dir):
    return groups.fission_fusion_metrics(_thin(tracks(spark, sf_dir)), frames=4)


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, frame, event_id % 4 AS label, id AS id1, (id + 1) % 8 AS id2 FROM t WHERE frame = 2""")
def labels_at_frame(spark, sf_dir):
    events = tracks(spark, sf_dir).select("group", "sequence", "frame", (F.col("event_id") % 4).alias("label"), F.col("id").alias("id1"), ((F.col("id") + 1) % 8).alias("id2"))
    return summaries.labels_at(events, 2)


@query(f"""{WITH_TRACKS} (SELECT DISTINCT {ENTRY_SQL} FROM t WHERE frame >= 8) INTERSECT (SELECT DISTINCT {ENTRY_SQL} FROM t WHERE x > 95 AND y > 60)""")
def common_entries(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return scope.common_entries([t.where("frame >= 8"), t.where("X > 95 and Y > 60")])


@query(f"""{WITH_TRACKS} SELECT {ENTRY_SQL}, id, frame, {r('x')} AS "X", CAST(NULL AS DOUBLE) AS "Y" FROM t WHERE id < 4 UNION ALL SELECT grp, seq, id, frame, NULL, {r('y')} FROM t WHERE id >= 4""")
def united_columns(spark, sf_dir):
    t = tracks(spark, sf_dir).select("group", "sequence", "id", "frame", "X", "Y")
    return readers.union_by_columns([t.where("id < 4").drop("Y"), t.where("id >= 4").drop("X")])


@query()
def alpha_areas(spark, sf_dir):
    t = tracks(spark, sf_dir)
    points = t.groupBy("group", "sequence", "frame").agg(F.collect_set(F.struct(F.col("X").alias("x"), F.col("Y").alias("y"))).alias("p"))
    shape = points.withColumn("s", kernels.alpha_shape(F.col("p"), 40.0))
    return shape.select("group", "sequence", "frame", "s.area", "s.n_triangles")


_GT = f"SELECT grp, seq, frame, event_id % 4 AS label, id AS id1, (id + 1) % 8 AS id2 FROM t"


@query(f"{WITH_TRACKS}, ev AS ({_GT}) SELECT {ENTRY_SQL}, frame, label, id1, id2 FROM ev WHERE (id1 = 3 OR id2 = 3) AND frame >= 1 AND frame <= 4")
def labels_of_individual(spark, sf_dir):
    events = tracks(spark, sf_dir).select("group", "sequence", "frame", (F.col("event_id") % 4).alias("label"), F.col("id").alias("id1"), ((F.col("id") + 1) % 8).alias("id2"))
    return summaries.labels_of(events, 3, 1, 4)
