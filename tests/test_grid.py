"""Neighbours of large frames by cells, against brute force with NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import grid
from trackloom.operators.neighbours import local_order, nearest_neighbor


def frame(spark, points, group="g"):
    rows = [(group, "s", 0, i, float(x), float(y), 0.1 * (i % 60)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "group string, sequence string, frame long, id long, X double, Y double, ANGLE double")


def shapes(n):
    rng = np.random.default_rng(4)
    dense = np.concatenate([rng.normal(0, 1e-4, (n // 2, 2)), rng.uniform(-50, 50, (n - n // 2, 2))])
    return {
        "even": rng.uniform(0, 100, (n, 2)),
        "a dense spot in a thin crowd": dense,
        "a line": np.stack([np.arange(n) * 0.5, np.full(n, 3.0)], 1),
        "a lattice": np.stack([np.arange(n) % 25, np.arange(n) // 25], 1) * 1.0,
        "copies": rng.integers(0, 5, (n, 2)) * 1.0,
        "one spot": np.zeros((n, 2)),
        "far from zero": 1e7 + rng.uniform(0, 1, (n, 2)),
    }


@pytest.mark.parametrize("shape", list(shapes(8)))
def test_nearest_and_disc_of_a_large_frame(spark, shape):
    p = shapes(400)[shape]
    d2 = ((p[:, None, 0] - p[None, :, 0]) ** 2) + ((p[:, None, 1] - p[None, :, 1]) ** 2)
    off = d2 + np.diag(np.full(len(p), np.inf))
    nearest = {r["id"]: r for r in nearest_neighbor(frame(spark, p)).collect()}
    assert [nearest[i]["nn_id"] for i in range(len(p))] == off.argmin(1).tolist()
    for radius in (0.0, 1.0, 7.5):
        order = {r["id"]: r["n_local_neighbors"] for r in local_order(frame(spark, p), radius).collect()}
        assert [order[i] for i in range(len(p))] == ((d2 <= radius * radius).sum(1) - 1).tolist()


def test_frames_of_any_size_side_by_side_and_rows_without_position(spark):
    p = np.random.default_rng(1).uniform(0, 10, (200, 2))
    many, few, one = frame(spark, p, "many"), frame(spark, p[:5], "few"), frame(spark, p[:1], "one")
    nobody = few.limit(1).withColumns({"id": F.lit(999).cast("long"), "X": F.lit(None).cast("double")})
    rows = {(r["group"], r["id"]): r for r in nearest_neighbor(many.union(few).union(one).union(nobody).union(nobody.withColumn("group", F.lit("many")))).collect()}
    assert len(rows) == 208
    assert [rows["one", 0]["nn_id"], rows["few", 999]["nn_id"], rows["many", 999]["nn_id"]] == [None] * 3
    for group, n in (("many", 200), ("few", 5)):
        d2 = ((p[:n, None] - p[None, :n]) ** 2).sum(2) + np.diag(np.full(n, np.inf))
        assert [rows[group, i]["nn_id"] for i in range(n)] == d2.argmin(1).tolist()


def test_a_frame_of_20000_meets_few_partners(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("g").alias("group"), F.lit("s").alias("sequence"), F.lit(0).cast("long").alias("frame"), "id", (F.rand(3) * 100).alias("X"), (F.rand(5) * 100).alias("Y"), F.lit(0.0).alias("ANGLE"))
    df = spark.createDataFrame(df.toArrow())
    got = nearest_neighbor(df).select("id", "nn_id", "nn_dist").toPandas().set_index("id")
    xy = df.orderBy("id").select("X", "Y").toPandas().to_numpy()
    for i in range(0, n, 500):
        d = np.hypot(*(xy - xy[i]).T)
        d[i] = np.inf
        assert got.loc[i, "nn_id"] == d.argmin() and got.loc[i, "nn_dist"] == pytest.approx(d.min())
    order = local_order(df, 1.0).select("id", "n_local_neighbors").toPandas().set_index("id")["n_local_neighbors"]
    for i in range(0, n, 500):
        assert order[i] == (np.hypot(*(xy - xy[i]).T) <= 1.0).sum() - 1
    placed = grid.placed(df, ["group", "sequence", "frame"], "X", "Y").withColumn("_level", grid.level(F.lit(1.0)))
    met = grid.looking(placed).join(grid.seen(placed, F.array("_level")), grid.CELL).count()
    assert met < 60 * n


def test_thousands_at_one_spot_are_not_paired(spark):
    df = spark.range(30_000).select(F.lit("g").alias("group"), F.lit("s").alias("sequence"), F.lit(0).cast("long").alias("frame"), "id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("X"), F.lit(2.0).alias("Y"))
    got = {r["id"]: r["nn_id"] for r in nearest_neighbor(df).select("id", "nn_id").collect()}
    # 0, 1, 3, 6 and so on share a spot; id 2 is one unit from it.
    assert got[0] == 1 and got[1] == 0 and got[3] == 0 and got[29_997] == 0 and got[2] == 0 and got[29_999] == 29_998


@pytest.mark.parametrize("reach", [0.0, 1e-9, 0.1, 1.0, 33.0, 1e6])
def test_cells_are_as_wide_as_the_reach(spark, reach):
    df = spark.createDataFrame([(64.0, True)], "_extent double, _many boolean").withColumn("level", grid.level(F.lit(reach)))
    at = df.collect()[0]["level"]
    assert 0 <= at <= grid.BITS
    assert at in (0, grid.BITS) or 64 / 2**at >= reach > 64 / 2 ** (at + 1) / (1 + 2 * grid.MARGIN)
