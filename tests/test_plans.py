"""Manifests with edge rows, template strategies, quantile categories, and what becomes of steps that fail or are cancelled."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.ml import templates
from trackloom.operators import summaries
from trackloom.plans import scope
from trackloom.plans.catalog import Catalog
from trackloom.plans.pipeline import Pipeline

TRACK = "`group` string, sequence string, id long, frame long, X double, Y double"


def tracks(spark, sequences="abc", frames=5):
    return spark.createDataFrame([("g", s, 0, f, float(10 * i + f), 0.0) for i, s in enumerate(sequences) for f in range(frames)], TRACK)


def test_manifest_adds_edges_and_core_trims(spark):
    t = tracks(spark)
    doubled = t.select("group", "sequence", "id", "frame", (F.col("X") * 2).alias("X2")).where("not (sequence = 'c' and frame = 0)")
    m = scope.manifest([t, doubled], 2)
    rows = sorted((r["sequence"], r["origin"], r["frame"], r["is_core"], r["X2"]) for r in m.collect())
    assert [r[:3] for r in rows if not r[3]] == [("a", "b", 0), ("a", "b", 1), ("b", "a", 3), ("b", "a", 4), ("b", "c", 1), ("b", "c", 2), ("c", "b", 3), ("c", "b", 4)]
    assert sum(r[3] for r in rows) == 14
    bounds = {r["sequence"]: (r["core_start"], r["core_end"]) for r in scope.core_bounds(m).collect()}
    assert bounds == {"a": (0, 5), "b": (2, 7), "c": (2, 6)}
    assert scope.core(m).count() == 14 and scope.manifest([t], 1, sequences=["a", "c"], where="frame > 0").where("not is_core").count() == 2


def test_smoothing_over_a_manifest_sees_across_sequences(spark):
    m = scope.manifest([tracks(spark, "ab", 4)], 1).withColumn("step", F.col("X"))
    own = m.groupBy("sequence").agg(F.max("X").alias("most")).collect()
    assert {r["sequence"]: r["most"] for r in own} == {"a": 10.0, "b": 13.0}


def points(spark, n=600):
    rng = np.random.default_rng(6)
    rows = [("g", "ab"[i % 2], 0, i, *map(float, rng.normal(size=2) + (100.0 if i == 7 else 0.0))) for i in range(n)]
    return spark.createDataFrame(rows, TRACK)


def test_farthest_first_templates_cover_what_random_ones_miss(spark):
    df = points(spark)
    far = templates.extract_templates(df, 600, ["X", "Y"], strategy="farthest_first", templates=12)
    got = far.collect()
    assert len(got) == 12 and any(r["frame"] == 7 for r in got)
    xy = np.array([[r["X"], r["Y"]] for r in got])
    gap = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2) + np.diag(np.full(12, np.inf)))
    drawn = np.array([[r["X"], r["Y"]] for r in templates.extract_templates(df, 600, ["X", "Y"], templates=12).collect()])
    other = np.sqrt(((drawn[:, None] - drawn[None]) ** 2).sum(2) + np.diag(np.full(12, np.inf)))
    assert gap.min() > 2 * other.min()
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, got))
    with pytest.raises(ValueError):
        templates.extract_templates(df, 600, ["X", "Y"], strategy="farthest_first")


def test_quotas_are_met_exactly_though_few_rows_leave_their_task(spark):
    df = spark.range(40_000).select(F.lit("g").alias("group"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("sequence"), F.col("id").alias("frame"), F.rand(1).alias("v"))
    got = {r["sequence"]: r["count"] for r in templates.extract_templates(df, 1_000, ["v"]).groupBy("sequence").count().collect()}
    assert got == {"x": 250, "y": 750}


@pytest.mark.parametrize("above", [True, False])
def test_quantile_categories(spark, above):
    rows = [("g", s, 0, f, float(f * f) if f % 7 else None, 0.0) for s in "ab" for f in range(20 + 10 * (s == "b"))]
    df = spark.createDataFrame(rows, TRACK)
    got = {(r["sequence"], r["frame"]): r["fast"] for r in summaries.quantile_category(df, "X", "fast", 0.6, above).collect()}
    for s, n in (("a", 20), ("b", 30)):
        edge = np.quantile([f * f for f in range(n) if f % 7], 0.6)
        assert all(got[s, f] == (f % 7 != 0 and (f * f > edge) == above) for f in range(n))
    near = summaries.quantile_category(df, "X", "fast", 0.6, above, accuracy=1_000).where("fast").count()
    assert abs(near - sum(got.values())) <= 2


def test_failed_step_leaves_no_entry_and_is_in_the_log(spark, tmp_path):
    p = Pipeline(Catalog(spark, str(tmp_path))).add("ok", lambda t: t, ["tracks"], materialise=True)
    p.add("bad", lambda t: t.withColumn("X", F.raise_error(F.lit("no"))), ["ok"], materialise=True)
    with pytest.raises(Exception, match="no"):
        p.run(tracks(spark))
    assert p.catalog.entries(p.run_id("bad")).count() == 0 and p.catalog.entries(p.run_id("ok")).count() == 3
    assert p.status() == {"ok": "cached", "bad": "stale"}
    log = p.catalog.events().collect()
    assert [(r["step"], r["did"]) for r in log] == [("ok", "written"), ("bad", "failed")] and "no" in log[1]["error"]


def test_cancelled_step_leaves_no_half_entry(spark, tmp_path):
    def slow(t):
        def wait(parts):
            for part in parts:
                time.sleep(60)
                yield part

        return t.mapInPandas(wait, t.schema)

    p, caught = Pipeline(Catalog(spark, str(tmp_path))).add("slow", slow, ["tracks"], materialise=True), []

    def run():
        try:
            p.run(tracks(spark))
        except Exception as e:  # noqa: BLE001
            caught.append(e)

    began = time.time()
    thread = threading.Thread(target=run)
    thread.start()
    while thread.is_alive() and time.time() - began < 50:
        time.sleep(2)
        p.cancel(spark, "slow")
    thread.join(70)
    assert caught and time.time() - began < 58
    assert p.catalog.entries(p.run_id("slow")).count() == 0
    assert p.catalog.events().collect()[0]["did"] == "failed"
