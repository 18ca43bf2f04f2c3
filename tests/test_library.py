import functools
import itertools
import json
import math
import operator
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom import columns, schema, windows
from trackloom.functions import boxes, kernels, numbers
from trackloom.joins import align
from trackloom.ml import models, templates
from trackloom.operators import groups, interactions, kinematics, neighbours, pairs, sampling, summaries
from trackloom.plans import scope, values
from trackloom.plans.catalog import RUNS, Catalog, run_id
from trackloom.plans.pipeline import Pipeline
from trackloom.sources import conversion, readers, writers
from trackloom.streaming import live


def track(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"`group` string, sequence string, id long, frame long, X double, Y double{extra}")


SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]


def test_square_is_polarized_and_milling(spark):
    for angles, want in (((0, 0, 0, 0), ("Polarized", 1, 0)), ((-math.pi / 4, math.pi / 4, 3 * math.pi / 4, -3 * math.pi / 4), ("Milling", 0, 1))):
        df = track(spark, [("g", "s", i, 0, x, y, float(a)) for i, ((x, y), a) in enumerate(zip(SQUARE, angles))], ", ANGLE double")
        r = groups.collective_motion(df, area=True).first()
        assert (r["state"], pytest.approx(r["polarization"], abs=1e-12), pytest.approx(r["rotation_signed"], abs=1e-12)) == want
        assert r["sd_major"] == pytest.approx(1) and r["sd_minor"] == pytest.approx(1) and r["area"] == pytest.approx(4) and r["density"] == pytest.approx(1)


def test_plus_and_ring_local_order(spark):
    plus = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]
    df = track(spark, [("g", "s", i, 0, x, y, 0.0) for i, (x, y) in enumerate(plus)], ", ANGLE double")
    out = {r["id"]: r for r in neighbours.local_order(df, 1.5).collect()}
    assert [out[i]["n_local_neighbors"] for i in range(5)] == [4, 3 + 1 - 1, 3, 3, 3]
    assert [out[i]["shell_index"] for i in range(5)] == [0, 5, 5, 5, 5] and [out[i]["shell_n"] for i in range(5)] == [1, 4, 4, 4, 4]
    assert out[0]["radial_rotation"] is None
    ring = [(1.0, 0.0, math.pi / 2), (0.0, 1.0, math.pi), (0.0, -1.0, 0.0), (-1.0, 0.0, -math.pi / 2)]
    df = track(spark, [("g", "s", i, 0, x, y, a) for i, (x, y, a) in enumerate(ring)], ", ANGLE double")
    assert all(r["local_rotation"] == pytest.approx(1) for r in neighbours.local_order(df, 5.0).collect())


def test_missing_positions_are_nobody(spark):
    df = track(spark, [("g", "s", 0, 0, 0.0, 0.0), ("g", "s", 1, 0, float("nan"), 1.0), ("g", "s", 2, 0, 3.0, 4.0), ("g", "s", 3, 1, 1.0, 1.0)])
    out = {(r["id"], r["frame"]): r for r in neighbours.nearest_neighbor(df).collect()}
    assert out[0, 0]["nn_id"] == 2 and out[0, 0]["nn_dist"] == 5 and out[1, 0]["nn_id"] is None and out[3, 1]["nn_id"] is None
    assert out[0, 0]["nn_ego_unrotated"]


@pytest.mark.parametrize("limit", [None, 2])
def test_interpolation_matches_pandas(spark, limit):
    rng = random.Random(1)
    values = [None, None, None, 1.0, None, None, None, None, None, 7.0, None, None, None, None] + [rng.choice([None, rng.random()]) for _ in range(40)]
    df = track(spark, [("g", "s", 0, i, v, 0.0) for i, v in enumerate(values)])
    got = [r["X"] for r in windows.interpolated(df, ["X"], limit=limit).orderBy("frame").collect()]
    own = pd.Series(values, dtype=float)
    want = own.interpolate(limit=limit, limit_direction="both") if limit else own.interpolate().bfill()
    assert [None if g is None else pytest.approx(g) for g in got] == [None if math.isnan(w) else w for w in want]


def test_groups_match_a_slow_reference(spark):
    rng = random.Random(3)
    rows = [("g", "s", i, f, rng.uniform(0, 100), rng.uniform(0, 100)) for f in range(12) if f != 7 for i in range(6) if rng.random() < 0.9]
    got = {(r["frame"], r["id"]): r for r in groups.fission_fusion(track(spark, rows), 45.0, 3).collect()}
    frames, ids = sorted({r[3] for r in rows}), range(6)
    at = {(r[3], r[2]): r[4:] for r in rows}
    for k, f in enumerate(frames):
        root = {i: i for i in ids}
        for a in ids:
            for b in range(a + 1, 6):
                d = [math.dist(at[g, a], at[g, b]) for g in frames[max(0, k - 1) : k + 2] if (g, a) in at and (g, b) in at]
                if d and sum(d) / len(d) < 45.0:
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
        for i in ids:
            assert got[f, i]["group_membership"] == root[i] and got[f, i]["group_size"] == sum(r == root[i] for r in root.values())
    assert all((r["event"] == -1) or r["event"] >= 0 for r in got.values())


def test_savgol_reproduces_polynomials():
    x = np.arange(30.0)
    for order in (1, 2, 3):
        y = np.polyval(range(1, order + 2), x)
        assert np.allclose(kernels.savgol(y, 7, order), y)
    assert np.allclose(kernels.gaussian(np.ones(50), 3.0), 1)


def test_smoothing_and_stacks(spark):
    df = track(spark, [("g", "s", i, f, f * 1.0 + (50.0 if f == 5 else 0.0), 1.0) for i in range(2) for f in range(20)])
    out = kinematics.trajectory_smooth(df, 20.0, expand=1, savgol_window=5).where("id = 0").orderBy("frame").collect()
    assert [r["frame"] for r in out if r["bad_frame"]] == [4, 5, 6, 7] and all(abs(r["X"] - r["frame"]) < 1e-6 for r in out)
    stacked = kernels.temporal_stack(df, ["X"], 4, 2, 1.0)
    assert {"X__t-04", "X__t+00", "X__t+04", "X__pool_mean"} <= set(stacked.columns) and stacked.count() == 40
    assert kernels.pair_wavelet(df, ["X"], 10.0, n=4).count() == 40
    assert kinematics.nn_delta_response(df.withColumns({"ANGLE": F.lit(0.0), "speed": F.lit(1.0)}), 3, 1.0).count() == 2 * 17
    own = df.withColumns({"ANGLE": F.lit(0.0), "speed": F.lit(1.0), "lag": F.lit(3.2)})
    assert kinematics.nn_delta_response(own, 9, 1.0, lag_column="lag").count() == 2 * 17


@pytest.mark.parametrize("names,n", [(["frame"], 0), (["id", "X"], 1), (["id1", "id2"], 2), (["id_a", "id_b", "id"], 2), (["id1", "X"], 0), (["id", "id1"], 1), (["id_B", "id_A"], 2)])
def test_individuals_of_a_row(names, n):
    assert columns.individuals(names) == n


def test_merge_rule(spark):
    a = track(spark, [("g", "s", 0, 0, 1.0, 2.0)])
    pair = spark.createDataFrame([("g", "s", 0, 0, 1, 5.0)], "`group` string, sequence string, frame long, id1 long, id2 long, ego double")
    with pytest.raises(ValueError):
        align([a, pair])
    with pytest.raises(ValueError):
        align([a.union(a), a.union(a)])
    assert set(align([a, a]).columns) == {*a.columns, "X__1", "Y__1"}


def test_scope_and_overlap(spark):
    df = track(spark, [(g, f"s{s}", 0, f, float(f), 0.0) for g in "ab" for s in range(3) for f in range(5)])
    with pytest.raises(ValueError):
        scope.in_scope(df, groups=[])
    assert scope.in_scope(df, entries=[("a", "s1"), ("b", "s2")]).count() == 10
    wide = scope.with_overlap(df, 2)
    counts = {(r["group"], r["sequence"]): r["count"] for r in wide.where("not is_core").groupBy("group", "sequence").count().collect()}
    assert counts == {(g, s): n for g in "ab" for s, n in (("s0", 2), ("s1", 4), ("s2", 2))}
    assert scope.core(wide).count() == df.count()
    assert scope.query_entries(df, contains="s[12]").count() == 4
    assert columns.parse_entry_key(columns.entry_key("a b", "x__y")) == ("a b", "x__y")


def test_schema_rules(spark):
    df = track(spark, [("g", "s", 0, 0, 1.0, 2.0)])
    assert schema.validate(df, "body_v1").missing
    with pytest.raises(ValueError):
        schema.validate(df, "body_v1", strict=True)
    with pytest.raises(ValueError):
        schema.validate(df.withColumn("SPEED", F.lit(1.0)), "body_v1")
    schema.validate(df.withColumn("SPEED", F.lit(1.0)), "body_v2")
    with pytest.raises(KeyError):
        schema.validate(df, "none")


def test_catalogue_and_pipeline(spark, tmp_path):
    df = track(spark, [(g, "s", 0, f, float(f), 0.0) for g in "ab" for f in range(6)])
    cat = Catalog(spark, str(tmp_path / "cat"))
    p = Pipeline(cat).add("speed", kinematics.speed_angvel, ["tracks"], materialise=True, fps=1.0).add("mean", groups.frame_aggregate, ["speed"], column="speed")
    with pytest.raises(ValueError):
        p.add("bad", groups.frame_aggregate, ["nowhere"])
    first = p.run(df)["mean"].count()
    assert p.status() == {"speed": "cached", "mean": "lazy"} and [x["did"] for x in p.log] == ["written", "planned"]
    assert p.run(df)["mean"].count() == first == 12 and p.log[-2]["did"] == "read"
    assert p.downstream("speed") == {"speed", "mean"}
    run = p.run_id("speed")
    assert cat.resolve("speed") == run and cat.entries(run).count() == 2
    now = spark.createDataFrame([("a", "s", "x"), ("b", "s", None), ("c", "s", None)], "`group` string, sequence string, consumed string")
    assert {r["group"]: r["verdict"] for r in cat.verdicts(run, now).collect()} == {"a": "recompute", "b": "undetectable", "c": "recompute"}
    assert run_id("1", {"b": 1, "a": 2}, []) == run_id("1", {"a": 2, "b": 1}, []) != run_id("1", {"a": 2, "b": 1}, [], scope=[("a", "s")])


def test_templates_and_models(spark):
    rng = np.random.default_rng(0)
    rows = [(g, s, f, *(rng.normal(size=2) + 6 * (f % 3)).tolist(), f % 3) for g, s, n in (("a", "1", 60), ("a", "2", 30), ("b", "1", 90)) for f in range(n)]
    df = spark.createDataFrame(rows, "`group` string, sequence string, frame long, f0 double, f1 double, label int").persist()
    t = templates.extract_templates(df, 60, ["f0", "f1"])
    assert {(r["group"], r["sequence"]): r["n"] for r in templates.provenance(t).collect()} == {("a", "1"): 20, ("a", "2"): 10, ("b", "1"): 30}
    scaled = models.Scaler.fit(df, ["f0", "f1"]).apply(df).agg(F.avg("f0"), F.stddev_pop("f1")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)
    points = df.select("f0", "f1").toPandas().to_numpy()
    labels, centers = models.ward(points, 3)
    assert np.sort(centers[:, 0]).round() == pytest.approx([0, 6, 12], abs=1)
    clustered = models.nearest_centroid(df, ["f0", "f1"], models.kmeans(t, ["f0", "f1"], 3))
    scores = models.agreement(models.contingency(clustered, "label", "cluster").toPandas())
    assert scores["ari"] > 0.95 and scores["matched_accuracy"] > 0.95 and scores["ami"] > 0.9
    assert models.assignment(np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]]))[1].tolist() == [1, 0, 2]
    own = models.fit_classifier(df, ["f0", "f1"], rounds=3)
    got = models.classify(df, own, ["f0", "f1"])
    assert got.where("predicted_label = label").count() / df.count() > 0.95
    assert templates.labelled_templates(df, ["f0", "f1"], 5).groupBy("split", "label").count().where("count > 5").isEmpty()
    assert len(set(templates.farthest_first(points, 10).tolist())) == 10
    assert "PC1" in models.pca(df, ["f0", "f1"], 2).columns
    y = models.tsne(points[:60], 10, 150)
    assert y.shape == (60, 2) and np.isfinite(y).all()
    assert models.tsne_map(df.limit(5), ["f0", "f1"], points[:60], y).count() == 5


def test_arhmm_finds_two_regimes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3):
        x = np.zeros(2)
        for f in range(120):
            slow = (f // 40) % 2 == 0
            x = (0.95 if slow else -0.8) * x + rng.normal(scale=0.3, size=2)
            rows.append(("g", "s", i, f, *x.tolist(), int(slow)))
    df = spark.createDataFrame(rows, "`group` string, sequence string, id long, frame long, a double, b double, truth int").persist()
    model = models.arhmm_fit(df, ["a", "b"], 2, rounds=8, sticky=5.0)
    out = models.arhmm_decode(df, ["a", "b"], model).join(df, ["group", "sequence", "id", "frame"])
    assert models.agreement(models.contingency(out, "truth", "syllable").toPandas())["matched_accuracy"] > 0.85


def test_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("scorer,s,s,s,s,s,s\nbodyparts,n,n,n,t,t,t\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.8\n1,5,6,0.9,,8,0.1\n")
    out = readers.deeplabcut_csv(spark, str(tmp_path / "d.csv"), "g", "s").orderBy("frame").collect()
    assert [(r["frame"], r["id"], r["X"], r["poseP1"]) for r in out] == [(0, 0, 2.0, 0.8), (1, 0, 5.0, 0.1)]
    np.savez(tmp_path / "t_fish3.npz", frame=np.arange(4), time=np.arange(4) / 10, cm_per_pixel=[0.5], X=[1.0, 2.0], Y=np.ones(4))
    out = readers.trex_npz(spark, str(tmp_path / "*.npz"), "g", "s").orderBy("frame").collect()
    assert [r["id"] for r in out] == [3] * 4 and out[0]["X"] == 2.0 and out[3]["X"] is None
    (tmp_path / "c.json").write_text(json.dumps({"g": {"s": {"keypoints": np.ones((3, 2, 2, 7)).tolist(), "annotations": [0, 1, 3]}}}))
    assert readers.calms21_json(spark, str(tmp_path / "c.json")).count() == 6
    assert [r["name"] for r in readers.pair_labels(spark, str(tmp_path / "c.json")).orderBy("frame").collect()] == ["attack", "investigation", "other"]
    (tmp_path / "b.tsv").write_text("Observation id\tSubject\tBehavior\tBehavior type\tStart (s)\tStop (s)\tFPS\no\tm\trun\tSTATE\t0.1\t0.35\t10\no\tf\tjump\tPOINT\t0.5\t0.9\t10\n")
    out = readers.boris_events(spark, str(tmp_path / "b.tsv"), {"m": 1, "f": 2}, ["run", "jump"]).collect()
    assert sorted((r["frame"], r["label"], r["id1"], r["id2"]) for r in out) == [(1, 1, 1, -1), (2, 1, 1, -1), (3, 1, 1, -1), (5, 2, 2, -1)]
    (tmp_path / "tags.csv").write_text("group,sequence,id,sex\n01,007,2,f\n")
    assert tuple(readers.id_tags(spark, str(tmp_path / "tags.csv"), "category", ["sex"]).first()) == ("01", "007", 2, "f")
    (tmp_path / "coco.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.png"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 1, "bbox": [0, 0, 2, 2], "keypoints": [1, 2, 2, 3, 4, 1]}]}))
    points = readers.coco_keypoints(spark, str(tmp_path / "coco.json"))
    assert sorted((r["point"], r["x"], r["visibility"]) for r in points.collect()) == [(0, 1.0, 2), (1, 3.0, 1)]
    assert json.loads(writers.coco_document(points).first()["document"])["annotations"][0]["keypoints"] == [1.0, 2.0, 2.0, 3.0, 4.0, 1.0]
    (tmp_path / "y.txt").write_text("0 0.5 0.5 0.2 0.2 0.1 0.2 2\n")
    assert readers.yolo_pose(spark, str(tmp_path / "y.txt"), 100, 50).first()["points"][0]["y"] == 10.0
    (tmp_path / "v.xml").write_text('<annotations><image id="0" name="a"><points label="p" points="1.0,2.0;3.0,4.0"/><points label="q" points="5.0,6.0"/></image></annotations>')
    assert sorted((r["label"], r["x"]) for r in readers.cvat_points(spark, str(tmp_path / "v.xml")).collect()) == [("p", 1.0), ("p", 3.0), ("q", 5.0)]
    boxes = spark.createDataFrame([("g", "s", 0, t, 0.0, 0.0, 2.0, 4.0, 1.0, float("nan"), 3.0) for t in (9, 4)], "`group` string, sequence string, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, kpx0 double, kpx1 double, kpy0 double")
    assert sorted((r["id"], r["X"], r["Y"]) for r in readers.ultralytics(boxes.withColumn("kpy1", F.lit(None).cast("double"))).collect()) == [(0, 1.0, 3.0), (1, 1.0, 3.0)]
    df = track(spark, [("a", "s", 0, f, 1.0, 2.0) for f in range(3)])
    writers.write_tracks(df, str(tmp_path / "out"))
    assert readers.read_tracks(spark, str(tmp_path / "out")).count() == 3
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, writers.append_index(old, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_live_speed(spark, tmp_path):
    df = track(spark, [("g", "s", i, f, 3.0 * f, 4.0 * f) for i in range(2) for f in range(4)])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.live_speed(stream, 2.0).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    out = spark.sql("select * from live").collect()
    assert len(out) == 8 and {r["speed"] for r in out if r["frame"]} == {10.0}


def test_live_counts_by_window(spark, tmp_path):
    rows = [("g", 0, "2024-01-01 00:00:01"), ("g", 0, "2024-01-01 00:00:05"), ("g", 1, "2024-01-01 00:00:09"), ("g", 1, "2024-01-01 00:00:12"), ("h", 1, "2024-01-01 00:01:30")]
    df = spark.createDataFrame(rows, "`group` string, id long, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.live_counts(stream, "at", "10 seconds", "20 seconds").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["group"], r["window"]["start"].second, r["rows"], r["individuals"]) for r in spark.sql("select * from counts").collect())
    assert got == [("g", 0, 3, 2), ("g", 10, 1, 1)]


def test_one_coco_document_of_a_data_set(spark, tmp_path):
    rows = [(i, f"f{i}.png", 10 * i + a, 1, [0.0, 1.0, 2.0, 3.0], p, float(p), 2.0, 2 * p) for i in range(40) for a in range(2) for p in range(2)]
    points = spark.createDataFrame(rows, "image_id long, file_name string, annotation_id long, category_id long, bbox array<double>, point int, x double, y double, visibility int").repartition(5)
    writers.write_coco(points, str(tmp_path / "coco"), [(1, "bee")])
    text = "".join(p.read_text() for p in sorted((tmp_path / "coco").glob("part-*")))
    doc = json.loads(text)
    assert [i["id"] for i in doc["images"]] == list(range(40)) and len(doc["annotations"]) == 80 and doc["categories"] == [{"id": 1, "name": "bee"}]
    assert doc["annotations"][3] == {"id": 11, "image_id": 1, "category_id": 1, "bbox": [0.0, 1.0, 2.0, 3.0], "keypoints": [0.0, 2.0, 0.0, 1.0, 2.0, 2.0], "num_keypoints": 1}


def test_entry_is_converted_when_it_is_asked_for(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for name in ("a__one", "a__two"):
        np.savez(tmp_path / "raw" / f"{name}.npz", frame=np.arange(3), X=np.arange(3), Y=np.arange(3), id=np.array([0]))
    index = conversion.index_raw(spark, [str(tmp_path / "raw")], "*.npz", "trex_npz", group_from="name", contents=True)
    out = str(tmp_path / "out")
    assert conversion.tracks_of(spark, index, "trex_npz", out, "a", "one").count() == 3
    assert readers.read_tracks(spark, out).select("sequence").distinct().count() == 1
    with pytest.raises(LookupError):
        conversion.tracks_of(spark, index, "trex_npz", out, "a", "three")
    (tmp_path / "raw" / "a__one.npz").unlink()
    assert conversion.tracks_of(spark, index, "trex_npz", out, "a", "one").count() == 3


def test_ward_matches_merging_by_least_increase():
    x = np.random.default_rng(5).normal(size=(60, 3))
    clusters = [[i] for i in range(60)]
    while len(clusters) > 5:
        spread = lambda c: ((x[c] - x[c].mean(0)) ** 2).sum()
        a, b = min(((i, j) for i in range(len(clusters)) for j in range(i)), key=lambda p: spread(clusters[p[0]] + clusters[p[1]]) - spread(clusters[p[0]]) - spread(clusters[p[1]]))
        clusters[b] += clusters.pop(a)
    labels, centers = models.ward(x, 5)
    assert {frozenset(c) for c in clusters} == {frozenset(np.flatnonzero(labels == c).tolist()) for c in range(5)}
    assert np.allclose(centers, [x[labels == c].mean(0) for c in range(5)])


def test_prototypes(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.8, 0.2], 0), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    scores = models.prototype_scores(df, models.prototypes(df), "vec_id")
    best = {r["vec_id"]: r["b"] for r in scores.groupBy("vec_id").agg(F.max_by("label", "probability").alias("b")).collect()}
    assert best == {0: 0, 1: 0, 2: 1}
    total = scores.groupBy("vec_id").agg(F.sum("probability").alias("t")).first()["t"]
    assert total == pytest.approx(1)


def test_heading_follows_the_keypoints(spark):
    rows = [("g", "s", 0, 0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "`group` string, sequence string, id long, frame long, X double, Y double, poseX0 double, poseY0 double, poseX1 double, poseY1 double")
    assert kinematics.heading(df).first()["ANGLE"] == pytest.approx(math.pi / 4)
    assert abs(kinematics.heading(df, front=1, rear=0).first()["ANGLE"]) == pytest.approx(3 * math.pi / 4)
    assert kinematics.heading(df, "pca").first()["ANGLE"] == pytest.approx(math.pi / 4)
    assert pairs.body_scale(df).first()["body_scale"] == pytest.approx(math.sqrt(2))


def test_alpha_shape_of_a_grid():
    grid = np.array([[x, y] for x in range(4) for y in range(4)], float)
    assert kernels._alpha(grid, 1.0)[0] == pytest.approx(9) and kernels._alpha(grid, 0.5) == (None, 0)
    far = np.vstack([grid, grid + 100])
    assert kernels._alpha(far, 1.0)[0] == pytest.approx(18)
    rng = np.random.default_rng(0).random((40, 2))
    assert kernels._alpha(rng, 1e9)[0] == pytest.approx(kernels._hull(rng), rel=1e-6)


def test_cleaning_fills_gaps_and_edges(spark):
    values = [None, None, 1.0, None, None, None, None, None, 7.0, None, None, None]
    df = track(spark, [("g", "s", 0, i, v, float(i)) for i, v in enumerate(values)])
    out = {r["frame"]: r["X"] for r in kinematics.clean_tracks(df, ["X"], 2, 1, 0.5).collect()}
    assert out == {1: 1.0, 2: 1.0, 3: 2.0, 4: 3.0, 6: 5.0, 7: 6.0, 8: 7.0, 9: 7.0}
    kept = {r["frame"]: r["X"] for r in kinematics.clean_tracks(df, ["X", "Y"], 2, 1, 0.5).collect()}
    assert len(kept) == 12 and kept[5] == kept[11] == 4.0
    pose = spark.createDataFrame([("g", "s", 0, f, float(f), 0.0, 0.1 if f == 1 else 0.9) for f in range(3)], "`group` string, sequence string, id long, frame long, poseX0 double, poseY0 double, poseP0 double")
    assert [r["poseX0"] for r in kinematics.confidence_filter(pose).orderBy("frame").collect()] == [0.0, 1.0, 2.0]


def test_pose_distance_pca_has_both_perspectives_of_all_keypoints(spark):
    from trackloom import queries

    sf = "/root/testdata/sf0.001"
    at = {}
    for r in queries.tracks(spark, sf).collect():
        at.setdefault((r["group"], r["sequence"], r["frame"]), {})[r["id"]] = np.array([[r[f"poseX{i}"], r[f"poseY{i}"]] for i in range(7)])
    keys, rows = [], []
    for entry, own in at.items():
        for a, b in ((a, b) for a in own for b in own if a != b):
            p = np.concatenate([own[a], own[b]])
            keys.append((*entry, min(a, b), max(a, b), int(a > b)))
            rows.append([np.hypot(*(p[i] - p[j])) for i in range(14) for j in range(i + 1, 14)])
    x = np.array(rows) - np.mean(rows, axis=0)
    want = x @ np.linalg.eigh(x.T @ x)[1][:, :-7:-1]
    got = {(r["group"], r["sequence"], r["frame"], r["id1"], r["id2"], r["perspective"]): [r[f"PC{i}"] for i in range(6)] for r in queries.pose_distance_pca(spark, sf).collect()}
    assert got.keys() == set(keys)
    ours = np.array([got[k] for k in keys])
    assert np.allclose(ours * np.sign((ours * want).sum(0)), want, atol=1e-6)


def test_interpolation_of_a_long_track_is_linear(spark):
    df = spark.range(60_000).select(F.lit("g").alias("group"), F.lit("s").alias("sequence"), F.lit(0).alias("id"), F.col("id").alias("frame"), F.when(F.col("id") % 1000 == 0, F.col("id") * 2.0).alias("X"))
    out = windows.interpolated(df, ["X"]).agg(F.max(F.abs(F.col("X") - F.least(F.col("frame"), F.lit(59_000)) * 2))).first()[0]
    assert out == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("window", [4, 5])
def test_moving_average_mirrors_the_ends(spark, window):
    x = np.random.default_rng(3).normal(size=23)
    df = track(spark, [("g", "s", 0, i, float(v), 0.0) for i, v in enumerate(x)])
    got = [r["m"] for r in windows.with_moving_average(df, {"m": "X"}, window).orderBy("frame").collect()]
    padded = np.pad(x, (window // 2, window - 1 - window // 2), mode="reflect")
    assert got == pytest.approx(np.convolve(padded, np.ones(window) / window, "valid"))


def test_entry_keys_of_blank_groups():
    assert [columns.entry_key(g, "seq") for g in ("", " ", None)] == ["seq"] * 3 and columns.entry_key("a", "b") == "a__b"
    assert columns.parse_entry_key("s1") == ("", "s1") and columns.parse_entry_key("g__a__b") == ("g", "a__b")
    with pytest.raises(ValueError):
        columns.entry_key("a/b", "c")


def test_frame_range():
    assert kinematics.frame_range(30, 100, 500) == (100, 500) and kinematics.frame_range(30, start_time=1.0, end_time=5.0) == (30, 150)
    assert kinematics.frame_range(30, start_frame=100, end_time=5.0) == (100, 150) and kinematics.frame_range(None, 100) == (100, None)
    for bad in ({"start_frame": 1, "start_time": 1.0}, {"end_frame": 1, "end_time": 1.0}):
        with pytest.raises(ValueError):
            kinematics.frame_range(30, **bad)
    with pytest.raises(ValueError):
        kinematics.frame_range(None, start_time=1.0)


def test_scale_to_cm_refuses_what_it_cannot_scale(spark):
    df = track(spark, [("g", "s", 0, 0, 4.0, 8.0)]).withColumns({"speed": F.lit(2.0), "X#head": F.lit(6.0), "ANGLE": F.lit(1.0), "poseP0": F.lit(0.5)})
    scale = lambda v: spark.createDataFrame([("g", "s", v)], "`group` string, sequence string, cm_per_pixel double")
    r = summaries.scale_to_cm(df, scale(0.5)).first()
    assert (r["X_cm"], r["speed_cm"], r["X#head_cm"]) == (2.0, 1.0, 3.0) and not {"ANGLE_cm", "poseP0_cm"} & set(r.asDict())
    for bad in (0.0, -1.0, None):
        with pytest.raises(Exception, match="cm_per_pixel"):
            summaries.scale_to_cm(df, scale(bad)).collect()
    with pytest.raises(ValueError):
        summaries.scale_to_cm(df, scale(1.0), columns=["nope"])
    with pytest.raises(ValueError):
        summaries.scale_to_cm(df.select("group", "sequence", "id", "frame", "ANGLE"), scale(1.0))


def test_expected_mutual_information_matches_its_definition():
    def slow(a, b, n):
        lf = lambda v: math.lgamma(v + 1)
        out = 0.0
        for x in a:
            for y in b:
                for k in range(max(1, x + y - n), min(x, y) + 1):
                    out += k / n * math.log(n * k / (x * y)) * math.exp(lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(k) - lf(x - k) - lf(y - k) - lf(n - x - y + k))
        return out

    for a, b in (([3, 4, 5], [6, 6]), ([100, 1, 399], [250, 250]), ([7], [7])):
        assert models._expected_mutual(np.array(a, float), np.array(b, float), float(sum(a))) == pytest.approx(slow(a, b, sum(a)), rel=1e-9, abs=1e-12)
    assert np.isfinite(models._expected_mutual(np.array([5e8, 5e8]), np.array([1e8, 9e8]), 1e9))


def test_dataset_agreement_by_frame_and_by_order(spark):
    clusters = spark.createDataFrame([("g", "s", i, i // 5) for i in range(20)], "`group` string, sequence string, frame long, cluster long")
    labels = spark.createDataFrame([("g", "s", i, i // 5 + 7) for i in range(18)] + [("g", "t", 0, 1)], "`group` string, sequence string, frame long, label long")
    for own in (clusters, clusters.drop("frame")):
        out = models.dataset_agreement(own, labels, per_sequence=True)
        assert out["n_frames_total"] == 18
    assert models.dataset_agreement(clusters, labels)["metrics"]["ari"] == pytest.approx(1)
    assert models.dataset_agreement(clusters, labels, frames=9)["sampled"]
    with pytest.raises(ValueError):
        models.dataset_agreement(clusters, labels.where("sequence = 't'"))


def test_prototype_scores_by_product_and_by_join(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=5)], int(i % 3)) for i in range(30)] + [(30, None, None)], "vec_id long, embedding array<double>, label int")
    proto = models.prototypes(df)
    both = [{(r["vec_id"], r["label"]): r["probability"] for r in f(df, proto, "vec_id", "embedding", "label", 0.07).collect() if r["probability"] is not None} for f in (models.prototype_scores, models._joined_scores)]
    assert both[0].keys() == both[1].keys() and len(both[0]) == 90
    assert all(both[0][k] == pytest.approx(both[1][k], abs=1e-9) for k in both[0])


def test_labelled_templates_targets(spark):
    rows = [("g", f"s{i % 5}", i, float(i), float(i * i % 17), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "`group` string, sequence string, frame long, f0 double, f1 double, label int")
    count = lambda out: {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert set(count(templates.labelled_templates(df, ["f0", "f1"], {0: 4, 1: 2})).items()) == {((s, k), n) for s in ("train", "test") for k, n in ((0, 4), (1, 2))}
    assert set(count(templates.labelled_templates(df, ["f0", "f1"], total=30)).values()) == {10}
    assert set(count(templates.labelled_templates(df, ["f0", "f1"], 3, strategy="farthest_first", pool=12)).values()) == {3}
    for bad in ({}, {"per_class": 1, "total": 1}):
        with pytest.raises(ValueError):
            templates.labelled_templates(df, ["f0"], **bad)
    sides = templates.split_by_sequence(df, 0.2).select("sequence", "split").distinct().collect()
    assert sorted(r["split"] for r in sides) == ["test"] + ["train"] * 4


def test_quotas(spark):
    counts = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 1)], "e string, n long")
    got = {r["e"]: r["quota"] for r in templates.with_quotas(counts, 110).collect()}
    assert 99 <= got["a"] <= 100 and 9 <= got["b"] <= 10 and got["c"] == 0
    capped = {r["e"]: r["quota"] for r in templates.with_quotas(counts, 110, 0.5).collect()}
    assert capped["a"] == 55 and capped["b"] > 9
    assert {r["quota"] for r in templates.with_quotas(counts, 5000).collect()} == {1000, 100, 1}


def test_classifiers_and_sampling_of_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y), k, "test" if i % 4 == 0 else "train") for k, n in ((0, 120), (1, 40), (2, 24)) for i, (x, y) in enumerate(rng.normal(3.0 * k, 0.5, (n, 2)))]
    df = spark.createDataFrame(rows, "f0 double, f1 double, label int, split string")
    assert {r["label"]: r["count"] for r in models.undersampled(df, most_ratio=2).groupBy("label").count().collect()} == {0: 48, 1: 40, 2: 24}
    more = models.oversampled(df, ["f0", "f1"])
    assert {r["count"] for r in more.groupBy("label").count().collect()} == {120}
    assert more.where("label = 2 and (f0 < 3 or f0 > 9)").isEmpty()
    for mode in ("multiclass", "one_vs_rest"):
        fitted = models.fit_classifier(df, ["f0", "f1"], rounds=4, mode=mode, most_ratio=3, oversample=True)
        found = models.classify(df.where("split = 'test'"), fitted, ["f0", "f1"])
        assert all(r["f1"] > 0.9 and r["support"] > 5 for r in models.report(found).collect())


def posed(spark, n, frames):
    rng = np.random.default_rng(5)
    rows = [("g", "s", i, f, float(f), float(i), 0.3, *map(float, rng.normal(size=6))) for i in range(n) for f in range(frames)]
    return spark.createDataFrame(rows, "`group` string, sequence string, id long, frame long, X double, Y double, ANGLE double, " + ", ".join(f"pose{c}{k} double" for k in range(3) for c in "XY"))


def test_subsamples_of_a_sequence(spark):
    df = posed(spark, 2, 50)
    assert sampling.subsample(df, 200).count() == 100
    assert sampling.subsample(df, 10, "uniform").count() == 10
    assert 5 <= sampling.subsample(df, 10).count() <= 10
    clips = [(r["id"], r["frame"]) for r in sampling.subsample(df, 24, "clips", clip=8).collect()]
    assert len(clips) in (8, 16, 24) and len(set(clips)) == len(clips)
    assert sampling.spans(np.array([0, 3, 97]), 100, 8) == [0, 8, 92]
    assert [r["frame"] for r in sampling.uniform_frames(df, 3).orderBy("frame").collect()] == [0, 24, 49]
    assert sampling.kmeans_frames(df.where("id = 0"), ["poseX0", "poseY0"], 6).count() == 6


def test_boxes_of_keypoints(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 20.0), (None, None, None, None)], "poseX0 double, poseY0 double, poseX1 double, poseY1 double")
    tight, none = boxes.keypoint_boxes(df, 100, 100).collect()
    assert [tight[c] for c in boxes.BOX] == pytest.approx([0.2, 0.2, 0.24, 0.0]) and [none[c] for c in boxes.BOX] == [0.0] * 4
    wide = boxes.keypoint_boxes(df, 100, 100, "isotropic", head=0, tail=1, least_pad=1.0).first()
    assert [wide[c] for c in boxes.BOX] == pytest.approx([0.2, 0.2, 0.32, 0.12])
    turned = boxes.keypoint_boxes(df, 100, 100, "oriented", head=0, tail=1).first()
    assert [turned[c] for c in boxes.BOX] == pytest.approx([0.2, 0.2, 0.3, 0.14])
    with pytest.raises(ValueError):
        boxes.keypoint_boxes(df, 100, 100, "oriented")


def test_last_labels_and_headings(spark):
    df = spark.createDataFrame([("g", "s", 2, 1, 5, 7, 0), ("g", "s", 1, 2, 5, 8, 1), ("g", "s", 1, None, 5, 9, 2), ("g", "s", None, None, 5, 3, 3)], "`group` string, sequence string, id1 long, id2 long, frame long, label long, at long")
    got = {(r["id1"], r["id2"]): r["label"] for r in summaries.last_labels(df, "label", "at").collect()}
    assert got == {(1, 2): 8, (1, None): 9, (None, None): 3}
    assert numbers.in_degrees(spark.createDataFrame([(90.0,)], "a double"), "a") and not numbers.in_degrees(spark.createDataFrame([(3.0,), (None,)], "a double"), "a")
    one = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0)], "a double, b double, c double, d double")
    assert one.select(numbers.heading_between(*map(F.col, "abcd"))).first()[0] == pytest.approx(math.pi / 4)


def test_conversion_reports_broken_files_and_goes_on(spark, tmp_path):
    for name, n in (("a__one_id0.npz", 5), ("a__two_id0.npz", 3)):
        np.savez(tmp_path / name, frame=np.arange(n), X=np.arange(n), Y=np.arange(n), id=np.array([0]))
    (tmp_path / "a__bad_id0.npz").write_bytes(b"not an npz")
    (tmp_path / "skip_me.npz").write_bytes(b"")
    index = conversion.index_raw(spark, [str(tmp_path)], "*.npz", "trex_npz", exclude=["skip*"], group_from="name", checksum=True)
    assert {(r["group"], r["sequence"], len(r["md5"])) for r in index.collect()} == {("a", s, 32) for s in ("one_id0", "two_id0", "bad_id0")}
    tracks, failed = conversion.convert(spark, index, "trex_npz")
    assert {(r["sequence"], r["n"]) for r in tracks.groupBy("sequence").agg(F.count("*").alias("n")).collect()} == {("one_id0", 5), ("two_id0", 3)}
    assert [r["sequence"] for r in failed.collect()] == ["bad_id0"]
    out = f"{tmp_path}/out"
    with pytest.raises(ValueError, match="1 of 3"):
        conversion.convert_all(spark, index, "trex_npz", out, strict=True)
    assert conversion.convert_all(spark, index, "trex_npz", out) == {"files": 3, "failed": 1, "entries": 2}
    assert conversion.convert_all(spark, index, "trex_npz", out)["entries"] == 0
    with pytest.raises(ValueError, match="no converter"):
        conversion.converter_of("nothing")


def test_npz_entries_go_out_and_come_back(spark, tmp_path):
    df = track(spark, [("g", "s", 0, i, float(i), 2.0 * i) for i in range(4)])
    (tmp_path / "one.npz").write_bytes(bytes(writers.npz_entries(df, ["X", "Y"]).first()["npz"]))
    rows = readers.npz_array(spark, f"{tmp_path}/*.npz", "Y").orderBy("row").collect()
    assert [r["values"] for r in rows] == [[0.0], [2.0], [4.0], [6.0]]
    assert [r["values"] for r in readers.npz_array(spark, f"{tmp_path}/*.npz", "X", transpose=True).collect()] == [[0.0, 1.0, 2.0, 3.0]]
    index = spark.createDataFrame([("a", 1)], "k string, v int")
    for v in (1, 2):
        writers.write_index(index.withColumn("v", F.lit(v)), f"{tmp_path}/index")
    assert [r["v"] for r in spark.read.csv(f"{tmp_path}/index", header=True).collect()] == ["2"]


def test_loaded_values_names_and_selection(spark):
    df = track(spark, [("g", s, 0, i, float(i), -float(i)) for s in "st" for i in range(4)])
    assert values.column_names(["X", "Y", "X", "X"]) == ["X", "Y", "X-1", "X-2"]
    labels = spark.createDataFrame([("g", "s", 2, 5)], "`group` string, sequence string, frame long, label long")
    out = values.load_values([values.Values(df, "X"), values.Values(df.withColumn("X", F.col("X") * 2), "X"), values.Labels(labels, "b")], sequences=["s"], fps=1.0, start_time=1.0)
    assert sorted((r["frame"], r["X"], r["X-1"], r["labels-b"]) for r in out.collect()) == [(1, 1.0, 2.0, 0), (2, 2.0, 4.0, 5), (3, 3.0, 6.0, 0)]
    with pytest.raises(ValueError):
        values.load_values([values.Labels(labels, "b")])


def test_delete_set_takes_what_drifted(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    df = track(spark, [("g", s, 0, 0, 1.0, 1.0) for s in "abc"])
    digests = lambda rows: spark.createDataFrame([("g", s, d) for s, d in rows], "`group` string, sequence string, consumed string")
    catalog.write("up", "u-1", df, {}, [])
    catalog.write("down", "d-1", df, {}, ["u-1"], digests([("a", "1"), ("b", "1"), ("c", None)]))
    now = digests([("a", "2"), ("b", "1"), ("c", "2")])
    candidates, declined = catalog.delete_set("u-1", now)
    assert [r["sequence"] for r in candidates.collect()] == ["a"] and [r["sequence"] for r in declined.collect()] == ["c"]
    assert catalog.read("down", "d-1").count() == 3
    candidates, _ = catalog.delete_set("u-1", now, apply=True)
    assert candidates.count() == 1 and sorted(r["sequence"] for r in catalog.read("down", "d-1").collect()) == ["b", "c"]
    assert sorted(r["sequence"] for r in catalog.entries("d-1").collect()) == ["b", "c"]


def test_lineage_has_no_depth_limit(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    # A chain of 200 runs, each of which also consumes the run before the last, so there are very many ways.
    rows = [("f", f"r-{i}", "{}", [f"r-{j}" for j in (i - 1, i - 2) if j >= 0], "finished", float(i)) for i in range(200)]
    catalog._append("runs", spark.createDataFrame(rows, RUNS).coalesce(1))
    assert {r["run_id"]: r["distance"] for r in catalog.lineage("r-199").collect()} == {f"r-{i}": (200 - i) // 2 for i in range(199)}
    assert {r["run_id"]: r["distance"] for r in catalog.reached_by("r-0").collect()} == {f"r-{i}": (i + 1) // 2 for i in range(1, 200)}
    assert catalog.lineage("r-0").count() == 0


def test_drift_far_down_the_chain_is_found(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog._append("runs", spark.createDataFrame([("f", f"r-{i}", "{}", [f"r-{i - 1}"] if i else [], "finished", float(i)) for i in range(60)], RUNS).coalesce(1))
    df = track(spark, [("g/1", s, 0, 0, 1.0, 1.0) for s in "ab"])
    digests = lambda d: spark.createDataFrame([("g/1", s, d) for s in "ab"], "`group` string, sequence string, consumed string")
    catalog.write("last", "r-60", df, {}, ["r-59"], digests("1"))
    candidates, _ = catalog.delete_set("r-0", digests("2").where("sequence = 'b'"), apply=True)
    assert [(r["run_id"], r["sequence"]) for r in candidates.collect()] == [("r-60", "b")]
    assert [r["sequence"] for r in catalog.read("last", "r-60").collect()] == ["a"]


def test_index_survives_a_writer_that_is_cut_off(spark, tmp_path):
    path = f"{tmp_path}/index"
    for v in (1, 2):
        writers.write_index(spark.createDataFrame([(v,)], "v int"), path)
        assert [r["v"] for r in writers.read_index(spark, path).collect()] == [str(v)]
    assert not (tmp_path / "index.old").exists()
    (tmp_path / "index").rename(tmp_path / "index.old")
    assert [r["v"] for r in writers.read_index(spark, path).collect()] == ["2"]


def test_last_event_of_a_frame_wins_and_repeats_of_pairs_do_not(spark):
    df = track(spark, [("g", "s", 0, i, float(i), 0.0) for i in range(3)])
    events = spark.createDataFrame([("g", "s", 1, 9, 1, 1, 2), ("g", "s", 1, 4, 2, 1, 2), ("g", "s", 1, 7, 3, 2, 1), ("g", "s", 2, 8, 4, 3, 1)], "`group` string, sequence string, frame long, label long, event long, id1 long, id2 long")
    get = lambda **o: [r["labels-b"] for r in values.load_values([values.Values(df, "X"), values.Labels(events, "b", **o)]).orderBy("frame").collect()]
    assert get() == [0, 4, 0] and get(symmetric=False) == [0, 7, 8]


def test_pipeline_callbacks_and_cleaning(spark, tmp_path):
    df = track(spark, [("g", "s", 0, i, float(i), 0.0) for i in range(3)])
    seen = []
    make = lambda version: Pipeline(Catalog(spark, str(tmp_path))).add("twice", lambda t: t.withColumn("X", F.col("X") * 2), ["tracks"], materialise=True, version=version).add_callback("look", lambda t: seen.append(t.count()), ["twice"])
    old, new = make("1"), make("2")
    assert old.run(df)["look"].agg(F.max("X")).first()[0] == 4.0 and seen == [3]
    assert new.status() == {"twice": "stale", "look": "callback"}
    new.run(df)
    assert new.clean() == [f"twice/{old.run_id('twice')}"] and new.clean() == []
    assert new.status()["twice"] == "cached" and old.status()["twice"] == "stale"


def test_distance_pca_is_pca_of_the_distances_and_keeps_its_plan_small(spark):
    """Distances as columns of the plan made a method that was never compiled: 600,000 events took longer than 200 s."""
    rng = np.random.default_rng(3)
    points = [("px0", "py0"), ("px1", "py1")]
    names = [f"{c}_{s}" for p in points for c in p for s in "AB"]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rng.normal(size=(200, 8)))] + [(200, None, *[1.0] * 7)], ["n", *names]).repartition(5)
    rows = sorted(models.pair_distance_pca(df, points, k=3).collect(), key=lambda r: r["n"])
    x = np.array([[np.hypot(r[f"px{i}_{s}"] - r[f"px{j}_{t}"], r[f"py{i}_{s}"] - r[f"py{j}_{t}"]) for (s, i), (t, j) in itertools.combinations([(s, i) for s in "AB" for i in (0, 1)], 2)] for r in rows])
    centred = x - x.mean(0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    got = np.array([[r[f"PC{i}"] for i in range(3)] for r in rows])
    assert len(rows) == 200 and np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    assert models.pair_distance_pca(df.where("n < 0"), points, k=3).count() == 0


def test_segments_and_events_sort_the_rows_of_pairs_once(spark):
    """Runs were found by windows over other keys, so a task sorted and held all its rows of pairs again."""
    rows = [("g", "s", i, f, float(i), 0.0, math.pi * i) for f in range(40) for i in range(2) if not (i and f in (9, 10, 30))]
    df = spark.createDataFrame(rows, "group string, sequence string, id long, frame long, X double, Y double, ANGLE double")
    got = interactions.pair_interaction_filter(df, 0.0, 5.0, True, 80.0, 5, 2, 1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("_run") == 0
    assert {(r["frame"], r["segment"], r["interaction_start"], r["interaction_end"]) for r in got.collect()} == {(f, 0, 0, 39) for f in range(40) if f not in (9, 10, 30)}
    gone = [f for f in range(40) if f % 8 == 7]
    far = df.withColumn("X", F.when(F.col("frame").isin(gone) & (F.col("id") == 1), 50.0).otherwise(F.col("X")))
    # 0-6, 8-14 without 9 and 10 (five rows), 16-22, 24-29 with 30 gone (six), 32-38; a run of five is long, one of four isn't.
    spans = {(r["interaction_start"], r["interaction_end"]) for r in interactions.pair_interaction_filter(far, 0.0, 5.0, True, 80.0, 5, 0, 1).collect()}
    assert spans == {(0, 6), (8, 14), (16, 22), (24, 29), (32, 38)}
    assert {(r["interaction_start"], r["interaction_end"]) for r in interactions.pair_interaction_filter(far, 0.0, 5.0, True, 80.0, 6, 0, 1).collect()} == spans - {(8, 14)}
    aa = spark.createDataFrame([("g", "s", 0, 1, f, int(f in (1, 2, 5)), int(f in (2, 3, 4))) for f in range(7)], "group string, sequence string, id1 long, id2 long, frame long, aa_event_12 int, aa_event_21 int")
    events = interactions.event_table(aa)
    assert events._jdf.queryExecution().executedPlan().toString().count("Window ") <= 1
    assert {(r["direction"], r["start_frame"], r["end_frame"], r["duration"], r["approacher_id"]) for r in events.collect()} == {("12", 1, 2, 2, 0), ("12", 5, 5, 1, 0), ("21", 2, 4, 3, 1)}


def test_turned_points_are_sorted_without_a_comparator_in_the_plan(spark):
    """array_sort calls an interpreted comparator for each two values; orientation_relative and body_scale sort by it no more."""
    df = spark.createDataFrame([("g", "s", 0, i, 1.0 * i, 2.0, None if i else 0.5, 1.0, 2.0 + i, 3.0, 5.0, None, 1.0) for i in range(2)], "group string, sequence string, frame long, id long, X double, Y double, ANGLE double, poseX0 double, poseY0 double, poseX1 double, poseY1 double, poseX2 double, poseY2 double")
    out = pairs.orientation_relative(df, pairs.body_scale(df))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "sort_array" in plan
    got = {r["id1"]: r for r in out.collect()}
    # The focal without an angle gets nothing that needs one; missing points don't count.
    assert got[1]["dist_min"] is None and got[1]["dx"] is None and got[0]["near_2"] is None and got[0]["near_0"] <= got[0]["near_1"]


# The second heading is the first one turned round, up to the last bits of its components.
HALF_TURNS = [
    ((0.10000000000000142, -0.39999999999999947), (-0.20000000000000284, 0.8000000000000007)),  # Java's arctangent makes this half a circle
    ((-2.0, 1.0), (3.1999999999999993, -1.6000000000000014)),  # one bit beyond half a circle
    ((3.1999999999999993, 0.5), (-3.200000000000003, -0.5)),
]


@pytest.mark.parametrize("before, after", HALF_TURNS)
def test_turns_by_half_a_circle_of_keypoints(spark, before, after):
    rows = [("g", "s", i, f, *v, 0.0, 0.0) for f, v in enumerate((before, after)) for i, v in enumerate((v, (1.0, 0.0)))]
    df = spark.createDataFrame(rows, "`group` string, sequence string, id long, frame long, poseX0 double, poseY0 double, poseX1 double, poseY1 double")
    got = {(r["perspective"], r["frame"]): r for r in pairs.pair_egocentric(df, 1.0, neck=0, tail=1).collect()}
    turn = np.diff(np.unwrap([math.atan2(y, x) for x, y in (before, after)]))[0]
    for f in (0, 1):
        assert got[0, f]["A_ang_speed"] == pytest.approx(turn) and got[1, f]["B_ang_speed"] == pytest.approx(turn)


def test_arctangent_is_that_of_the_c_library_and_null_without_a_point(spark):
    rng = random.Random(5)
    rows = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(5000)] + [(0.0, 0.0), (None, 1.0), (1.0, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "y double, x double").coalesce(1).select(kernels.arctangent("y", "x")).collect()]
    assert got == [None if None in p else math.atan2(*p) for p in rows]


def test_angle_just_below_half_a_turn_back_is_half_a_turn(spark):
    below, pi = math.nextafter(-math.pi, -4), math.pi
    df = spark.createDataFrame([(below,), (-pi,), (pi,), (-4.0,), (7.0,), (100.0,)], "a double").coalesce(1)
    assert [r[0] for r in df.select(numbers.wrap_angle(F.col("a"))).collect()] == [float((a + pi) % (2 * pi) - pi) for a in (below, -pi, pi, -4.0, 7.0, 100.0)]
    assert (below + pi) % (2 * pi) - pi == pi


def test_means_of_bins_do_not_depend_on_the_order_of_rows(spark):
    """Turns whose mean is 9.48125; plain sums of them end one bit apart in some of their orders."""
    turns = [34.66481633974483, 22.425, -31.302316339744827, -0.5375000000000019, -1.5125000000000055, 33.15]
    orders = list(itertools.permutations(turns))
    assert len({functools.reduce(operator.add, o) / 6 for o in orders}) > 1
    rows = [("g", f"s{i}", 5.0, 25.0, v, 0.0) for i, o in enumerate(orders) for v in o]
    df = spark.createDataFrame(rows, "`group` string, sequence string, neighbor_x double, neighbor_y double, dangle double, dspeed double").coalesce(1)
    out = summaries.nn_delta_bins(df, bins=7, most=60.0, most_for_mean=40.0).where("dim = '1d' and metric = 'turn' and bin_idx = 4")
    assert [r["value"] for r in out.collect()] == [9.48125] * len(orders)


def test_steady_sums_are_those_of_exact_terms(spark):
    rng = random.Random(2)
    groups_ = [[rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 5) for _ in range(400)] for _ in range(20)] + [[1e300, 1.0, -1e300], [0.1] * 10, [None, 2.5], [None]]
    df = spark.createDataFrame([(i, v) for i, g in enumerate(groups_) for v in g], "i int, v double")
    got = {r["i"]: r["s"] for r in df.groupBy("i").agg(numbers.steady_sum(F.col("v")).alias("s")).collect()}
    assert got[20] is not None and got[23] is None and got[22] == 2.5
    assert all(got[i] == math.fsum(groups_[i]) for i in (*range(20), 21))
