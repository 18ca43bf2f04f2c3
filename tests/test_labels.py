"""Label files of several formats through one conversion, and track files of the registered formats."""

import io
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.sources import conversion, labels, readers

BORIS = "Observation id\tSubject\tBehavior\tBehavior type\tStart (s)\tStop (s)\tFPS\n"


def boris(folder):
    (folder / "a__one.tsv").write_text(BORIS + "o1\tanna\twalk\tSTATE\t0.5\t1.0\t4\no2\tben\trest\tPOINT\t2.0\t2.0\t4\no1\tcarl\tfly\tPOINT\t0\t0\t4\n")
    (folder / "a__two.tsv").write_text(BORIS + "o1\tben\trest\tSTATE\t0\t0\t4\n")
    (folder / "a__bad.tsv").write_text(BORIS + "o1\tben\trest\tSTATE\tsoon\tlater\t4\n")


PARAMS = {"subjects": {"anna": 3, "ben": 4}, "behaviors": ["walk", "rest"]}


def test_registered_converter_and_report(spark, tmp_path):
    boris(tmp_path)
    index = conversion.index_raw(spark, [str(tmp_path)], "*.tsv", "boris_csv", group_from="name", contents=True)
    events, failed = labels.convert_labels(spark, index, labels.converter_of("boris_csv", "behavior"), **PARAMS)
    got = sorted((r["group"], r["sequence"], r["frame"], r["label"], r["name"], r["id1"], r["id2"]) for r in events.collect())
    assert got == [("a", "one", 2, 1, "walk", 3, -1), ("a", "one", 3, 1, "walk", 3, -1), ("a", "one", 4, 1, "walk", 3, -1), ("a", "one", 8, 2, "rest", 4, -1), ("a", "two", 0, 2, "rest", 4, -1)]
    assert [(r["sequence"], "ValueError" in r["error"]) for r in failed.collect()] == [("bad", True)]
    with pytest.raises(ValueError, match="no label converter"):
        labels.converter_of("boris_csv", "id_tags")
    with pytest.raises(ValueError, match="already"):
        labels.register(labels.converter_of("boris_csv", "behavior"))


def test_batch_conversion_by_recipe(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "labels")
    raw.mkdir()
    boris(raw)
    index = conversion.index_raw(spark, [str(raw)], "*.tsv", "boris_csv", group_from="name")
    own = labels.converter_of("boris_csv", "behavior")
    with pytest.raises(ValueError, match="1 label files failed"):
        labels.convert_all_labels(spark, index, own, out, strict=True, **PARAMS)
    assert not (tmp_path / "labels" / "behavior").exists() or not any((tmp_path / "labels" / "behavior").iterdir())
    first = labels.convert_all_labels(spark, index, own, out, **PARAMS)
    assert (first["failed"], first["entries"]) == (1, 2)
    assert labels.convert_all_labels(spark, index, own, out, **PARAMS)["entries"] == 0
    assert labels.convert_all_labels(spark, index, own, out, overwrite=True, **PARAMS)["entries"] == 2
    other = labels.convert_all_labels(spark, index, own, out, **(PARAMS | {"fps": 8.0}))
    assert other["folder"] != first["folder"] and other["entries"] == 2
    rows = {r["sequence"]: r for r in labels.label_index(labels.read_labels(spark, first["folder"]), "behavior").collect()}
    assert (rows["one"]["n_frames"], rows["one"]["n_events"], rows["one"]["label_ids"], rows["one"]["label_names"]) == (4, 4, "1,2", "walk,rest")


def test_a_function_of_ones_own(spark, tmp_path):
    (tmp_path / "x.lst").write_text("3 7\n5 8\n")
    (tmp_path / "y.lst").write_text("boom\n")

    def lines(name, content, group, sequence):
        for line in content.decode().splitlines():
            frame, label = map(int, line.split())
            yield group, sequence, frame, label, f"l{label}", -1, -1

    index = conversion.index_raw(spark, [str(tmp_path)], "*.lst", "lines")
    done = labels.convert_all_labels(spark, index, lines, str(tmp_path / "out"), kind="marks")
    assert done["folder"].endswith("marks/authored") and (done["failed"], done["entries"]) == (1, 1)
    assert sorted((r["frame"], r["label"], r["name"], r["event"]) for r in labels.read_labels(spark, done["folder"]).collect()) == [(3, 7, "l7", 0), (5, 8, "l8", 1)]


def test_dense_and_event_arrays_and_annotations(spark, tmp_path):
    np.savez(tmp_path / "dense.npz", labels=np.array([0, 2, 1]))
    np.savez(tmp_path / "events.npz", frames=np.array([4, 4]), labels=np.array([1, 2]), individual_ids=np.array([[0, 1], [1, 0]]))
    index = conversion.index_raw(spark, [str(tmp_path)], "*.npz", "labels_npz", contents=True)
    events, failed = labels.convert_labels(spark, index, labels.converter_of("labels_npz", "behavior"), names=("none", "a", "b"))
    assert failed.isEmpty()
    got = sorted((r["sequence"], r["frame"], r["name"], r["id1"], r["id2"]) for r in events.collect())
    assert got == [("dense", 0, "none", -1, -1), ("dense", 1, "b", -1, -1), ("dense", 2, "a", -1, -1), ("events", 4, "a", 0, 1), ("events", 4, "b", 1, 0)]
    keys = np.zeros((2, 2, 2, 7)).tolist()
    (tmp_path / "c.json").write_text(json.dumps({"g": {"s": {"keypoints": keys, "annotations": [3, 0]}, "t": {"keypoints": keys}}}))
    index = conversion.index_raw(spark, [str(tmp_path)], "*.json", "calms21")
    events, _ = labels.convert_labels(spark, index, labels.converter_of("calms21", "behavior"))
    assert sorted((r["sequence"], r["frame"], r["name"], r["id2"]) for r in events.collect()) == [("s", 0, "other", 1), ("s", 1, "attack", 1)]


def test_deeplabcut_and_detections_through_the_registry(spark, tmp_path):
    (tmp_path / "g__m.csv").write_text("scorer,s,s,s,s,s,s\nindividuals,p,p,p,q,q,q\nbodyparts,n,n,n,n,n,n\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.8\n1,5,6,0.9,,8,0.1\n")
    (tmp_path / "g__k.csv").write_text("scorer,s,s,s,s,s,s\nbodyparts,n,n,n,t,t,t\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.8\n")
    index = conversion.index_raw(spark, [str(tmp_path)], "*.csv", "deeplabcut_csv", group_from="name", contents=True)
    rows, failed = conversion.convert(spark, index, "deeplabcut_csv", points=2)
    assert failed.isEmpty()
    want = readers.deeplabcut_csv(spark, str(tmp_path / "g__k.csv"), "g", "k")
    pick = lambda df: sorted((r["sequence"], r["id"], r["frame"], r["X"], r["poseX0"], r["poseP0"]) for r in df.select("sequence", "id", "frame", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("X", "poseX0", "poseP0")]).collect())
    got = pick(rows)
    assert [r for r in got if r[0] == "k"] == pick(want)
    assert ("m", 1, 0, 3.0, 3.0, 0.8) in got and ("m", 1, 1, None, None, 0.1) in got
    assert conversion.convert(spark, index, "deeplabcut_csv", points=1)[1].count() == 1
    box = pd.DataFrame({"frame": [0, 0], "track_id": [9, 4], "x1": [0.0, 0.0], "y1": [0.0, 2.0], "x2": [2.0, 2.0], "y2": [4.0, 4.0], "conf": [0.5, 0.6], "cls": [0, 1], "kpx0": [1.5, np.nan], "kpy0": [1.0, np.nan]})
    held = io.BytesIO()
    box.to_parquet(held)
    (tmp_path / "g__u.parquet").write_bytes(held.getvalue())
    index = conversion.index_raw(spark, [str(tmp_path)], "*.parquet", "ultralytics", group_from="name", contents=True)
    assert sorted((r["id"], r["X"], r["Y"], r["cls"], r["bbox_y1"]) for r in conversion.convert(spark, index, "ultralytics", points=1)[0].collect()) == [(0, 1.0, 3.0, 1, 2.0), (1, 1.5, 1.0, 0, 0.0)]


def test_names_are_decoded_without_python(spark, tmp_path):
    (tmp_path / "a%20b+c__100%.tsv").write_text("x")
    rows = conversion.index_raw(spark, [str(tmp_path)], "*.tsv", "x", group_from="name").select("group", "sequence").collect()
    assert rows[0]["sequence"] in ("100%",) and rows[0]["group"] in ("a b+c", "a%20b+c")
