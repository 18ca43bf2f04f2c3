"""Readers of track files. Spark lists and reads the files; what it can't parse itself comes as `binaryFile` rows and
is parsed by small functions in tasks, one file at a time."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ENTRY, FRAME, ID


def union_by_columns(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; a column that a table lacks is null. Columns come out sorted."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track tables written by `write_tracks`; sequences may differ in their extra columns."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.withColumns({c: F.col(c).cast("string") for c in ENTRY if c in df.columns})


def ultralytics(df: DataFrame) -> DataFrame:
    """Detections (group, sequence, frame, track_id, x1, y1, x2, y2, conf, cls, kpx*, kpy*, kpp*) as tracks: ids dense
    from 0 in the order of track ids, X and Y the mean of finite keypoints, else the middle of the box."""
    points = sorted((c[3:] for c in df.columns if c.startswith("kpx")), key=int)
    dense = F.dense_rank().over(Window.partitionBy(*ENTRY).orderBy("track_id")) - 1
    out = df.where("track_id is not null").withColumn(ID, dense.cast("long"))
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    mean = lambda a: F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(F.filter(a, lambda x: x.isNotNull())), F.lit(0))
    for axis, low, high in (("X", "x1", "x2"), ("Y", "y1", "y2")):
        middle = (F.col(low) + F.col(high)) / 2
        out = out.withColumn(axis, F.coalesce(mean(F.array(*[finite(f"kp{axis.lower()}{p}").cast("double") for p in points])), middle) if points else middle)
    names = {f"kp{a}{p}": f"pose{b}{p}" for p in points for a, b in (("x", "X"), ("y", "Y"), ("p", "P"))} | {"x1": "bbox_x1", "y1": "bbox_y1", "x2": "bbox_x2", "y2": "bbox_y2"}
    return out.withColumnsRenamed({k: v for k, v in names.items() if k in out.columns}).drop("track_id")


def deeplabcut_csv(spark: SparkSession, path: str, group: str, sequence: str, fps: float = 30.0) -> DataFrame:
    """One CSV file with three or four header rows (scorer, individuals if there are several, bodyparts, coords). Only
    the file's head is read here; the body is a plain CSV scan, unpivoted by individual."""
    head = [line.split(",") for line in _head(spark, path, 4)]
    several = head[1][0] == "individuals"
    rows = head[: 4 if several else 3]
    who = rows[1][1:] if several else ["0"] * (len(rows[1]) - 1)
    part, coord = rows[-2][1:], rows[-1][1:]
    names = [FRAME] + [f"c{i}" for i in range(len(coord))]
    body = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names)).where(F.col(FRAME).rlike(r"^\s*\d+\s*$"))
    parts = list(dict.fromkeys(part))
    number = {n: i for i, n in enumerate(dict.fromkeys(who))}
    kind = {"x": "poseX", "y": "poseY", "likelihood": "poseP"}
    records = []
    for w, i in number.items():
        own = {(p, c): k for k, (x, p, c) in enumerate(zip(who, part, coord)) if x == w}
        fields = [F.lit(i).cast("long").alias(ID)] + [F.expr(f"try_cast(c{own[p, c]} as double)").alias(f"{kind[c]}{parts.index(p)}") if (p, c) in own else F.lit(None).cast("double").alias(f"{kind[c]}{parts.index(p)}") for p in parts for c in kind]
        records.append(F.struct(*fields))
    out = body.select(F.trim(FRAME).cast("long").alias(FRAME), F.explode(F.array(*records)).alias("r")).select(FRAME, "r.*")
    x, y = (F.array(*[F.col(f"pose{a}{i}") for i in range(len(parts))]) for a in "XY")
    mean = lambda a: F.aggregate(F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v))), F.lit(0))
    return out.withColumns({"group": F.lit(group), "sequence": F.lit(sequence), "time": F.col(FRAME) / F.lit(fps), "X": mean(x), "Y": mean(y)})


def deeplabcut_parser(points: int, fps: float = 30.0) -> tuple[T.StructType, Callable[[str, bytes], Iterator[pd.DataFrame]]]:
    """Schema and parser of files as `deeplabcut_csv` reads them, for batch conversion: `points` body parts, in the order in
    which a file names them first; parts that a file lacks are missing, and a file of more parts is an error."""
    values = ["X", "Y", *[f"pose{a}{i}" for i in range(points) for a in "XYP"]]
    schema = T.StructType([T.StructField(ID, T.LongType()), T.StructField(FRAME, T.LongType()), T.StructField("time", T.DoubleType()), *[T.StructField(v, T.DoubleType()) for v in values]])
    kind = {"x": "X", "y": "Y", "likelihood": "P"}

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        lines = content.decode("utf-8-sig").splitlines()
        several = lines[1].split(",")[0] == "individuals"
        head = [line.split(",")[1:] for line in lines[1 : 4 if several else 3]]
        who, part, coord = head if several else (["0"] * len(head[0]), *head)
        parts, whose = list(dict.fromkeys(part)), list(dict.fromkeys(who))
        if len(parts) > points:
            raise ValueError(f"{len(parts)} body parts, {points} expected")
        body = pd.read_csv(io.StringIO("\n".join(lines[4 if several else 3 :])), header=None)
        body = body[pd.to_numeric(body[0], errors="coerce").notna()]
        frames = body[0].astype(np.int64).to_numpy()
        for i, w in enumerate(whose):
            out = {f"pose{a}{p}": np.full(len(body), np.nan) for p in range(points) for a in "XYP"}
            for c, (x, p, k) in enumerate(zip(who, part, coord)):
                if x == w and k in kind:
                    out[f"pose{kind[k]}{parts.index(p)}"] = pd.to_numeric(body[c + 1], errors="coerce").to_numpy(float)
            centre = {a: pd.DataFrame({p: out[f"pose{a}{p}"] for p in range(points)}).mean(axis=1).to_numpy() for a in "XY"}
            yield pd.DataFrame({ID: i, FRAME: frames, "time": frames / fps, **centre, **out})

    return schema, parse


def ultralytics_parser(points: int = 0, fps: float = 30.0) -> tuple[T.StructType, Callable[[str, bytes], Iterator[pd.DataFrame]]]:
    """Schema and parser of one sequence's Parquet file of detections, by the rules of `ultralytics`."""
    values = ["X", "Y", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "conf", *[f"pose{a}{i}" for i in range(points) for a in "XYP"]]
    schema = T.StructType([T.StructField(ID, T.LongType()), T.StructField(FRAME, T.LongType()), T.StructField("time", T.DoubleType()), *[T.StructField(v, T.DoubleType()) for v in values], T.StructField("cls", T.LongType())])

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = pd.read_parquet(io.BytesIO(content))
        rows = rows[rows["track_id"].notna()].reset_index(drop=True)
        get = lambda c: rows[c].to_numpy(float) if c in rows else np.full(len(rows), np.nan)
        out = {f"bbox_{c}": get(c) for c in ("x1", "y1", "x2", "y2")} | {"conf": get("conf")}
        out |= {f"pose{a}{i}": get(f"kp{a.lower()}{i}") for i in range(points) for a in "XYP"}
        for a in "XY":
            middle = (out[f"bbox_{a.lower()}1"] + out[f"bbox_{a.lower()}2"]) / 2
            own = pd.DataFrame({i: out[f"pose{a}{i}"] for i in range(points)}, index=rows.index).mean(axis=1).to_numpy(float) if points else np.full(len(rows), np.nan)
            out[a] = np.where(np.isnan(own), middle, own)
        frames = rows["frame"].to_numpy(np.int64)
        dense = rows["track_id"].rank(method="dense").astype(np.int64).to_numpy() - 1
        yield pd.DataFrame({ID: dense, FRAME: frames, "time": frames / fps, **out, "cls": pd.array(rows["cls"] if "cls" in rows else [None] * len(rows), dtype="Int64")})

    return schema, parse


def _head(spark: SparkSession, path: str, lines: int) -> list[str]:
    """The first lines of one file."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.isFile(name):
        raise ValueError(f"{path} is not one file")
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(name), "UTF-8"))
    try:
        return [line for _ in range(lines) if (line := reader.readLine()) is not None]
    finally:
        reader.close()


def _files(spark: SparkSession, path: str, parse, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield from parse(name, content)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def trex_parser(points: int = 7) -> tuple[T.StructType, Callable[[str, bytes], Iterator[pd.DataFrame]]]:
    """Schema and parser of one individual's npz: arrays by frame, short ones padded with NaN; the id from its array or
    the file's name. Lengths come in centimetres and leave in pixels by cm_per_pixel; X#wcentroid and Y#wcentroid become
    X and Y, the head's position stays as X#head and Y#head."""
    values = ["X", "Y", "X#head", "Y#head", "ANGLE", *[f"pose{a}{i}" for i in range(points) for a in "XY"]]
    schema = T.StructType([T.StructField(ID, T.LongType()), T.StructField(FRAME, T.LongType()), T.StructField("time", T.DoubleType()), *[T.StructField(v, T.DoubleType()) for v in values]])

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        data = np.load(io.BytesIO(content), allow_pickle=False)
        n = len(data["frame"])

        def column(key: str, scale: float = 1.0) -> np.ndarray:
            out = np.full(n, np.nan)
            if key in data:
                own = np.ravel(data[key]).astype(float)[:n]
                out[: len(own)] = own / scale
            return out

        own = np.ravel(data["id"])[0] if "id" in data and np.size(data["id"]) else int("".join(c for c in name.rsplit("_", 1)[-1] if c.isdigit()) or 0)
        cm = float(np.ravel(data["cm_per_pixel"])[0]) if "cm_per_pixel" in data else 1.0
        centre = "X#wcentroid" in data
        out = {ID: np.full(n, int(own)), FRAME: np.ravel(data["frame"]).astype(np.int64), "time": column("time")}
        out |= {"X": column("X#wcentroid" if centre else "X", cm), "Y": column("Y#wcentroid" if centre else "Y", cm), "X#head": column("X", cm), "Y#head": column("Y", cm), "ANGLE": column("ANGLE")}
        out |= {f"pose{a}{i}": column(f"pose{a}{i}", cm) for i in range(points) for a in "XY"}
        yield pd.DataFrame(out)

    return schema, parse


def trex_npz(spark: SparkSession, path: str, group: str, sequence: str, points: int = 7) -> DataFrame:
    """The npz files of one sequence, one an individual (see `trex_parser`)."""
    schema, parse = trex_parser(points)
    return _files(spark, path, parse, schema).withColumns({"group": F.lit(group), "sequence": F.lit(sequence)})


def calms21_parser(fps: float = 30.0, points: int = 7) -> tuple[T.StructType, Callable[[str, bytes], Iterator[pd.DataFrame]]]:
    """Schema and parser of {group: {sequence: {keypoints (T, 2, 2, points), scores?, annotations?}}}, as JSON or as an npy
    file that holds such a JSON text: two individuals a frame, X and Y the mean of the keypoints, label from the
    annotations."""
    values = [f"pose{a}{i}" for i in range(points) for a in "XYP"]
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("sequence", T.StringType()), T.StructField(ID, T.LongType()), T.StructField(FRAME, T.LongType()), T.StructField("time", T.DoubleType()), T.StructField("X", T.DoubleType()), T.StructField("Y", T.DoubleType()), *[T.StructField(v, T.DoubleType()) for v in values], T.StructField("label", T.LongType())])

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        text = str(np.load(io.BytesIO(content), allow_pickle=False)) if content[:6] == b"\x93NUMPY" else content
        for group, sequences in json.loads(text).items():
            for sequence, own in sequences.items():
                k = np.array(own["keypoints"], float)
                scores = np.array(own["scores"], float) if own.get("scores") is not None else np.full((len(k), 2, points), np.nan)
                labels = np.array(own["annotations"]) if own.get("annotations") is not None else None
                labels = labels[:, 0] if labels is not None and labels.ndim > 1 else labels
                for i in range(k.shape[1]):
                    out = {"group": group, "sequence": sequence, ID: i, FRAME: np.arange(len(k)), "time": np.arange(len(k)) / fps, "X": k[:, i, 0].mean(1), "Y": k[:, i, 1].mean(1)}
                    for p in range(points):
                        out |= {f"poseX{p}": k[:, i, 0, p], f"poseY{p}": k[:, i, 1, p], f"poseP{p}": scores[:, i, p]}
                    yield pd.DataFrame(out | {"label": pd.array(labels if labels is not None else [None] * len(k), dtype="Int64")})

    return schema, parse


def calms21_json(spark: SparkSession, path: str, fps: float = 30.0, points: int = 7) -> DataFrame:
    """Files of whole groups of sequences (see `calms21_parser`)."""
    schema, parse = calms21_parser(fps, points)
    return _files(spark, path, parse, schema)


def npz_array(spark: SparkSession, path: str, key: str, transpose: bool = False) -> DataFrame:
    """(path, row, values) of one array of each npz file that the path or glob names; a vector is one value a row."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        data = np.load(io.BytesIO(content), allow_pickle=False)
        if key not in data:
            raise ValueError(f"{name} holds no array {key!r}")
        found = np.atleast_1d(data[key].astype(float))
        found = found.reshape(len(found), -1)
        found = found.T if transpose else found
        yield pd.DataFrame({"path": name, "row": np.arange(len(found)), "values": list(found)})

    return _files(spark, path, parse, schema)


def table_artifact(spark: SparkSession, path: str, columns: list[str] | None = None, drop: list[str] | None = None, numeric_only: bool = False) -> DataFrame:
    """A Parquet artifact with the columns that are asked for; the selection reaches the scan."""
    df = spark.read.parquet(path)
    chosen = [f.name for f in df.schema if (not numeric_only or isinstance(f.dataType, T.NumericType)) and f.name not in (drop or []) and (columns is None or f.name in columns)]
    if missing := [c for c in columns or [] if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return df.select(*chosen)


# ---- labels and tags


def boris_events(spark: SparkSession, path: str, subjects: dict[str, int], behaviors: list[str], separator: str = "\t", fps: float | None = None) -> DataFrame:
    """Aggregated event rows as one row per frame: frame, label (place in `behaviors`, from 1), id1 and id2 = -1.

    A state event covers int(start * fps) to int(stop * fps), both included; a point event covers its first frame.
    """
    rows = spark.read.csv(path, sep=separator, header=True)
    columns = {c.strip().lower(): c for c in rows.columns}
    get = lambda name: F.col(f"`{columns[name]}`")
    rate = F.lit(float(fps)) if fps else get("fps").cast("double")
    start = (get("start (s)").cast("double") * rate).cast("int")
    stop = F.when(F.upper(get("behavior type")) == "POINT", start).otherwise((get("stop (s)").cast("double") * rate).cast("int"))
    who = F.create_map(*[F.lit(x) for kv in subjects.items() for x in kv])
    label = F.array_position(F.array(*map(F.lit, behaviors)), get("behavior")).cast("int")
    out = rows.select(get("observation id").alias("sequence"), F.explode(F.sequence(start, F.greatest(start, stop))).alias(FRAME), label.alias("label"), F.coalesce(F.try_element_at(who, get("subject")), F.lit(-1)).alias("id1"), F.lit(-1).alias("id2"))
    return out.where("label > 0")


def pair_labels(spark: SparkSession, path: str, names: tuple[str, ...] = ("attack", "investigation", "mount", "other")) -> DataFrame:
    """CalMS21 annotations as events of the resident (0) towards the intruder (1)."""
    tracks = calms21_json(spark, path).where((F.col(ID) == 0) & F.col("label").isNotNull())
    return tracks.select(*ENTRY, FRAME, "label", F.get(F.array(*map(F.lit, names)), F.col("label").cast("int")).alias("name"), F.lit(0).alias("id1"), F.lit(1).alias("id2"))


def id_tags(spark: SparkSession, path: str, kind: str, fields: list[str], all_ids: DataFrame | None = None) -> DataFrame:
    """Tags from a CSV whose group and sequence are text, so leading zeros stay.

    `focal`: the row's focal_id is tagged focal = 1, all other ids of the entry 0. `category` and `multi`: the named
    fields of each id.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    entry = [c for c in ENTRY if c in raw.columns]
    if kind == "focal":
        ids = all_ids.select(*entry, ID).distinct()
        focal = raw.select(*entry, F.col("focal_id").cast("long").alias("_focal"))
        return ids.join(focal, entry).select(*entry, ID, (F.col(ID) == F.col("_focal")).cast("int").alias("focal"))
    if kind not in ("category", "multi"):
        raise ValueError(f"unknown kind of tags {kind!r}")
    return raw.select(*entry, F.col(ID).cast("long").alias(ID), *fields)


# ---- annotations


def coco_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotated keypoint: image, annotation, box, point number, x, y, visibility."""
    doc = spark.read.option("multiLine", "true").json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"))
    each = doc.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("annotation_id"), F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("category_id"), F.col("a.bbox").alias("bbox"), F.col("a.keypoints").cast("array<double>").alias("k"))
    points = F.transform(F.sequence(F.lit(0), (F.size("k") / 3 - 1).cast("int")), lambda i: F.struct(F.get("k", i * 3).alias("x"), F.get("k", i * 3 + 1).alias("y"), F.get("k", i * 3 + 2).cast("int").alias("visibility")))
    rows = each.where(F.size("k") >= 3).select("annotation_id", "image_id", "category_id", "bbox", F.posexplode(points).alias("point", "p"))
    return rows.select("annotation_id", "image_id", "category_id", "bbox", "point", "p.*").join(images, "image_id", "left")


def yolo_pose(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Label lines (class, box centre and size, then x, y, visibility per point, all relative) in pixels."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").cast("array<double>").alias("v")).where(F.size("v") >= 5)
    px = lambda i, size: F.get("v", i) * size
    n = ((F.size("v") - 5) / 3).cast("int")
    points = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(px(5 + i * 3, width).alias("x"), px(6 + i * 3, height).alias("y"), F.get("v", 7 + i * 3).cast("int").alias("visibility")))
    return lines.select("file", F.get("v", F.lit(0)).cast("int").alias("category_id"), px(F.lit(1), width).alias("cx"), px(F.lit(2), height).alias("cy"), px(F.lit(3), width).alias("w"), px(F.lit(4), height).alias("h"), points.alias("points"))


def cvat_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of CVAT images XML: one row per point."""
    doc = spark.read.format("xml").option("rowTag", "image").option("inferSchema", "true").load(path)
    kind = doc.schema["points"].dataType
    rows = doc.select(F.col("_id").alias("image_id"), F.col("_name").alias("file_name"), (F.explode("points") if isinstance(kind, T.ArrayType) else F.col("points")).alias("p"))
    xy = F.explode(F.split("p._points", ";"))
    pair = F.split("xy", ",").cast("array<double>")
    return rows.select("image_id", "file_name", F.col("p._label").alias("label"), xy.alias("xy")).select("image_id", "file_name", "label", F.get(pair, 0).alias("x"), F.get(pair, 1).alias("y"))
