"""Writers of track and feature tables, of rows as CSV indexes, and of annotations."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ENTRY, order_column


def write_tracks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One partition per entry, rows in order; Spark commits whole jobs, and a rerun replaces only what it holds."""
    order = [c for c in ("id", order_column(df.columns)) if c in df.columns]
    rows = df.repartition(*ENTRY).sortWithinPartitions(*ENTRY, *order)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*ENTRY).parquet(path)


def append_index(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """An index with new rows in place of old ones of the same key."""
    if old is None:
        return new.dropDuplicates(keys)
    return old.join(new, keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def write_index(df: DataFrame, path: str) -> None:
    """A CSV index: written beside the old one, which steps aside as `<path>.old` and goes once the new one is in place.
    A writer that is cut off in between leaves one of them whole, which `read_index` finds."""
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.csv(new, header=True)
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, aside = to_path(path), to_path(f"{path.rstrip('/')}.old")
    system = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(here):
        system.delete(aside, True)
        system.rename(here, aside)
    system.rename(to_path(new), here)
    system.delete(aside, True)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index, or the one before it if a writer was cut off."""
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here)
    return spark.read.csv(path if there else f"{path.rstrip('/')}.old", header=True)


def npz_entries(df: DataFrame, columns: list[str]) -> DataFrame:
    """(group, sequence, npz): the columns of each entry as arrays in the order of its rows, as the bytes of an npz file.
    A task holds one entry."""
    entry = [c for c in ENTRY if c in df.columns]
    order = [c for c in (order_column(df.columns), "id") if c in df.columns]
    schema = T.StructType([df.schema[c] for c in entry] + [T.StructField("npz", T.BinaryType())])

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own, out = own.sort_values(order, kind="stable"), io.BytesIO()
        np.savez_compressed(out, **{c: own[c].to_numpy() for c in columns})
        return own[entry].head(1).assign(npz=out.getvalue())

    return df.select(*entry, *dict.fromkeys([*order, *columns])).groupBy(*entry).applyInPandas(pack, schema)


def coco_document(points: DataFrame) -> DataFrame:
    """One JSON text per image with its annotations, from rows as `coco_keypoints` returns them."""
    each = points.groupBy("image_id", "file_name", "annotation_id", "category_id", "bbox")
    flat = each.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("point", "x", "y", "visibility"))), lambda p: F.array(p["x"], p["y"], p["visibility"].cast("double")))).alias("keypoints"))
    notes = F.collect_list(F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", "bbox", "keypoints")).alias("annotations")
    return flat.groupBy("image_id", "file_name").agg(notes).select("image_id", F.to_json(F.struct("image_id", "file_name", "annotations")).alias("document"))


def write_coco(points: DataFrame, path: str, categories: list[tuple[int, str]] = ()) -> None:
    """The annotations of all images, rows as `coco_keypoints` returns them, as one COCO document below `path`: text files
    whose contents, one after the other in the order of their names, are the document. No task holds more than its range of
    images and annotations."""
    keys = ["image_id", "annotation_id", "category_id", "bbox"]
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("point", "x", "y", "visibility"))), lambda p: F.array(p["x"], p["y"], p["visibility"].cast("double"))))
    notes = points.groupBy(*keys).agg(flat.alias("keypoints"), F.count(F.when(F.col("visibility") > 0, 1)).alias("num_keypoints"))
    notes = notes.select(F.col("annotation_id").alias("id"), F.to_json(F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", "bbox", "keypoints", "num_keypoints")).alias("text"))
    images = points.select(F.col("image_id").alias("id"), "file_name").distinct().withColumn("text", F.to_json(F.struct("id", "file_name")))

    def listed(rows: DataFrame, section: int) -> DataFrame:
        """Items of an array, each after a comma but the first."""
        first = rows.agg(F.min("id")).first()[0]
        text = F.when(F.col("id") == first, F.col("text")).otherwise(F.concat(F.lit(","), "text"))
        return rows.select(F.lit(section).alias("section"), F.col("id").cast("long").alias("id"), text.alias("text"))

    named = json.dumps([{"id": i, "name": n} for i, n in categories])
    fixed = points.sparkSession.createDataFrame([(0, 0, '{"images": ['), (2, 0, '], "annotations": ['), (4, 0, f'], "categories": {named}}}')], "section int, id long, text string")
    listed(images, 1).union(listed(notes, 3)).union(fixed).orderBy("section", "id").select("text").write.mode("overwrite").text(path)


def describe(df: DataFrame) -> str:
    """The schema as JSON, for manifests."""
    return json.dumps(json.loads(df.schema.json()), sort_keys=True)
