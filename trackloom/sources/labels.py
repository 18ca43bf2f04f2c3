"""Label files to events: converters by format and kind, functions of one's own, one job for all files of an index.

A converter is a function of one file, `parse(name, content, group, sequence)`, that yields events. Spark runs it as a
table function beside each row of the index, so files are dealt like any rows, and a file that can't be read becomes a
row of the report.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import ENTRY, FRAME
from ..plans.catalog import run_id
from . import readers
from .conversion import contents_of, exists, staged

EVENTS = "`group` string, sequence string, frame long, label int, name string, id1 long, id2 long, event long"
#: group, sequence, frame, label, name, id1, id2; ids are -1 where a label is no individual's or no pair's.
Event = tuple
Parser = Callable[[str, bytes, str, str], Iterator[Event]]


@dataclass
class LabelConverter:
    """How label files of a format are read for a kind of labels: `make(**params)` gives the parser of one file."""

    src_format: str
    kind: str
    version: str
    make: Callable[..., Parser]


CONVERTERS: dict[tuple[str, str], LabelConverter] = {}


def register(converter: LabelConverter) -> LabelConverter:
    key = (converter.src_format, converter.kind)
    if key in CONVERTERS:
        raise ValueError(f"there is a label converter for {key} already")
    CONVERTERS[key] = converter
    return converter


def converter_of(src_format: str, kind: str) -> LabelConverter:
    if (src_format, kind) not in CONVERTERS:
        raise ValueError(f"no label converter for {(src_format, kind)}; there are {sorted(CONVERTERS)}")
    return CONVERTERS[src_format, kind]


def boris_labels(subjects: dict[str, int], behaviors: list[str], separator: str = "\t", fps: float | None = None, one_sequence: bool = True) -> Parser:
    """Aggregated event rows. A state covers int(start * fps) to int(stop * fps), both included, a point its first frame;
    labels are places in `behaviors`, from 1, and other behaviours are left out. The sequence is the file's, or with
    `one_sequence` false the row's observation."""

    def parse(name: str, content: bytes, group: str, sequence: str) -> Iterator[Event]:
        rows = csv.DictReader(io.StringIO(content.decode("utf-8-sig")), delimiter=separator)
        rows.fieldnames = [c.strip().lower() for c in rows.fieldnames or []]
        for r in rows:
            rate = fps or float(r["fps"])
            first = int(float(r["start (s)"]) * rate)
            last = first if r["behavior type"].strip().upper() == "POINT" else int(float(r["stop (s)"]) * rate)
            if r["behavior"] in behaviors:
                own = sequence if one_sequence else r["observation id"]
                for frame in range(first, max(first, last) + 1):
                    yield group, own, frame, behaviors.index(r["behavior"]) + 1, r["behavior"], subjects.get(r["subject"], -1), -1

    return parse


def calms21_labels(names: tuple[str, ...] = ("attack", "investigation", "mount", "other"), fps: float = 30.0, points: int = 7) -> Parser:
    """Annotations of the resident (0) towards the intruder (1), a label a frame; the file names group and sequence."""
    _, tracks = readers.calms21_parser(fps, points)

    def parse(name: str, content: bytes, group: str, sequence: str) -> Iterator[Event]:
        for part in tracks(name, content):
            part = part[(part["id"] == 0) & part["label"].notna()]
            for g, s, frame, label in zip(part["group"], part["sequence"], part[FRAME], part["label"]):
                yield g, s, int(frame), int(label), names[int(label)] if int(label) < len(names) else None, 0, 1

    return parse


def dense_labels(names: tuple[str, ...] = ()) -> Parser:
    """An npz file with one label a frame (`labels`), or with events (`frames`, `labels`, `individual_ids` of two columns)."""

    def parse(name: str, content: bytes, group: str, sequence: str) -> Iterator[Event]:
        data = np.load(io.BytesIO(content), allow_pickle=False)
        labels = np.ravel(data["labels"]).astype(int)
        frames = np.ravel(data["frames"]).astype(int) if "frames" in data else np.arange(len(labels))
        ids = data["individual_ids"].reshape(-1, 2).astype(int) if "individual_ids" in data else np.full((len(labels), 2), -1)
        for frame, label, (a, b) in zip(frames.tolist(), labels.tolist(), ids.tolist()):
            yield group, sequence, frame, label, names[label] if label < len(names) else None, a, b

    return parse


register(LabelConverter("boris_csv", "behavior", "1", boris_labels))
register(LabelConverter("calms21", "behavior", "1", calms21_labels))
register(LabelConverter("labels_npz", "behavior", "1", dense_labels))


def _table_function(parse: Parser):
    class Converted:
        def eval(self, path: str, content: bytes, group: str, sequence: str):
            try:
                rows = list(parse(path, bytes(content), group, sequence))
            except Exception as e:  # noqa: BLE001 - whatever a broken file raises is reported with its name
                yield (group, sequence, *[None] * 6, f"{type(e).__name__}: {e}")
                return
            for i, row in enumerate(rows):
                yield (*row, i, None)

    return F.udtf(Converted, returnType=f"{EVENTS}, error string")


def _parsed(spark: SparkSession, index: DataFrame, converter: LabelConverter | Parser, params: dict) -> DataFrame:
    """EVENTS of all files with path and error: an error comes alone, in a row without a frame."""
    if isinstance(converter, LabelConverter):
        index, parse = index.where(F.col("src_format") == converter.src_format), converter.make(**params)
    else:
        parse = converter
    name = f"convert_labels_{uuid.uuid4().hex}"
    spark.udtf.register(name, _table_function(parse))
    files = contents_of(spark, index).select("path", "content", *[F.col(c).alias(f"_{c}") for c in ENTRY])
    return spark.sql(f"SELECT f.path, e.* FROM {{files}} AS f, LATERAL {name}(f.path, f.content, f._group, f._sequence) AS e", files=files)


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("error is null").drop("error", "path"), rows.where("error is not null").select("path", *ENTRY, "error")


def convert_labels(spark: SparkSession, index: DataFrame, converter: LabelConverter | Parser, **params) -> tuple[DataFrame, DataFrame]:
    """EVENTS of all files of the index, and a report (path, group, sequence, error) of the files that failed.

    `converter` is one of CONVERTERS, which reads the files of its format and takes `params`, or a parser of one's own,
    which reads all of them. `event` numbers the events of a file. A file that fails gives no event.
    """
    return _split(_parsed(spark, index, converter, params))


def convert_all_labels(spark: SparkSession, index: DataFrame, converter: LabelConverter | Parser, out: str, kind: str | None = None, overwrite: bool = False, strict: bool = False, **params) -> dict:
    """Converts the index's files and writes their events below `out`, one folder an entry, in a folder of their own for
    every recipe (`<kind>/<version and digest of the params>`; `authored` for a function of one's own).

    Entries that are there stay unless `overwrite`. Each file is parsed once. Returns the folder, the number of files that
    failed and of entries written; with `strict` a failure raises before anything is written.
    """
    registered = isinstance(converter, LabelConverter)
    recipe = run_id(converter.version, {"format": converter.src_format, **params}, []) if registered else "authored"
    folder = f"{out.rstrip('/')}/{kind or (converter.kind if registered else 'behavior')}/{recipe}"
    with staged(spark, _parsed(spark, index, converter, params), folder) as parsed:
        new, failures = _split(parsed)
        failed = failures.count()
        if strict and failed:
            r = failures.first()
            raise ValueError(f"{failed} label files failed; {r['path']}: {r['error']}")
        if not overwrite and exists(spark, folder):
            new = new.join(read_labels(spark, folder).select(*ENTRY).distinct(), ENTRY, "left_anti")
        entries = new.select(*ENTRY).distinct().count()
        if entries:
            rows = new.repartition(*ENTRY).sortWithinPartitions(*ENTRY, FRAME, "event")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*ENTRY).parquet(folder)
    return {"folder": folder, "failed": failed, "entries": entries}


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(folder)
    return df.withColumns({c: F.col(c).cast("string") for c in ENTRY})


def label_index(events: DataFrame, kind: str) -> DataFrame:
    """One row an entry: kind, group, sequence, n_frames, n_events, label_ids and label_names in ascending order of ids."""
    named = F.array_sort(F.collect_set(F.struct("label", "name")))
    rows = events.groupBy(*ENTRY).agg(F.countDistinct(FRAME).alias("n_frames"), F.count("*").alias("n_events"), named.alias("_l"))
    text = lambda c: F.array_join(F.transform("_l", lambda x: F.coalesce(x[c].cast("string"), F.lit(""))), ",")
    return rows.select(F.lit(kind).alias("kind"), *ENTRY, "n_frames", "n_events", text("label").alias("label_ids"), text("name").alias("label_names"))
