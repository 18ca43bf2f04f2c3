"""From raw files to track tables: an index of files, converters by format, and one job for all files of a format."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ENTRY
from . import readers
from .writers import write_tracks

INDEX = ["path", "group", "sequence", "src_format", "size_bytes", "modified", "md5"]


@dataclass
class Converter:
    """How files of a format are read: `make(**params)` gives a schema and a parser of one file."""

    src_format: str
    version: str
    make: Callable[..., tuple[T.StructType, Callable[[str, bytes], Iterator[pd.DataFrame]]]]


CONVERTERS: dict[str, Converter] = {}


def register(converter: Converter) -> Converter:
    if converter.src_format in CONVERTERS:
        raise ValueError(f"there is a converter for {converter.src_format!r} already")
    CONVERTERS[converter.src_format] = converter
    return converter


def converter_of(src_format: str) -> Converter:
    if src_format not in CONVERTERS:
        raise ValueError(f"no converter for {src_format!r}; there are {sorted(CONVERTERS)}")
    return CONVERTERS[src_format]


register(Converter("trex_npz", "1", readers.trex_parser))
register(Converter("calms21", "1", readers.calms21_parser))
register(Converter("deeplabcut_csv", "1", readers.deeplabcut_parser))
register(Converter("ultralytics", "1", readers.ultralytics_parser))


def _decoded(name: Column) -> Column:
    """Percent-encoding undone, as far as it is one; a plus is a plus."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def _path(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    name, system = _path(spark, path)
    return system.exists(name)


@contextmanager
def staged(spark: SparkSession, df: DataFrame, beside: str) -> Iterator[DataFrame]:
    """The rows of `df`, computed once and written beside a folder for as long as the context lasts."""
    at = f"{beside.rstrip('/')}.{uuid.uuid4().hex}"
    schema = df.schema
    try:
        df.write.parquet(at)
        yield spark.read.schema(schema).parquet(at)
    finally:
        name, system = _path(spark, at)
        system.delete(name, True)


def contents_of(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The index with the files' contents: from its own column, or by a scan of the paths that it names."""
    if "content" in index.columns:
        return index
    paths = [r["path"] for r in index.select("path").distinct().collect()]
    files = spark.read.format("binaryFile").load(paths).select("path", "content") if paths else spark.createDataFrame([], "path string, content binary")
    return files.join(index, "path")


def index_raw(spark: SparkSession, roots: list[str], pattern: str, src_format: str, exclude: list[str] | None = None, group_from: str = "none", checksum: bool = False, contents: bool = False) -> DataFrame:
    """INDEX of the files below the roots whose names match the glob `pattern` and none of the globs in `exclude`.

    The sequence is the file's name without its ending. The group is empty, the name of the folder (`parent`), or what
    the name has before two underscores (`name`, the sequence being the rest). Only with `checksum` are contents read,
    by the executors. With `contents` the index has a column of them, which is read where it is used, so a conversion is one
    scan of the roots, without a list of paths or a join.
    """
    if group_from not in ("none", "parent", "name"):
        raise ValueError(f"no rule {group_from!r} for groups")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    for e in exclude or []:
        glob = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in e)
        files = files.where(~name.rlike(f"^{glob}$"))
    stem = _decoded(F.regexp_replace(name, r"\.[^.]*$", ""))
    group = {"none": F.lit(""), "parent": _decoded(F.element_at(parts, -2)), "name": F.when(stem.contains("__"), F.substring_index(stem, "__", 1)).otherwise("")}[group_from]
    sequence = F.when(stem.contains("__"), F.regexp_replace(stem, "^.*?__", "")).otherwise(stem) if group_from == "name" else stem
    md5 = F.md5("content") if checksum else F.lit(None).cast("string")
    return files.select("path", group.alias("group"), sequence.alias("sequence"), F.lit(src_format).alias("src_format"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), md5.alias("md5"), *(["content"] if contents else []))


def _parsed(spark: SparkSession, index: DataFrame, src_format: str, merge_per_sequence: bool, params: dict) -> DataFrame:
    """The rows of all files with path and error; an error comes alone, in a row without a frame."""
    schema, parse = converter_of(src_format).make(**params)
    own_entry = set(ENTRY) <= set(schema.names)
    entry = [] if own_entry else [T.StructField(c, T.StringType()) for c in ENTRY]
    found = T.StructType([T.StructField("path", T.StringType()), *schema, *entry, T.StructField("error", T.StringType())])
    rows = index.where(F.col("src_format") == src_format).select("path", *ENTRY, *(["content"] if "content" in index.columns else []))
    refused = None
    if not merge_per_sequence and not own_entry:
        alone = rows.groupBy(*ENTRY).agg(F.count("*").alias("files"))
        refused = rows.drop("content").join(alone.where("files > 1"), ENTRY, "left_semi")
        rows = rows.join(alone.where("files = 1"), ENTRY, "left_semi")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group, sequence, content in zip(batch["path"], batch["group"], batch["sequence"], batch["content"]):
                entry = {} if own_entry else {"group": group, "sequence": sequence}
                try:
                    parts = list(parse(name, content))
                except Exception as e:  # noqa: BLE001 - whatever a broken file raises is reported with its name
                    yield pd.DataFrame({"path": [name], "group": [group], "sequence": [sequence], "error": [f"{type(e).__name__}: {e}"]}).reindex(columns=found.names)
                    continue
                for part in parts:
                    yield part.assign(path=name, error=None, **entry)[found.names]

    parsed = contents_of(spark, rows).select("path", *ENTRY, "content").mapInPandas(read, found)
    if refused is not None:
        why = F.lit("several files of one entry, which are not to be merged")
        parsed = parsed.unionByName(refused.select("path", *ENTRY, why.alias("error")), allowMissingColumns=True)
    return parsed


def _split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where("error is null").drop("error", "path"), parsed.where("error is not null").select("path", *ENTRY, "error")


def convert(spark: SparkSession, index: DataFrame, src_format: str, merge_per_sequence: bool = True, **params) -> tuple[DataFrame, DataFrame]:
    """The rows of all files of a format in the index, and a report (path, group, sequence, error) of those that failed.

    A file that can't be read, or one of several of an entry unless `merge_per_sequence`, costs its own rows only.
    Files that name group and sequence themselves keep theirs. Each file is parsed by one task.
    """
    return _split(_parsed(spark, index, src_format, merge_per_sequence, params))


def convert_all(spark: SparkSession, index: DataFrame, src_format: str, out: str, overwrite: bool = False, strict: bool = False, merge_per_sequence: bool = True, **params) -> dict[str, int]:
    """Converts the entries of the index that `out` doesn't hold yet, or all with `overwrite`, and writes them there.

    Returns how many files there were, how many failed and how many entries were written. With `strict` a failure
    raises before anything is written.
    """
    todo, again = index.where(F.col("src_format") == src_format), exists(spark, out) and not overwrite
    if again:
        todo = todo.join(readers.read_tracks(spark, out).select(*ENTRY).distinct(), ENTRY, "left_anti")
    files = todo.count()
    with staged(spark, _parsed(spark, todo, src_format, merge_per_sequence, params), out) as parsed:
        tracks, failures = _split(parsed)
        failed = failures.count()
        if strict and failed:
            first = failures.first()
            raise ValueError(f"{failed} of {files} files failed; {first['path']}: {first['error']}")
        if again:  # files that name their entries themselves
            tracks = tracks.join(readers.read_tracks(spark, out).select(*ENTRY).distinct(), ENTRY, "left_anti")
        written = tracks.select(*ENTRY).distinct().count()
        if written:
            write_tracks(tracks, out)
    return {"files": files, "failed": failed, "entries": written}


def tracks_of(spark: SparkSession, index: DataFrame, src_format: str, out: str, group: str, sequence: str, **params) -> DataFrame:
    """The tracks of one entry, converted first if `out` doesn't hold them yet; an entry without readable files is an error."""
    own = (F.col("group") == group) & (F.col("sequence") == sequence)
    held = readers.read_tracks(spark, out).where(own) if exists(spark, out) else None
    if held is None or held.isEmpty():
        done = convert_all(spark, index.where(own), src_format, out, overwrite=True, **params)
        if not done["entries"]:
            raise LookupError(f"no tracks of {(group, sequence)}: {done['files']} files, {done['failed']} of them failed")
        held = readers.read_tracks(spark, out).where(own)
    return held
