"""A catalogue of materialised runs: content-addressed ids, entries, lineage, staleness.

Two Parquet tables hold it: `runs`, one row per event of a run, and `entries`, one row per written entry. Rows are
only appended, and the newest row of a key counts, so writers never rewrite what others read.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..columns import ENTRY

RUNS = "feature string, run_id string, params string, upstream array<string>, status string, at double"
ENTRIES = "run_id string, `group` string, sequence string, path string, n_rows long, consumed string, at double"


def run_id(version: str, params: dict, inputs: list[str], frames: tuple | None = None, scope: list | None = None) -> str:
    """`version-` and 10 digits of the digest of the sorted description; `scope` is given by operators whose result
    depends on which entries they see. Values that JSON can't say are an error."""
    described = {"params": params, "inputs": inputs, "frames": frames} | ({"scope": sorted(map(list, scope))} if scope is not None else {})
    return f"{version}-{hashlib.sha1(json.dumps(described, sort_keys=True).encode()).hexdigest()[:10]}"


def storage_name(slug: str, inputs: list[str]) -> str:
    return f"{slug}__from__{'+'.join(inputs)}" if inputs else slug


@dataclass
class Catalog:
    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def runs(self) -> DataFrame:
        """The newest row of each run, with the time it started."""
        w = Window.partitionBy("feature", "run_id")
        all_ = self._read("runs", RUNS)
        newest = F.row_number().over(w.orderBy(F.desc("at"), F.desc(F.col("status") == "finished")))
        return all_.withColumns({"started_at": F.min("at").over(w), "_r": newest}).where("_r = 1").drop("_r")

    def entries(self, run: str | None = None) -> DataFrame:
        rows = self._read("entries", ENTRIES)
        rows = rows.where(F.col("run_id") == run) if run else rows
        newest = F.row_number().over(Window.partitionBy("run_id", *ENTRY).orderBy(F.desc("at")))
        return rows.withColumn("_r", newest).where("_r = 1 and path is not null").drop("_r")

    def record(self, feature: str, run: str, params: dict, upstream: list[str], status: str) -> None:
        row = (feature, run, json.dumps(params, sort_keys=True), upstream, status, time.time())
        self._append("runs", self.spark.createDataFrame([row], RUNS).coalesce(1))

    def note(self, event: dict) -> None:
        """Adds an event of a step to the log, as a line of JSON."""
        self.spark.createDataFrame([(json.dumps(event, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/log")

    def events(self) -> DataFrame:
        """The log: step, run_id, did, error, seconds, at; from the oldest on."""
        return self.spark.read.schema("step string, run_id string, did string, error string, seconds double, at double").json(f"{self.root}/log").orderBy("at")

    def resolve(self, feature: str, run: str | None = None) -> str:
        """The run that a reference means: the named one; else the only run that no other consumes, where runs of the
        feature consume one another; else the newest finished one, else the newest."""
        runs = self.runs().where(F.col("feature") == feature)
        if run is not None:
            if runs.where(F.col("run_id") == run).isEmpty():
                raise LookupError(f"{feature} has no run {run}")
            return run
        used = runs.select(F.explode("upstream").alias("run_id")).distinct()
        if not used.join(runs, "run_id", "left_semi").isEmpty():
            leaves = [r["run_id"] for r in runs.join(used, "run_id", "left_anti").select("run_id").limit(2).collect()]
            if len(leaves) != 1:
                raise LookupError(f"{feature} has several runs that nothing consumes; name one")
            return leaves[0]
        best = runs.orderBy(F.desc(F.col("status") == "finished"), F.desc("at")).select("run_id").limit(1).collect()
        if not best:
            raise LookupError(f"{feature} has no run")
        return best[0]["run_id"]

    def verdicts(self, run: str, current: DataFrame) -> DataFrame:
        """serve, recompute or undetectable for each entry of `current(group, sequence, consumed)`: serve where both
        digests are known and equal, or where neither is (undetectable); recompute where one is or they differ."""
        old = self.entries(run).select(*ENTRY, F.col("consumed").alias("_old"), F.lit(True).alias("_there"))
        known, was = F.col("consumed").isNotNull(), F.col("_old").isNotNull()
        verdict = F.when(F.col("_there").isNull(), "recompute").when(~known & ~was, "undetectable").when(known & was & (F.col("consumed") == F.col("_old")), "serve").otherwise("recompute")
        return current.join(old, ENTRY, "left").select(*ENTRY, "consumed", verdict.alias("verdict"))

    def write(self, feature: str, run: str, df: DataFrame, params: dict, upstream: list[str], consumed: DataFrame | None = None) -> DataFrame:
        """Materialises the entries of `df` that have no valid output; only their partitions are written."""
        path = f"{self.root}/data/{feature}/{run}"
        wanted = consumed if consumed is not None else df.select(*ENTRY).distinct().withColumn("consumed", F.lit(None).cast("string"))
        verdicts = self.verdicts(run, wanted).persist()
        todo = verdicts.where("verdict = 'recompute'")
        self.record(feature, run, params, upstream, "started")
        if not todo.isEmpty():
            rows = df.join(todo.select(*ENTRY), ENTRY, "left_semi")
            rows.repartition(*ENTRY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*ENTRY).parquet(path)
            counts = self.read(feature, run).groupBy(*ENTRY).agg(F.count("*").alias("n_rows"))
            new = todo.join(counts, ENTRY, "left").select(F.lit(run).alias("run_id"), *ENTRY, F.lit(path).alias("path"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "consumed", F.lit(time.time()).alias("at"))
            self._append("entries", new)
        verdicts.unpersist()
        missing = wanted.join(self.entries(run), ENTRY, "left_anti")
        self.record(feature, run, params, upstream, "finished" if missing.isEmpty() else "partial")
        return self.read(feature, run)

    def read(self, feature: str, run: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/data/{feature}/{self.resolve(feature, run)}")
        return df.withColumns({c: F.col(c).cast("string") for c in ENTRY})

    def delete(self, feature: str, run: str) -> None:
        """Removes what a run wrote; the catalogue keeps that it was there."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{feature}/{run}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.record(feature, run, {}, [], "deleted")

    def _reach(self, links: DataFrame, start: list[str]) -> dict[str, int]:
        """Distance of every run that `links(source, target)` reach from `start`, however far it is. Links are followed level by
        level; a run is followed once, so many ways to it cost no more than one. Only run ids of a level, of which there
        are as many as a catalogue has runs, pass through the driver."""
        links = links.select("source", "target").distinct().persist()
        found, level, distance = {}, start, 0
        while level:
            distance += 1
            here = self.spark.createDataFrame([(r,) for r in level], "source string")
            level = [r["target"] for r in links.join(here, "source", "left_semi").select("target").distinct().collect() if r["target"] not in found]
            found |= dict.fromkeys(level, distance)
        links.unpersist()
        return found

    def lineage(self, run: str) -> DataFrame:
        """All runs that a run consumes, directly or not, with their least distance."""
        links = self.runs().select(F.col("run_id").alias("source"), F.explode("upstream").alias("target"))
        return self.spark.createDataFrame(list(self._reach(links, [run]).items()), "run_id string, distance int")

    def reached_by(self, run: str) -> DataFrame:
        """All runs that consume a run, directly or not, with their least distance."""
        links = self.runs().select(F.explode("upstream").alias("source"), F.col("run_id").alias("target"))
        found = self.spark.createDataFrame(list(self._reach(links, [run]).items()), "run_id string, distance int")
        return self.runs().join(found, "run_id").select("feature", "run_id", "distance")

    def _folder(self, path: str, entry) -> str:
        """The folder of an entry's rows below its run's path."""
        part = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return "/".join([path, *[part(c, entry[c]) for c in ENTRY]])

    def delete_set(self, run: str, current: DataFrame, apply: bool = False) -> tuple[DataFrame, DataFrame]:
        """What a change of a run's entries makes wrong: (candidates, declined), each an entry of a run that consumes it.

        `current(group, sequence, consumed)` are the changed entries with the digest of what they would consume now. An
        entry is a candidate where its recorded digest differs, and declined where nothing was recorded, as that shows
        no change. With `apply` the candidates' folders go, and they count as not written.
        """
        now = current.select(*ENTRY, F.col("consumed").alias("now"))
        written = self.entries().join(self.reached_by(run).select("feature", "run_id"), "run_id").join(now, ENTRY)
        columns = ["feature", "run_id", *ENTRY, "path"]
        declined = written.where("consumed is null or now is null").select(*columns)
        candidates = written.where("consumed <> now").select(*columns)
        if apply:
            # Written first, as what is to go must not depend on what has gone; it stays as the record of the deletion.
            log = f"{self.root}/deletions/{time.time_ns()}"
            candidates.write.parquet(log)
            candidates = gone = self.spark.read.schema(candidates.schema).parquet(log)
            for r in gone.select("path", *ENTRY).distinct().toLocalIterator():
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(r["path"], r))
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            marks = gone.select("run_id", *ENTRY, F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("consumed"), F.lit(time.time()).alias("at"))
            self._append("entries", marks)
        return candidates, declined
