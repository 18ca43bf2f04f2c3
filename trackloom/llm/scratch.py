"""Written tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is configured and Spark runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    own = tempfile.mkdtemp(prefix="trackloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Rows of an Arrow batch: a few MB of ordinary documents on either side of the Python boundary.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, as rows that hold whole documents are large. Operators that
    send texts to Python call it; a session with smaller batches keeps them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def settle(spark: SparkSession) -> None:
    """Has the driver collect its garbage. Iterative operators call it between rounds: Spark removes the shuffle files
    and broadcasts of a finished round only when the driver's objects for them are gone."""
    spark.sparkContext._jvm.System.gc()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A batch function that gives freed memory back to the system when its task ends: Python workers stay alive and
    idle between tasks, beside executors that need the memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    """Gives freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    found = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if found:
        found(0)


def running_totals(df: DataFrame, order: list[Column], values: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """`df`, sorted over all its rows, written, with running sums: `values` maps output columns to whole-number columns.

    Spark sorts by ranges; a task adds up its own range, and what the ranges before it hold, one row a range, is
    gathered and broadcast, so no task sees more than its range.
    """
    outputs, inputs = list(values), list(values.values())
    sorted_ = df.orderBy(*order)
    schema = T.StructType([*sorted_.schema, *[T.StructField(c, T.LongType()) for c in outputs], T.StructField("range_no", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sofar, no = [0] * len(inputs), TaskContext.get().partitionId()
        for batch in batches:
            sums = []
            for i, c in enumerate(inputs):
                sums.append(np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)) + sofar[i])
                sofar[i] = int(sums[i][-1]) if len(sums[i]) else sofar[i]
            columns = [*batch.columns, *map(pa.array, sums), pa.array(np.full(batch.num_rows, no, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *outputs, "range_no"])

    summed = scratch.write(sorted_.mapInArrow(frugal(run), schema), name)
    totals = sorted(map(tuple, summed.groupBy("range_no").agg(*[F.max(c) for c in outputs]).collect()))
    before, rows = [0] * len(outputs), []
    for no, *sums in totals:
        rows.append((no, *before))
        before = [b + s for b, s in zip(before, sums)]
    ahead = df.sparkSession.createDataFrame(rows, ", ".join(["range_no int", *[f"before_{c} long" for c in outputs]]))
    out = summed.join(F.broadcast(ahead), "range_no").withColumns({c: F.col(c) + F.col(f"before_{c}") for c in outputs})
    return out.select(*df.columns, *outputs)


class Scratch:
    """Names Parquet tables below the shared folder and drops those that are no longer needed.

    A table is written by Spark's commit protocol and read back with its schema given, so a lost executor
    costs nothing that was already written, and reading starts no job to infer a schema.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/trackloom-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        schema = df.schema
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        settle(self.spark)
