"""Exact deduplication through an extendible-hash index on shared files.

A text's key is the 64-bit hash of its normalised form; a bucket of the index is a range of keys that share a
prefix. The directory starts with one bucket and splits every bucket that holds more distinct keys than its
capacity, doubling itself when the bucket's own depth has reached its depth. Each bucket has one owner task,
which reads the bucket's entries in key order, chains the different texts of one key by comparing their bytes,
and writes one index entry per text to the shared folder. A task first combines the copies within its own
input, so a text of which there are millions of copies reaches its owner once per input split, and the owner
holds one chain at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, frugal

#: A combiner passes on what it holds when its texts exceed this many bytes.
COMBINE_BYTES = 12 << 20
#: The directory never exceeds 2**MAX_DEPTH slots of 12 bytes; it is gathered and broadcast. Buckets hold more where
#: the corpus needs it: an eighth of the slots would do for all its keys.
MAX_DEPTH = 18
BUCKETS_PER_PARTITION = 8
LARGEST_BUCKET = 50_000


def normalise(text):
    """One space for each run of white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def build_directory(counts: dict[int, int], fine: int, capacity: int) -> tuple[int, list[int], dict[int, tuple[int, int]]]:
    """The directory for keys counted by their first `fine` bits.

    Returns its depth, the bucket of each of its 2**depth slots, and each bucket's (prefix, own depth).
    """
    depth, slots = 0, [0]
    buckets = {0: (0, 0)}
    totals = {0: sum(counts.values())}
    inside = {0: list(counts)}
    full = [0]
    while full:
        b = full.pop()
        prefix, own = buckets[b]
        if totals[b] <= capacity or own == fine:
            continue
        if own == depth:
            slots = [x for x in slots for _ in (0, 1)]
            depth += 1
        low, high = [], []
        for p in inside[b]:
            (high if p >> (fine - own - 1) & 1 else low).append(p)
        new = len(buckets)
        buckets[b], buckets[new] = (prefix << 1, own + 1), (prefix << 1 | 1, own + 1)
        inside[b], inside[new] = low, high
        totals[b], totals[new] = sum(counts[p] for p in low), sum(counts[p] for p in high)
        span = 1 << (depth - own - 1)
        first = (prefix << 1 | 1) * span
        slots[first : first + span] = [new] * span
        full += [b, new]
    return depth, slots, buckets


def _together(a: tuple, b: tuple) -> tuple:
    """Of two parts of a group: the smallest id, null only if there is no other, how many rows have it, all rows."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    first = a if b[0] is None or (a[0] is not None and a[0] < b[0]) else b
    return first[0], first[1], a[2] + b[2]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, str], list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        cols = zip(*((b, k, t, *who) for (k, t), (b, who) in held.items()))
        types = pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["bucket", "key", "text", "keep_id", "keepers", "group_size"])

    for batch in batches:
        for b, k, t, d in zip(*(c.to_pylist() for c in batch.columns)):
            entry = held.get((k, t))
            if entry is None:
                held[k, t] = [b, (d, 1, 1)]
                size += len(t) + 200
                if size > COMBINE_BYTES:
                    yield out()
                    held, size = {}, 0
            else:
                entry[1] = _together(entry[1], (d, 1, 1))
    if held:
        yield out()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and key; one chain of texts is open at a time."""
    key, bucket, chain = None, None, {}
    done: list[tuple] = []

    def close() -> None:
        for i, (t, who) in enumerate(chain.items()):
            done.append((bucket, key, i, len(chain) > 1, *who, hashlib.sha256(t.encode()).hexdigest(), t if len(chain) > 1 else None))

    def out() -> pa.RecordBatch:
        types = pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()
        names = ["bucket", "key", "link", "chained", "keep_id", "keepers", "group_size", "text_sha256", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    for batch in batches:
        for b, k, t, *who in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                close()
                key, bucket, chain = k, b, {}
            if t in chain:  # equal hashes, then equal bytes
                chain[t] = _together(chain[t], who)
            else:
                chain[t] = tuple(who)
        if done:
            yield out()
            done = []
    close()
    if done:
        yield out()


def build_index(docs: DataFrame, scratch: Scratch, key_bits: int = 64, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The written key of each row (doc_id, key), and the index of distinct texts."""
    spark = docs.sparkSession
    hashed = F.xxhash64(normalise(F.col("text")))
    if key_bits < 64:
        hashed = F.shiftleft(F.shiftrightunsigned(hashed, 64 - key_bits), 64 - key_bits)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed.alias("key"), normalise(F.col("text")).alias("text"))
    keys = scratch.write(keyed.select("doc_id", "key"), "keys")

    distinct = keys.select("key").distinct()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = keys.count()
    capacity = capacity or max(16, min(LARGEST_BUCKET, count // (BUCKETS_PER_PARTITION * partitions)), 8 * count >> MAX_DEPTH)
    fine = min(MAX_DEPTH, max(1, (count // capacity).bit_length() + 3))
    counts = distinct.groupBy(F.shiftrightunsigned("key", 64 - fine).alias("p")).count().toArrow()
    depth, slots, _ = build_directory(dict(zip(*(c.to_pylist() for c in counts.columns))), fine, capacity)
    directory = spark.createDataFrame(pa.table({"slot": pa.array(range(len(slots)), pa.int64()), "bucket": pa.array(slots, pa.int32())}))

    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    entries = keyed.withColumn("slot", slot).join(F.broadcast(directory), "slot").select("bucket", "key", "text", "doc_id")
    entries = entries.mapInArrow(frugal(_combine), "bucket int, key long, text string, keep_id long, keepers long, group_size long")
    owned = entries.repartition("bucket").sortWithinPartitions("bucket", "key")
    index = owned.mapInArrow(frugal(_own), "bucket int, key long, link int, chained boolean, keep_id long, keepers long, group_size long, text_sha256 string, text string")
    return keys, scratch.write(index, "index")


def exact_duplicates(docs: DataFrame, key_bits: int = 64, capacity: int | None = None) -> DataFrame:
    """Groups of equal texts in `docs(doc_id, text, ...)`.

    Returns doc_id, keep_id (smallest doc_id with the same text), group_size, kept, text_sha256 of the
    normalised text. Texts are equal when they are after each run of white space becomes one space; null counts
    as empty, and empty texts are equal to one another. Just one row of a group is kept: where several have the smallest
    doc_id and the same text, one of them. A null doc_id gives way to any other; among rows with null doc_ids only,
    keep_id is null and one is kept. Other columns are not read, whatever their names. An empty table gives an empty
    result. Texts of any length are compared whole. `key_bits` is for tests of colliding keys.
    """
    return _groups(docs, key_bits, capacity).drop("keepers")


def _groups(docs: DataFrame, key_bits: int = 64, capacity: int | None = None) -> DataFrame:
    """What `exact_duplicates` returns, and keepers, how many rows have keep_id and the text."""
    keys, index = build_index(docs, Scratch(docs.sparkSession), key_bits, capacity)
    wanted = ["doc_id", "keep_id", "keepers", "group_size", "text_sha256"]
    found = keys.join(index.where("not chained").drop("text"), "key").select(wanted)
    chained = index.where("chained")
    if not chained.isEmpty():
        hard = keys.join(chained.select("key").distinct(), "key", "left_semi").select("doc_id", "key").distinct()
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalise(F.col("text")).alias("text"))
        texts = texts.join(hard.select("doc_id").distinct().withColumnRenamed("doc_id", "hard_id"), F.col("doc_id").eqNullSafe(F.col("hard_id")), "left_semi")
        found = found.union(texts.join(chained.drop("doc_id"), "text").select(wanted))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Only rows that repeat the kept one are numbered.
    repeated = kept & (F.col("keepers") > 1)
    number = F.row_number().over(Window.partitionBy("keep_id", "text_sha256").orderBy("doc_id"))
    once = found.where(~repeated).withColumn("kept", kept).union(found.where(repeated).withColumn("kept", number == 1))
    return once.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "keepers")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """`docs`, all columns as they are, without its exact duplicates: of equal texts one row with the smallest doc_id
    stays. Nulls, empty and very long texts, repeated rows and empty tables are as in `exact_duplicates`."""
    kept = _groups(docs).where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha"), "keepers")
    kept = Scratch(docs.sparkSession).write(kept, "stay")
    # All columns travel as one struct, so that none of them meets a name of this plan.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("stay_id"), F.sha2(normalise(F.col("text")), 256).alias("stay_sha"))
    of = lambda who: rows.join(who, rows["stay_id"].eqNullSafe(who["stay_id"]) & (rows["stay_sha"] == who["stay_sha"]), "left_semi")
    often = kept.where("keepers > 1")
    stay = of(kept.where("keepers = 1"))
    if not often.isEmpty():
        stay = stay.union(of(often).dropDuplicates(["stay_id", "stay_sha"]))
    return stay.select("row.*")
