"""Runs of periodic words: stretches that repeat with one period, found by comparing a text's words with every shift.

A document is an array of word ids. For every lag up to a LEAST_EXPONENT-th of the words the array is compared with itself
shifted by the lag; a stretch of equal words, run-length coded, is a run of that period if it is long enough and has no
shorter period. A stretch that is long enough can't miss every step-th position when the step is no longer than itself,
so the lags of a doubling range are compared at those positions first, all at once, and in full where a position agrees.

Spark deals documents to tasks, and long documents by ranges of lags, so that no task compares more than about one range.
Words are told apart exactly, by a dictionary of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, frugal
from .tokens import text_bytes, word_spans

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Texts of more characters are dealt by ranges of lags: at least LAGS of them, or as many as make up WORK comparisons.
LONG = 1 << 16
LAGS, WORK = 1_024, 1 << 26
#: Elements of one comparison of several lags.
TOGETHER = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"
NO_RUNS = np.zeros((0, 3), np.int64)


def least(q: np.ndarray | int, words: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT):
    """Equal words in a row that make a run of period q."""
    return np.maximum(words, exponent * q) - q


def likely_lags(ids: np.ndarray, low: int, high: int) -> np.ndarray:
    """The lags from low to high (exclusive) that agree at one of the positions that no run of theirs can miss."""
    n, out = len(ids), []
    while low < high:
        step = int(least(low))
        at = np.arange(step - 1, n, step)
        top = min(high, 2 * low, low + max(1, TOGETHER // max(1, len(at))))
        lags = np.arange(low, top)
        to = at[None, :] + lags[:, None]
        agree = (ids[np.minimum(to, n - 1)] == ids[at][None, :]) & (to < n)
        out.append(lags[agree.any(1)])
        low = top
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _shorter(ids: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether the words from start to end have a shorter period than q. One divides q, as they are 2q or more."""
    own, rest, r = ids[start:end], q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r:
            r += 1
            continue
        if (own[: -(q // r)] == own[q // r :]).all():
            return True
        while rest % r == 0:
            rest //= r
    return False


def runs(ids: np.ndarray, low: int = 1, high: int | None = None) -> np.ndarray:
    """(start, length, period) of the runs whose period is at least low and below high, by start and period."""
    n = len(ids)
    high = n // LEAST_EXPONENT + 1 if high is None else min(high, n // LEAST_EXPONENT + 1)
    if n < LEAST_WORDS or low >= high:
        return NO_RUNS
    out = []
    for q in likely_lags(ids, low, high).tolist():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-q] == ids[q:], [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least(q)
        out += [(a, b + q - a, q) for a, b in zip(starts[long].tolist(), ends[long].tolist()) if not _shorter(ids, a, b + q, q)]
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64) if out else NO_RUNS


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, an id for each that equal words share, and the n + 1 offsets of the texts."""
    data, offsets = text_bytes(texts)
    starts, ends, row = word_spans(data, offsets)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    solid = data[np.cumsum(inside[:-1]).astype(bool)]
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(solid.tobytes()))
    return words, words.dictionary_encode().indices.to_numpy(), np.searchsorted(row, np.arange(len(texts) + 1))


def _collapsed(words: pa.Array, offsets: np.ndarray, found: list[np.ndarray]) -> pa.Array:
    """Each text's words, joined by one space, without what runs repeat after their first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for at, r in zip(offsets[:-1], found):
        if len(r):
            np.add.at(drop, at + r[:, 0] + r[:, 2], 1)
            np.add.at(drop, at + r[:, 0] + r[:, 1], -1)
    keep = np.cumsum(drop[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_string())


def _result(batch: pa.RecordBatch, words: pa.Array, offsets: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate([NO_RUNS, *found])
    struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32()), struct)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), lists, _collapsed(words, offsets, found)], ["doc_id", "n_words", "runs", "collapsed"])


OUT = f"doc_id long, n_words long, runs {RUNS}, collapsed string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of which one task sees all lags."""
    for batch in batches:
        words, ids, offsets = _words(batch.column("text"))
        yield _result(batch, words, offsets, [runs(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ids of each document once for every range of lags."""
    for batch in batches:
        _, ids, offsets = _words(batch.column("text"))
        for row, a, b in zip(batch.column("row").to_pylist(), offsets[:-1], offsets[1:]):
            n, each = int(b - a), max(LAGS, WORK // max(1, int(b - a)))
            for low in range(1, n // LEAST_EXPONENT + 1, each):
                own = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(ids[a:b], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([low]), pa.array([low + each]), own], ["row", "low", "high", "ids"])


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("row").to_pylist()
        for i, (low, high) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())):
            found = runs(batch.column("ids")[i].values.to_numpy(), low, high)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rows[i])), *[pa.array(found[:, c]) for c in range(3)]], ["row", "start", "length", "period"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long documents with the runs that all their ranges found."""
    for batch in batches:
        words, _, offsets = _words(batch.column("text"))
        found = [np.array([(r["start"], r["length"], r["period"]) for r in own or []], np.int64).reshape(-1, 3) for own in batch.column("runs").to_pylist()]
        yield _result(batch, words, offsets, found)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of `docs(doc_id, text, ...)`.

    runs: (start, length, period) of each maximal stretch of words with smallest period q and of max(6, 4q) words or
    more, by start, then period; words count from 0. collapsed: the words, joined by one space, without those that some run holds after
    its first q words. A null or empty text has no words, no runs and an empty text; rows that repeat return one row
    each; a null doc_id goes through. Other columns are not read. An empty table gives an empty result.

    A document's comparisons grow with its words times the logarithm of their number, and with each lag that agrees
    somewhere, up to the square for one word repeated; ranges of lags bound what one task has of it.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > LONG, F.lit(False))
    short = texts.where(~is_long).mapInArrow(frugal(_whole), OUT)
    long = scratch.write(texts.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long")
    ranges = long.select("row", "text").mapInArrow(frugal(_ranges), "row long, low long, high long, ids array<int>")
    dealt = ranges.repartition(F.col("row"), F.col("low")).mapInArrow(frugal(_in_range), "row long, start long, length long, period long")
    found = dealt.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    by_start = F.array_sort("runs", lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])), -1).otherwise(1))
    whole = long.join(found.withColumn("runs", by_start), "row", "left").select("doc_id", "text", "runs")
    return short.union(whole.mapInArrow(frugal(_joined), OUT))


def with_repeats(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` with the tail of every tenth document, by the checksum h of its doc_id, made periodic: with
    g = floor(h / 10), words from a = g % n on become the p = 1 + floor((n - a) / (3 + g % 8)) words from a on, repeated. A
    null doc_id has the checksum of an empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        g, n = F.floor(h / 10).cast("long"), F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        head, tail = F.slice(w, F.lit(1), a.cast("int")), F.slice(w, (a + 1).cast("int"), p.cast("int"))
        often = F.flatten(F.array_repeat(tail, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(head, often), F.lit(1), n.cast("int")), " ")

    return docs.select("doc_id", F.when((h % 10 == 0) & (F.size(words) > 0), repeated(words)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest run (ties: smallest start, then period), digests of runs and text."""
    first = F.element_at(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int")), 1)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = found.withColumn("top", F.when(F.size("runs") > 0, first))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: The same rows by joining equal words of a document. The first part is the checksum crc32 of a number's digits.
ORACLE_SQL = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS digits FROM documents),
h AS MATERIALIZED (
  SELECT k, doc_id, w, len(w) AS n,
         xor(4294967295, list_reduce(digits, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)) AS h FROM d),
g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h),
t AS MATERIALIZED (
  SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(generate_series(0, n - 1), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
u AS MATERIALIZED (SELECT k, n, unnest(w) AS word, unnest(generate_series(0, n - 1)) AS i FROM t WHERE n > 0),
e AS (SELECT a.k, b.i - a.i AS q, a.i FROM u AS a JOIN u AS b ON a.k = b.k AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS MATERIALIZED (
  SELECT k, q, min(i) AS start, count(*) + q AS length FROM (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e)
  GROUP BY k, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.k = s.k AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
f AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
        arg_min({'start': start, 'length': length, 'period': q}, [-length, start, q]) AS top FROM r GROUP BY k),
x AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = u.k AND u.i >= r.start + r.q AND u.i < r.start + r.length) GROUP BY k)
SELECT t.doc_id, coalesce(f.n_runs, 0) AS n_runs, f.top.start AS start, f.top.length AS length, f.top.period AS period,
       1000 * f.top.length // f.top.period AS exponent_milli, sha256(coalesce(f.lines, '')) AS runs_sha256, sha256(coalesce(x.kept, '')) AS collapsed_sha256
FROM t LEFT JOIN f ON t.k = f.k LEFT JOIN x ON t.k = x.k
"""
