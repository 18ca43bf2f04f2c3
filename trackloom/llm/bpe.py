"""Byte-level byte-pair encoding and decoding.

The merges of a word are a fold of Spark's `aggregate` over its byte pieces that looks ranks up in a literal map.
A fold costs some 0.1 ms, so it is done once for each frequent distinct word: there are at most 1 / FREQUENT of
them, whatever the size of the corpus, and their ids are broadcast. Tasks that encode texts merge rare words
themselves, by the same rule, and remember them; sending every occurrence of a word through a join with all
distinct words would move several times the input. Decoding is a Spark expression: the pieces of the ids, from a literal
array, joined.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, frugal, settle

SLOTS = 1 << 14
FREQUENT = 2.0**-20
#: Longest word, in bytes, that is broadcast or remembered; number of rare words that a task remembers.
LONGEST = 48
CACHED = 100_000
#: Pieces from which a heap finds the next merge; ids after which a batch is passed on.
HEAP_FROM = 64
BATCH_IDS = 1 << 19
NO_RANK = 1 << 60


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def slotted(entries: dict[str, object], kind: str) -> Column:
    """A literal map of strings to `kind`, dealt into an array of small maps by checksum, as a lookup in one of
    Spark's maps looks through all of its keys."""
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for k, v in entries.items():
        slots[zlib.crc32(k.encode()) % SLOTS][k] = v
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), f"array<map<string,{kind}>>")


def look_up(table: Column, key: Column) -> Column:
    return F.try_element_at(F.element_at(table, (F.crc32(key) % SLOTS + 1).cast("int")), key)


def encode_word(word: Column, ranks: Column) -> Column:
    """The ids of one word, given as upper-case hex: the whole word if it has a rank, else a fold that merges the
    leftmost of the adjacent pairs of least rank until none has one. The ranks of pairs travel with the pieces, so
    a merge looks up only its two new neighbours. The map is bound once, so a plan holds it once."""
    return let(ranks, lambda table: _encode_word(word, table))


def _encode_word(word: Column, ranks: Column) -> Column:
    none = F.array().cast("array<int>")
    pieces = F.regexp_extract_all(word, F.lit("(..)"), F.lit(1))
    n = F.length(word) / 2

    def merge(s: Column) -> Column:
        def at(i: Column) -> Column:
            def joined(m: Column) -> Column:
                p, r = s["p"], s["r"]
                before = F.when(i > 1, F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), F.array(look_up(ranks, F.concat(F.get(p, i - 2), m))))).otherwise(none)
                after = F.when(i + 1 < F.size(p), F.concat(F.array(look_up(ranks, F.concat(m, F.get(p, i + 1)))), F.slice(r, i + 2, F.size(r)))).otherwise(none)
                return F.struct(F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, F.size(p))).alias("p"), F.concat(before, after).alias("r"))

            return let(F.concat(F.get(s["p"], i - 1), F.get(s["p"], i)), joined)

        return let(F.array_position(s["r"], F.array_min(s["r"])).cast("int"), at)

    start = let(pieces, lambda p: F.struct(p.alias("p"), F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: look_up(ranks, F.concat(F.get(p, i), F.get(p, i + 1)))).alias("r")))
    steps = F.sequence(F.lit(2), n.cast("int"))
    folded = F.aggregate(steps, start, lambda s, _: F.when(F.array_min(s["r"]).isNull(), s).otherwise(merge(s)))
    ids = F.transform(folded["p"], lambda x: look_up(ranks, x))
    return let(look_up(ranks, word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(ids))


def frequent_words(docs: DataFrame, pattern: str, share: float = FREQUENT) -> DataFrame:
    """Distinct words that make up at least `share` of all word occurrences, so 1 / share of them at most."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(_for_java(pattern)), F.lit(0))).alias("word"))
    counts = words.groupBy("word").count()
    scratch = Scratch(docs.sparkSession)
    counts = scratch.write(counts.where("count > 1"), "words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.where((F.col("count") >= total * share) & (F.length(F.col("word").cast("binary")) <= LONGEST)).select("word")


def _for_java(pattern: str) -> str:
    """Java's white space class is ASCII only; this spells out Unicode's."""
    space = "\\t-\\r \\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return pattern.replace("[^\\s", f"[^{space}").replace("\\S", f"[^{space}]").replace("\\s", f"[{space}]")


def merge_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The fold of `encode_word` for one rare word."""
    if word in ranks:
        return (ranks[word],)
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > HEAP_FROM:
        return _merge_long(parts, ranks)
    pairs = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < NO_RANK:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
    return tuple(ranks[p] for p in parts)


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same merges by a heap, for words of very many bytes."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
        if before[i] >= 0 and (r := ranks.get(parts[before[i]] + parts[i])) is not None:
            heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
    return tuple(ranks[parts[i]] for i in range(n) if alive[i])


class _Words(dict):
    """Ids of words; those that are missing are merged when first seen and forgotten when too many are held."""

    def __init__(self, known: dict[str, tuple[int, ...]], ranks: dict[bytes, int]):
        super().__init__(known)
        self.known, self.ranks = known, ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > len(self.known) + CACHED:
            self.clear()
            self.update(self.known)
        ids = merge_word(word.encode(), self.ranks)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of `docs(doc_id, text, ...)`, without special tokens.

    `vocabulary` is a file of base64 pieces and ranks, read by the driver; `pattern` splits text into words. Spark's
    higher-order functions fold the merges of the frequent distinct words, using a literal rank map; tasks take
    their ids from there and merge rare words themselves.

    Null and empty texts have no ids. Rows come back as often as they come; null doc_ids stay null. Other columns
    are not read. An empty table gives an empty result. A text goes through whole, and a word of any length is
    merged in n * log(n) steps.
    """
    spark = docs.sparkSession
    ranks = load_ranks(vocabulary)
    table = slotted({k.hex().upper(): v for k, v in ranks.items()}, "int")
    frequent = frequent_words(docs, pattern)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = frequent.repartition(slices, "word").select("word", encode_word(F.hex(F.col("word").cast("binary")), table).alias("ids"))
    found = folded.toArrow()
    settle(spark)
    known = spark.sparkContext.broadcast((dict(zip(found.column(0).to_pylist(), map(tuple, found.column(1).to_pylist()))), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = _Words(*known.value), regex.compile(pattern).findall
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, size, held, lens = 0, 0, [], []
            for i, text in enumerate(texts):
                found = np.fromiter(chain.from_iterable(map(words.__getitem__, split(text.as_py() or ""))), np.int32)
                held.append(found)
                lens.append(len(found))
                size += len(found)
                if size > BATCH_IDS or i + 1 == len(texts):
                    ends = np.cumsum([0, *lens]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), pa.ListArray.from_arrays(ends, np.concatenate(held))], ["doc_id", "ids"])
                    at, size, held, lens = i + 1, 0, [], []

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, ids array<int>")


def pieces(vocabulary: str) -> Column:
    """A literal array of the pieces of all ids, as hex; an id without a piece is empty."""
    by_id = {v: k.hex() for k, v in load_ranks(vocabulary).items()}
    return F.from_json(F.lit(json.dumps([by_id.get(i, "") for i in range(max(by_id) + 1)], separators=(",", ":"))), "array<string>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """`encoded(ids, ...)` with data, the bytes of the ids' pieces one after another; null ids are empty."""
    table = pieces(vocabulary)
    return encoded.withColumn("data", F.coalesce(F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at(table, i + 1)), "")), F.lit(b"")))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Digests of the ids and of what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, vocabulary, pattern), vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
