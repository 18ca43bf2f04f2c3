"""Language-model scores from a probabilistic suffix tree over the bytes of words.

A text is its lower-cased words, a space after each, then an end symbol. A context of up to DEPTH symbols is a state
of the tree when it occurs LEAST times or more in training, whatever the size of the corpus, and its next-symbol
distribution diverges from its longest proper suffix's by at least DIVERGENCE nats (or a longer state needs it as a
suffix). Every state's distribution is smoothed by its suffix's, the root's by a uniform one. Each symbol is scored by
the state of its longest suffix.

Counts come from all training texts: tasks count the longest contexts with their next symbol, and words, combine
them, and Spark sums them; shorter contexts are sums of longer ones. The states stay in Spark's tables, which grow
with the corpus: each level meets its suffix level in a join, once for the divergences and once for the probabilities.
The outcome is a value for each distinct gram (a context of DEPTH symbols and the next one) of any text; texts that
are only scored add grams without a count. The unigram baseline needs the count of every word of every text. Words
that make up 2**-22 of the training tokens or more (4 million at most) and the GRAMS most frequent grams are broadcast;
all others meet their values in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch, frugal, settle

DEPTH = 6
LEAST = 2
DIVERGENCE = 0.01
STRENGTH = 4.0
FREQUENT = 2.0**-22
GRAMS = 2_000_000
SEPARATOR, END = 32, 10
WORD, GRAM = 0, 1
#: Counts that a task holds before it combines them, and after combining before it passes them on.
HELD = 2_500_000


def _stream(part: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all documents, each after DEPTH end symbols, and where each one's own symbols begin."""
    docs, lens = len(bounds) - 1, ends - starts
    size = np.bincount(rows, lens + 1, minlength=docs).astype(np.int64) + 1
    first = np.cumsum(size + DEPTH) - size
    out = np.full(int((size + DEPTH).sum()), END, np.uint8)
    if len(starts):
        before = np.cumsum(lens + 1) - (lens + 1)
        own = np.cumsum(np.bincount(rows, lens + 1, minlength=docs).astype(np.int64)) - (size - 1)
        to = before - own[rows] + first[rows]
        at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(to, lens) + at] = tokens.LOWER[part[np.repeat(starts, lens) + at]]
        out[to + lens] = SEPARATOR
    return out, first


def _own(first: np.ndarray, total: int) -> np.ndarray:
    """Positions that are predicted: all but the padding."""
    mask = np.zeros(total + 1, np.int8)
    np.add.at(mask, first - DEPTH, 1)
    np.add.at(mask, first, -1)
    return np.flatnonzero(np.cumsum(mask[:-1]) == 0)


def _combined(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _codes(symbols: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The grams at these positions: a symbol in the lowest byte, those before it in the next ones."""
    code = symbols.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        code[k:] |= symbols[:-k].astype(np.uint64) << np.uint64(8 * k)
    return code[own]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the training texts and grams of all; a gram's lowest bit says that it is of a text that is only scored."""
    held: dict[int, tuple[list, list]] = {WORD: ([], []), GRAM: ([], [])}
    sizes = {WORD: 0, GRAM: 0}

    def out(kind: int) -> Iterator[pa.RecordBatch]:
        k, c = _combined(*held[kind])
        held[kind], sizes[kind] = ([], []), 0
        for i in range(0, len(k), 1 << 20):
            part = k[i : i + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(c[i : i + (1 << 20)])], ["kind", "code", "n"])

    for batch in batches:
        for scored in (False, True):
            data, offsets = tokens.text_bytes(batch.column(0).filter(pc.equal(batch.column(1), scored)))
            for _, _, part, bounds in tokens.pieces(data, offsets):
                starts, ends, rows = tokens.word_spans(part, bounds)
                symbols, first = _stream(part, bounds, starts, ends, rows)
                grams = _codes(symbols, _own(first, len(symbols))) << np.uint64(1) | np.uint64(scored)
                words = [] if scored else [(WORD, tokens.word_hashes(part, starts, ends))]
                for kind, values in (*words, (GRAM, grams)):
                    u, n = np.unique(values, return_counts=True)
                    held[kind][0].append(u)
                    held[kind][1].append(n.astype(np.int64))
                    sizes[kind] += len(u)
                    if sizes[kind] > HELD:
                        u, n = _combined(*held[kind])
                        held[kind], sizes[kind] = ([u], [n]), len(u)
                        if len(u) > 0.8 * HELD:
                            yield from out(kind)
    for kind in held:
        if sizes[kind]:
            yield from out(kind)


def _values(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(code, value) of all `grams(code, n)`: log10 of the probability of a gram's last symbol in the state of the
    longest suffix of those before it. n counts training texts only and can be 0.

    A code of level k is a context of k symbols and the next one, its lower bytes are its code of level k - 1.
    """

    def up(k: int):
        return F.col("code").bitwiseAND((1 << 8 * k) - 1)

    context = F.shiftright("code", 8)
    levels: list[DataFrame] = [grams] * (DEPTH + 1)
    for k in range(DEPTH, -1, -1):
        if k < DEPTH:
            levels[k] = levels[k + 1].groupBy(up(k + 1).alias("code")).agg(F.sum("n").alias("n"))
        levels[k] = levels[k].select("code", "n", F.sum("n").over(Window.partitionBy(context)).alias("all"))
        levels[k] = scratch.write(levels[k], f"level{k}")
    # A context is a state if it is seen often enough and diverges from its suffix, or is the suffix of a state.
    states: dict[int, DataFrame] = {}
    for k in range(DEPTH, 0, -1):
        above = levels[k - 1].where("n > 0").select(F.col("code").alias("up"), (F.col("n") / F.col("all")).alias("q"))
        cells = levels[k].where((F.col("n") > 0) & (F.col("all") >= LEAST)).withColumn("up", up(k)).join(above, "up")
        apart = cells.groupBy(context.alias("context")).agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") / F.col("all") / F.col("q"))).alias("apart"))
        apart = apart.where(F.col("apart") >= DIVERGENCE).select("context")
        if k < DEPTH:
            apart = apart.union(states[k + 1].select(F.col("context").bitwiseAND((1 << 8 * k) - 1))).distinct()
        states[k] = scratch.write(apart, f"states{k}")

    def smoothed(above):
        return (F.col("n") + STRENGTH * above) / (F.col("all") + STRENGTH)

    found = levels[0].select("code", smoothed(F.lit(1 / 256)).alias("p"))
    for k in range(1, DEPTH + 1):
        cells = levels[k].withColumns({"up": up(k), "context": context}).join(states[k].withColumn("state", F.lit(True)), "context", "left")
        cells = cells.join(found.select(F.col("code").alias("up"), F.col("p").alias("above")), "up")
        found = cells.select("code", F.when(F.col("state"), smoothed(F.col("above"))).otherwise(F.col("above")).alias("p"))
        found = scratch.write(found, f"values{k}")
    scratch.drop(*levels, *states.values())
    return found.select("code", F.log10("p").alias("value"))


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, values = (c.to_numpy() for c in table.columns)
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], values[order]


class Lookup:
    """Values by gram: a slot for each hash, which the most frequent gram gets; the others are in sorted arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(counts, kind="stable")
        keys, values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(2 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), np.uint64(2**64 - 1))
        self.values = np.zeros(len(self.slots), np.float32)
        at = self.hashed(keys)
        self.slots[at] = keys
        own = self.slots[at] == keys
        self.values[at[own]] = values[own]
        order = np.argsort(keys[~own])
        self.more, self.more_values = keys[~own][order], values[~own][order]

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these keys, 0 where there is none, and the places of those without."""
        at = self.hashed(keys)
        missing = np.flatnonzero(self.slots[at] != keys)
        values = self.values[at]
        to, met = _found(self.more, keys[missing])
        values[missing] = 0
        values[missing[met]] = self.more_values[to[met]]
        return values, missing[~met]


def _found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys hold these values, and whether they do."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n rows; `rows` is sorted."""
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.array(values.view(np.int64)))


def held_out(n: int, remainder: int):
    """Whether crc32 of the doc_id as text leaves this remainder; a null doc_id counts as empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n) == remainder


def score_texts(docs: DataFrame, train, least_share: float = FREQUENT, most_grams: int = GRAMS) -> DataFrame:
    """Scores of the whole texts of `docs(doc_id, text, ...)` by a tree learned from the rows where `train` holds.

    Returns doc_id, held_out (not `train`), n_tokens (words and one end), n_known (tokens with a training count),
    train_tokens, base_score (add-0.1 unigram log10 probability) and score (the tree's log10 probability).

    Null texts count as empty and are scored as just an end. Rows come back as often as they come, and count as
    often in training. Other columns are not read. An empty table gives an empty result; without training rows all
    symbols are equally likely. A text is scored whole, whatever its length. Words are told apart by a 64-bit hash of their
    bytes, so n_known, base_score and the counts behind them are exact unless two words of the corpus share one: with
    10 million distinct words that has probability 3e-6.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~train).alias("held_out"))
    counted = texts.select("text", "held_out").mapInArrow(frugal(_count), "kind int, code long, n long")
    is_gram = F.col("kind") == GRAM
    counted = counted.select("kind", F.when(is_gram, F.shiftright("code", 1)).otherwise(F.col("code")).alias("code"), F.when(is_gram & (F.col("code").bitwiseAND(1) == 1), 0).otherwise(F.col("n")).alias("n"), F.col("n").alias("any"))
    counted = scratch.write(counted.groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("any").alias("any")), "counts")
    words, grams = (counted.where(F.col("kind") == k).select("code", "n", "any") for k in (WORD, GRAM))
    settle(spark)
    ends = grams.where(F.col("code").bitwiseAND(255) == END).agg(F.sum("n")).first()[0] or 0
    in_words, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (in_words or 0) + ends, distinct + (ends > 0)
    values = scratch.write(grams.select("code", "any").join(_values(grams.select("code", "n"), scratch), "code"), "values")
    settle(spark)
    least = max(1, int(total * least_share))
    # Grams are frequent from the least binned count on that no more than `most_grams` reach.
    size = F.floor(F.log2("any") * 8)
    enough, sofar = 1 << 20, 0
    for b, n in sorted(values.groupBy(size).count().collect(), reverse=True):
        sofar += n
        if sofar > most_grams:
            break
        enough = b
    frequent = _sorted(words.where(F.col("n") >= least).select("code", "n").toArrow())
    top = values.where(size >= enough).select("code", F.col("value").cast("float"), "any").toArrow()
    code, value, n = (c.to_numpy() for c in top.columns)
    model = spark.sparkContext.broadcast((*frequent, code.view(np.uint64), value, n))
    below = total + 0.1 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, *grams = model.value
        grams = Lookup(*grams)
        log10 = np.log10((n + 0.1) / below)
        for batch in batches:
            data, offsets = tokens.text_bytes(batch.column(1))
            for a, b, part, bounds in tokens.pieces(data, offsets):
                starts, ends_, rows = tokens.word_spans(part, bounds)
                hashes = tokens.word_hashes(part, starts, ends_)
                at, known = _found(keys, hashes)
                base = np.bincount(rows[known], log10[at[known]], minlength=b - a) + np.log10((ends + 0.1) / below)
                symbols, first = _stream(part, bounds, starts, ends_, rows)
                own = _own(first, len(symbols))
                codes, begins = _codes(symbols, own), np.searchsorted(own, first)
                score, missing = grams.find(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(np.bincount(rows, minlength=b - a) + 1),
                        pa.array(np.bincount(rows[known], minlength=b - a) + int(ends > 0)),
                        pa.array(base),
                        pa.array(np.add.reduceat(score, begins, dtype=np.float64)),
                        _lists(hashes[~known], rows[~known], b - a),
                        _lists(codes[missing], np.searchsorted(begins, missing, side="right") - 1, b - a),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "rare_grams"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, rare_grams array<long>"
    scored = texts.select("doc_id", "text", "held_out").mapInArrow(frugal(run), schema)
    scored = scratch.write(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    value = F.log10((F.col("n") + 0.1) / below)
    known = words.where(F.col("n") < least).select(F.lit(WORD).alias("kind"), "code", value.alias("value"))
    known = known.union(values.where(size < enough).select(F.lit(GRAM), "code", "value"))
    rare = scored.select("row", F.lit(WORD).alias("kind"), F.explode("rare").alias("code"))
    rare = rare.union(scored.select("row", F.lit(GRAM), F.explode("rare_grams"))).join(known, ["kind", "code"], "left")
    is_word, unknown = F.col("kind") == WORD, math.log10(0.1 / below)
    rare = rare.groupBy("row").agg(F.sum(F.when(is_word, F.coalesce("value", F.lit(unknown)))).alias("more"), F.count(F.when(is_word, F.col("value"))).alias("more_known"), F.sum(F.when(~is_word, F.col("value"))).alias("more_score"))
    zero = F.lit(0)
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
