"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, drops invisible characters, maps look-alike letters of other scripts and full-width forms to
ASCII, reads digits and signs as the letters they stand for (l and 1 become i, so either spelling meets), and
turns all else into spaces. Lexicon entries are word beginnings, weighted by the log odds of toxic against clean
documents among labelled ones; a few plain insults are in it from the start. Phrases around an entry that occur in
clean documents only are exceptions: matches inside them don't count. The sum of weights is divided by the
logarithm of the text's length and calibrated by logistic regression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .scratch import frugal, small_batches

#: Labelled documents that the lexicon is fitted on, at most about this many.
FITTED = 20_000
SHORTEST, LONGEST = 4, 8
LEAST_TOXIC, LEAST_WEIGHT = 10, 2.5
LEAST_CLEAN = 3

# Plain insults, and phrases in which such words are harmless.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown", "imbecile", "bastard")
SEED_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown")

# Letters of other scripts that look like Latin ones, and substitutes.
LOOKALIKES = {
    "a": "аαɑ@4", "b": "ЬВβ8", "c": "сϲ", "d": "ԁ", "e": "еεєҽ3", "g": "ɡ9", "h": "һհ", "i": "іιıl1ӏ", "j": "јϳ", "k": "кκ", "m": "м", "n": "ո",
    "o": "оοօ0", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ѡԝ", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
INVISIBLE = "­​‌‍⁠﻿"


def _folding() -> dict[int, int | None]:
    table: dict[int, int | None] = {c: 32 for c in range(128) if not chr(c).isalnum()}
    table |= {0xFF21 + i: 97 + i for i in range(26)} | {0xFF41 + i: 97 + i for i in range(26)} | {0xFF10 + i: 48 + i for i in range(10)}
    for letter, same in LOOKALIKES.items():
        table |= {ord(x): ord(letter) for c in same for x in (c, c.lower())}
    table |= {0xFF10: ord("o"), 0xFF11: ord("i"), 0xFF4C: ord("i"), 0xFF2C: ord("i")}
    table |= {ord(c): None for c in INVISIBLE} | {c: 32 for c in (*range(0x80, 0xA2), 0xA0, 0xA7, 0xAB, 0xBB, 0xBF, 0xA1, *range(0x2010, 0x2030))}
    return table


FOLDING = _folding()


def fold(text: str | None) -> str:
    """Folded words with one space before, between and after."""
    return " " + " ".join((text or "").lower().translate(FOLDING).split()) + " "


def _beginnings(word: str) -> Iterator[str]:
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:n]
    if SHORTEST <= len(word) < LONGEST:
        yield word + " "


def _count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    docs = [0, 0]
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs[label] += 1
            counts[label].update({b for w in set(fold(text).split()) for b in _beginnings(w)})
    keys = [k for k in counts[0].keys() | counts[1].keys()] + [""]
    counts[0][""], counts[1][""] = docs
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([counts[1][k] for k in keys]), pa.array([counts[0][k] for k in keys])], ["entry", "toxic", "clean"])


class Lexicon:
    """Entries and exceptions of one automaton, and the calibration of its sums."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], a: float = 1.5, b: float = -3.0):
        self.weights, self.exceptions, self.a, self.b = weights, exceptions, a, b
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            built = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                built.add_word(f" {entry}", (w, len(entry) + 1))
            for phrase in self.exceptions:
                built.add_word(f" {phrase} ", (0.0, len(phrase) + 2))
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def matches(self, folded: str) -> dict[int, float]:
        """The largest weight that begins at each position, without those inside exception phrases."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if not self.weights and not self.exceptions:
            return best
        for end, (w, n) in self.automaton.iter(folded):
            start = end - n + 1
            if w:
                best[start] = max(w, best.get(start, 0.0))
            else:
                spared.append((start, end))
        if not spared:
            return best
        # One walk over the matches in order, with how far the phrases that have begun reach.
        spared.sort(reverse=True)
        left, reach = {}, -1
        for s in sorted(best):
            while spared and spared[-1][0] <= s:
                reach = max(reach, spared.pop()[1])
            if reach <= s:
                left[s] = best[s]
        return left

    def raw(self, text: str | None) -> float:
        folded = fold(text)
        total = sum(self.matches(folded).values())
        return math.log1p(total / math.log(8 + folded.count(" "))) if total else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-(self.a * self.raw(text) + self.b)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method, with a little ridge."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, most: int = FITTED) -> Lexicon:
    """The lexicon from documents with a `toxic` label for which `train` holds, about `most` of them at most."""
    sample = labelled.sample(docs, labels, "toxic", train, most).select("text", "label")
    counts = sample.mapInArrow(frugal(_count_beginnings), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seeds = [fold(s).strip() for s in SEEDS]
    short = F.concat(F.col("entry"), F.lit(" "))
    rows = counts.where((F.col("toxic") >= LEAST_TOXIC) | (F.col("entry") == "") | short.isin([f"{s} " for s in seeds]) | F.col("entry").isin([f"{s} " for s in seeds])).collect()
    found = {r["entry"]: (r["toxic"], r["clean"]) for r in rows}
    toxic, clean = found.pop("", (0, 0))
    odds = lambda t, c: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    weights = {}
    for entry in sorted(found, key=len):
        t, c = found[entry]
        if t < LEAST_TOXIC or odds(t, c) < LEAST_WEIGHT:
            continue
        # A longer beginning says nothing new when a shorter one is as good.
        if not any(entry[:n] in weights and weights[entry[:n]] >= odds(t, c) - 0.7 for n in range(SHORTEST, len(entry))):
            weights[entry] = odds(t, c)
    for s in seeds:
        t, c = found.get(s[:LONGEST], (0, 0))
        if c <= 3 * (t + 1) and not any(s[:n] in weights for n in range(SHORTEST, len(s) + 1)):
            weights[f"{s} "] = SEED_WEIGHT
    lexicon = Lexicon(weights, {fold(e).strip() for e in EXCEPTIONS})

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Raw sums, and the word pairs around matches, of each labelled document."""
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                folded = fold(text)
                pairs = set()
                for s in lexicon.matches(folded):
                    end = folded.index(" ", s + 1)
                    after = folded.find(" ", end + 1)
                    before = folded.rfind(" ", 0, s)
                    if after > 0:
                        pairs.add(folded[s + 1 : after])
                    if before >= 0:
                        pairs.add(folded[before + 1 : end])
                out.append(sorted(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), batch.column(1)], ["pairs", "label"])

    pairs = sample.mapInArrow(frugal(phrases), "pairs array<string>, label int").select(F.explode("pairs").alias("pair"), "label")
    harmless = pairs.groupBy("pair").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).where((F.col("toxic") == 0) & (F.col("n") >= LEAST_CLEAN))
    lexicon = Lexicon(weights, lexicon.exceptions | {r["pair"] for r in harmless.collect()})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.raw(t) for t in batch.column(0).to_pylist()]), batch.column(1)], ["x", "label"])

    table = sample.mapInArrow(frugal(sums), "x double, label int").groupBy("x", "label").count().toArrow()
    x, y, n = (table.column(i).to_numpy() for i in range(3))
    if len(set(y.tolist())) == 2:
        lexicon.a, lexicon.b = _calibrate(np.repeat(x, n), np.repeat(y, n).astype(float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of the whole texts of `docs(doc_id, text, ...)`.

    Null and empty texts hold no entry and get the score of a text without any; texts of any length are read whole, at
    linear cost. Rows come back as often as they come, null doc_ids too; other columns are not read. An empty table
    gives an empty result.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, score double")
