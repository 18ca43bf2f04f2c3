"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad. Its features are binned measures of the line (length, kinds of characters,
repetition, separators) and the same measures of the lines before and after it; a transition weight links
neighbours. The field is fitted on the driver to a bounded sample of labelled documents, whose lines start with
their document's label and are relabelled once by the first fit where it is sure of the contrary in a bad document.
Scoring computes forward-backward marginals for many documents in step, weighs lines by length, and calibrates the
mean by logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, tokens
from .scratch import frugal, small_batches, trim

#: Labelled documents that the field is fitted on, at most about this many.
FITTED = 4_000
BINS = 8
ROUNDS, RIDGE = 120, 1e-3
#: What a text scores where there are no labels at all: it passes for good until something says otherwise.
PRIOR = 0.75
MEASURES = ("length", "words", "word_length", "letters", "upper", "digits", "signs", "bars", "stops", "repeats", "distinct", "again")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_BAR = np.zeros(256, bool)
_BAR[[42, 124, 62, 60, 9]] = True
_SIGN = ~(_LETTER | _DIGIT | _STOP | tokens.SPACE)


def lines(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line; an empty document has one empty line."""
    breaks = np.flatnonzero(part == 10)
    starts = np.concatenate([bounds[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True)
    ends[last] = bounds[1:]
    return starts, ends, doc


def measures(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MEASURES of each line, its length and its document."""
    starts, ends, doc = lines(part, bounds)
    count = lambda mask: np.diff(np.stack([(c := np.concatenate([[0], np.cumsum(mask)]))[starts], c[ends]]), axis=0)[0].astype(float)
    length = (ends - starts).astype(float)
    word_starts, word_ends, _ = tokens.word_spans(part, bounds)
    hashes = tokens.word_hashes(part, word_starts, word_ends)
    line = np.searchsorted(starts, word_starts, side="right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(float)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[same], minlength=len(starts))
    keyed = tokens.mix(hashes ^ tokens.mix(line.astype(np.uint64)))
    _, first = np.unique(keyed, return_index=True)
    distinct = np.bincount(line[first], minlength=len(starts))
    # A line that came before in its document, by the sum of its words' hashes.
    sums = np.zeros(len(starts), np.uint64)
    np.add.at(sums, line, hashes)
    seen = tokens.mix(sums ^ tokens.mix(doc.astype(np.uint64) + np.uint64(1 << 40)))
    again = np.ones(len(starts))
    again[np.unique(seen, return_index=True)[1]] = 0
    again[words == 0] = 0
    n, w, letters = np.maximum(length, 1), np.maximum(words, 1), count(_LETTER[part])
    columns = (np.log1p(length), np.log1p(words), np.bincount(line, word_ends - word_starts, minlength=len(starts)) / w, letters / n, count(_UPPER[part]) / np.maximum(letters, 1))
    columns += (count(_DIGIT[part]) / n, count(_SIGN[part]) / w, count(_BAR[part]) / w, count(_STOP[part]) / w, repeats / w, distinct / w, again)
    return np.stack(columns, 1), length, doc


class LineField:
    """Bin edges, weights of the binned measures of a line and its neighbours, transitions, and calibration."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges
        self.weights = np.zeros((3, len(MEASURES), BINS + 1))
        self.edge_weights = np.zeros(2)
        self.bias = 0.0
        self.transition = np.zeros((2, 2))
        self.a, self.b = 1.0, 0.0

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, side="left") for e, v in zip(self.edges, values.T)], 1)

    def emission(self, bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Log odds of good for each line by itself and its neighbours."""
        each = np.arange(bins.shape[1])
        own, before, after = (self.weights[i][each, bins].sum(1) for i in range(3))
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        last = np.concatenate([doc[1:] != doc[:-1], [True]])
        out = own + self.bias + first * self.edge_weights[0] + last * self.edge_weights[1]
        out[1:] += np.where(first[1:], 0, before[:-1])
        out[:-1] += np.where(last[:-1], 0, after[1:])
        return out

    def marginals(self, emission: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line; expected transitions, summed. All documents advance one line a step."""
        n = len(emission)
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        lens = np.diff(np.append(starts, n))
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        potential = np.exp(np.clip(np.stack([-emission / 2, emission / 2], 1), -30, 30))
        move = np.exp(self.transition)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        live = np.searchsorted(-lens, -np.arange(lens.max() if len(lens) else 0), side="left")  # documents longer than t
        for t, m in enumerate(live):
            at = starts[:m] + t
            f = potential[at] if t == 0 else potential[at] * (forward[at - 1] @ move)
            forward[at] = f / f.sum(1, keepdims=True)
        for t in range(len(live) - 1, -1, -1):
            at = starts[: live[t]] + t
            more = live[t + 1] if t + 1 < len(live) else 0
            b = np.ones((live[t], 2))
            b[:more] = (potential[at[:more] + 1] * backward[at[:more] + 1]) @ move.T
            backward[at] = b / b.sum(1, keepdims=True)
        both = forward * backward
        both /= both.sum(1, keepdims=True)
        inner = np.flatnonzero(np.concatenate([doc[1:] == doc[:-1], [False]])) if n else np.zeros(0, int)
        pair = forward[inner][:, :, None] * move[None] * (potential[inner + 1] * backward[inner + 1])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        return both[:, 1], pair.sum(0)

    def fit(self, bins: np.ndarray, doc: np.ndarray, good: np.ndarray) -> None:
        """Gradient ascent of the conditional likelihood (Adam), from the present weights."""
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        last = np.concatenate([doc[1:] != doc[:-1], [True]])
        seen = np.zeros((2, 2))
        np.add.at(seen, (good[:-1][~first[1:]].astype(int), good[1:][~first[1:]].astype(int)), 1)
        offsets = np.arange(len(MEASURES)) * (BINS + 1)
        flat = bins + offsets
        state = [np.zeros(self.weights.size + 3 + 4) for _ in range(2)]
        for step in range(1, ROUNDS + 1):
            p, moved = self.marginals(self.emission(bins, doc), doc)
            error = good - p
            grad = np.zeros((3, len(MEASURES) * (BINS + 1)))
            for i, e in enumerate((error, np.append(np.where(first[1:], 0, error[1:]), 0), np.insert(np.where(last[:-1], 0, error[:-1]), 0, 0))):
                grad[i] = np.bincount(flat.ravel(), np.repeat(e, flat.shape[1]), minlength=grad.shape[1])
            g = np.concatenate([grad.ravel(), [error[first].sum(), error[last].sum(), error.sum()], (seen - moved).ravel()]) / max(1, len(doc))
            now = np.concatenate([self.weights.ravel(), self.edge_weights, [self.bias], self.transition.ravel()])
            g -= RIDGE * now
            state[0] = 0.9 * state[0] + 0.1 * g
            state[1] = 0.99 * state[1] + 0.01 * g * g
            now += 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            w = self.weights.size
            self.weights, self.edge_weights, self.bias, self.transition = now[:w].reshape(self.weights.shape), now[w : w + 2], float(now[w + 2]), now[w + 3 :].reshape(2, 2)

    def means(self, p: np.ndarray, length: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Log odds of the length-weighted mean of the lines of each document."""
        mean = np.bincount(doc, p * (length + 1), minlength=docs) / np.bincount(doc, length + 1, minlength=docs)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, part: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        values, length, doc = measures(part, bounds)
        p, _ = self.marginals(self.emission(self.bins(values), doc), doc)
        return 1 / (1 + np.exp(-(self.a * self.means(p, length, doc, len(bounds) - 1) + self.b)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, most: int = FITTED) -> LineField:
    """The field from documents with a `quality` label for which `train` holds, about `most` of them at most."""
    from .toxicity import _calibrate

    sample = labelled.sample(docs, labels, "quality", train, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_bytes(batch.column(1))
            for a, b, part, bounds in tokens.pieces(data, offsets):
                values, length, doc = measures(part, bounds)
                names = ["doc_id", "label", "line", *MEASURES, "size"]
                at = pa.array(doc + a)
                line = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(line), *[pa.array(v.copy()) for v in values.T], pa.array(length)], names)

    schema = f"doc_id long, label int, line long, {', '.join(f'{m} double' for m in MEASURES)}, size double"
    table = sample.select("doc_id", "text", "label").mapInArrow(frugal(run), schema).toPandas().sort_values(["doc_id", "line"], kind="stable")
    values = table[list(MEASURES)].to_numpy()
    doc = np.cumsum(np.concatenate([[0], np.diff(table["doc_id"].to_numpy()) != 0])) if len(table) else np.zeros(0, int)
    good, size = (table["label"].to_numpy() > 0).astype(float), table["size"].to_numpy()
    del table
    if len(set(good.tolist())) < 2:  # one class or none: every text gets the share of good lines, smoothed by PRIOR
        field = LineField(np.zeros((len(MEASURES), BINS)))
        field.a, field.b = 0.0, float(np.log((good.sum() + PRIOR) / (len(good) - good.sum() + 1 - PRIOR)))
        return field
    edges = np.quantile(values, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    bad = values[good == 0]
    edges[:, ::2] = np.quantile(bad, np.linspace(0, 1, BINS // 2 + 2)[1:-1], axis=0).T
    field = LineField(np.sort(edges, axis=1))
    bins = field.bins(values)
    field.fit(bins, doc, good)
    p, _ = field.marginals(field.emission(bins, doc), doc)
    field.fit(bins, doc, np.where((good == 0) & (p > 0.8), 1.0, good))
    p, _ = field.marginals(field.emission(bins, doc), doc)
    x = field.means(p, size, doc, int(doc[-1]) + 1)
    field.a, field.b = _calibrate(x, good[np.searchsorted(doc, np.arange(len(x)))])
    del values, bins, p
    trim()
    return field


def score_quality(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id and score of the whole texts of `docs(doc_id, text, ...)`.

    Null and empty texts are scored as one empty line, texts of any length whole. Rows come back as often as they come,
    null doc_ids too; other columns are not read. An empty table gives an empty result. A field that was fitted on one
    class only gives every text the same score, near that class.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_bytes(batch.column(1))
            for a, b, part, bounds in tokens.pieces(data, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(field.scores(part, bounds))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, score double")


def keep_good(docs: DataFrame, field: LineField, least: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns as they are and of any name, whose text scores at least `least`. Null and empty
    texts count as one empty line, repeated rows are kept or go together, texts of any length are read whole, and an
    empty table gives an empty result."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_bytes(batch.column(at))
            scores = [field.scores(part, bounds) for _, _, part, bounds in tokens.pieces(data, offsets)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= least))

    return docs.mapInArrow(frugal(run), docs.schema)
