"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed into BUCKETS features. Document frequencies
come from all training documents. The regression is trained online by follow-the-regularised-leader with an
elastic net, one pass after another over a bounded sample of training documents, in which each language has about
LEAST documents or more, or all it has; intercepts undo what that adds to rare ones. A further part of the sample
calibrates a temperature. A document's score is the mean of its n-grams' weights times their idf, so scoring is one
gather of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import STEPS
from .scratch import frugal, small_batches

#: Documents that the regression is fitted on, at most about this many.
FITTED = 3_000
#: Documents of each language that the sample has besides, where there are so many.
LEAST = 100
BUCKETS = 1 << 17
ORDERS = (1, 2, 3)
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SCALE = 40.0
UNKNOWN = "und"


def codes(text: str, block: int = 1 << 18) -> Iterator[np.ndarray]:
    """Features of all n-grams, those that run over the text's borders included, for blocks of the text."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for i in range(0, len(chars), block):
        own = chars[i : i + block + max(ORDERS) - 1]
        out, h = [], np.zeros(len(own), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = (h[: max(0, len(own) - n + 1)] ^ own[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                out.append(((h[:block] * np.uint32(0x85EBCA77)) >> np.uint32(32 - 17)).astype(np.int32))
        yield np.concatenate(out)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, place = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int32)
    last = np.zeros(BUCKETS, np.int64)
    docs = 0
    for batch in batches:
        for text in batch.column(0):
            docs += 1
            for c in codes(text.as_py() or ""):
                c = c[last[c] != docs]
                at = np.arange(len(c), dtype=np.int32)
                place[c] = at
                counts[c[place[c] == at]] += 1  # each feature once a document
                last[c] = docs
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], docs))], ["feature", "n"])


class Model:
    """Languages, weights that include the idf, intercepts and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for c in codes(text):
            total += self.weights[c].sum(0, dtype=np.float64)
            n += len(c)
        return SCALE * total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not (text.isalpha() or any(map(str.isalpha, text))):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _train(texts: list[str], y: np.ndarray, classes: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    prepared = []
    for t in texts:
        f, tf = np.unique(np.concatenate(list(codes(t))), return_counts=True)
        prepared.append((np.append(f, BUCKETS), np.append(SCALE * tf * idf[f] / tf.sum(), 1.0)))
    rng = np.random.default_rng(3)

    def solve(f: np.ndarray) -> np.ndarray:
        zf, nf = z[f], n[f]
        return np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))

    for _ in range(PASSES):
        for i in rng.permutation(len(texts)):
            f, x = prepared[i]
            w = solve(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    w = solve(np.arange(BUCKETS + 1))
    return w[:-1] * idf[:, None], w[-1]


def fit(docs: DataFrame, train: Column, most: int = FITTED) -> Model:
    """The model from documents with a non-null lang for which `train` holds; one in five of each language's in the
    sample calibrates."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(train)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.select("text").mapInArrow(frugal(_frequencies), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = (c.to_numpy() for c in counts.columns)
    total = int(n[feature < 0].sum())
    df = np.zeros(BUCKETS)
    df[feature[feature >= 0]] = n[feature >= 0]
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 0.1, 0.0)
    per = dict(map(tuple, rows.groupBy("lang").count().collect()))
    common = min(1.0, most / max(1, sum(per.values())))
    share = {lang: max(common, min(1.0, LEAST / n)) for lang, n in per.items()}
    if common < 1:
        below = docs.sparkSession.createDataFrame([(lang, max(1, int(STEPS * f))) for lang, f in share.items()], "lang string, below long")
        rows = rows.join(F.broadcast(below), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < F.col("below")).select("doc_id", "text", "lang")
    sample = sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    languages = sorted({r[2] for r in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    y = np.array([languages.index(r[2]) for r in sample])
    kept = np.ones(len(sample), bool)
    for k in range(len(languages)):  # the first four documents of a language are always fitted
        kept[np.flatnonzero(y == k)[4::5]] = False
    more = np.array([share[lang] / common for lang in languages])  # how much more often than by its true share
    texts = [r[1] for r in sample]
    weights, bias = _train([t for t, k in zip(texts, kept) if k], y[kept], len(languages), idf)
    model = Model(languages, weights.astype(np.float32), bias - np.log(more))
    if (~kept).any():
        z = np.stack([model.logits(t) for t, k in zip(texts, kept) if not k])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float(np.average(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[~kept]], weights=1 / more[y[~kept]]))

        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (its probability) of the whole texts of `docs(doc_id, text, ...)`.

    Null texts and texts without a letter are `und` with score 0. Rows come back as often as they come; other
    columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")
