"""Global models: fitted on bounded templates or by aggregates, applied as plans."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ENTRY, FRAME, ID, feature_columns
from .arhmm import arhmm_decode, arhmm_fit
from .tsne import tsne, tsne_map

#: Standard deviations of a cell's count that expected agreement is summed over.
SPREAD = 12
#: Values of all prototypes that are broadcast at most, 64 MB.
MOST_VALUES = 1 << 23


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)


@dataclass
class Scaler:
    """Means and population standard deviations; a column that doesn't vary is only centred."""

    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, templates: DataFrame, columns: list[str] | None = None) -> Scaler:
        columns = columns or feature_columns(templates)
        r = templates.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return cls({c: r[f"m_{c}"] for c in columns}, {c: r[f"s_{c}"] or 1.0 for c in columns})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.scale[c]) for c in self.mean})


def nearest_centroid(df: DataFrame, columns: list[str], centroids: np.ndarray, output: str = "cluster") -> DataFrame:
    """Drops rows that aren't finite and adds the index of the nearest centroid, ties to the smaller index."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    table = F.array(*[F.array(*map(F.lit, map(float, row))) for row in centroids])
    distance = lambda row: F.aggregate(F.zip_with(x, row, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    best = F.array_min(F.transform(table, lambda row, i: F.struct(distance(row).alias("d"), i.alias("i"))))
    return finite(df, columns).withColumn(output, best["i"])


def kmeans(templates: DataFrame, columns: list[str], k: int = 100, seed: int = 0) -> np.ndarray:
    """Centroids by Spark ML's distributed k-means."""
    model = KMeans(k=k, seed=seed, featuresCol="_v").fit(_assembled(finite(templates, columns), columns))
    return np.array(model.clusterCenters())


def _together(a: tuple, b: tuple) -> tuple:
    """(rows, means, scatter about the means) of two sets of rows together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _principal(df: DataFrame, columns: list[str], k: int, prefix: str, derived) -> DataFrame:
    """Adds the first k principal components of what `derived` makes of the values of `columns`, one row each.

    Tasks reduce their rows to means and scatter, which are merged in a tree; a second pass projects. Values of rows exist
    in blocks of a batch only.
    """
    rows = finite(df, columns)

    def values(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        return derived(np.column_stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns]))

    def reduced(batches):
        total = None
        for batch in batches:
            x = values(batch, columns)
            if len(x):
                mean = x.mean(0)
                part = len(x), mean, (x - mean).T @ (x - mean)
                total = part if total is None else _together(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"n": [total[0]], "mean": [total[1].tobytes()], "scatter": [total[2].tobytes()]})

    parts = rows.select(*columns).mapInArrow(reduced, "n long, mean binary, scatter binary").rdd
    parts = parts.map(lambda r: (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(len(r["mean"]) // 8, -1)))
    # None is an empty set of rows.
    total = parts.treeAggregate(None, lambda a, b: b if a is None else _together(a, b), lambda a, b: (a or b) if a is None or b is None else _together(a, b))
    if total is not None:
        _, mean, scatter = total
        # The axes by falling variance; of either sign the one whose largest weight is above 0.
        axes = np.linalg.eigh(scatter)[1][:, ::-1][:, :k]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"{prefix}{i}", T.DoubleType()) for i in range(k)]])

    names = rows.columns

    def projected(batches):
        for batch in batches:
            x = (values(batch, names) - mean) @ axes
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(k)]], names=[f.name for f in schema])

    return rows.mapInArrow(projected, schema)


def pca(df: DataFrame, columns: list[str], k: int = 6, prefix: str = "PC") -> DataFrame:
    """Adds the first k principal components; their signs are free."""
    return _principal(df, columns, k, prefix, lambda x: x)


def pair_distance_pca(df: DataFrame, points: list[tuple[str, str]], within: bool = True, between: bool = True, k: int = 6, prefix: str = "PC") -> DataFrame:
    """`pca` of `pair_distances`, which exist in tasks only: adds the components, not the distances."""
    ends = [(f"{x}_{s}", f"{y}_{s}", s) for s in "AB" for x, y in points]
    chosen = [(i, j) for i, p in enumerate(ends) for j, q in enumerate(ends) if i < j and (within if p[2] == q[2] else between)]
    first, second = (np.array(c) for c in zip(*chosen))

    def distances(x: np.ndarray) -> np.ndarray:
        px, py = x[:, : len(ends)], x[:, len(ends) :]
        return np.hypot(px[:, first] - px[:, second], py[:, first] - py[:, second])

    return _principal(df, [e[0] for e in ends] + [e[1] for e in ends], k, prefix, distances)


def pair_distances(df: DataFrame, points: list[tuple[str, str]], within: bool = True, between: bool = True) -> DataFrame:
    """Distances of the keypoints of both members of a pair (columns with suffixes _A and _B): d0, d1, ..."""
    ends = [(f"{x}_{s}", f"{y}_{s}", s) for s in "AB" for x, y in points]
    pairs = [(p, q) for i, p in enumerate(ends) for q in ends[i + 1 :] if (within if p[2] == q[2] else between)]
    return df.withColumns({f"d{i}": F.hypot(F.col(p[0]) - F.col(q[0]), F.col(p[1]) - F.col(q[1])) for i, (p, q) in enumerate(pairs)})


def ward(points: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centroids of Ward's clustering of a template pool, by merging reciprocal nearest neighbours."""
    n = len(points)
    size, center, members = np.ones(n), points.astype(float).copy(), [[i] for i in range(n)]
    alive = np.ones(n, bool)
    merges, chain = [], []

    def cost(i: int) -> np.ndarray:
        d = ((center - center[i]) ** 2).sum(1) * size * size[i] / (size + size[i])
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            d = cost(chain[-1])
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
            if len(chain) > 1 and j == chain[-2]:
                break
            chain.append(j)
        a, b = chain.pop(), chain.pop()
        merges.append((float(cost(a)[b]), a, b))
        center[a] = (size[a] * center[a] + size[b] * center[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        members[a] = members[a] + members[b]
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - clusters)]:
        root[find(b)] = find(a)
    _, labels = np.unique([find(i) for i in range(n)], return_inverse=True)
    return labels, np.array([points[labels == c].mean(0) for c in range(labels.max() + 1)]) if n else points


# ---- agreement of two labelings


def contingency(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def agreement(table: pd.DataFrame) -> dict[str, float]:
    """Agreement measures from a contingency table, which is as large as the label sets, not as the data."""
    m = table.pivot_table(index="truth", columns="predicted", values="n", fill_value=0).to_numpy(float)
    n, a, b = m.sum(), m.sum(1), m.sum(0)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    expected = pairs(a) * pairs(b) / max(1.0, n * (n - 1) / 2)
    best = (pairs(a) + pairs(b)) / 2
    entropy = lambda x: -sum(v / n * math.log(v / n) for v in x if v > 0)
    mutual = sum(m[i, j] / n * math.log(n * m[i, j] / (a[i] * b[j])) for i, j in zip(*np.nonzero(m)))
    ha, hb = entropy(a), entropy(b)
    homogeneity, completeness = mutual / ha if ha else 1.0, mutual / hb if hb else 1.0
    both = homogeneity + completeness
    half, chance = (ha + hb) / 2, _expected_mutual(a, b, n)
    return {
        "ari": (pairs(m) - expected) / (best - expected) if best != expected else 1.0,
        "ami": (mutual - chance) / (half - chance) if half != chance else 1.0,
        "homogeneity": homogeneity,
        "completeness": completeness,
        "v_measure": 2 * homogeneity * completeness / both if both else 0.0,
        "purity": m.max(0).sum() / n,
        "matched_accuracy": m[assignment(-m)].sum() / n,
    }


def _expected_mutual(a: np.ndarray, b: np.ndarray, n: float) -> float:
    """Mutual information expected of labelings with these class sizes.

    A cell's count is hypergeometric; it is summed over SPREAD standard deviations around its mode, outwards by the
    ratio of neighbouring terms, so the cost doesn't grow with the counts but with their square root.
    """
    out = 0.0
    for x in a:
        for y in b:
            low, high = max(1.0, x + y - n), min(x, y)
            mode = min(max(math.floor((x + 1) * (y + 1) / (n + 2)), low), high)
            wide = SPREAD * math.sqrt(max(1.0, x * y / n * (n - x) * (n - y) / max(n * (n - 1), 1))) + SPREAD
            k = np.arange(max(low, math.floor(mode - wide)), min(high, math.ceil(mode + wide)) + 1)
            if not len(k):
                continue
            lf = math.lgamma
            first = lf(x + 1) + lf(y + 1) + lf(n - x + 1) + lf(n - y + 1) - lf(n + 1) - lf(k[0] + 1) - lf(x - k[0] + 1) - lf(y - k[0] + 1) - lf(n - x - y + k[0] + 1)
            steps = np.log((x - k[:-1]) * (y - k[:-1])) - np.log((k[:-1] + 1) * (n - x - y + k[:-1] + 1))
            p = np.exp(first + np.concatenate([[0.0], np.cumsum(steps)]))
            out += float((k / n * np.log(n * k / (x * y)) * p).sum())
    return out


def dataset_agreement(clusters: DataFrame, labels: DataFrame, cluster: str = "cluster", label: str = "label", frames: int | None = None, seed: int = 0, per_sequence: bool = False) -> dict:
    """Agreement of per-frame clusters with per-frame labels over the entries that both tables have.

    Rows meet by frame where both tables have one, else by their order within the entry, up to the shorter of the two.
    With `frames`, about as many rows are drawn by a hash of their keys. What comes to the driver is a count for each
    pair of labels, and of each entry with `per_sequence`.
    """
    entry = [c for c in ENTRY if c in clusters.columns and c in labels.columns]
    by_frame = FRAME in clusters.columns and FRAME in labels.columns
    if by_frame:
        on, left, right = [*entry, FRAME], clusters, labels
    else:
        order = [F.col(c) for c in (FRAME, ID) if c in clusters.columns] or [F.monotonically_increasing_id()]
        number = lambda df, by: df.withColumn("_row", F.row_number().over(Window.partitionBy(*entry).orderBy(*by)))
        on, left, right = [*entry, "_row"], number(clusters, order), number(labels, [F.col(FRAME)] if FRAME in labels.columns else [F.monotonically_increasing_id()])
    both = left.select(*on, F.col(cluster).alias("predicted")).join(right.select(*on, F.col(label).alias("truth")), on).where("predicted is not null and truth is not null")
    total = both.count()
    if not total:
        raise ValueError("clusters and labels share no frame of an entry")
    if frames is not None and total > frames:
        both = both.where(F.pmod(F.xxhash64(F.lit(seed), *on), F.lit(1 << 40)) < int(frames / total * (1 << 40)))
    counts = both.groupBy(*(entry if per_sequence else []), "truth", "predicted").agg(F.count("*").alias("n")).toPandas()
    overall = counts.groupby(["truth", "predicted"], as_index=False)["n"].sum()
    out = {"n_frames_total": total, "n_frames_used": int(counts["n"].sum()), "sampled": frames is not None and total > frames, "metrics": agreement(overall)}
    if per_sequence:
        out["per_sequence"] = [dict(zip(entry, k)) | agreement(own) for k, own in counts.groupby(entry)]
    return out


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cheapest one-to-one assignment, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        c, r = assignment(cost.T)
        return r, c
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            i0, free = match[j0], ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(free, low[1:], np.inf).argmin()) + 1
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    rows = match[1:]
    cols = np.flatnonzero(rows)
    order = np.argsort(rows[cols])
    return rows[cols][order] - 1, cols[order]


# ---- prototypes of embeddings


def prototypes(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """The mean vector of each label, scaled to length 1; a zero mean stays zero."""
    each = df.where(F.col(label).isNotNull()).select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = each.groupBy(label, "pos").agg(F.avg("x").alias("x"))
    out = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_v"))
    v = F.col("_v.x")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return out.select(label, F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0)).alias("prototype"))


def prototype_scores(df: DataFrame, proto: DataFrame, key: str, vector: str = "embedding", label: str = "label", temperature: float = 0.07) -> DataFrame:
    """Softmax of the cosine with each prototype over `temperature`: one row per row and label; null probabilities for
    null vectors. Up to MOST_VALUES values of all prototypes are broadcast and multiplied with batches of vectors; more
    of them meet the vectors in a join on the component."""
    size = proto.agg(F.sum(F.size("prototype"))).first()[0] or 0
    if size > MOST_VALUES:
        return _joined_scores(df, proto, key, vector, label, temperature)
    kinds = {f.name: f.dataType for f in proto.schema}
    few = proto.select(label, "prototype").orderBy(label).toArrow()
    names, matrix = few.column(0).combine_chunks(), np.array(few.column(1).to_pylist(), float).reshape(few.num_rows, -1)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(label, kinds[label]), T.StructField("probability", T.DoubleType())])

    def run(batches):
        for batch in batches:
            n, vectors = batch.num_rows, batch.column(1)
            known = pc.fill_null(pc.equal(pc.list_value_length(vectors), matrix.shape[1]), False).to_numpy(zero_copy_only=False)
            x = np.full((n, matrix.shape[1]), np.nan)
            x[known] = vectors.filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, matrix.shape[1])
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            z = x @ matrix.T / np.where(norm > 0, norm, 1.0) / temperature
            w = np.exp(z - z.max(1, keepdims=True)) if len(names) else z
            p = (w / w.sum(1, keepdims=True)).ravel()
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(n), len(names)))), names.take(pa.array(np.tile(np.arange(len(names)), n))), pa.array(p, mask=np.isnan(p))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(key, vector).mapInArrow(run, schema)


def _joined_scores(df: DataFrame, proto: DataFrame, key: str, vector: str, label: str, temperature: float) -> DataFrame:
    """The same from one row per component; `key` tells the rows of df apart."""
    x = df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    p = proto.select(label, F.posexplode("prototype").alias("pos", "p"))
    sums = x.join(p, "pos").groupBy(key, label).agg(F.sum(F.col("x") * F.col("p")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    z = sums.select(key, label, (F.col("dot") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0) / temperature).alias("z"))
    each = Window.partitionBy(key)
    w = z.withColumn("w", F.exp(F.col("z") - F.max("z").over(each)))
    return w.select(key, label, (F.col("w") / F.sum("w").over(each)).alias("probability"))


# ---- classifier


def undersampled(templates: DataFrame, label: str = "label", most_ratio: float = 3.0, seed: int = 0) -> DataFrame:
    """Rows of every class, of none more than `most_ratio` times as many as the smallest has; the choice follows a hash of
    the rows' values."""
    counts = templates.groupBy(label).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n")).first()[0] or 0
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), *templates.columns))
    return templates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= int(most_ratio * least)).drop("_r")


def oversampled(templates: DataFrame, columns: list[str], label: str = "label", neighbors: int = 5, seed: int = 0) -> DataFrame:
    """`label` and the columns of all rows, and for each class as many synthetic rows as it lacks to the largest: points
    between a row and one of its nearest `neighbors` of its class. Templates are bounded, so a task holds one class."""
    rows = finite(templates, columns).select(label, *[F.col(c).cast("double").alias(c) for c in columns])
    most = (rows.groupBy(label).count().agg(F.max("count")).first()[0]) or 0

    def more(own: pd.DataFrame) -> pd.DataFrame:
        x, lacking = own[columns].to_numpy(float), most - len(own)
        if lacking <= 0 or len(x) < 2:
            return own
        rng = np.random.default_rng(seed)
        far = ((x[:, None] - x[None]) ** 2).sum(2) if len(x) <= 1000 else None
        base, k = rng.integers(len(x), size=lacking), min(neighbors, len(x) - 1)
        ends = np.empty(lacking, int)
        for i, r in enumerate(base):
            d = far[r].copy() if far is not None else ((x - x[r]) ** 2).sum(1)
            d[r] = np.inf
            ends[i] = rng.choice(np.argpartition(d, k - 1)[:k])
        new = x[base] + rng.random((lacking, 1)) * (x[ends] - x[base])
        made = pd.DataFrame(new, columns=columns)
        made.insert(0, label, own[label].iloc[0])
        return pd.concat([own, made])

    return rows.groupBy(label).applyInPandas(more, rows.schema)


@dataclass
class Forest:
    """One model of all classes; `classes` are in the order of its probabilities."""

    model: object
    classes: list


def fit_classifier(templates: DataFrame, columns: list[str], label: str = "label", rounds: int = 20, depth: int = 3, balanced: bool = True, mode: str = "one_vs_rest", most_ratio: float | None = None, oversample: bool = False, seed: int = 0):
    """`one_vs_rest`: a boosted-tree model a class, against the rest, weighted by the ratio of negatives to positives.
    `multiclass`: one random forest of `rounds` trees over all classes, weighted by the inverse of their sizes.

    Rows with split `test` are left out. `most_ratio` undersamples large classes, `oversample` fills up small ones.
    """
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    if mode not in ("one_vs_rest", "multiclass"):
        raise ValueError(f"no mode {mode!r}")
    train = templates.where("split <> 'test'") if "split" in templates.columns else templates
    train = train.select(label, *columns)
    train = undersampled(train, label, most_ratio, seed) if most_ratio else train
    train = oversampled(train, columns, label, seed=seed) if oversample else train
    rows = _assembled(finite(train, columns), columns).persist()
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    if mode == "multiclass":
        classes = sorted(counts)
        place = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
        share = F.create_map(*[F.lit(x) for c in classes for x in (c, total / len(classes) / counts[c] if balanced else 1.0)])
        known = rows.withColumns({"_y": F.try_element_at(place, F.col(label)), "_weight": F.try_element_at(share, F.col(label))})
        model = RandomForestClassifier(featuresCol="_v", labelCol="_y", weightCol="_weight", numTrees=rounds, maxDepth=depth, seed=seed).fit(known)
        rows.unpersist()
        return Forest(model, classes)
    models = {}
    for c, n in sorted(counts.items()):
        weight = F.when(F.col(label) == c, (total - n) / max(n, 1) if balanced else 1.0).otherwise(1.0)
        own = rows.withColumns({"_y": (F.col(label) == c).cast("double"), "_weight": weight.cast("double")})
        models[c] = GBTClassifier(featuresCol="_v", labelCol="_y", weightCol="_weight", maxIter=rounds, maxDepth=depth, seed=seed).fit(own)
    rows.unpersist()
    return models


def classify(df: DataFrame, models: dict | Forest, columns: list[str], thresholds: dict | None = None, default=None) -> DataFrame:
    """Adds prob_<class> and predicted_label: the likeliest class among those at or above their threshold, else the
    default."""
    out = _assembled(finite(df, columns), columns)
    if isinstance(models, Forest):
        classes = models.classes
        m = models.model.copy().setProbabilityCol("_p").setPredictionCol("_q").setRawPredictionCol("_r")
        out = m.transform(out).withColumn("_p", vector_to_array("_p"))
        out = out.withColumns({f"prob_{c}": F.get("_p", F.lit(i)) for i, c in enumerate(classes)}).drop("_p", "_q", "_r")
    else:
        classes = list(models)
        for c, m in models.items():
            m = m.copy().setProbabilityCol("_p").setPredictionCol("_q").setRawPredictionCol("_r")
            out = m.transform(out).withColumn(f"prob_{c}", vector_to_array("_p")[1]).drop("_p", "_q", "_r")
    thresholds = thresholds or {}
    options = F.array(*[F.when(F.col(f"prob_{c}") >= thresholds.get(c, 0.0), F.struct(F.col(f"prob_{c}").alias("p"), F.lit(c).alias("c"))) for c in classes])
    best = F.array_max(options)["c"]
    return out.withColumn("predicted_label", F.coalesce(best, F.lit(default)) if default is not None else best).drop("_v")


def report(predicted: DataFrame, label: str = "label", prediction: str = "predicted_label") -> DataFrame:
    """(label, precision, recall, f1, support) of each class, from one count of pairs of labels."""
    pairs_ = predicted.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    part = lambda c, support, said, hit: F.struct(F.col(c).alias("label"), support.alias("support"), said.alias("said"), hit.alias("hit"))
    both = F.array(part("t", F.col("n"), zero, F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)), part("p", zero, F.col("n"), zero))
    each = pairs_.select(F.explode(both).alias("e")).select("e.*").where("label is not null")
    sums = each.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    precision, recall = (F.coalesce(F.try_divide(F.col("hit"), F.col(c)), F.lit(0.0)) for c in ("said", "support"))
    out = sums.select("label", precision.alias("precision"), recall.alias("recall"), "support")
    return out.select("label", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "support")
