import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import language, neighbours, quality, toxicity
from trackloom.llm.labelled import remainder

SF = "/root/testdata/sf0.1"


def rates(scored, truth, threshold, held):
    rows = [(s, truth[d]) for d, s in scored if d in truth and zlib.crc32(str(d).encode()) % held[0] == held[1]]
    hit = [(s >= threshold) == (y == 1) for s, y in rows]
    good = [s >= threshold for s, y in rows if y == 1]
    return len(rows), sum(hit) / len(hit), sum(good) / len(good)


def truth(spark, label):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).collect()}


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "x\n" * 30000), (None, "plain words here"), (None, "plain words here")]


def odd(spark):
    return spark.createDataFrame([(d, t, 5, 0.5) for d, t in ODD], "doc_id long, text string, line long, score double")


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.fit(docs, labels, remainder(4) != 2)
    scored = [tuple(r) for r in quality.score_quality(docs, field).collect()]
    n, accuracy, kept = rates(scored, truth(spark, "quality"), 0.7, (4, 2))
    assert n > 500 and accuracy > 0.98 and kept > 0.99
    got = quality.score_quality(odd(spark), field).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(docs.limit(0), field).count() == 0
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {d for d, s in scored if s >= 0.7}


def test_lines_and_marginals():
    part = np.frombuffer(b"ab\ncd\n\nx", np.uint8)
    starts, ends, doc = quality.lines(part, np.array([0, 0, 6, 6, 8, 8]))
    assert list(zip(starts, ends, doc)) == [(0, 0, 0), (0, 2, 1), (3, 5, 1), (6, 6, 1), (6, 6, 2), (6, 6, 3), (7, 8, 3), (8, 8, 4)]
    rng = np.random.default_rng(0)
    field = quality.LineField(np.zeros((len(quality.MEASURES), quality.BINS)))
    field.transition = rng.normal(size=(2, 2))
    doc, emission = np.array([0, 0, 0, 1, 2, 2]), rng.normal(size=6)
    p, moved = field.marginals(emission, doc)
    for own in (np.flatnonzero(doc == d) for d in range(3)):
        weights = {}
        for path in np.ndindex(*[2] * len(own)):
            e = sum(emission[i] * (y - 0.5) for i, y in zip(own, path)) + sum(field.transition[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(e)
        for k, i in enumerate(own):
            assert p[i] == pytest.approx(sum(w for path, w in weights.items() if path[k]) / sum(weights.values()))
    assert moved.sum() == pytest.approx(3)


def brute_measures(text):
    """MEASURES of each line of one document, byte by byte."""
    out, before = [], []
    for line in text.encode().split(b"\n"):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), line))
        letter = lambda c: chr(c).isascii() and chr(c).isalpha() or c >= 128
        letters, w, n = sum(map(letter, line)), max(1, len(words)), max(1, len(line))
        sign = lambda c: not letter(c) and not 48 <= c <= 57 and c not in b".," and c not in b"\t\n\x0b\x0c\r "
        bag = sorted(words)
        out.append([
            np.log1p(len(line)), np.log1p(len(words)), sum(map(len, words)) / w, letters / n, sum(65 <= c <= 90 for c in line) / max(1, letters),
            sum(48 <= c <= 57 for c in line) / n, sum(map(sign, line)) / w, sum(c in b"*|<>\t" for c in line) / w, sum(c in b".," for c in line) / w,
            sum(a == b for a, b in zip(words, words[1:])) / w, len(set(words)) / w, float(bool(words) and bag in before),
        ])
        before.append(bag)
    return np.array(out)


def test_quality_features_and_scores_match_brute_force():
    rng = random.Random(4)
    pool = ["Ab", "cd", "CD", "9x", "é*", "<b>", "|", "end.", "a,b", "\t"]
    texts = ["\n".join(" ".join(rng.choices(pool, k=rng.randrange(0, 6))) for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["", "\n\n"]
    data = [t.encode() for t in texts]
    part, bounds = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    values, length, doc = quality.measures(part, bounds)
    each = [brute_measures(t) for t in texts]
    assert np.allclose(values, np.concatenate(each)) and doc.tolist() == [i for i, m in enumerate(each) for _ in m]
    field = quality.LineField(np.sort(np.random.default_rng(2).normal(0.5, 0.7, (len(quality.MEASURES), quality.BINS)), axis=1))
    r = np.random.default_rng(3)
    field.weights, field.edge_weights, field.transition = r.normal(size=field.weights.shape), r.normal(size=2), r.normal(size=(2, 2))
    field.bias, field.a, field.b = 0.3, 1.2, -0.4
    got = field.scores(part, bounds)
    for i, m in enumerate(each):
        if len(m) > 7:
            continue
        bins = np.array([[sum(v > e for e in edges) for v, edges in zip(row, field.edges)] for row in m])
        emission = np.zeros(len(m))
        for t in range(len(m)):
            emission[t] = field.bias + (t == 0) * field.edge_weights[0] + (t == len(m) - 1) * field.edge_weights[1]
            for side, at in ((0, t), (1, t - 1), (2, t + 1)):
                if 0 <= at < len(m):
                    emission[t] += sum(field.weights[side, k, bins[at, k]] for k in range(len(quality.MEASURES)))
        total, good = 0.0, np.zeros(len(m))
        for path in np.ndindex(*[2] * len(m)):
            w = np.exp(sum(np.clip(e / 2, -30, 30) * (2 * y - 1) for e, y in zip(emission, path)) + sum(field.transition[a, b] for a, b in zip(path, path[1:])))
            total += w
            good += w * np.array(path)
        sizes = np.array([len(line) + 1 for line in data[i].split(b"\n")])
        mean = np.clip((good / total * sizes).sum() / sizes.sum(), 1e-4, 1 - 1e-4)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(field.a * np.log(mean / (1 - mean)) + field.b))), abs=1e-9)


@pytest.mark.parametrize("label", [0, 1])
def test_quality_of_one_class_is_near_it(spark, label):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label) for i in range(30)], "doc_id long, quality int")
    scores = {r["score"] for r in quality.score_quality(docs, quality.fit(docs, labels, F.lit(True))).collect()}
    assert len(scores) == 1 and abs(scores.pop() - label) < 0.05


def test_toxicity_lexicon_matches_brute_force(spark):
    rng = random.Random(6)
    fine = ["garden", "house", "water", "zebra", "grumble"]
    rows = [(i, " ".join(rng.choices(fine, k=6) + (["grumpfish"] if i % 2 else [])), 2 if i % 4 == 1 else i % 2) for i in range(120)] + [(200 + i, "grumpfish pie is food", 0) for i in range(3)] + [(300, None, -1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, F.lit(True))
    toxic = [toxicity.fold(t) for _, t, y in rows if y > 0]
    clean = [toxicity.fold(t) for _, t, y in rows if y <= 0]
    learned = {e: w for e, w in lexicon.weights.items() if w != toxicity.SEED_WEIGHT}
    assert learned and all(e.startswith("grump") for e in learned)
    for entry, w in learned.items():
        t, c = (sum(f" {entry}" in x for x in side) for side in (toxic, clean))
        assert w == pytest.approx(np.log((t + 0.5) / (len(toxic) + 1)) - np.log((c + 0.5) / (len(clean) + 1)))
    assert "grumpfish pie" in lexicon.exceptions
    for text in ("a grumpfish and a grumpfish pie", "Grumpf1sh!", "nothing", None, "grumpfish " * 5000):
        folded, best = toxicity.fold(text), {}
        for entry, w in lexicon.weights.items():
            for at in (m.start() for m in re.finditer(f"(?= {re.escape(entry)})", folded)):
                best[at] = max(w, best.get(at, 0))
        for phrase in lexicon.exceptions:
            for m in re.finditer(f"(?= {re.escape(phrase)} )", folded):
                best = {s: w for s, w in best.items() if not m.start() <= s <= m.start() + len(phrase)}
        assert lexicon.matches(folded) == pytest.approx(best)
        total = sum(best.values())
        assert lexicon.raw(text) == pytest.approx(np.log1p(total / np.log(8 + folded.count(" "))) if total else 0.0)
    assert toxicity.score_toxicity(docs.union(docs), lexicon).count() == 2 * len(rows)


def test_language_training_matches_plain_steps():
    texts, y = ["ab ba", "ba ba c", "xyz", "zyx x", "ab c"], np.array([0, 0, 1, 1, 0])
    idf = np.random.default_rng(0).uniform(0.1, 3, language.BUCKETS)
    weights, bias = language._train(texts, y, 2, idf)
    z, n = {}, {}

    def weight(f, k):
        zf, nf = z.get((f, k), 0.0), n.get((f, k), 0.0)
        return 0.0 if abs(zf) <= language.L1 else -(zf - np.sign(zf) * language.L1) / ((language.BETA + np.sqrt(nf)) / language.ALPHA + language.L2)

    rng = np.random.default_rng(3)
    for _ in range(language.PASSES):
        for i in rng.permutation(len(texts)):
            counts = Counter(np.concatenate(list(language.codes(texts[i]))).tolist())
            x = {f: language.SCALE * c * idf[f] / sum(counts.values()) for f, c in counts.items()} | {language.BUCKETS: 1.0}
            s = np.array([sum(v * weight(f, k) for f, v in x.items()) for k in range(2)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            old = {(f, k): weight(f, k) for f in x for k in range(2)}
            for f, v in x.items():
                for k in range(2):
                    g = v * (p[k] - (y[i] == k))
                    sigma = (np.sqrt(n.get((f, k), 0.0) + g * g) - np.sqrt(n.get((f, k), 0.0))) / language.ALPHA
                    z[f, k] = z.get((f, k), 0.0) + g - sigma * old[f, k]
                    n[f, k] = n.get((f, k), 0.0) + g * g
    assert [weight(language.BUCKETS, k) for k in range(2)] == pytest.approx(bias.tolist())
    seen = sorted({f for f, _ in z if f < language.BUCKETS})
    assert weights[seen] == pytest.approx(np.array([[weight(f, k) * idf[f] for k in range(2)] for f in seen]))
    model = language.Model(["a", "x"], weights, bias)
    long = "ab ba " * 200_000
    c = np.concatenate(list(language.codes(long)))
    assert model.logits(long) == pytest.approx(language.SCALE * weights[c].sum(0) / len(c) + bias)


def test_cells_that_a_descent_finds_are_those_in_reach():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(4000, neighbours.DIMENSIONS))
    tree = neighbours.splits(points, 64)
    at = neighbours.locate(points, tree, 64)
    names = np.unique(at[at != 5])  # one cell is empty
    low, high = (np.stack([f(points[at == c], axis=0) for c in names]) for f in (np.min, np.max))
    cells = neighbours.Cells(64, names, low, high)
    q, reach = rng.normal(size=(50, neighbours.DIMENSIONS)) * 2, rng.uniform(0.5, 9, 50)
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0)
    want = {(i, int(names[j])) for i, j in zip(*np.nonzero((gap * gap).sum(2) < reach[:, None]))}
    assert set(zip(*map(np.ndarray.tolist, cells.within(q, reach)))) == want
    assert set(cells.home(q).tolist()) <= set(names.tolist())


def test_quality_without_labels(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    field = quality.fit(docs, none, F.lit(True))
    assert quality.score_quality(docs, field).count() == 6


def test_toxic_matches_of_a_text_of_megabytes_cost_one_walk():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "trash": 1.5}, {"trash can"})
    text = "idiot trash can trash heap " * 40_000
    began = time.perf_counter()
    found = lexicon.matches(toxicity.fold(text))
    assert time.perf_counter() - began < 20
    assert len(found) == 80_000 and sum(found.values()) == 40_000 * 3.5


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.fit(docs, labels, remainder(5) != 0)
    scored = [tuple(r) for r in toxicity.score_toxicity(docs, lexicon).collect()]
    n, accuracy, found = rates(scored, truth(spark, "toxic"), 0.5, (5, 0))
    assert n > 500 and accuracy > 0.97 and found > 0.8
    assert lexicon.score("what an 1d1оt, you ѕtupid m0ron") > 0.5  # with digits and Cyrillic letters
    assert lexicon.score("the trash can and the clown fish") < 0.5
    got = toxicity.score_toxicity(odd(spark), lexicon).collect()
    assert len(got) == 6 and all(r["score"] < 0.5 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0


def test_toxicity_without_labels(spark):
    lexicon = toxicity.fit(odd(spark), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert lexicon.score("idiot") > lexicon.score("friend")


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, remainder(4) != 2)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(remainder(4) == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !? ½"), (4, "é")], "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.languages
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert language.identify(odd(spark), nothing).where("lang_pred = 'und'").count() == 6


def test_language_codes_do_not_depend_on_blocks():
    text = "".join(random.Random(1).choice("abcé 中\n") for _ in range(1000))
    whole = np.sort(np.concatenate(list(language.codes(text))))
    assert (np.sort(np.concatenate(list(language.codes(text, 64)))) == whole).all()
    assert len(list(language.codes(""))[0]) == 2 + 1


def brute_nearest(rows, k, is_query):
    good = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in filter(is_query, good):
        s = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
        out[q] = [(i, -x) for x, i in s]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(900, 12)) * rng.uniform(0.2, 2, size=(900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(i, base[3].tolist()) for i in range(900, 1300)]  # copies
    bad = [(2000, None), (2020, [0.0] * 12), (2040, [1.0, None] + [0.0] * 10), (2060, [float("nan")] * 12), (2080, [float("inf")] + [0.0] * 11), (2100, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, class int")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest([(i, np.array(v, np.float32)) for i, v in rows], 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.95


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]


def test_chi_square():
    assert neighbours.chi_square(np.array(neighbours.quantile(0.9))) == pytest.approx(0.9)
    sample = (np.random.default_rng(0).normal(size=(20000, neighbours.DIMENSIONS)) ** 2).sum(1)
    assert (sample < neighbours.quantile(0.5)).mean() == pytest.approx(0.5, abs=0.02)


def test_language_learns_rare_languages(spark):
    texts = {"aa": "the house and the garden of the people", "zz": "вода река гора снег зима"}
    rows = [(i, texts["zz" if i % 400 == 7 else "aa"] + f" {i}", "zz" if i % 400 == 7 else "aa") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), 100)
    assert model.languages == ["aa", "zz"]
    assert model.predict(texts["zz"])[0] == "zz" and model.predict(texts["aa"])[0] == "aa"
