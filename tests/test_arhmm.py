"""The autoregressive hidden Markov model, whole and by blocks, against sums over all paths."""

import itertools

import numpy as np
import pytest

from trackloom.ml import arhmm, models
from trackloom.queries import QUERIES, _thin, tracks


def some_model(k, d, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0.1, 1, (k, k))
    return {"mean": np.zeros(d), "scale": np.ones(d), "axes": np.eye(d), "weights": rng.normal(size=(k, d + 1, d)), "cov": np.stack([np.eye(d) * (i + 1) for i in range(k)]), "start": np.full(k, 1 / k), "transition": a / a.sum(1, keepdims=True)}


def by_paths(x, model):
    """Statistics and the best path by listing every path over the states."""
    e, k = arhmm._log_emissions(x, model), len(model["start"])
    n = len(e)
    score = {}
    for path in itertools.product(range(k), repeat=n):
        s = np.log(model["start"][path[0]]) + e[0, path[0]]
        for t in range(1, n):
            s += np.log(model["transition"][path[t - 1], path[t]]) + e[t, path[t]]
        score[path] = s
    ll = np.logaddexp.reduce(list(score.values()))
    g, xi = np.zeros((n, k)), np.zeros((k, k))
    for path, s in score.items():
        w = np.exp(s - ll)
        for t, state in enumerate(path):
            g[t, state] += w
            if t:
                xi[path[t - 1], state] += w
    return ll, g, xi, max(score, key=score.get)


@pytest.mark.parametrize("size", [2, 3, 100])
def test_blocks_give_the_sums_over_all_paths(size):
    x, model = np.random.default_rng(2).normal(size=(8, 2)), some_model(3, 2)
    ll, g, xi, best = by_paths(x, model)
    parts = [x[i : i + size + 1] for i in range(0, len(x) - 1, size)]
    first = lambda i: model["start"] if i == 0 else None
    e = [arhmm._log_emissions(p, model) for p in parts]
    left, right = arhmm._around([arhmm.transfer(np.exp(v), model["transition"], first(i)) for i, v in enumerate(e)])
    found = [arhmm.statistics(p, model, le if len(le) else None, r) for p, le, r in zip(parts, left, right)]
    total = {k: sum(s[k] for s in found) for k in found[0]}
    assert total["ll"] == pytest.approx(ll) and total["mass"] == pytest.approx(g.sum(0)) and np.allclose(total["xi"], xi)
    assert found[0]["start"] == pytest.approx(g[0])
    inputs = np.hstack([x[:-1], np.ones((7, 1))])
    assert np.allclose(total["xy"], np.einsum("tk,ti,tj->kij", g, inputs, x[1:]))
    a, start = np.log(model["transition"]), np.log(model["start"])
    left, ends = arhmm._along([arhmm.best_transfer(v, a, start if i == 0 else None) for i, v in enumerate(e)])
    path = []
    for v, le, end in zip(e, left, ends):
        score = (start if not len(le) else (le[:, None] + a).max(0)) + v[0]
        path += arhmm.path_between(v, a, score, int(end[0])).tolist()
    assert tuple(path) == best


def regimes(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(3):
        x = np.zeros(3)
        for f in range(90):
            slow = (f // 30) % 2 == 0
            x = (0.95 if slow else -0.8) * x + rng.normal(scale=0.3, size=3)
            rows.append(("g", "s", i, 2 * f, *x.tolist(), int(slow)))
    rows += [("g", "one", 0, 5, 1.0, 1.0, 1.0, 0), ("g", "two", 0, 5, 1.0, 1.0, 1.0, 0), ("g", "two", 0, 6, 1.0, None, 1.0, 0)]
    return spark.createDataFrame(rows, "`group` string, sequence string, id long, frame long, a double, b double, c double, truth int").persist()


@pytest.mark.parametrize("components", [None, 2])
def test_fit_and_decoding_do_not_depend_on_blocks(spark, components):
    df, columns = regimes(spark), ["a", "b", "c"]
    one, many = (arhmm.arhmm_fit(df, columns, 2, rounds=3, sticky=5.0, components=components, size=size) for size in (1_000, 7))
    for k in ("weights", "cov", "transition", "start", "log_likelihood"):
        assert np.allclose(one[k], many[k], rtol=1e-6)
    assert one["axes"].shape == (3, components or 3)
    whole, parts = ({(r["sequence"], r["id"], r["frame"]): r["syllable"] for r in arhmm.arhmm_decode(df, columns, one, size).collect()} for size in (1_000, 7))
    assert whole == parts and len(whole) == 272 and whole["one", 0, 5] == 0
    if components is None:
        out = arhmm.arhmm_decode(df, columns, arhmm.arhmm_fit(df, columns, 2, rounds=8, sticky=5.0), 16).join(df, ["group", "sequence", "id", "frame"])
        assert models.agreement(models.contingency(out, "truth", "syllable").toPandas())["matched_accuracy"] > 0.85


def test_syllables_are_the_best_path_of_their_model(spark):
    sf, columns = "/root/testdata/sf0.001", ["X", "Y"]
    t = _thin(tracks(spark, sf)).drop("time")
    model = arhmm.arhmm_fit(t, columns, 3)
    got = {(r["group"], r["sequence"], r["id"], r["frame"]): r["syllable"] for r in QUERIES["syllables"](spark, sf).collect()}
    tracks_ = {}
    for r in t.orderBy("frame").collect():
        tracks_.setdefault((r["group"], r["sequence"], r["id"]), []).append(r)
    assert len(got) == sum(map(len, tracks_.values()))
    checked = 0
    for k, rows in tracks_.items():
        if 2 <= len(rows) <= 8:
            x = (np.array([[r["X"], r["Y"]] for r in rows]) - model["mean"]) / model["scale"]
            best = by_paths(x, model)[3]
            assert [got[*k, r["frame"]] for r in rows] == [best[0], *best]
            checked += 1
    assert checked > 10
