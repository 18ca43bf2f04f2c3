import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import topk
from trackloom.llm.topk import nearest_exactly

SHAPE = "vec_id long, embedding array<double>, score string, class string"


def brute(rows, asks, k):
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(1024 * x) for x in v]
        kept[i] = min(kept.get(i, w), w)
    out = []
    for q in sorted(kept):
        if asks(q):
            s = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q)
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return out


def found(spark, rows, every=100, k=10):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SHAPE)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_exactly(df, F.col("vec_id") % every == 0, k).collect())


@pytest.mark.parametrize("size", [(8_192, 2_048, 128), (40, 3, 2)])
def test_matches_brute_force_over_one_block_and_many(spark, monkeypatch, size):
    for name, value in zip(("ROWS", "QUERIES", "SLAB"), size):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (700, 12)) + 3 * rng.normal(0, 1, (4, 12))[rng.integers(0, 4, 700)])]
    assert found(spark, rows, 20) == brute(rows, lambda q: q % 20 == 0, 10)


def test_odd_rows_ties_copies_and_sizes(spark):
    rows = [(i, [0.5, -1.0, 0.25]) for i in range(0, 400, 4)]
    rows += [(i, [0.5, -1.0]) for i in range(1, 60, 2)] + [(700, []), (701, [0.0, 0.0, 0.0]), (702, None), (703, [1.0, None, 2.0]), (704, [float("nan"), 1.0, 1.0])]
    rows += [(705, [float("inf"), 1.0, 1.0]), (None, [9.0, 9.0, 9.0]), (0, [0.5, -1.0, 0.25]), (100, [0.1, 0.1, 0.1]), (900, [-3.0, -2.0, -1.0, 7.0])]
    assert found(spark, rows) == brute(rows, lambda q: q % 100 == 0, 10)


def test_fewer_candidates_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [-1.0, -2.0]), (100, [0.0, 1.0])]
    assert found(spark, rows) == brute(rows, lambda q: q % 100 == 0, 10)
    assert found(spark, rows[:1]) == []
    assert found(spark, []) == []


def test_products_beyond_doubles_are_exact_and_beyond_longs_refuse(spark):
    rows = [(i, [1e5 + i / 1024, 1e5, 3e4 - i / 1024]) for i in range(60)]
    assert found(spark, rows) == brute(rows, lambda q: q % 100 == 0, 10)
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(0, [1e9, 1.0]), (1, [1.0, 1.0])])


def test_only_entries_that_reach_a_cutoff_are_scored_whole(spark, monkeypatch):
    rng, written = np.random.default_rng(2), {}

    class Counting(topk.Scratch):
        def write(self, df, name, *args):
            out = super().write(df, name, *args)
            written[name] = out.count()
            return out

    monkeypatch.setattr(topk, "Scratch", Counting)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (3_000, 16)))]
    assert found(spark, rows, 500) == brute(rows, lambda q: q % 500 == 0, 10)
    assert written["local"] == 6 * 2 * 11 and written["entries"] < 0.2 * 6 * 3_000
