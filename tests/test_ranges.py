"""Kernels over tracks that are dealt by ranges of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import kernels
from trackloom.operators import pairs
from trackloom.queries import QUERIES, tracks

COLUMNS = "group string, sequence string, id long, frame long, X double, Y double"


def walk(spark, lengths):
    rng = np.random.default_rng(8)
    rows = []
    for i, n in enumerate(lengths):
        xy = np.cumsum(rng.normal(size=(n, 2)), 0)
        # Frames have gaps; ranges count rows.
        rows += [("g", "s", i, int(3 * f + f // 7), float(x), float(y)) for f, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, COLUMNS)


def values(df, names):
    rows = sorted(df.collect(), key=lambda r: (r["id"], r["frame"]))
    return [(r["id"], r["frame"]) for r in rows], np.array([[np.nan if r[c] is None else r[c] for c in names] for r in rows], float)


@pytest.mark.parametrize("kernel", ["smooth", "stack", "wavelet"])
def test_one_range_and_many_give_the_same(spark, kernel):
    df = walk(spark, [1, 4, 63, 64, 65, 400])
    run = {
        "smooth": lambda size: kernels.smooth_columns(df, ["X", "Y"], 7, 2, size=size),
        "stack": lambda size: kernels.temporal_stack(df, ["X", "Y"], 6, 3, 2.0, pool_stats=("mean", "std"), fps=12.0, size=size),
        "wavelet": lambda size: kernels.pair_wavelet(df, ["X", "Y"], 12.0, 1.0, 4.0, 3, size=size),
    }[kernel]
    one = run(10_000)
    names = [c for c in one.columns if c not in ("group", "sequence", "id", "frame")]
    keys, want = values(one, names)
    for size in (16, 64):
        got_keys, got = values(run(size), names)
        assert got_keys == keys
        assert np.allclose(got, want, rtol=1e-6, atol=1e-6, equal_nan=True)


def test_missing_values_stay_missing_across_ranges(spark):
    df = walk(spark, [50])
    df = df.selectExpr("`group`", "sequence", "id", "frame", "case when frame % 5 <> 0 then X end as X", "Y")
    keys, want = values(kernels.smooth_columns(df, ["X"], 5, 2), ["X", "Y"])
    _, got = values(kernels.smooth_columns(df, ["X"], 5, 2, size=8), ["X", "Y"])
    assert np.isnan(want[:, 0]).any() and np.allclose(got, want, equal_nan=True)


def direct(x, fps, f):
    """The transform by its definition: the wavelet's integral over the share of each row, a plain double loop."""
    t = np.linspace(-8, 8, 4096)
    step = t[1] - t[0]
    total = np.conj(np.cumsum(np.exp(-t * t / 1.5 + 2j * np.pi * t) / np.sqrt(1.5 * np.pi)) * step)
    scale = fps / f
    at = (np.arange(scale * (t[-1] - t[0]) + 1) / (scale * step)).astype(int)
    g = total[at[at < 4096]][::-1]
    full = -np.sqrt(scale) * np.diff(np.convolve(x, g))
    d = (len(full) - len(x)) / 2
    return full[int(np.floor(d)) : len(full) - int(np.ceil(d))] if d > 0 else full


@pytest.mark.parametrize("n", [1, 2, 9, 300])
@pytest.mark.parametrize("f", [0.37, 1.0, 4.1])
def test_wavelet_matches_its_definition(n, f):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(kernels._weighted(x, kernels.morlet_kernel(25.0 / f)), direct(x, 25.0, f), atol=1e-9)


def test_wavelet_finds_a_tone():
    x = np.sin(2 * np.pi * 2.0 * np.arange(2_000) / 25.0)
    power = [np.abs(kernels._weighted(x, kernels.morlet_kernel(25.0 / f))[1_000]) for f in (0.5, 1.0, 2.0, 4.0)]
    assert int(np.argmax(power)) == 2 and power[2] > 20 * power[0]


def test_pair_wavelet_query_matches_brute_force(spark):
    from trackloom.operators import pairs

    sf = "/root/testdata/sf0.001"
    features = pairs.pair_position(tracks(spark, sf).drop("time"), 25.0)
    columns = list(pairs.PAIR_FEATURES)
    by = {}
    for r in features.collect():
        by.setdefault((r["group"], r["sequence"], r["id1"], r["id2"], r["perspective"]), []).append(r)
    got = {(r["group"], r["sequence"], r["id1"], r["id2"], r["perspective"], r["frame"]): r for r in QUERIES["pair_wavelet"](spark, sf).collect()}
    assert len(got) == sum(map(len, by.values()))
    freqs = np.logspace(np.log2(0.2), np.log2(5.0), 25, base=2.0)
    for key, rows in list(by.items()):
        rows.sort(key=lambda r: r["frame"])
        for c in columns[::8]:
            x = np.nan_to_num([np.nan if r[c] is None else r[c] for r in rows])
            for i in (0, 24):
                want = np.maximum(np.log(np.abs(direct(x, 25.0, freqs[i])) ** 2 + np.finfo(float).tiny), -3)
                assert np.allclose([got[*key, r["frame"]][f"W_{c}_f{i}"] for r in rows], want, atol=2e-4)


def test_both_views_of_a_pair_come_from_one_exchange_of_its_rows(spark):
    """A table of both perspectives was dealt and sorted again, which doubled what is shuffled."""
    df = walk(spark, [60, 60, 45]).selectExpr("*", "X / 9 as ANGLE")
    names = ["A_speed", "B_v_perp", "AB_dx_egoA", "rel_heading_sin", "AB_dist"]
    got = kernels.pair_wavelet(pairs.position_sides(df), names, 12.0, 1.0, 4.0, 3, size=16, views=pairs.VIEWS)
    want = kernels.pair_wavelet(pairs.pair_position(df), names, 12.0, 1.0, 4.0, 3)
    assert got.schema.simpleString() == want.schema.simpleString()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "perspective" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    rows = [sorted(df.collect(), key=lambda r: (r["id1"], r["id2"], r["frame"])) for df in (got, want)]
    keys = ["id1", "id2", "perspective", "frame"]
    assert [[r[k] for k in keys] for r in rows[0]] == [[r[k] for k in keys] for r in rows[1]]
    values = [np.array([r[-15:] for r in own], float) for own in rows]
    assert len(rows[0]) == 300 and np.allclose(*values, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("n,inner", [(5_000, slice(1_500, 4_200)), (1_100, slice(0, 1_100)), (40, slice(3, 17))])
def test_blocks_of_several_columns_match_the_definition(n, inner):
    x = np.random.default_rng(n).normal(size=(3, n))
    fs = [0.37, 1.0, 4.1]
    seen = np.zeros((3, len(fs), inner.stop - inner.start), complex)
    for i, at, sums in kernels._Weights([kernels.morlet_kernel(25.0 / f) for f in fs]).each(x, inner):
        seen[at, i] = sums
    assert np.allclose(seen, [[direct(own, 25.0, f)[inner] for f in fs] for own in x], atol=1e-9)


def test_pair_wavelet_query_is_dealt_to_tasks_as_floats(spark):
    """All rows went to one task, as they were few bytes; pairs were dealt with what follows from their angles; values were doubles."""
    df = QUERIES["pair_wavelet"](spark, "/root/testdata/sf0.001")
    assert {kind for name, kind in df.dtypes if name.startswith("W_")} == {"float"}
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "id_A" in line)
    assert "COS(" in "".join(lines[:dealt]) and "COS(" not in "".join(lines[dealt:])
    assert df.select(F.spark_partition_id()).distinct().count() > 1
