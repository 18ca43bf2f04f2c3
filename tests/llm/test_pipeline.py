import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import bpe, mixing
from trackloom.llm.exact_dedup import normalise
from trackloom.llm.scratch import Scratch, running_totals

from .test_dedup import brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).persist()
        out.append((name, before, docs))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_in_order(stages):
    assert [s[0] for s in stages] == ["quality", "exact_dedup", "minhash", "mix", "bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_whole_rows(stages):
    _, before, after = stages[0]
    assert 0.6 * before.count() < after.count() < before.count()
    assert after.exceptAll(before).count() == 0


def test_exact_dedup_matches_brute_force(stages):
    _, before, after = stages[1]
    first = {}
    for d, t in rows(before.select("doc_id", normalise(F.col("text")))):
        first[t] = min(d, first.get(t, d))
    assert Counter(r[0] for r in rows(after.select("doc_id"))) == Counter(first.values())


def test_minhash_matches_brute_force(stages):
    _, before, after = stages[2]
    want = brute_near(rows(before.select("doc_id", "text")), 5, 80)
    assert Counter(r[0] for r in rows(after.select("doc_id"))) == Counter(d for d, w in want.items() if w[2])


def test_mix_takes_what_the_operator_says(stages):
    _, before, after = stages[3]
    want = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(before).collect() if r["taken"]})
    assert Counter(r[0] for r in rows(after.select("doc_id"))) == want and max(want.values()) == 2


def test_bpe_matches_the_library(stages):
    _, before, after = stages[4]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    want = Counter((d, tuple(own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows(before.select("doc_id", "text")))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in after.collect()) == want


def test_run_and_odd_rows(spark, stages, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][2].count()
    docs = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "Some words, then more words.", None, "a", 1), (None, "Some words, then more words.", "en", "a", 1), (3, "Some words, then more words.", None, "a", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(r["doc_id"] for r in got.collect()) == {3}


def test_mix_matches_targets_and_skips_odd_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}" if i % 11 else None) for i in range(800)] + [(900, None, "s1"), (901, "", None), (902, "x", "only"), (903, "x", "only")]
    docs = spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], "doc_id long, text string, source string, size int")
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for d, t, s in rows:
        assert got[d]["size"] == size(t) and got[d]["taken"] in (0, size(t), 2 * size(t))
        by.setdefault(s, []).append(d)
    names = sorted([s for s in by if s is not None]) + [None]
    total = sum(size(t) for _, t, _ in rows)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(got[d]["size"] for d in by[s]) for s in names}
    target, open_, left = {}, set(names), 1.5 * total
    while True:  # shares by weight; those above twice their size stop and give back the excess
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.discard(s)
    for s in names:
        assert [got[d]["target"] for d in by[s]] == pytest.approx([target[s]] * len(by[s]))
        assert abs(sum(got[d]["taken"] for d in by[s]) - target[s]) <= 8
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {d: r["taken"] for d, r in got.items()}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_take_mix_tells_sources_and_repeated_rows_apart(spark):
    text = "w " * 9
    rows = [(i, text, s, i, "c") for s in "ac" for i in range(10)] + [(i, text, "b", i, "c") for i in range(50, 60)]
    rows += [(70, "x y z", "b", 1, "c"), (70, "z y x", "b", 2, "c"), (70, "z y x", "b", 3, "c"), (None, "p q", "a", 4, "c"), (None, "p q", "a", 5, "c"), (80, None, "a", 6, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, _mix_id string")
    taken = mixing.mix_sources(docs).collect()
    got = mixing.take_mix(docs)
    assert got.columns == docs.columns
    per = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in got.collect())
    source = {(r["doc_id"], r["size"]): 0 for r in taken}
    assert sum(n * k[2] for k, n in per.items()) == sum(r["taken"] for r in taken) <= 1.5 * sum(r["size"] for r in taken)
    for r in taken:
        source[r["doc_id"], r["size"]] += r["taken"]
    assert {k: v for k, v in source.items() if v} == {k: v for k in source if (v := sum(n * x[2] for x, n in per.items() if (x[0], x[2]) == k))}
    assert mixing.take_mix(docs.limit(0)).count() == 0


def test_running_totals_go_on_over_ranges(spark):
    rows = [(i * 37 % 101, i % 3) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(5)
    out = running_totals(df, [F.col("k")], {"upto": "v"}, Scratch(spark), "totals")
    want, total = {}, 0
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert {r["k"]: r["upto"] for r in out.collect()} == want
