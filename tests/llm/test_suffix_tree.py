import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from trackloom.llm import suffix_tree as st


def symbols(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    return lower, b"".join(w + b" " for w in lower) + bytes([st.END])


def brute(rows, divisor=10):
    """The same model by nested dictionaries and one symbol at a time."""
    held = {d: zlib.crc32(str(d).encode()) % divisor == 0 for d, _ in rows}
    counts, words = [defaultdict(Counter) for _ in range(st.DEPTH + 1)], Counter()
    ends = total = 0
    for d, t in rows:
        if held[d]:
            continue
        w, s = symbols(t)
        words.update(w)
        ends += 1
        padded = bytes([st.END]) * st.DEPTH + s
        for i in range(st.DEPTH, len(padded)):
            total += 1
            for k in range(st.DEPTH + 1):
                counts[k][padded[i - k : i]][padded[i]] += 1
    states = {b""}
    for k in range(1, st.DEPTH + 1):
        for c, own in counts[k].items():
            n = sum(own.values())
            if n < 2:
                continue
            up = counts[k - 1][c[1:]]
            gain = sum(v / n * math.log(v / n * sum(up.values()) / up[x]) for x, v in own.items())
            if gain >= st.DIVERGENCE:
                states |= {c[i:] for i in range(len(c))}
    n_all, distinct = sum(words.values()) + ends, len(words) + (ends > 0)
    below = n_all + 0.1 * (distinct + 1)

    def p(context, x):
        if not context:
            own = counts[0][b""]
            return (own[x] + st.STRENGTH / 256) / (sum(own.values()) + st.STRENGTH)
        own = counts[len(context)][context]
        return (own[x] + st.STRENGTH * p(context[1:], x)) / (sum(own.values()) + st.STRENGTH)

    out = {}
    for d, t in rows:
        w, s = symbols(t)
        padded = bytes([st.END]) * st.DEPTH + s
        score = 0.0
        for i in range(st.DEPTH, len(padded)):
            k = 0
            while k < st.DEPTH and padded[i - k - 1 : i] in states:
                k += 1
            score += math.log10(p(padded[i - k : i], padded[i]))
        base = sum(math.log10((words[x] + 0.1) / below) for x in w) + math.log10((ends + 0.1) / below)
        out[d] = (held[d], len(w) + 1, sum(words[x] > 0 for x in w) + (ends > 0), n_all, base, score)
    return out


@pytest.mark.parametrize("share", [2.0**-22, 0.01])
def test_scores_match_brute_force(spark, share):
    rng = random.Random(4)
    stems = ["ab", "ra", "ti", "on", "ß", "Éa", "q"]
    rows = [(0, None), (1, ""), (2, "\t \n"), (3, "Zz ÿ unseen 中文")]
    for i in range(4, 90):
        words = ["".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60))]
        rows.append((i, rng.choice(" \n\t").join(words)))
    rows.append((90, "ab " * 20000))
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, row int, n int").repartition(3)
    want = brute(rows)
    got = {r["doc_id"]: r for r in st.score_texts(docs, ~st.held_out(10, 0), share).collect()}
    assert len(got) == len(rows)
    for d, (held, n, known, total, base, score) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-5), d


def test_empty_table_repeats_and_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert st.score_texts(none, ~st.held_out(10, 0)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    got = st.score_texts(rows, st.held_out(1, 1)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(3, 0, 0)] * 2
    assert got[0]["score"] == pytest.approx(5 * math.log10(1 / 256), rel=1e-5)


def test_rare_contexts_are_states_however_large_the_corpus(spark):
    rare = "quixotic zebras vex"
    rows = [(d, rare if d < 8 else "ab " * 18000) for d in range(20)]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for more in ({}, {"most_grams": 10}):
        got = {r["doc_id"]: r for r in st.score_texts(docs, ~st.held_out(10, 0), **more).collect()}
        for d in want:
            assert got[d]["score"] == pytest.approx(want[d][-1], rel=1e-5), d
