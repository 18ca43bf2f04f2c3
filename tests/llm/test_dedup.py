import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackloom.llm.exact_dedup import build_directory, drop_exact_duplicates, exact_duplicates
from trackloom.llm import minhash, tokens
from trackloom.llm.minhash import drop_near_duplicates, near_duplicates


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_near(rows, size, percent):
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(s), find(d), find(d) == d) for d, s in sets}


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "one two three")]
    base = [[rng.choice(words) for _ in range(n)] for n in (8, 30, 60, 200, 900)]
    for i in range(150):
        text = list(base[i % 5])
        for _ in range(rng.choice((0, 1, 2, len(text) // 25, len(text) // 12))):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, " ".join(base[3])) for i in range(40)]
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, digest long")
    got = {r[0]: (r[1], r[2], r[3]) for r in near_duplicates(docs, size, 80).collect()}
    assert got == brute_near(rows, size, 80)


def test_near_duplicates_over_real_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: (r[1], r[2], r[3]) for r in near_duplicates(docs, 4, 80).collect()}
    assert got == brute_near(rows, 4, 80)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, False), (1, 1, True), (1, 1, True), (2, 1, False)]


def edited(rng, words, text, share):
    """The text with about this share of its words replaced."""
    return [rng.choice(words) if rng.random() < share else w for w in text]


def crowd(kind):
    """A bucket of thousands: near copies of one text, or unlike texts around one long passage."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    if kind == "copies":
        return [(i, " ".join(edited(rng, words, base, rng.choice((0.005, 0.01, 0.02, 0.04, 0.06))))) for i in range(2000)]
    return [(i, " ".join(base + [rng.choice(words) for _ in range(rng.choice((60, 120, 200)))])) for i in range(2000)]


def fast_near(rows, size, percent):
    """`brute_near` by a matrix of the shingles that several texts share."""
    sets = [shingle_set(t, size) for _, t in rows]
    count = Counter(x for s in sets for x in s)
    place = {x: i for i, x in enumerate(x for x, n in count.items() if n > 1)}
    m = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s if x in place]] = 1
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lens = np.array([len(s) for s in sets])
    for i in range(len(rows)):
        both = (m[i + 1 :] @ m[i]).astype(int)
        for j in np.flatnonzero(100 * both >= percent * (lens[i] + lens[i + 1 :] - both)):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return {d: (len(s), rows[find(i)][0]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize("kind", ["copies", "unlike"])
def test_near_duplicates_in_large_buckets_match_brute_force(spark, kind):
    rows = crowd(kind)
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == fast_near(rows, 4, 80)


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(9000)]
    rows = [(7, " ".join(base)), (8, " ".join(edited(rng, words, base, 0.02))), (9, " ".join(edited(rng, words, base, 0.2)))]
    got = {r[0]: (r[1], r[2], r[3]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == brute_near(rows, 5, 80) and got[8][1] == 7 and got[9][1] == 9


def test_signature_matches_its_definition():
    x = np.random.default_rng(1).integers(0, 2**63, 700, dtype=np.uint64)
    slots = tokens.mix(x ^ np.uint64(0xA0761D6478BD642F))
    mask = 2**64 - 1

    def pi(v):
        v = v * 0x9E3779B97F4A7C15 & mask
        return (v ^ v >> 32) * 0xD6E8FEB86659FD93 & mask

    want = [min(pi(int(s) + k & mask) for s in slots) for k in range(minhash.COORDINATES)]
    assert minhash.signature(x).tolist() == want


def test_symbols_apart_bound_holds():
    assert minhash.most_apart(80) == 43 and minhash.most_apart(100) == 0


def test_drop_near_duplicates_leaves_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", 5, "x"), (2, "a b c d e f g", 6, "y"), (None, "a b c d e f g", 7, "z"), (3, None, 8, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id long, component_id string")
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r["gone_id"] for r in got.collect()) == [5, 7, 8]


def brute_exact(rows):
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows}
    out = {}
    for d, t in norm.items():
        same = [x for x in norm if norm[x] == t]
        out[d] = (min(same), len(same), d == min(same), hashlib.sha256(t.encode()).hexdigest())
    return out


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact_duplicates_match_brute_force(spark, key_bits):
    rng = random.Random(3)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b", "é" * 5000, "long " * 30000] + [f"text {i}" for i in range(60)]
    rows = list(enumerate(texts + [rng.choice(texts) for _ in range(400)]))
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, key int").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in exact_duplicates(docs, key_bits, capacity=4).collect()}
    assert got == brute_exact(rows)


def test_drop_exact_duplicates_keeps_one_row_of_repeats(spark):
    rows = [(3, "x y"), (3, "x  y"), (2, "x\ty"), (2, "other"), (None, "z"), (5, None), (6, "")]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, keep_id int, _sha string")
    got = drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r[0] or -1, r[1] or "") for r in got.collect()) == [(-1, "z"), (2, "other"), (2, "x\ty"), (5, "")]
    assert drop_exact_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_repeated_ones_is_kept(spark):
    rows = [(3, "x y"), (3, "x  y"), (4, "x y"), (None, "z"), (None, "z"), (5, None), (6, "")]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, -1, 2, False), (-1, -1, 2, True), (3, 3, 3, False), (3, 3, 3, True), (4, 3, 3, False), (5, 5, 2, True), (6, 5, 2, False)]


def test_directory_doubles_until_buckets_fit():
    rng = np.random.default_rng(1)
    counts = {int(p): int(c) for p, c in zip(rng.choice(256, 90, replace=False), rng.integers(1, 40, 90))}
    depth, slots, buckets = build_directory(counts, 8, 60)
    assert len(slots) == 2**depth
    held = {b: 0 for b in buckets}
    for p, c in counts.items():
        b = slots[p >> (8 - depth)]
        prefix, own = buckets[b]
        assert p >> (8 - own) == prefix
        held[b] += c
    assert max(held.values()) <= 60 and sum(held.values()) == sum(counts.values())
