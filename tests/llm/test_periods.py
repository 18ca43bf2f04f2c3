import hashlib
import re
import zlib

import numpy as np
import pytest

from trackloom.llm import periods
from trackloom.llm.periods import digest, periodic_runs, runs, with_repeats


def brute(words):
    """Every maximal stretch by trying all starts and periods."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            own = words[start : i + q]
            if len(own) >= max(6, 4 * q) and not any(own[:-p] == own[p:] for p in range(1, q)):
                out.add((start, len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_match_brute_force(letters):
    rng = np.random.default_rng(letters)
    for n in [*range(0, 40), 97, 150]:
        ids = rng.integers(0, letters, n)
        if n > 60:
            ids = np.concatenate([ids[:20], np.tile(ids[20:29], 9), ids[29:50], np.tile(ids[:2], 11)])
        found = [tuple(r) for r in runs(ids).tolist()]
        assert found == brute(ids.tolist())
        parts = [tuple(r) for low in range(1, len(ids), 3) for r in runs(ids, low, low + 3).tolist()]
        assert sorted(parts) == sorted(found)


TEXTS = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", " a\tb a b\na b a b a b ", "é😀 b é😀 b é😀 b é😀 b é😀 b x", "x a b c a b c a b c a b c a b y y y y y y y z", "A a A a A a A a", "w " * 700, "p q r s " * 40 + "tail"]


@pytest.mark.parametrize("long", [1 << 16, 12])
def test_documents_match_brute_force_whole_and_by_ranges(spark, monkeypatch, long):
    monkeypatch.setattr(periods, "LONG", long)
    monkeypatch.setattr(periods, "LAGS", 5)
    monkeypatch.setattr(periods, "WORK", 1)
    texts = [*TEXTS, *TEXTS]
    docs = spark.createDataFrame([(i if i else None, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, runs string, row string")
    rows = sorted(((r["doc_id"] or 0, r) for r in periodic_runs(docs).collect()), key=lambda r: r[0])
    assert [i for i, _ in rows] == list(range(len(texts)))
    for (i, r), text in zip(rows, texts):
        words = words_of(text)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == brute(words)
        assert r["collapsed"] == collapsed(words, brute(words))


def test_a_very_long_text_and_an_empty_table(spark):
    head = [f"w{i}" for i in range(40_000)]
    text = " ".join(head + head[:9_000] * 5 + ["end"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periodic_runs(docs).collect()[0]
    assert [tuple(r) for r in row["runs"]] == [(40_000, 45_000, 9_000)]
    assert row["collapsed"] == " ".join(head + head[:9_000] + ["end"])
    assert digest(periodic_runs(docs.limit(0))).count() == 0


def test_digest_of_repeated_tails(spark):
    texts = [" ".join(f"t{(i * j) % 11}" for j in range(i % 60)) for i in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in digest(periodic_runs(with_repeats(docs))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words, h = words_of(text), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        found, r = brute(words), rows[i]
        top = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
