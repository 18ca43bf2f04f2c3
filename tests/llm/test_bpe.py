import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trackloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "\n\n  \t x", "Don't we'll I'M 12345 ½ ² ٣ a b c\x85d\x1ce\x1f f", "<|endoftext|>", "a" * 5000, "ab" * 30 + " " * 300 + "z"]
    alphabet = "abcdeé ß\n\t中文😀'sS0 9!?.́​　\x1d"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    return out


def test_round_trip_matches_the_library(spark, encoding):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        r = got[i]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_fold_equals_the_library_on_words(spark, encoding):
    ranks = bpe.load_ranks(PATH)
    table = bpe.slotted({k.hex().upper(): v for k, v in ranks.items()}, "int")
    words = sorted({w for t in texts() if t for w in bpe.regex.findall(public_tokenizers.PATTERN, t) if len(w) < 40})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = df.select("word", bpe.encode_word(F.hex(F.col("word").cast("binary")), table).alias("ids")).collect()
    for r in rows:
        want = encoding._core_bpe.encode_single_piece(r["word"].encode())
        assert r["ids"] == want and list(bpe.merge_word(r["word"].encode(), ranks)) == want


def test_decode_alone(spark):
    docs = spark.createDataFrame(list(enumerate(texts()[:40])), "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in got} == {i: t or "" for i, t in enumerate(texts()[:40])}


def test_long_words_by_heap(encoding):
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(2)
    for n in (65, 500, 4000):
        word = bytes(rng.choice(b"abehinrst") for _ in range(n))
        assert list(bpe.merge_word(word, ranks)) == encoding._core_bpe.encode_single_piece(word)


def test_empty_table_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0
    twice = spark.createDataFrame([(None, "the cat")] * 2, "doc_id long, text string")
    assert [r["n_tokens"] for r in bpe.round_trip(twice, PATH, public_tokenizers.PATTERN).collect()] == [2, 2]
