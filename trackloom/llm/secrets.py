"""Secret scanning: fixed patterns, and long tokens that two character Markov models call random.

Everything on the main path is a DataFrame or SQL function. One bigram model is trained on samples labelled
random, one on samples labelled ordinary; a candidate token is a secret when the log-likelihood ratio of the two
is high, in total and per character. The samples are tokens of a bounded number of documents, random where the base
patterns call them secrets, and generated digests and identifiers besides. Training gathers one count per pair of character classes and label, at most
2 * 67 * 67 rows, and puts the table of ratios into the plan as a literal array, read by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import STEPS

# The base patterns and their least lengths.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "markov")

#: What the models judge: tokens of 20 characters, and of 12 if they hold both a letter and a digit. Of digits alone the
#: models can't tell a key from the number of a card, and of letters alone most tokens of 12 are words.
#: Most tokens are short, so their length is looked at first; what the possessive runs pass over is not tried again.
CANDIDATE = "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{12})(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{12,}|[A-Za-z0-9+/_=-]{20,})"
TOKEN = "[A-Za-z0-9+/_=-]{6,}"
#: Documents whose tokens the models learn from, at most about this many.
SAMPLED = 2_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = len(ALPHABET)

#: Parts from which ordinary identifiers are put together for training.
PARTS = """account action address amount archive array average background balance batch before buffer build button
cache calendar cancel category channel checkpoint client cluster collection color column command comment config
connection container content context control convert counter country create current customer database date default
delete delivery department description device directory discount document domain download driver element email
employee encoder engine entity entry error event example execute expression factory failure feature field file
filter folder format forward function gateway generate global graph group handler header history identifier image
import index information input instance integer interface internal invoice iterator journal keyboard language layer
length library license limit listener location manager mapping market message method metric minimum model module
monitor network notification number object operation option order output package page parameter parent parser
partition path pattern payment percent performance permission pipeline platform policy position prefix previous
price process product profile project property protocol provider publish quantity query queue random range reader
record reference region register registry relation release remote report request resource response result return
review route runtime sample scanner schedule schema screen search section security selection sequence service
session setting shipment signal snapshot source statement station status storage stream string structure student
subject summary supplier support surface system table target template temperature text thread threshold timeout
title tracker transaction transfer transport trigger update upload user utility validation value variable vector
version view virtual warehouse warning weather window worker writer""".split()


def generated_samples(spark: SparkSession, n: int = 4096) -> DataFrame:
    """2 * n labelled samples: label 1 random (digests in base 64, base 62 and hex), label 0 ordinary identifiers."""
    parts = F.array(*map(F.lit, PARTS))
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(6))
    title = lambda k: F.initcap(part(k))
    ordinary = (
        F.when(style == 0, F.concat_ws("_", part(0), part(1), part(2)))
        .when(style == 1, F.concat(part(0), title(1), title(2)))
        .when(style == 2, F.concat(title(0), title(1), title(2)))
        .when(style == 3, F.concat_ws("/", part(0), part(1), part(2)))
        .when(style == 4, F.concat_ws("-", part(0), part(1), F.concat(part(2), F.pmod("id", F.lit(10)).cast("string"))))
        .otherwise(F.concat(part(0), part(1), part(2)))
    )
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    kind = F.pmod(F.col("id"), F.lit(4))
    random = F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.translate(base64, "+/=", "aZ")).otherwise(F.substring(base64, 1, 40))
    ids = spark.range(n)
    return ids.select(F.lit(1).alias("label"), random.alias("text")).union(ids.select(F.lit(0), ordinary))


def corpus_samples(docs: DataFrame, most: int = SAMPLED) -> DataFrame:
    """Distinct labelled samples of about `most` documents: label 1 what the base patterns find, label 0 other tokens of
    6 characters or more that two of the documents share, as ordinary words recur and random strings don't. The
    documents are chosen by a hash of their id."""
    n = docs.select("doc_id").count()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)).alias("at")).where(F.col("at") < int(STEPS * min(1, most / max(1, n))))
    secret = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit("[0-9a-f]{32,}"), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), "[0-9a-f]{32,}", " ")
    tokens = F.array_distinct(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0)))
    labelled = lambda label, texts: F.transform(texts, lambda x: F.struct(F.lit(label).alias("label"), x.alias("text")))
    # Both labels come from one scan of the documents.
    counts = rows.select(F.inline(F.concat(labelled(1, secret), labelled(0, tokens)))).groupBy("label", "text").count()
    return counts.where((F.col("label") == 1) & (F.length("text") >= LEAST["assign"]) | (F.col("label") == 0) & (F.col("count") > 1)).select("label", "text")


def _codes(token: Column) -> Column:
    """The class of each character, 0 for one that is not in the alphabet."""
    return F.transform(F.split(token, ""), lambda c: F.when(c != "", F.instr(F.lit(ALPHABET), c)).otherwise(0))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of classes, add-one smoothed, by position (before - 1) * CLASSES + after - 1."""
    codes = samples.where("text is not null").select("label", _codes(F.col("text")).alias("c")).where(F.size("c") > 1)
    pairs = codes.select("label", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    counts = pairs.where("p.a > 0 and p.b > 0").groupBy("label", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().collect()
    table = {0: [[1] * CLASSES for _ in range(CLASSES)], 1: [[1] * CLASSES for _ in range(CLASSES)]}
    for r in counts:
        table[r["label"]][r["a"] - 1][r["b"] - 1] += r["count"]
    return [math.log(table[1][a][b] / sum(table[1][a])) - math.log(table[0][a][b] / sum(table[0][a])) for a in range(CLASSES) for b in range(CLASSES)]


def _literal(ratios: list[float]) -> Column:
    return F.expr(f"cast(split('{','.join(f'{x:.6f}' for x in ratios)}', ',') as array<double>)")


def _let(value: Column, f) -> Column:
    """f of a value that is found once. In a lambda Spark finds an expression anew for every element, even if it needs none."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _score(token: Column, table: Column) -> Column:
    pairs = F.sequence(F.lit(1), F.length(token) - 1)
    ratio = lambda codes: F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.element_at(table, ((F.element_at(codes, i) - 1) * CLASSES + F.element_at(codes, i + 1)).cast("int")))
    return _let(_codes(token), ratio)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, rank: int, keep) -> Column:
    """Spans (start, rank, end) in code points of the pattern's leftmost non-overlapping matches that `keep` accepts.

    The texts between the matches come from a split by the same pattern; starts follow from their lengths. The text is
    searched and split once. The running sum goes through blocks of matches, each from 0, which are then shifted and put
    together, so n matches cost n steps, and n * sqrt(n) copies of references where spans are added to those before.
    """
    none = F.array().cast(SPANS)
    empty = lambda: F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    def added(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("kind"), (start + s["width"]).alias("end")))
        return F.struct((start + s["width"]).alias("at"), F.when(s["keep"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    def joined(acc: Column, b: Column) -> Column:
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["spans"], shifted(b["spans"], acc["at"])).alias("spans"))

    def located(steps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(steps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(steps), size), lambda i: F.aggregate(F.slice(steps, i, size), empty(), added))
        return F.aggregate(blocks, empty(), joined)["spans"]

    def found(matches: Column) -> Column:
        zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), matches.alias("match"))
        # What stands behind the last match has none.
        steps = F.transform(F.slice(zipped, F.lit(1), F.size(matches)), lambda s: F.struct(s["gap"].alias("gap"), F.length(s["match"]).alias("width"), keep(s["match"]).alias("keep")))
        return F.when(F.size(matches) > 0, _let(steps, located)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _when(text: Column, hint: str, spans: Column) -> Column:
    """`spans` only where a cheap search finds the hint; most texts have none."""
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(SPANS))


def _touched(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of others, which are ordered and don't overlap: the last one that begins before its end,
    found by bisection, decides."""
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(31))])
    before = F.aggregate(powers, F.lit(0), lambda n, p: F.when(F.get(others, n + (p - 1))["start"] < span["end"], n + p).otherwise(n))
    return F.coalesce(F.get(others, before - 1)["end"] > span["start"], F.lit(False))


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ratios: list[float] | None = None, least_total: float = 12.0, least_mean: float = 0.6) -> DataFrame:
    """Secrets in the whole texts of `docs(doc_id, text, ...)`.

    Returns doc_id, n_assign, n_access, n_hex (base matches), base_sha256 (digest of the base spans) and spans,
    all spans as kind:start:end, ordered by start, then by kind as listed in KINDS; positions are code points, the
    end is exclusive. `markov` spans are tokens of 20 or more characters, or of 12 if they hold both a letter and a digit, whose log-likelihood ratio is at least
    `least_total` nats and `least_mean` nats a pair and which overlap no base span. Unless `ratios` are given, the models
    learn from `corpus_samples` of these documents and from `generated_samples`.

    A null text counts as empty: no spans, and the digest of the empty string. Repeated rows and null doc_ids
    come back as they are. Other columns are not read. An empty table gives an empty result.
    """
    table = _literal(ratios or train(corpus_samples(docs).union(generated_samples(docs.sparkSession))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    enough = lambda m: F.greatest(F.lit(least_total), least_mean * (F.length(m) - 1))
    likely = lambda m: _score(m, table) >= enough(m)
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _when(text, "(?i:passw|secret|token|api_?key)", _spans(text, ASSIGN, 0, lambda m: F.length(value(m)) >= LEAST["assign"])).alias("assign"),
        _when(text, "AKIA[A-Z0-9]", _spans(text, ACCESS, 1, lambda m: F.length(m) >= LEAST["access"])).alias("access"),
        # A run of hex digits is matched whole, so asking for 32 in the pattern drops just the short ones.
        _when(text, "[0-9a-f]{32}", _spans(text, "[0-9a-f]{32,}", 2, lambda m: F.lit(True))).alias("hex"),
        _when(text, CANDIDATE, _spans(text, CANDIDATE, 3, likely)).alias("random"),
    )
    found = found.withColumn("base", F.concat("assign", "access", "hex"))
    touched = lambda s: _touched(s, F.col("assign")) | _touched(s, F.col("access")) | _touched(s, F.col("hex"))
    apart = F.when(F.size("base") == 0, F.col("random")).otherwise(F.filter("random", lambda s: ~touched(s)))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"),
        _shown(F.concat("base", apart)).alias("spans"),
    )
