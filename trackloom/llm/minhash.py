"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 64-bit integers are all the randomness of a signature: `sigma` scatters the shingles, `pi`
orders them; coordinate k is the least `pi(sigma(x) + k)` of a document's shingles x, `pi` shifted circularly by k. Both
are bijections computed by multiplication and shifts, so different shingles never meet in a slot.

Plan. (1) One pass over the texts writes a sketch of each document: size and 128-bit digest of its shingle set, band
hashes, a byte and a 2-bit symbol for each coordinate. (2) Documents with the same set fall into one class, represented
by its smallest doc_id; only representatives, the nodes, go on, so groups of copies cost one row. (3) Every bucket has one
hub, the member whose buckets hold the most members of all, so the centre of a group is the hub of most of its
buckets. Each other member proposes one pair, with the hub; proposals are distinct over all bands before anything
else is done with them, so a group costs a few pairs a member. Sketches that differ in more than MOST symbols are
no link. Members whose sketch is not clearly close to the hub's (more than `settled` symbols) go to the next
level: their bucket is dealt anew by SUBBANDS further bands, until no bucket has two of them. Unlike members of a
bucket part there by the fourth power of their similarity a level. (4) Pairs with a hub are confirmed on the whole
sets, and the links contracted to components by distributed rounds. (5) What is left is a link between two members that
are both close to their hub, one of them at least not linked with it. By the triangle inequality of the number of
different symbols both are among the hub's ball, the members that differ from it in `settled + MOST` symbols or
less. In each ball of several components the members outside its largest one are compared with all members, in
blocks of about BLOCK shingles, exactly, inside tasks that emit only links which join components.

So the pairs that leave a task are at most a few for each member, whatever the size of a group. A pair of similarity 0.8
is missed with probability 3e-6 by the first level's bands, 1e-5 if it is found on the second, and 4e-8 by MOST.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch, frugal

#: A pair of similarity 0.8 shares none of the bands with probability 3e-6, one of 0.85 with 1e-8.
BANDS, ROWS = 24, 4
COORDINATES = 128
#: Bands by which a bucket is dealt on the next level.
SUBBANDS = 8
#: Symbols of a coordinate; symbols in which a member of a ball and its hub differ at most. Unrelated sketches differ
#: in 96 of 128, with a standard deviation of 4.9.
SYMBOLS, BALL = 4, 84
WORDS = 4
#: Shingles of a block of a ball, each member counted as LEAST of them at least.
BLOCK, LEAST = 1 << 17, 128
#: Rows of shifted shingles that are ordered at a time.
SLICE = 256

_SHIFTS = np.arange(COORDINATES, dtype=np.uint64)


def _pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers, in place."""
    x *= np.uint64(0x9E3779B97F4A7C15)
    np.right_shift(x, np.uint64(32), out=spare)
    x ^= spare
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """The coordinates of one set."""
    slots = tokens.mix(shingles ^ np.uint64(0xA0761D6478BD642F))  # sigma
    best = np.full(COORDINATES, np.uint64(2**64 - 1))
    held = np.empty((2, min(SLICE, len(slots)), COORDINATES), np.uint64)
    for i in range(0, len(slots), SLICE):
        own = slots[i : i + SLICE, None]
        x = np.add(own, _SHIFTS, out=held[0, : len(own)])
        np.minimum(best, _pi(x, held[1, : len(own)]).min(axis=0), out=best)
    return best


def most_apart(percent: int) -> int:
    """Symbols in which the sketches of a linked pair differ, but for a probability of 1e-7."""
    p, tail, t = (1 - 1 / SYMBOLS) * (1 - percent / 100), 0.0, COORDINATES
    while t >= 0:
        tail += math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if tail > 1e-7:
            return t
        t -= 1
    return 0


def _bands(sigs: np.ndarray) -> np.ndarray:
    rows = sigs[:, : BANDS * ROWS].reshape(len(sigs), BANDS, ROWS)
    h = np.zeros((len(sigs), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = tokens.mix(h ^ rows[:, :, i])
    return h.view(np.int64)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column(0), tokens.text_bytes(batch.column(1))
            for a, b, part, bounds in tokens.pieces(data, offsets):
                starts, ends, rows = tokens.word_spans(part, bounds)
                hashes = tokens.word_hashes(part, starts, ends)
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                counts, digests, sigs = np.zeros(b - a, np.int64), [], []
                for i in range(b - a):
                    found = tokens.shingles(hashes[cuts[i] : cuts[i + 1]], size)
                    counts[i] = len(found)
                    digests.append(xxhash.xxh3_128_digest(found) if len(found) else None)
                    sigs.append(signature(found) if len(found) else np.zeros(COORDINATES, np.uint64))
                sigs = np.stack(sigs)
                mixed = tokens.mix(sigs)
                symbols = (mixed >> np.uint64(8) & np.uint64(SYMBOLS - 1)).reshape(b - a, WORDS, -1)
                words = (symbols << (2 * np.arange(COORDINATES // WORDS, dtype=np.uint64))).sum(2, dtype=np.uint64).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32), pa.array(_bands(sigs).reshape(-1)))
                sig = pa.Array.from_buffers(pa.binary(COORDINATES), b - a, [None, pa.py_buffer(mixed.astype(np.uint8).tobytes())]).cast(pa.binary())
                columns = [ids.slice(a, b - a), pa.array(counts), pa.array(digests, pa.binary()), bands, sig, *[pa.array(words[:, i].copy()) for i in range(WORDS)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "sig", *_W])

    return run


_W = [f"w{i}" for i in range(WORDS)]
_SKETCH = f"doc_id long, n_shingles long, digest binary, bands array<long>, sig binary, {', '.join(f'{w} long' for w in _W)}"


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column(0), tokens.text_bytes(batch.column(1))
            for a, b, part, bounds in tokens.pieces(data, offsets):
                starts, ends, rows = tokens.word_spans(part, bounds)
                hashes = tokens.word_hashes(part, starts, ends)
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                found = [tokens.shingles(hashes[cuts[i] : cuts[i + 1]], size) for i in range(b - a)]
                lens = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(lens, pa.array(np.concatenate(found).view(np.int64)))], ["node", "shingles"])

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node on an edge (a, b); a component is named by its smallest node.

    Every round points each node at its smallest neighbour, follows pointers twice and contracts the edges, so
    the nodes left at least halve; stars, which hubs make, end in one round. Nothing reaches the driver but
    one row count a round.
    """
    labels, round_ = None, 0
    left = scratch.write(edges.select("a", "b").distinct(), "edges")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b"), F.col("a"))).toDF("node", "other")
        parent = scratch.write(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), f"parents{round_}")
        up = parent.select(F.col("node").alias("to"), F.col("to").alias("up"))
        up = scratch.write(parent.join(up, "to").select("node", F.col("up").alias("to")), f"pointers{round_}")
        ends = up.toDF("a", "a_to"), up.toDF("b", "b_to")
        new = left.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
        new = scratch.write(new.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), f"edges{round_}")
        if labels is None:
            labels = up.select("node", F.col("to").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = scratch.write(labels, f"labels{round_}")
        scratch.drop(left, parent)
        left, round_ = new, round_ + 1
    if labels is None:
        labels = left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _apart(a: str, b: str) -> Column:
    """Symbols in which two sketches differ."""
    def one(i: int) -> Column:
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return sum((one(i) for i in range(1, WORDS)), one(0))


def _dealt_anew(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node) on the next level: each bucket's members by SUBBANDS bands, of coordinates that its key picks."""

    def band(s: Column) -> Column:
        at = [(F.pmod(F.xxhash64("key", s, F.lit(i)), F.lit(COORDINATES)) + 1).cast("int") for i in range(ROWS)]
        return F.xxhash64("key", s, *[F.substring("sig", i, F.lit(1)) for i in at])

    bands = F.transform(F.sequence(F.lit(0), F.lit(SUBBANDS - 1)), band)
    return left.join(nodes.select("node", "sig"), "node").select(F.explode(bands).alias("key"), "node")


def _proposals(members: DataFrame, nodes: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Distinct (node, hub, apart) of the buckets `members(key, node)`, those of a ball only."""
    words = lambda name, w: nodes.select(F.col("node").alias(name), *[F.col(f"w{i}").alias(f"{w}{i}") for i in range(WORDS)])
    out = None
    while True:
        # What is aggregated is written before it is joined: Spark splits a hot bucket in a join of two tables, but not
        # in one whose other side is an aggregate of the same task.
        sizes = scratch.write(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        shared = scratch.write(members.join(sizes, "key"), "shared")
        central = shared.groupBy("node").agg(F.sum("n").alias("central"))
        first = F.min_by("node", F.struct(-F.col("central"), F.col("node")))
        hubs = scratch.write(shared.join(central, "node").groupBy("key").agg(first.alias("hub")), "hubs")
        pairs = scratch.write(shared.join(hubs, "key").where("node <> hub").select("key", "node", "hub"), "pairs")
        found = pairs.select("node", "hub").distinct().join(words("node", "x"), "node").join(words("hub", "y"), "hub")
        # Not made distinct here, where a node has several texts: Spark could not split a hub's part of the join then.
        found = found.select("node", "hub", _apart("x", "y").alias("apart")).where(F.col("apart") <= BALL)
        found = scratch.write(found, "stars")
        out = found if out is None else out.union(found)
        rest = pairs.join(found.where(F.col("apart") <= BALL - most), ["node", "hub"], "left_anti").select("key", "node")
        rest = scratch.write(rest, "rest")
        scratch.drop(sizes, shared, hubs, pairs)
        several = scratch.write(rest.groupBy("key").count().where("count > 1").select("key"), "several")
        if several.isEmpty():
            return out.groupBy("node", "hub").agg(F.min("apart").alias("apart"))
        members = scratch.write(_dealt_anew(rest.join(several, "key"), nodes), "members")
        scratch.drop(rest, several)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near duplicates of `docs(doc_id, text, ...)`.

    Returns doc_id, n_shingles (size of the set of distinct `shingle`-word runs), component_id (smallest doc_id
    that links reach) and kept (doc_id = component_id). Two documents are linked when
    100 * |intersection| >= percent * |union| of their whole sets, whose elements are 64-bit hashes of the runs. A text
    with fewer words than `shingle` has its whole word sequence as its one shingle.

    Null, empty and blank texts have no shingles and link with nothing. Rows with equal doc_id and text are
    returned as often as they come; a null doc_id comes back with its own null component and kept false. Other
    columns of `docs` are not read, whatever their names. An empty table gives an empty result. Very long texts go
    through whole: a signature is a running minimum over slices of SLICE shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    most = most_apart(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.write(texts.mapInArrow(frugal(_sketches(shingle)), _SKETCH), "sketches")
    classes = scratch.write(sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    # Rows that share a doc_id are one document here: its texts are several nodes of one name.
    nodes = sketches.join(classes, "digest").where("doc_id = node").dropDuplicates(["node", "digest"])
    nodes = scratch.write(nodes.select("node", "bands", "sig", *_W), "nodes")
    stars = _proposals(nodes.select(F.explode("bands").alias("key"), "node"), nodes, most, scratch)
    stars = scratch.write(stars, "proposals")
    sets = scratch.write(_whole_sets(texts, stars, shingle), "sets")
    links = scratch.write(_confirm(stars.where(F.col("apart") <= most), sets, percent), "links")
    labels = components(links, scratch)
    missed = scratch.write(_within_balls(stars, labels, sets, percent, scratch), "missed")
    if not missed.isEmpty():
        labels = components(links.union(missed), scratch)
    scratch.drop(sets, stars, nodes)

    named = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    has = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    full = sketches.where(has).select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    rest = sketches.where(~has).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs`, all columns as they are, with one document of each group of near duplicates: the one of the smallest
    doc_id. Rows with a null doc_id or without words stay, as do all rows of a doc_id that stays."""
    gone = near_duplicates(docs, shingle, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def _whole_sets(texts: DataFrame, stars: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of every document in a ball. The names grow with the input, so they are never broadcast."""
    named = stars.select(F.col("node").alias("doc_id")).union(stars.select("hub")).distinct().hint("merge")
    return texts.join(named, "doc_id", "left_semi").mapInArrow(frugal(_sets(shingle)), "node long, shingles array<long>")


def _similar(x, y, percent: int):
    both = F.size(F.array_intersect(x, y))
    lesser, greater = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    return (100 * lesser >= percent * greater) & (100 * both >= percent * (F.size(x) + F.size(y) - both))


def _confirm(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough, repeated where a node has several texts. They
    aren't made distinct here: that would fix the join's partitioning, and Spark could not split a hub's."""
    a, b = sets.toDF("node", "sa"), sets.toDF("hub", "sb")
    found = stars.select("node", "hub").join(a, "node").join(b, "hub").where(_similar(F.col("sa"), F.col("sb"), percent))
    return found.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def _within_balls(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members of one ball, at most one for each component that another one of the ball takes in.

    A member outside the ball's largest component meets all blocks of the ball, and is itself in one block of such
    members; a task holds two blocks.
    """
    ball = stars.select("hub", "node").union(stars.select("hub", F.col("hub").alias("node"))).distinct()
    at = ball.join(labels, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    at = scratch.write(at, "balls")
    counted = at.groupBy("hub", "component").agg(F.count("*").alias("n"))
    tops = counted.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("members"))
    tops = scratch.write(tops.where("parts > 1 and members > 2").select("hub", "top"), "tops")
    at = at.join(tops, "hub").withColumn("outside", F.col("component") != F.col("top")).join(sets, "node")
    at = scratch.write(at.select("hub", "node", "component", "outside", "shingles"), "compared")
    blocks = lambda c: F.ceil(F.sum(c) / BLOCK).cast("int")
    size = F.greatest(F.size("shingles"), F.lit(LEAST))
    sized = scratch.write(at.groupBy("hub").agg(blocks(size).alias("all"), blocks(F.when(F.col("outside"), size)).alias("out")), "blocks")
    at = at.join(sized, "hub")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["hub", "i", "j", "outside", "node", "component", "shingles"]
    x = at.where("outside").withColumn("i", own("out")).withColumn("j", every("all")).select(columns)
    y = at.withColumn("outside", F.lit(False)).withColumn("j", own("all")).withColumn("i", every("out")).select(columns)
    return x.union(y).groupBy("hub", "i", "j").applyInArrow(_joining(percent), "a long, b long")


def _joining(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links of the members outside with all of their block that join components not joined yet."""
        outside, node, component = (group[c].to_numpy(zero_copy_only=False) for c in ("outside", "node", "component"))
        sets = group["shingles"].combine_chunks()
        lens = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(lens)), lens)
        # Only shingles of both sides count; each row's are the bits of its words.
        vocabulary = code.max() + 1 if len(code) else 0
        both = (np.bincount(code[outside[row]], minlength=vocabulary) > 0) & (np.bincount(code[~outside[row]], minlength=vocabulary) > 0)
        place = np.cumsum(both) - 1
        use = both[code]
        width = int(both.sum()) // 64 + 1
        bits = np.zeros((len(lens), width), np.uint64)
        np.bitwise_or.at(bits, (row[use], place[code[use]] // 64), np.uint64(1) << (place[code[use]] % 64).astype(np.uint64))
        root = {int(c): int(c) for c in component}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        others = np.flatnonzero(~outside)
        known, n, size = bits[others], lens[others], {}
        found = []
        for i in np.flatnonzero(outside):
            shared = np.zeros(len(others), np.int64)
            for k in np.flatnonzero(bits[i]):
                shared += np.bitwise_count(known[:, k] & bits[i, k])
            for j in others[100 * shared >= percent * (lens[i] + n - shared)]:
                p, q = find(int(component[i])), find(int(component[j]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run
