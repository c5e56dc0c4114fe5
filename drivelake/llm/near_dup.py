"""Near-duplicate documents: banded MinHash candidates, odd sketches to sift them, full shingle sets to confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix, stored, windows, word_hashes, work_folder

#: MinHash samples of a set, and bits of the parity bitmap that they are folded into.
SAMPLES, BITS = 512, 4096
#: Samples in a band.
ROWS = 4
#: A linked pair shares no band with at most this probability.
MISS = 1e-6
#: A pair is sifted out if its sketches differ in so many standard deviations more bits than at the threshold: 3 of
#: 100,000 pairs that lie at it exactly, far fewer above it.
MARGIN = 4.0
#: Members of a bucket that are compared in one step; larger buckets are compared part by part.
BLOCK = 1024


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words, of the whole sequence."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"), lower=True)
    return np.unique(windows(h, min(words, len(h)))) if len(h) else h


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = (mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return seeds[:SAMPLES] | np.uint32(1), seeds[SAMPLES:]


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation of 32-bit numbers over a set that isn't empty."""
    times, plus = _permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, ((x[at : at + 256] ^ plus) * times).min(0), out=out)
    return out.astype(np.uint64)


def odd_sketch(mins: np.ndarray) -> bytes:
    """Each sample flips one bit of the bitmap."""
    at = mix(mins + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1).tobytes()


def most_odd_bits(threshold: float) -> int:
    """The largest XOR count that leaves a pair in: MARGIN deviations above that of pairs at the threshold."""
    flips = 2 * SAMPLES * (1 - threshold)
    mean = BITS / 2 * (1 - math.exp(-2 * flips / BITS))
    # The samples of a pair differ by a binomial count; flips that meet in one bit add a little.
    spread = math.sqrt(4 * SAMPLES * threshold * (1 - threshold) + 2 * flips * flips / BITS)
    return int(mean + MARGIN * spread)


def bands_for(threshold: float) -> int:
    n = math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))
    if n * ROWS > SAMPLES:
        raise ValueError("the threshold is too low for the number of samples")
    return n


def _signatures(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """k, n, s1, s2 (a hash of the set), sketch, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for b in batches:
            n, s1, s2, sketch, keys = [], [], [], [], []
            for text in b.column(1).to_pylist():
                x = shingle_set(text, words)
                n.append(len(x))
                s1.append(np.bitwise_xor.reduce(x).view(np.int64) if len(x) else 0)
                s2.append(np.add.reduce(mix(x)).view(np.int64) if len(x) else 0)
                if len(x):
                    m = samples(x)
                    sketch.append(odd_sketch(m))
                    keys.append(mix(windows_of_rows(m[: bands * ROWS].reshape(bands, ROWS)) + place).view(np.int64))
                else:
                    sketch.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["k", "n", "s1", "s2", "sketch", "bands"])

    return docs.mapInArrow(run, f"k {docs.schema['k'].dataType.simpleString()}, n long, s1 long, s2 long, sketch binary, bands array<long>")


def windows_of_rows(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for i in range(x.shape[1]):
        out = mix(out ^ x[:, i])
    return out


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """k, s (the shingle set as bytes) of the documents named by ids (k, s1, s2)."""
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets = [], []
            for k, text, s1 in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = shingle_set(text, words)
                if np.bitwise_xor.reduce(x).view(np.int64) == s1:  # else another text of this key
                    keys.append(k.as_py())
                    sets.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(sets, pa.binary())], ["k", "s"])

    return docs.join(ids, "k").select("k", "t", "s1").mapInArrow(run, f"k {kind}, s binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame, work: str, name: str) -> DataFrame:
    """k, component (the smallest node reachable) of every node on an edge, by large and small stars until nothing changes.

    Each round is a few joins and aggregates whose result is written; nothing but two numbers reaches the driver.
    """
    now, before, i = stored(edges.select("a", "b").distinct(), work, f"{name}-0"), None, 0
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")))).first()
        if mark == before:
            return now.select(F.greatest("a", "b").alias("k"), F.least("a", "b").alias("component")).union(now.select(F.least("a", "b"), F.least("a", "b")).distinct())
        before, i = mark, i + 1
        sym = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        now = stored(small.filter(F.col("a") != F.col("b")).distinct(), work, f"{name}-{i}")


def _relabelled(labels: DataFrame, edges: DataFrame, work: str, name: str) -> DataFrame:
    """Labels (k, component) after more edges: only the components that these join are walked through again."""
    ends = edges.select(F.col("a").alias("k")).union(edges.select("b")).distinct()
    every = labels.select("k", "component").union(ends.join(labels, "k", "left_anti").select("k", F.col("k").alias("component")))
    of = lambda x: every.select(F.col("k").alias(x), F.col("component").alias(f"_{x}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b")
    joined = components(between, work, name).select(F.col("k").alias("component"), F.col("component").alias("now"))
    return every.join(joined, "component", "left").select("k", F.coalesce("now", "component").alias("component"))


def _sift(pairs: DataFrame, sketches: DataFrame, most: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches are close and whose sets are of sizes that can fit."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most))

    a, b = (sketches.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _across(members: DataFrame, most: int, percent: int, only_best: bool) -> DataFrame:
    """Pairs (a, b) of members of one bucket in other components whose sketches are close and whose sizes can fit.

    members: band, k, n, label, sketch, bands. A pair that shares several buckets counts in the first of them. Large buckets are cut into parts; each pair of parts is one step, so no step
    holds more than 2 * BLOCK or so members. only_best: for each member the closest one only.
    """
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    cut = members.join(sizes, "band").withColumn("part", part).select("*", other)
    step = cut.select("band", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y"), "part", "k", "n", "label", "sketch", "bands")
    kind = members.schema["k"].dataType.simpleString()

    def compare(rows: list[dict]) -> Iterator[tuple]:
        keys, labels = [r["k"] for r in rows], [r["label"] for r in rows]
        code = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        label = np.array([code[x] for x in labels])
        if len(code) < 2:
            return
        parts = np.array([r["part"] for r in rows])
        size = np.array([r["n"] for r in rows])
        every = np.array([r["bands"] for r in rows], np.int64)
        shared = every == rows[0]["band"]  # the place of this bucket's band
        bits = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint64).reshape(len(rows), -1)
        one_part = rows[0]["x"] == rows[0]["y"]
        for i in range(len(rows)):
            fit = (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if not one_part:
                fit &= parts != parts[i]
            if not fit.any():
                continue
            odd = np.bitwise_count(bits[i] ^ bits).sum(1, dtype=np.int64)
            fit &= odd <= most
            near = np.flatnonzero(fit)
            fit[near] = shared[i, (every[near] == every[i]).argmax(1)]
            if only_best and fit.any():
                j = int(np.where(fit, odd, 1 << 30).argmin())
                yield tuple(sorted((keys[i], keys[j])))
            elif not only_best:
                yield from (tuple(sorted((keys[i], keys[j]))) for j in np.flatnonzero(fit[:i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at = None

        def out() -> pa.RecordBatch:
            found = list(dict.fromkeys(compare(held)))
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], key_type) for i in (0, 1)], ["a", "b"])

        for b in batches:
            key_type = b.schema.field("k").type
            for r in b.to_pylist():
                here = (r["band"], r["x"], r["y"])
                if here != at and held:
                    yield out()
                    held = []
                at = here
                held.append(r)
        if held:
            yield out()

    return step.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets have 100 * intersection >= percent * union, directly or over others.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set has the distinct shingles of so many
    words, of fewer words the whole sequence as one. Returns for each row of docs: key, n_shingles, component_id (the
    smallest key reachable), kept (key = component_id). Documents without words (also null) link with nothing. Rows
    with a null key link with nothing, have a null component_id and are kept. Rows of one key count as one document with the links of
    all its texts. An empty table gives an empty result.

    Equal sets meet first, by a hash of 128 bits, and one of each goes on. Buckets are bands of MinHash samples; a
    linked pair meets in none with a probability of MISS at most. Odd sketches sift candidates with a margin, and full sets
    confirm every link. To stay linear in groups of thousands, each member is first tried against its bucket's first
    member; what is linked then is one component, and only pairs across components are compared further: first each
    member's closest partner, then all pairs that are left. Nothing is capped.
    """
    spark = docs.sparkSession
    work = work_folder(spark)
    threshold = percent / 100
    most, bands = most_odd_bits(threshold), bands_for(threshold)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    signed = stored(_signatures(rows, words, bands), work, "signatures")
    usable = signed.filter("n > 0 AND k IS NOT NULL")
    firsts = usable.groupBy("s1", "s2").agg(F.min(F.struct("k", "n", "sketch", "bands")).alias("f"))
    firsts = stored(firsts.select("s1", "s2", "f.*"), work, "firsts")

    banded = firsts.select("k", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("k").alias("pivot"), F.max("k").alias("last")).filter("pivot <> last").drop("last")
    members = stored(banded.join(met, "band"), work, "members")
    sketches = firsts.select("k", "n", "sketch", "bands")
    star = members.filter("k <> pivot").select(F.col("pivot").alias("a"), F.col("k").alias("b")).distinct()
    star = stored(_sift(star, sketches, most, percent), work, "star")

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
        return stored(_sets(rows, firsts.select("k", "s1").join(ids, "k"), words), work, name)

    edges = stored(_confirmed(star, sets_of(star, "star-sets"), percent), work, "edges-0")
    tried, labels = star, components(edges, work, "stars")
    for step, only_best in enumerate((True, False), 1):
        labelled = members.select("band", "k").join(labels, "k", "left").withColumn("label", F.coalesce("component", "k"))
        mixed = labelled.groupBy("band").agg(F.min("label").alias("p"), F.max("label").alias("q")).filter("p <> q").select("band")
        rest = labelled.join(mixed, "band", "left_semi").join(sketches, "k").select("band", "k", "n", "label", "sketch", "bands")
        pairs = stored(_across(rest, most, percent, only_best).join(tried, ["a", "b"], "left_anti"), work, f"across-{step}")
        if pairs.isEmpty():
            if only_best:
                continue
            break
        more = stored(_confirmed(pairs, sets_of(pairs, f"across-sets-{step}"), percent), work, f"edges-{step}")
        tried = tried.union(pairs)
        labels = stored(_relabelled(labels, more, work, f"components-{step}"), work, f"labels-{step}")
    dropped(spark, work, "members", "star", "star-sets", "across-sets-1", "across-sets-2")

    rep = firsts.select("s1", "s2", F.col("k").alias("rep"))
    linked = usable.join(rep, ["s1", "s2"], "left").join(labels.select(F.col("k").alias("rep"), "component"), "rep", "left")
    linked = linked.select("k", "n", F.coalesce("component", "rep", "k").alias("component_id"))
    # Documents without words, and those without a key, go round the join: they all would be one key of it.
    alone = signed.filter("n = 0 OR k IS NULL").select("k", "n", F.when(F.col("n") == 0, F.col("k")).alias("component_id"))
    out = linked.unionByName(alone).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
