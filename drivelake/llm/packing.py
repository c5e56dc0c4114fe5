"""Packing of documents into fixed windows: lexical neighbours of a seed, found by BM25 in its shard of related documents, fill its window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, encoder, mix, stored, work_folder

K1, B = 1.2, 0.75
#: Neighbours that one look-up returns; the same seed is looked up again when they are used up.
NEIGHBOURS = 16
#: Terms that one document in so many has are kept as rows over all documents: adding rows is quicker than following postings.
DENSE = 8

#: Dimensions of the vectors by which related documents are placed together.
DIMS = 128
#: Documents from which the tree of shards is cut, at most; every document then goes down the tree.
SAMPLE = 1 << 16
#: Terms of fewer than one in so many documents share the largest weight in those vectors.
RARE = 100
#: Ids of more than one document in so many are common: they don't tell copies from others.
RARER = 64
#: Tokens that are looked at together.
TOKENS = 1 << 20
#: Token ids fit 16 bits; they are the terms, so statistics of the whole table have a fixed size.
VOCABULARY = 1 << 16
#: A sequence's number is its shard's, then this many bits for its place in the shard.
SEQUENCE_BITS = 18

PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, id and count of every different id of each document."""
    if len(docs) == 1:  # perhaps a very long one
        n = np.bincount(docs[0], minlength=1)
        ids = np.flatnonzero(n)
        return np.zeros(len(ids), np.int64), ids, n[ids]
    key = np.repeat(np.arange(len(docs), dtype=np.int64) << 16, [len(x) for x in docs])
    key |= np.concatenate(docs)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> 16, key[first] & 0xFFFF, np.diff(np.append(first, len(key)))


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For successive documents of about TOKENS ids: their number, then document, id and count as _counted."""
    held, size = [], 0
    for i, raw in enumerate(column, 1):
        held.append(np.frombuffer(raw.as_py(), np.uint16))
        size += len(held[-1])
        if size >= TOKENS or i == len(column):
            yield len(held), *_counted(held)
            held, size = [], 0


def document_frequencies(ids: DataFrame) -> np.ndarray:
    """How many documents hold each id, over all rows. The vocabulary bounds it: 65,536 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            for _, _, term, _ in _chunks(b.column(0)):
                n += np.bincount(term, minlength=VOCABULARY)
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n[term])], ["term", "df"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in ids.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


#: A hash of each term.
_SPREAD = mix(np.arange(VOCABULARY, dtype=np.uint64) + np.uint64(1))


def _vectors(n: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A unit vector for each document: its terms by their weight, each with a sign in one dimension."""
    spread = _SPREAD[term]
    signed = np.where(spread >> np.uint64(63), weight[term], -weight[term])
    out = np.bincount(owner * DIMS + (spread % np.uint64(DIMS)).astype(np.int64), signed, n * DIMS).reshape(n, DIMS)
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)).astype("<f4")


def cut_tree(vectors: np.ndarray, sizes: np.ndarray, leaf_size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, thresholds and children of a tree that cuts the vectors along their main direction, where the middle is thinnest, until no leaf is larger than leaf_size.

    A child below zero is leaf -1 - child; leaves are numbered from left to right, so that near ones are related.
    """
    ways, limits, children, leaves = [], [], [], [0]

    def grow(rows: np.ndarray) -> int:
        x = vectors[rows] - vectors[rows].mean(0)
        way = x[np.argmax((x**2).sum(1))]
        for _ in range(12):
            way = x.T @ (x @ way)
            way = way / max(np.sqrt(way @ way), 1e-12)
        along = vectors[rows] @ way
        order = np.argsort(along, kind="stable")
        steps = along[order]
        span = max(1, len(rows) // 20)
        low, high = len(rows) * 7 // 20, max(len(rows) * 13 // 20, len(rows) * 7 // 20 + 1)
        gaps = steps[np.minimum(np.arange(low, high) + span, len(rows) - 1)] - steps[np.arange(low, high)]
        at = low + int(np.argmax(gaps)) + (span + 1) // 2
        at = min(max(at, 1), len(rows) - 1)
        limit = (steps[at - 1] + steps[at]) / 2
        left = along <= limit
        if sizes[rows].sum() <= leaf_size or len(rows) < 8 or left.all() or not left.any():
            leaves[0] += 1
            return -leaves[0]
        node = len(ways)
        ways.append(way), limits.append(limit), children.append([0, 0])
        children[node] = [grow(rows[left]), grow(rows[~left])]
        return node

    if len(vectors) > 1:
        grow(np.arange(len(vectors)))
    return np.array(ways).reshape(-1, vectors.shape[1]), np.array(limits), np.array(children, np.int64).reshape(-1, 2)


def leaf_of(vectors: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf that each vector comes down to."""
    ways, limits, children = tree
    at = np.zeros(len(vectors), np.int64) if len(ways) else np.full(len(vectors), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        at[inner] = children[node, ((vectors[inner] * ways[node]).sum(1) > limits[node]).astype(int)]
    return -1 - at


def _placed(ids: DataFrame, df: np.ndarray, n: int, total: int, shard_bytes: int, work: str) -> DataFrame:
    """shard, k, ids: related documents in one shard of about shard_bytes.

    A tree cut from the vectors of a sample leads every document to a leaf; small neighbouring leaves share a shard. A leaf over
    shard_bytes is split by a MinHash sample of its rarer ids (those of one in RARER documents at most, if it has any), which keeps near copies together
    and, unlike ids that nearly all texts hold, spreads the rest; what is then still over twice of it by a hash of the row.
    """
    kind, spark = ids.schema["k"].dataType.simpleString(), ids.sparkSession
    if total <= shard_bytes:
        return ids.select(F.lit(0).cast("long").alias("shard"), "k", "ids")
    weight = np.log(np.clip(n / np.maximum(df, 1), 1, RARE))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for m, owner, term, _ in _chunks(b.column(0)):
                found = [x.tobytes() for x in _vectors(m, owner, term, weight)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1).slice(at, m), b.column(2).slice(at, m)], ["v", "size", "h"])
                at += m

    share = min(1.0, min(SAMPLE, 64 * -(-total // shard_bytes)) / n)
    sample = ids.filter(F.shiftrightunsigned("h", 11) / float(1 << 53) <= share).select("ids", "size", "h").mapInArrow(vectors, "v binary, size long, h long").collect()
    sample.sort(key=lambda r: (r.h, r.v))
    sizes = np.array([r.size for r in sample], float)
    tree = cut_tree(np.frombuffer(b"".join(r.v for r in sample), "<f4").reshape(-1, DIMS).astype(float), sizes * (total / max(sizes.sum(), 1)), shard_bytes)

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = mix(np.arange(VOCABULARY, dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
        order[df * RARER > n] |= np.uint64(1 << 63)
        for b in batches:
            leaf, least = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for m, owner, term, _ in _chunks(b.column(1)):
                leaf.append(leaf_of(_vectors(m, owner, term, weight).astype(float), tree))
                low = np.zeros(m, np.uint64)
                if len(owner):
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    low[owner[first]] = np.minimum.reduceat(order[term], first)
                least.append(mix(low).view(np.int64))
            columns = [*b.columns, pa.array(np.concatenate(leaf)), pa.array(np.concatenate(least))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "ids", "size", "h", "leaf", "least"])

    # Twice, once for the sizes and once for the rows: much less to write than the ids once more.
    found = ids.select("k", "ids", "size", "h").mapInArrow(place_rows, f"k {kind}, ids binary, size long, h long, leaf long, least long")
    sizes = stored(found.select("size", "leaf", "least"), work, "sizes")
    plan, shard, room = [], -1, 0
    for leaf, size in sorted(map(tuple, sizes.groupBy("leaf").agg(F.sum("size")).collect())):  # not more than SAMPLE leaves
        if size > room:
            shard, room = shard + 1, shard_bytes
        plan.append((leaf, shard, parts := max(1, -(-size // shard_bytes))))
        shard, room = shard + parts - 1, room - size if parts == 1 else 0
    plan = F.broadcast(spark.createDataFrame(plan, "leaf long, first long, parts long"))
    at = F.col("first") + F.pmod("least", "parts")
    large = sizes.join(plan, "leaf").groupBy(at.alias("shard")).agg(F.sum("size").alias("all")).filter(F.col("all") > 2 * shard_bytes)
    large = stored(large.select("shard", F.ceil(F.col("all") / shard_bytes).alias("pieces")), work, "large")  # small ones are sent to all, as their size is known then
    dropped(spark, work, "sizes")
    found = found.join(plan, "leaf").withColumn("shard", at)
    piece = F.coalesce(F.pmod("h", "pieces"), F.lit(0))
    return found.join(large, "shard", "left").select((F.col("shard") + piece * (shard + 1)).alias("shard"), "k", "ids")


class Bm25:
    """An inverted index over the documents of one shard; its terms are token ids. Terms of one document only are left out, as they find nothing.

    pairs: document, id and count as _counted. everywhere: documents, mean length and document frequencies of the whole table; else those of the shard hold.
    """

    def __init__(self, sizes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], everywhere: tuple[int, float, np.ndarray] | None = None):
        n = self.n = len(sizes)
        doc, term, tf = pairs
        df = np.bincount(term, minlength=VOCABULARY)
        total, mean, counts = everywhere or (n, sizes.mean() if n else 1.0, df)
        norm = K1 * (1 - B + B * sizes / max(mean, 1e-9))
        idf = np.log1p((total - counts + 0.5) / (counts + 0.5))
        keep = df[term] > 1
        doc, term, tf = doc[keep], term[keep], tf[keep]
        self.term, self.own = term, np.searchsorted(doc, np.arange(n + 1))  # by document
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, by_term = doc[order], weight[order], term[order]
        self.ends = np.searchsorted(by_term, np.arange(VOCABULARY + 1))
        common = np.flatnonzero(np.diff(self.ends) * DENSE >= max(n, 1))
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), np.float32)  # half the memory to read; equal documents keep equal scores
        at = self.row[by_term]
        self.dense[at[at >= 0], self.doc[at >= 0]] = self.weight[at >= 0]
        self.live = np.arange(n)  # the documents that scores are made for
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0))

    def shrink(self, used: np.ndarray) -> None:
        """Leave used documents out of the postings as soon as they are half of them: what is left has the same scores."""
        keep = ~used[self.live]
        if 2 * int(keep.sum()) > len(keep):
            return
        posted = keep[self.doc]
        self.doc, self.weight = (np.cumsum(keep) - 1)[self.doc[posted]], self.weight[posted]
        self.ends = np.concatenate([[0], np.cumsum(posted)])[self.ends]
        self.dense, self.live, self.last = np.ascontiguousarray(self.dense[:, keep]), self.live[keep], (-1, np.empty(0))

    def scores(self, i: int) -> np.ndarray:
        """The score of every live document for all terms of document i that any other one has."""
        if self.last[0] != i:
            terms = self.term[self.own[i] : self.own[i + 1]]
            rows = self.row[terms]
            low, high = self.ends[terms[rows < 0]], self.ends[terms[rows < 0] + 1]
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.last = i, np.bincount(self.doc[at], self.weight[at], len(self.live)) + self.dense[rows[rows >= 0]].sum(0)
        return self.last[1]

    def neighbours(self, i: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with document i, by score, the smaller number first at ties."""
        self.shrink(used)
        left = np.flatnonzero(~used[self.live])
        score, left = self.scores(i)[left], self.live[left]
        if len(left) > 4 * NEIGHBOURS:  # all that tie with the last one, too
            least = np.partition(score, len(left) - NEIGHBOURS)[len(left) - NEIGHBOURS]
            left, score = left[score >= least], score[score >= least]
        best = np.lexsort((left, -score))[:NEIGHBOURS]
        return left[best[score[best] > 0]]


def order_by_retrieval(lengths: np.ndarray, index: Bm25, window: int) -> Iterator[int]:
    """Every document once. The document that begins or reaches into a window is its seed, and unused neighbours of the seed follow until the window is full; without any left, the next unused one follows."""
    used = np.zeros(len(lengths), bool)
    fill, seed, waiting, following = 0, -1, [], 0
    for _ in range(len(lengths)):
        while waiting and used[waiting[0]]:
            waiting.pop(0)
        if not waiting and seed >= 0:
            waiting = index.neighbours(seed, used).tolist()
        if waiting:
            doc = waiting.pop(0)
        else:
            while used[following]:
                following += 1
            doc = following
        used[doc] = True
        yield doc
        fill += int(lengths[doc])
        if fill >= window or seed < 0:  # this document reaches into the next window, or begins this one
            fill %= window
            seed, waiting = doc, []


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_bytes: int = 8 << 20) -> DataFrame:
    """Pack all documents into sequences of `window` ids at most; every sequence of a shard but its last is full.

    A document's ids are those of the byte-level tokenizer without added special tokens, then end_id; null texts are empty.
    Returns for each piece: key, start (its document's ids before it), length, doc_tokens (all ids of its document), sequence_id, offset
    (in the sequence), ids (little-endian unsigned 32-bit).

    Related documents go to one shard of about shard_bytes of text, so memory and index are bounded; a shard's index is
    searched for neighbours of its own documents, by all ids of the seed, with document frequencies and mean length of the
    whole table. Documents are cut only where a window ends. Rows with equal or null keys are documents of their own. An
    empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kind, work = docs.schema[key].dataType.simpleString(), work_folder(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), body.alias("t"), (F.octet_length(body) + 64).cast("long").alias("size"), F.xxhash64(F.col(key), body).alias("h"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, "byte")
        for b in batches:
            ids = pa.array([x.tobytes() for x in coder.encode(b.column(1).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, b.column(2), b.column(3)], ["k", "ids", "size", "h"])

    ids = stored(rows.mapInArrow(encode, f"k {kind}, ids binary, size long, h long"), work, "ids")
    n_docs, total, tokens = ids.agg(F.count("*"), F.sum("size"), F.sum(F.octet_length("ids") / 2)).first()
    df = document_frequencies(ids)
    placed = _placed(ids, df, n_docs, total or 0, shard_bytes, work)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("ids", "ascending")])
        shard = table.column("shard")[0].as_py()
        raw = table.column("ids").combine_chunks()
        sizes, pairs, before = np.array([len(x.as_py()) // 2 for x in raw]), [], 0
        for m, owner, term, tf in _chunks(raw):
            pairs.append((owner + before, term, tf))
            before += m
        index = Bm25(sizes, tuple(map(np.concatenate, zip(*pairs))), (n_docs, tokens / n_docs, df))
        at: list[tuple] = []
        parts, rows, filled = [], [], 0
        for d in order_by_retrieval(sizes + 1, index, window):
            ids, n, start = np.append(np.frombuffer(raw[d].as_py(), np.uint16), np.uint16(end_id)).astype("<u4").tobytes(), int(sizes[d]) + 1, 0
            while start < n:
                length = min(n - start, window - filled % window)
                at.append((start, length, n, shard << SEQUENCE_BITS | filled // window, filled % window))
                parts.append(ids[4 * start : 4 * (start + length)])
                rows.append(d)
                start, filled = start + length, filled + length
        columns = np.array(at, np.int64).reshape(-1, 5)
        names = ["k", *(x.split()[0] for x in PIECES.split(", "))]
        return pa.Table.from_arrays([table.column("k").take(pa.array(rows, pa.int64())), *(pa.array(columns[:, i]) for i in range(5)), pa.array(parts, pa.binary())], names)

    packed = placed.groupBy("shard").applyInArrow(run, f"k {kind}, {PIECES}")
    return packed.withColumnRenamed("k", key)
