"""Approximate nearest neighbours by inner product: one hierarchical small-world graph per shard, results merged."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, stored, work_folder

#: Links of a node on the upper levels, twice as many on the lowest.
LINKS = 16
#: Candidates for a node's links: its nearest, and its nearest in a sample, which gives links that reach far.
NEAREST, FAR = 64, 32
FAR_SAMPLE = 8


@dataclass
class Graph:
    """vectors: n x d. nodes[l] and links[l]: the node numbers on level l, and for each its links there (-1: none); flat arrays."""

    vectors: np.ndarray
    nodes: list[np.ndarray]
    links: list[np.ndarray]

    @classmethod
    def build(cls, vectors: np.ndarray, seeds: np.ndarray) -> Graph:
        """seeds: a 64-bit number for each vector that decides its level.

        Inner product isn't a distance, so one more component makes all vectors equally long; nearness between those
        orders as the inner product does for any query.
        """
        v = _single(vectors)
        norm = np.einsum("ij,ij->i", v, v, dtype=np.float64)
        even = np.concatenate([v, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None].astype(np.float32)], 1)
        even /= math.sqrt(max(norm.max(initial=0), 1e-300))
        level = (-np.log((mix(seeds.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-17) / math.log(LINKS)).astype(int)
        nodes, links = [], []
        for at in range(int(level.max(initial=0)) + 1):
            here = np.flatnonzero(level >= at)
            nodes.append(here.astype(np.int32))
            own = _linked(even[here], 2 * LINKS if at == 0 else LINKS, seeds[here]) if len(here) > 1 else np.full((len(here), 1), -1)
            links.append(np.where(own < 0, -1, here[own]).astype(np.int32))
        return cls(v, nodes, links)

    def search(self, queries: np.ndarray, width: int, keep: int) -> np.ndarray:
        """For each query the numbers of `keep` vectors found, best first (-1: none). Only the direction of a query counts."""
        queries = queries.astype(np.float64)
        queries = queries / np.maximum(np.abs(queries).max(1, initial=0), np.finfo(float).tiny)[:, None]
        queries = (queries / np.maximum(np.sqrt(np.einsum("qd,qd->q", queries, queries)), 1e-300)[:, None]).astype(np.float32)
        found: np.ndarray | None = None
        for at in range(len(self.nodes) - 1, -1, -1):
            place = np.full(len(self.vectors), -1, np.int32)
            place[self.nodes[at]] = np.arange(len(self.nodes[at]), dtype=np.int32)
            if found is None:
                start = self.nodes[at][: min(len(self.nodes[at]), 32)]
                found = np.broadcast_to(start, (len(queries), len(start)))
            found = self._beam(queries, found, place, self.links[at], width if at == 0 else max(16, width // 4))
        return found[:, :keep]

    def _beam(self, queries: np.ndarray, start: np.ndarray, place: np.ndarray, links: np.ndarray, width: int, step: int = 4) -> np.ndarray:
        """Best-first search of one level for all queries at once; each round opens `step` nodes of each beam."""
        n, rows = len(self.vectors), np.arange(len(queries))[:, None]
        ids = np.full((len(queries), width), -1, np.int32)
        score = np.full((len(queries), width), -np.inf, np.float32)
        opened = np.ones((len(queries), width), bool)
        seen = np.zeros((len(queries), n + 1), bool)
        seen[:, n] = True  # where -1 points
        new, q = start, np.arange(len(queries))
        while True:
            fresh = ~seen[q[:, None], new]
            seen[q[:, None], new] = True
            # A number met twice in one round counts once.
            order = np.sort(np.where(fresh, new, -1), axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            s = np.einsum("qkd,qd->qk", self.vectors[order], queries[q], optimize=False)
            s[order < 0] = -np.inf
            all_ids, all_s = np.concatenate([ids[q], order], 1), np.concatenate([score[q], s], 1)
            all_open = np.concatenate([opened[q], order < 0], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            ids[q], score[q], opened[q] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_s, all_open))
            waiting = np.where(opened, -np.inf, score)
            best = np.argpartition(-waiting, min(step, width) - 1, axis=1)[:, :step]
            live = np.take_along_axis(waiting, best, 1) > -np.inf
            q = np.flatnonzero(live.any(1))
            if not len(q):
                break
            best, live = best[q], live[q]
            nodes = np.where(live, np.take_along_axis(ids[q], best, 1), -1)
            opened[q[:, None], best] = True
            new = links[place[nodes]]
            new[~live] = -1
            new = new.reshape(len(q), -1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1)


def _single(vectors: np.ndarray) -> np.ndarray:
    """The vectors in single precision, by their largest component: as order of inner products they stay the same, and none of these overflows."""
    v = vectors.astype(np.float64)
    return np.ascontiguousarray(v / max(np.abs(v).max(initial=0), np.finfo(float).tiny), np.float32)


def _linked(v: np.ndarray, most: int, seeds: np.ndarray) -> np.ndarray:
    """Links of each vector among the others: chosen so that none is closer to a chosen one than to its node, both ways (-1: none).

    Of the nodes that link to a node NEAREST at most are looked at for its own links; all of them keep theirs to it.
    """
    n = len(v)
    far = np.flatnonzero(mix(seeds.astype(np.uint64) + np.uint64(77)) % np.uint64(FAR_SAMPLE) == 0)
    forward = np.full((n, most), -1, np.int64)
    for at in range(0, n, 512):
        block = slice(at, min(n, at + 512))
        near = v[block] @ v.T
        near[np.arange(near.shape[0]), np.arange(block.start, block.stop)] = -np.inf
        k = min(NEAREST, n - 1)
        found = [np.argpartition(-near, k - 1, axis=1)[:, :k]]
        if len(far) > 1:
            k = min(FAR, len(far))
            found.append(far[np.argpartition(-near[:, far], k - 1, axis=1)[:, :k]])
        forward[block] = _spread(v, np.arange(block.start, block.stop), np.concatenate(found, 1), most)
    # Back links, then the same choice among both.
    source = np.repeat(np.arange(n), most)
    target = forward.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    wide = min(int(nth.max(initial=0)) + 1, NEAREST)
    back = np.full((n, wide), -1, np.int64)
    fits = nth < wide
    back[target[fits], nth[fits]] = source[fits]
    out = np.full((n, most), -1, np.int64)
    for at in range(0, n, 512):
        block = np.arange(at, min(n, at + 512))
        out[block] = _spread(v, block, np.concatenate([forward[block], back[block]], 1), most)
    return out


def _spread(v: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (-1: none), nearest first, those nearer to the node than to any chosen before; then the nearest of the rest."""
    near = np.einsum("nkd,nd->nk", v[candidates], v[nodes])
    ordered = np.sort(candidates, axis=1)
    at = np.argsort(candidates, axis=1, kind="stable")
    twice = np.zeros(candidates.shape, bool)
    np.put_along_axis(twice, at[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
    near[twice | (candidates < 0) | (candidates == nodes[:, None])] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    near, candidates = np.take_along_axis(near, order, 1), np.take_along_axis(candidates, order, 1)
    vectors = v[candidates]
    between = vectors @ vectors.transpose(0, 2, 1)
    n, k = candidates.shape
    chosen, closest = np.zeros((n, k), bool), np.full((n, k), -np.inf, np.float32)
    for i in range(k):
        take = (near[:, i] > -np.inf) & (closest[:, i] < near[:, i]) & (chosen.sum(1) < most)
        chosen[:, i] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, :, i]), closest)
    rank = np.argsort(np.where(near > -np.inf, np.where(chosen, 0, 1), 2), axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(near, rank, 1) > -np.inf, np.take_along_axis(candidates, rank, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


INDEX_SCHEMA = "dim int, shard int, n int, vectors binary, ids binary, id_ends binary, level_sizes binary, nodes binary, links binary"


def _usable(rows: DataFrame) -> DataFrame:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def build_index(rows: DataFrame, path: str, keep_ids: int, shard_size: int = 8192) -> int:
    """Write the index of rows (id, v) to path; returns the number of shards.

    Equal vectors are one node with the keep_ids smallest of their ids: more can't be among the nearest. Vectors go to shards of about
    shard_size by a hash, apart by their length.
    """
    order = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("i", F.row_number().over(order)).filter(F.col("i") <= keep_ids)
    distinct = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = stored(distinct.select(F.size("v").alias("dim"), F.xxhash64("v").alias("h"), "v", "ids"), path, "distinct")
    shards = max(1, -(-distinct.count() // shard_size))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending")])
        n, dim = table.num_rows, table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)  # as given; the graph takes single precision
        ids = table.column("ids").combine_chunks()
        g = Graph.build(v, table.column("h").to_numpy())
        sizes = np.array([x.shape for x in g.links], np.int64)
        flat = lambda xs: np.concatenate([x.ravel() for x in xs]).astype("<i4").tobytes()
        values = [dim, table.column("shard")[0].as_py(), n, v.tobytes(), ids.flatten().to_numpy().astype("<i8").tobytes(), np.cumsum(np.diff(ids.offsets.to_numpy())).astype("<i8").tobytes(), sizes.tobytes(), flat(g.nodes), flat(g.links)]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(values, [pa.int32()] * 3 + [pa.binary()] * 6)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])

    cut = distinct.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    cut.groupBy("dim", "shard").applyInArrow(build, INDEX_SCHEMA).write.parquet(f"{path}/index")
    return shards


def _load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph, its original vectors, and the ids of each node."""
    n, dim = row["n"], row["dim"]
    sizes = np.frombuffer(row["level_sizes"], np.int64).reshape(-1, 2)
    nodes = np.split(np.frombuffer(row["nodes"], "<i4"), np.cumsum(sizes[:, 0])[:-1])
    links = [x.reshape(s) for x, s in zip(np.split(np.frombuffer(row["links"], "<i4"), np.cumsum(sizes.prod(1))[:-1]), sizes)]
    exact = np.frombuffer(row["vectors"], np.float32 if len(row["vectors"]) == 4 * n * dim else np.float64).reshape(n, dim)
    return Graph(_single(exact), nodes, links), exact, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["id_ends"], "<i8")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", width: int = 128, shard_size: int = 8192, block: int = 1024) -> DataFrame:
    """The k nearest rows found for each query, by the largest inner product in double precision; ties go to the smaller id.

    Returns query_id, rank int (from 1), vec_id, score. A query isn't its own neighbour (by id). Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows with a null id; vectors of another length are never near. Repeated rows count once. Fewer
    candidates than k give all of them. An empty table gives an empty result.

    Queries go through every shard in blocks: a task holds one shard and one block, whatever the input. Scores of what the graphs find
    are made from the original vectors, single or double precision; the graphs walk in single precision, scaled so that vectors of any finite size
    can be told apart unless others of their shard are more than 1e30 times as long. width is the beam of the search: wider finds more.
    """
    work = work_folder(rows.sparkSession)
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = _usable(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")))
    queries = _usable(queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))).distinct()
    shards = build_index(rows, work, k + 1, shard_size)
    index = rows.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{work}/index")
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    indexed = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asked: pa.Table, indexed: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked.num_rows and indexed.num_rows:
            graph, vectors, ids, ends = _load(indexed.to_pylist()[0])
            own = asked.column("id").to_pylist()
            q = asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            found = graph.search(q, max(width, 2 * k), k + 12)
            exact = np.einsum("qkd,qd->qk", vectors[found].astype(np.float64), q.astype(np.float64))
            for i, (row, scores) in enumerate(zip(found, exact)):
                near = [(-s, v) for at, s in zip(row.tolist(), scores.tolist()) if at >= 0 for v in ids[ends[at - 1] if at else 0 : ends[at]].tolist() if v != own[i]]
                near = sorted(near)[:k]
                out[0] += [own[i]] * len(near)
                out[1] += [v for _, v in near]
                out[2] += [-s for s, _ in near]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    by = ["dim", "shard", "block"]
    near = asked.groupBy(*by).cogroup(indexed.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
