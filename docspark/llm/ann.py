"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release, small_batches, table

K, EVERY = 20, 20
SHARD_ROWS, QUERY_BLOCK, DEALT = 20_000, 2048, 20_000
#: Queries that meet a shard's graph in one task; the graph is sent once for so many.
STRIPE = 1 << 16
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX, STEP, SEED_NODES = 32, 64, 160, 1.2, 4, 256


class Graph:
    """A directed graph over rows of x. Inner products become distances by one more coordinate, which makes all
    rows equally long; a query has 0 there, so its nearest row is the one with the largest inner product."""

    def __init__(self, x: np.ndarray, links: np.ndarray | None = None, start: int = 0):
        self.raw = x
        square = np.einsum("nd,nd->n", x, x, dtype=np.float64)
        lift = np.sqrt(np.maximum(square.max() - square, 0.0))
        self.x = np.concatenate([x, lift[:, None]], axis=1).astype(np.float32)
        self.norm = np.einsum("nd,nd->n", self.x, self.x)
        self.links = links if links is not None else np.full((len(x), 2 * DEGREE), -1, np.int32)
        self.degree = (self.links >= 0).sum(axis=1)
        self.start = start

    def search(self, queries: np.ndarray, beam: int, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: row numbers (-1: none) and distances, nearest first."""
        n, nq = among or len(self.x), len(queries)
        beam = min(beam, n)
        seen = np.zeros((nq, len(self.x) + 1), bool)  # the last column stands for no row
        seen[:, -1] = True
        ids = np.full((nq, beam), -1, np.int64)
        dist = np.full((nq, beam), np.inf, np.float32)
        done = np.ones((nq, beam), bool)
        ids[:, 0], done[:, 0] = self.start, False
        dist[:, 0] = self.norm[self.start] - 2 * (queries @ self.x[self.start])
        seen[:, self.start] = True
        active = np.arange(nq)
        while len(active):
            waiting = np.where(done[active], np.inf, dist[active])
            pick = np.argpartition(waiting, min(STEP, beam) - 1, axis=1)[:, :STEP] if beam > STEP else np.argsort(waiting, axis=1)[:, :STEP]
            real = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            going = real.any(axis=1)
            active, pick, real = active[going], pick[going], real[going]
            if not len(active):
                break
            rows = active[:, None]
            chosen = np.where(real, ids[rows, pick], -1)
            done[rows, pick] = True
            near = np.where(chosen[:, :, None] >= 0, self.links[chosen], -1).reshape(len(active), -1).astype(np.int64)
            near[seen[rows, near]] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            width = int((near >= 0).sum(axis=1).max(initial=0))
            if not width:
                continue
            near = -np.sort(-near, axis=1)[:, :width]
            seen[rows, near] = True
            found = self.norm[near] - 2 * np.einsum("qd,qrd->qr", queries[active], self.x[near])
            found[near < 0] = np.inf
            all_dist = np.concatenate([dist[active], found], axis=1)
            keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            dist[active] = np.take_along_axis(all_dist, keep, axis=1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), keep, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], near < 0], axis=1), keep, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)

    def prune(self, node: int, candidates: np.ndarray) -> None:
        """Keep up to DEGREE diverse links: the nearest candidate, then none that a kept one is RELAX times nearer to."""
        candidates = candidates[(candidates >= 0) & (candidates != node)]
        part = self.x[candidates]
        own = np.maximum(self.norm[candidates] + self.norm[node] - 2 * (part @ self.x[node]), 0)
        order = np.argsort(own, kind="stable")
        candidates, part, own = candidates[order], part[order], own[order]
        norms = self.norm[candidates]
        between = np.maximum(norms[:, None] + norms[None, :] - 2 * (part @ part.T), 0) * RELAX**2
        alive, kept = np.ones(len(candidates), bool), []
        for i in range(len(candidates)):
            if alive[i]:
                kept.append(i)
                if len(kept) == DEGREE:
                    break
                alive &= between[i] > own
        self.links[node] = -1
        self.links[node, : len(kept)] = candidates[kept]
        self.degree[node] = len(kept)

    def link_back(self, node: int) -> None:
        for other in self.links[node, : self.degree[node]].tolist():
            n = self.degree[other]
            if (self.links[other, :n] == node).any():
                continue
            if n < self.links.shape[1]:
                self.links[other, n] = node
                self.degree[other] = n + 1
            else:
                self.prune(other, np.append(self.links[other, :n], node))

    def build(self) -> Graph:
        """Rows are inserted in order: a few by all distances, then in growing batches by search of the graph so far."""
        n = len(self.x)
        self.start = int(np.argmin(self.norm - 2 * (self.x @ self.x.mean(axis=0))))
        order = np.concatenate([[self.start], np.delete(np.arange(n), self.start)])
        first = order[:SEED_NODES]
        distance = self.norm[first][None, :] - 2 * (self.x[first] @ self.x[first].T)
        near = np.argsort(distance, axis=1)[:, : BUILD_BEAM + 1]
        for i, node in enumerate(first.tolist()):
            self.prune(node, first[near[i]])
        for node in first.tolist():
            self.link_back(node)
        at = len(first)
        while at < n:
            batch = order[at : at + min(max(64, at // 4), 512)]
            ids, _ = self.search(self.x[batch], BUILD_BEAM)
            for node, found in zip(batch.tolist(), ids, strict=True):
                self.prune(node, found)
            for node in batch.tolist():
                self.link_back(node)
            at += len(batch)
        return self


def usable(vectors: pa.Array) -> list[np.ndarray | None]:
    """Vectors as arrays; None for null, empty or zero vectors and those with null or non-finite components."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = []
    kind = vectors.type.value_type.to_pandas_dtype()
    for v in vectors:
        a = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            a = v.values.to_numpy(zero_copy_only=False).astype(kind)
            if not np.isfinite(a).all() or not a.any():
                a = None
        out.append(a)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, embedding) its k nearest of all other vectors found.

    Score is the inner product in double precision, summed in the order of the components, ties go to the smaller vec_id. Rows without vec_id and vectors
    that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths are
    not compared. Repeated rows count once; a vec_id with several vectors has the best score of any. Empty tables give
    no rows. Equal vectors are one node, which keeps the k + 1 smallest ids: no query can need more of them.

    Vectors are dealt into shards by a hash of their bytes, so that copies meet, and a graph is built for each.
    Blocks of queries meet each shard once, about STRIPE queries in a task, to which the graph is sent once.
    """
    count = small_batches(vectors).count()
    shards = max(1, math.ceil(count / SHARD_ROWS))
    stripes = max(1, math.ceil(queries.count() / STRIPE))
    double = vectors.schema["embedding"].dataType.elementType.typeName() == "double"
    kind = np.float64 if double else np.float32

    def deal(batches):
        kept: dict[bytes, list[int]] = {}

        def dealt():
            rows = [(len(v) // np.dtype(kind).itemsize, xxhash.xxh3_64_intdigest(v) % shards, i, v) for v, ids in kept.items() for i in least(ids)]
            kept.clear()
            dim, shard, ids, data = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.record_batch({"dim": pa.array(dim, pa.int32()), "shard": pa.array(shard, pa.int32()), "vec_id": pa.array(ids, pa.int64()), "vec": pa.array(data, pa.binary())})

        def least(ids):
            return sorted(set(ids))[: k + 1]

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), usable(b.column(1)), strict=True):
                if v is not None and i is not None:
                    ids = kept.setdefault((v + 0).astype(kind).tobytes(), [])
                    ids.append(i)
                    if len(ids) > 64 * (k + 1):
                        ids[:] = least(ids)
            if len(kept) > DEALT:
                yield dealt()
        yield dealt()
        release()

    graph_schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vecs", pa.binary()), ("links", pa.binary()), ("start", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64())))])

    def build(part: pa.Table) -> pa.Table:
        nodes: dict[bytes, set[int]] = {}
        for i, v in zip(part["vec_id"].to_pylist(), part["vec"].to_pylist(), strict=True):
            nodes.setdefault(v, set()).add(i)
        order = sorted(nodes, key=xxhash.xxh3_64_intdigest)
        graph = Graph(np.frombuffer(b"".join(order), kind).reshape(len(order), -1)).build()
        ids = [sorted(nodes[v])[: k + 1] for v in order]
        row = {"dim": part["dim"][0].as_py(), "shard": part["shard"][0].as_py(), "vecs": b"".join(order), "links": graph.links.tobytes(), "start": graph.start, "ids": ids}
        return pa.Table.from_pylist([row], schema=graph_schema)

    def block(batches):
        from pyspark import TaskContext

        made = TaskContext.get().partitionId()
        for b in batches:
            found: dict[int, list] = {}
            for i, v in zip(b.column(0).to_pylist(), usable(b.column(1)), strict=True):
                if v is not None and i is not None:
                    found.setdefault(len(v), []).append((i, v.astype(kind)))
            for dim, rows in found.items():
                for at in range(0, len(rows), QUERY_BLOCK):
                    part = rows[at : at + QUERY_BLOCK]
                    made += 1
                    yield pa.record_batch({"dim": pa.array([dim], pa.int32()), "stripe": pa.array([made % stripes], pa.int32()), "query_ids": pa.array([[i for i, _ in part]], pa.list_(pa.int64())), "queries": pa.array([b"".join(v.tobytes() for _, v in part)], pa.binary())})

    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(shard: pa.Table, blocks: pa.Table) -> pa.Table:
        if not (shard.num_rows and blocks.num_rows):
            return found_schema.empty_table()
        (s,) = shard.to_pylist()
        x = np.frombuffer(s["vecs"], kind).reshape(-1, s["dim"])
        graph, wide = Graph(x, np.frombuffer(s["links"], np.int32).reshape(len(x), -1), s["start"]), x.astype(np.float64)
        out = []
        for query_ids, data in zip(blocks["query_ids"].to_pylist(), blocks["queries"].to_pylist(), strict=True):
            q = np.frombuffer(data, kind).reshape(-1, s["dim"])
            columns = ([], [], [])
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                lifted = np.concatenate([some, np.zeros((len(some), 1), some.dtype)], axis=1).astype(np.float32)
                ids, _ = graph.search(lifted, max(SEARCH_BEAM, 2 * k))
                for query, vector, near in zip(query_ids[at : at + 256], some.astype(np.float64), ids, strict=True):
                    near = near[near >= 0][: 2 * k]
                    score = np.cumsum(wide[near] * vector, axis=1)[:, -1]  # added up in order
                    best = sorted((-v, i) for v, n in zip(score.tolist(), near.tolist(), strict=True) for i in s["ids"][n] if i != query)[:k]
                    columns[0].extend([query] * len(best))
                    columns[1].extend(i for _, i in best)
                    columns[2].extend(-v for v, _ in best)
            out.append(pa.table(list(columns), schema=found_schema))
        return pa.concat_tables(out)

    parts = max(shards, 1)
    dealt = vectors.select("vec_id", "embedding").mapInArrow(deal, "dim int, shard int, vec_id long, vec binary")
    graphs = cut(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, vecs binary, links binary, start int, ids array<array<long>>"))
    blocks = queries.select("vec_id", "embedding").mapInArrow(block, "dim int, stripe int, query_ids array<long>, queries binary")
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    every = graphs.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    keys = ("dim", "shard", "stripe")
    met = every.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
