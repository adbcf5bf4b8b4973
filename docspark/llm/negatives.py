"""Hard negatives by exact integer products, worked out bit-plane by bit-plane within score intervals."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release, small_batches, table

EVERY, POSITIVES, NEGATIVES, SCALE, LOW, HIGH = 100, 5, 10, 256, 30, 90
#: Rows of a shard, anchors of a part, rows and anchors that are worked on together, rows held by a task before they are dealt.
LEAST_SHARD, MOST_SHARD, SHARDS, PART, CHUNK, BLOCK, DEALT = 4096, 1 << 18, 64, 1 << 16, 8192, 256, 20_000
#: Components are at most this large, so that they fit four bytes and their products a long.
MOST = 1 << 26
#: Share of pairs below which they are gathered one by one.
SPARSE = 0.05

PACK = "dim int, shard int, ids binary, labels binary, rows binary, wide boolean"
PART_ROW = "dim int, part int, ids binary, labels binary, rows binary"


def first_of_groups(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by falling score, then by id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    began = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order[np.arange(len(g)) - began < k]


class Planes:
    """Rows of integers as their least component and the bits above it, most significant plane first."""

    def __init__(self, rows: np.ndarray, kind):
        self.least = int(rows.min()) if rows.size else 0
        above = (rows - self.least).astype(np.int64)
        self.bits = int(above.max()).bit_length() if rows.size else 0
        self.kind = kind
        # planes[0] is that of the bit `bits - 1`
        self.planes = [((above >> k) & 1).astype(kind) for k in reversed(range(self.bits))]


def products(anchors: np.ndarray, planes: Planes, allowed: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs that may count.

    After a plane, each pair's score lies between what the planes so far give plus the least and plus the most that the
    lower bits can add. keep(a, r, low, high) says, for all pairs that are left, which of these intervals can still
    qualify; the others are dropped. While many are left, a plane is one product of matrices; later the pairs are gathered.
    """
    kind = planes.kind
    a = anchors.astype(kind)
    down, up = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    at_a, at_r = np.nonzero(allowed)
    base = a.sum(axis=1) * kind(planes.least)
    left = planes.bits
    dense, score = None, base[at_a]
    columns = np.arange(allowed.shape[1])
    for plane in planes.planes:
        left -= 1
        if len(at_a) > SPARSE * len(a) * max(len(columns), 1):
            if dense is None:
                dense = np.repeat(base[:, None], len(columns), axis=1)
            dense += kind(1 << left) * (a @ plane[columns].T)
            place = np.searchsorted(columns, at_r)
            score = dense[at_a, place]
        else:
            dense = None
            for i in range(0, len(at_a), 1 << 16):
                part = slice(i, i + (1 << 16))
                score[part] += kind(1 << left) * np.einsum("pd,pd->p", a[at_a[part]], plane[at_r[part]])
        rest = kind((1 << left) - 1)
        alive = keep(at_a, at_r, score + rest * down[at_a], score + rest * up[at_a])
        if not alive.all():
            at_a, at_r, score = at_a[alive], at_r[alive], score[alive]
            if not len(at_a):
                break
            if dense is not None:
                now = np.unique(at_r)
                if len(now) < 0.7 * len(columns):
                    dense, columns = dense[:, np.searchsorted(columns, now)], now
    return at_a, at_r, score.astype(np.int64)


def exact_kind(anchors: np.ndarray, rows: np.ndarray):
    """The fastest type in which every sum of products on the way is a whole number without rounding."""
    largest = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    top = 4 * (largest + 1) * int(np.abs(anchors.astype(np.int64)).sum(axis=1).max(initial=0))
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


class Best:
    """The first k (score, id) of each group, over batches of them; `floor` is the score of the k-th, if there are as many."""

    def __init__(self, groups: int, k: int):
        self.k, self.none = k, np.iinfo(np.int64).min
        self.group, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(groups, self.none, np.int64)

    def add(self, group: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(group):
            return
        group, ids, score = np.concatenate([self.group, group]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        kept = first_of_groups(group, score, ids, self.k)
        self.group, self.id, self.score = group[kept], ids[kept], score[kept]
        n = np.bincount(self.group, minlength=len(self.floor))
        last = np.cumsum(n) - 1  # groups are in order
        full = np.flatnonzero(n >= self.k)
        self.floor[full] = self.score[last[full]]


def _matrix(data: bytes, wide: bool, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if wide else "<i2").reshape(-1, dim) if dim else np.zeros((0, 0), np.int32)


class Tile:
    """One shard's rows and one part's anchors."""

    def __init__(self, dim: int, shard: dict, part: dict):
        self.ids, self.labels = np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["labels"], "<i8")
        self.anchor_ids, self.anchor_labels = np.frombuffer(part["ids"], "<i8"), np.frombuffer(part["labels"], "<i8")
        self.rows = _matrix(shard["rows"], shard["wide"], dim) if dim else np.zeros((len(self.ids), 0), np.int32)
        self.anchors = _matrix(part["rows"], True, dim) if dim else np.zeros((len(self.anchor_ids), 0), np.int32)
        self.kind = exact_kind(self.anchors, self.rows)

    def positives(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, id, score): the first k rows of the anchor's label."""
        out = []
        for label in np.unique(self.anchor_labels):
            mine, others = np.flatnonzero(self.anchor_labels == label), np.flatnonzero(self.labels == label)
            blocks = [(some, Best(len(some), k)) for some in np.split(mine, range(BLOCK, len(mine), BLOCK))]
            for at in range(0, len(others), CHUNK):
                rows = others[at : at + CHUNK]
                planes = Planes(self.rows[rows], self.kind)
                for some, best in blocks:
                    allowed = self.anchor_ids[some][:, None] != self.ids[rows][None, :]

                    def keep(a, r, low, high, best=best):
                        floor = best.floor.copy()
                        # k rows whose scores are not below some bound make that bound a floor; pairs are in order of anchors
                        ends = np.searchsorted(a, np.arange(len(floor) + 1)).tolist()
                        for i, (first, end) in enumerate(zip(ends, ends[1:], strict=False)):
                            if end - first >= k:
                                floor[i] = max(floor[i], int(np.partition(low[first:end], end - first - k)[end - first - k]))
                        return high >= floor[a]

                    a, r, score = products(self.anchors[some], planes, allowed, keep)
                    best.add(a, self.ids[rows[r]], score)
            out += [(some[best.group], best.id, best.score) for some, best in blocks]
        return _joined(out)

    def negatives(self, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, positive, id, score): the first k rows of another label for each anchor and number of a positive, whose
        score is from least to most (anchors x positives; where least is over most, there is none)."""
        ends, wide = np.iinfo(np.int64), least.shape[1]
        window = least <= most
        lowest = np.where(window, least, ends.max).min(axis=1, initial=ends.max)
        highest = np.where(window, most, ends.min).max(axis=1, initial=ends.min)
        busy = np.flatnonzero(lowest <= highest)
        blocks = [(some, Best(len(some) * wide, k)) for some in np.split(busy, range(BLOCK, len(busy), BLOCK))]
        for at in range(0, len(self.ids), CHUNK):
            rows = slice(at, at + CHUNK)
            planes = Planes(self.rows[rows], self.kind)
            ids, labels = self.ids[rows], self.labels[rows]
            for some, best in blocks:
                allowed = self.anchor_labels[some][:, None] != labels[None, :]
                floors = np.where(window[some], best.floor.reshape(-1, wide), ends.max).min(axis=1, initial=ends.max)
                bottom, top = np.maximum(lowest[some], floors), highest[some]
                a, r, score = products(self.anchors[some], planes, allowed, lambda a, r, low, high, b=bottom, t=top: (high >= b[a]) & (low <= t[a]))
                found = []
                for j in range(wide):
                    fits = (score >= least[some[a], j]) & (score <= most[some[a], j])
                    found.append((a[fits] * wide + j, ids[r[fits]], score[fits]))
                best.add(*_joined(found))
        return _joined([(some[best.group // wide], best.group % wide, best.id, best.score) for some, best in blocks], 4)


def _joined(parts: list[tuple], columns: int = 3) -> tuple:
    """Arrays of the same kind end to end."""
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else tuple(np.empty(0, np.int64) for _ in range(columns))


def _least_row(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    return min(rows)


def hard_negatives(vectors: DataFrame, *, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors (vec_id, embedding, label).

    A component x counts as floor(scale * x); a score is the integer inner product with the anchor, one of the rows whose
    vec_id is divisible by `every`. An anchor's positives are its first rows of the same label by falling score, then by
    vec_id; its negatives for one of them are the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. So a negative positive_score has none.

    Rows without vec_id, label or vector, with null or non-finite components, or with components of MOST and more after
    scaling (no score could then be held for sure) take no part; vectors of different sizes are not compared. Repeated rows
    count once; of different rows with one vec_id the one with the smallest label, then the smallest vector as bytes, counts.
    An empty table gives no rows; other columns, whatever their names, are not looked at.

    Rows are packed into shards by a hash of vec_id, anchors into parts; each shard meets each part in one task, first for
    the positives, then for the negatives within the windows that those set. Only the first few of a tile are shuffled.
    """
    x = F.col("embedding").cast("array<double>")
    fits = F.forall(x, lambda v: v.isNotNull() & (F.abs(v * float(scale)) < float(MOST)))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("vector"))
    clean = clean.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fits)
    size = small_batches(clean).select(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("a")).first()
    shards = max(1, math.ceil(size["n"] / min(max(LEAST_SHARD, size["n"] // SHARDS), MOST_SHARD)))
    parts = min(shards, max(1, math.ceil(size["a"] / PART)))

    def deal(batches):
        held: dict[tuple[int, int], list] = {}

        def dealt():
            rows = [(dim, xxhash.xxh3_64_intdigest(i.to_bytes(8, "little", signed=True)) % shards, i, *_least_row(r)) for (dim, i), r in held.items()]
            held.clear()
            dim, shard, ids, label, data = zip(*rows, strict=True) if rows else ((),) * 5
            return pa.record_batch({"dim": pa.array(dim, pa.int32()), "shard": pa.array(shard, pa.int32()), "vec_id": pa.array(ids, pa.int64()), "label": pa.array(label, pa.int64()), "data": pa.array(data, pa.binary())})

        for b in batches:
            column = b.column(2)
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype("<i4")
            ends = np.cumsum([0, *column.value_lengths().to_pylist()]).tolist()
            for n, (i, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                rows = held.setdefault((ends[n + 1] - ends[n], i), [])
                rows.append((label, flat[ends[n] : ends[n + 1]].tobytes()))
                if len(rows) > 64:
                    rows[:] = [_least_row(rows)]
            if len(held) > DEALT:
                yield dealt()
        yield dealt()
        release()

    def pack(rows: pa.Table) -> pa.Table:
        first: dict[int, tuple] = {}
        for i, label, data in zip(rows["vec_id"].to_pylist(), rows["label"].to_pylist(), rows["data"].to_pylist(), strict=True):
            if i not in first or (label, data) < first[i]:
                first[i] = (label, data)
        ids = sorted(first)
        dim = rows["dim"][0].as_py()
        matrix = np.frombuffer(b"".join(first[i][1] for i in ids), "<i4")
        wide = bool(len(matrix)) and not (-(1 << 15) <= matrix.min() and matrix.max() < 1 << 15)
        row = {"dim": dim, "shard": rows["shard"][0].as_py(), "ids": np.array(ids, "<i8").tobytes(), "labels": np.array([first[i][0] for i in ids], "<i8").tobytes(), "rows": (matrix if wide else matrix.astype("<i2")).tobytes(), "wide": wide}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary()), ("wide", pa.bool_())]))

    part_schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary())])

    def anchors_of(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
                at = np.flatnonzero(ids % every == 0)
                rows = _matrix(r["rows"], r["wide"], r["dim"])[at].astype("<i4") if r["dim"] else np.empty(0, "<i4")
                if len(at):
                    out.append({"dim": r["dim"], "part": r["shard"] * parts // shards, "ids": ids[at].tobytes(), "labels": labels[at].tobytes(), "rows": rows.tobytes()})
            yield from pa.Table.from_pylist(out, schema=part_schema).to_batches()

    def join_up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ids")
        row = {k: b"".join(rows[k].to_pylist()) for k in ("ids", "labels", "rows")}
        return pa.Table.from_pylist([{"dim": rows["dim"][0].as_py(), "part": rows["part"][0].as_py(), **row}], schema=part_schema)

    packs = cut(clean.mapInArrow(deal, "dim int, shard int, vec_id long, label long, data binary").groupBy("dim", "shard").applyInArrow(pack, PACK))
    found = cut(packs.select("dim", "shard", "ids", "labels", "rows", "wide").mapInArrow(anchors_of, PART_ROW).groupBy("dim", "part").applyInArrow(join_up, PART_ROW))
    every_part = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("dim", "shard", "part")

    def meet(frame: DataFrame, run, schema: str) -> DataFrame:
        every_shard = frame.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("dim", "shard", "part")
        return every_part.cogroup(every_shard).applyInArrow(run, schema)

    near_schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def near(shard: pa.Table, part: pa.Table) -> pa.Table:
        if not (shard.num_rows and part.num_rows):
            return near_schema.empty_table()
        s, p = shard.to_pylist()[0], part.to_pylist()[0]
        tile = Tile(p["dim"], s, p)
        a, ids, score = tile.positives(positives)
        return pa.table([np.full(len(a), p["dim"], np.int32), np.full(len(a), p["part"], np.int32), tile.anchor_ids[a], ids, score], schema=near_schema)

    order = W.partitionBy("dim", "anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = meet(found, near, "dim int, part int, anchor_id long, positive_id long, score long")
    chosen = chosen.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= positives)
    window_schema = pa.schema([*part_schema, ("positive_ids", pa.binary()), ("scores", pa.binary())])

    def windows(part: pa.Table, rows: pa.Table) -> pa.Table:
        if not (part.num_rows and rows.num_rows):
            return window_schema.empty_table()
        p = part.to_pylist()[0]
        ids = np.frombuffer(p["ids"], "<i8")
        by_id = np.argsort(ids)
        at = by_id[np.searchsorted(ids[by_id], rows["anchor_id"].to_numpy())], rows["at"].to_numpy() - 1
        # a missing positive has a score below zero, and so no negatives
        found, scores = np.zeros((len(ids), positives), "<i8"), np.full((len(ids), positives), -1, "<i8")
        found[at], scores[at] = rows["positive_id"].to_numpy(), rows["score"].to_numpy()
        return pa.Table.from_pylist([p | {"positive_ids": found.tobytes(), "scores": scores.tobytes()}], schema=window_schema)

    windowed = cut(found.groupBy("dim", "part").cogroup(chosen.groupBy("dim", "part")).applyInArrow(windows, PART_ROW + ", positive_ids binary, scores binary"))
    out_schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])

    def hard(shard: pa.Table, part: pa.Table) -> pa.Table:
        if not (shard.num_rows and part.num_rows):
            return out_schema.empty_table()
        s, p = shard.to_pylist()[0], part.to_pylist()[0]
        tile = Tile(p["dim"], s, p)
        ids, scores = (np.frombuffer(p[k], "<i8").reshape(-1, positives) for k in ("positive_ids", "scores"))
        # 100 * score is from low * positive to high * positive
        a, j, found, score = tile.negatives(-(-low * scores // 100), high * scores // 100, negatives)
        return pa.table([tile.anchor_ids[a], ids[a, j], found, scores[a, j], score], schema=out_schema)

    out = meet(windowed, hard, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return hard_negatives(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))
