"""Exact repeats between and within documents, found in bounded memory.

The table is dealt once into ranges of doc_id ("groups", at most 8 MB of text each), so that an earlier group holds
only smaller ids; groups that share an id with more text than that share a level, and a level counts as earlier, not
a group. Three passes over the groups follow; between them only sorted, delta-coded hashes move:

1. seeds: every group sends hashes of short seeds. A reducer holds one slice of the hash range and answers one bit
   for each: does it occur again anywhere. It also tells which whole texts an earlier group holds.
2. windows: seeds that recur are extended to the windows around them, and the groups send 64-bit hashes of just
   these windows. The reducer of a slice sorts it and answers one bit for each: held by an earlier group or not.
3. removal: a group unites the windows that start earlier into maximal spans.

A group sends each distinct hash once, so no reducer gets more rows for a passage than there are groups, however
many documents hold it. Nothing is sampled or capped. Units and windows are scrambled at each step (see
`rolling_hash`), so two different windows are taken as equal only with the chance of random 64-bit values.

Which seeds are sent depends on the method:

* fixed blocks (`remove_repeated_words`): non-overlapping blocks of half a window form the index, and every rolling
  block probes it.
* difference cover (`remove_repeated_bytes`): only suffixes that start in a difference cover modulo 21 are seeds.
  For any two places there is an offset below 21 at which both are in the cover, so two equal windows share a seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_BYTES, doc_ranges, group_docs, mix64, packed, release, rolling_hash, split_words, unique_sorted, word_hashes

SPARE_BITS = 9  # a seed seems to recur by chance once in about 2 ** (SPARE_BITS + 2)
_CODED = "bucket int, g int, kind int, data binary"


@dataclass(frozen=True)
class Repeats:
    """What a repeat is: the window, its seeds and which earlier starts count."""

    units: Callable[[str], tuple[np.ndarray, object]]  # units of a text, and what to cut them from
    runs: Callable[[np.ndarray, int, np.ndarray], np.ndarray]  # 64-bit hashes of the runs of so many units at some places
    window: int
    seed: int
    sent: Callable[[int], np.ndarray] | None  # which of n seed positions are sent; None: all
    indexed: Callable[[int], np.ndarray] | None  # a mask of those in the index; None: all that are sent
    same_doc: bool  # an earlier start in the same document counts


# --- sorted hashes as bytes ---------------------------------------------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as first value, then differences by byte planes, compressed."""
    if not len(values):
        return b""
    steps = np.diff(values)
    wide = 8 if len(steps) and int(steps.max()) >> 32 else 4
    planes = steps.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T
    return int(values[0]).to_bytes(8, "little") + bytes([wide]) + zstandard.compress(planes.tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(zstandard.decompress(data[9:]), np.uint8).reshape(data[8], -1)
    steps = np.ascontiguousarray(planes.T).view(f"<u{data[8]}").ravel()
    out = np.empty(len(steps) + 1, np.uint64)
    out[0] = int.from_bytes(data[:8], "little")
    out[1:] = steps
    return np.cumsum(out, dtype=np.uint64)


def slices(values: np.ndarray, bits: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Ascending values of so many bits, by equal parts of their range."""
    part = ((values >> np.uint64(bits - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    edges = np.flatnonzero(np.diff(part)) + 1
    return [(int(part[i]), v) for i, v in zip([0, *edges], np.split(values, edges), strict=False) if len(v)]


def contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def rows(found: list[tuple]) -> pa.RecordBatch:
    b, g, k, d = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.record_batch({"bucket": pa.array(b, pa.int32()), "g": pa.array(g, pa.int32()), "kind": pa.array(k, pa.int32()), "data": pa.array(d, pa.binary())})


# --- the passes ---------------------------------------------------------------------------------------------

PROBE, FLAGS, WHOLE, HITS, COPIES, WINDOWS, STATE, LOST, STARTS = range(9)


def removals(docs: DataFrame, spec: Repeats, finish, schema: str) -> DataFrame:
    """finish(doc_id, source, removed) makes a row of the schema from a document and the mask of its removed units."""
    ranges = doc_ranges(docs)
    groups = packed(docs, ranges)
    buckets = max(1, len(ranges))
    bits = min(62, max(32, (len(ranges) * GROUP_BYTES).bit_length() + SPARE_BITS))
    held = docs.sparkSession.sparkContext.broadcast((ranges.level, ranges.shared))

    def seeds_of(units):
        """Seeds of a text that are sent, where they start, which are in the index, and how many places there are."""
        n = max(0, len(units) - spec.seed + 1)
        at = np.arange(n) if spec.sent is None else spec.sent(n)
        seeds = spec.runs(units, spec.seed, at) >> np.uint64(64 - bits)
        return seeds, at, np.ones(len(at), bool) if spec.indexed is None else spec.indexed(n), n

    def send_seeds(table: pa.Table) -> pa.Table:
        g, out = table["g"][0].as_py(), []
        _, texts, _ = group_docs(table["blob"])
        found = [seeds_of(spec.units(text)[0]) for text in texts]
        if any(len(f[0]) for f in found):
            distinct, back, n = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True, return_counts=True)
            indexed = np.zeros(len(distinct), bool)
            indexed[back[np.concatenate([f[2] for f in found])]] = True
            done = 0
            for b, v in slices(distinct, bits, buckets):
                part = slice(done, done + len(v))
                out.append((b, g, PROBE, pack_sorted(v)))
                out.append((b, g, FLAGS, pack_bits(np.concatenate([indexed[part], n[part] > 1]))))
                done += len(v)
        whole = unique_sorted(np.array([text_hash(t) for t in texts], np.uint64))
        out += [(b, g, WHOLE, pack_sorted(v)) for b, v in slices(whole, 64, buckets)]
        return pa.Table.from_batches([rows(out)])

    def answer_seeds(part: pa.Table) -> pa.Table:
        bucket, out = part["bucket"][0].as_py(), []
        by_kind: dict[int, dict[int, bytes]] = {PROBE: {}, FLAGS: {}, WHOLE: {}}
        for g, kind, data in zip(part["g"].to_pylist(), part["kind"].to_pylist(), part["data"].to_pylist(), strict=True):
            by_kind[kind][g] = data
        if by_kind[PROBE]:
            groups_here = list(by_kind[PROBE])
            sent = [unpack_sorted(by_kind[PROBE][g]) for g in groups_here]
            flags = [unpack_bits(by_kind[FLAGS][g], 2 * len(v)).reshape(2, -1) for g, v in zip(groups_here, sent, strict=True)]
            every = np.concatenate(sent)
            indexed, twice = np.concatenate(flags, axis=1)
            order = np.argsort(every, kind="stable")
            run = every[order]
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            n = np.diff(np.append(starts, len(run)))
            again = ((n > 1) | np.logical_or.reduceat(twice[order], starts)) & np.logical_or.reduceat(indexed[order], starts)
            hit = np.empty(len(every), bool)
            hit[order] = np.repeat(again, n)
            for g, mask in zip(groups_here, np.split(hit, np.cumsum([len(v) for v in sent])[:-1]), strict=True):
                if mask.any():
                    out.append((bucket, g, HITS, pack_bits(mask)))
        for g, (v, lost) in earlier([(g, unpack_sorted(d)) for g, d in by_kind[WHOLE].items()], held.value[0]):
            if lost.any():
                out.append((bucket, g, COPIES, pack_sorted(v[lost])))
        return pa.Table.from_batches([rows(out)])

    def candidates(texts, copies: np.ndarray, hits: dict[int, bytes], ranks) -> tuple[np.ndarray, np.ndarray]:
        """Which documents are copies of an earlier one, and at which places of the others a window may recur."""
        flags, first = np.zeros(len(texts), bool), {}
        for i, text in enumerate(texts):
            h = text_hash(text)
            flags[i] = first.setdefault(h, ranks[i]) < ranks[i] or bool(contains(copies, np.array([h], np.uint64))[0])
        found = [seeds_of(spec.units(text)[0]) for text in texts]
        masks = [np.empty(0, bool)]
        if any(len(f[0]) for f in found):
            distinct, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            hit = by_slice(distinct, bits, hits)[back]
            done, span = 0, spec.window - spec.seed + 1
            for i, (own, at, _, n) in enumerate(found):
                if not flags[i] and n >= span:
                    mark = np.zeros(n + 1, np.int32)
                    mark[1:][at] = hit[done : done + len(own)]
                    total = np.cumsum(mark, dtype=np.int32)
                    masks.append(total[span:] > total[:-span])
                done += len(own)
        return flags, np.concatenate(masks)

    def by_slice(distinct: np.ndarray, width: int, replies: dict[int, bytes]) -> np.ndarray:
        """The answer for each value that was sent."""
        out, done = np.zeros(len(distinct), bool), 0
        for b, v in slices(distinct, width, buckets):
            if b in replies:
                out[done : done + len(v)] = unpack_bits(replies[b], len(v))
            done += len(v)
        return out

    def windows_of(texts, flags: np.ndarray, mask: np.ndarray):
        """Units of each text, hashes of its candidate windows, and their places."""
        found, places, sources, start = [], [], [], 0
        for i, text in enumerate(texts):
            units, source = spec.units(text)
            sources.append((source, len(units)))
            n = max(0, len(units) - spec.window + 1)
            if n and not flags[i]:
                own = np.flatnonzero(mask[start : start + n])
                if len(own):
                    found.append(spec.runs(units, spec.window, own))
                    places.append((i, own))
                start += n
        return sources, found, places

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([rows([])])
        g, hits, copies = table["g"][0].as_py(), {}, [np.empty(0, np.uint64)]
        for b, kind, data in zip(*(replies[c].to_pylist() for c in ("bucket", "kind", "data")), strict=True):
            if kind == HITS:
                hits[b] = data
            else:
                copies.append(unpack_sorted(data))
        ids, texts, _ = group_docs(table["blob"])
        flags, mask = candidates(texts, unique_sorted(np.concatenate(copies)), hits, ranks_of(ids))
        _, found, places = windows_of(texts, flags, mask)
        out = [(-1 - g, g, STATE, pack_state(flags, mask))]
        if found and spec.same_doc and held.value[1][g]:
            distinct, back = np.unique(np.concatenate(found), return_inverse=True)
            least, done = np.full(len(distinct), 1 << 40, np.int64), 0
            np.minimum.at(least, back, np.concatenate([own for _, own in places]))
            for b, v in slices(distinct, 64, buckets):
                out += [(b, g, WINDOWS, pack_sorted(v)), (b, g, STARTS, zstandard.compress(least[done : done + len(v)].tobytes(), 1))]
                done += len(v)
        elif found:
            out += [(b, g, WINDOWS, pack_sorted(v)) for b, v in slices(unique_sorted(np.concatenate(found)), 64, buckets)]
        return pa.Table.from_batches([rows(out)])

    def answer_windows(part: pa.Table) -> pa.Table:
        out, sent, starts = [], [], {}
        for b, g, kind, data in zip(*(part[c].to_pylist() for c in ("bucket", "g", "kind", "data")), strict=True):
            if kind == STATE:
                out.append((b, g, kind, data))
            elif kind == STARTS:
                starts[g] = np.frombuffer(zstandard.decompress(data), np.int64)
            else:
                sent.append((g, unpack_sorted(data)))
                bucket = b
        for g, (_, lost) in earlier(sent, held.value[0], starts):
            if lost.any():
                out.append((bucket, g, LOST, pack_bits(lost)))
        return pa.Table.from_batches([rows(out)])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        got = dict(zip(replies["bucket"].to_pylist(), replies["data"].to_pylist(), strict=True))
        ids, texts, _ = group_docs(table["blob"])
        ranks = ranks_of(ids)
        flags, mask = unpack_state(next(d for b, d in got.items() if b < 0), len(ids))
        sources, found, places = windows_of(texts, flags, mask)
        cover: dict[int, np.ndarray] = {}
        if found:
            distinct, back = np.unique(np.concatenate(found), return_inverse=True)
            lost = by_slice(distinct, 64, got)
            rank = np.concatenate([np.full(len(own), ranks[i], np.int64) for i, own in places])
            key = rank
            if spec.same_doc:
                key = rank * (1 << 40) + np.concatenate([own for _, own in places])
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, back, key)
            gone = lost[back] | (key > least[back])
            done = 0
            for i, own in places:
                cover[i] = own[gone[done : done + len(own)]]
                done += len(own)
        made = []
        for i, (source, n) in enumerate(sources):
            if flags[i]:
                removed = np.full(n, n >= spec.window)
            else:
                step = np.zeros(n + 1, np.int32)
                starts = cover.get(i)
                if starts is not None and len(starts):
                    step[starts] += 1
                    np.subtract.at(step, starts + spec.window, 1)
                removed = np.cumsum(step[:n]) > 0
            made.append(finish(ids[i], source, removed))
        out = pa.Table.from_pylist(made, schema=arrow_schema)
        release()
        return out

    arrow_schema = to_arrow(docs, schema)
    # as many tasks as slices of the hash range, so that a task's share stays the same however large the input is
    seeds = groups.groupBy("g").applyInArrow(send_seeds, _CODED)
    replies = seeds.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer_seeds, _CODED)
    windows = groups.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(send_windows, _CODED)
    decided = windows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer_windows, _CODED)
    return groups.groupBy("g").cogroup(decided.groupBy("g")).applyInArrow(remove, schema)


def to_arrow(docs: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def earlier(sent: list[tuple[int, np.ndarray]], level: np.ndarray, starts: dict[int, np.ndarray] | None = None) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """For each (group, ascending distinct values): the values and whether a group of a smaller level sent them too, or
    one of the same level from an earlier start (starts: by group, the least of each value)."""
    if not sent:
        return []
    sent = sorted(sent, key=lambda x: x[0])
    every = np.concatenate([v for _, v in sent])
    place = np.concatenate([np.full(len(v), int(level[g]) << 41, np.int64) for g, v in sent])
    if starts:
        place += np.concatenate([starts.get(g, np.zeros(len(v), np.int64)) for g, v in sent])
    order = np.argsort(every, kind="stable") if not starts else np.lexsort((place, every))
    run, place = every[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))[: len(run)]
    lost = np.empty(len(every), bool)
    lost[order] = place > np.repeat(place[first], np.diff(np.append(first, len(run))))
    ends = np.cumsum([len(v) for _, v in sent])[:-1]
    return [(g, (v, part)) for (g, v), part in zip(sent, np.split(lost, ends), strict=True)]


def ranks_of(ids: list) -> np.ndarray:
    """Number of each doc_id in order; equal ids share one."""
    return np.cumsum([0] + [a != b for a, b in zip(ids[1:], ids, strict=False)])


def pack_bits(mask: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(mask).tobytes(), 3)


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool)


def pack_state(flags: np.ndarray, mask: np.ndarray) -> bytes:
    return len(mask).to_bytes(8, "little") + pack_bits(np.concatenate([flags, mask]))


def unpack_state(data: bytes, docs: int) -> tuple[np.ndarray, np.ndarray]:
    both = unpack_bits(data[8:], docs + int.from_bytes(data[:8], "little"))
    return both[:docs], both[docs:]


# --- words: fixed blocks ------------------------------------------------------------------------------------


def word_units(text: str) -> tuple[np.ndarray, str]:
    """The 64-bit hash of each word."""
    return word_hashes(text.encode("utf-8", "surrogatepass"))[0], text


def word_runs(units: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    return rolling_hash(units, length)[at]


def spans_of(removed: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def remove_repeated_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """Documents without words that stand in a window of words which starts earlier in the table.

    Returns doc_id, n_words, removed (spans of word numbers, end exclusive), kept (words joined by one space).
    A null text counts as empty; null doc_ids come before all others; rows with the same doc_id are the same
    document for the order, so repeated rows get equal results. An empty table gives no rows. Other columns are
    not looked at.
    """
    block = window // 2
    spec = Repeats(word_units, word_runs, window, block, None, lambda n: np.arange(n) % block == 0, True)

    def finish(doc_id, text, removed):
        words = split_words(text)
        if removed.any():
            words = list(compress(words, (~removed).tolist()))
        return {"doc_id": doc_id, "n_words": len(removed), "removed": spans_of(removed), "kept": " ".join(words)}

    return removals(docs, spec, finish, "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")


# --- bytes: difference cover --------------------------------------------------------------------------------


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The least set of residues whose differences give every residue, by search in order of size."""
    size = 1
    while True:
        size += 1
        if size * (size - 1) + 1 < period:
            continue

        def extend(chosen: tuple[int, ...], size: int = size) -> tuple[int, ...] | None:
            if len(chosen) == size:
                return chosen if len({(a - b) % period for a in chosen for b in chosen}) == period else None
            for x in range(chosen[-1] + 1, period):
                if size * (size - 1) + 1 == period and len({(a - b) % period for a in (*chosen, x) for b in (*chosen, x)}) < len(chosen) * (len(chosen) + 1) + 1:
                    continue
                if out := extend((*chosen, x)):
                    return out
            return None

        if found := extend((0, 1)):
            return found


def byte_units(text: str) -> tuple[np.ndarray, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(raw, np.uint8), raw


def byte_runs(units: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Eight bytes at a time, of at least eight; the last eight end with the run."""
    padded = np.concatenate([units, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(units) + 1,), "<u8", padded.data, 0, (1,))
    out = eight[at]
    for step in [*range(8, length - 8, 8), length - 8]:
        out = mix64(out + np.uint64(step)) + eight[at + step]
    return mix64(out)


def remove_repeated_bytes(docs: DataFrame, window: int = 50, period: int = 21) -> DataFrame:
    """Documents without bytes that stand in a string of `window` bytes which also starts in a smaller doc_id.

    Returns doc_id, n_bytes, removed (spans of byte numbers, end exclusive), kept (binary: the remaining bytes).
    A null text counts as empty; null doc_ids come before all others; rows with the same doc_id are one document for
    the order: neither is earlier. An empty table gives no rows. Other columns are not looked at.
    """
    cover = np.array(difference_cover(period))

    def sent(n: int) -> np.ndarray:
        at = (np.arange(0, n, period)[:, None] + cover[None, :]).ravel()
        return at[at < n]

    spec = Repeats(byte_units, byte_runs, window, window - period + 1, sent, None, False)

    def finish(doc_id, raw, removed):
        kept = np.frombuffer(raw, np.uint8)[~removed].tobytes() if removed.any() else raw
        return {"doc_id": doc_id, "n_bytes": len(raw), "removed": spans_of(removed), "kept": kept}

    return removals(docs, spec, finish, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op7_substring_dedup(spark, sf_dir):
    from .common import table

    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", removed_size().alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_suffix_dedup(spark, sf_dir):
    from .common import table

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", removed_size().alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def removed_size():
    return F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
