"""Shared pieces of the corpus operators: checkpoints, document groups, fast hashes."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; everything else belongs to a word.
WORD_BREAKS = "\t\n\x0b\x0c\r "
MULTIPLIER = 6364136223846793005
GROUP_BYTES = 8 << 20
_BREAK = np.isin(np.arange(256), [ord(c) for c in WORD_BREAKS])
_LOW_BYTES = np.array([0] + [(1 << 8 * i) - 1 for i in range(1, 9)], np.uint64)
#: Words of more bytes are hashed one by one; texts are hashed together up to so many characters.
LONG_WORD, CHUNK = 256, 1 << 20
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's shared checkpoint folder; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="docspark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as the frame has columns so called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session that sends at most BATCH_ROWS rows to Python at a time: texts have any length, so that
    many more rows would not fit a worker. A smaller setting of the session stays."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df


def release() -> None:
    """Give memory that is free in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def split_words(text: str) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged; these breaks are just the blanks that bytes are split at."""
    words = text.encode("utf-8", "surrogatepass").split()
    return b" ".join(words).decode("utf-8", "surrogatepass").split(" ") if words else []


def unique_sorted(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending, by one sort: NumPy's own way for this goes through a hash table and is slower."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    shifted = out >> np.uint64(27)
    out ^= shifted
    out *= np.uint64(0x94D049BB133111EB)
    np.right_shift(out, np.uint64(31), out=shifted)
    out ^= shifted
    return out


def word_hashes(raw: bytes, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 text, and where it starts and ends; breaks: which bytes part words.

    Eight bytes at a time are scrambled into the hash; words of up to eight bytes cannot meet, longer ones only with
    the chance of random 64-bit values.
    """
    data, n = np.frombuffer(raw + bytes(8), np.uint8), len(raw)
    outside = np.ones(n + 2, bool)
    np.take(breaks, data[:n], out=outside[1:-1])
    edge = np.flatnonzero(outside[1:] != outside[:-1])
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray((n + 1,), "<u8", data.data, 0, (1,))  # the eight bytes from each place on
    out = mix64((eight[start] & _LOW_BYTES[np.minimum(size, 8)]) + np.uint64(0x9E3779B97F4A7C15) * size.astype(np.uint64))
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        out[at] = mix64(out[at] * np.uint64(MULTIPLIER) ^ (eight[start[at] + done] & _LOW_BYTES[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return out, start, end


def hashed_words(texts: list[str], *, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of some texts at a time: the number of the first, hashes of all their words, and where each text's words end."""
    at = 0
    while at < len(texts):
        coded, held, first = [], 0, at
        while at < len(texts) and held < CHUNK:
            text = texts[at].lower() if lower else texts[at]
            coded.append(text.encode("utf-8", "surrogatepass"))
            held += len(coded[-1])
            at += 1
        hashes, start, _ = word_hashes(b"\n".join(coded))
        ends = np.cumsum([len(c) + 1 for c in coded])
        yield first, hashes, np.searchsorted(start, ends)


def spelled(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The words at these places."""
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class WordNumbers:
    """Numbers 0, 1, 2, ... for words by their 64-bit hash, in order of arrival; a whole array is looked up at once."""

    def __init__(self, most: int):
        self.most, self.bits = most, (most + most // 3).bit_length()
        self.keys, self.numbers, self.n = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each, -1 if it has none."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.numbers[at]
        left = np.flatnonzero((self.keys[at] != hashes) & (out >= 0))
        out[left] = -1
        at = at[left]
        while len(left):
            at = at + 1 & len(self.keys) - 1
            number, same = self.numbers[at], self.keys[at] == hashes[left]
            found = same & (number >= 0)
            out[left[found]] = number[found]
            going = ~same & (number >= 0)
            left, at = left[going], at[going]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number distinct hashes that have none yet; there must be room for them."""
        number = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.n += len(hashes)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.numbers[at[left]] < 0
            at[left[~free]] = at[left[~free]] + 1 & len(self.keys) - 1
            claims = left[free]
            _, first = np.unique(at[claims], return_index=True)
            won = claims[first]
            self.keys[at[won]], self.numbers[at[won]] = hashes[won], number[won]
            left = left[self.numbers[at[left]] != number[left]]


def joined_runs(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` tokens (64-bit values), in order, before their last scramble."""
    have, run = 1, tokens
    for bit in bin(length)[3:]:
        keep = len(run) - have
        run = mix64(run[:keep] + np.uint64(have)) + run[have : have + keep]
        have *= 2
        if bit == "1":
            keep = len(tokens) - have
            run = mix64(run[:keep] + np.uint64(have)) + tokens[have : have + keep]
            have += 1
    return run


def rolling_hash(tokens: np.ndarray, length: int) -> np.ndarray:
    """Scrambled hashes of all runs of `length` tokens (64-bit values), in order; empty if there are fewer tokens.

    Runs of 2n tokens are combined from runs of n, scrambled before, so that no structure of the tokens survives;
    the cost is logarithmic in the length.
    """
    if len(tokens) < length:
        return np.empty(0, np.uint64)
    return mix64(joined_runs(tokens, length))


# --- groups of documents, dealt by ranges of doc_id ---------------------------------------------------------

PART_BITS = 16


class Ranges:
    """Groups of documents in order of doc_id, null ids first; groups share a `level` only if they share one doc_id.

    ends: the largest doc_id of each level of known ids, ascending; every one is an id that occurs. nulls: whether
    level 0 is that of null ids. cuts: by level, the ends of the groups of an id with more text than a group takes,
    as parts of the hash range of texts.
    """

    def __init__(self, ends: list[int], nulls: bool, cuts: dict[int, list[int]]):
        self.ends, self.nulls = np.asarray(ends, np.int64), nulls
        self.cuts = {level: np.asarray(c, np.int64) for level, c in cuts.items()}
        sizes = np.ones(len(ends) + nulls, np.int64)
        for level, c in cuts.items():
            sizes[level] = len(c)
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.level = np.repeat(np.arange(len(sizes)), sizes)
        self.shared = np.repeat(sizes > 1, sizes)

    def __len__(self) -> int:
        return len(self.level)

    def groups(self, ids: np.ndarray, null: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The group of each document, by its id and its text's part of the hash range."""
        level = np.searchsorted(self.ends, ids, side="left") + self.nulls
        level[null] = 0
        level = np.minimum(level, len(self.first) - 1)
        out = self.first[level]
        for hot in np.intersect1d(np.unique(level), list(self.cuts)).tolist():
            here = level == hot
            out[here] += np.minimum(np.searchsorted(self.cuts[hot], part[here], side="left"), len(self.cuts[hot]) - 1)
        return out.astype(np.int32)

    def closes(self, ids: np.ndarray, null: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which documents have the largest id of their group."""
        level = self.level[group] - self.nulls
        return null | (ids == self.ends[np.maximum(level, 0)]) if len(self.ends) else null


def text_part():
    """The part of the hash range in which a text lies (a null text as empty)."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 64 - PART_BITS).cast("int")


def doc_ranges(docs: DataFrame) -> Ranges:
    """Ranges of doc_id of at most GROUP_BYTES of text, but for a single document that is longer.

    Ids and sizes only are sorted, by Spark, and each task cuts its own run of them; the driver receives a few numbers
    for each range. An id with more text than that, as null ids may have together, is cut again by a hash of its
    texts; so only rows that are equal in both stay together however many they are.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("id"), text_part().alias("part"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"))
    sizes = sizes.groupBy("id", "part").agg(F.sum("b").alias("b"))
    runs = sizes.repartitionByRange("id").sortWithinPartitions("id", "part").mapInArrow(run_cutter(GROUP_BYTES), "id long, part int, b long")
    found = sorted(((r["id"] is not None, r["id"] or 0, r["part"], r["b"]) for r in runs.collect()), key=lambda r: (r[:2], r[2]))
    ends, levels, cuts, held = [], 0, {}, None  # held: bytes of the last range, if more may join it
    for (known, number), group in itertools.groupby(found, key=lambda r: r[:2]):
        own = list(group)
        if len(own) > 1:
            cuts[levels] = [part for _, _, part, _ in own]
        joins = known and len(own) == 1 and held is not None and held + own[0][3] <= GROUP_BYTES
        if joins:
            ends[-1], held = number, held + own[0][3]
            continue
        levels += 1
        if known:
            ends.append(number)
            held = own[0][3] if len(own) == 1 else None
    return Ranges(ends, bool(found) and not found[0][0], cuts)


def run_cutter(most: int):
    """Cuts sorted (id, part, b) into runs of at most `most` bytes: (last id, last part, bytes) of each run. Null ids
    and an id with more than that have runs of their own, cut at parts; other ids are not cut."""

    def run(batches):
        out = []  # finished runs
        before = 0  # bytes of ids that wait for more
        last = None  # the id before, if it waits
        now, started, own, inner = None, False, 0, []  # the id that is read: bytes since its last cut, and its cuts

        def finish():
            nonlocal before, last, inner, own
            if not started:
                return
            if inner or now is None or before + own > most:
                if last is not None:
                    out.append((last, 0, before))
                before, last = 0, None
            if inner or now is None:
                out.extend(inner)
                out.append((now, part_before, own))
            else:
                before, last = before + own, now

        part_before = 0
        for batch in batches:
            for number, part, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or number != now:
                    finish()
                    now, started, own, inner = number, True, 0, []
                elif own + b > most and own:
                    inner.append((now, part_before, own))
                    own = 0
                own += b
                part_before = part
            if out:
                yield coded(out)
                out.clear()
        finish()
        if last is not None:
            out.append((last, 0, before))
        if out:
            yield coded(out)

    def coded(found):
        number, part, b = zip(*found, strict=True)
        return pa.record_batch({"id": pa.array(number, pa.int64()), "part": pa.array(part, pa.int32()), "b": pa.array(b, pa.int64())})

    return run


def packed(docs: DataFrame, ranges: Ranges, *, lend_last: bool = False) -> DataFrame:
    """Rows (g, blob): documents (doc_id, text; null text as empty) as compressed Arrow streams by group.

    lend_last: the last document of each group is also sent to the next group (that of the last group to the
    first), marked `lent`. Dealt by g; the exchange is the only movement of whole texts.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranges)

    def deal(batches):
        ranges = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, text = batch.column(0), batch.column(1)
            text = text.cast(pa.large_string()).fill_null("")
            null = np.asarray(ids.is_null())
            number = np.asarray(ids.fill_null(0)).astype(np.int64)
            g = ranges.groups(number, null, np.asarray(batch.column(2)))
            whole = pa.table({"doc_id": ids, "text": text})
            rows, to, lent = np.arange(len(g)), g, np.zeros(len(g), bool)
            if lend_last and len(ranges):
                # of several with the largest id of a group only that with the largest text here can be the last
                last: dict[int, int] = {}
                for i in np.flatnonzero(ranges.closes(number, null, g)).tolist():
                    j = last.setdefault(int(g[i]), i)
                    if j != i and text[j].as_py() < text[i].as_py():
                        last[int(g[i])] = i
                rows = np.concatenate([rows, np.fromiter(last.values(), np.int64, len(last))])
                to = np.concatenate([to, (np.fromiter(last, np.int64, len(last)) + 1) % len(ranges)])
                lent = np.concatenate([lent, np.ones(len(last), bool)])
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order])) + 1
            for part in np.split(order, edges):
                piece = whole.take(pa.array(rows[part])).append_column("lent", pa.array(lent[part]))
                yield pa.record_batch({"g": pa.array([int(to[part[0]])], pa.int32()), "blob": pa.array([to_blob(piece)], pa.binary())})

    parts = max(1, len(ranges))
    rows = small_batches(docs).select("doc_id", "text", text_part().alias("part"))
    return rows.mapInArrow(deal, "g int, blob binary").repartition(parts, "g")


def to_blob(piece: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write_table(piece)
    return sink.getvalue().to_pybytes()


def from_blob(blob) -> pa.Table:
    return pa.ipc.open_stream(blob if isinstance(blob, bytes) else blob.as_buffer()).read_all()


def group_docs(blobs: pa.ChunkedArray) -> tuple[list, list[str], list[bool]]:
    """doc_id (None first, then ascending; ties by text), text and lent of a group's blobs."""
    rows: list = []
    for b in blobs:
        t = from_blob(b)
        rows += zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["lent"].to_pylist())
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
