"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_ranges, group_docs, joined_runs, mix64, packed, rolling_hash, table

K, S = 16, 9


def closed_syncmers(text: str, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers whose least s-mer stands first or last in them."""
    code = mix64(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    if len(code) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    half = s - 1
    shared = k == 2 * half and not half & (half - 1)  # both hashes grow from the same runs, see `rolling_hash`
    if shared:
        run = joined_runs(code, half)
        mixed = mix64(run + np.uint64(half))
        small = mix64(mixed[:-1] + code[half:])
    else:
        small = rolling_hash(code, s)
    width = k - s + 1
    least, have = small, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero((small[: len(least)] == least) | (small[width - 1 :] == least))
    return at, mix64(mixed[at] + run[at + half]) if shared else rolling_hash(code, k)[at]


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers: k-mers whose least s-mer stands first or last in them.

    Whether a k-mer is chosen depends on its own characters only, so equal passages have equal anchors wherever
    they stand. A non-empty text without any has one anchor, the whole text at position 0.
    """
    at, hashes = closed_syncmers(text, k, s)
    return (at, hashes) if len(at) else whole_text(text)


def whole_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.zeros(1, np.int64), np.array([whole], np.uint64)


def edited_anchors(text: str, start: int, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text that agrees with another up to `start`, from those of the other: they need no context, so
    only what reaches beyond is looked at."""
    if start < K:
        return anchors(text)
    first = start - K + 1  # of the k-mers that reach beyond
    keep = int(np.searchsorted(before[0], first))
    at, hashes = closed_syncmers(text[first:], K, S)
    if not len(at) and (not keep or len(before[0]) == 1):  # perhaps the other's one anchor is its whole text
        return anchors(text)
    return np.concatenate([before[0][:keep], at + first]), np.concatenate([before[1][:keep], hashes])


def to_text(values: np.ndarray) -> str:
    """64-bit values as base64 of their bytes, highest first."""
    return binascii.b2a_base64(values.astype(">u8").tobytes(), newline=False).decode()


def from_text(fingerprint: str) -> np.ndarray:
    """The distinct anchors, ascending, of which the fingerprint consists."""
    return np.frombuffer(binascii.a2b_base64(fingerprint), ">u8").astype(np.uint64)


class Print:
    """All anchors of a text: `at` and `hashes` by position; `distinct` hashes, ascending, with `first` and `count`
    of each among the positions `by_hash`, which are in order of hash and then of place. `text` is the fingerprint."""

    def __init__(self, found: tuple[np.ndarray, np.ndarray]):
        at, self.hashes = found
        self.at = at.astype(np.int32)
        order = np.argsort(self.hashes, kind="stable")
        self.by_hash, ordered = self.at[order], self.hashes[order]
        new = np.ones(len(ordered), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        self.first = np.flatnonzero(new)
        self.distinct, self.count = ordered[self.first], np.diff(np.append(self.first, len(ordered)))
        self.text = to_text(self.distinct)


def compared(a: Print, b: Print) -> tuple[float, int]:
    """Jaccard similarity of all distinct anchors (two empty texts: 1), and how many anchors match by position.

    For the second the k-th occurrence of an anchor in one text is paired with the k-th in the other; it is the
    number of pairs at the distance that most of them have, so those of the longest passages moved by one shift.
    """
    if not len(a.distinct) and not len(b.distinct):
        return 1.0, 0
    if a is b:
        return 1.0, len(a.at)
    both, i, j = np.intersect1d(a.distinct, b.distinct, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0
    n = np.minimum(a.count[i], b.count[j])
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shift = b.by_hash[np.repeat(b.first[j], n) + step] - a.by_hash[np.repeat(a.first[i], n) + step]
    return len(both) / (len(a.distinct) + len(b.distinct) - len(both)), int(np.unique(shift, return_counts=True)[1].max())


def lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(kind) if parts else np.empty(0, kind)))


DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, placed_edited long, placed_next long"
RESULT = DIGEST + ", positions array<int>, anchors array<long>, edited_positions array<int>, edited_anchors array<long>"
#: Characters of the texts whose rows are sent together: a row holds several times its text.
SENT_CHARS = 1 << 19


def with_next(docs: DataFrame, *, arrays: bool = True) -> DataFrame:
    """Every anchor of each text and of its edited text with its position, and their likeness; see `op2_syncmers`.

    A fingerprint holds all distinct anchors of its text (`from_text`); near_* are the Jaccard similarities of
    fingerprints, placed_* is that of `compared`. Anchors are 64-bit hashes, in the arrays as signed numbers; without
    `arrays` the rows end before them, which is half their bytes.
    Documents are dealt by ranges of doc_id; each range also gets the last document of the range before it, so
    that every document meets its next one without a sort of the whole table. Null text counts as empty, null
    doc_ids as smallest; ties follow the text, those of an id with more text than a group takes follow a hash of the
    text first. A single document is its own next. An empty table gives no rows.
    """

    def coded(rows: list[tuple], prints: list[tuple], changes: list[tuple]) -> pa.RecordBatch:
        doc_id, n_chars, sha, key, edited_key, to_edited, to_next = zip(*rows, strict=True)
        out = {
            "doc_id": pa.array(doc_id, pa.int64()), "n_chars": pa.array(n_chars, pa.int64()), "edited_sha256": pa.array(sha, pa.string()),
            "fingerprint": pa.array(key, pa.string()), "edited_fingerprint": pa.array(edited_key, pa.string()),
            "near_edited": pa.array([x for x, _ in to_edited], pa.float64()), "near_next": pa.array([x for x, _ in to_next], pa.float64()),
            "placed_edited": pa.array([n for _, n in to_edited], pa.int64()), "placed_next": pa.array([n for _, n in to_next], pa.int64()),
        }
        if arrays:
            out |= {
                "positions": lists([at for at, _ in prints], np.int32), "anchors": lists([h for _, h in prints], np.int64),
                "edited_positions": lists([at for at, _ in changes], np.int32), "edited_anchors": lists([h for _, h in changes], np.int64),
            }
        return pa.record_batch(out)

    def compare(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, lent = group_docs([b for batch in group for b in batch.column("blob")])
        own = [i for i, x in enumerate(lent) if not x]
        before = [i for i, x in enumerate(lent) if x]
        rows, prints, changes, held = [], [], [], 0
        if own:
            follower = before[-1] if before else own[-1]
            next_print = Print(anchors(texts[follower]))
            for i in own:
                text, after = texts[i], texts[follower]
                mine = next_print if text == after else Print(anchors(text))
                m = len(text) // 3
                edited = text[: len(text) - m] + after[:m] if m else text
                changed = mine if edited == text else Print(edited_anchors(edited, len(text) - m, (mine.at, mine.hashes)))
                rows.append((ids[i], len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine.text, changed.text, compared(mine, changed), compared(mine, next_print)))
                if arrays:
                    prints.append((mine.at, mine.hashes))
                    changes.append((changed.at, changed.hashes))
                held += len(text)
                follower, next_print = i, mine
                if held >= SENT_CHARS:
                    yield coded(rows, prints, changes)
                    rows, prints, changes, held = [], [], [], 0
        if rows:
            yield coded(rows, prints, changes)

    groups = packed(docs, doc_ranges(docs), lend_last=True)
    return groups.groupBy("g").applyInArrow(compare, RESULT if arrays else DIGEST)


def op2_syncmers(spark, sf_dir):
    """Without the arrays: their hashes are those of the fingerprints."""
    return with_next(table(spark, sf_dir, "documents"), arrays=False)
