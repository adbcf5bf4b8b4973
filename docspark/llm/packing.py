"""Packing documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, small_batches, table
from .tokens import VOCABULARY, encoder, vocabulary_path

LENGTH = 2048
END_ID = 1
#: A cut counts as one unit of the sum of squares for each so many tokens that are cut off.
CUT_COST = 32
CHUNK, ROWS, KEPT_IDS = 2 << 20, 8192, 1 << 18


class SumOfSquares:
    """Open windows by fill level. A piece goes where the sum of squared level counts gets least.

    Raising a window from level a to level b changes the sum by 1 - 2 n(a) + 2 n(b) + 1; a new window by 2 n(b) + 1;
    a window that gets full leaves the array and adds nothing. A piece may also be cut: its first part fills a
    window, what is cut off is placed next, and each CUT_COST tokens of it count as one. So a level's windows, once
    there are some, are filled rather than joined by more, and the open windows stay few for any lengths. Of equal
    choices the fullest window that takes the piece whole wins, then the least cut.
    """

    def __init__(self, length: int):
        self.length = length
        self.windows: list[list] = [[] for _ in range(length)]
        self.leave = np.full(length, np.iinfo(np.int32).max // 2, np.int32)
        self.leave[0] = 0  # level 0: a new window
        self.enter = np.ones(length + 1, np.int32)
        self.enter[length] = 0
        self.cost = (np.arange(1, length + 1) // CUT_COST).astype(np.int32)
        self.open = 0

    def _note(self, level: int) -> None:
        n = len(self.windows[level])
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int32).max // 2
        self.enter[level] = 2 * n + 1

    def best(self, size: int) -> int:
        """The level of the window to take; if it and the size are over the length, the piece is cut."""
        whole = self.length - size
        change = self.leave[: whole + 1] + self.enter[size:]
        level = whole - int(np.argmin(change[::-1]))
        if size > 1:
            cut = self.leave[whole + 1 :] + self.cost[: size - 1]
            if cut.min() < change[level]:
                return whole + 1 + int(np.argmin(cut))
        return level

    def place(self, piece) -> Iterator[list]:
        """Windows, as lists of pieces (doc, start, ids, total), that this piece fills."""
        doc, start, ids, total = piece
        while len(ids):
            level = self.best(len(ids))
            fits = min(len(ids), self.length - level)
            window = self.windows[level].pop() if level else []
            if level:
                self._note(level)
                self.open -= 1
            window.append((doc, start, ids[:fits], total))
            start, ids = start + fits, ids[fits:]
            if level + fits == self.length:
                yield window
            else:
                self.windows[level + fits].append(window)
                self._note(level + fits)
                self.open += 1

    def close(self) -> Iterator[list]:
        """All open windows: the fullest stay as they are and are filled up from the emptiest, whose pieces are cut;
        the last is cut into lengths that are powers of two."""
        left = [w for level in reversed(self.windows) for w in level]
        self.__init__(self.length)
        at = 0
        while at < len(left):
            window = left[at]
            room = self.length - sum(len(p[2]) for p in window)
            while room and len(left) > at + 1:
                doc, start, ids, total = left[-1].pop()
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    left[-1].append((doc, start + room, ids[room:], total))
                if not left[-1]:
                    left.pop()
                room -= min(room, len(ids))
            at += 1
            if not room:
                yield window
                continue
            tokens = self.length - room
            while tokens:
                part, want = [], 1 << (tokens.bit_length() - 1)
                tokens -= want
                while want:
                    doc, start, ids, total = window.pop()
                    part.append((doc, start, ids[:want], total))
                    if len(ids) > want:
                        window.append((doc, start + want, ids[want:], total))
                    want -= min(want, len(ids))
                yield part


def pack(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids if asked for.

    A document is its token ids and end_id; null text counts as empty. Whole sequences are cut off a long document
    first; the rest is placed by `SumOfSquares`. When a partition ends, its few open windows are filled from each
    other, and what remains is cut into lengths that are powers of two, so that nothing is padded. One pass without a
    shuffle; a task holds its open windows only, and every sequence is of one partition, in whose order of rows the
    result is determined. Repeated rows are packed as often as they occur. An empty table gives no rows; other
    columns, whatever their names, are not looked at.
    """
    path = path or vocabulary_path(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 36, 0
        words, levels, rows, kept, held = encoder(path), SumOfSquares(length), [], [], 0

        def encoded(b):
            docs, texts, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > CHUNK:
                    yield from zip(docs, words.encode_all(texts), strict=True)
                    docs, texts, held = [], [], 0
            yield from zip(docs, words.encode_all(texts), strict=True)

        def emit(pieces):
            nonlocal made, held
            at = 0
            for doc, start, ids, total in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + made, at)
                rows.append(row)
                if with_ids:
                    kept.append(ids)
                    held += len(ids)
                at += len(ids)
            made += 1

        def batch():
            nonlocal held
            held = 0
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int32))))
            rows.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for b in batches:
            for doc, found in encoded(b):
                ids = np.append(found, np.uint32(end_id))
                total = len(ids)
                whole = total - total % length
                for start in range(0, whole, length):
                    emit([(doc, start, ids[start : start + length], total)])
                if whole < total:
                    for window in levels.place((doc, whole, ids[whole:], total)):
                        emit(window)
                if len(rows) >= ROWS or held >= KEPT_IDS:
                    yield batch()
        for window in levels.close():
            emit(window)
        if rows:
            yield batch()
        release()

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, out)


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
