"""SentencePiece models of the merge type: texts to ids by a table of last tokens over prefixes, and ids to texts."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, WordNumbers, release, small_batches, spelled, table, word_hashes
from .tokens import vocabulary_path

PIECES = "piece_bpe_32k.model"
BLANK = "▁"
#: Chunks kept by a worker, their longest length in bytes, and pairs of tokens whose test is kept.
KEPT_CHUNKS, LONGEST_KEPT, KEPT_PAIRS = 500_000, 128, 2_000_000
MARK = 0xFF  # no byte of UTF-8
_MARKS = np.arange(256) == MARK
#: Texts that a model must encode as the library does before it is used; they meet every rule that is relied on.
PROBES = ("", " ", "  a  b ", "a\nb\tc", "a▁b", "\x00é語\U0001f600", "<s> </s><unk><0x41>", "ab" * 40, "éﬁ")


class PrefixTable:
    """Ids of a chunk of text under a model of the merge type.

    The model merges the adjacent parts whose joined piece scores best, leftmost first, until none is a piece. A run of
    tokens is such a result just if each two neighbours are: a merge across a boundary would show in the run of those two
    alone. So each prefix has one last token, the one piece that ends there and goes with the last token of what is
    before it. An automaton gives the pieces that end at each place, and the ids are read off from the end.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if not all(model.is_byte(int(i)) for i in self.bytes):
            raise ValueError("a model with a piece for every byte is needed")
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.scores = {names[i]: model.get_score(i) for i in range(n) if not special[i]}
        self.end, self.size = model.eos_id(), n
        self.chars = {c for p in self.scores for c in p}
        # tokens beyond the vocabulary are characters that occur in pieces only; they are written as bytes
        self.names = names + sorted(self.chars - self.scores.keys())
        self.lengths = [len(t) for t in self.names]
        self.start = len(self.names)
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(self.names):
            if i >= n or not special[i]:
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.goes: dict[int, bool] = {}
        for text in PROBES:
            if self.text_ids(text) != model.encode(text):
                raise ValueError("the model is not of the merge type, or changes texts by more than blanks")

    def merged(self, text: str) -> list[str]:
        """The parts of a short text by the model's own rule."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, joined and merged anew, come out as these two; before the first there is the start.

        Answers are kept in `goes`, by left * (start + 1) + right.
        """
        pair = [self.names[right]] if left == self.start else [self.names[left], self.names[right]]
        if len(self.goes) >= KEPT_PAIRS:
            self.goes.clear()
        known = self.goes[left * (self.start + 1) + right] = self.merged("".join(pair)) == pair
        return known

    def last_tokens(self, text: str) -> list[int] | array:
        """The last token of each prefix of a text that has only characters of pieces; the empty prefix has the start."""
        last = [-1] * (len(text) + 1) if len(text) < LONGEST_KEPT else array("i", [-1]) * (len(text) + 1)
        last[0] = self.start
        goes, step, compatible = self.goes, self.start + 1, self.compatible
        for at, (token, length) in self.automaton.iter(text):
            if last[at + 1] < 0:
                before = last[at + 1 - length]
                known = goes.get(before * step + token)
                if known or known is None and compatible(before, token):
                    last[at + 1] = token
        return last

    def ids(self, text: str) -> list[int]:
        """Ids of a text in which blanks are BLANK already; characters without a piece are bytes."""
        if not self.chars.issuperset(text):
            out, at = [], 0
            for i, char in enumerate(text):
                if char not in self.chars:
                    out += self.ids(text[at:i]) + self.bytes[list(char.encode())].tolist()
                    at = i + 1
            return out + self.ids(text[at:])
        last, at, found = self.last_tokens(text), len(text), []
        while at:
            token = last[at]
            found.append(token)
            at -= self.lengths[token]
        found.reverse()
        if max(found, default=0) >= self.size:
            return [i for t in found for i in (self.bytes[list(self.names[t].encode())].tolist() if t >= self.size else [t])]
        return found

    def text_ids(self, text: str) -> list[int]:
        """Ids of one text, its blanks replaced and one put before it."""
        return self.ids((BLANK + text.replace(" ", BLANK)) if text else "")


class PieceEncoder:
    """encode_all(texts) -> ids of each, equal to the library's without an end id.

    No token crosses a place whose two bytes are side by side in no piece, such as that before a blank or around a line
    break. So texts are cut there, and each chunk is its own. Chunks are found by 64-bit hash in a bounded memory; those
    that it does not hold go through the prefix table, which changes no id.
    """

    def __init__(self, path: str, most: int = KEPT_CHUNKS):
        self.table = PrefixTable(path)
        self.parted = np.ones((256, 256), bool)
        self.parted[:, 0x80:0xC0] = False  # inside a character
        for piece in self.table.scores:
            data = np.frombuffer(piece.replace(BLANK, " ").encode(), np.uint8)
            self.parted[data[:-1], data[1:]] = False
        self.words, self.starts, self.held, self.used = WordNumbers(most), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint32), 0

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Some texts are done at a time."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and size < CHUNK:
                size += len(texts[at])
                at += 1
            yield from self._encode(texts[first:at])

    def _chunks(self, coded: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The texts with a MARK between any two chunks, and where each text ends."""
        raw = np.frombuffer(bytes([MARK]).join(coded) + bytes([MARK]), np.uint8)
        at = np.flatnonzero(self.parted[raw[:-1], raw[1:]]) + 1
        ends = np.cumsum([len(c) + 1 for c in coded]) - 1
        return np.insert(raw, at, MARK).tobytes(), ends + np.searchsorted(at, ends, side="right")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        coded = [b" " + t.encode("utf-8", "replace").replace(BLANK.encode(), b" ") if t else b"" for t in texts]
        raw, text_ends = self._chunks(coded)
        hashes, start, end = word_hashes(raw, _MARKS)
        number = self.words.of(hashes)
        begin, stop = self.starts[number], self.starts[number + 1]
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, first, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            first = unknown[first]
            found = [self.table.ids(c.replace(" ", BLANK)) for c in spelled(raw, start[first], end[first])]
            edges = self._remember(new, end[first] - start[first] <= LONGEST_KEPT, found)
            begin[unknown], stop[unknown] = edges[0][back], edges[1][back]
        sizes = stop - begin
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.held[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])]
        edge = ends[np.searchsorted(start, text_ends)].tolist()
        return [ids[a:b] for a, b in zip([0, *edge], edge, strict=False)]

    def _remember(self, hashes: np.ndarray, short: np.ndarray, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new chunks begin and end in `held`. The short ones stay as far as there is room, the others
        are behind them until the next call."""
        keep = np.flatnonzero(short)[: self.words.most - self.words.n]
        order = np.concatenate([keep, np.delete(np.arange(len(found)), keep)])
        sizes = np.array([len(found[i]) for i in order.tolist()], np.int64)
        edges = self.used + np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        n = self.words.n
        for name, size in (("starts", n + len(keep) + 2), ("held", int(edges[-1]))):
            held = getattr(self, name)
            if size > len(held):
                setattr(self, name, np.concatenate([held, np.zeros((1 << size.bit_length()) - len(held), held.dtype)]))
        self.held[self.used : edges[-1]] = np.array([x for i in order.tolist() for x in found[i]], np.uint32)
        self.words.add(hashes[keep])
        self.starts[n : n + len(keep) + 1] = edges[: len(keep) + 1]
        self.used = int(edges[len(keep)])
        begin, stop = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
        begin[order], stop[order] = edges[:-1], edges[1:]
        return begin, stop


class PieceDecoder:
    """Ids to text as the library joins it: BLANK is a blank, one at the very start goes, bytes become characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        self.silent = np.array([model.is_control(i) for i in range(n)])
        self.byte = np.array([model.is_byte(i) for i in range(n)])
        shown, self.leads = [], np.zeros(n, bool)
        for i in range(n):
            name = model.id_to_piece(i)
            self.leads[i] = name.startswith(BLANK) and not self.silent[i]
            if self.byte[i]:
                shown.append(bytes([int(name[3:5], 16)]))
            else:
                shown.append(b"" if self.silent[i] else " ⁇ ".encode() if model.is_unknown(i) else name.replace(BLANK, " ").encode())
        self.lengths = np.array([len(s) for s in shown], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(shown), np.uint8)

    def spread(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the vocabulary")
        heard = np.flatnonzero(~self.silent[ids])
        if not len(heard):
            return ""
        ids = ids[heard[0] : heard[-1] + 1]
        lead = int(self.leads[ids[0]])
        if len(ids) == len(heard):
            try:
                return self.spread(ids).tobytes()[lead:].decode()
            except UnicodeDecodeError:
                pass
        # control ids, or runs of bytes that are no characters: a run ends where another kind of id comes
        kind = self.byte[ids] + 2 * self.silent[ids]
        parts = [self.spread(p).tobytes() for p in np.split(ids, np.flatnonzero(np.diff(kind)) + 1)]
        return "".join([mended(parts[0][lead:]), *map(mended, parts[1:])])


def mended(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that belongs to no character becomes U+FFFD."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@cache
def decoder(path: str) -> PieceDecoder:
    return PieceDecoder(path)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(f) for f in found]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found]).astype(np.int32)))


def encode(docs: DataFrame, *, path: str | None = None, with_decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int>: every whole text by the model, closed by its end id; with_decoded also `decoded`, the text
    that the ids give.

    The ids are those of the library without sampling. Null text counts as empty and has the end id alone. Repeated rows
    get equal results, an empty table gives no rows, other columns, whatever their names, are not looked at. One pass
    without a shuffle; a worker's tables are bounded, and a very long text goes through the prefix table in linear time.
    A batch is handed on whenever it holds a few megabytes.
    """
    path = path or vocabulary_path(PIECES)

    def run(batches):
        held, back = encoder(path), decoder(path) if with_decoded else None

        def batch(docs, found):
            columns = {"doc_id": pa.array(docs, pa.int64()), "ids": _lists(found)}
            if back is not None:
                columns["decoded"] = pa.array([back.decode(f.astype(np.int64)) for f in found], pa.string())
            return pa.record_batch(columns)

        for b in batches:
            docs, texts, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > CHUNK:
                    yield batch(docs, [np.append(f, np.uint32(held.table.end)) for f in held.encode_all(texts)])
                    docs, texts, size = [], [], 0
            yield batch(docs, [np.append(f, np.uint32(held.table.end)) for f in held.encode_all(texts)])
        release()

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + (", decoded string" if with_decoded else ""))


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, text of (doc_id, ids array<int>), as the library decodes ids.

    Null lists give null, null ids in a list are left out, an id that the vocabulary does not have stops the job. Control
    ids give nothing; runs of byte ids that are no UTF-8 give U+FFFD for each byte that fits no character. Repeated rows
    get equal results, an empty table gives no rows, other columns are not looked at.
    """
    path = path or vocabulary_path(PIECES)

    def run(batches):
        back = decoder(path)
        for b in batches:
            texts = [None if not x.is_valid else back.decode(np.array(x.values.drop_null(), np.int64)) for x in b.column(1)]
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})
        release()

    return small_batches(encoded).select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def ids_digest(ids: list[int]) -> str:
    """Lowercase hex SHA-256 of the decimal ids joined by one blank."""
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def op11_pieces(spark, sf_dir):
    found = encode(table(spark, sf_dir, "documents"), with_decoded=True)
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
