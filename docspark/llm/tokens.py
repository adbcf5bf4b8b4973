"""Words to token ids by a public vocabulary, with a bounded memory of words seen."""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cache

import numpy as np

from .common import CHUNK, WordNumbers, spelled, word_hashes

VOCABULARY = "word_bpe_49k.json"
KEPT_WORDS = 700_000
_SPLIT_AT = np.isin(np.arange(256), [ord(c) for c in " \t\n\r"])
LAST_PLAIN = "ɏ"  # up to here Unicode's rules for case and composition are the same everywhere


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself, if it prints."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordEncoder:
    """encode_all(texts) -> ids as uint32, equal to those of `tokenizers` without special tokens.

    The tokenizer splits at white space before all else, so each word's ids are found once and remembered by the
    word's 64-bit hash; words that come when the bounded memory is full are encoded anew each time. Words of plain
    letters are merged here from the vocabulary's own merge table, all others, and texts that hold a special token's
    string, are given to `tokenizers`.
    """

    def __init__(self, path: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        split = next(p["pattern"]["Regex"] for p in held["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split).findall
        signs = byte_signs()
        self.inner = np.array([vocabulary[s] for s in signs], np.int64)
        self.final = np.array([vocabulary[s + suffix] for s in signs], np.int64)
        parts = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        keys = np.array([vocabulary[a] << 17 | vocabulary[b] for a, b in parts], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in parts], np.int64)
        self.order = np.argsort(keys)
        self.pairs, self.none = keys[self.order], 1 << 40
        # ranks of two bytes, and of two of which the second ends a piece
        self.byte_ranks = np.stack([self._rank(self.inner[:, None], x[None, :]) for x in (self.inner, self.final)])
        # the ids of word n are `ids` from `starts[n]` to `starts[n + 1]`
        self.words, self.starts, self.ids, self.used = WordNumbers(KEPT_WORDS), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint32), 0

    def _remember(self, hashes: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new words begin and end in `ids`; those for which there is no room are there until the next call."""
        n, new = self.words.n, np.frombuffer(b"".join(found), "<u4")
        for name, size in (("starts", n + len(found) + 1), ("ids", self.used + len(new))):
            held = getattr(self, name)
            if size > len(held):
                setattr(self, name, np.concatenate([held, np.zeros((1 << size.bit_length()) - len(held), held.dtype)]))
        self.ids[self.used : self.used + len(new)] = new
        edges = self.used + np.cumsum([0, *[len(f) // 4 for f in found]])
        kept = min(len(hashes), self.words.most - n)
        self.words.add(hashes[:kept])
        self.starts[n : n + kept + 1] = edges[: kept + 1]
        self.used = int(edges[kept])
        return edges[:-1], edges[1:]

    def _merge_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens: byte signs merged pair by pair, lowest rank and then leftmost first, all at once.

        Rows hold the signs of a piece; each round merges one pair in every row that still has one.
        """
        out = [b""] * len(pieces)
        coded = [p.encode() for p in pieces]
        order = sorted(range(len(pieces)), key=lambda i: len(coded[i]))
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            sizes = np.array([len(coded[i]) for i in part])
            wide = int(sizes.max()) + 1
            rows, column = np.arange(len(part)), np.arange(wide)
            data = np.zeros((len(part), wide), np.uint8)
            data[column < sizes[:, None]] = np.frombuffer(b"".join([coded[i] for i in part]), np.uint8)
            ids = np.where(column < sizes[:, None], self.inner[data], -1)
            ids[rows, sizes - 1] = self.final[data[rows, sizes - 1]]
            second = column[1:] - sizes[:, None] + 1  # 0 where the second byte ends the piece
            ranks = np.where(second > 0, self.none, self.byte_ranks[(second == 0).astype(np.int8), data[:, :-1], data[:, 1:]])
            done = []
            while len(rows):
                best = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(rows)), best]
                going = rank < self.none
                if not going.all():
                    done.append((rows[~going], ids[~going]))
                    rows, ids, ranks, best, rank = rows[going], ids[going], ranks[going], best[going], rank[going]
                    if not len(rows):
                        break
                here = np.arange(len(rows))
                shift = np.minimum(column + (column > best[:, None]), wide - 1)
                ids = np.take_along_axis(ids, shift, axis=1)
                ids[:, -1] = -1
                ids[here, best] = self.made[rank]
                ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], wide - 2), axis=1)
                ranks[:, -1] = self.none
                ranks[here, best] = self._rank(ids[here, best], ids[here, np.minimum(best + 1, wide - 1)])
                left = np.maximum(best - 1, 0)
                ranks[here, left] = self._rank(ids[here, left], ids[here, left + 1])
            for r, found in done:
                ends = ((found >= 0).sum(axis=1) * 4).tolist()
                raw, step = found.astype("<u4").tobytes(), 4 * found.shape[1]
                for k, (i, n) in enumerate(zip(r.tolist(), ends, strict=True)):
                    out[part[i]] = raw[k * step : k * step + n]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a < 0) | (b < 0), -1, a << 17 | b)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], self.none)

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of the words, as bytes."""
        found: list[bytes] = [b""] * len(new)
        pieces: list[tuple[int, list[str]]] = []
        for i, word in enumerate(new):
            if word.isprintable() and (word.isascii() or max(word) <= LAST_PLAIN and unicodedata.is_normalized("NFC", word)):
                low = word.lower()
                pieces.append((i, [low] if low.isalpha() else self.pieces(low)))
            else:
                found[i] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        distinct = list({p for _, ps in pieces for p in ps})
        merged = dict(zip(distinct, self._merge_all(distinct), strict=True))
        for i, ps in pieces:
            found[i] = merged[ps[0]] if len(ps) == 1 else b"".join([merged[p] for p in ps])
        return found

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Some texts are done at a time."""
        out, at = [], 0
        while at < len(texts):
            start, held = at, 0
            while at < len(texts) and held < CHUNK:
                held += len(texts[at])
                at += 1
            out += self._encode(texts[start:at])
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        coded = [b"" if i in whole else t.encode() for i, t in enumerate(texts)]
        raw = b" ".join(coded)
        hashes, start, end = word_hashes(raw, _SPLIT_AT)
        number = self.words.of(hashes)
        begin, end_of = self.starts[number], self.starts[number + 1]
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, first, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            first = unknown[first]
            made = self._remember(new, self._learn(spelled(raw, start[first], end[first])))
            begin[unknown], end_of[unknown] = made[0][back], made[1][back]
        sizes = end_of - begin
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.ids[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])]
        edge = ends[np.searchsorted(start, np.cumsum([0, *[len(c) + 1 for c in coded]]))].tolist()
        out = [ids[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
