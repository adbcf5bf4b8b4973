"""Token counts by a unigram model whose forward scores are shared through a trie."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK, WordNumbers, release, small_batches, spelled, table, word_hashes
from .tokens import vocabulary_path

PIECES = "piece_bpe_32k.model"
WORD_START = "▁"
NODES, WORDS = 400_000, 700_000


@cache
def piece_scores(path: str) -> tuple[dict[str, float], float]:
    """Log scores of the vocabulary's pieces and of a byte that stands for part of a character without a piece.

    The vocabulary is in order of frequency, so a piece scores as the logarithm of its rank, reversed in sign.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
    scores = {model.id_to_piece(i): -math.log(i + 2) for i in range(n) if not special[i]}
    return scores, -math.log(n + 2)


class Trie:
    """Prefixes of all words so far, each with its best forward score and, for it, the number of tokens.

    A node's score needs only what its parent knows: the parent's own best, and the pieces that began earlier on the
    path and are not yet complete. So a prefix that words share is computed once; the count at a word's last node is
    its answer. Ties go to fewer tokens. Beyond `most` nodes no more are kept, and what follows a kept prefix is
    computed for the word alone.
    """

    def __init__(self, scores: dict[str, float], byte_score: float, most: int = NODES):
        self.byte_score, self.most = byte_score, most
        self.inside: list[dict[str, int]] = [{}]  # the vocabulary's own trie: steps, and the score where a piece ends
        self.ends: list[float | None] = [None]
        for piece, score in scores.items():
            at = 0
            for char in piece:
                if char not in self.inside[at]:
                    self.inside[at][char] = len(self.inside)
                    self.inside.append({})
                    self.ends.append(None)
                at = self.inside[at][char]
            self.ends[at] = score
        self.singles = {p for p in scores if len(p) == 1}
        self.step: dict[tuple[int, str], int] = {}
        self.best: list[tuple] = [(0.0, 0, ((0.0, 0, 0),))]  # score, minus the number of tokens, open pieces

    def insert(self, word: str) -> int:
        """Number of tokens of the word."""
        step, best, inside, ends, singles = self.step, self.best, self.inside, self.ends, self.singles
        node, here = 0, best[0]
        for char in word:
            if node >= 0:
                child = step.get((node, char))
                if child is not None:
                    node, here = child, best[child]
                    continue
            score, n, started = here
            top = None
            if char not in singles:
                size = len(char.encode("utf-8", "surrogatepass"))
                top = (score + size * self.byte_score, n - size)
            open_ = []
            for s, m, at in started:
                at = inside[at].get(char)
                if at is not None:
                    open_.append((s, m, at))
                    end = ends[at]
                    if end is not None and (top is None or (s + end, m - 1) > top):
                        top = (s + end, m - 1)
            open_.append((*top, 0))
            here = (*top, open_)
            if node >= 0 and len(best) <= self.most:
                step[node, char] = len(best)
                node = len(best)
                best.append((*top, tuple(open_)))
            else:
                node = -1
        return -here[1]


class Counter:
    """Token counts of words, kept by the word's 64-bit hash; new words go through the trie.

    A worker keeps one from task to task. Words that come when the bounded memory is full are not kept, which changes
    no count.
    """

    def __init__(self, path: str, most: int = WORDS):
        self.trie = Trie(*piece_scores(path))
        self.words, self.counts = WordNumbers(most), np.zeros(most, np.int32)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many words and tokens each text has."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join(coded)
        hashes, start, end = word_hashes(raw)
        number = self.words.of(hashes)
        found = self.counts[number]
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, first, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            first = unknown[first]
            made = np.array([self.trie.insert(WORD_START + w) for w in spelled(raw, start[first], end[first])], np.int32)
            found[unknown] = made[back]
            room = self.words.most - self.words.n
            self.counts[self.words.n : self.words.n + len(new[:room])] = made[:room]
            self.words.add(new[:room])
        tokens = np.concatenate([np.zeros(1, np.int64), np.cumsum(found, dtype=np.int64)])
        ends = np.searchsorted(start, np.cumsum([0, *[len(c) + 1 for c in coded]]))
        return np.diff(ends), np.diff(tokens[ends])


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every document.

    Words are split at white space; a word with the sign of a word start before it is segmented by the best sum of
    piece scores, characters without a piece as bytes. Null text has no words. Repeated rows get equal results, an
    empty table gives no rows, other columns, whatever their names, are not looked at. One pass without a shuffle; a
    worker's trie and its table of words are bounded, which changes no count.
    """
    path = path or vocabulary_path(PIECES)

    def run(batches):
        held = counter(path)
        for b in batches:
            texts, words, tokens, at = [t or "" for t in b.column(1).to_pylist()], [], [], 0
            while at < len(texts):
                first, size = at, 0
                while at < len(texts) and size < CHUNK:
                    size += len(texts[at])
                    at += 1
                for out, found in zip((words, tokens), held.of(texts[first:at]), strict=True):
                    out.append(found)
            none = [np.empty(0, np.int64)]
            yield pa.record_batch({"doc_id": b.column(0), "n_words": pa.array(np.concatenate(words or none)), "n_tokens": pa.array(np.concatenate(tokens or none))})
        release()

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
