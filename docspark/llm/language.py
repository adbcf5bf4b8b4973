"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix64, release, small_batches, table

DIMENSIONS, ORDER, SEED = 1024, 3, 10
UNKNOWN = "und"
_LETTER = 21  # bits of a code point
_WORDS = DIMENSIONS // 64
#: Letters below this have their vectors in a table; others' are made as they come.
PLAIN = 0x250
#: Trigrams of a language that a task counts together.
SETTLE = 500_000


@cache
def letters_of_code_points() -> np.ndarray:
    """The lower-cased letter of every code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            out[code] = ord(char.lower()[0])
    return out


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A random vector of +1 and -1 for each letter, from a hash of its code point; 0, the gap between words, has one too."""
    place = letters.astype(np.uint64)[:, None] * np.uint64(_WORDS) + np.arange(_WORDS, dtype=np.uint64)
    bits = np.unpackbits(mix64(place + np.uint64(SEED << 32)).astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def permuted(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors by place in the trigram: the first is permuted twice, the second once."""
    v = letter_vectors(letters)
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


@cache
def plain_letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return permuted(np.arange(PLAIN))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Permuted letter vectors of each trigram, bound by multiplication."""
    mask = (1 << _LETTER) - 1
    letters = np.stack([codes >> 2 * _LETTER, codes >> _LETTER & mask, codes & mask])
    if letters.max(initial=0) < PLAIN:
        a, b, c = plain_letters()
    else:
        distinct, letters = np.unique(letters, return_inverse=True)
        letters = letters.reshape(3, -1)
        a, b, c = permuted(distinct)
    return a[letters[0]] * b[letters[1]] * c[letters[2]]


def trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of letters; what stands between words counts as one gap. Empty without letters."""
    letter = letters_of_code_points()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    if not letter.any():
        return np.empty(0, np.int64)
    letter = np.concatenate([[0], letter, [0]]).astype(np.int64)
    letter = letter[(letter != 0) | np.concatenate([[True], letter[1:] != letter[:-1]])]
    return letter[:-2] << 2 * _LETTER | letter[1:-1] << _LETTER | letter[2:]


def _weighed(n: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Vectors by their counts, added up without rounding: sums of whole numbers below 2^24, or else 2^53, are exact."""
    kind = np.float32 if n.sum() < 1 << 24 else np.float64
    return (n.astype(kind) @ vectors.astype(kind)).astype(np.int64)


def bundle(codes: np.ndarray) -> np.ndarray:
    """The sum of the vectors of all trigrams, as whole numbers."""
    distinct, n = np.unique(codes, return_counts=True)
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(distinct), 2048):
        total += _weighed(n[at : at + 2048], trigram_vectors(distinct[at : at + 2048]))
    return total


def profiles(labelled: DataFrame) -> dict[str, np.ndarray]:
    """A unit prototype for each language from (text, lang) rows, all of them.

    A prototype bundles the trigram vectors of all its documents. Bundles are whole numbers and add up in any order, so a
    task sends one of them for each language that it met, and the driver gets DIMENSIONS numbers a language, never
    documents or trigrams.
    """

    def add_up(batches):
        kept: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def settle(lang):
            if pieces := waiting.pop(lang, None):
                kept[lang] = kept.get(lang, 0) + bundle(np.concatenate(pieces))

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                codes = trigrams(text.as_py() or "")
                if len(codes):
                    waiting.setdefault(lang, []).append(codes)
                    if sum(map(len, waiting[lang])) > SETTLE or len(waiting[lang]) > 500:
                        settle(lang)
        for lang in list(waiting):
            settle(lang)
        for lang, total in kept.items():
            yield pa.record_batch({"lang": pa.array([lang] * DIMENSIONS, pa.string()), "at": pa.array(np.arange(DIMENSIONS, dtype=np.int32)), "n": pa.array(total)})
        release()

    rows = small_batches(labelled).select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.mapInArrow(add_up, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).orderBy("lang", "at").toArrow()
    out = {}
    for lang in sorted(set(found["lang"].to_pylist())):
        total = found.filter(pa.compute.equal(found["lang"], lang))["n"].to_numpy().astype(np.float64)
        if length := np.linalg.norm(total):
            out[lang] = (total / length).astype(np.float32)
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], columns: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_trigrams")) -> DataFrame:
    """All columns of docs and three more: the language, its score (cosine, at least 0) and the number of trigrams.

    Each is found from the whole text, of any length. `und` with score 0 if the text is null or has no letter, or if
    no language is known; of equal cosines the first name wins. Repeated rows get equal results, an empty table gives
    no rows; other columns pass through, but none may be named like the three. One pass without a shuffle; the
    prototypes are a few kilobytes a language.
    """
    if taken := {c.lower() for c in columns} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns {sorted(taken)}; pass other names")
    names = sorted(prototypes)
    known = np.array([prototypes[n] for n in names], np.float32) if names else None

    @F.arrow_udf("struct<lang:string,score:double,trigrams:int>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores, sizes = [], [], []
        for text in texts:
            codes = trigrams(text.as_py() or "")
            lang, score = UNKNOWN, 0.0
            if len(codes) and names:
                own = bundle(codes).astype(np.float32)
                cosine = known @ own / max(float(np.linalg.norm(own)), 1e-12)
                best = int(np.argmax(cosine))
                lang, score = names[best], min(1.0, max(0.0, float(cosine[best])))
            langs.append(lang)
            scores.append(score)
            sizes.append(len(codes))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())], ["lang", "score", "trigrams"])

    (found,) = fresh(docs, "found_language")
    predict = predict.asNondeterministic()  # so that a filter on its result does not run it once more
    parts = [F.col(f"{found}.{part}").alias(name) for part, name in zip(("lang", "score", "trigrams"), columns, strict=True)]
    return small_batches(docs).withColumn(found, predict("text")).select(*[F.col(f"`{c}`") for c in docs.columns], *parts)


def held_out():
    """Documents kept from learning; a null doc_id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = profiles(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
