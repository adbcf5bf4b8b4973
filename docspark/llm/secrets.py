"""Secrets in texts: keyword prefilter, anchored patterns near hits, checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, table

# What counts as a secret.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_TAIL = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_WORD = "AKIA"
CHECKED_WORDS = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

_TAIL = re.compile(ASSIGN_TAIL)
_ACCESS = re.compile("[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{%d,}" % HEX_LEAST)
_CHECKED = re.compile("([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")


@cache
def prefilter():
    """An automaton of all keywords, in lower case."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in (*ASSIGN_WORDS, ACCESS_WORD.lower(), *CHECKED_WORDS):
        found.add_word(word, word)
    found.make_automaton()
    return found


def checksum62(body: str) -> str:
    """CRC32 of the token's body in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of KINDS; positions in code points, end exclusive.

    Each kind is matched leftmost and without overlaps; a match that is too short takes its characters all the
    same. Tokens with an embedded checksum count only if it is right.
    """
    spans = []
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII letters only
    ends = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - len(word), end + 1, word) for end, word in prefilter().iter(lower))
    for start, end, word in hits:
        if word == ACCESS_WORD.lower():
            if start >= ends["access"] and text.startswith(ACCESS_WORD, start) and (m := _ACCESS.match(text, end)):
                ends["access"] = m.end()
                if m.end() - start >= ACCESS_LEAST:
                    spans.append(("access", start, m.end()))
        elif word in CHECKED_WORDS:
            kind = CHECKED_WORDS[word]
            if start >= ends[kind] and text.startswith(word, start) and (m := _CHECKED.match(text, end)) and checksum62(m[1]) == m[2]:
                ends[kind] = m.end()
                spans.append((kind, start, m.end()))
        elif start >= ends["assign"] and (m := _TAIL.match(text, end)):
            ends["assign"] = m.end()
            if len(m[1]) >= ASSIGN_LEAST:
                spans.append(("assign", start, m.end()))
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, as `[SECRET]`."""
    out, at, end = [], 0, 0
    for _, a, b in spans:
        if a >= end:
            out += [text[at:a], "[SECRET]"]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, *, redact: bool = False, name: str = "secrets") -> DataFrame:
    """All columns of docs and one more, `name` (array of kind, start, end); with redact, text and n_chars follow the spans.

    A null or empty text holds no secrets and stays as it is; repeated rows get equal results, a text of any length is
    searched as a whole, an empty table gives no rows. One pass without a shuffle; other columns pass through whatever
    their names, but `name` must not be one of theirs.
    """
    if name.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"docs has a column {name}; pass another name")
    schema = "array<struct<kind:string,start:long,end:long>>"
    if redact:
        schema = f"struct<text:string,secrets:{schema}>"

    @F.arrow_udf(schema)
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        every = [(t, find_secrets(t) if t else []) for t in texts.to_pylist()]
        lists = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in every], kind)
        if not redact:
            return lists
        return pa.StructArray.from_arrays([pa.array([redacted(t, s) if s else t for t, s in every], pa.string()), lists], ["text", "secrets"])

    docs = small_batches(docs)
    if not redact:
        return docs.withColumn(name, found("text"))
    (both,) = fresh(docs, "scan_of_text")
    out = docs.withColumn(both, found("text"))
    spans = F.col(f"{both}.secrets")
    changed = {"text": F.col(f"{both}.text"), "n_chars": F.when(F.size(spans) > 0, F.char_length(F.col(f"{both}.text")).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns], spans.alias(name))


def op6_secrets(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
