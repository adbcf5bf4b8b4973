"""The pipeline's stages, each on what the stage before kept."""

import collections
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
import test_operators as plain
from docspark.llm import minhash, secrets, tokens
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    home = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, sf_dir)
        frame.write.parquet(str(home / name))
        out.append((docs, spark.read.parquet(str(home / name))))
        docs = out[-1][1]
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def test_columns_and_order(stages):
    assert list(stages) == ["language_id", "near_duplicates", "secret_scan", "mix_sources", "pack_sequences"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_clean_documents_stay_and_decisions_take_effect(stages):
    before, after = stages["language_id"]
    assert after.count() >= 0.97 * before.count()
    before, after = stages["near_duplicates"]
    groups = {r.doc_id: r.group_id for r in minhash.near_groups(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))
    before, after = stages["secret_scan"]
    assert before.count() == after.count()
    for r in after.collect():
        assert not secrets.find_secrets(r.text) and r.n_chars == len(r.text)
    before, after = stages["mix_sources"]
    assert max(collections.Counter(r.doc_id for r in after.collect()).values()) <= 2
    before, after = stages["pack_sequences"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, short and long texts, ties, repeated rows, and columns with names used inside."""
    long = " ".join(f"wort{i % 700} der und" for i in range(20_000))
    same = "the same words again and again, password = abcdef123456 " * 8
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34 !?", "en", "a", 8), (4, long, "de", "b", len(long)), (5, same, "en", "b", len(same)),
        (5, same, "en", "b", len(same)), (6, same, None, None, None), (None, same, "de", None, None), (None, None, None, None, None),
        (7, "ein kurzer text", "de", "ä", 15), (8, "a short text", "en", "ä", 12), (8, "a short text", "en", "a", 12),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("lang_pred", "lang_score", "lang_trigrams", "secrets", "found_language", "scan_of_text", "row_key", "row_turn", "copies", "size", "target", "node", "node_", "id_kept", "label", "band", "__x", "Secrets_"):
        frame = frame.withColumn(name, F.concat(F.lit(name), F.coalesce("text", F.lit("")).substr(1, 3)))
    return frame


def rows_of(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_stages_on_odd_rows(spark, odd):
    stage, whole = dict(corpus_pipeline.STAGES), rows_of(odd)
    for name in list(stage)[:-1]:
        out = stage[name](spark, odd, "")
        assert out.columns == odd.columns, name
        assert stage[name](spark, odd.limit(0), "").count() == 0
    known = rows_of(stage["language_id"](spark, odd, ""))
    assert known == {r: n for r, n in whole.items() if r[0] not in (1, 2, 3) and r[1]}
    kept = rows_of(stage["near_duplicates"](spark, odd, ""))
    assert set(kept) <= set(whole) and set(kept.values()) == {1}
    assert collections.Counter((r[0], (r[1] or "")[:5]) for r in kept) == collections.Counter([(None, ""), (3, "12 34"), (4, "wort0"), (None, "the s"), (7, "ein k"), (8, "a sho")])
    scanned = rows_of(stage["secret_scan"](spark, odd, ""))
    cleaned = collections.Counter()
    for r, n in whole.items():
        text = secrets.redacted(r[1], secrets.find_secrets(r[1])) if r[1] else r[1]
        cleaned[(r[0], text, *r[2:4], len(text) if text != r[1] else r[4], *r[5:])] += n
    assert scanned == cleaned and "[SECRET]" in str(scanned) and "abcdef123456" not in str(scanned)
    taken = rows_of(stage["mix_sources"](spark, odd, ""))
    assert set(taken) <= {r for r in whole if r[1]} and all(n <= 2 * whole[r] for r, n in taken.items())
    pieces = stage["pack_sequences"](spark, odd, "").collect()
    assert collections.Counter(p.doc_id for p in pieces if p.start == 0) == collections.Counter(r[0] for r in odd.collect())
    assert stage["pack_sequences"](spark, odd.limit(0), "").count() == 0


def test_short_documents_stay_and_long_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, letters = np.random.default_rng(9), list("abcdefghijklmnopqrstuvwxyz")
    words = lambda n: " ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(n))
    short = {900_000 + i: t for i, t in enumerate(["Avec.", "Edrere.", "Lllldoado.", "Onhaha sh.", "A."])}
    junk = {910_000 + i: words(400) for i in range(40)}
    made = [(i, t, "en", "web", len(t)) for i, t in (short | junk | {920_000: "12 34 !?"}).items()]
    both = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, "").select("doc_id").collect()}
    assert set(short) <= kept and not kept & set(junk) and 920_000 not in kept
    assert len(kept & {r.doc_id for r in docs.select("doc_id").collect()}) >= 0.99 * docs.count()


def test_run_and_empty_tables(spark, sf_dir, stages, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["pack_sequences"][1].count()
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_language(rows):
    """doc_ids that stay, by trigrams bound and added one by one, with plain medians; and those too near a limit to tell."""
    vectors = {}

    def vector(letter):
        if letter not in vectors:
            vectors[letter] = plain.plain_vector(letter)
        return vectors[letter]

    def bundle(text):
        letters = [0]
        for c in text:
            s = ord(c.lower()[0]) if c.isalpha() else 0
            if s or letters[-1]:
                letters.append(s)
        letters += [0] if letters[-1] else []
        count = collections.Counter(zip(letters, letters[1:], letters[2:], strict=False)) if any(letters) else {}
        total = np.zeros(1024, np.int64)
        for (a, b, c), n in count.items():
            total += n * (np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c))
        return total, sum(count.values())

    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _, _ in rows}
    bundles = {i: bundle(t or "") for i, t, _, _ in rows}
    sums = collections.defaultdict(lambda: np.zeros(1024, np.int64))
    for i, _, lang, _ in rows:
        if not held[i] and lang is not None:
            sums[lang] += bundles[i][0]
    found = {}
    for i, (b, n) in bundles.items():
        if n:
            cosine = {lang: float(b @ s / np.linalg.norm(b) / np.linalg.norm(s)) for lang, s in sums.items()}
            best = max(sorted(cosine), key=cosine.get)
            found[i] = best, max(0.0, cosine[best]), n
    classes = collections.defaultdict(list)
    for i, _, lang, _ in rows:
        if held[i] and i in found and found[i][0] == lang:
            classes[math.ceil(math.log2(found[i][2] + 1))].append(found[i][1])
    least = {c: 0.2 * sorted(s)[math.ceil(len(s) / 2) - 1] for c, s in classes.items() if len(s) >= 5 and 1 << (c - 1) >= 64}
    stay, unsure = set(), set()
    for i, (_, score, n) in found.items():
        own = [c for c in least if c <= math.ceil(math.log2(n + 1))]
        limit = least[max(own)] if own else 0.0
        if abs(score - limit) < 1e-4 and limit:
            unsure.add(i)
        elif score >= limit:
            stay.add(i)
    return stay, unsure


def plain_redaction(text):
    spans = plain.base_spans(text)
    for m in re.finditer(r"(?:gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", text):
        if secrets.checksum62(m[1]) == m[2]:
            spans.append(("token", *m.span()))
    cover = np.zeros(len(text) + 1, bool)
    starts = {a for _, a, _ in spans}
    for _, a, b in spans:
        cover[a:b] = True
    out, i = [], 0
    while i < len(text):
        if cover[i]:
            out.append("[SECRET]")
            i += 1
            while cover[i] and not (i in starts and not any(a < i < b for _, a, b in spans)):
                i += 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_run_equals_a_plain_program(spark, sf_dir):
    """The whole run against plain loops over the same documents: who stays, what their texts become, how much of each
    source is taken, and every id of every copy."""
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    stay, unsure = plain_language(rows)
    assert not unsure
    texts = {i: t for i, t, _, _ in rows if i in stay}
    classes = plain.classes_by_brute_force(texts)
    kept = {i: plain_redaction(texts[i]) for i in set(classes.values())}
    source = {i: s for i, _, _, s in rows}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in kept.items()}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    wanted = plain.targets_by_sharing(sizes)
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    cover = {}
    sequences = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        ids = [*tokenizer.encode(kept[r.doc_id], add_special_tokens=False).ids, 1]
        assert list(r.ids) == ids[r.start : r.start + r.length] and len(r.ids) == r.length and r.doc_tokens == len(ids)
        cover.setdefault(r.doc_id, np.zeros(len(ids), int))[r.start : r.start + r.length] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = {i: int(c[0]) for i, c in cover.items()}
    assert all((c == copies[i]).all() and 1 <= copies[i] <= 2 for i, c in cover.items())
    taken = collections.Counter()
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    assert all(abs(taken[s] - want) <= max(2, 0.01 * want) for s, want in wanted.items())
    for parts in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [at for at, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048
