"""Groups of documents: cut by bytes, null and repeated ids over many groups, with unchanged results."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from docspark.llm import common, fingerprints, repeats


@pytest.fixture()
def skewed(spark):
    """20,000 short texts, then 60 of a thousand times their size, 150 without an id and 150 of one id."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(400)])
    rows = [(int(i), " ".join(words[rng.integers(0, 400, 2)])) for i in rng.permutation(20_000)]
    rows += [(20_000 + i, " ".join(words[rng.integers(0, 400, 2000)])) for i in range(60)]
    passage = " ".join(words[rng.integers(0, 400, 30)])
    for id_ in (None, 7):
        rows += [(id_, " ".join([*words[rng.integers(0, 400, rng.integers(0, 80))], passage, *words[rng.integers(0, 400, 300)]])) for _ in range(150)]
    rows += [(20_100, passage), (20_101, None), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def sizes_of(docs):
    ranges, out = common.doc_ranges(docs), {}
    for r in common.packed(docs, ranges).collect():
        out[r.g] = out.get(r.g, 0) + sum(len(x) for x in common.from_blob(r.blob)["text"].to_pylist())
    return ranges, out


def test_groups_are_cut_by_bytes(skewed, monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", 40_000)
    ranges, sizes = sizes_of(skewed)
    assert sorted(sizes) == list(range(len(ranges))) and max(sizes.values()) <= 40_000
    assert len(ranges) <= 2 * sum(sizes.values()) / 40_000 + 4
    shared = collections.Counter(ranges.level.tolist())
    assert shared[0] > 3 and len([n for n in shared.values() if n > 1]) == 2  # null ids, and the repeated one


def test_one_long_text_has_a_group_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", 1000)
    rows = [(i, "x" * (100_000 if i == 50 else 90)) for i in range(100)]
    _, sizes = sizes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(sizes.values())[-1] == 100_000 and sorted(sizes.values())[-2] <= 1000


def test_groups_of_an_empty_table_and_of_null_ids_only(spark):
    assert len(common.doc_ranges(spark.createDataFrame([], "doc_id long, text string"))) == 0
    _, sizes = sizes_of(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string"))
    assert sizes == {0: 1}


@pytest.mark.parametrize("find", [repeats.remove_repeated_words, repeats.remove_repeated_bytes])
def test_split_ids_leave_results_unchanged(skewed, monkeypatch, find):
    docs = skewed.filter("doc_id IS NULL OR doc_id = 7 OR doc_id >= 19900")
    got = []
    for most in (40_000, 8 << 20):
        monkeypatch.setattr(common, "GROUP_BYTES", most)
        rows = find(docs).collect()
        got.append(sorted((r[0] if r[0] is not None else -1, r[1], str(r.removed), hashlib.sha256(r.kept if isinstance(r.kept, bytes | bytearray) else r.kept.encode()).hexdigest()) for r in rows))
    assert got[0] == got[1] and len(got[0]) == docs.count()
    assert any(d == 7 and spans != "[]" for d, _, spans, _ in got[0])


def test_next_documents_over_split_ids(skewed, monkeypatch):
    """Each document but the first is the next one of exactly one other: the edited text ends with its start."""
    monkeypatch.setattr(common, "GROUP_BYTES", 40_000)
    docs = skewed.filter("doc_id IS NULL OR doc_id = 7 OR doc_id >= 19900")
    rows = docs.collect()
    ranges = common.doc_ranges(docs)
    parts = {r.text: r.part for r in docs.select("text", common.text_part().alias("part")).collect()}
    group = ranges.groups(np.array([r.doc_id or 0 for r in rows]), np.array([r.doc_id is None for r in rows]), np.array([parts[r.text] for r in rows]))
    order = sorted(zip(group.tolist(), rows, strict=True), key=lambda x: (x[0], x[1].doc_id is not None, x[1].doc_id or 0, x[1].text or ""))
    want = []
    for i, (_, r) in enumerate(order):
        text, after = r.text or "", order[i - 1][1].text or ""
        m = len(text) // 3
        want.append((r.doc_id or -1, len(text), hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()))
    got = [(r.doc_id or -1, r.n_chars, r.edited_sha256) for r in fingerprints.with_next(docs).collect()]
    assert sorted(got) == sorted(want)


def test_fingerprints_are_sent_in_parts(spark, monkeypatch):
    """A group's rows leave the worker a few at a time, and the query's rows end before the arrays."""
    monkeypatch.setattr(fingerprints, "SENT_CHARS", 1 << 9)
    rows = [(i, f"text {i} " * (i % 50)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    whole = fingerprints.with_next(docs).collect()
    monkeypatch.setattr(fingerprints, "packed", lambda docs, ranges, lend_last: Sent(common.packed(docs, ranges, lend_last=lend_last), sent))
    fingerprints.with_next(docs)
    assert sum(sent) == 300 and max(sent) < 100 and len(sent) > 10
    monkeypatch.undo()
    got = fingerprints.with_next(docs, arrays=False)
    assert got.columns == [c.split()[0] for c in fingerprints.DIGEST.split(", ")]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r)[: len(got.columns)] for r in whole)


class Sent:
    """Stands for a frame of groups: notes how many rows each batch of a group's answer has."""

    def __init__(self, groups, sent):
        self.groups, self.sent = groups, sent

    def groupBy(self, _):  # noqa: N802
        return self

    def applyInArrow(self, compare, _):  # noqa: N802
        blobs = [bytes(r.blob) for r in self.groups.collect()]
        self.sent += [b.num_rows for b in compare(iter([pa.record_batch({"blob": pa.array(blobs, pa.binary())})]))]
