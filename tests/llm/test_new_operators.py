"""Pieces, centroids and hard negatives against the library, brute force and SQL, and on edge cases."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import centroids, negatives, pieces
from docspark.llm.queries import ORACLE_SQL, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, part int, rows binary"


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path(pieces.PIECES))


def random_texts(n, seed=1):
    r = random.Random(seed)
    signs = ["abcdefgh ", "  \t\n▁aé\x00", "the of and in er on <s>", "日本語éü \U0001f600ßЖдорова", "▁ ", "aA 0123456789.,;'", "etaoinshrdlu"]
    return ["".join(r.choice(s) for _ in range(r.randrange(60))) for s in r.choices(signs, k=n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 -----------------------------------------------------------------------------------------------------


def test_prefix_table_gives_the_library_s_ids(model):
    texts = random_texts(3000)
    held = pieces.PieceEncoder(pieces.vocabulary_path(pieces.PIECES))
    assert [x.tolist() for x in held.encode_all(texts)] == model.encode(texts)
    assert [held.table.text_ids(t) for t in texts] == model.encode(texts)


def test_each_prefix_has_the_last_token_of_its_own_encoding(model):
    held = pieces.PrefixTable(pieces.vocabulary_path(pieces.PIECES))
    for text in ["▁representation", "▁the▁▁▁cat", "abcabcabcaba", "▁internationalization"]:
        last = held.last_tokens(text)
        assert [held.names[t] for t in last[1:]] == [held.merged(text[:i])[-1] for i in range(1, len(text) + 1)]


def test_a_full_memory_changes_no_id(model):
    texts = random_texts(400, 2) + ["x" * 5000, "ab " * 3000, "語" * 4000, "q" * 127 + " " + "q" * 129]
    held = pieces.PieceEncoder(pieces.vocabulary_path(pieces.PIECES), most=20)
    for _ in range(2):
        assert [x.tolist() for x in held.encode_all(texts)] == model.encode(texts)


def test_decoding_is_the_library_s(model):
    r, back = random.Random(3), pieces.PieceDecoder(pieces.vocabulary_path(pieces.PIECES))
    for _ in range(4000):
        ids = [r.randrange(model.get_piece_size()) if r.random() < 0.4 else r.randrange(270) for _ in range(r.randrange(12))]
        assert back.decode(np.array(ids, np.int64)) == model.decode(ids)
    with pytest.raises(ValueError):
        back.decode(np.array([-1]))


def test_op11_equals_the_library_on_the_whole_table(spark, sf_dir, model):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = model.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    got = QUERIES["op11_pieces"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_pieces_on_odd_rows(spark, model):
    long = "".join(random.Random(5).choices("abcdefg hij\n", k=600_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, long, None), (4, "one two", "x"), (4, "one two", "x"), (None, "\x00 \t é", None), (5, "z" * 100_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1))
    got = pieces.encode(docs, with_decoded=True).collect()
    want = [(i, model.encode(t or "", add_eos=True), (t or "")) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, pieces.decode(pieces.encode(docs)).collect()))) == sorted(repr((i, t)) for i, _, t in want)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 264, None]), (None, [229, 148, 264])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(odd).collect()} == {1: None, 2: "", 3: "a", None: model.decode([229, 148, 264])}
    assert pieces.encode(docs.limit(0)).count() == 0 and pieces.ids_digest([5, 2]) == sha("5 2")


# --- 12 -----------------------------------------------------------------------------------------------------


def by_sql(sf_dir, name, rows=None):
    con = duckdb.connect()
    if rows is None:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    else:
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
        con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    found = con.execute(ORACLE_SQL[name])
    return [d[0] for d in found.description], found.fetchall()


def check_sql(frame, sf_dir, name, rows=None):
    names, want = by_sql(sf_dir, name, rows)
    got = [tuple(r) for r in frame.select(*names).collect()]
    assert sorted(got) == sorted(want) and len(got)


def plain_lloyd(rows, k, rounds, scale, size):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, sha(f"1:{kept[n][0]}"), kept[n][1]))
    centers = [kept[n][1] for n in order[:k]]

    def deal():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        to = deal()
        for j in range(len(centers)):
            mine = [v for (_, v), (_, t) in zip(kept, to, strict=True) if t == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    to = deal()
    of = {j: sum(d for d, t in to if t == j) for _, j in to}
    return sorted((repr((i, t, d, of[t], sum(of.values()), centers[t])) for (i, _), (d, t) in zip(kept, to, strict=True)))


def test_op12_equals_sql(spark, sf_dir):
    check_sql(QUERIES["op12_centroids"](spark, sf_dir), sf_dir, "op12_centroids")


@pytest.mark.parametrize("size,k", [(2, 4), (3, 50), (1, 1)])
def test_lloyd_on_odd_rows(spark, size, k):
    r = random.Random(size)
    rows = [(i, [r.choice([0.0, 0.5, -0.3, 1.25, 7.0]) for _ in range(size)]) for i in range(40)]
    rows += [(50, None), (51, []), (52, [None] * size), (53, [float("nan")] * size), (54, [float("inf")] * size), (55, [1.0] * (size + 1)), (None, [0.25] * size), (None, [0.25] * size)]
    rows += [(60, [2.0] * size)] * 30 + [(61, [-0.001] * size), (61, [0.001] * size)]
    frame = spark.createDataFrame([(i, v, None, "c", 1, None) for i, v in rows], VECTORS).repartition(3)
    got = centroids.lloyd(frame, clusters=k, size=size)
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_lloyd(rows, k, 3, 64, size)
    assert centroids.lloyd(frame.limit(0), clusters=k, size=size).count() == 0
    assert centroids.centroid_digest([1, -2]) == sha("1,-2")


def test_vectors_too_large_for_a_long_take_no_part(spark):
    frame = spark.createDataFrame([(1, [3e38]), (2, [1.0]), (3, [-3.5e7])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in centroids.lloyd(frame, clusters=1, rounds=0, size=1).collect()) in ([(2, 0), (3, (64 + int(3.5e7 * 64)) ** 2)], [(2, (64 + int(3.5e7 * 64)) ** 2), (3, 0)], [(2, 0)])


# --- 13 -----------------------------------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=10, every=100, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(np.float64(x) * scale)) for x in v]
            held = kept.get((i, len(w)))
            kept[i, len(w)] = min(filter(None, [held, (label, np.array(w, "<i4").tobytes(), w)]))
    out = []
    for (a, dim), (label, _, v) in kept.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for (i, d), (other, _, w) in kept.items() if d == dim and i != a]
        for s, p, _ in sorted(x for x in scores if x[2])[:positives]:
            fit = sorted((t, i) for t, i, same in scores if not same and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


def test_op13_equals_sql(spark, sf_dir):
    check_sql(QUERIES["op13_hard_negatives"](spark, sf_dir), sf_dir, "op13_hard_negatives")


@pytest.mark.parametrize("dim,scale,sizes", [(4, 256, (16, 8, 3)), (9, 3, (64, 50, 200)), (3, 2_000_000, (40, 8, 3)), (2, 60_000_000, (40, 8, 3))])
def test_negatives_on_odd_rows(spark, monkeypatch, dim, scale, sizes):
    """Many small tiles, every kind of number, ties, repeats, sizes that differ."""
    for name, value in zip(("LEAST_SHARD", "CHUNK", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives, "PART", 7)
    r = random.Random(dim)
    rows = [(i * 10, [r.choice([0.0, 1.0, 0.5, r.random(), -r.random()]) for _ in range(dim)], r.randrange(3)) for i in range(160)]
    rows += [(i * 100 + 7, rows[i][1], 5) for i in range(20)] + rows[:30] + [(100, [0.75] * dim, 1), (100, [-0.75] * dim, 1), (100, [0.75] * dim, 0)]
    rows += [(None, [1.0] * dim, 1), (200_000, None, 1), (300_000, [None] * dim, 1), (400_000, [float("nan")] * dim, 1), (500_000, [1.0] * dim, None), (600_000, [], 1), (700_001, [], 2)]
    rows += [(800_000 + i * 50, [0.9] * (dim + 1), i % 2) for i in range(8)]
    frame = spark.createDataFrame([(i, v, y, "c", 1, None) for i, v, y in rows], VECTORS).repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = negatives.hard_negatives(frame, scale=scale)
    assert sorted(map(tuple, got.collect())) == plain_negatives(exact, scale=scale)
    assert negatives.hard_negatives(frame.limit(0)).count() == 0


def test_intervals_drop_candidates_and_no_result():
    r = np.random.default_rng(1)
    rows, anchors = r.integers(-130, 130, (3000, 16)), r.integers(-130, 130, (20, 16))
    exact = anchors @ rows.T
    for kind in (np.float32, np.float64, np.int64):
        left = []

        def keep(a, r, low, high, left=left):
            assert (low <= exact[a, r]).all() and (exact[a, r] <= high).all()
            left.append(len(a))
            return high >= 60_000

        a, b, score = negatives.products(anchors, negatives.Planes(rows, kind), np.ones(exact.shape, bool), keep)
        assert (score == exact[a, b]).all() and set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= 60_000)), strict=True))
        assert left[0] == exact.size and left[-1] < exact.size / 10


# --- 8: stripes of queries ----------------------------------------------------------------------------------


def test_neighbours_do_not_depend_on_stripes(spark, monkeypatch):
    from docspark.llm import ann

    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=8 if i % 3 else 5).astype(float).tolist()) for i in range(700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = frame.filter("vec_id % 5 = 0")
    monkeypatch.setattr(ann, "SHARD_ROWS", 150)
    want = sorted(map(tuple, ann.nearest(frame, asked, 4).collect()))
    monkeypatch.setattr(ann, "STRIPE", 20)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, ann.nearest(frame, asked, 4).collect())) == want
