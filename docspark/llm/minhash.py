"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, hashed_words, mix64, release, rolling_hash, small_batches, table, unique_sorted

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 16, 3, 1
SAMPLES = BANDS * ROWS
#: Each of a shingle's three draws comes from a table of 2^14 rows, in steps of 1/6 where it is only bounded.
SLOT_BITS, STEPS = 14, 6.0
#: Shingles are evaluated in full while they may be below this many expected minima.
ENOUGH = 6.0
#: Words whose document frequency is broadcast at most, and words that a task counts at a time.
HELD, COUNTED = 1 << 21, 1 << 21
#: Bits of the filter by which texts without a bucket mate are left out before texts move.
FILTER_BITS = 26
LIGHT = "array<struct<word:bigint,n:bigint>>"


def node_of(text: str = "text"):
    """The number of a text: 64 bits of its SHA-256, the same for null and empty; n texts meet with chance n^2 / 2^65."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")


class Idf:
    """ln(1 + N / df) by word hash, df the number of documents that have the word.

    Held are the hashes, ascending, and frequencies of words of at least `least` documents. A word that is not held
    is one of a single document, unless the list that comes with the text, its light words, has another frequency.
    """

    def __init__(self, n_docs: int, hashes: np.ndarray, df: np.ndarray, least: int = 2):
        self.n_docs, self.hashes, self.df, self.least = max(1, n_docs), hashes, df, least
        # the last value looked up for each of 2^16 hash ranges; at first none that belongs there
        self.kept, self.values = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16)
        self.kept[0] = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __getstate__(self):
        return self.n_docs, self.hashes, self.df, self.least

    def __setstate__(self, state):
        self.__init__(*state)

    def held(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is held, and its frequency: 1 if not."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return found, np.where(found, self.df[at], 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """IDF of each word, light words apart."""
        place = (hashes >> np.uint64(48)).astype(np.int64)
        out = self.values[place]
        missed = np.flatnonzero(self.kept[place] != hashes)
        if len(missed):
            new, at = hashes[missed], place[missed]
            out[missed] = np.log1p(self.n_docs / self.held(new)[1])
            self.kept[at], self.values[at] = new, out[missed]
        return out

    def with_light(self, hashes: np.ndarray, values: np.ndarray, light) -> np.ndarray:
        """The values, with those of the light words (hashes, frequencies) of the text."""
        if light is None or not len(light[0]):
            return values
        order = np.argsort(light[0])
        own, df = light[0][order], light[1][order]
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        return np.where(own[at] == hashes, np.log1p(self.n_docs / df[at]), values)


def light_of(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray] | None:
    if not value.is_valid:
        return None
    return value.values.field("word").to_numpy().view(np.uint64), value.values.field("n").to_numpy()


def shingles(hashes: np.ndarray, values: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their weights: occurrences times the mean IDF of the words.

    A text of fewer words is one shingle; a text without words has none.
    """
    if not len(hashes):
        return np.empty(0, np.uint64), np.empty(0, np.float64)
    n = min(words, len(hashes))
    runs = rolling_hash(hashes, n)
    weights = values[: len(runs)].copy()
    for i in range(1, n):  # always in this order, so that a shingle weighs the same to the last bit wherever it stands
        weights += values[i : i + len(runs)]
    weights /= n
    order = np.argsort(runs, kind="stable")
    runs, weights = runs[order], weights[order]
    new = np.ones(len(runs), bool)
    np.not_equal(runs[1:], runs[:-1], out=new[1:])
    if not new.all():
        first = np.flatnonzero(new)
        runs, weights = runs[first], weights[first] * np.diff(np.append(first, len(runs)))
    return runs, weights


def shingled(texts: list[str], idf: Idf, lights=None):
    """Shingles and weights of each text, in order."""
    for first, hashes, ends in hashed_words(texts, lower=True):
        values, start = idf.of(hashes), 0
        for i, end in enumerate(ends.tolist(), first):
            own = hashes[start:end]
            part = values[start:end]
            yield shingles(own, part if lights is None else idf.with_light(own, part, lights[i]))
            start = end


def shingles_of(text: str, idf: Idf, light=None) -> tuple[np.ndarray, np.ndarray]:
    return next(shingled([text], idf, [light]))


@cache
def draws() -> tuple[np.ndarray, ...]:
    """r, beta and ln c for each row and sample (r and c by Gamma(2, 1), beta uniform), and steps at or above r and at
    or below ln c."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    shape = (1 << SLOT_BITS, SAMPLES)
    r, beta, c = (draw(shape) for draw in (lambda s: rng.standard_gamma(2.0, s, np.float32), lambda s: rng.random(s, np.float32), lambda s: np.log(rng.standard_gamma(2.0, s, np.float32))))
    over, under = np.ceil(r * STEPS), np.floor(c * STEPS)
    assert over.max() <= 107 and under.min() >= -128  # over + 20 and under fit a byte
    return r, beta, c, over.astype(np.int8), under.astype(np.int8)


def weighted_samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Improved consistent weighted sampling: sample k is the shingle with the least a_k and its level t_k.

    t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1). Two sets agree in a sample with the chance of their
    weighted Jaccard similarity. r, beta and c of a shingle are drawn from tables by three separate parts of its hash;
    two shingles share all three with chance 2^-42, and keep their identity in the sample even then. Of equal a the
    least hash wins.

    As ln a >= ln c - ln w - r, only shingles for which that bound is below the value that the minimum rarely exceeds
    are evaluated. A sample for which none is below it is found from all shingles, so the result is that of all.
    """
    r, beta, c, over, under = draws()
    slot = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))
    row_mask = np.uint64((1 << SLOT_BITS) - 1)
    rows = [((slot >> np.uint64(s)) & row_mask).astype(np.int64) for s in (0, 20, 40)]
    logs = np.log(weights).astype(np.float32)
    limit = np.float32(np.log(ENOUGH / weights.sum()))
    bound = np.clip(np.ceil((logs + limit) * STEPS) + 1, -128, 20).astype(np.int8)
    r_at, beta_at, c_at = (x * SAMPLES for x in rows)

    def evaluate(i, k):
        step, shift = r.take(r_at.take(i) + k), beta.take(beta_at.take(i) + k)
        t = np.floor(logs.take(i) / step + shift)
        return c.take(c_at.take(i) + k) - step * (t - shift + 1), t

    parts = []
    for at in range(0, len(hashes), 4096):
        most = over.take(rows[0][at : at + 4096], axis=0)
        most += bound[at : at + 4096, None]
        may = np.flatnonzero(under.take(rows[2][at : at + 4096], axis=0) <= most)
        i = may // SAMPLES
        k = may - i * SAMPLES
        i += at
        a, t = evaluate(i, k)
        low = np.flatnonzero(a <= limit)
        parts.append((a.take(low), i.take(low), k.take(low), t.take(low)))
    a, i, k, t = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
    chosen, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    order = np.argsort(a, kind="stable")
    order = order[np.argsort(k[order].astype(np.int8), kind="stable")]
    k = k[order]
    first = np.flatnonzero(np.concatenate([k[:1] >= 0, k[1:] != k[:-1]]))
    best = order[first]
    chosen[k[first]], level[k[first]] = hashes[i[best]], t[best]
    if len(first) < SAMPLES:
        every = np.arange(len(hashes))
        for missing in np.setdiff1d(np.arange(SAMPLES), k[first]).tolist():
            a, t = evaluate(every, missing)
            least = int(a.argmin())
            chosen[missing], level[missing] = hashes[least], t[least]
    return (mix64(chosen ^ mix64(level.astype(np.int64).view(np.uint64))) >> np.uint64(33)).astype(np.int32)


def band_keys():
    """Keys of the bands of `samples`; texts that share one are bucket mates."""
    at = lambda i: F.element_at("samples", i + 1)
    return F.array(*[F.xxhash64(F.lit(b), *[at(b * ROWS + i) for i in range(ROWS)]) for b in range(BANDS)])


def shared_weight(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    return float(np.minimum(a[1][at[both]], b[1][both]).sum())


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    shared = shared_weight(a, b)
    return shared / float(a[1].sum() + b[1].sum() - shared)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): the hash of each word and the number of documents that have it; counted in tasks before it is dealt."""

    def count(batches):
        waiting, held = [], 0

        def counted():
            words, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, np.uint64), np.empty(0, np.int64))
            return pa.record_batch({"word": pa.array(words.view(np.int64)), "n": pa.array(n)})

        for b in batches:
            for _, hashes, ends in hashed_words([t or "" for t in b.column(0).to_pylist()], lower=True):
                start = 0
                for end in ends.tolist():
                    own = np.sort(hashes[start:end])
                    start = end
                    if len(own):
                        new = np.ones(len(own), bool)
                        np.not_equal(own[1:], own[:-1], out=new[1:])
                        waiting.append(own[new])
                        held += len(waiting[-1])
                if held > COUNTED:
                    yield counted()
                    waiting, held = [], 0
        yield counted()
        release()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def held_idf(counted: DataFrame, n_docs: int) -> Idf:
    """Holds all words of two documents or more, or as many of the most frequent ones as HELD allows."""
    top = 1 << 16
    sizes = {r["n"]: r["words"] for r in counted.filter("n > 1").groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()}
    least, room = top + 1, HELD
    for n in sorted(sizes, reverse=True):
        room -= sizes[n]
        if room < 0:
            break
        least = n
    else:
        least = 2
    # from `top` on frequencies share a line above; if even those are too many, none is held and all are joined
    held = counted.filter(F.col("n") >= least).toArrow() if least <= top else None
    if held is None or not held.num_rows:
        return Idf(n_docs, np.empty(0, np.uint64), np.empty(0, np.int64), least if least <= top else 1 << 62)
    hashes = held["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Idf(n_docs, hashes[order], held["n"].to_numpy()[order], least)


def word_idf(docs: DataFrame) -> Idf:
    """Exact for the words that are held; for others see `with_light_words`."""
    return held_idf(document_frequencies(docs), docs.count())


def with_light_words(texts: DataFrame, counted: DataFrame, idf) -> DataFrame:
    """(node, text, light): the words of each text that are not held but in several documents, with their frequency.

    Words and frequencies meet in a join. A word that is not held is in few documents, so no word is hot, and a text
    with many copies has no such words. Copies become one row, if any light words are looked for.
    """
    if idf.value.least <= 2:
        return texts.withColumn("light", F.lit(None).cast(LIGHT))

    def spread(batches):
        for b in batches:
            nodes = b.column(0).to_numpy()
            for first, hashes, ends in hashed_words(b.column(1).to_pylist(), lower=True):
                start = 0
                for i, end in enumerate(ends.tolist(), first):
                    own = unique_sorted(hashes[start:end])
                    own = own[~idf.value.held(own)[0]]
                    yield pa.record_batch({"node": pa.array(np.full(len(own), nodes[i])), "word": pa.array(own.view(np.int64))})
                    start = end

    several = counted.filter((F.col("n") > 1) & (F.col("n") < idf.value.least))
    light = texts.mapInArrow(spread, "node long, word long").join(several, "word")
    light = cut(light.groupBy("node").agg(F.collect_set(F.struct("word", "n")).alias("light")))
    return texts.dropDuplicates(["node"]).join(light, "node", "left").select("node", "text", F.col("light").cast(LIGHT).alias("light"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by alternating large and small stars.

    Only least neighbours are aggregated, so no task ever holds a node's neighbours; each round is checkpointed. It
    is done when no node has two parents or is parent and child at once.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
        ends = ends.unionAll(edges.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        ends = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        roots = ends.select("n", F.col("n").alias("label")).filter("child = 0")
        if not ends.filter("child + parent > 1 AND child > 0").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots.select(F.col("n").alias("node"), "label"))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct())


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node (number of the text), label (number of the class), group_id (its least doc_id), group_size of every row.

    Texts are nodes; two texts are linked if their weighted Jaccard similarity is at least `similarity`, and a class
    is a connected component, so exact copies always share one. Null text counts as empty; texts without words are
    linked to their exact copies only. A class whose doc_ids are all null has a null group_id. An empty table gives
    no rows; other columns are not looked at. Bands are laid out for a similarity of 0.8: a pair at the threshold
    shares none with a chance of about 1 in 100,000; less is refused.

    Candidates share a band. In each bucket one text, that with most bucket mates, is compared with all others, so
    a group of copies costs a star, not all its pairs. Buckets that still hold several classes are left with pairs of
    different classes. Such two share at most what each shares with the star, and of the rest what other texts have
    too, and they must share 4/9 of their joint weight. The pairs that this bound leaves are compared in full, so of
    the candidates no link is lost and every link is exact.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"bands are laid out for a similarity of {SIMILARITY} or more")
    spark = docs.sparkSession
    docs = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = cut(document_frequencies(docs))
    idf = spark.sparkContext.broadcast(held_idf(counted, docs.count()))
    keyed = docs.select("doc_id", node_of().alias("node"))
    weighed = with_light_words(docs.select(node_of().alias("node"), "text"), counted, idf)

    def sign(batches):
        for b in batches:
            lights = None if b.column(2).null_count == len(b) else [light_of(x) for x in b.column(2)]
            samples, weight, rows = [], [], []
            for i, (h, w) in enumerate(shingled(b.column(1).to_pylist(), idf.value, lights)):
                if len(h):
                    samples.append(weighted_samples(h, w))
                    weight.append(float(w.sum()))
                    rows.append(i)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SAMPLES)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(samples) if samples else np.empty(0, np.int32)))
            yield pa.record_batch({"node": b.column(0).take(pa.array(rows, pa.int64())), "weight": pa.array(weight, pa.float64()), "samples": lists})
        release()

    signed = weighed.mapInArrow(sign, "node long, weight double, samples array<int>")
    nodes = cut(signed.dropDuplicates(["node"]))
    banded = nodes.select("node", F.explode(band_keys()).alias("band"))
    full = banded.groupBy("band").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    members = cut(banded.join(full, "band"))
    met = members.groupBy("node").agg(F.sum("mates").alias("met"))
    stars = members.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node")).alias("s")).select("band", F.col("s.node").alias("star"))
    members = cut(members.join(stars, "band"))
    met = members.select("node").distinct()
    texts = cut(only_these(weighed, met))
    pairs = members.filter("node <> star").select(F.col("star").alias("a"), F.col("node").alias("b")).distinct()
    found = cut(compared(pairs, texts, idf))
    label = components(found.filter(F.col("similarity") >= similarity))

    # buckets whose texts are in several classes; of two texts in a bucket one is the star
    several = placed_at(members.filter("mates > 2"), label)
    apart = several.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band")
    several = cut(several.join(apart, "band", "left_semi").select("band", "node", "star", "label"))
    own = own_weights(texts.join(several.select("node"), "node", "left_semi"), idf)
    known = nodes.join(own, "node").select("node", "weight", (F.col("weight") - F.col("own")).alias("common"), band_keys().alias("bands"))
    some = several.join(known.filter(F.col("common") >= (similarity - 1e-6) * F.col("weight")), "node")
    some = some.join(found.select(F.col("a").alias("star"), F.col("b").alias("node"), "shared"), ["star", "node"])
    a, b = some.alias("a"), some.alias("b")
    need = (F.col("a.weight") + F.col("b.weight")) * (similarity / (1 + similarity) - 1e-6)
    most = F.least("a.shared", "b.shared") + F.least(F.col("a.common") - F.col("a.shared"), F.col("b.common") - F.col("b.shared"))
    possible = (F.col("a.label") < F.col("b.label")) & (most >= need)
    once = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.band")  # each pair in one band only
    rest = a.join(b, (F.col("a.band") == F.col("b.band")) & possible & once)
    rest = rest.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.label").alias("x"), F.col("b.label").alias("y"))
    more = cut(compared(rest, texts, idf).filter(F.col("similarity") >= similarity).select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = placed_at(keyed, label)
    if more.limit(1).count():
        joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("joined"))
        placed = placed.join(joined, "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined")
    sizes = placed.groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    placed = placed.join(cut(sizes.filter("n > 1")), "label", "left")  # cut, so that a large class can be split here
    group_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return placed.select("doc_id", "node", "label", group_id.alias("group_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"))


def placed_at(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows with their class so far; a text without links is its own."""
    return rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def only_these(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each of the nodes. Most others are left out by a bit for each of 2^26 values before rows move; the
    filter has a fixed size and lets some rows through, which the join then takes out. Copies meet in tasks first."""
    bit = F.col("node").bitwiseAND((1 << FILTER_BITS) - 1) + 1
    bits = nodes.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("bit"))
    parts = bits.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    size = 4096  # bytes of a part
    found = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for p in parts:
        found[(p["part"] - 1) * size : p["part"] * size] = np.frombuffer(p["bits"], np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(found)

    def pick(batches):
        mask = (1 << FILTER_BITS) - 1
        for b in batches:
            at = b.column(0).to_numpy() & mask
            yield b.filter(pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return rows.mapInArrow(pick, rows.schema).dropDuplicates(["node"]).join(nodes, "node", "left_semi")


def own_weights(texts: DataFrame, idf) -> DataFrame:
    """(node, own): the weight of a text's shingles that no other of these texts has."""

    def spread(batches):
        for b in batches:
            nodes, lights = b.column(0).to_numpy(), [light_of(x) for x in b.column(2)]
            for node, (h, w) in zip(nodes, shingled(b.column(1).to_pylist(), idf.value, lights), strict=True):
                yield pa.record_batch({"shingle": pa.array(h.view(np.int64)), "node": pa.array(np.full(len(h), node)), "weight": pa.array(w.astype(np.float32))})
        release()

    each = texts.select("node", "text", "light").mapInArrow(spread, "shingle long, node long, weight float")
    single = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).filter("n = 1")
    # a float's error in the sum is made up for, so that the bound stays one
    parts = single.select("node", (F.col("weight").cast("double") * (1 - 1e-6)).alias("w")).unionAll(texts.select("node", F.lit(0.0).alias("w")))
    return parts.groupBy("node").agg(F.sum("w").alias("own"))


def compared(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The rows of pairs (a, b, ...) with their similarity and the weight they share, from their whole texts."""

    def compare(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            names, similar, weight = batch.schema.names, [], []
            first, x, y, u, v = (batch.column(names.index(c)) for c in ("a", "__x", "__y", "__u", "__v"))
            seconds = shingled(y.to_pylist(), idf.value, [light_of(i) for i in v])
            for node, text, light, second in zip(first.to_pylist(), x, u, seconds, strict=True):
                if node not in held:
                    held = {node: shingles_of(text.as_py(), idf.value, light_of(light))}
                shared = shared_weight(held[node], second)
                weight.append(shared)
                similar.append(shared / (held[node][1].sum() + second[1].sum() - shared))
            out = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(similar, pa.float64()), pa.array(weight, pa.float64())], names=[*columns, "similarity", "shared"])
        release()

    columns = pairs.columns
    rows = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("__y"), F.col("light").alias("__v")), "b")
    rows = rows.join(texts.select(F.col("node").alias("a"), F.col("text").alias("__x"), F.col("light").alias("__u")), "a")
    return rows.select(*columns, "__x", "__y", "__u", "__v").mapInArrow(compare, pairs.withColumn("similarity", F.lit(0.0)).withColumn("shared", F.lit(0.0)).schema)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the least doc_id stays.

    Null doc_ids come first; of rows that agree in doc_id and text one stays. All columns are kept, whatever their names.
    """
    found = near_groups(docs, similarity)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "node")
    node, own, id_, known = fresh(docs, "node_", "node_kept", "id_kept", "id_known")
    best = found.groupBy("label").agg(F.min(order).alias("d"))
    best = best.select(F.col("d.node").alias(own), F.coalesce("d.doc_id", F.lit(0)).alias(id_), F.col("d.known").alias(known))
    rows = docs.withColumn(node, node_of())
    same = (F.col(node) == F.col(own)) & (F.coalesce("doc_id", F.lit(0)) == F.col(id_)) & (F.col("doc_id").isNotNull() == F.col(known))
    return rows.join(best, same).dropDuplicates([own, id_, known]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_minhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size")
