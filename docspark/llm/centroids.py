"""Centroid clustering by plain Lloyd rounds over integer vectors, exact on every cluster layout."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

CLUSTERS, ROUNDS, SCALE, SIZE, SEED = 16, 3, 64, 64, 1
LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    # the squared distance of two such vectors fits a long
    most = math.isqrt((1 << 62) // max(size, 1)) // 2
    x = F.col("embedding").cast("array<double>")
    fits = F.forall(x, lambda v: v.isNotNull() & (F.abs(v * float(scale)) <= float(most)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).filter((F.size("vector") == size) & fits)


def integers(rows, scale: int) -> np.ndarray:
    return np.floor(np.array([np.asarray(r, np.float64) for r in rows]) * scale).astype(np.int64)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row; of equally near ones the smallest number."""
    square = np.empty((len(centroids), len(x)), np.int64)
    for i, c in enumerate(centroids):
        apart = x - c
        np.einsum("nd,nd->n", apart, apart, out=square[i])
    best = square.argmin(axis=0)
    return best, square[best, np.arange(len(x))]


def lloyd(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): clusters of vectors (vec_id, embedding).

    A component x counts as floor(scale * x). Centroids start as the vectors with the smallest SHA-256 of
    `seed:vec_id`; in each round every vector goes to the nearest (squared distance, then smaller number), and each centroid
    that has vectors moves to the exact floor of their mean. At the end all vectors are dealt once more.

    Vectors that are null, of another size or hold null or non-finite components take no part, nor do those with components
    so large that a squared distance could leave a long. Each repeated row counts. Rows without vec_id are clustered, but
    start a centroid only when no others are left; rows with one vec_id start in order of their vectors. With fewer vectors
    than clusters there are as many centroids; an empty table gives no rows. A sum beyond a long is null. Other columns,
    whatever their names, are not looked at.

    A round reads the vectors once and shuffles only a partition's sums. The driver holds clusters x size numbers; the
    last assignment (three numbers a vector) is cut before its distances are added up.
    """
    spark = vectors.sparkSession
    x = whole_vectors(vectors, size, scale)
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vector"]
    first = [r["vector"] for r in x.orderBy(*order).limit(clusters).collect()]
    centroids = integers(first, scale) if first else np.empty((0, size), np.int64)

    for _ in range(rounds if first else 0):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(frames, sent=sent):
            held = sent.value
            total = np.zeros((len(held), size + 1), np.int64)
            for frame in frames:
                if len(frame):
                    part = integers(frame["vector"], scale)
                    to, _ = nearest_centroid(part, held)
                    np.add.at(total, to, np.concatenate([part, np.ones((len(part), 1), np.int64)], axis=1))
            used = np.flatnonzero(total[:, -1])
            yield pd.DataFrame({"cluster": used.astype(np.int32), "sums": [total[i] for i in used]})

        parts = x.select("vector").mapInPandas(sums, "cluster int, sums array<long>")
        merged = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found = {(r["cluster"], r["at"]): int(r["s"]) for r in merged.collect()}
        sent.unpersist()
        moved = centroids.copy()
        for i in range(len(centroids)):
            if (i, size) in found:
                moved[i] = [found[i, d] // found[i, size] for d in range(size)]
        centroids = moved

    final = spark.sparkContext.broadcast(centroids)

    def assign(frames):
        for frame in frames:
            if len(frame):
                to, distance = nearest_centroid(integers(frame["vector"], scale), final.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": to.astype(np.int32), "distance": distance})

    dealt = cut(x.mapInPandas(assign, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["s"]) for r in dealt.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fitting = lambda n: n if n <= LONG else None
    rows = [(c, fitting(s), fitting(sum(inertia.values())), [int(v) for v in centroids[c]]) for c, s in sorted(inertia.items())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return dealt.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op12_centroids(spark, sf_dir):
    found = lloyd(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.withColumn("centroid_sha256", digest).drop("centroid")
