"""From raw documents to packed sequences: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import language, minhash, mixing, packing, secrets
from docspark.llm.common import ensure_checkpoint_dir, fresh

ORACLE_SQL = None
#: Texts of fewer trigrams are not judged; longer ones need this share of the median score of held-out ones as long.
LEAST_TRIGRAMS, LEAST_SHARE, LEAST_HELD_OUT = 64, 0.2, 5


def length_class(trigrams: str):
    """Number of binary digits of the number of trigrams."""
    return F.ceil(F.log2(F.col(trigrams) + 1)).cast("int")


def least_scores(docs: DataFrame, prototypes: dict) -> dict[int, float]:
    """By length class, the score to reach: from held-out documents whose language is found; a row for each class."""
    found = language.identify(docs.filter(language.held_out()).select("text", "lang"), prototypes).filter("lang_pred = lang")
    medians = found.groupBy(length_class("lang_trigrams").alias("c")).agg(F.percentile_approx("lang_score", 0.5).alias("m"), F.count(F.lit(1)).alias("n")).collect()
    return {r.c: LEAST_SHARE * r.m for r in medians if r.n >= LEAST_HELD_OUT and 1 << (r.c - 1) >= LEAST_TRIGRAMS}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those like no language that the labelled documents show.

    The score grows with the length of a text, so each is held against that of documents of its length; a class of
    few held-out documents takes the least score of the next shorter one, and short texts stay. Null and empty texts
    have no letters and go; copies share one fate; a null doc_id or lang changes nothing else. Without any labelled
    document only those without letters go. All columns pass, whatever their names; an empty table gives no rows.
    """
    prototypes = language.profiles(docs.filter(~language.held_out()))
    names = pred, score, trigrams = fresh(docs, "lang_pred", "lang_score", "lang_trigrams")
    found = language.identify(docs, prototypes, tuple(names))
    least = F.lit(0.0)
    for c, lowest in sorted(least_scores(docs, prototypes).items()):
        least = F.when(length_class(trigrams) >= c, F.lit(lowest)).otherwise(least)
    known = (F.col(pred) != language.UNKNOWN) & (F.col(score) >= least)
    if not prototypes:  # nothing to learn from: only documents without letters go
        known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.filter(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least doc_id.

    Null doc_ids come first, null texts count as empty and are copies of each other, of equal rows one stays. All
    columns pass, whatever their names; an empty table gives no rows.
    """
    return minhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts, whole texts of any length; every document stays, n_chars follows.

    Null and empty texts stay as they are, equal rows stay equal. Other columns pass, whatever their names; an empty
    table gives no rows.
    """
    (spans,) = fresh(docs, "secrets")
    return secrets.scan(docs, redact=True, name=spans).drop(spans)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one more source; null and empty texts have no words and are never taken; equal rows share what
    is taken of them. All columns pass, whatever their names; an empty table gives no rows.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, by sequence and offset.

    Null and empty texts are the end id alone, repeated rows are packed as often as they occur, a null doc_id stays
    null. Other columns are not looked at; an empty table gives no rows.
    """
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared checkpoint folder, and taken away when
    the next stage is written. The last one's rows stay there, as the frame reads them."""
    ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{jvm.java.util.UUID.randomUUID()}"
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{home}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if done is not None:
            old = jvm.org.apache.hadoop.fs.Path(done)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        docs, done = spark.read.parquet(path), path
    return docs
