"""Page folders and shared working folders."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"md": "markdown", "markdown": "markdown", "xhtml": "xhtml", "xml": "xhtml", "cfx": "xhtml", "wiki": "jira_wiki", "txt": "jira_wiki"}


def read_pages(spark: SparkSession, path: str, *, format: str | None = None) -> DataFrame:
    """(page_id, format, body) of the files below a path, a whole file each; page_id is the file's address."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("page_id", F.input_file_name())
    ending = F.lower(F.regexp_extract("page_id", r"\.([A-Za-z]+)$", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), ending)
    return files.select("page_id", (F.lit(format) if format else known).alias("format"), F.col("value").alias("body"))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, filename, bytes) of files laid out as page_id/filename below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("page_id"), F.element_at(parts, -1).alias("filename"), F.col("content").alias("bytes"))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors share, below the session's checkpoint folder; a local one only for a local session."""
    sc = spark.sparkContext
    home = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if home is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        home = tempfile.mkdtemp(prefix="docspark-")
    return f"{home}/{purpose}-{sc._jvm.java.util.UUID.randomUUID()}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written to a new shared folder and read again: what is used twice is made once, and lost executors cost
    no second run. The folder stays until whoever set it clears it."""
    home = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(home)
    return frame.sparkSession.read.parquet(home)
