"""Converters over streams: they hold no state, so they run unchanged; only removing repeats keeps any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def converted(pages: DataFrame, source: str, convert: Callable[[str], Column], name: str) -> DataFrame:
    """(page_id, name) of a static or streaming frame of pages."""
    return pages.select("page_id", convert(source).alias(name))


def convert_stream(spark: SparkSession, pages: DataFrame, source: str, convert: Callable[[str], Column], name: str) -> DataFrame:
    """Writes the pages to a folder, reads it as a stream, converts it once and gives the rows written."""
    home = shared_folder(spark, "stream")
    pages.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(pages.schema).parquet(f"{home}/in")
    run = converted(stream, source, convert, name).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out")


def new_versions(stream: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Pages of a stream (page_id, ts, xhtml hash in `canonical`) without repeats of a version inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["page_id", "canonical"])


def edits_by_window(stream: DataFrame, *, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """How many pages changed in each window of time."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
