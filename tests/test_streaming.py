"""Stateless and windowed steps over streams of pages."""

import datetime as dt

from pyspark.sql import functions as F

from docspark import functions as fn
from docspark.streaming import convert

START = dt.datetime(2024, 1, 1)
SCHEMA = "page_id long, ts timestamp, xhtml string"


def replayed(spark, folder, rows, step, mode="append"):
    """The step over a stream that gets the rows in two runs; far rows at the end close all windows."""
    runs = [rows[: len(rows) // 2], [*rows[len(rows) // 2 :], (-1, START + dt.timedelta(days=30), "<p>end</p>")], [(-2, START + dt.timedelta(days=60), "<p>end</p>")]]
    for part in runs:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        run = step(stream).writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_repeated_versions_are_left_out(spark, tmp_path):
    rows = [(1, START, "<p>a</p>"), (1, START + dt.timedelta(minutes=1), "<p>a<br/></p>"), (2, START, "<p>a</p>"), (1, START + dt.timedelta(minutes=2), "<p>b</p>"), (1, START + dt.timedelta(minutes=3), "<p>b</p>"), (2, START + dt.timedelta(minutes=4), "<p>a</p>")]
    step = lambda s: convert.new_versions(s.withColumn("canonical", fn.canonical_storage("xhtml")["xhtml"]))
    got = replayed(spark, tmp_path, rows, step).filter("page_id > 0").select("page_id", "canonical").collect()
    assert sorted(map(tuple, got)) == [(1, "<p>a</p>"), (1, "<p>b</p>"), (2, "<p>a</p>")]


def test_edits_are_counted_by_window(spark, tmp_path):
    rows = [(i % 3, START + dt.timedelta(minutes=m), "<p/>") for i, m in enumerate([0, 1, 4, 5, 6, 14, 15, 3])]
    got = replayed(spark, tmp_path, rows, convert.edits_by_window).filter(F.col("window.start") < F.lit(START + dt.timedelta(days=1))).collect()
    assert {(r.window.start - START).seconds // 60: r.n for r in got} == {0: 4, 5: 2, 10: 1, 15: 1}


def test_a_stream_is_converted_as_a_table_is(spark):
    pages = spark.createDataFrame([(1, "# a\n"), (2, None), (3, "- b\n")], "page_id long, markdown string")
    got = convert.convert_stream(spark, pages, "markdown", lambda c: fn.to_storage(c, nodes=False)["xhtml"], "xhtml")
    assert {r.page_id: r.xhtml for r in got.collect()} == {1: "<h1>a</h1>", 2: None, 3: "<ul><li>b</li></ul>"}
