"""Batches of pages are converted and sent back in parts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark import functions as fn
from docspark.functions import converters
from docspark.markup import convert
from docspark.plans.queries import QUERIES


def test_parts_are_small_and_whole():
    texts = [None, "", "a" * 1000, "b" * (converters.PART_CHARS + 5), None, *["c" * 300] * 5000]
    for kind in (pa.string(), pa.large_string()):
        parts = list(converters.parts(pa.array(texts, kind)))
        assert [t for p in parts for t in p] == texts
        assert all(len(p) <= converters.PART_PAGES and sum(len(t or "") for t in p[:-1]) < converters.PART_CHARS for p in parts)
    assert list(converters.parts(pa.array([], pa.string()))) == []


def test_a_batch_does_not_pile_up_in_the_worker(spark):
    """The worker has at most a part of the pages of a batch of 3,000 under way."""
    made = []
    source = iter([pa.array(["<p>x</p>"] * 3000)])
    sizes = []
    for a in converters.converter(lambda t: made.append(t) or convert.to_markdown(t)).func(source):
        assert len(a) == len(made) <= converters.PART_PAGES
        sizes.append(len(a))
        made.clear()
    assert sum(sizes) == 3000


def test_rows_stay_with_their_pages(spark):
    """More pages than a part has, long and short, null and broken ones, with two converters in one projection."""
    pages = spark.range(0, 3000, 1, 2).withColumn("xhtml", F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, "<p>").otherwise(F.concat(F.lit("<p>"), F.repeat(F.col("id").cast("string"), (F.col("id") % 500).cast("int")), F.lit("y</p>"))))
    got = pages.select("id", "xhtml", fn.to_markdown("xhtml").alias("a"), fn.storage_hash("xhtml", "xhtml").alias("b"), fn.storage_blocks("xhtml", "xhtml").alias("c")).collect()
    assert len(got) == 3000
    for r in got:
        want = convert.to_markdown(r.xhtml)
        assert r.a.markdown == want["markdown"] and (r.a.error and r.a.error["class"]) == (want["error"] and want["error"]["class"]) and r.b.hash == convert.hashed(r.xhtml, "xhtml")[0] == r.c.hash


def test_passes_are_the_conversions_one_after_another(spark):
    texts = ["# a\n\n- b\n", None, "", "x <b>y</b> *z*\n"]
    steps = ["to_storage", "storage_to_jira", "from_jira", "markdown_to_jira"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in frame.select("t", fn.passes("t", steps).alias("p")).collect():
        x = convert.to_storage(r.t)["xhtml"]
        w = convert.to_jira(x, source_format="xhtml")["jira_wiki"]
        m = convert.from_jira(w)["markdown"]
        assert r.p == [x, w, m, convert.to_jira(m, source_format="markdown")["jira_wiki"]]
    assert frame.select(fn.passes(F.lit("<p>"), ["to_markdown", "to_storage"]).alias("p")).first().p == [None, None]
    with pytest.raises(ValueError):
        fn.passes("t", ["to_pdf"])


def test_fixed_points_takes_few_workers(spark, sf_dir):
    plan = QUERIES["fixed_points"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3
