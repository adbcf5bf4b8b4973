"""Table functions that read pages, against the node arrays of the converters."""

import pytest

from docspark import functions as fn
from docspark.functions import blocks
from docspark.operators import nodes

MARKDOWN = '# a *b*\n\n- x\n  - y\n\n| c | d |\n| --- | --- |\n| 1 | [l](u "t") |\n\n::: note title="q"\nbody\n:::\n\n> z\n'


@pytest.fixture
def pages(spark):
    blocks.register(spark)
    frame = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, None), (1, "again\n"), (None, "n\n"), (4, "x\n\n" * 3000)], "page_id long, markdown string")
    frame.createOrReplaceTempView("block_pages")
    return frame


def rows(frame, names):
    return sorted(repr([r[n] for n in names]) for r in frame.collect())


def test_both_functions_give_the_nodes_of_the_converters(spark, pages):
    want = nodes.explode_nodes(pages.select("page_id", fn.to_storage("markdown")["nodes"].alias("nodes")))
    names = want.columns
    lateral = spark.sql("SELECT p.page_id, b.* FROM block_pages AS p, LATERAL parse_blocks(p.markdown, 'markdown') AS b")
    whole = spark.sql("SELECT * FROM page_blocks(TABLE(block_pages))")
    assert rows(lateral, names) == rows(want, names) == rows(whole, names)
    assert spark.sql("SELECT * FROM page_blocks(TABLE(SELECT * FROM block_pages WHERE page_id = 9))").count() == 0


def test_all_formats_and_texts_that_can_not_be_read(spark, pages):
    xhtml, wiki = "<h1>t</h1><p>a<br/>b</p>", "h1. t\n\n* a\n** b\n"
    for text, name, run in ((xhtml, "xhtml", fn.to_markdown), (wiki, "jira_wiki", fn.from_jira)):
        frame = spark.createDataFrame([(1, text)], f"page_id long, {name} string")
        frame.createOrReplaceTempView("one_page")
        want = nodes.explode_nodes(frame.select("page_id", run(name)["nodes"].alias("nodes")))
        assert rows(spark.sql("SELECT * FROM page_blocks(TABLE(one_page))"), want.columns) == rows(want, want.columns)
    bad = spark.sql("SELECT * FROM parse_blocks('<p>', 'xhtml')").collect()
    assert [(r.kind, r.id) for r in bad] == [("error", 0)] and "well-formed" in bad[0].text
    for wrong in ("SELECT * FROM parse_blocks('x', 'word')", "SELECT * FROM parse_blocks(1, 'xhtml')", "SELECT * FROM page_blocks(TABLE(SELECT 1 AS a))", "SELECT * FROM page_blocks(TABLE(SELECT 1 AS page_id, '' AS xhtml, '' AS markdown))"):
        with pytest.raises(Exception, match="format|text|table"):
            spark.sql(wrong).collect()
