"""Every registered query of the library against its SQL, and operators on edge cases."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docspark.operators import assets
from docspark.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if x != x or x is None else x for x in r]) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    numeric = [c for c in ours.columns if ours[c].dtype.kind in "if"]
    for c in numeric:
        ours[c], theirs[c] = ours[c].astype("float64"), theirs[c].astype("float64")
    assert rows(ours) == rows(theirs)


def test_unsafe_names_are_reported_and_missing_files_stay(spark, tmp_path):
    text = '![a](../x.png)<!-- docspark:asset src="../x.png" --> ![b](y.png "t")<!-- docspark:asset src="y.png" --> ![c](z.png)<!-- docspark:asset src="z.png" -->'
    pages = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "page_id long, markdown string")
    files = spark.createDataFrame([(1, "../x.png", b"1"), (1, "y.png", b"2")], "page_id long, filename string, bytes binary")
    got = {r.page_id: r for r in assets.resolve_assets(pages, files).collect()}
    assert got[1].asset_error == "parent directory segment"
    assert "(../x.png)" in got[1].markdown and '(assets/y.png "t")' in got[1].markdown and "(z.png)" in got[1].markdown
    assert got[2].markdown == "none" and got[2].asset_error is None
    assets.write_assets(files.filter("filename = 'y.png'"), str(tmp_path))
    assert (tmp_path / "1" / "y.png").read_bytes() == b"2"


def test_conversion_runs_once_when_filtered(spark):
    from docspark.functions import to_markdown

    pages = spark.range(50).withColumn("xhtml", F.when(F.col("id") % 2 == 0, "<p>x</p>").otherwise("<p>"))
    plan = pages.withColumn("r", to_markdown("xhtml")).filter("r.error IS NULL").select("id", "r.markdown")
    assert plan.count() == 25
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1


def test_odd_pages_and_files_are_resolved(spark):
    """Repeated pages and files, any character in the text, extra columns with names used inside, nulls."""
    text = 'a\x02b ![x](y.csv)<!-- docspark:asset src="y.csv" -->\x02$1\\ ![](y.csv)<!-- docspark:asset src="y.csv" --> end <!-- docspark:asset src="y.csv" -->'
    rows = [(1, text, "one", "s"), (1, "other", "two", "s"), (2, text, None, None), (None, text, "n", "s"), (3, None, "m", "s")]
    pages = spark.createDataFrame(rows, "page_id long, markdown string, src string, target string")
    files = spark.createDataFrame([(1, "y.csv", b"2"), (1, "y.csv", b"1"), (1, "y.csv", None), (2, "y.csv", None), (None, "y.csv", b"3")], "page_id long, filename string, bytes binary")
    for mode, link in (("sidecar", "assets/y.csv"), ("inline", "data:text/csv;base64,MQ==")):
        got = assets.resolve_assets(pages, files, mode=mode)
        assert got.columns == [*pages.columns, "asset_error"]
        want = [(1, text.replace("(y.csv)", f"({link})"), "one", "s", None), *[(*r, None) for r in rows[1:]]]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert assets.resolve_assets(pages.limit(0), files).count() == 0 and assets.resolve_assets(pages, files.limit(0)).count() == 5


def test_media_types(spark):
    from docspark import functions as fn
    from docspark.markup.assets import media_type

    names = ["a.csv", "a.PNG", "d.e/f.mp4", "x.tar.gz", "x.tgz", "x.json", "x.gz", "x", "x.unknown", ".html", "x.svg", "x.html.Z"]
    frame = spark.createDataFrame([(n,) for n in names], "n string").withColumn("b", F.encode(F.lit("1"), "UTF-8"))
    got = {r.n: r.u for r in frame.select("n", fn.data_uri("n", "b").alias("u")).collect()}
    assert got == {n: f"data:{media_type(n)};base64,MQ==" for n in names}
    assert [media_type(n) for n in names[:6]] == ["text/csv", "image/png", "video/mp4", "application/x-tar", "application/x-tar", "application/json"]
    assert media_type("x.gz") == media_type("x.unknown") == "application/octet-stream"


def test_macros_with_code_of_their_own():
    from docspark.markup import convert
    from docspark.markup.macros import DEFAULT_MACROS, Macro
    from docspark.markup.tree import MacroError, Node
    from docspark.markup.xml import Element

    def read(el, blocks):
        body = [k for k in el.elements() if k.local == "rich-text-body"]
        if not body:
            return None
        if el.get("ac:name") == "status" and not body[0].kids:
            raise MacroError("an empty status")
        return Node("directive", blocks(body[0].kids), attrs={"name": "status", "has_body": "true"}, params=[("state", "read")])

    def write(node, blocks):
        return Element("ac:structured-macro", {"ac:name": "status", "state": dict(node.params)["state"]}, blocks(node.kids))

    macros = DEFAULT_MACROS.with_macro(Macro("status", "status", read=read, write=write))
    page = '<ac:structured-macro ac:name="status"><ac:rich-text-body><p>{}</p></ac:rich-text-body></ac:structured-macro>'.format("up")
    there = convert.to_markdown(page, macros=macros)["markdown"]
    assert '::: status state="read"\nup\n:::' in there
    assert convert.to_storage(there, macros=macros)["xhtml"] == '<ac:structured-macro ac:name="status" state="read"><p>up</p></ac:structured-macro>'
    assert "docspark:opaque" in convert.to_markdown('<ac:structured-macro ac:name="status"/>', macros=macros)["markdown"]
    assert convert.to_markdown('<ac:structured-macro ac:name="status"><ac:rich-text-body/></ac:structured-macro>', macros=macros)["error"]["class"] == "MacroError"
    assert convert.from_jira("* a\n# b\n* c\n")["warnings"] == ["2 list items after a change of the kind of list are left out"]
