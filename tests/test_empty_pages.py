"""Documents without a line, whose pages or fragments are empty, against the SQL."""

import duckdb
import pytest

from docspark.markup import convert
from docspark.markup.xml import parse_fragment, write
from docspark.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    made = tmp_path_factory.mktemp("empty")
    duckdb.execute(f"COPY (SELECT i AS doc_id, 'web' AS source, t AS text FROM (VALUES (1, ''), (2, ' '), (3, chr(10) || ' ' || chr(10)), (4, 'a <b>'), (5, '')) v(i, t)) TO '{made}/documents.parquet' (FORMAT parquet)")
    return str(made)


def agree(spark, documents, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}/documents.parquet'")
    ours = QUERIES[name](spark, documents)
    return sorted(map(tuple, ours.collect())) == sorted(con.execute(ORACLE_SQL[name]).df()[ours.columns].itertuples(index=False, name=None))


def test_an_empty_page_is_empty_markdown(spark, documents):
    assert convert.to_markdown("") == convert.result(markdown="", attachments=[], nodes=[])
    assert convert.to_markdown("", nodes=False)["nodes"] is None
    assert agree(spark, documents, "marks_to_markdown")


@pytest.mark.parametrize("name", ["opaque_round_trip", "opaque_to_markdown"])
def test_empty_fragments_are_those_of_the_sql(spark, documents, name):
    assert agree(spark, documents, name)


def test_empty_elements_are_written_as_they_were_read():
    for xml in ("<x/>", "<x></x>", '<x a="/"></x>', '<x a="/"/>', "<a><x/></a>", "<a><x></x><y/></a>", "<a>é<y/><x></x>é</a>", "<x><![CDATA[]]></x>"):
        assert "".join(map(write, parse_fragment(xml).elements())) == xml
    # beyond the pieces of 1 MB that the parser is fed
    long = "<r>" + "é<x></x><y/>" * 150_000 + "</r>"
    assert write(parse_fragment(long).elements()[0]) == long
    page = '<ac:structured-macro ac:name="chart"><ac:parameter ac:name="k"></ac:parameter><ac:parameter ac:name="l"/></ac:structured-macro><p>see <ac:link><ri:user></ri:user></ac:link></p>'
    there = convert.to_markdown(page)["markdown"]
    assert convert.to_storage(there)["xhtml"] == page
    assert convert.to_markdown(convert.to_storage(there)["xhtml"])["markdown"] == there
    assert convert.canonical("<p>a<b></b></p>")["xhtml"] == convert.canonical("<p>a<b/></p>")["xhtml"]
