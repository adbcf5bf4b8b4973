"""Queries over the reference operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions.native import is_refused
from ..markup.options import Options
from ..operators import assets, nodes, publish
from ..streaming.convert import convert_stream
from .pages import DOCUMENTS, documents, each, lines, read, wiki_literal, xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
M = Options().marker
# DuckDB expressions
MD = r"regexp_replace({0}, '([\\`*_\[\]|])', '\\\1', 'g')"
WIKI = r"regexp_replace({0}, '([*_{{\[\]|~+^])', '\\\1', 'g')"
XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ID = "'op-' || substr(sha256({0}), 1, 8)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def joined(items: str, before: str, after: str, write: str) -> str:
    """SQL for `each`."""
    return f"array_to_string(list_transform({items}, lambda x: '{before}' || {write.format('x')} || '{after}'), '')"


NL = "' || chr(10) || '"


def markdown_pages(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("page_id", F.concat(F.lit("# "), fn.escape_markdown("title"), F.lit("\n\n"), each("lines", "- ", "\n", fn.escape_markdown)).alias("markdown"))


def xhtml_pages(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    level = (F.col("page_id") % 6 + 1).cast("string")
    return d.select("page_id", F.concat(F.lit("<h"), level, F.lit(">"), xml(F.col("title")), F.lit("</h"), level, F.lit(">"), each("lines", "<p>", "</p>", xml)).alias("xhtml"))


# --- conversions --------------------------------------------------------------------------------------------


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, '<h1>' || {XML.format('title')} || '</h1>' || CASE WHEN len(lines) > 0 THEN '<ul>' || {joined('lines', '<li>', '</li>', XML)} || '</ul>' ELSE '' END AS xhtml FROM d")
def markdown_to_storage(spark, sf_dir):
    return markdown_pages(spark, sf_dir).select("page_id", fn.to_storage("markdown", nodes=False)["xhtml"].alias("xhtml"))


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, repeat('#', CAST(page_id % 6 + 1 AS INT)) || ' ' || {MD.format('title')} || {joined('lines', NL + NL, '', MD)} || chr(10) AS markdown FROM d")
def storage_to_markdown(spark, sf_dir):
    return xhtml_pages(spark, sf_dir).select("page_id", fn.to_markdown("xhtml", nodes=False)["markdown"].alias("markdown"))


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, 'h1. ' || {WIKI.format('title')} || CASE WHEN len(lines) > 0 THEN chr(10) || {joined('lines', NL + '* ', '', WIKI)} ELSE '' END || chr(10) AS jira_wiki FROM d")
def markdown_to_jira(spark, sf_dir):
    return markdown_pages(spark, sf_dir).select("page_id", fn.to_jira("markdown", nodes=False)["jira_wiki"].alias("jira_wiki"))


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, 'h' || [1,2,2,3,4,5][CAST(page_id % 6 + 1 AS INT)] || '. ' || {WIKI.format('title')} || {joined('lines', NL + NL, '', WIKI)} || chr(10) AS jira_wiki FROM d")
def storage_to_jira(spark, sf_dir):
    return xhtml_pages(spark, sf_dir).select("page_id", fn.to_jira("xhtml", source_format="xhtml", nodes=False)["jira_wiki"].alias("jira_wiki"))


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, '## Page ' || page_id || CASE WHEN len(lines) > 0 THEN chr(10) || {joined('lines', NL + '- ', '', MD)} ELSE '' END || chr(10) AS markdown FROM d")
def jira_to_markdown(spark, sf_dir):
    d = documents(spark, sf_dir)
    wiki = F.concat(F.lit("h2. Page "), F.col("page_id").cast("string"), F.lit("\n\n"), each("lines", "* ", "\n", wiki_literal))
    return d.select("page_id", fn.from_jira(wiki, nodes=False)["markdown"].alias("markdown"))


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, '# ' || {MD.format('title')} || CASE WHEN len(lines) > 0 THEN chr(10) || {joined('lines', NL + '- ', '', MD)} ELSE '' END || chr(10) AS markdown FROM d")
def normalized_markdown(spark, sf_dir):
    d = documents(spark, sf_dir)
    loose = F.concat(F.lit("  "), fn.escape_markdown("title"), F.lit("\n=====\n\n"), each("lines", "* ", "\n", fn.escape_markdown))
    return d.select("page_id", fn.normalize_markdown(loose)["markdown"].alias("markdown"))


CANON = f"'<h2>' || {XML.format('title')} || '</h2>' || CASE WHEN len(lines) > 0 THEN '<ul>' || {joined('lines', '<li>', '</li>', XML)} || '</ul>' ELSE '' END"


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, {CANON} AS canonical FROM d")
def canonical_pages(spark, sf_dir):
    """Noise that the canonical form leaves out: volatile attributes, decorated spans, wrapped items, blanks."""
    d = documents(spark, sf_dir)
    noisy = F.concat(
        F.lit('<h2 style="text-align: left" data-uuid="'), F.col("page_id").cast("string"), F.lit('"><span style="color: red">'), xml(F.col("title")), F.lit("</span><br/></h2>\n<p> <br/></p>\n"),
        F.when(F.size("lines") > 0, F.concat(F.lit('<ul class="wrapped">\n'), each("lines", "  <li><p>", "</p></li>\n", xml), F.lit("</ul>\n"))).otherwise(""),
    )
    return d.select("page_id", fn.canonical_storage(noisy)["xhtml"].alias("canonical"))


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, CAST(1 AS BIGINT) AS headings, CAST(len(lines) AS BIGINT) AS items, CASE WHEN len(lines) > 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS lists FROM d")
def node_kinds(spark, sf_dir):
    p = markdown_pages(spark, sf_dir).select("page_id", fn.to_storage("markdown")["nodes"].alias("nodes"))
    each_kind = nodes.explode_nodes(p).groupBy("page_id").pivot("kind", ["heading", "list_item", "list"]).count()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return each_kind.select("page_id", zero("heading").alias("headings"), zero("list_item").alias("items"), zero("list").alias("lists"))


@query(
    "WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)"
    " SELECT conv_id AS page_id, CAST(turn AS VARCHAR) || ' ' || role AS title, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL"
)
def outline(spark, sf_dir):
    pages = conversation_pages(spark, sf_dir).select("page_id", fn.to_storage("markdown")["nodes"].alias("nodes"))
    return nodes.headings(pages).groupBy("page_id", "title").agg(F.count(F.lit(1)).alias("n"))


def conversation_pages(spark, sf_dir) -> DataFrame:
    """A page for each conversation, a section for each turn."""
    turns = read(spark, sf_dir, "conversations")
    body = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n\n"), each(lines("text"), "", "\n\n", fn.escape_markdown))
    parts = turns.groupBy(F.col("conv_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", body.alias("body")))).alias("parts"))
    return parts.select("page_id", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("markdown"))


@query(
    "SELECT conv_id AS page_id, CAST(turn AS VARCHAR) || ' ' || role AS section, CAST(sum(len(list_filter(list_transform(string_split(text, chr(10)),"
    " lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''))) AS BIGINT) AS blocks FROM conversations GROUP BY ALL HAVING blocks > 0"
)
def section_blocks(spark, sf_dir):
    pages = conversation_pages(spark, sf_dir).select("page_id", fn.to_storage("markdown")["nodes"].alias("nodes"))
    return nodes.sections(pages).groupBy("page_id", "section").agg(F.count(F.lit(1)).alias("blocks"))


@query("SELECT page_id, 'ParseError' AS error_class FROM pages")
def refused_pages(spark, sf_dir):
    """Raw web pages hold a DOCTYPE: each gives an error value, none stops the job."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", fn.to_markdown("html", nodes=False)["error"]["class"].alias("error_class"))


@query("SELECT page_id, regexp_matches(html, '(?i)<!(DOCTYPE|ENTITY)\\b') AS refused FROM pages")
def refused_natively(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", is_refused("html").alias("refused"))


WANTED = f"CASE WHEN len(lines) > 0 THEN rtrim({joined('lines', '', NL + NL, WIKI)}, chr(10)) || chr(10) ELSE '' END"


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, CAST(NULL AS VARCHAR) AS jira_wiki, CAST(0 AS BIGINT) AS n_warnings FROM d WHERE page_id % 2 = 0 UNION ALL SELECT page_id, {WANTED}, 0 FROM d WHERE page_id % 2 = 1")
def jira_section(spark, sf_dir):
    """A section by name: pages with odd ids have it."""
    d = documents(spark, sf_dir)
    name = F.when(F.col("page_id") % 2 == 1, "Wanted").otherwise("Other")
    page = F.concat(F.lit("intro\n\n## "), name, F.lit("\n\n"), each("lines", "", "\n\n", fn.escape_markdown), F.lit("## Next\n\nrest\n"))
    r = d.select("page_id", fn.to_jira(page, section="Wanted", nodes=False).alias("r"))
    return r.select("page_id", "r.jira_wiki", F.size("r.warnings").cast("long").alias("n_warnings"))


# --- string steps -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {MD.format('text')} AS markdown, {WIKI.format('text')} AS wiki, text AS back FROM documents")
def escapes(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    back = fn.unescape_jira(fn.escape_jira(F.replace("text", F.lit("\\"), F.lit("\\\\"))))
    return d.select("doc_id", fn.escape_markdown("text").alias("markdown"), fn.escape_jira("text").alias("wiki"), back.alias("back"))


@query(
    f"WITH d AS (SELECT doc_id, '<p>' || {XML.format('text')} || '</p>' AS x FROM documents)"
    f" SELECT doc_id, {ID.format('x')} AS fragment, '[' || 'doc' || '](cfx:' || {ID.format('x')} || ')' AS link,"
    f" '<!-- {M}:opaque id=\"' || {ID.format('x')} || '\" -->' || chr(10) || '```cfx-storage' || chr(10) || x || chr(10) || '```' || chr(10) || '<!-- /{M}:opaque -->' AS block FROM d"
)
def fragments(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<p>"), xml(F.col("text")), F.lit("</p>")).alias("x"))
    return d.select("doc_id", fn.fragment_id("x").alias("fragment"), fn.write_fragment_link(F.lit("doc"), "x").alias("link"), fn.write_fragment("x").alias("block"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS authentic FROM documents")
def fragment_authentication(spark, sf_dir):
    """Every second block claims an id that is not its hash."""
    d = read(spark, sf_dir, "documents")
    body = F.concat(F.lit("<p>"), xml(F.col("text")), F.lit("</p>"))
    block = fn.write_fragment(body)
    forged = F.regexp_replace(block, 'id="op-[0-9a-f]{8}"', 'id="op-00000000"')
    shown = F.concat(F.lit("before\n\n"), F.when(F.col("doc_id") % 2 == 0, block).otherwise(forged), F.lit("\n\nafter\n"))
    return d.select("doc_id", F.size(fn.authentic_blocks(shown)).cast("long").alias("authentic"))


@query(f"SELECT doc_id, {ID.format('text')} AS id, text AS xml, 'body' || chr(10) AS rest FROM documents WHERE text NOT LIKE '%-->%'")
def payload_sections(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter(~F.col("text").contains("-->"))
    entries = F.array(F.struct(fn.fragment_id("text").alias("id"), F.col("text").alias("xml")))
    page = d.select("doc_id", F.concat(F.lit("body\n"), fn.write_payloads(entries)).alias("page"))
    return page.select("doc_id", F.inline(fn.payload_entries("page")), fn.strip_payloads("page").alias("rest"))


@query("SELECT o_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY first, l_partkey) - 1 AS BIGINT) AS ord, 'part-' || l_partkey || '.png' AS filename"
       " FROM (SELECT l_orderkey AS o_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)")  # fmt: skip
def attachment_inventory(spark, sf_dir):
    """Files that pages refer to, in order, each once; one in CDATA does not count."""
    return assets.page_files(order_pages(spark, sf_dir)).select("page_id", F.col("ord").cast("long").alias("ord"), "filename")


def order_pages(spark, sf_dir) -> DataFrame:
    """A page for each order with an image for each line item."""
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    image = lambda x: F.concat(F.lit('<ac:image><ri:attachment ri:filename="part-'), x["l_partkey"].cast("string"), F.lit('.png"/></ac:image>'))
    decoy = '<ac:plain-text-body><![CDATA[<ri:attachment ri:filename="decoy.png"/>]]></ac:plain-text-body>'
    return items.select("page_id", F.concat(F.lit(decoy), F.array_join(F.transform("items", image), "")).alias("xhtml"))


@query("SELECT doc_id, text || chr(10) || 'x' AS clean, '# T' || chr(10) || text AS body FROM documents")
def comment_and_notice_removal(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    noted = F.concat("text", F.lit("\n<!-- workflow:meta "), F.col("doc_id").cast("string"), F.lit(" -->  \nx"))
    body = F.concat(F.lit(f"<!-- {M}:notice "), F.col("doc_id").cast("string"), F.lit(" -->\n\n\n# T\n"), "text")
    return d.select("doc_id", fn.strip_comments(noted, ("workflow:",)).alias("clean"), fn.strip_notice(body).alias("body"))


@query("SELECT p_partkey, 'p' || p_partkey || '.png' AS src, CAST(p_size AS INT) AS width, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 2 AS INT) END AS height FROM part")
def image_sizes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    height = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(",h="), (F.col("p_size") * 2).cast("int").cast("string"))).otherwise("")
    url = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(f".png#{M}:w="), F.col("p_size").cast("int").cast("string"), height)
    return p.select("p_partkey", fn.image_size(url).alias("i")).select("p_partkey", "i.src", "i.width", "i.height")


@query("SELECT p_partkey, 'title' AS k, p_name || ' \"q\" \\ end' AS v, 'part' AS wk, p_name AS wv FROM part")
def macro_parameters(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    value = F.concat(F.col("p_name"), F.lit(' "q" \\ end'))
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    head = F.concat(F.lit('info title="'), quoted, F.lit('"'))
    a = F.element_at(fn.directive_params(head), 1)
    b = F.element_at(fn.macro_params(F.concat(F.lit(" part = "), F.col("p_name"), F.lit(" | x"))), 1)
    return p.select("p_partkey", a["k"].alias("k"), a["v"].alias("v"), b["k"].alias("wk"), b["v"].alias("wv"))


@query("SELECT l AS level, [1,2,2,3,4,5][CAST(l AS INT)] AS confluence, CAST(l AS INT) AS jira FROM (SELECT DISTINCT doc_id % 6 + 1 AS l FROM documents)")
def heading_levels(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 6 + 1).alias("level")).distinct()
    return d.select("level", fn.heading_level("level").alias("confluence"), fn.heading_level("level", "jira").alias("jira"))


@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'absolute path' WHEN 2 THEN 'parent directory segment' WHEN 3 THEN 'colon' ELSE 'backslash' END AS problem,"
    " p_partkey % 5 <> 3 AS local, 'data:image/png;base64,' || to_base64(encode(p_name)) AS uri FROM part"
)
def asset_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    name = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("d/"), n, F.lit(".png"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("/"), n)).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("a/../"), n))
        .when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("c:"), n)).otherwise(F.concat(F.lit("a\\"), n))
    )
    return p.select("p_partkey", fn.filename_problem(name).alias("problem"), fn.is_local_file(name).alias("local"), fn.data_uri(F.lit("x.PNG"), F.encode("p_name", "UTF-8")).alias("uri"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'xhtml' WHEN 1 THEN 'markdown' ELSE 'xhtml' END AS format FROM documents")
def input_formats(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, " <ac:image/>").when(F.col("doc_id") % 3 == 1, "<b>").otherwise('<p xmlns:ac="u">'), F.col("text"))
    return d.select("doc_id", fn.input_format(text).alias("format"))


# --- joins --------------------------------------------------------------------------------------------------


def asset_pages(spark, sf_dir, mode: str) -> DataFrame:
    """Pages with an image for each line item, resolved against a file for every part with an even key."""
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    name = lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string"), F.lit(".txt"))
    line = lambda x: F.concat(F.lit("![]("), name(x), F.lit(")"), fn.write_asset_marker(name(x)), F.lit("\n"))
    pages = items.select("page_id", F.array_join(F.transform("items", line), "").alias("markdown"))
    used = read(spark, sf_dir, "lineitem").filter(F.col("l_partkey") % 2 == 0).select(F.col("l_orderkey").alias("page_id"), "l_partkey").distinct()
    files = used.select("page_id", F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".txt")).alias("filename"), F.encode(F.col("l_partkey").cast("string"), "UTF-8").alias("bytes"))
    return assets.resolve_assets(pages, files, mode=mode).select("page_id", "markdown")


def asset_sql(target: str) -> str:
    shown = f"CASE WHEN l_partkey % 2 = 0 THEN {target} ELSE 'p' || l_partkey || '.txt' END"
    return f"SELECT l_orderkey AS page_id, string_agg('![](' || {shown} || ')<!-- {M}:asset src=\"p' || l_partkey || '.txt\" -->' || chr(10), '' ORDER BY l_linenumber, l_partkey) AS markdown FROM lineitem GROUP BY 1"


@query(asset_sql("'assets/p' || l_partkey || '.txt'"))
def resolved_sidecar(spark, sf_dir):
    return asset_pages(spark, sf_dir, "sidecar")


@query(asset_sql("'data:text/plain;base64,' || to_base64(encode(CAST(l_partkey AS VARCHAR)))"))
def resolved_inline(spark, sf_dir):
    return asset_pages(spark, sf_dir, "inline")


@query("SELECT doc_id AS page_id, CASE WHEN doc_id % 7 = 0 THEN 'create' WHEN doc_id % 3 = 0 THEN 'update' ELSE 'none' END AS action FROM documents")
def push_decisions(spark, sf_dir):
    local = markdown_pages(spark, sf_dir)
    d = documents(spark, sf_dir).filter("page_id % 7 <> 0")
    items = F.when(F.size("lines") > 0, F.concat(F.lit("<ul>\n"), each("lines", "<li><p>", "</p></li>\n", xml), F.lit("</ul>"))).otherwise("")
    remote = d.select("page_id", F.concat(F.lit("<h1>"), xml(F.col("title")), F.when(F.col("page_id") % 3 == 0, " old").otherwise(""), F.lit("</h1>"), items).alias("xhtml"), F.lit(1).alias("version"))
    return publish.push_plan(local, remote).select("page_id", "action")


@query(f"WITH d AS ({DOCUMENTS}) SELECT page_id, CAST(1 AS INT) AS version, '![](assets/x.png)<!-- {M}:asset src=\"x.png\" -->' || chr(10) AS markdown FROM d WHERE page_id % 2 = 0"
       f" UNION ALL SELECT page_id, 1, '![](x.png)<!-- {M}:asset src=\"x.png\" -->' || chr(10) FROM d WHERE page_id % 2 = 1")  # fmt: skip
def pulled_pages(spark, sf_dir):
    """Remote pages with an image, whose file is there for even ids."""
    d = documents(spark, sf_dir).select("page_id")
    remote = d.select("page_id", F.lit('<p><ac:image><ri:attachment ri:filename="x.png"/></ac:image></p>').alias("xhtml"), F.lit(1).alias("version"))
    files = d.filter("page_id % 2 = 0").select("page_id", F.lit("x.png").alias("filename"), F.encode(F.lit("x"), "UTF-8").alias("bytes"))
    return publish.pull(remote, files).select("page_id", "version", "markdown")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || chr(10) || chr(10) || chr(10) || chr(10) || 'b' ELSE 'kept' END AS rest FROM documents")
def fragments_taken_out(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    block = fn.write_fragment(F.concat(F.lit("<p>"), xml(F.col("text")), F.lit("</p>")))
    forged = F.regexp_replace(block, 'id="op-[0-9a-f]{8}"', 'id="op-00000000"')
    shown = F.concat(F.lit("a"), F.when(F.col("doc_id") % 2 == 0, block).otherwise(forged), F.lit("b"))
    rest = fn.without_blocks(shown)
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, rest).when(rest == shown, "kept").alias("rest"))


@query("SELECT l_orderkey AS page_id, 'img/p' || l_partkey || '.png' AS path, l_partkey % 3 <> 1 AS upload FROM lineitem GROUP BY ALL")
def upload_decisions(spark, sf_dir):
    """A third of the files are there, a third have another size, a third are missing."""
    files = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_partkey").distinct()
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".png"))
    local = files.select("page_id", F.concat(F.lit("img/"), name).alias("path"), F.col("l_partkey").cast("long").alias("size"))
    there = files.filter("l_partkey % 3 <> 0").select("page_id", name.alias("title"), F.when(F.col("l_partkey") % 3 == 1, F.col("l_partkey")).otherwise(F.lit(-1)).cast("long").alias("file_size"))
    return publish.upload_plan(local, there).select("page_id", "path", "upload")


@query("SELECT doc_id AS page_id FROM documents WHERE doc_id % 5 = 0")
def changed(spark, sf_dir):
    before = xhtml_pages(spark, sf_dir)
    after = before.withColumn("xhtml", F.when(F.col("page_id") % 5 == 0, F.concat("xhtml", F.lit("<p>new</p>"))).otherwise(F.concat("xhtml", F.lit("<p><br/></p>\n"))))
    return publish.changed_pages(before, after)


@query(ORACLE_SQL["markdown_to_storage"])
def streamed_to_storage(spark, sf_dir):
    """The same conversion over a stream of the pages."""
    return convert_stream(spark, markdown_pages(spark, sf_dir), "markdown", lambda c: fn.to_storage(c, nodes=False)["xhtml"], "xhtml")


from . import blocks, graph, marks, rules, structure  # noqa: E402, F401  (register more queries)
