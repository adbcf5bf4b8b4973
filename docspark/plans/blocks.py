"""Queries over tables, code, nested lists, inline marks, images, macros, opaque fragments and the canonical rules.

Every page holds all lines of its document; the SQL writes the text that the converters have to give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..markup.options import Options
from .pages import DOCUMENTS, documents, each, wiki_literal, xml
from .queries import ID, MD, NL, WIKI, XML, M, joined, query

D = f"WITH d AS ({DOCUMENTS}) SELECT page_id, "
T_MD, T_XML, T_WIKI = MD.format("title"), XML.format("title"), WIKI.format("title")
CODE = "'<ac:structured-macro ac:name=\"code\" ac:schema-version=\"1\"><ac:parameter ac:name=\"language\">sql</ac:parameter><ac:plain-text-body><![CDATA['"
LINES = "array_to_string(lines, chr(10))"


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def title():
    return F.col("title")


def lines_text():
    return F.array_join("lines", "\n")


def markdown_of(page, **how):
    return fn.to_markdown(page, nodes=False, **how)["markdown"].alias("markdown")


def storage_of(page, **how):
    return fn.to_storage(page, nodes=False, **how)["xhtml"].alias("xhtml")


def jira_of(page, source_format, **how):
    return fn.to_jira(page, source_format=source_format, nodes=False, **how)["jira_wiki"].alias("jira_wiki")


# --- tables -------------------------------------------------------------------------------------------------


def storage_table():
    return text("<table><tbody><tr><th>", xml(title()), "</th><th>n</th></tr>", each("lines", "<tr><td>", "</td><td><p>1</p></td></tr>", xml), "</tbody></table>")


@query(D + f"'| ' || {T_MD} || ' | n |{NL}| --- | --- |' || {joined('lines', NL + '| ', ' | 1 |', MD)} || chr(10) AS markdown FROM d")
def tables_to_markdown(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", markdown_of(storage_table()))


@query(D + f"'||' || {T_WIKI} || '||n||' || {joined('lines', NL + '|', '|1|', WIKI)} || chr(10) AS jira_wiki FROM d")
def tables_to_jira(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", jira_of(storage_table(), "xhtml"))


@query(D + f"'<table><thead><tr><th>' || {T_XML} || '</th><th>n</th></tr></thead>' || CASE WHEN len(lines) > 0 THEN '<tbody>' || {joined('lines', '<tr><td>', '</td><td>1</td></tr>', XML)} || '</tbody>' ELSE '<tbody/>' END || '</table>' AS xhtml FROM d")
def tables_to_storage(spark, sf_dir):
    """Alignments are read and left out."""
    page = text("| ", fn.escape_markdown(title()), " | n |\n|:---|---:|\n", each("lines", "| ", " | 1 |\n", fn.escape_markdown))
    return documents(spark, sf_dir).select("page_id", storage_of(page))


@query(D + f"'| ' || {T_MD} || ' | n |{NL}| --- | --- |' || {joined('lines', NL + '| ', ' | 1 |', MD)} || chr(10) AS markdown FROM d")
def tables_from_jira(spark, sf_dir):
    page = text("||", wiki_literal(title()), "||n||\n", each("lines", "|", "|1|\n", wiki_literal))
    return documents(spark, sf_dir).select("page_id", fn.from_jira(page, nodes=False)["markdown"].alias("markdown"))


SPANNED = '<tr><td colspan="2">', '</td></tr><tr><td rowspan="2">', "</td><td>1</td></tr><tr><td>2</td></tr>"


def spanned_rows(c):
    return text(SPANNED[0], xml(c), SPANNED[1], xml(c), SPANNED[2])


@query(D + f"'| h | i |{NL}| --- | --- |' || array_to_string(list_transform(lines, lambda x: chr(10) || '| ' || {MD.format('x')} || ' | < |' || chr(10) || '| ' || {MD.format('x')} || ' | 1 |' || chr(10) || '| ^ | 2 |'), '') || chr(10) AS markdown FROM d")
def spans_to_markdown(spark, sf_dir):
    page = text("<table><tbody><tr><th>h</th><th>i</th></tr>", F.array_join(F.transform("lines", spanned_rows), ""), "</tbody></table>")
    return documents(spark, sf_dir).select("page_id", markdown_of(page))


@query(D + f"'<table><thead><tr><th>h</th><th>i</th></tr></thead>' || CASE WHEN len(lines) > 0 THEN '<tbody>' || array_to_string(list_transform(lines, lambda x: '{SPANNED[0]}' || {XML.format('x')} || '{SPANNED[1]}' || {XML.format('x')} || '{SPANNED[2]}'), '') || '</tbody>' ELSE '<tbody/>' END || '</table>' AS xhtml FROM d")
def spans_to_storage(spark, sf_dir):
    row = lambda x: text("| ", fn.escape_markdown(x), " | < |\n| ", fn.escape_markdown(x), " | 1 |\n| ^ | 2 |\n")
    page = text("| h | i |\n| --- | --- |\n", F.array_join(F.transform("lines", row), ""))
    return documents(spark, sf_dir).select("page_id", storage_of(page))


# --- code ---------------------------------------------------------------------------------------------------


def code_macro():
    return text('<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[', lines_text(), "]]></ac:plain-text-body></ac:structured-macro><pre>", xml(title()), "</pre>")


@query(D + f"'```sql' || chr(10) || {LINES} || '{NL}```{NL}{NL}```{NL}' || title || '{NL}```{NL}' AS markdown FROM d")
def code_to_markdown(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", markdown_of(code_macro()))


@query(D + f"'{{code:sql}}' || chr(10) || {LINES} || '{NL}{{code}}{NL}{NL}{{code}}{NL}' || title || '{NL}{{code}}{NL}' AS jira_wiki FROM d")
def code_to_jira(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", jira_of(code_macro(), "xhtml"))


@query(D + f"{CODE} || {LINES} || ']]></ac:plain-text-body></ac:structured-macro>' AS xhtml FROM d")
def code_to_storage(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", storage_of(text("```sql\n", lines_text(), "\n```\n")))


@query(D + f"'```java' || chr(10) || {LINES} || '{NL}```{NL}{NL}```{NL}' || title || '{NL}```{NL}{NL}> ' || {T_MD} || chr(10) AS markdown FROM d")
def code_from_jira(spark, sf_dir):
    page = text("{code:java|title=x}\n", lines_text(), "\n{code}\n{noformat}\n", title(), "\n{noformat}\nbq. ", wiki_literal(title()), "\n")
    return documents(spark, sf_dir).select("page_id", fn.strip_notice(fn.from_jira(page, nodes=False)["markdown"]).alias("markdown"))


# --- nested lists -------------------------------------------------------------------------------------------

NESTED_XML = f"'<ul><li>' || {T_XML} || CASE WHEN len(lines) > 0 THEN '<ul>' || {joined('lines', '<li>', '<ol><li>n</li></ol></li>', XML)} || '</ul>' ELSE '' END || '</li></ul>'"
NESTED_MD = f"'- ' || {T_MD} || {joined('lines', NL + '  - ', NL + '    1. n', MD)} || chr(10)"


def nested_storage():
    inner = F.when(F.size("lines") > 0, text("<ul>", each("lines", "<li>", "<ol><li>n</li></ol></li>", xml), "</ul>")).otherwise("")
    return text("<ul><li>", xml(title()), inner, "</li></ul>")


@query(D + f"{NESTED_MD} AS markdown FROM d")
def lists_to_markdown(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", markdown_of(nested_storage()))


@query(D + f"'* ' || {T_WIKI} || {joined('lines', NL + '** ', NL + '**# n', WIKI)} || chr(10) AS jira_wiki FROM d")
def lists_to_jira(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", jira_of(nested_storage(), "xhtml"))


@query(D + f"{NESTED_XML} AS xhtml FROM d")
def lists_to_storage(spark, sf_dir):
    page = text("* ", fn.escape_markdown(title()), "\n", each("lines", "  * ", "\n    1. n\n", fn.escape_markdown))
    return documents(spark, sf_dir).select("page_id", storage_of(page))


@query(D + f"{NESTED_MD} AS markdown FROM d")
def lists_from_jira(spark, sf_dir):
    page = text("* ", wiki_literal(title()), "\n", each("lines", "** ", "\n**# n\n", wiki_literal))
    return documents(spark, sf_dir).select("page_id", fn.from_jira(page, nodes=False)["markdown"].alias("markdown"))


# --- inline marks -------------------------------------------------------------------------------------------


def marked(before, between, after, write):
    """Each line between marks, and again in a link."""
    return F.array_join(F.transform("lines", lambda x: text(before, write(x), between, write(x), after)), "")


def marked_sql(before, between, after, write):
    return f"array_to_string(list_transform(lines, lambda x: '{before}' || {write.format('x')} || '{between}' || {write.format('x')} || '{after}'), '')"


MARKS_XML = "<p><strong>b</strong> <em>e</em> <del>d</del> <code>c*d</code> ", ' <a href="http://x.y/z">', "</a> <sub>1</sub><sup>2</sup></p>"
MARKS_MD = "**b** *e* ~~d~~ `c*d` ", " [", "](http://x.y/z) <sub>1</sub><sup>2</sup>" + NL + NL
MARKS_WIKI = "*b* _e_ -d- {{c*d}} ", " [", "|http://x.y/z] ~1~^2^" + NL + NL


@query(D + f"rtrim({marked_sql(*MARKS_MD, MD)}, chr(10)) || CASE WHEN len(lines) > 0 THEN chr(10) ELSE '' END AS markdown FROM d")
def marks_to_markdown(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", markdown_of(marked(*MARKS_XML, xml)))


@query(D + f"rtrim({marked_sql(*MARKS_WIKI, WIKI)}, chr(10)) || CASE WHEN len(lines) > 0 THEN chr(10) ELSE '' END AS jira_wiki FROM d")
def marks_to_jira(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", jira_of(marked(*MARKS_XML, xml), "xhtml"))


@query(D + f"{marked_sql(*MARKS_XML, XML)} AS xhtml FROM d")
def marks_to_storage(spark, sf_dir):
    page = marked("**b** *e* ~~d~~ `c*d` ", " [", "](http://x.y/z) <sub>1</sub><sup>2</sup>\n\n", fn.escape_markdown)
    return documents(spark, sf_dir).select("page_id", storage_of(page))


@query(D + f"rtrim({marked_sql('**b** *e* ~~d~~ <ins>u</ins> `c*d` ', ' [', '](http://x.y/z) <sub>1</sub> <sup>2</sup> <span style=\"color:red\">r</span>' + NL + NL, MD)}, chr(10)) || CASE WHEN len(lines) > 0 THEN chr(10) ELSE '' END AS markdown FROM d")
def marks_from_jira(spark, sf_dir):
    page = marked("*b* _e_ -d- +u+ {{c*d}} ", " [", "|http://x.y/z] ~1~ ^2^ {color:red}r{color}\n\n", wiki_literal)
    return documents(spark, sf_dir).select("page_id", fn.from_jira(page, nodes=False)["markdown"].alias("markdown"))


@query(D + f"'<p>' || array_to_string(list_transform(lines, lambda x: {XML.format('x')} || '<br/>'), '') || '<span style=\"color:red\">' || {T_XML} || '</span> ' || {T_XML} || '</p>' AS xhtml, CAST(2 AS BIGINT) AS n_warnings FROM d")
def colours_to_storage(spark, sf_dir):
    """Hard breaks, a coloured span, and a tag that storage has no equivalent for, which is dropped with a warning."""
    page = text(F.array_join(F.transform("lines", lambda x: text(fn.escape_markdown(x), "  \n")), ""), '<span style="color:red">', fn.escape_markdown(title()), "</span> <mark>", fn.escape_markdown(title()), "</mark>\n")
    r = documents(spark, sf_dir).select("page_id", fn.to_storage(page, nodes=False).alias("r"))
    return r.select("page_id", "r.xhtml", F.size("r.warnings").cast("long").alias("n_warnings"))


@query(D + f"'<span style=\"color:rgb(255,0,0)\">' || {T_MD} || '</span> ' || {T_MD} || array_to_string(list_transform(lines, lambda x: '  ' || chr(10) || {MD.format('x')}), '') || chr(10) AS markdown, '{{color:rgb(255,0,0)}}' || {T_WIKI} || '{{color}} ' || {T_WIKI} || array_to_string(list_transform(lines, lambda x: chr(92) || chr(92) || chr(10) || {WIKI.format('x')}), '') || chr(10) AS jira_wiki FROM d")
def colours_to_markdown(spark, sf_dir):
    page = text('<p><span style="color: rgb(255,0,0);">', xml(title()), '</span> <span class="x">', xml(title()), "</span>", F.array_join(F.transform("lines", lambda x: text("<br/>", xml(x))), ""), "</p>")
    return documents(spark, sf_dir).select("page_id", markdown_of(page), jira_of(page, "xhtml"))


# --- images, macros, opaque fragments -----------------------------------------------------------------------


@query(D + f"'![' || title || '](f ' || page_id || '.png#{M}:w=30,h=' || page_id % 7 || ' \"ti \\\"q\\\"\")<!-- {M}:asset src=\"f ' || page_id || '.png\" -->![](http://x.y/z.png)' || chr(10) AS markdown, 'f ' || page_id || '.png' AS attachments FROM d")
def images_to_markdown(spark, sf_dir):
    page = text('<p><ac:image ac:width="30" ac:height="', (F.col("page_id") % 7).cast("string"), '" ac:alt="', title(), '" ac:title="ti &quot;q&quot;"><ri:attachment ri:filename="f ', F.col("page_id").cast("string"), '.png"/></ac:image><ac:image><ri:url ri:value="http://x.y/z.png"/></ac:image></p>')
    r = documents(spark, sf_dir).select("page_id", fn.to_markdown(page, nodes=False).alias("r"))
    return r.select("page_id", "r.markdown", F.array_join("r.attachments", ",").alias("attachments"))


@query(D + "'<p><ac:image ac:alt=\"' || title || '\" ac:title=\"ti &amp; &quot;q&quot;\" ac:width=\"30\" ac:height=\"' || page_id % 7 || '\"><ri:attachment ri:filename=\"f ' || page_id || '.png\"/></ac:image> <ac:image ac:alt=\"r\"><ri:url ri:value=\"http://x.y/z.png\"/></ac:image></p>' AS xhtml, 'f ' || page_id || '.png' AS attachments FROM d")
def images_to_storage(spark, sf_dir):
    name = F.col("page_id").cast("string")
    page = text("![", title(), "](f.png#", f"{M}:w=30,h=", (F.col("page_id") % 7).cast("string"), ' "ti & \\"q\\"")', fn.write_asset_marker(text("f ", name, ".png")), " ![r](http://x.y/z.png)\n")
    r = documents(spark, sf_dir).select("page_id", fn.to_storage(page, nodes=False).alias("r"))
    return r.select("page_id", "r.xhtml", F.array_join("r.attachments", ",").alias("attachments"))


MACROS = [("info", "info"), ("note", "note"), ("warning", "warning"), ("tip", "tip"), ("expand", "expand")]
MACRO_XML = '<ac:structured-macro ac:name="{0}"{1}><ac:parameter ac:name="title">'
FLAT_XML = '<ac:structured-macro ac:name="toc"{0}><ac:parameter ac:name="maxLevel">3</ac:parameter></ac:structured-macro><ac:structured-macro ac:name="jira"{0}><ac:parameter ac:name="key">AB-1</ac:parameter></ac:structured-macro>'
KIND = "['info', 'note', 'warning', 'tip', 'expand'][CAST(page_id % 5 + 1 AS INT)]"
FLAT_MD = NL.join(["::: toc maxLevel=\"3\"", ":::", "", "::: jira key=\"AB-1\"", ":::", ""])


def kind_of_page():
    return F.element_at(F.array(*[F.lit(k) for k, _ in MACROS]), (F.col("page_id") % 5 + 1).cast("int"))


@query(D + f"'::: ' || {KIND} || ' title=\"a \\\"' || page_id || '\\\"\"' || chr(10) || {T_MD} || CASE WHEN len(lines) > 0 THEN chr(10) ELSE '' END || {joined('lines', NL + '- ', '', MD)} || '{NL}:::{NL}{NL}{FLAT_MD}' AS markdown FROM d")
def macros_to_markdown(spark, sf_dir):
    items = F.when(F.size("lines") > 0, text("<ul>", each("lines", "<li>", "</li>", xml), "</ul>")).otherwise("")
    page = text('<ac:structured-macro ac:name="', kind_of_page(), '"><ac:parameter ac:name="title">a "', F.col("page_id").cast("string"), '"</ac:parameter><ac:rich-text-body><p>', xml(title()), "</p>", items, "</ac:rich-text-body></ac:structured-macro>", FLAT_XML.format(""))
    return documents(spark, sf_dir).select("page_id", fn.strip_notice(fn.to_markdown(page, nodes=False)["markdown"]).alias("markdown"))


@query(D + f"'<ac:structured-macro ac:name=\"' || {KIND} || '\" ac:schema-version=\"1\"><ac:parameter ac:name=\"title\">a \"' || page_id || '\"</ac:parameter><ac:rich-text-body><p>' || {T_XML} || '</p>' || CASE WHEN len(lines) > 0 THEN '<ul>' || {joined('lines', '<li>', '</li>', XML)} || '</ul>' ELSE '' END || '</ac:rich-text-body></ac:structured-macro>{FLAT_XML.format(chr(32) + 'ac:schema-version=' + chr(34) + '1' + chr(34))}' AS xhtml FROM d")
def macros_to_storage(spark, sf_dir):
    page = text("::: ", kind_of_page(), ' title="a \\"', F.col("page_id").cast("string"), '\\""\n', fn.escape_markdown(title()), "\n\n", each("lines", "- ", "\n", fn.escape_markdown), '\n:::\n\n::: toc maxLevel="3"\n:::\n\n::: jira key="AB-1"\n:::\n')
    return documents(spark, sf_dir).select("page_id", storage_of(page))


CHART = "'<ac:structured-macro ac:name=\"chart\"><ac:parameter ac:name=\"k\">' || " + XML.format(LINES) + " || '</ac:parameter></ac:structured-macro>'"
USER = "'<ac:link><ri:user ri:account-id=\"' || page_id || '\"/></ac:link>'"


def opaque_page():
    """A macro nobody knows, with all lines of the document, and a mention inside a paragraph."""
    return text('<p>', xml(title()), '</p><ac:structured-macro ac:name="chart"><ac:parameter ac:name="k">', xml(lines_text()), '</ac:parameter></ac:structured-macro><p>see <ac:link><ri:user ri:account-id="', F.col("page_id").cast("string"), '"/></ac:link> end</p>')


@query(f"WITH d AS ({DOCUMENTS}), f AS (SELECT *, {CHART} AS c, {USER} AS u FROM d) SELECT page_id, {T_MD} || '{NL}{NL}<!-- {M}:opaque id=\"' || {ID.format('c')} || '\" -->{NL}```cfx-storage{NL}' || c || '{NL}```{NL}<!-- /{M}:opaque -->{NL}{NL}see [@user](cfx:' || {ID.format('u')} || ') end{NL}{NL}<!-- {M}:payloads -->{NL}<!-- ' || {ID.format('u')} || chr(10) || u || '{NL}-->{NL}<!-- /{M}:payloads -->{NL}' AS markdown FROM f")
def opaque_to_markdown(spark, sf_dir):
    return documents(spark, sf_dir).select("page_id", fn.strip_notice(fn.to_markdown(opaque_page(), nodes=False)["markdown"]).alias("markdown"))


@query(D + f"'<p>' || {T_XML} || '</p>' || {CHART} || '<p>see ' || {USER} || ' end</p>' AS xhtml FROM d")
def opaque_round_trip(spark, sf_dir):
    """To Markdown and back: the fragments come back byte for byte."""
    there = documents(spark, sf_dir).select("page_id", markdown_of(opaque_page()))
    return there.select("page_id", storage_of("markdown"))


@query(D + f"'h1. ' || {T_WIKI} || '{NL}{NL}see (cfx:@user) end{NL}' AS jira_wiki, CAST(2 AS BIGINT) AS n_warnings, CAST(1 AS INT) AS opaque_blocks, CAST(1 AS INT) AS inline_fragments FROM d")
def losses_to_jira(spark, sf_dir):
    """What wiki text has no place for is counted, in a warning and in the node table."""
    from ..operators import nodes

    page = text("<h1>", xml(title()), '</h1><ac:structured-macro ac:name="chart"><ac:parameter ac:name="k">', xml(lines_text()), '</ac:parameter></ac:structured-macro><p>see <ac:link><ri:user ri:account-id="1"/></ac:link> end</p>')
    r = documents(spark, sf_dir).select("page_id", fn.to_jira(page, source_format="xhtml").alias("r")).select("page_id", "r.jira_wiki", "r.warnings", "r.nodes")
    lost = nodes.dropped(r)
    return r.select("page_id", "jira_wiki", F.size("warnings").cast("long").alias("n_warnings")).join(lost, "page_id")


# --- structure ----------------------------------------------------------------------------------------------


@query(D + f"{T_MD} || {joined('lines', NL + NL, '', MD)} || '{NL}{NL}---{NL}{NL}> q' || chr(10) || chr(10) || 'é©' || chr(160) || 'x—<' || chr(10) AS markdown FROM d")
def layouts_to_markdown(spark, sf_dir):
    """Layout cells become a sequence, empty paragraphs go, entities are decoded."""
    page = text('<ac:layout><ac:layout-section ac:type="two_equal"><ac:layout-cell><p>', xml(title()), "</p></ac:layout-cell><ac:layout-cell>", each("lines", "<p>", "</p><p></p>", xml), "</ac:layout-cell></ac:layout-section></ac:layout><p></p><p><br/></p><hr/><blockquote><p>q</p></blockquote><p>&eacute;&copy;&nbsp;x&#8212;&lt;</p>")
    return documents(spark, sf_dir).select("page_id", markdown_of(page))


@query(D + f"'h1. ' || {T_WIKI} || {joined('lines', NL + NL, '', WIKI)} || chr(10) AS jira_wiki FROM d")
def leading_notes_dropped(spark, sf_dir):
    """A first paragraph that matches a pattern is left out of wiki text."""
    page = text("generated by hand ", F.col("page_id").cast("string"), "\n\n# ", fn.escape_markdown(title()), "\n\n", each("lines", "", "\n\n", fn.escape_markdown))
    return documents(spark, sf_dir).select("page_id", jira_of(page, "markdown", drop_leading=("^generated",)))


@query(D + f"'# ' || {T_MD} || {joined('lines', NL + NL, '', MD)} || '{NL}{NL}* a{NL}{NL}~~~{NL}' || title || '{NL}~~~{NL}' AS markdown FROM d")
def options_of_markdown(spark, sf_dir):
    page = text("<h1>", xml(title()), "</h1>", each("lines", "<p>", "</p>", xml), "<ul><li>a</li></ul><pre>", xml(title()), "</pre>")
    return documents(spark, sf_dir).select("page_id", markdown_of(page, options=Options(bullet="*", fence="~~~")))


@query(D + f"'<p>' || {T_XML} || '</p>' || {joined('lines', '<p>', '</p>', XML)} AS xhtml FROM d")
def comments_left_out(spark, sf_dir):
    """Comments that Markdown keeps for its own tools never reach the page."""
    page = text(fn.escape_markdown(title()), "\n\n<!-- workflow:meta ", F.col("page_id").cast("string"), " -->\n\n", each("lines", "", "\n\n", fn.escape_markdown))
    return documents(spark, sf_dir).select("page_id", storage_of(page, options=Options(keep_comments=("workflow:",))))


@query("SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE 'ParseError' END AS error_class, doc_id % 4 = 3 AS converted FROM documents")
def malformed_pages(spark, sf_dir):
    """Pages that are no XML, use unknown entities or declare some have an error value; the others are converted."""
    body = text("<p>", xml(lines_text()))
    case = F.col("page_id") % 4
    page = F.when(case == 0, body).when(case == 1, text(body, "&bogus;</p>")).when(case == 2, text("<!DOCTYPE x>", body, "</p>")).otherwise(text(body, "</p>"))
    r = documents(spark, sf_dir).select("page_id", fn.to_markdown(page, nodes=False).alias("r"))
    return r.select("page_id", F.col("r.error.class").alias("error_class"), F.col("r.markdown").isNotNull().alias("converted"))


@query(
    D + f"'<h1>' || {T_XML} || '</h1>' || {joined('lines', '<p>', '</p>', XML)} || '<table><thead><tr><th>1</th><th>' || {T_XML} || '</th></tr></thead><tbody></tbody></table>"
    "<ac:image ac:width=\"3\"><ri:attachment ri:filename=\"a\"></ri:attachment></ac:image><ac:structured-macro ac:name=\"toc\"></ac:structured-macro>' AS canonical FROM d"
)
def canonical_noise(spark, sf_dir):
    """Layout attributes, wrapped cells, column groups, empty paragraphs, versions, ids and blanks make no difference."""
    page = text(
        "<h1>", xml(title()), "</h1>\n", each("lines", '<p style="text-align: left">&nbsp;', "</p>\n<p/>", xml), '<table class="wrapped"><colgroup><col/><col/></colgroup><tbody><tr><th>1</th><td class="confluenceTd"><p>',
        xml(title()), '</p></td></tr></tbody></table>\n<ac:image ac:thumbnail="true" ac:width="3"><ri:attachment ri:filename="a" ri:version-at-save="1"/></ac:image><ac:structured-macro ac:macro-id="u" ac:name="toc" ac:schema-version="1"/>',
    )
    return documents(spark, sf_dir).select("page_id", fn.canonical_storage(page)["xhtml"].alias("canonical"))


@query("SELECT doc_id AS page_id, true AS markdown_is_fixed, true AS storage_is_fixed, true AS jira_is_fixed FROM documents")
def fixed_points(spark, sf_dir):
    """Markdown and storage settle after one pass, wiki text after two."""
    first = documents(spark, sf_dir).select("page_id", storage_of(text("# ", fn.escape_markdown(title()), "\n\n", each("lines", "- ", "\n\n  1. n\n", fn.escape_markdown), "\n| a | b |\n|---|---|\n| **c** | `d` |\n")))
    back = first.select("page_id", "xhtml", fn.passes("xhtml", ["to_markdown", "to_storage", "to_markdown"]).alias("m"))
    both = back.select("*", fn.passes("xhtml", ["storage_to_jira", "from_jira", "markdown_to_jira", "from_jira", "markdown_to_jira"]).alias("w"))
    return both.select("page_id", (F.col("m")[0] == F.col("m")[2]).alias("markdown_is_fixed"), (F.col("xhtml") == F.col("m")[1]).alias("storage_is_fixed"), (F.col("w")[2] == F.col("w")[4]).alias("jira_is_fixed"))
