"""Queries over markup that is seldom met: pictures, quotations, panels, mentions, reference links, inline labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions.blocks import register as register_blocks
from ..markup.macros import DEFAULT_MACROS, Macro
from ..markup.tree import Node
from ..markup.xml import Element
from .pages import lines, read, wiki_literal, xml
from .queries import MD, WIKI, XML, M, query


def said_pages(spark, sf_dir) -> DataFrame:
    """(page_id, t): what was said in each conversation, as (turn, said) in order, each on one line."""
    said = F.concat(F.lit("said "), F.regexp_replace(F.array_join(lines("text"), " "), "^$", "-"))
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id"))
    return turns.agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("t"))


#: The same rows, one for each turn.
SAID = """WITH l AS (SELECT conv_id AS page_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), ' ') AS s FROM conversations),
d AS (SELECT page_id, turn, 'said ' || CASE WHEN s = '' THEN '-' ELSE s END AS x FROM l)
"""
T_MD, T_XML, T_WIKI = MD.format("x"), XML.format("x"), WIKI.format("x")


def turn(*parts):
    """Text around what was said; None stands for it."""
    return lambda write: lambda x: F.concat(*[write(x["said"]) if p is None else F.lit(p) for p in parts])


def shown(*parts: str) -> str:
    """SQL of what is shown for a turn."""
    return " || ".join(p if p in (T_MD, T_XML, T_WIKI, "x") else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in parts)


JIRA = ("!pic.png!\n\n!http://x.y/z.png|width=10,alt=a b!\n\n{quote}\n", None, "\n{quote}\n\n{panel:title=T}\n", None, "\n{panel}\n\n{note}\nn\n{note}\n\n[^f.txt] [~bob] [http://x.y]\n\n----\n\n")
MARKDOWN = (
    f'![](pic.png)<!-- {M}:asset src="pic.png" -->\n\n![a b](http://x.y/z.png#{M}:w=10)\n\n> ', T_MD, '\n\n::: note title="T"\n', T_MD,
    "\n:::\n\n::: note\nn\n:::\n\n[f.txt](attachment:f.txt)  [http://x.y](http://x.y)\n\n---\n",
)


@query(SAID + f"SELECT page_id, string_agg({shown(*MARKDOWN)}, chr(10) ORDER BY turn) AS markdown, 2 * count(*) AS n_warnings FROM d GROUP BY 1")
def marks_of_jira(spark, sf_dir):
    """Pictures, quotations, panels, attachments, mentions and bare links of wiki text."""
    page = F.array_join(F.transform("t", turn(*JIRA)(wiki_literal)), "")
    r = said_pages(spark, sf_dir).select("page_id", fn.from_jira(page, nodes=False).alias("r"))
    return r.select("page_id", fn.strip_notice("r.markdown").alias("markdown"), F.size("r.warnings").cast("long").alias("n_warnings"))


ENDS = '[1]: http://x.y/1 "t"\n[p]: pic.png\n'
CODE = '<ac:structured-macro ac:name="code" ac:schema-version="1"><ac:plain-text-body><![CDATA['
STORAGE = ("<blockquote><p>", T_XML, f"</p></blockquote>{CODE}", "x", ']]></ac:plain-text-body></ac:structured-macro><hr/><p><a href="http://x.y/1" title="t">a</a> <ac:image ac:alt="i"><ri:attachment ri:filename="pic.png"/></ac:image> <code>b`c</code></p>')
WIKI_TEXT = ("{quote}\n", T_WIKI, "\n{quote}\n\n{code}\n", "x", "\n{code}\n\n----\n\n[a|http://x.y/1] !pic.png|alt=i! {{b`c}}\n")
AGAIN = ("> ", T_MD, "\n\n```\n", "x", f'\n```\n\n---\n\n[a](http://x.y/1 "t") ![i](pic.png)<!-- {M}:asset src="pic.png" --> ``b`c``\n')


@query(SAID + f"""SELECT page_id, string_agg({shown(*STORAGE)}, '' ORDER BY turn) AS xhtml, string_agg({shown(*WIKI_TEXT)}, chr(10) ORDER BY turn) AS jira_wiki,
  string_agg({shown(*AGAIN)}, chr(10) ORDER BY turn) AS markdown FROM d GROUP BY 1""")  # fmt: skip
def marks_of_markdown(spark, sf_dir):
    """Quotations, indented code, rules, reference links and pictures, code that holds a backtick; in all three forms."""
    one = lambda x: F.concat(F.lit("> "), fn.escape_markdown(x["said"]), F.lit("\n\n    "), x["said"], F.lit("\n\n***\n\n[a][1] ![i][p] ``b`c``\n\n"))
    pages = said_pages(spark, sf_dir).select("page_id", F.concat(F.array_join(F.transform("t", one), ""), F.lit(ENDS)).alias("page"))
    return pages.select(
        "page_id", fn.to_storage("page", nodes=False)["xhtml"].alias("xhtml"), fn.to_jira("page", source_format="markdown", nodes=False)["jira_wiki"].alias("jira_wiki"),
        fn.normalize_markdown("page")["markdown"].alias("markdown"),
    )


#: Inline elements that Markdown has no form for, and the labels that stand for them.
LABELLED = [
    ('<ac:link><ri:page ri:content-title="P{}"/></ac:link>', "→P{}"), ('<ac:link><ri:page/></ac:link>', "→page"), ('<ac:link><ri:attachment ri:filename="f{}.txt"/></ac:link>', "📎f{}.txt"),
    ('<ac:link><ri:user ri:userkey="u0123456789"/></ac:link>', "@user-u0123456"), ("<ac:link><ri:user/></ac:link>", "@user"), ('<ac:link ac:anchor="a{}"/>', "cfx:link"),
    ('<ac:structured-macro ac:name="issue"><ac:parameter ac:name="key">AB-{}</ac:parameter></ac:structured-macro>', "issue:AB-{}"),
    ('<ac:structured-macro ac:name="status"><ac:parameter ac:name="title">{}</ac:parameter></ac:structured-macro>', "cfx:status"), ("<ac:placeholder>{}</ac:placeholder>", "cfx:placeholder"),
]


@query("SELECT conv_id AS page_id, label, count(*) AS n FROM (SELECT conv_id, unnest([" + ", ".join("'" + label.replace("{}", "' || turn || '") + "'" for _, label in LABELLED) + "]) AS label FROM conversations) GROUP BY ALL")
def inline_labels(spark, sf_dir):
    """Labels of the inline elements that a page carries along, from the links that stand for them."""
    number = lambda x: x["turn"].cast("string")
    filled = lambda pattern, x: F.replace(F.lit(pattern), F.lit("{}"), number(x))
    one = lambda x: F.concat(F.lit("<p>"), xml(x["said"]), *[F.concat(F.lit(" "), filled(pattern, x)) for pattern, _ in LABELLED], F.lit("</p>"))
    pages = said_pages(spark, sf_dir).select("page_id", F.array_join(F.transform("t", one), "").alias("xhtml"))
    found = pages.select("page_id", fn.to_markdown("xhtml", nodes=False)["markdown"].alias("markdown"))
    return found.select("page_id", F.explode(fn.inline_fragments("markdown")).alias("f")).select("page_id", "f.label").groupBy("page_id", "label").agg(F.count(F.lit(1)).alias("n"))


#: Nodes that a turn of the Markdown pages above gives.
NODES = {"blockquote": 1, "paragraph": 2, "code_block": 1, "hr": 1, "link": 1, "image": 1, "code": 1}


@query("SELECT conv_id AS page_id, kind, k * count(*) AS n FROM conversations, (VALUES " + ", ".join(f"('{kind}', {n})" for kind, n in NODES.items()) + ") AS v(kind, k) GROUP BY conv_id, kind, k")
def lateral_blocks(spark, sf_dir):
    """Blocks of each page by a table function that gives them one by one; text and breaks are left out of the counts."""
    register_blocks(spark)
    one = lambda x: F.concat(F.lit("> "), fn.escape_markdown(x["said"]), F.lit("\n\n    "), x["said"], F.lit("\n\n***\n\n[a][1] ![i][p] ``b`c``\n\n"))
    said_pages(spark, sf_dir).select("page_id", F.concat(F.array_join(F.transform("t", one), ""), F.lit(ENDS)).alias("markdown")).createOrReplaceTempView("docspark_lateral_pages")
    rows = spark.sql("SELECT p.page_id, b.kind FROM docspark_lateral_pages AS p, LATERAL parse_blocks(p.markdown, 'markdown') AS b WHERE b.kind NOT IN ('text', 'softbreak')")
    return rows.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- macros with code of their own --------------------------------------------------------------------------


def read_status(el, blocks):
    """A status macro of storage pages: its words as blocks, and that it was read."""
    body = next((k for k in el.elements() if k.local == "rich-text-body"), None)
    return None if body is None else Node("directive", blocks(body.kids), attrs={"name": "status", "has_body": "true"}, params=[("state", "read")])


def write_status(node, blocks):
    return Element("ac:structured-macro", {"ac:name": "status", "state": dict(node.params)["state"]}, blocks(node.kids))


@query(SAID + f"""SELECT page_id, string_agg('::: status state="read"' || chr(10) || {T_MD} || chr(10) || ':::' || chr(10), chr(10) ORDER BY turn) AS markdown,
  string_agg('<ac:structured-macro ac:name="status" state="read"><p>' || {T_XML} || '</p></ac:structured-macro>', '' ORDER BY turn) AS xhtml FROM d GROUP BY 1""")  # fmt: skip
def own_macros(spark, sf_dir):
    """A macro with code of its own, from storage pages to Markdown and back."""
    macros = DEFAULT_MACROS.with_macro(Macro("status", "status", read=read_status, write=write_status))
    one = lambda x: F.concat(F.lit('<ac:structured-macro ac:name="status"><ac:rich-text-body><p>'), xml(x["said"]), F.lit("</p></ac:rich-text-body></ac:structured-macro>"))
    pages = said_pages(spark, sf_dir).select("page_id", F.array_join(F.transform("t", one), "").alias("page"))
    there = pages.select("page_id", fn.to_markdown("page", macros=macros, nodes=False)["markdown"].alias("markdown"))
    return there.select("page_id", fn.strip_notice("markdown").alias("markdown"), fn.to_storage("markdown", macros=macros, nodes=False)["xhtml"].alias("xhtml"))
