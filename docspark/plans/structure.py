"""Queries over the structure of pages: outlines of any depth, what stands inside what, and what a push changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import nodes, publish
from ..sources.folders import stored
from ..streaming import history
from .pages import each, lines, read, xml
from .queries import query


def nodes_of(pages: DataFrame, source: str = "markdown") -> DataFrame:
    """(page_id, nodes), written once: a frame that is used twice would be converted twice."""
    return stored(pages.select("page_id", fn.to_storage(source)["nodes"].alias("nodes")), "nodes")


# --- outlines -----------------------------------------------------------------------------------------------

#: Headings of the pages below and the one that each stands under; turns skip a level.
TREE = """
WITH RECURSIVE h(page_id, name, above, level) AS (
  SELECT DISTINCT conv_id // 10, 'block ' || (conv_id // 10), NULL, 1 FROM conversations
  UNION ALL SELECT DISTINCT conv_id // 10, 'talk ' || conv_id, 'block ' || (conv_id // 10), 2 FROM conversations
  UNION ALL SELECT conv_id // 10, 'turn ' || conv_id || ' ' || turn, 'talk ' || conv_id, 4 FROM conversations
  UNION ALL SELECT conv_id // 10, 'said ' || conv_id || ' ' || turn, 'turn ' || conv_id || ' ' || turn, 6 FROM conversations),
path(page_id, name, level, path) AS (
  SELECT page_id, name, level, name FROM h WHERE above IS NULL
  UNION ALL SELECT h.page_id, h.name, h.level, path.path || ' > ' || h.name FROM h JOIN path ON h.page_id = path.page_id AND h.above = path.name),
reach(page_id, name, other) AS (
  SELECT page_id, name, name FROM h
  UNION ALL SELECT reach.page_id, reach.name, h.name FROM reach JOIN h ON h.page_id = reach.page_id AND h.above = reach.other)
"""


def block_pages(spark, sf_dir) -> DataFrame:
    """A page for ten conversations each, with headings for these, for their turns and for what was said."""
    t = read(spark, sf_dir, "conversations")
    number = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    said = F.concat(F.lit("#### turn "), number, F.lit("\n\n###### said "), number, F.lit("\n\n"), each(lines("text"), "", "\n\n", fn.escape_markdown))
    talk = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda x: x["said"]), "").alias("body"))
    talk = talk.withColumn("body", F.concat(F.lit("## talk "), F.col("conv_id").cast("string"), F.lit("\n\n"), "body"))
    page = talk.groupBy(F.floor(F.col("conv_id") / 10).alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "body"))), lambda x: x["body"]), "").alias("body"))
    return page.select("page_id", F.concat(F.lit("# block "), F.col("page_id").cast("string"), F.lit("\n\n"), "body").alias("markdown"))


@query(TREE + "SELECT page_id, level::INT AS level, name AS title, path FROM path")
def outline_paths(spark, sf_dir):
    """Each heading with the headings that it stands under."""
    rows = nodes.outline(nodes_of(block_pages(spark, sf_dir)))
    return rows.select("page_id", "level", "title", F.array_join("path", " > ").alias("path"))


@query(TREE + "SELECT page_id, name AS title, count(*) - 1 AS headings FROM reach GROUP BY ALL")
def section_sizes(spark, sf_dir):
    """How many headings stand inside each heading's section."""
    rows = nodes.outline(nodes_of(block_pages(spark, sf_dir)))
    inside = nodes.within(rows.select("page_id", "id"), rows.select("page_id", "id", "last")).groupBy("page_id", F.col("outer_id").alias("id")).agg(F.count("*").alias("headings"))
    return rows.join(inside, ["page_id", "id"], "left").select("page_id", "title", F.coalesce("headings", F.lit(0)).alias("headings"))


# --- what stands inside what --------------------------------------------------------------------------------


def linked_pages(spark, sf_dir) -> DataFrame:
    """A page for each conversation: a table whose cells link the roles, a list whose items link the turns, a bare link."""
    items = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
    rows = each("items", "| **[s](/role/", " |\n", lambda x: F.concat(x["role"], F.lit(")** | "), fn.escape_markdown(F.array_join(lines(x["text"]), " "))))
    listed = each("items", "- of [c](/turn/", ")\n", lambda x: x["turn"].cast("string"))
    return items.select("page_id", F.concat(F.lit("| role | said |\n| --- | --- |\n"), rows, F.lit("\n"), listed, F.lit("\n[all](/all)\n")).alias("markdown"))


#: Nodes of these pages by hand: what each stands in.
HELD = """
WITH RECURSIVE n(page, me, above, kind, href) AS (
  SELECT DISTINCT conv_id, 'table', 'page', 'table', NULL FROM conversations
  UNION ALL SELECT DISTINCT conv_id, 'list', 'page', 'list', NULL FROM conversations
  UNION ALL SELECT DISTINCT conv_id, 'all', 'page', 'link', '/all' FROM conversations
  UNION ALL SELECT conv_id, 'cell' || turn, 'table', 'cell', NULL FROM conversations
  UNION ALL SELECT conv_id, 'strong' || turn, 'cell' || turn, 'strong', NULL FROM conversations
  UNION ALL SELECT conv_id, 'link' || turn, 'strong' || turn, 'link', '/role/' || role FROM conversations
  UNION ALL SELECT conv_id, 'item' || turn, 'list', 'list_item', NULL FROM conversations
  UNION ALL SELECT conv_id, 'own' || turn, 'item' || turn, 'link', '/turn/' || turn FROM conversations),
up(page, me, href, kind, above) AS (
  SELECT page, me, href, kind, above FROM n WHERE kind = 'link'
  UNION ALL SELECT up.page, up.me, up.href, n.kind, n.above FROM up JOIN n ON n.page = up.page AND n.me = up.above)
"""


def links(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'link'").select("page_id", "id", F.col("attrs")["url"].alias("href"))


@query(HELD + "SELECT page AS page_id, href, count(*) AS n FROM up WHERE kind = 'cell' GROUP BY ALL")
def links_in_cells(spark, sf_dir):
    """Links at any depth inside table cells."""
    rows = nodes.explode_nodes(nodes_of(linked_pages(spark, sf_dir)))
    return nodes.within(links(rows), rows.filter("kind = 'cell'"), how="some").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(HELD + ", k AS (SELECT page, me, href, max(CASE WHEN kind IN ('table', 'list') THEN kind END) AS holder FROM up GROUP BY ALL) SELECT page AS page_id, href, coalesce(holder, 'page') AS holder, count(*) AS n FROM k GROUP BY ALL")
def link_holders(spark, sf_dir):
    """The innermost table or list of each link."""
    rows = nodes.explode_nodes(nodes_of(linked_pages(spark, sf_dir)))
    blocks = rows.filter("kind IN ('table', 'list')")
    placed = nodes.within(links(rows), blocks, how="nearest").join(blocks.select("page_id", F.col("id").alias("outer_id"), F.col("kind").alias("holder")), ["page_id", "outer_id"], "left")
    return placed.select("page_id", "href", F.coalesce("holder", F.lit("page")).alias("holder")).groupBy("page_id", "href", "holder").agg(F.count("*").alias("n"))


def talk_pages(spark, sf_dir) -> DataFrame:
    """A page for each conversation: a heading for each turn; every second turn is code, the others are text."""
    turns = read(spark, sf_dir, "conversations")
    said = F.replace(F.array_join(lines("text"), "\n"), F.lit("`"), F.lit("'"))
    code = F.concat(F.lit("```\n"), said, F.lit("\n```\n\n"))
    body = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.when(F.col("turn") % 2 == 0, code).otherwise(F.concat(F.lit("### note\n\n> "), fn.escape_markdown(F.replace(said, F.lit("\n"), F.lit(" "))), F.lit("\n>\n> ```\n> quoted\n> ```\n\n"))))
    parts = turns.groupBy(F.col("conv_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", body.alias("body")))).alias("parts"))
    return parts.select("page_id", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("markdown"))


@query("SELECT conv_id AS page_id, role AS section, turn % 2 = 1 AS quoted, count(*) AS n FROM conversations GROUP BY ALL")
def code_below_headings(spark, sf_dir):
    """Code blocks at any depth below each second-level heading, and whether they stand in a quotation."""
    pages = nodes_of(talk_pages(spark, sf_dir))
    rows = nodes.explode_nodes(pages)
    code = rows.filter("kind = 'code_block'").select("page_id", "id")
    parts = nodes.outline(pages).filter("level = 2").select("page_id", F.col("id").alias("outer_id"), "last", "title")
    placed = nodes.within(code, parts.select("page_id", F.col("outer_id").alias("id"), "last")).join(parts, ["page_id", "outer_id"])
    quoted = nodes.within(code, rows.filter("kind = 'blockquote'"), how="some").select("page_id", "id", F.lit(True).alias("quoted"))
    placed = placed.select("page_id", "id", "title").join(quoted, ["page_id", "id"], "left")
    return placed.groupBy("page_id", F.col("title").alias("section"), F.coalesce("quoted", F.lit(False)).alias("quoted")).agg(F.count("*").alias("n"))


# --- what a push changes ------------------------------------------------------------------------------------


def turns_of(spark, sf_dir) -> DataFrame:
    """(page_id, turns): what was said in each conversation, in order."""
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id"))
    said = F.regexp_replace(F.trim(F.array_join(lines("text"), " ")), "^$", "-")
    return turns.agg(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("said")))).alias("t")).select("page_id", F.transform("t", lambda x: x["said"]).alias("turns"))


def edited(turns):
    """Pages by turns: unchanged, with one paragraph more, without the first, with the last one first."""
    n = F.size(turns)
    return (
        F.when(F.col("page_id") % 4 == 1, F.concat(turns, F.array(F.lit("one more"))))
        .when(F.col("page_id") % 4 == 2, F.slice(turns, 2, n)).when(F.col("page_id") % 4 == 3, F.concat(F.slice(turns, n, 1), F.slice(turns, 1, n - 1))).otherwise(turns)
    )


#: Turns as one line each, and how many different ones a page has.
TURNS = """
WITH t AS (SELECT conv_id AS page_id, CASE WHEN s = '' THEN '-' ELSE s END AS said FROM (SELECT conv_id,
  trim(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), ' ')) AS s FROM conversations)),
p AS (SELECT page_id, count(*) AS n, count(DISTINCT said) AS d FROM t GROUP BY 1)
"""


@query(TURNS + """SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 4 = 3 AND d = 1 THEN 'none' ELSE 'update' END AS action, (page_id % 4 = 1)::INT AS inserted,
  (page_id % 4 = 2)::INT AS deleted, (page_id % 4 = 3 AND d > 1)::INT AS moved FROM p""")  # fmt: skip
def pushed_blocks(spark, sf_dir):
    """Blocks that a push of edited Markdown inserts, deletes and moves."""
    t = turns_of(spark, sf_dir)
    local = t.select("page_id", each(edited(F.col("turns")), "", "\n\n", fn.escape_markdown).alias("markdown"))
    remote = t.select("page_id", each("turns", "<p>", "</p>\n", xml).alias("xhtml"), F.lit(1).alias("version"))
    return publish.block_plan(local, remote).select("page_id", "action", *[F.size(c).alias(c) for c in ("inserted", "deleted", "moved")])


@query(TURNS + """SELECT page_id, (page_id % 4 = 1)::INT AS inserted, (page_id % 4 = 2)::INT AS deleted, (page_id % 4 = 3 AND d > 1)::INT AS moved, (page_id % 3 = 0)::INT AS changed, TRUE AS restored
  FROM p WHERE page_id % 4 IN (1, 2) OR page_id % 4 = 3 AND d > 1 OR page_id % 3 = 0""")  # fmt: skip
def patched_pages(spark, sf_dir):
    """Scripts between two states of each page, and that they make the one the other: turns come, go and move, and in every
    third page a cell of a table changes."""
    t = turns_of(spark, sf_dir)
    table = lambda word: F.concat(F.lit("<table><tbody><tr><td>same</td><td>"), word, F.lit("</td></tr></tbody></table>"))
    before = t.select("page_id", F.concat(table(F.lit("old")), each("turns", "<p>", "</p>", xml)).alias("xhtml"))
    after = t.select("page_id", F.concat(table(F.when(F.col("page_id") % 3 == 0, "new").otherwise("old")), each(edited(F.col("turns")), "<p>", "</p>", xml)).alias("xhtml"))
    steps = stored(publish.edit_scripts(before, after), "scripts")
    made = steps.join(before, "page_id").select("page_id", fn.patch_page("xhtml", "script")["xhtml"].alias("made"))
    same = made.join(after.select("page_id", fn.canonical_storage("xhtml")["xhtml"].alias("wanted")), "page_id")
    same = same.select("page_id", (F.col("made") == F.col("wanted")).alias("restored"))
    return steps.select("page_id", "inserted", "deleted", "moved", "changed").join(same, "page_id")


# --- versions of pages over time ----------------------------------------------------------------------------

#: State that a page is in after each turn, and minutes between versions.
STATES, PAUSES = [0, 1, 1, 0, 2], [10, 40, 10]


def versions_of(spark, sf_dir) -> DataFrame:
    """A page for each conversation and a version for each turn; what was said stands in an attribute that does not count."""
    t = read(spark, sf_dir, "conversations")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("turn") % 5 + 1).cast("int")).cast("string")
    minutes = F.col("turn") * 10 + F.floor(F.col("turn") / 3) * 30 + F.col("conv_id") % 1000
    body = F.concat(F.lit('<p data-uuid="'), F.replace(xml(F.array_join(lines("text"), " ")), F.lit('"'), F.lit("&quot;")), F.lit('">'), state, F.lit("</p>"))
    found = t.select(F.col("conv_id").alias("page_id"), F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("ts"), body.alias("xhtml"))
    # time goes on, so that all sessions end
    return found.unionAll(spark.createDataFrame([(-1, "<p/>")], "page_id long, xhtml string").select("page_id", F.timestamp_seconds(F.lit(1893456000)).alias("ts"), "xhtml"))


@query("""
WITH v AS (SELECT conv_id AS page_id, turn, turn * 10 + turn // 3 * 30 AS m, [0, 1, 1, 0, 2][turn % 5 + 1] AS s FROM conversations),
w AS (SELECT *, lag(s) OVER p AS before, row_number() OVER (PARTITION BY page_id, s ORDER BY turn) AS k FROM v WINDOW p AS (PARTITION BY page_id ORDER BY turn)),
e AS (SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN before = s THEN 'repeat' WHEN k > 1 THEN 'revert' ELSE 'edit' END AS event FROM w),
g AS (SELECT *, coalesce(m - lag(m) OVER (PARTITION BY page_id ORDER BY turn) >= 30, TRUE) AS opens FROM e WHERE event <> 'repeat')
SELECT page_id, event, count(*) AS n, NULL::BIGINT AS edits FROM e GROUP BY ALL
UNION ALL SELECT page_id, 'session', count(*) FILTER (opens), count(*) FROM g GROUP BY ALL
""")
def page_history(spark, sf_dir):
    """What each version is to its page, and sessions of edits, by keyed state over a stream of the versions."""
    rows = history.events_of(spark, versions_of(spark, sf_dir)).filter("page_id >= 0")
    return rows.groupBy("page_id", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("edits").alias("edits"))
