"""The graph of pages: who links whom, links that lead nowhere, and what can be reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.native import CDATA, _c, all_of
from ..sources.folders import stored

_TAG = r'<ri:(page|attachment|url)(?=[\s/>])((?:[^>"/]++|"[^"]*+"|/(?!>))*+)'
# a tag's attributes may hold any sign but quotes, and the tag may close itself
_LINK = r'(?s)<ac:link(?=[\s/>])((?:[^>"/]++|"[^"]*+"|/(?!>))*+)(?:/>|>(.*?)</ac:link>)'


def _plain(c: Column) -> Column:
    """The value of an attribute."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return c


def _attribute(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, rf'\b{name}="([^"]*)"', 1)
    return F.when(found != "", _plain(found))


def page_links(pages: DataFrame, body: str = "xhtml") -> DataFrame:
    """(page_id, ord, kind, target, space, anchor) of the links of storage pages, in order.

    kind: `page` (target: its title, null for the page itself), `attachment` (target: the file's name) or `url` (target: the
    address of an `a`). What stands in CDATA is no link. Built-in expressions only.
    """
    shown = F.regexp_replace(_c(body), CDATA, "")
    heads, inner = all_of(shown, _LINK, 1), all_of(shown, _LINK, 2)
    held = F.transform(F.arrays_zip(heads.alias("head"), inner.alias("body")), lambda x: F.struct(x["head"].alias("head"), F.regexp_extract(x["body"], _TAG, 1).alias("kind"), F.regexp_extract(x["body"], _TAG, 2).alias("at")))
    wiki = F.transform(held, lambda x: F.struct(
        F.when(x["kind"] == "", "page").otherwise(x["kind"]).alias("kind"),
        F.coalesce(_attribute(x["at"], "ri:content-title"), _attribute(x["at"], "ri:filename"), _attribute(x["at"], "ri:value")).alias("target"),
        _attribute(x["at"], "ri:space-key").alias("space"), _attribute(x["head"], "ac:anchor").alias("anchor"),
    ))
    plain = F.transform(all_of(shown, r'<a\b[^>]*\bhref="([^"]*)"', 1), lambda u: F.struct(F.lit("url").alias("kind"), _plain(u).alias("target"), F.lit(None).cast("string").alias("space"), F.lit(None).cast("string").alias("anchor")))
    return pages.select("page_id", F.posexplode(F.concat(wiki, plain)).alias("ord", "l")).select("page_id", "ord", "l.*")


def page_edges(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(page_id, target_id) of links between pages (page_id, title, xhtml), each once: a title leads to every page that has it,
    a link without one to its own page."""
    links = page_links(pages) if links is None else links
    named = links.filter("kind = 'page' AND target IS NOT NULL").select("page_id", "target").distinct()
    met = named.join(pages.select(F.col("page_id").alias("target_id"), F.col("title").alias("target")), "target").select("page_id", "target_id")
    own = links.filter("kind = 'page' AND target IS NULL").select("page_id", F.col("page_id").alias("target_id"))
    return met.unionAll(own).distinct()


def broken_links(pages: DataFrame, links: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(page_id, ord, kind, target) of links to titles that no page has, and, with files (page_id, filename), to
    attachments that their page does not have."""
    links = page_links(pages) if links is None else links
    out = links.filter("kind = 'page' AND target IS NOT NULL").join(pages.select(F.col("title").alias("target")), "target", "left_anti").select("page_id", "ord", "kind", "target")
    if files is not None:
        lost = links.filter("kind = 'attachment'").join(files.select("page_id", F.col("filename").alias("target")), ["page_id", "target"], "left_anti")
        out = out.unionAll(lost.select("page_id", "ord", "kind", "target"))
    return out


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, distance) of all pages that links lead to from the roots (page_id), which are at distance 0.

    Semi-naive: each round follows the edges of the pages found in the last one and keeps what is new; there are as many
    rounds as the largest distance. Each round is written, so a lost executor costs one round; the driver gets a count.
    Null ids are no pages.
    """
    step = edges.filter("page_id IS NOT NULL AND target_id IS NOT NULL").select("page_id", "target_id")
    new = stored(roots.filter("page_id IS NOT NULL").select("page_id").distinct().withColumn("distance", F.lit(0)), "reached")
    rounds, found = 0, new
    while new.limit(1).count():
        rounds += 1
        ahead = new.select("page_id").join(step, "page_id").select(F.col("target_id").alias("page_id")).distinct()
        new = stored(ahead.join(found.select("page_id"), "page_id", "left_anti").withColumn("distance", F.lit(rounds)), "reached")
        found = found.unionAll(new)
    return found


def unlinked(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id of the pages that no other page links."""
    return pages.select("page_id").join(edges.filter("page_id <> target_id").select(F.col("target_id").alias("page_id")), "page_id", "left_anti")
