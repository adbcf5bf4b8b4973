"""A content-addressed store of the fragments that pages carry: each once, under its whole hash, with ids that tell them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.native import MARKER, inline_fragments, payload_entries, strip_payloads, write_payloads
from ..markup.fragments import LINK_SCHEME

#: Hexadecimal digits that an id has at least, and that a hash has.
LEAST, WHOLE = 8, 64


def page_fragments(pages: DataFrame, marker: str = MARKER) -> DataFrame:
    """(page_id, ord, id, xml, sha256) of the payloads of pages (page_id, markdown) whose id is the hash of their body."""
    rows = pages.select("page_id", F.posexplode(payload_entries("markdown", marker)).alias("ord", "e"))
    return rows.select("page_id", "ord", "e.id", "e.xml", F.sha2(F.encode("e.xml", "UTF-8"), 256).alias("sha256"))


def shared_digits(a: Column, b: Column, least: int) -> Column:
    """How many digits two hashes begin with in common; below least, or where one is null, 0."""
    same = F.filter(F.sequence(F.lit(least), F.lit(WHOLE)), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.coalesce(F.array_max(same), F.lit(0))


def fragment_store(fragments: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(sha256, id, xml, pages) of fragments (page_id, xml, sha256): each different one once.

    id: `op-` and as many digits of the hash, at least `least`, as no other fragment of the store begins with. pages: how
    many pages hold it, which is its reference count. Counts are added up before the shuffle, so a fragment that very many
    pages hold moves once a task; ids compare a hash with its neighbours among those that begin alike. An empty frame gives none.
    """
    held = fragments.groupBy("sha256").agg(F.first("xml").alias("xml"), F.count_distinct("page_id").alias("pages"))
    near = W.partitionBy(F.substring("sha256", 1, least)).orderBy("sha256")
    digits = F.greatest(F.lit(least), *[shared_digits(F.col("sha256"), side("sha256").over(near), least) + 1 for side in (F.lag, F.lead)])
    return held.withColumn("id", F.concat(F.lit("op-"), F.substring(F.col("sha256"), F.lit(1), digits))).select("sha256", "id", "xml", "pages")


def taken_out(pages: DataFrame, store: DataFrame, *, least: int = LEAST, marker: str = MARKER) -> DataFrame:
    """Pages (page_id, markdown, ...) without their payloads; their links have the store's ids.

    Only fragments whose id had to be longer meet the pages, as a map of each page. page_id should be unique; the page's own ids
    have `least` digits. All columns and rows stay.
    """
    longer = store.filter(F.length("id") > len("op-") + least).select("sha256", F.col("id").alias("new"))
    maps = page_fragments(pages, marker).join(longer, "sha256").groupBy("page_id").agg(F.collect_list(F.struct("id", "new")).alias("__longer"))
    link = lambda i: F.concat(F.lit(f"]({LINK_SCHEME}"), i, F.lit(")"))
    bare = strip_payloads("markdown", marker)
    text = F.aggregate(F.coalesce("__longer", F.array().cast("array<struct<id:string,new:string>>")), bare, lambda t, m: F.replace(t, link(m["id"]), link(m["new"])))
    return pages.join(maps, "page_id", "left").withColumn("markdown", text).select(pages.columns)


def put_back(pages: DataFrame, store: DataFrame, *, least: int = LEAST, marker: str = MARKER) -> DataFrame:
    """The reverse: links get their own ids again, and the fragments that a page links stand in a section at its end, in the
    order of their first links. Ids that the store does not have stay as they are.

    Links, not texts, meet the store; a fragment's body moves to the pages that link it.
    """
    links = pages.select("page_id", F.posexplode(F.array_distinct(F.transform(inline_fragments("markdown"), lambda x: x["id"]))).alias("ord", "id"))
    found = links.join(store.select("id", "xml"), "id").withColumn("own", F.substring("id", 1, len("op-") + least))
    parts = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "own", "id", "xml"))).alias("__parts"))
    rows = pages.join(parts, "page_id", "left")
    link = lambda i: F.concat(F.lit(f"]({LINK_SCHEME}"), i, F.lit(")"))
    changed = F.filter("__parts", lambda p: p["own"] != p["id"])
    text = F.aggregate(F.coalesce(changed, F.array().cast("array<struct<ord:int,own:string,id:string,xml:string>>")), F.col("markdown"), lambda t, p: F.replace(t, link(p["id"]), link(p["own"])))
    section = write_payloads(F.transform("__parts", lambda p: F.struct(p["own"].alias("id"), p["xml"].alias("xml"))), marker)
    return rows.withColumn("markdown", F.concat(text, F.coalesce(section, F.lit("")))).select(pages.columns)


def orphans(store: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of the store that no link of the pages (page_id, markdown, with the store's ids) leads to."""
    used = pages.select(F.explode(F.array_distinct(F.transform(inline_fragments("markdown"), lambda x: x["id"]))).alias("id")).distinct()
    return store.join(used, "id", "left_anti")
