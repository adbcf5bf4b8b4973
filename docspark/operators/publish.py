"""Deciding what has to be published: canonical comparison of pages, and which attachments to upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.converters import block_changes, canonical_trace, page_script, storage_blocks, storage_hash, to_markdown
from ..markup.canonical import RULES
from ..markup.options import Options
from .assets import resolve_assets


def push_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(page_id, action, version, error) for local (page_id, markdown) against remote (page_id, xhtml, version).

    action: `create` without a remote page, `update` if the canonical forms differ, `none` if they agree, `error` if
    either side can't be read. Each side is converted and hashed in one call before the join, so that only hashes are
    shuffled.
    """
    ours = local.select("page_id", storage_hash("markdown", "markdown").alias("r")).select("page_id", F.col("r.hash").alias("ours"), F.col("r.error").alias("error"))
    theirs = remote.select("page_id", "version", storage_hash("xhtml", "xhtml").alias("r"))
    theirs = theirs.select("page_id", "version", F.col("r.hash").alias("theirs"), F.col("r.error").alias("remote_error"), F.lit(True).alias("there"))
    both = ours.join(theirs, "page_id", "left")
    action = (
        F.when(F.coalesce("error", "remote_error").isNotNull(), "error")
        .when(F.col("there").isNull(), "create")
        .when(F.col("ours") == F.col("theirs"), "none")
        .otherwise("update")
    )
    return both.select("page_id", action.alias("action"), "version", F.coalesce("error", "remote_error").alias("error"))


def block_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """`push_plan` with the blocks that an update touches: (page_id, action, version, inserted, deleted, moved, error).

    inserted: places of new top-level blocks in the local page; deleted: places in the remote page; moved: places of equal
    blocks there (source) and here (target). All three are empty where nothing is to be done, and null for `create` and
    `error`. Only hashes of blocks are shuffled, and only pages that differ are aligned.
    """
    ours = local.select("page_id", storage_blocks("markdown", "markdown").alias("o"))
    theirs = remote.select("page_id", "version", storage_blocks("xhtml", "xhtml").alias("t"), F.lit(True).alias("there"))
    both = ours.join(theirs, "page_id", "left").withColumn("error", F.coalesce("o.error", "t.error"))
    both = both.withColumn(
        "action", F.when(F.col("error").isNotNull(), "error").when(F.col("there").isNull(), "create").when(F.col("o.hash").eqNullSafe(F.col("t.hash")), "none").otherwise("update")
    )
    differs = lambda c: F.when(F.col("action") == "update", F.col(c))
    both = both.withColumn("c", block_changes(differs("t.blocks"), differs("o.blocks")))
    none = F.col("action") == "none"
    places = [F.when(none, F.array().cast(kind)).otherwise(F.col(f"c.{n}")).alias(n) for n, kind in (("inserted", "array<int>"), ("deleted", "array<int>"), ("moved", "array<struct<source:int,target:int>>"))]
    return both.select("page_id", "action", "version", *places, "error")


def edit_scripts(before: DataFrame, after: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, script, kept, moved, changed, inserted, deleted, error) for pages (key, xhtml) that are in both frames and whose
    canonical forms differ; `patch_page` applies a script to the page before.

    Hashes are compared first, so only the texts of pages that differ are shuffled. Keys should be unique in each frame.
    """
    hashed = lambda frame: frame.select(key, storage_hash("xhtml", "xhtml").alias("h")).select(key, F.coalesce("h.hash", F.lit("")).alias("h"))
    old, new = hashed(before), hashed(after).withColumnRenamed("h", "other")
    differ = old.join(new, key).filter((F.col("h") != F.col("other")) | (F.col("h") == "")).select(key)
    texts = before.join(differ, key, "left_semi").select(key, F.col("xhtml").alias("old")).join(after.select(key, F.col("xhtml").alias("new")), key)
    return texts.select(key, page_script("old", "new").alias("s")).select(key, "s.*")


def rule_counts(pages: DataFrame, body: str = "xhtml") -> DataFrame:
    """(rule, pages, taken) for each of the canonical rules, in no order: how many pages it changes, and how many characters
    it takes away in all. Counts are added up before the shuffle, which moves a row for each rule and task."""
    spark = pages.sparkSession
    found = pages.select(F.explode(canonical_trace(body)["rules"]).alias("r")).select("r.*")
    sums = found.groupBy("rule").agg(F.count(F.lit(1)).alias("pages"), F.sum("taken").alias("taken"))
    every = spark.createDataFrame([(r.__name__,) for r in RULES], "rule string")
    return every.join(F.broadcast(sums), "rule", "left").select("rule", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("taken", F.lit(0)).alias("taken"))


def upload_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(page_id, path, basename, upload) for local (page_id, path, size) against remote (page_id, title, file_size).

    A file is uploaded if the page has none of that name, or one of another or unknown size.
    """
    ours = local.withColumn("basename", F.element_at(F.split("path", "/"), -1))
    theirs = remote.select("page_id", F.col("title").alias("basename"), "file_size")
    same = F.coalesce(F.col("size") == F.col("file_size"), F.lit(False))
    return ours.join(theirs, ["page_id", "basename"], "left").select("page_id", "path", "basename", (~same).alias("upload"))


def changed_pages(before: DataFrame, after: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages of `after` whose canonical form is new or differs from `before`: both hold (key, xhtml)."""
    old = before.select(key, storage_hash("xhtml", "xhtml")["hash"].alias("h"))
    new = after.select(key, storage_hash("xhtml", "xhtml")["hash"].alias("h"))
    return new.join(old, [key, "h"], "left_anti").select(key)


def pull(remote: DataFrame, files: DataFrame | None = None, options: Options | None = None, **how) -> DataFrame:
    """(page_id, version, markdown, warnings, error) of remote (page_id, xhtml, version) pages.

    With files (page_id, filename, bytes) the image links of each page are resolved; see `resolve_assets` for `how`.
    """
    options = options or Options()
    pages = remote.withColumn("r", to_markdown("xhtml", options, nodes=False))
    pages = pages.select("page_id", "version", "r.markdown", "r.warnings", F.col("r.error.message").alias("error"))
    if files is None:
        return pages
    return resolve_assets(pages, files, marker=options.marker, **how)
