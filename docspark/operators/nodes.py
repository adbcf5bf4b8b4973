"""Operators on the node table: one row for each node of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def explode_nodes(pages: DataFrame, nodes: str = "nodes", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Rows (keep..., id, last, parent, depth, ord, kind, text, level, attrs, params) in pre-order by id."""
    return pages.select(*keep, F.inline(nodes))


def plain_text(nodes: Column | str) -> Column:
    """Text of all text and code nodes, with a space for breaks, in order; stays in the JVM."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    shown = F.filter(n, lambda x: x["kind"].isin("text", "code", "softbreak", "hardbreak"))
    return F.array_join(F.transform(shown, lambda x: F.when(x["kind"].isin("softbreak", "hardbreak"), " ").otherwise(F.coalesce(x["text"], F.lit("")))), "")


def below(node: Column, nodes: Column | str) -> Column:
    """The nodes inside a node of the array: a slice, as ids are places in the array and a subtree ends at `last`."""
    return F.slice(F.col(nodes) if isinstance(nodes, str) else nodes, node["id"] + 2, node["last"] - node["id"])


def headings(pages: DataFrame, nodes: str = "nodes", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The outline: (keep..., id, level, title) of all headings. No shuffle, and linear in the nodes of a page: a
    heading's text is the slice of its page's array below it."""
    found = F.transform(
        F.filter(nodes, lambda x: x["kind"] == "heading"),
        lambda h: F.struct(h["id"].alias("id"), h["level"].alias("level"), plain_text(below(h, nodes)).alias("title")),
    )
    return pages.select(*keep, F.inline(found))


LEVELS = range(1, 7)


def outline(pages: DataFrame, nodes: str = "nodes", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The tree of headings: (keep..., id, level, title, parent, path, last) of all headings outside other blocks.

    parent: id of the nearest heading before it with a smaller level, null for none; path: titles from the outermost
    heading down to its own; last: the last node of its section, which ends before the next heading of its level or a
    smaller one. Levels may skip. A page's open headings are at most one for each level, so they are the columns of one
    running window; only headings are shuffled. Levels outside 1 to 6 count as the nearest of these.
    """
    top = F.filter(nodes, lambda x: (x["kind"] == "heading") & (x["depth"] == 0))
    level = lambda h: F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(h["level"], F.lit(1))))
    found = F.transform(top, lambda h: F.struct(h["id"].alias("id"), level(h).alias("level"), plain_text(below(h, nodes)).alias("title"), (F.size(nodes) - 1).alias("__end")))
    rows = pages.select(*keep, F.inline(found))  # no other column of the page, which each heading would copy
    down = W.partitionBy(*keep).orderBy("id")
    up = W.partitionBy(*keep).orderBy(F.desc("id"))
    here = F.struct("id", "title")

    # a heading closes all open ones of its level and below: what is open at level k is the last heading of level k with no
    # smaller one since, which the ids tell
    seen = {k: F.last(F.when(F.col("level") == k, here), True).over(down.rowsBetween(W.unboundedPreceding, -1)) for k in LEVELS}
    ahead = {k: F.last(F.when(F.col("level") == k, F.col("id")), True).over(up.rowsBetween(W.unboundedPreceding, -1)) for k in LEVELS}
    rows = rows.withColumns({f"__seen{k}": c for k, c in seen.items()} | {f"__next{k}": c for k, c in ahead.items()})
    start = {k: F.coalesce(F.col(f"__seen{k}")["id"], F.lit(-1)) for k in LEVELS}

    def is_open(k: int) -> Column:
        closers = [start[j] for j in LEVELS if j < k]
        return (F.col("level") > k) & (start[k] >= 0) & (start[k] > (F.greatest(F.lit(-1), *closers) if closers else F.lit(-1)))

    parent = F.coalesce(*[F.when(is_open(k), start[k]) for k in reversed(LEVELS)])
    path = F.array_compact(F.array(*[F.when(is_open(k), F.col(f"__seen{k}")["title"]) for k in LEVELS], F.col("title")))
    later = F.least(*[F.when(F.col("level") >= k, F.col(f"__next{k}")) for k in LEVELS], F.col("__end") + 1)
    return rows.select(*keep, "id", "level", "title", parent.alias("parent"), path.alias("path"), (later - 1).alias("last"))


def sections(pages: DataFrame, nodes: str = "nodes", keep: tuple[str, ...] = ("page_id",), level: int = 2) -> DataFrame:
    """Top-level blocks with the section they stand in: (keep..., id, kind, section).

    A heading of that level opens a section, which the next one or a rule ends; headings of sections are not rows. One
    shuffle of the top-level blocks, whose titles come from the slices below them.
    """
    tops = F.filter(nodes, lambda x: x["depth"] == 0)
    opens = lambda x: (x["kind"] == "heading") & (x["level"] == level)
    row = lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), F.when(opens(x), plain_text(below(x, nodes))).alias("__title"), opens(x).alias("__opens"))
    rows = pages.select(*keep, F.inline(F.transform(tops, row)))
    edge = F.col("__opens") | (F.col("kind") == "hr")
    last = F.last(F.when(edge, F.struct("__title")), True).over(W.partitionBy(*keep).orderBy("id"))
    rows = rows.withColumn("section", last["__title"])
    return rows.filter(~edge & F.col("section").isNotNull()).select(*keep, "id", "kind", "section")


# --- what stands inside what --------------------------------------------------------------------------------

#: Ids that one bucket of the join below covers.
BUCKET = 64


def within(inner: DataFrame, outer: DataFrame, keep: tuple[str, ...] = ("page_id",), *, how: str = "all", bucket: int = BUCKET) -> DataFrame:
    """Which nodes of `inner` (keep..., id, ...) stand inside which intervals of `outer` (keep..., id, last, ...).

    A node with an id over the interval's and up to its `last` is inside; intervals are nodes of `explode_nodes` or sections
    of `outline`. how: `all` gives every pair as the columns of inner and `outer_id`; `nearest` the innermost interval of
    each node, null for none; `some` the nodes that stand in any, `none` those that stand in none. Rows of inner are told
    apart by keep and id for `nearest`, so they should be distinct there. Null keys meet nothing.

    A range join without comparing all pairs of a page: an interval is sent to each bucket of ids that it reaches, a node to
    its own, and only those that share a bucket are compared. A large page is many buckets, so no task gets all of it, and
    the rows sent are the nodes plus, for each interval, its length over the bucket's size.
    """
    if how not in ("all", "nearest", "some", "none"):
        raise ValueError("how is all, nearest, some or none")
    names = [f"__{k}" for k in ("bucket", "from", "to")]
    span = F.sequence(F.floor((F.col("id") + 1) / bucket), F.floor(F.col("last") / bucket))
    ends = outer.filter(F.col("last") > F.col("id")).select(*keep, F.col("id").alias("__from"), F.col("last").alias("__to"), F.explode(span).alias("__bucket"))
    points = inner.withColumn("__bucket", F.floor(F.col("id") / bucket))
    joined = [points[k] == ends[k] for k in (*keep, "__bucket")] + [points["id"] > ends["__from"], points["id"] <= ends["__to"]]
    if how in ("some", "none"):
        return points.join(ends, joined, "left_semi" if how == "some" else "left_anti").drop(*names)
    met = points.join(ends, joined, "inner").select(*[points[c] for c in inner.columns], ends["__from"].alias("outer_id"))
    if how == "all":
        return met
    nearest = met.groupBy(*keep, "id").agg(F.max("outer_id").alias("outer_id"))
    return inner.join(nearest, [*keep, "id"], "left").select(*inner.columns, "outer_id")


def kind_counts(pages: DataFrame, nodes: str = "nodes") -> DataFrame:
    """How often each kind of node occurs, and on how many pages."""
    each = pages.select("page_id", F.explode(F.transform(nodes, lambda x: x["kind"])).alias("kind"))
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("page_id").alias("pages"))


def dropped(pages: DataFrame, nodes: str = "nodes") -> DataFrame:
    """What a conversion to wiki text leaves out: (page_id, opaque_blocks, inline_fragments)."""

    def count(kind: str) -> Column:
        return F.size(F.filter(nodes, lambda x: x["kind"] == kind))

    return pages.select("page_id", count("opaque").alias("opaque_blocks"), count("inline_opaque").alias("inline_fragments"))
