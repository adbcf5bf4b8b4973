"""Outlines, sections and what stands inside what, against plain walks over the tree."""

import random
import time

import pytest

from docspark import functions as fn
from docspark.markup.tree import Node, to_rows
from docspark.operators import nodes

NODE = "array<struct<id:int,last:int,parent:int,depth:int,ord:int,kind:string,text:string,level:int,attrs:map<string,string>,params:array<struct<k:string,v:string>>>>"


def frame(spark, pages):
    return spark.createDataFrame([(i, None if t is None else [x | {"attrs": dict(x["attrs"])} for x in to_rows(t)]) for i, t in pages], f"page_id long, nodes {NODE}")


def heading(level, title):
    return Node("heading", [Node("strong", [Node("text", text=title)]), Node("softbreak"), Node("code", text="x")], level=level)


def random_page(r, n):
    return [heading(r.randrange(1, 7), f"h{i}") if r.random() < 0.6 else Node("list", [Node("list_item", [Node("paragraph", [Node("text", text="a")])])] * r.randrange(3)) if r.random() < 0.8 else Node("hr") for i in range(n)]


def plain_outline(tree):
    rows, open_, out = to_rows(tree), [], []
    tops = [x for x in rows if x["depth"] == 0]
    for x in tops:
        if x["kind"] != "heading":
            continue
        open_ = [o for o in open_ if o["level"] < x["level"]]
        inside = [y for y in rows if x["id"] < y["id"] <= x["last"]]
        title = "".join(" " if y["kind"] == "softbreak" else y["text"] or "" for y in inside)
        later = [y["id"] for y in tops if y["id"] > x["id"] and y["kind"] == "heading" and y["level"] <= x["level"]]
        out.append((x["id"], x["level"], title, open_[-1]["id"] if open_ else None, [o["title"] for o in open_] + [title], min(later, default=len(rows)) - 1))
        open_.append({"id": x["id"], "level": x["level"], "title": title})
    return out


def test_outline_equals_a_walk_with_a_stack(spark):
    r = random.Random(4)
    pages = [(i, random_page(r, r.randrange(12))) for i in range(40)] + [(40, []), (41, None), (None, [heading(3, "n")])]
    got = nodes.outline(frame(spark, pages)).collect()
    want = [(i, *x) for i, t in pages if t for x in plain_outline(t)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    flat = nodes.headings(frame(spark, pages)).collect()
    assert sorted(map(repr, map(tuple, flat))) == sorted(repr(w[:4]) for w in want)
    assert nodes.outline(frame(spark, pages).limit(0)).count() == 0


@pytest.mark.parametrize("level", [1, 2, 3])
def test_sections_equal_a_walk(spark, level):
    r = random.Random(level)
    pages = [(i, random_page(r, r.randrange(12))) for i in range(40)]
    want = []
    for i, tree in pages:
        section = None
        titles = {o[0]: o[2] for o in plain_outline(tree)}
        for x in to_rows(tree):
            if x["depth"]:
                continue
            if x["kind"] == "heading" and x["level"] == level:
                section = titles[x["id"]]
            elif x["kind"] == "hr":
                section = None
            elif section is not None:
                want.append((i, x["id"], x["kind"], section))
    assert sorted(map(tuple, nodes.sections(frame(spark, pages), level=level).collect())) == sorted(want)


def test_ten_thousand_headings_in_one_page(spark):
    page = spark.createDataFrame([(1, "".join(f"{'#' * (i % 6 + 1)} t{i}\n\nx\n\n" for i in range(10_000)))], "page_id long, markdown string")
    made = page.select("page_id", fn.to_storage("markdown")["nodes"].alias("nodes")).cache()
    assert made.count() == 1
    for run in (nodes.headings, nodes.outline, nodes.sections):  # code is compiled
        run(made).collect()
    for run, n in ((nodes.headings, 10_000), (nodes.outline, 10_000), (nodes.sections, None)):
        began = time.time()
        rows = run(made).collect()
        assert time.time() - began < 3 and (n is None or len(rows) == n)


def test_within_equals_all_pairs(spark):
    r = random.Random(9)

    def tree(depth):
        return [Node(r.choice(["list", "cell", "link"]), tree(depth - 1) if depth else []) for _ in range(r.randrange(5))]

    pages = [(i, tree(5)) for i in range(6)] + [(9, [Node("list", [Node("link") for _ in range(500)])])]
    rows = nodes.explode_nodes(frame(spark, pages)).cache()
    held = [(x.page_id, x.id, x.last, x.kind) for x in rows.collect()]
    inner, outer = rows.filter("kind = 'link'").select("page_id", "id"), rows.filter("kind <> 'link'").select("page_id", "id", "last")
    pairs = [(p, i, j) for p, i, _, k in held if k == "link" for q, j, end, kind in held if p == q and kind != "link" and j < i <= end]
    nearest = {(p, i): max([j for q, n, j in pairs if (q, n) == (p, i)], default=None) for p, i, _, k in held if k == "link"}
    for bucket in (1, 7, 64, 10_000):
        got = {how: sorted(map(tuple, nodes.within(inner, outer, how=how, bucket=bucket).collect()), key=repr) for how in ("all", "nearest", "some", "none")}
        assert got["all"] == sorted(pairs, key=repr)
        assert got["nearest"] == sorted(((*k, v) for k, v in nearest.items()), key=repr)
        assert got["some"] == sorted((k for k, v in nearest.items() if v is not None), key=repr)
        assert got["none"] == sorted((k for k, v in nearest.items() if v is None), key=repr)
    with pytest.raises(ValueError):
        nodes.within(inner, outer, how="first")
