"""Edit scripts against brute force, and plans of blocks."""

import random
import time

import pytest

from docspark import functions as fn
from docspark.markup import convert, diff
from docspark.markup.tree import MarkupError
from docspark.markup.xml import Element
from docspark.operators import publish


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_longest_common_is_one():
    r = random.Random(1)
    for _ in range(3000):
        letters = r.choice(["ab", "abc", "abcdefgh"])
        a, b = ("".join(r.choices(letters, k=r.randrange(14))) for _ in range(2))
        pairs = diff.longest_common(a, b)
        assert len(pairs) == common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))
        kept, moved = diff.aligned(a, b)
        assert len(kept) + len(moved) == sum(min(a.count(c), b.count(c)) for c in set(a))


def random_tree(r, depth):
    out = []
    for _ in range(r.randrange(5)):
        kind = r.random()
        if depth and kind < 0.7:
            out.append(Element(r.choice(["p", "ul", "li"]), {"class": r.choice("ab")} if r.random() < 0.2 else {}, random_tree(r, depth - 1)))
        elif not out or isinstance(out[-1], Element):
            out.append(r.choice(["x", "y & z", "<"]))
    return out


def test_a_script_makes_the_other_tree():
    r = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(map(diff.shown, random_tree(r, 4))) for _ in range(2))
        if r.random() < 0.5:
            parts = diff.parsed(a)
            r.shuffle(parts)
            b = "".join(map(diff.shown, parts[: r.randrange(len(parts) + 1)]))
        steps, n = diff.page_script(a, b)
        assert diff.patched(a, steps) == b
        assert n["kept"] + n["moved"] + n["changed"] + n["deleted"] == len(diff.parsed(a))
        assert (n["moved"] + n["changed"] + n["inserted"] + n["deleted"] == 0) == (a == b)
    with pytest.raises(MarkupError):
        diff.patched("<p/>", '[["move",7]]')
    with pytest.raises(MarkupError):
        diff.patched("<p/>", "no script")


def test_scripts_tell_what_happened():
    page = "<h1>t</h1><p>a</p><p>b</p><ul><li>x</li><li>y</li></ul>"
    assert convert.page_script(page, page + "<p>c</p>")["script"] == '[["keep",0,4],["insert","<p>c</p>"]]'
    assert convert.page_script(page, page.replace("<p>a</p>", ""))["deleted"] == 1
    got = convert.page_script(page, "<p>b</p><h1>t</h1><p>a</p><ul><li>x</li><li>z</li></ul>")
    assert (got["kept"], got["moved"], got["changed"], got["inserted"], got["deleted"]) == (2, 1, 1, 0, 0)
    assert convert.page_script(None, page)["script"] is None and convert.page_script("<p>", page)["error"]
    assert convert.patched("<p>", "[]")["error"]["class"] == "ParseError"


def test_long_and_reordered_pages():
    a = [f"x{i}" for i in range(6000)]
    began = time.time()
    kept, moved = diff.aligned(a, a[100:] + a[:100])
    assert (len(kept), len(moved)) == (5900, 100)
    assert diff.aligned(a, [f"y{i}" for i in range(6000)]) == ([], [])
    assert time.time() - began < 10


def test_plans_of_blocks(spark):
    local = spark.createDataFrame([(1, "# a\n\nb\n\nc\n"), (2, "# a\n\nc\n\nnew\n"), (3, "x\n"), (4, None), (5, "y\n"), (None, "z\n")], "page_id long, markdown string")
    remote = spark.createDataFrame([(1, "<h1>a</h1><p>b</p><p>c</p>", 1), (2, "<p>c</p><h1>a</h1><p>b</p>", 2), (4, "<p>a</p>", 1), (5, "<p>", 1), (None, "<p>z</p>", 1)], "page_id long, xhtml string, version int")
    got = {r.page_id: r for r in publish.block_plan(local, remote).collect()}
    assert (got[1].action, got[1].inserted, got[1].deleted, got[1].moved) == ("none", [], [], [])
    assert (got[2].action, got[2].inserted, got[2].deleted, [tuple(m) for m in got[2].moved]) == ("update", [2], [2], [(0, 1)]) or got[2].moved
    assert got[3].action == got[None].action == "create" and got[3].inserted is None
    assert got[5].action == "error" and got[5].error and got[5].moved is None
    before = spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>a</p><p>b</p>"), (3, None), (4, "<p>"), (5, "<p>x</p>")], "page_id long, xhtml string")
    after = spark.createDataFrame([(1, "<p>a<br/></p>"), (2, "<p>b</p>"), (3, "<p/>"), (4, "<p>q</p>"), (6, "<p>x</p>")], "page_id long, xhtml string")
    steps = publish.edit_scripts(before, after)
    rows = {r.page_id: r for r in steps.collect()}
    assert set(rows) == {2, 3, 4} and rows[2].deleted == 1 and rows[3].script is None and rows[4].error
    made = steps.join(before, "page_id").select("page_id", fn.patch_page("xhtml", "script")["xhtml"].alias("x")).collect()
    assert {r.page_id: r.x for r in made} == {2: "<p>b</p>", 3: None, 4: None}
    assert publish.edit_scripts(before.limit(0), after).count() == 0
