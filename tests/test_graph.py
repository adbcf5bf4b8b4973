"""The stores of fragments and files, and the link graph, against plain programs."""

import hashlib
import random

import duckdb
import pytest

from docspark import functions as fn
from docspark.markup.fragments import fragment_id
from docspark.markup.xml import parse_fragment
from docspark.operators import assets, fragments, links
from docspark.plans.queries import ORACLE_SQL, QUERIES


def page(bodies, text="- [said](cfx:{})\n", least=8):
    """A page that carries the fragments and links each; ids have so many digits."""
    ids = [fragment_id(b)[: 3 + least] for b in bodies]
    section = "\n".join(["<!-- docspark:payloads -->", *[f"<!-- {i}\n{b}\n-->" for i, b in zip(ids, bodies, strict=True)], "<!-- /docspark:payloads -->"]) if bodies else ""
    return "# t\n" + "".join(text.format(i) for i in ids) + section


def planted(n=60):
    """Bodies, some of which have hashes that begin alike."""
    return [f"<p>{i}</p>" for i in range(n)]


def test_ids_tell_all_fragments_apart(spark):
    bodies = planted()
    rows = [(i % 7, b, hashlib.sha256(b.encode()).hexdigest()) for i, b in enumerate(bodies)] + [(99, bodies[0], hashlib.sha256(bodies[0].encode()).hexdigest())] * 5
    frame = spark.createDataFrame(rows, "page_id long, xml string, sha256 string")
    for least in (1, 2, 8):
        store = fragments.fragment_store(frame, least=least).collect()
        assert len({r.id for r in store}) == len(store) == len(bodies) and {r.xml for r in store} == set(bodies)
        hashes = [r.sha256 for r in store]
        for r in store:
            digits = r.id[3:]
            assert r.sha256.startswith(digits) and len(digits) >= least and sum(h.startswith(digits) for h in hashes) == 1
            assert len(digits) == least or sum(h.startswith(digits[:-1]) for h in hashes) > 1
        assert {r.xml: r.pages for r in store}[bodies[0]] == 2
    assert any(len(r.id) > 4 for r in fragments.fragment_store(frame, least=1).collect())
    assert fragments.fragment_store(frame.limit(0)).count() == 0


def test_pages_come_back_when_ids_collide(spark, monkeypatch):
    """With ids of one digit nearly all collide between pages, though not within one."""
    monkeypatch.setattr(fragments, "payload_entries", lambda c, m="docspark": fn.payload_entries(c, m))
    bodies, pages, used = planted(), [], set()
    for i in range(30):
        mine, seen = [], set()
        for b in bodies[i : i + 6]:
            if fragment_id(b)[:11] not in seen:
                mine.append(b)
                seen.add(fragment_id(b)[:11])
        used |= set(mine)
        pages.append((i, page(mine), "kept"))
    pages += [(100, "no fragment [x](cfx:op-00000000)\n", "k"), (101, None, "k"), (102, "", None)]
    frame = spark.createDataFrame(pages, "page_id long, markdown string, other string")
    store = fragments.fragment_store(fragments.page_fragments(frame))
    assert {r.xml for r in store.collect()} == used
    bare = fragments.taken_out(frame, store)
    assert all("payloads" not in (r.markdown or "") for r in bare.collect()) and bare.columns == frame.columns
    assert sorted(map(repr, fragments.put_back(bare, store).collect())) == sorted(map(repr, frame.collect()))
    assert fragments.orphans(store, bare).count() == 0
    assert {r.xml for r in fragments.orphans(store, bare.filter("page_id > 20")).collect()} == used - {b for i, m, _ in pages if m and i > 20 for b in used if b in m}


def test_stored_fragments_whose_hashes_begin_alike(spark, tmp_path):
    """The query gives the ids that pages carry, as its SQL does, also for two fragments that share one."""
    rows = [(1, 0, "said 37528"), (1, 1, "other"), (2, 0, "said 82512"), (3, 0, "said 37528"), (4, 0, "said 82512"), (4, 1, "said 37528")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["stored_fragments"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(ORACLE_SQL["stored_fragments"]).fetchall())
    assert sorted((i, pages) for _, i, _, pages in got)[-2:] == [("op-f637f62c", 2), ("op-f637f62c", 3)]


def test_longer_ids_are_put_into_links_and_taken_out_again(spark):
    a, b = "<p>a</p>", "<p>b</p>"
    one, two = (hashlib.sha256(x.encode()).hexdigest() for x in (a, b))
    frame = spark.createDataFrame([(1, page([a])), (2, page([b]))], "page_id long, markdown string")
    rows = [(one, f"op-{one[:11]}", a, 1), (two, f"op-{two[:8]}", b, 1)]  # as if another fragment began with the same eight digits
    store = spark.createDataFrame(rows, "sha256 string, id string, xml string, pages long")
    bare = fragments.taken_out(frame, store)
    assert {r.page_id: r.markdown for r in bare.collect()} == {1: f"# t\n- [said](cfx:op-{one[:11]})\n", 2: f"# t\n- [said](cfx:op-{two[:8]})\n"}
    assert sorted(fragments.put_back(bare, store).collect()) == sorted(frame.collect())


# --- files --------------------------------------------------------------------------------------------------


def test_files_are_stored_once_and_whole(spark, tmp_path):
    rows = [(1, "a.bin", b"same"), (2, "b.bin", b"same"), (3, "c.bin", b""), (4, "../x", b"1"), (5, None, b"1"), (6, "n", None), (None, "d.bin", b"same")]
    files = spark.createDataFrame(rows, "page_id long, filename string, bytes binary").repartition(4)
    uri = tmp_path.as_uri()
    manifest = assets.store_assets(files, uri)
    got = {(r.page_id, r.filename): r for r in manifest.collect()}
    assert got["1", "a.bin"].sha256 == got["2", "b.bin"].sha256 == got[None, "d.bin"].sha256 == hashlib.sha256(b"same").hexdigest()
    assert got["4", "../x"].error == "parent directory segment" and got["6", "n"].error == "no bytes" and got["5", None].error == "no name"
    objects = sorted(p for p in (tmp_path / "objects").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert [p.read_bytes() for p in objects] == [b"same", b""] or [p.read_bytes() for p in objects] == [b"", b"same"]
    times = {p: p.stat().st_mtime_ns for p in objects}
    again = assets.store_assets(files, uri)  # a job that runs once more writes no object
    assert {p: p.stat().st_mtime_ns for p in objects} == times and again.count() == manifest.count()
    (tmp_path / "objects" / "ab").mkdir(exist_ok=True)
    (tmp_path / "objects" / "ab" / ".torn").write_bytes(b"half")  # what a lost task leaves
    assert [r.size for r in assets.stored_objects(spark, uri).collect()] == [4]
    back = {(r.page_id, r.filename): bytes(r.bytes) for r in assets.read_stored(spark, uri, manifest).collect()}
    assert back == {("1", "a.bin"): b"same", ("2", "b.bin"): b"same", ("3", "c.bin"): b"", (None, "d.bin"): b"same"}


def test_sidecar_files_are_never_seen_half(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(1, "d/a.png", b"1"), (1, "../x", b"2")], "page_id long, filename string, bytes binary")
    assets.write_assets(frame.limit(1), str(tmp_path))
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["a.png"] and (tmp_path / "1" / "d" / "a.png").read_bytes() == b"1"
    with pytest.raises(Exception, match="parent directory"):
        assets.write_assets(frame, str(tmp_path))


# --- links --------------------------------------------------------------------------------------------------


def links_by_tree(xhtml):
    """Of a page's tree: wiki links in order, then addresses."""
    wiki, plain = [], []
    for el in parse_fragment(xhtml).below():
        if el.tag == "ac:link":
            at = next((k for k in el.elements() if k.prefix == "ri"), None)
            target = at and (at.get("ri:content-title") or at.get("ri:filename") or at.get("ri:value"))
            wiki.append((at.local if at else "page", target, at and at.get("ri:space-key"), el.get("ac:anchor")))
        elif el.tag == "a" and el.get("href") is not None:
            plain.append(("url", el.get("href"), None, None))
    return wiki + plain


def test_links_equal_those_of_the_tree(spark):
    r = random.Random(5)
    parts = [
        '<ac:link><ri:page ri:content-title="A &amp; &quot;B&quot; &gt; c"/></ac:link>', '<ac:link ac:anchor="x/y > z"/>', '<ac:link ac:anchor="t"><ac:link-body>up</ac:link-body></ac:link>',
        '<ac:link><ri:page ri:space-key="S" ri:content-title="C"/><ac:plain-text-link-body><![CDATA[<ac:link/>]]></ac:plain-text-link-body></ac:link>',
        '<ac:link><ri:attachment ri:filename="f.txt"/></ac:link>', '<p>text <a class="c" href="http://x.y/?a=1&amp;b=2">z</a></p>', "<p>plain</p>", '<a name="n"/>',
        '<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[<ac:link><ri:page ri:content-title="no"/></ac:link> <a href="no">]]></ac:plain-text-body></ac:structured-macro>',
    ]
    pages = [(i, "".join(r.choices(parts, k=r.randrange(9)))) for i in range(80)]
    frame = spark.createDataFrame([*pages, (100, None), (101, "")], "page_id long, xhtml string")
    got = {}
    for x in links.page_links(frame).orderBy("page_id", "ord").collect():
        got.setdefault(x.page_id, []).append((x.kind, x.target, x.space, x.anchor))
    assert got == {i: found for i, x in pages if (found := links_by_tree(x))}


def test_graph_of_pages(spark):
    r = random.Random(6)
    n = 40
    ahead = {i: [r.randrange(n + 10) for _ in range(r.randrange(4))] for i in range(n)}
    body = lambda i: "".join(f'<ac:link><ri:page ri:content-title="T{j}"/></ac:link>' for j in ahead[i]) + '<ac:link ac:anchor="here"/>'
    pages = spark.createDataFrame([(i, f"T{i}", body(i)) for i in range(n)] + [(None, "T0", None)], "page_id long, title string, xhtml string")
    edges = links.page_edges(pages)
    found = {(a, b) for a, b in edges.filter("target_id IS NOT NULL").collect()}
    assert found == {(i, j) for i in range(n) for j in ahead[i] if j < n} | {(i, i) for i in range(n)}
    want, level, distance = {}, {3, 4}, 0
    while level:
        want |= dict.fromkeys(level, distance)
        distance += 1
        level = {j for i in level for j in ahead[i] if j < n} - want.keys()
    roots = spark.createDataFrame([(3,), (4,), (3,), (None,)], "page_id long")
    assert {x.page_id: x.distance for x in links.reachable(edges, roots).collect()} == want
    assert links.reachable(edges, roots.limit(0)).count() == 0
    assert sorted((x.page_id, x.target) for x in links.broken_links(pages).collect()) == sorted((i, f"T{j}") for i in range(n) for j in ahead[i] if j >= n)
    assert {x.page_id for x in links.unlinked(pages.filter("page_id IS NOT NULL"), edges).collect()} == set(range(n)) - {j for i in range(n) for j in ahead[i] if j != i}
