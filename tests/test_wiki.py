"""The data source `wiki_pages` against a wiki in this process: listing, changes, and writing once."""

import datetime as dt
import json
import re
import threading
import urllib.parse
from email.utils import format_datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from docspark.markup.tree import MarkupError
from docspark.sources import wiki
from docspark.sources.rest import HTTPError, WikiClient, bearer

START = dt.datetime(2024, 5, 1, 10, 0, tzinfo=dt.timezone.utc)


class State:
    """The pages of a wiki, and what it was asked."""

    def __init__(self):
        self.pages, self.puts, self.posts, self.files, self.asked = {}, [], [], {}, []
        self.lose, self.conflict, self.clock, self.on_search = 0, 0, START + dt.timedelta(hours=1), None
        self.lock = threading.Lock()

    def add(self, page_id, body, minute=0, space="DOC", version=1, title=None):
        when = START + dt.timedelta(minutes=minute, seconds=int(page_id) % 60)
        self.pages[str(page_id)] = {
            "id": str(page_id), "title": title or f"T{page_id}", "space": {"key": space}, "body": {"storage": {"value": body}},
            "version": {"number": version, "when": when.isoformat(timespec="milliseconds").replace("+00:00", "Z")}, "created": int(page_id),
        }

    def found(self, cql):
        where, _, order = cql.partition(" order by ")
        out = list(self.pages.values())
        for part in where.split(" and "):
            if m := re.fullmatch(r'space = "(.*)"', part):
                out = [p for p in out if p["space"]["key"] == m[1]]
            elif m := re.fullmatch(r'lastmodified (>=|<) "(.*)"', part):
                edge = dt.datetime.strptime(m[2], wiki.MINUTE).replace(tzinfo=dt.timezone.utc)
                out = [p for p in out if (wiki.moment(p["version"]["when"]) >= edge) == (m[1] == ">=")]
            else:
                assert part == "type = page"
        return sorted(out, key=(lambda p: p["created"]) if order == "created" else (lambda p: p["version"]["when"]))


STATE = State()


class Handler(BaseHTTPRequestHandler):
    def date_time_string(self, timestamp=None):
        return format_datetime(STATE.clock, usegmt=True)

    def answer(self, code, what):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(what).encode())

    def do_GET(self):
        url = urllib.parse.urlsplit(self.path)
        how = dict(urllib.parse.parse_qsl(url.query))
        STATE.asked.append(self.path)
        if url.path.endswith("/content/search"):
            found = STATE.found(how["cql"])
            at, limit = int(how["start"]), int(how["limit"])
            self.answer(200, {"results": found[at : at + limit], "totalSize": len(found)})
            if STATE.on_search:
                STATE.on_search(how["cql"], at)
            return
        if url.path.endswith("/child/attachment"):
            return self.answer(200, {"results": STATE.files.get(url.path.split("/")[-3], [])})
        if url.path.endswith("/content"):
            return self.answer(200, {"results": [p for p in STATE.pages.values() if p["title"] == how.get("title") and p["space"]["key"] == how.get("spaceKey")]})
        page = STATE.pages.get(url.path.rsplit("/", 1)[-1])
        return self.answer(200, page) if page else self.answer(404, {})

    def body(self):
        return self.rfile.read(int(self.headers["Content-Length"]))

    def do_PUT(self):
        page = json.loads(self.body())
        with STATE.lock:
            held = STATE.pages[page["id"]]
            if STATE.conflict or page["version"]["number"] != held["version"]["number"] + 1:
                STATE.conflict = max(0, STATE.conflict - 1)
                return self.answer(409, {})
            STATE.puts.append((page["id"], page["version"]["number"], page["body"]["storage"]["value"]))
            held["version"] = held["version"] | {"number": page["version"]["number"]}
            held["body"], held["title"] = page["body"], page["title"]
            if STATE.lose:
                STATE.lose -= 1
                return self.connection.close()
        self.answer(200, held)

    def do_POST(self):
        data = self.body()
        if self.path.endswith("/child/attachment"):
            name, mark = re.search(rb'filename="(.*?)"', data)[1].decode(), re.search(rb"sha256:[0-9a-f]+", data)[0].decode()
            size = len(re.search(rb"Content-Type: .*?\r\n\r\n(.*?)\r\n--", data, re.S)[1])
            page_id = self.path.split("/")[-3]
            STATE.posts.append((page_id, name))
            STATE.files.setdefault(page_id, [])[:] = [a for a in STATE.files.get(page_id, []) if a["title"] != name] + [{"title": name, "extensions": {"fileSize": size}, "metadata": {"comment": mark}}]
            return self.answer(200, {})
        page = json.loads(data)
        with STATE.lock:
            STATE.posts.append((None, page["title"]))
            new = str(1000 + len(STATE.pages))
            STATE.add(new, page["body"]["storage"]["value"], title=page["title"], space=page["space"]["key"])
        if STATE.lose:
            STATE.lose -= 1
            return self.connection.close()
        self.answer(200, STATE.pages[new])

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}"
    held.shutdown()


@pytest.fixture
def url(server, spark):
    STATE.__init__()
    wiki.register(spark)
    return server


@pytest.fixture
def client(url):
    return WikiClient(url, bearer("t"))


def reader(spark, url, **options):
    return spark.read.format("wiki_pages").options(base_url=url, token="t", batch="3", **options).load()


# --- reading ------------------------------------------------------------------------------------------------


def test_all_pages_of_a_space_are_listed(spark, url):
    for i in range(1, 12):
        STATE.add(i, f"<p>{i}</p>", space="DOC" if i % 2 else "ELSE", minute=i)
    assert sorted((int(r.page_id), r.xhtml, r.version, r.space) for r in reader(spark, url).collect()) == [(i, f"<p>{i}</p>", 1, "DOC" if i % 2 else "ELSE") for i in range(1, 12)]
    frame = reader(spark, url, space="DOC")
    assert sorted(int(r.page_id) for r in frame.collect()) == [1, 3, 5, 7, 9, 11] and frame.rdd.getNumPartitions() == 2
    assert reader(spark, url, space="NONE").count() == 0
    got = reader(spark, url, ids="4, 99").collect()
    assert {r.page_id: r.error is None for r in got} == {"4": True, "99": False}


def test_filters_reach_the_wiki(spark, url):
    for i in range(1, 10):
        STATE.add(i, "<p/>", minute=10 * i, space="A" if i < 5 else "B")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = reader(spark, url, pushdown="true")
        STATE.asked.clear()
        assert [r.page_id for r in frame.filter("page_id IN ('3', '4') AND space = 'A' AND version = 1").collect()] == ["3", "4"]
        assert not [a for a in STATE.asked if "search" in a] and len([a for a in STATE.asked if "/content/" in a]) == 2
        STATE.asked.clear()
        edge = START + dt.timedelta(minutes=50, seconds=5)
        later = frame.filter((F.col("modified") >= F.lit(edge)) & (F.col("space") == "B"))
        assert sorted(r.page_id for r in later.collect()) == ["5", "6", "7", "8", "9"]
        assert all('lastmodified >= "2024-05-01 10:50"' in urllib.parse.unquote_plus(a) and 'space = "B"' in urllib.parse.unquote_plus(a) for a in STATE.asked)
        assert sorted(r.page_id for r in frame.filter(F.col("modified") < F.lit(edge)).collect()) == ["1", "2", "3", "4"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def changes(spark, url, folder, **options):
    """One run over what has changed so far."""
    stream = spark.readStream.format("wiki_pages").options(base_url=url, token="t", batch="2", **options).load()
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted((int(r.page_id), r.version) for r in spark.read.parquet(f"{folder}/out").collect())


def test_two_runs_read_each_change_once(spark, url, tmp_path):
    for i in range(1, 8):
        STATE.add(i, "<p/>", minute=3 * i)
    STATE.clock = START + dt.timedelta(minutes=15, seconds=30)
    first = changes(spark, url, tmp_path, lag_seconds="0")
    assert first == [(1, 1), (2, 1), (3, 1), (4, 1)]  # what changed in the current minute waits
    STATE.add(2, "<p>again</p>", minute=40, version=2)
    STATE.add(9, "<p>new</p>", minute=41)
    STATE.clock = START + dt.timedelta(minutes=60)
    assert changes(spark, url, tmp_path, lag_seconds="0") == sorted([*first, (5, 1), (6, 1), (7, 1), (2, 2), (9, 1)])
    assert changes(spark, url, tmp_path, lag_seconds="0") == sorted([*first, (5, 1), (6, 1), (7, 1), (2, 2), (9, 1)])
    assert changes(spark, url, tmp_path / "since", lag_seconds="0", since="2024-05-01 10:40") == [(2, 2), (9, 1)]


def test_a_page_that_leaves_a_span_hides_no_other(client):
    for i in range(1, 8):
        STATE.add(i, "<p/>", minute=1)
    moved = []

    def leave(cql, at):
        if not moved:  # after the first request, a page that it gave changes again
            moved.append(at)
            STATE.add(1, "<p>late</p>", minute=50, version=2)

    STATE.on_search = leave
    got = [r[0] for r in wiki.read_changes(client, wiki.conditions(None, "2024-05-01 10:00", "2024-05-01 10:05") + " order by lastmodified", 2)]
    assert sorted(got) == ["1", "2", "3", "4", "5", "6", "7"]


# --- writing ------------------------------------------------------------------------------------------------


def test_a_repeated_attempt_writes_once(client):
    STATE.add(1, "<p>old</p>", version=4)
    assert wiki.publish_once(client, "1", "<p>new</p>", 4) == ("written", 5)
    assert wiki.publish_once(client, "1", "<p>new</p>", 4) == ("written", 5)  # the task runs again
    assert STATE.puts == [("1", 5, "<p>new</p>")]
    assert wiki.publish_once(client, "1", "<p>new<br/></p>", 5) == ("unchanged", 5)
    assert wiki.publish_once(client, "1", "<p>other</p>", 4) == ("conflict", 5)
    assert wiki.publish_once(client, "1", "<p>other</p>") == ("written", 6) and len(STATE.puts) == 2


def test_lost_answers_and_attempts_at_once(client):
    STATE.add(1, "<p>old</p>")
    STATE.lose = 1
    assert wiki.publish_once(client, "1", "<p>new</p>", 1) == ("written", 2) and len(STATE.puts) == 1
    STATE.conflict = 1
    assert wiki.publish_once(client, "1", "<p>newer</p>", 2) == ("written", 3)
    got = []
    tasks = [threading.Thread(target=lambda: got.append(wiki.publish_once(client, "1", "<p>both</p>", 3))) for _ in range(8)]
    [t.start() for t in tasks]
    [t.join() for t in tasks]
    assert set(got) == {("written", 4)} and [p for p in STATE.puts if p[2] == "<p>both</p>"] == [("1", 4, "<p>both</p>")]
    STATE.conflict = 9
    with pytest.raises(HTTPError):
        wiki.publish_once(client, "1", "<p>never</p>", 4)


def test_pages_are_made_once(client):
    STATE.lose = 1
    assert wiki.create_once(client, "DOC", "New", "<p>x</p>") == ("created", "1000", 1)
    assert wiki.create_once(client, "DOC", "New", "<p>x</p>") == ("unchanged", "1000", 1)
    assert wiki.create_once(client, "DOC", "New", "<p>y</p>")[0] == "conflict" and STATE.posts == [(None, "New")]


def test_files_are_uploaded_by_content(client):
    STATE.add(1, "<p/>")
    assert wiki.upload_once(client, "1", {"a.png": b"12", "b.png": b"1"}) == ["a.png", "b.png"]
    assert wiki.upload_once(client, "1", {"a.png": b"12", "b.png": b"2"}) == ["b.png"]
    assert wiki.upload_once(client, "1", {"a.png": b"12", "b.png": b"2"}) == []


PAGES = "page_id string, markdown string, version int, title string, files map<string,binary>"


def test_a_frame_is_published_with_a_list_of_what_counts(spark, url, tmp_path):
    for i in range(1, 7):
        STATE.add(i, f"<p>{i}</p>", version=i)
    rows = [("1", "1\n", 1, None, None), ("2", "new\n", 2, None, {"a.png": b"1", "none.png": None}), ("3", "new\n", 2, None, None), ("4", None, 4, None, None), ("5", "<!-- x", 5, None, None),
            ("99", "x\n", 1, None, None), (None, "made\n", None, "Made", None), (None, "made\n", None, None, None)]
    frame = spark.createDataFrame(rows, PAGES).repartition(3)

    def save(job):
        frame.write.format("wiki_pages").mode("append").options(base_url=url, token="t", space="DOC", manifest=tmp_path.as_uri(), job=job).save()
        return {(r.page_id, r.outcome): r for r in wiki.outcomes(spark, tmp_path.as_uri(), job).collect()}

    got = save("one")
    assert {k[0]: k[1] for k in got if k[0] not in ("5", None)} == {"1": "unchanged", "2": "written", "3": "conflict", "4": "written", "99": "error", "1006": "created"}
    assert got["2", "written"].version == 3 and got["2", "written"].uploaded == ["a.png"] and "404" in got["99", "error"].error and got[None, "error"].error
    done = list(STATE.puts)
    again = save("two")  # the whole job once more, from the same versions
    assert STATE.puts == done and {k[0]: k[1] for k in again if k[0] in ("1", "2", "3", "1006")} == {"1": "unchanged", "2": "written", "3": "conflict", "1006": "unchanged"}
    (tmp_path / "one" / "part-9-9.jsonl").write_text('{"page_id": "failed attempt", "outcome": "written"}\n')
    assert {r.page_id for r in wiki.outcomes(spark, tmp_path.as_uri(), "one").collect()} == {k[0] for k in got}
    assert not [p.name for p in (tmp_path / "one").iterdir() if p.name.startswith(".part")]
    with pytest.raises(Exception, match="not all pages"):
        frame.write.format("wiki_pages").mode("append").options(base_url=url, token="t", strict="true").save()
    with pytest.raises(Exception, match="markdown or xhtml"):
        frame.select("page_id").write.format("wiki_pages").mode("append").options(base_url=url).save()


def test_a_task_that_fails_after_writing_leaves_one_version(spark, url):
    STATE.add(1, "<p>old</p>", version=3)
    sink = wiki.WikiWriter({"base_url": url, "token": "t"}, ["page_id", "markdown", "version"])

    def rows(fail):
        yield {"page_id": 1, "markdown": "new\n", "version": 3}
        if fail:
            raise RuntimeError("the executor is lost")

    with pytest.raises(RuntimeError):
        sink.write(rows(True))
    assert sink.write(rows(False)).counts == {"written": 1} and STATE.puts == [("1", 4, "<p>new</p>")]
    assert STATE.pages["1"]["version"]["number"] == 4


def test_a_stream_of_pages_is_published(spark, url, tmp_path):
    for i in range(1, 5):
        STATE.add(i, "<p>old</p>")
    made = spark.createDataFrame([(str(i), f"v{i}\n", 1) for i in range(1, 5)], "page_id string, markdown string, version int")
    made.write.parquet(f"{tmp_path}/in")
    for state in ("a", "b"):  # the second has lost its checkpoint and publishes all again
        stream = spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in")
        run = stream.writeStream.format("wiki_pages").options(base_url=url, token="t", manifest=f"file://{tmp_path}/m", job=state, checkpointLocation=f"{tmp_path}/{state}").trigger(availableNow=True).start()
        run.awaitTermination()
        assert sorted((r.page_id, r.outcome, r.version) for r in wiki.outcomes(spark, f"file://{tmp_path}/m", state).collect()) == [(str(i), "written", 2) for i in range(1, 5)]
    assert sorted(STATE.puts) == [(str(i), 2, f"<p>v{i}</p>") for i in range(1, 5)]


def test_who_asks(monkeypatch, tmp_path):
    monkeypatch.setenv("WIKI_TOKEN", "e")
    secret = tmp_path / "token"
    secret.write_text("f\n")
    secret.chmod(0o600)
    for options, told in (({"token_env": "WIKI_TOKEN"}, "Bearer e"), ({"token_file": str(secret)}, "Bearer f"), ({"token": "t"}, "Bearer t"), ({"email": "a", "token": "b"}, "Basic YTpi")):
        assert wiki.client_of({"base_url": "https://x.invalid", **options}).auth() == {"Authorization": told}
    with pytest.raises(MarkupError):
        wiki.WikiWriter({"base_url": "https://x.invalid", "strict": "true"}, ["xhtml"]).commit([wiki.Written({"error": 1}), None])
