"""The REST client against a server in this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docspark.markup.tree import AssetSecurityError
from docspark.sources.rest import HTTPError, VersionConflict, WikiClient, bearer, pull_markdown, push_markdown, register


class Wiki(BaseHTTPRequestHandler):
    page = {"id": "1", "title": "T", "version": {"number": 3}, "body": {"storage": {"value": "<p>old</p>"}}}
    pictures = {"id": "3", "title": "P", "version": {"number": 8}, "body": {"storage": {"value": "".join(f'<p><ac:image><ri:attachment ri:filename="{n}.png"/></ac:image></p>' for n in ("same", "far", "none"))}}}
    calls: list = []
    conflicts = 0

    def answer(self, code, what):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(what).encode())

    def do_GET(self):
        if "/attachment" in self.path:
            Wiki.calls.append("list")
            links = {"download": "/download/same.png"}
            return self.answer(200, {"results": [{"title": "same.png", "extensions": {"fileSize": 2}, "_links": links}, {"title": "far.png", "_links": {"download": "http://elsewhere.invalid/x"}}]})
        if "/download/" in self.path:
            self.send_response(200)
            self.end_headers()
            return self.wfile.write(b"12")
        if "/content/3" in self.path:
            return self.answer(200, self.pictures)
        if "/content/1" in self.path:
            return self.answer(200, self.page)
        return self.answer(404, {"message": "x" * 9000})

    def do_PUT(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if Wiki.conflicts:
            Wiki.conflicts -= 1
            return self.answer(409, {})
        Wiki.calls.append(("PUT", *body["version"].values(), body["body"]["storage"]["value"]))
        return self.answer(200, body)

    def do_POST(self):
        data = self.rfile.read(int(self.headers["Content-Length"]))
        if b'filename="bad.png"' in data:
            return self.answer(500, {})
        Wiki.calls.append(("POST", b'filename="new.png"' in data, b"Content-Type: image/png" in data, self.headers.get("X-Atlassian-Token")))
        return self.answer(200, {})

    def log_message(self, *args):
        pass


@pytest.fixture
def client():
    server = HTTPServer(("127.0.0.1", 0), Wiki)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Wiki.calls, Wiki.conflicts = [], 0
    yield WikiClient(f"http://127.0.0.1:{server.server_port}", bearer("t"))
    server.shutdown()


def test_nothing_is_written_when_the_canonical_forms_agree(client):
    assert not push_markdown(client, "1", "old\n").changed and Wiki.calls == []


PICTURES = "new ![](img/same.png)![](img/new.png)\n"


def test_update_and_uploads(client, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "same.png").write_bytes(b"12")
    (tmp_path / "img" / "new.png").write_bytes(b"123")
    r = push_markdown(client, "1", PICTURES, tmp_path, message="why")
    assert r.changed and r.new_version == 4 and r.uploaded == ["new.png"] and not r.has_partial_failure and r.page["version"] == {"number": 4, "message": "why"}
    assert Wiki.calls[0][:3] == ("PUT", 4, "why") and Wiki.calls[1:] == ["list", ("POST", True, True, "no-check")]


def test_uploads_count_as_a_change_and_failures_are_told(client):
    page = 'old ![](img/same.png)![](img/new.png)![](bad.png)![](none.png)\n'
    Wiki.page = Wiki.page | {"body": {"storage": {"value": push_xhtml(page)}}}
    try:
        r = push_markdown(client, "1", page, {"img/same.png": b"other size", "img/new.png": b"1", "bad.png": b"1"})
        assert r.changed and r.new_version == 3 and r.uploaded == ["same.png", "new.png"]
        assert [(n, type(e)) for n, e in r.failed] == [("bad.png", HTTPError), ("none.png", FileNotFoundError)] and r.has_partial_failure
        r = push_markdown(client, "1", page, lambda name: b"12" if "same" in name else None)
        assert not r.changed and r.new_version == 3 and [n for n, _ in r.failed] == ["new.png", "bad.png", "none.png"]
    finally:
        Wiki.page = Wiki.page | {"body": {"storage": {"value": "<p>old</p>"}}}


def push_xhtml(page):
    from docspark.markup.convert import to_storage

    return to_storage(page, nodes=False)["xhtml"]


@pytest.mark.parametrize("name", ["../../etc/passwd", "/etc/passwd", "a/../../b", "a\\b.png"])
def test_unsafe_names_are_refused_before_anything_is_asked_for(client, tmp_path, name):
    import dataclasses

    nowhere = dataclasses.replace(client, base_url="http://127.0.0.1:9")
    page = f'![](x.png)<!-- docspark:asset src="{name}" -->\n'
    with pytest.raises(AssetSecurityError):
        push_markdown(nowhere, "1", page, tmp_path)
    r = push_markdown(client, "1", page, tmp_path, strict=False)
    assert [type(e) for _, e in r.failed] == [AssetSecurityError] and not r.uploaded


def test_links_out_of_the_folder_are_not_read(client, tmp_path):
    (tmp_path / "secret").write_bytes(b"s")
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "x.png").symlink_to(tmp_path / "secret")
    r = push_markdown(client, "1", "![](x.png)\n", tmp_path / "site")
    assert [type(e) for _, e in r.failed] == [AssetSecurityError]


def test_pulling_a_page_with_its_files(client, tmp_path):
    plain = pull_markdown(client, "3")
    assert plain.resolved_asset_count == 0 and plain.page["version"]["number"] == 8 and "(same.png)" in plain.markdown and Wiki.calls == []
    r = pull_markdown(client, "3", assets="sidecar", asset_dir=tmp_path / "files", page_dir=tmp_path)
    assert r.resolved_asset_count == 1 and "(files/same.png)" in r.markdown and "(far.png)" in r.markdown and "(none.png)" in r.markdown
    assert (tmp_path / "files" / "same.png").read_bytes() == b"12" and Wiki.calls == ["list"]
    r = pull_markdown(client, "3", assets="inline")
    assert "(data:image/png;base64,MTI=)" in r.markdown and r.resolved_asset_count == 1
    with pytest.raises(ValueError):
        pull_markdown(client, "3", assets="sidecar")


def test_settings_from_the_environment(monkeypatch, caplog):
    monkeypatch.setenv("DOCSPARK_HTTP_TIMEOUT", "7.5")
    monkeypatch.setenv("DOCSPARK_HTTP_ERROR_LIMIT", "nonsense")
    c = WikiClient("http://x.invalid", bearer("t"))
    assert c.timeout == 7.5 and c.error_limit == 4096 and "not encrypted" in caplog.text
    monkeypatch.setenv("DOCSPARK_HTTP_ERROR_LIMIT", "10")
    assert WikiClient("https://x.invalid", bearer("t"), timeout=3).error_limit == 10
    assert caplog.text.count("not encrypted") == 1


def test_conflicts(client):
    Wiki.conflicts = 1
    with pytest.raises(VersionConflict):
        push_markdown(client, "1", "new\n")
    Wiki.conflicts = 1
    assert push_markdown(client, "1", "new\n", on_conflict="retry").changed


def test_errors_and_foreign_hosts(client):
    with pytest.raises(HTTPError) as e:
        client.get_page("2")
    assert e.value.status == 404 and len(e.value.body) == 4096
    assert client.fetch("http://elsewhere.invalid/x") is None
    with pytest.raises(ValueError):
        WikiClient("ftp://x", bearer("t"))


def test_pages_are_pushed_from_a_table(spark, client):
    from docspark.sources.rest import push_pages

    pages = spark.createDataFrame([(1, "old ![](a.png)\n"), (2, "x\n")], "page_id long, markdown string")
    got = {r.page_id: r for r in push_pages(pages, client).collect()}
    assert got["1"].changed and got["1"].failed == ["a.png"] and got["1"].error is None and "404" in got["2"].error


def test_data_source(spark, client):
    register(spark)
    got = spark.read.format("wiki_pages").option("base_url", client.base_url).option("ids", "1,2").load().collect()
    assert {r.page_id: (r.version, r.xhtml, r.error is None) for r in got} == {"1": (3, "<p>old</p>", True), "2": (None, None, False)}
