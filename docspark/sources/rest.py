"""A wiki's REST interface as a source and a sink of pages."""

from __future__ import annotations

import base64
import datetime
import email.utils
import json
import logging
import os
import stat
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..markup.assets import check_name, media_type, name_problem, resolve_page
from ..markup.convert import canonical, to_markdown, to_storage
from ..markup.options import Options
from ..markup.tree import AssetSecurityError, MarkupError

EXPAND = "body.storage,version,space,ancestors"
log = logging.getLogger(__name__)


def from_env(name: str, default: float, kind: Callable = float) -> Callable:
    """The number in an environment variable, looked up when a client is made; the default if it holds none."""

    def value():
        try:
            return max(kind(0), kind(os.environ.get(name, default)))
        except ValueError:
            return default

    return value


class HTTPError(MarkupError):
    """An answer that is no success; status -1 if there was none."""

    def __init__(self, status: int, url: str, body: str = ""):
        super().__init__(f"HTTP {status} from {url}: {body}")
        self.status, self.url, self.body = status, url, body


class VersionConflict(HTTPError):
    """The page has changed meanwhile."""


# --- who asks -----------------------------------------------------------------------------------------------


def bearer(token: str) -> Callable[[], dict[str, str]]:
    return lambda: {"Authorization": f"Bearer {token}"}


def bearer_file(path: str) -> Callable[[], dict[str, str]]:
    """The token in a file that nobody else may read."""
    p = Path(path)
    if os.name == "posix" and stat.S_IMODE(p.stat().st_mode) & 0o077:
        raise PermissionError(f"{path} may be read by others")
    return bearer(p.read_text(encoding="utf-8").strip())


def basic(email: str, token: str) -> Callable[[], dict[str, str]]:
    code = base64.b64encode(f"{email}:{token}".encode()).decode()
    return lambda: {"Authorization": f"Basic {code}"}


def bearer_env(name: str) -> Callable[[], dict[str, str]]:
    """The token in an environment variable, looked up for each call."""

    def headers() -> dict[str, str]:
        if not os.environ.get(name):
            raise RuntimeError(f"{name} is not set")
        return {"Authorization": f"Bearer {os.environ[name]}"}

    return headers


# --- client -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class WikiClient:
    """Pages and attachments by id. dialect: `server` or `cloud`; timeout in seconds; errors keep so many characters.

    The last two come from DOCSPARK_HTTP_TIMEOUT and DOCSPARK_HTTP_ERROR_LIMIT, if they are not given.
    """

    base_url: str
    auth: Callable[[], dict[str, str]]
    dialect: str = "server"
    timeout: float = field(default_factory=from_env("DOCSPARK_HTTP_TIMEOUT", 30.0))
    error_limit: int = field(default_factory=from_env("DOCSPARK_HTTP_ERROR_LIMIT", 4096, int))
    api: str = "/rest/api"

    def __post_init__(self):
        url = urllib.parse.urlsplit(self.base_url)
        if url.scheme not in ("http", "https") or not url.netloc:
            raise ValueError(f"base_url must be an http(s) address: {self.base_url!r}")
        if self.dialect not in ("server", "cloud"):
            raise ValueError("dialect is server or cloud")
        if url.scheme == "http":
            log.warning("%s is not encrypted: whoever listens sees the credentials", self.base_url)

    def content(self, page_id: str | None = None, rest: str = "") -> str:
        return f"{self.api}/content" + (f"/{urllib.parse.quote(str(page_id), safe='')}" if page_id is not None else "") + rest

    def call(self, method: str, path: str, body: bytes | None = None, headers: dict[str, str] | None = None, *, raw: bool = False):
        url = path if "://" in path else self.base_url.rstrip("/") + path
        request = urllib.request.Request(url, body, {"Accept": "application/json"} | self.auth() | (headers or {}), method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                data = answer.read()
        except urllib.error.HTTPError as ex:
            text = ex.read().decode("utf-8", "replace")[: self.error_limit]
            raise (VersionConflict if ex.code == 409 else HTTPError)(ex.code, url, text) from ex
        except (urllib.error.URLError, TimeoutError, OSError) as ex:
            raise HTTPError(-1, url, str(ex)) from ex
        if raw:
            return data
        try:
            return json.loads(data) if data else {}
        except ValueError as ex:
            raise HTTPError(-1, url, "the answer is not JSON") from ex

    def send(self, method: str, path: str, what: dict):
        return self.call(method, path, json.dumps(what).encode(), {"Content-Type": "application/json"})

    def get_page(self, page_id: str, expand: str = EXPAND) -> dict:
        return self.call("GET", self.content(page_id, f"?expand={urllib.parse.quote(expand)}"))

    def search(self, cql: str, start: int = 0, limit: int = 50, expand: str = "version") -> dict:
        """Pages found, from a place on: `results` and, of all that there are, `totalSize`."""
        return self.call("GET", f"{self.api}/content/search?" + urllib.parse.urlencode({"cql": cql, "start": start, "limit": limit, "expand": expand}))

    def find_page(self, space: str, title: str) -> dict | None:
        """The page of that title."""
        found = self.call("GET", self.content(None, "?" + urllib.parse.urlencode({"spaceKey": space, "title": title, "expand": EXPAND})))
        return next(iter(found.get("results", [])), None)

    def now(self) -> datetime.datetime:
        """The time by the wiki's clock, as far as its answers tell."""
        request = urllib.request.Request(self.base_url.rstrip("/") + self.content(None, "?limit=1"), None, {"Accept": "application/json"} | self.auth())
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                told = answer.headers.get("Date")
        except (urllib.error.URLError, TimeoutError, OSError) as ex:
            raise HTTPError(getattr(ex, "code", -1), request.full_url, str(ex)) from ex
        return email.utils.parsedate_to_datetime(told) if told else datetime.datetime.now(datetime.timezone.utc)

    def create_page(self, space: str, title: str, xhtml: str, parent: str | None = None) -> dict:
        page = {"type": "page", "title": title, "space": {"key": space}, "body": {"storage": {"value": xhtml, "representation": "storage"}}}
        return self.send("POST", self.content(), page | ({"ancestors": [{"id": parent}]} if parent else {}))

    def update_page(self, page_id: str, title: str | None, xhtml: str, version: int | None = None, message: str = "") -> dict:
        """Writes the version after `version`; VersionConflict if that is no longer the last one. What is not given of
        title and version is asked for first; the message is shown in the page's history."""
        if title is None or version is None:
            page = self.get_page(page_id)
            title, version = page["title"] if title is None else title, page["version"]["number"] if version is None else version
        number = {"number": version + 1} | ({"message": message} if message else {})
        page = {"id": page_id, "type": "page", "title": title, "version": number, "body": {"storage": {"value": xhtml, "representation": "storage"}}}
        return self.send("PUT", self.content(page_id), page)

    def delete_page(self, page_id: str) -> None:
        self.call("DELETE", self.content(page_id), raw=True)

    def list_attachments(self, page_id: str, limit: int = 200) -> list[dict]:
        return self.call("GET", self.content(page_id, f"/child/attachment?limit={limit}")).get("results", [])

    def upload_attachment(self, page_id: str, name: str, data: bytes, comment: str = "") -> dict:
        mark = uuid.uuid4().hex
        safe = name.replace("\\", "\\\\").replace('"', '\\"').replace("\r", "").replace("\n", "")
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{safe}"\r\nContent-Type: {media_type(name)}\r\n\r\n'
        said = f'\r\n--{mark}\r\nContent-Disposition: form-data; name="comment"\r\n\r\n{comment}' if comment else ""
        headers = {"Content-Type": f"multipart/form-data; boundary={mark}"} | ({"X-Atlassian-Token": "no-check"} if self.dialect == "server" else {})
        return self.call("POST", self.content(page_id, "/child/attachment"), head.encode() + data + f"{said}\r\n--{mark}--\r\n".encode(), headers)

    def fetch(self, link: str) -> bytes | None:
        """An attachment's bytes; None if it can't be had. Addresses of another host are refused."""
        if "://" in link and urllib.parse.urlsplit(link).netloc != urllib.parse.urlsplit(self.base_url).netloc:
            log.warning("%s is on another host and is not asked for", link)
            return None
        try:
            return self.call("GET", link, raw=True)
        except HTTPError as ex:
            log.warning("%s can't be had: %s", link, ex)
            return None

    def attachment_fetcher(self, page_id: str) -> Callable[[str], bytes | None]:
        """A function from the names of a page's attachments to their bytes; the list is asked for once."""
        links = {a["title"]: (a.get("_links") or {}).get("download") for a in self.list_attachments(page_id)}
        return lambda name: self.fetch(links[name]) if links.get(name) else None


def size_matches(attachment: dict, size: int) -> bool:
    """Whether a remote attachment is known to have that size."""
    return (attachment.get("extensions") or {}).get("fileSize") == size


@dataclass
class PushResult:
    """changed: the body was written or a file uploaded; failed: names and what went wrong; page: as it is now."""

    changed: bool
    new_version: int
    uploaded: list[str] = field(default_factory=list)
    failed: list[tuple[str, Exception]] = field(default_factory=list)
    page: dict = field(default_factory=dict)

    @property
    def has_partial_failure(self) -> bool:
        return bool(self.failed)


@dataclass
class PullResult:
    """A page as Markdown; resolved_asset_count: files that were found for its images."""

    markdown: str
    page: dict
    warnings: list[str] = field(default_factory=list)
    resolved_asset_count: int = 0


def push_markdown(
    client: WikiClient,
    page_id: str,
    markdown: str,
    files: dict[str, bytes] | Callable[[str], bytes | None] | str | Path = ".",
    *,
    on_conflict: str = "abort",
    message: str = "",
    strict: bool = True,
    options: Options | None = None,
) -> PushResult:
    """Publishes one page and the files that it refers to.

    Nothing is written if the canonical forms agree; files that the page lacks, or has in another size, are uploaded
    in any case. files: the folder that the page's names are relative to, or names and bytes, or a function that gives
    a name's bytes. With strict, a name that leads out of the folder raises AssetSecurityError before anything is asked
    for; without, it counts as failed. on_conflict: `abort`, or `retry` once against the newest version, or `force`
    likewise without comparing again. message: the note in the page's history.
    """
    if on_conflict not in ("abort", "retry", "force"):
        raise ValueError("on_conflict is abort, retry or force")
    made = to_storage(markdown, options, nodes=False)
    if made["error"]:
        raise MarkupError(made["error"]["message"])
    if strict:
        for name in made["attachments"]:
            check_name(name)
    ours = canonical(made["xhtml"])["xhtml"]

    def read(name: str) -> bytes:
        if problem := name_problem(name):
            raise AssetSecurityError(f"{name!r}: {problem}")
        if isinstance(files, (str, Path)):
            path = (Path(files) / name).resolve()
            if not path.is_relative_to(Path(files).resolve()):
                raise AssetSecurityError(f"{name!r}: leaves the folder")
            return path.read_bytes()
        data = files(name) if callable(files) else files.get(name)
        if data is None:
            raise FileNotFoundError(name)
        return data

    def differs(page: dict) -> bool:
        return canonical(page["body"]["storage"]["value"])["xhtml"] != ours

    def write(page: dict) -> dict:
        return client.update_page(page_id, page["title"], made["xhtml"], page["version"]["number"], message)

    page = client.get_page(page_id)
    written = differs(page)
    if written:
        try:
            page = write(page)
        except VersionConflict:
            if on_conflict == "abort":
                raise
            page = client.get_page(page_id)
            written = on_conflict == "force" or differs(page)
            if written:
                page = write(page)
    done = PushResult(written, page["version"]["number"], page=page)
    there = {a["title"]: a for a in client.list_attachments(page_id)} if made["attachments"] else {}
    for path in made["attachments"]:
        name = path.rsplit("/", 1)[-1]
        try:
            data = read(path)
            if name in there and size_matches(there[name], len(data)):
                continue
            client.upload_attachment(page_id, name, data)
            done.uploaded.append(name)
        except (MarkupError, OSError) as ex:
            log.warning("%s was not uploaded to page %s: %s", name, page_id, ex)
            done.failed.append((name, ex))
    done.changed = written or bool(done.uploaded)
    return done


def pull_markdown(client: WikiClient, page_id: str, *, assets: str = "none", asset_dir: str | Path | None = None, page_dir: str | Path = ".", options: Options | None = None) -> PullResult:
    """One page as Markdown. assets: `none`, or what its image links point to: `sidecar` for copies in asset_dir, linked
    from page_dir, `inline` for their bytes."""
    if assets not in ("none", "sidecar", "inline"):
        raise ValueError("assets is none, sidecar or inline")
    page = client.get_page(page_id)
    made = to_markdown(page["body"]["storage"]["value"], options, nodes=False)
    if made["error"]:
        raise MarkupError(made["error"]["message"])
    text, n = made["markdown"], 0
    if assets != "none":
        text, n = resolve_page(text, client.attachment_fetcher(page_id), mode=assets, asset_dir=asset_dir, page_dir=page_dir, options=options)
    return PullResult(text, page, made["warnings"], n)


def push_pages(pages: DataFrame, client: WikiClient, **how) -> DataFrame:
    """(page_id, changed, new_version, failed, error) of pages (page_id, markdown), a call for each; errors don't stop others.

    Each action on the frame asks the wiki again; a page that is as wanted is not written again. To write once from a job
    whose tasks may be repeated, and keep what came of it, use the sink in `sources.wiki`.

    how: options of `push_markdown`; files that pages refer to are looked up in `files`, which every executor must
    reach; without it they are in `failed`.
    """
    how = {"files": {}} | how

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            rows = []
            for page_id, markdown in zip(b["page_id"], b["markdown"], strict=True):
                try:
                    r = push_markdown(client, str(page_id), markdown, **how)
                    rows.append((str(page_id), r.changed, r.new_version, [n for n, _ in r.failed], None))
                except MarkupError as ex:
                    rows.append((str(page_id), None, None, None, str(ex)))
            yield pd.DataFrame(rows, columns=["page_id", "changed", "new_version", "failed", "error"]).astype({"new_version": "Int64"})

    return pages.select("page_id", "markdown").mapInPandas(run, "page_id string, changed boolean, new_version long, failed array<string>, error string")


def register(spark: SparkSession) -> None:
    """Make the data source `wiki_pages` known."""
    from . import wiki

    wiki.register(spark)
