"""The data source `wiki_pages`: pages of a wiki in batches and as a stream of changes, and a sink that writes once.

Options of all: `base_url`, `token` or `token_env` or `token_file` or `email` with `token`, `timeout`, `batch` (pages a
request, default 50), `space`. See the classes for the others. A secret in `token` stands in query plans; the other two don't.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..markup.convert import canonical, to_storage
from ..markup.tree import MarkupError
from .rest import EXPAND, HTTPError, VersionConflict, WikiClient, basic, bearer, bearer_env, bearer_file, size_matches

NAME = "wiki_pages"
SCHEMA = "page_id string, title string, version int, xhtml string, error string, space string, modified timestamp"
MINUTE = "%Y-%m-%d %H:%M"
UTC = dt.timezone.utc
#: Passes over a slice of changes that moves while it is read.
PASSES = 10


def client_of(options: dict[str, str]) -> WikiClient:
    if "token_env" in options:
        auth = bearer_env(options["token_env"])
    elif "token_file" in options:
        auth = bearer_file(options["token_file"])
    elif "email" in options:
        auth = basic(options["email"], options.get("token", ""))
    else:
        auth = bearer(options.get("token", ""))
    how = {"timeout": float(options["timeout"])} if "timeout" in options else {}
    return WikiClient(options["base_url"], auth, options.get("dialect", "server"), **how)


# --- reading ------------------------------------------------------------------------------------------------


def moment(when: str | None) -> dt.datetime | None:
    """The time of a version."""
    return dt.datetime.fromisoformat(when.replace("Z", "+00:00")) if when else None


def floor_minute(t: dt.datetime) -> dt.datetime:
    t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    return t.replace(second=0, microsecond=0)


def row_of(page: dict) -> tuple:
    version = page.get("version") or {}
    body = ((page.get("body") or {}).get("storage") or {}).get("value")
    return str(page["id"]), page.get("title"), version.get("number"), body, None, (page.get("space") or {}).get("key"), moment(version.get("when"))


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def conditions(space: str | None = None, since: str | None = None, before: str | None = None) -> str:
    """A search for pages, as text of the wiki's query language; times are whole minutes, `before` is not included."""
    parts = ["type = page"]
    parts += [f"space = {quoted(space)}"] if space else []
    parts += [f"lastmodified >= {quoted(since)}"] if since else []
    parts += [f"lastmodified < {quoted(before)}"] if before else []
    return " and ".join(parts)


class Slice(InputPartition):
    """What one task reads: ids, or the found pages from a place on, or those changed in a span of time."""

    def __init__(self, ids: list[str] | None = None, search: str = "", start: int = 0, limit: int | None = None):
        self.ids, self.search, self.start, self.limit = ids, search, start, limit


def read_ids(client: WikiClient, ids: list[str]) -> Iterator[tuple]:
    for page_id in ids:
        try:
            yield row_of(client.get_page(page_id))
        except HTTPError as ex:
            yield page_id, None, None, None, str(ex), None, None


def read_found(client: WikiClient, search: str, batch: int, start: int = 0, limit: int | None = None) -> Iterator[dict]:
    """Found pages one request after the other."""
    at, end = start, math.inf if limit is None else start + limit
    while at < end:
        found = client.search(search, at, int(min(batch, end - at)), EXPAND)
        yield found
        n = len(found.get("results", []))
        at += n
        if not n or at >= found.get("totalSize", math.inf):
            return


def read_changes(client: WikiClient, search: str, batch: int) -> Iterator[tuple]:
    """All pages of a span of time. A page that changes meanwhile leaves the span and moves the others up by one place, so
    the span is read again until a pass saw the same number throughout; each page is given once."""
    seen: set[str] = set()
    for _ in range(PASSES):
        totals = set()
        for found in read_found(client, search, batch):
            totals.add(found.get("totalSize"))
            for page in found.get("results", []):
                if str(page["id"]) not in seen:
                    seen.add(str(page["id"]))
                    yield row_of(page)
        if len(totals) < 2:
            return


class WikiPages(DataSource):
    """spark.read.format("wiki_pages").option("base_url", ...).option("token_env", ...).option("space", "DOC").load()

    Rows (page_id, title, version, xhtml, error, space, modified). With `ids` ("1,2") these pages are read, and one that
    can't be has its error; else all pages of the space, or of the wiki. With the option `pushdown`
    filters on page_id, space and modified are handed to the wiki, for which spark.sql.python.filterPushdown.enabled must be set.

    spark.readStream gives changes: each version that is the last of its page when its minute is read, once. `since`
    ("2024-01-31 10:00", default all) is where it starts, `lag_seconds` (default 60) how long after its end a minute is read.
    Times are those of the wiki in UTC.

    frame.write and frame.writeStream publish pages; see `WikiWriter`.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteringReader if self.options.get("pushdown", "false").lower() == "true" else WikiReader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WikiChanges(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WikiWriter(dict(self.options), schema.names)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return WikiStreamWriter(dict(self.options), schema.names)


class WikiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.batch = options, int(options.get("batch", "50"))
        self.ids = [i.strip() for i in options["ids"].split(",") if i.strip()] if "ids" in options else None
        self.space, self.since, self.before = options.get("space"), None, None

    def partitions(self) -> list[InputPartition]:
        if self.ids is not None:
            return [Slice(self.ids[i : i + self.batch]) for i in range(0, len(self.ids), self.batch)] or [Slice([])]
        search = conditions(self.space, self.since, self.before) + " order by created"
        total = client_of(self.options).search(search, 0, 1).get("totalSize", 0)
        return [Slice(None, search, i, self.batch) for i in range(0, total, self.batch)] or [Slice([])]

    def read(self, partition: Slice):
        client = client_of(self.options)
        if partition.ids is not None:
            yield from read_ids(client, partition.ids)
            return
        for found in read_found(client, partition.search, self.batch, partition.start, partition.limit):
            yield from map(row_of, found.get("results", []))


class FilteringReader(WikiReader):
    """Spark takes such a reader only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters):
        """Ids and spaces are wholly seen to, times up to the minute, so that Spark looks at these again."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("page_id",) and isinstance(f, (EqualTo, In)):
                wanted = [str(v) for v in ([value] if isinstance(f, EqualTo) else value) if v is not None]
                self.ids = list(dict.fromkeys(wanted if self.ids is None else [i for i in self.ids if i in wanted]))
            elif column == ("space",) and isinstance(f, EqualTo) and self.space is None:
                self.space = value
                if self.ids is not None:
                    yield f
            elif column == ("modified",) and isinstance(value, dt.datetime):
                minute = floor_minute(value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.since = max(filter(None, [self.since, minute.strftime(MINUTE)]))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.before = min(filter(None, [self.before, (minute + dt.timedelta(minutes=1)).strftime(MINUTE)]))
                yield f
            else:
                yield f


class WikiChanges(DataSourceStreamReader):
    """Offsets are minutes: a batch has the pages that were last changed from one up to, without, the next."""

    def __init__(self, options: dict[str, str]):
        self.options, self.batch = options, int(options.get("batch", "50"))

    def initialOffset(self) -> dict:
        return {"minute": self.options.get("since", "1970-01-01 00:00")}

    def latestOffset(self) -> dict:
        lag = dt.timedelta(seconds=float(self.options.get("lag_seconds", "60")))
        return {"minute": floor_minute(client_of(self.options).now() - lag).strftime(MINUTE)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (dt.datetime.strptime(o["minute"], MINUTE) for o in (start, end))
        if first >= last:
            return []
        found = client_of(self.options).search(conditions(self.options.get("space"), start["minute"], end["minute"]) + " order by lastmodified", 0, 1, "version")
        total = found.get("totalSize", 0)
        if not total:
            return []
        # the oldest change may be long after the start
        oldest = moment((found["results"][0].get("version") or {}).get("when")) if found.get("results") else None
        if oldest is not None:
            first = max(first, floor_minute(oldest).replace(tzinfo=None))
        minutes = int((last - first).total_seconds() // 60)
        n = max(1, min(minutes, math.ceil(total / self.batch)))
        edges = [(first + dt.timedelta(minutes=minutes * i // n)).strftime(MINUTE) for i in range(n + 1)]
        return [Slice(None, conditions(self.options.get("space"), a, b) + " order by lastmodified") for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Slice):
        yield from read_changes(client_of(self.options), partition.search, self.batch)


# --- writing ------------------------------------------------------------------------------------------------


def same_page(page: dict, ours: str) -> bool:
    return canonical(page["body"]["storage"]["value"])["xhtml"] == ours


def publish_once(client: WikiClient, page_id: str, xhtml: str, base: int | None = None, *, title: str | None = None, message: str = "") -> tuple[str, int]:
    """Make a page's body this one: (`written`, `unchanged` or `conflict`, the page's version now).

    Attempts may be repeated, at the same time too: the wiki takes a version number once, and what an earlier attempt has
    written is recognised by its canonical form. base: the version that the body was made from; a page that has another one by
    now, with another body, is a conflict and stays. Without base the body is compared with whatever is there.
    """
    ours, failed = canonical(xhtml)["xhtml"], None
    for _ in range(3):
        page = client.get_page(page_id)
        now = page["version"]["number"]
        if same_page(page, ours):
            return ("unchanged" if failed is None and base in (None, now) else "written"), now
        if base is not None and now != base:
            return "conflict", now
        try:
            client.update_page(page_id, page["title"] if title is None else title, xhtml, now, message)
            return "written", now + 1
        except HTTPError as ex:
            if not isinstance(ex, VersionConflict) and ex.status != -1:
                raise
            failed = ex  # another attempt was first, or the answer was lost: look again
    raise failed


def create_once(client: WikiClient, space: str, title: str, xhtml: str, parent: str | None = None) -> tuple[str, str, int]:
    """A new page, unless there is one of that title: (`created`, `unchanged` or `conflict`, id, version)."""
    ours = canonical(xhtml)["xhtml"]

    def there(how: str):
        page = client.find_page(space, title)
        return page and (how if same_page(page, ours) else "conflict", str(page["id"]), page["version"]["number"])

    if found := there("unchanged"):
        return found
    try:
        page = client.create_page(space, title, xhtml, parent)
        return "created", str(page["id"]), (page.get("version") or {}).get("number", 1)
    except HTTPError as ex:
        if (ex.status in (-1, 400, 409)) and (found := there("created")):
            return found
        raise


def upload_once(client: WikiClient, page_id: str, files: dict[str, bytes]) -> list[str]:
    """Names of the files that the page did not have; the hash of a file is its comment."""
    there = {a["title"]: a for a in client.list_attachments(page_id)} if files else {}
    out = []
    for name, data in files.items():
        mark = "sha256:" + hashlib.sha256(data).hexdigest()
        held = there.get(name)
        comment = held and ((held.get("metadata") or {}).get("comment") or (held.get("extensions") or {}).get("comment") or "")
        if held and size_matches(held, len(data)) and (not comment.startswith("sha256:") or comment == mark):
            continue
        client.upload_attachment(page_id, name, data, mark)
        out.append(name)
    return out


@dataclass
class Written(WriterCommitMessage):
    """What a task did: how many pages of each outcome, the file with its outcomes, and what went wrong if there is none."""

    counts: dict[str, int]
    file: str | None = None
    errors: tuple[tuple[str | None, str], ...] = ()


class WikiWriter(DataSourceWriter):
    """frame.write.format("wiki_pages").mode("append").option("base_url", ...).save()

    Rows hold `page_id` and `markdown` or `xhtml`; optionally `version` (what the body was made from), `title`, and `files`
    (map<string, binary>). Without page_id a page of that title is made in the option `space`. A row that can't be
    published is an outcome and stops nothing; with the option `strict` the job fails when all are done.

    A task that is run again, or twice at once, writes each page once (see `publish_once`). With the option `manifest`, a
    folder that driver and executors share (any address that Arrow can open), each task leaves its outcomes in a file of its own,
    and the commit lists the files of the tasks that count: read them with `outcomes`. The driver gets counts only, and
    without a manifest the errors.
    """

    def __init__(self, options: dict[str, str], names: list[str]):
        if not {"markdown", "xhtml"} & set(names):
            raise ValueError("pages need a column markdown or xhtml")
        self.options, self.names, self.job = options, names, options.get("job") or uuid.uuid4().hex

    def folder(self, part: str = ""):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.options["manifest"])
        path = f"{path.rstrip('/')}/{self.job}{part}"
        files.create_dir(path, recursive=True)
        return files, path

    def put(self, name: str, data: str, part: str = "") -> str:
        """Write a file under another name first, so that nobody sees half of it."""
        files, path = self.folder(part)
        own = f"{path}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(own) as out:
            out.write(data.encode())
        files.move(own, f"{path}/{name}")
        return f"{path}/{name}"

    def publish(self, client: WikiClient, row) -> tuple:
        """(page_id, outcome, version, uploaded, error)"""
        get = lambda name: row[name] if name in self.names else None
        page_id = get("page_id")
        page_id = None if page_id is None else str(page_id)
        try:
            xhtml = get("xhtml")
            if xhtml is None:
                made = to_storage(get("markdown") or "", nodes=False)
                if made["error"]:
                    raise MarkupError(made["error"]["message"])
                xhtml = made["xhtml"]
            if problem := canonical(xhtml)["error"]:
                raise MarkupError(problem["message"])
            if page_id is None:
                if not (get("title") and self.options.get("space")):
                    raise MarkupError("a new page needs a title and the option space")
                outcome, page_id, version = create_once(client, self.options["space"], get("title"), xhtml, self.options.get("parent"))
            else:
                outcome, version = publish_once(client, page_id, xhtml, get("version"), title=get("title"), message=self.options.get("message", ""))
            files = {k: bytes(v) for k, v in (get("files") or {}).items() if v is not None}
            return page_id, outcome, version, upload_once(client, page_id, files) if outcome != "conflict" else [], None
        except MarkupError as ex:
            return page_id, "error", None, [], str(ex)

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        client, counts, lines, errors = client_of(self.options), {}, [], []
        kept = "manifest" in self.options
        for row in iterator:
            done = self.publish(client, row)
            counts[done[1]] = counts.get(done[1], 0) + 1
            if kept:
                lines.append(json.dumps(dict(zip(("page_id", "outcome", "version", "uploaded", "error"), done, strict=True))))
            elif done[4]:
                errors.append((done[0], done[4]))
        file = None
        if kept and lines:
            task = TaskContext.get()
            file = self.put(f"part-{task.partitionId()}-{task.taskAttemptId()}.jsonl" if task else f"part-{uuid.uuid4().hex}.jsonl", "\n".join(lines) + "\n")
        return Written(counts, file, tuple(errors))

    def close(self, messages: list[Written | None], name: str) -> None:
        done = [m for m in messages if m is not None]
        counts: dict[str, int] = {}
        for m in done:
            for k, n in m.counts.items():
                counts[k] = counts.get(k, 0) + n
        if "manifest" in self.options:
            self.put(name, json.dumps({"files": sorted(m.file for m in done if m.file), "counts": counts}))
        if self.options.get("strict", "false").lower() == "true" and (counts.get("error") or counts.get("conflict")):
            raise MarkupError(f"not all pages were published: {counts} {[e for m in done for e in m.errors][:20]}")

    def commit(self, messages: list[Written | None]) -> None:
        self.close(messages, "committed.json")

    def abort(self, messages: list[Written | None]) -> None:
        if "manifest" in self.options:
            self.put("aborted.json", json.dumps({"files": sorted(m.file for m in messages if m is not None and m.file)}))


class WikiStreamWriter(WikiWriter, DataSourceStreamWriter):
    """The same for each batch of a stream; a batch that is run again after a failure replaces its own list."""

    def commit(self, messages, batchId: int) -> None:
        self.close(messages, f"committed-{batchId}.json")

    def abort(self, messages, batchId: int) -> None:
        if "manifest" in self.options:
            self.put(f"aborted-{batchId}.json", json.dumps({"files": sorted(m.file for m in messages if m is not None and m.file)}))


def outcomes(spark: SparkSession, manifest: str, job: str) -> DataFrame:
    """(page_id, outcome, version, uploaded, error) of a job's committed tasks; files of failed attempts are left out."""
    folder = f"{manifest.rstrip('/')}/{job}"
    lists = spark.read.schema("files array<string>").json(f"{folder}/committed*.json").select(F.explode("files").alias("f"))
    names = lists.select(F.element_at(F.split("f", "/"), -1).alias("file"))
    rows = spark.read.schema("page_id string, outcome string, version long, uploaded array<string>, error string").json(f"{folder}/part-*.jsonl")
    rows = rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.join(names.distinct(), "file", "left_semi").drop("file")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WikiPages)


def options_of(client: WikiClient, **more: str) -> dict[str, str]:
    """Options for a client, but for who asks."""
    held = {f.name: getattr(client, f.name) for f in dataclasses.fields(client)}
    return {"base_url": held["base_url"], "dialect": held["dialect"], "timeout": str(held["timeout"])} | more
