"""Keyed state over streams of page versions, against a plain replay."""

import datetime as dt
import random

from docspark.markup.convert import hashed
from docspark.streaming import history

GAP, START = dt.timedelta(minutes=30), dt.datetime(2024, 1, 1)
SCHEMA = "page_id long, ts timestamp, xhtml string, event string"


def replay(rows):
    """Events of versions in order, and all sessions."""
    out = []
    for page in {r[0] for r in rows}:
        last, seen, start, end, n = None, set(), None, None, 0
        for _, ts, xhtml, _ in sorted((r for r in rows if r[0] == page), key=lambda r: (r[1], hashed(r[2], "xhtml")[0] or "")):
            found = hashed(xhtml, "xhtml")[0]
            if found is None:
                out.append((page, "unreadable", ts, None, None, None))
                continue
            event = "new" if last is None else "repeat" if found == last else "revert" if found in seen else "edit"
            out.append((page, event, ts, None, found, None))
            seen.add(found)
            last = found
            if event == "repeat":
                continue
            if end is not None and ts - end >= GAP:
                out.append((page, "session", start, end, None, n))
                start, n = None, 0
            start, end, n = start or ts, ts, n + 1
        if end is not None:
            out.append((page, "session", start, end, None, n))
    return sorted(map(repr, out))


def got(frame):
    return sorted(repr(tuple(r)) for r in frame.filter("page_id IS NULL OR page_id >= 0").collect())


def versions(seed, first, last):
    r = random.Random(seed)
    bodies = ["<p>a</p>", "<p>a<br/></p>", "<p>b</p>", "<p>c</p>", "<p>", None]
    return [(r.choice([1, 2, 3, None]), START + dt.timedelta(minutes=r.randrange(first, last)), r.choice(bodies), "x") for _ in range(60)]


END = (-1, START + dt.timedelta(days=900), "<p/>", None)


def test_events_equal_a_replay(spark):
    for seed in (1, 2):
        rows = versions(seed, 0, 900)
        frame = spark.createDataFrame([*rows, END, (1, None, "<p>no time</p>", None)], SCHEMA).repartition(3)
        assert got(history.events_of(spark, frame)) == replay(rows)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert before != history.PROVIDER


def test_state_lasts_from_run_to_run(spark, tmp_path):
    """Three runs of one stream, each over what has come since, give what one replay gives."""
    own, rows = history.stateful_session(spark), []
    for n, (first, last) in enumerate([(0, 300), (330, 600), (600, 900)]):
        part = versions(10 + n, first, last)
        rows += part
        spark.createDataFrame(part + ([END] if n == 2 else []), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        run = history.page_events(stream, gap="30 minutes", late="10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    assert got(spark.read.parquet(f"{tmp_path}/out")) == replay(rows)


class Calls:
    """A handle and its states in one, which counts the calls that would go over the socket."""

    def __init__(self):
        self.n, self.value, self.map, self.timers = 0, None, {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, key, value):  # noqa: N802
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def getValue(self, key):  # noqa: N802
        self.n += 1
        return self.map.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.n += 1
        self.map[key] = value

    def registerTimer(self, at):  # noqa: N802
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.n += 1
        self.timers.discard(at)


def test_state_is_read_and_written_once_a_batch():
    calls, page = Calls(), history.PageHistory(60_000)
    page.init(calls)
    for batch in (0, 1):
        calls.n = 0
        rows = [{"at": (batch * 300 + i) * 10_000_000, "canonical": "abc"[i % 3]} for i in range(300)]
        events = [r.event for r in page.handleInputRows((1, False), iter(rows), None)]
        assert len(events) == 300 and events.count("revert") == (300 if batch else 297) and calls.n <= 1 + 3 + 3 + 2 + 1
        end = (batch * 300 + 299) * 10_000
        assert calls.timers == {end + 60_000} and calls.value == ("c", 0, end, (batch + 1) * 300)
        assert calls.map == {(c,): ((batch + 1) * 100,) for c in "abc"}
