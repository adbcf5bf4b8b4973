"""Keyed state over a stream of page versions: what each version is to its page, and sessions of edits.

The state is one row and one map a page, in the state store of the session, which must be able to hold maps:
`stateful_session` gives a session that can.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.converters import storage_hash
from ..sources.folders import shared_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the processor gives; times are microseconds, which no time zone touches on their way through Python.
EVENTS = StructType([
    StructField("page_id", LongType()), StructField("event", StringType()), StructField("ts", LongType()), StructField("until", LongType()),
    StructField("canonical", StringType()), StructField("edits", LongType()),
])


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside this one, whose settings stay as they are, that keeps state in a store with maps and timers."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


def page_of(key) -> int | None:
    """The page_id of a key; null is a key of its own."""
    return None if key[1] else int(key[0])


class PageHistory(StatefulProcessor):
    """State of a page: its last canonical hash, the session that is open, and which hashes it ever had."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string, start long, end long, edits long")
        self.seen = handle.getMapState("seen", "hash string", "n long")

    def _session(self, key, start: int, end: int, edits: int) -> Row:
        return Row(page_id=page_of(key), event="session", ts=start, until=end, canonical=None, edits=edits)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """The state is read once and written once for all rows of a page in a batch: each call to it goes over a socket."""
        batch = sorted(((r["at"], r["canonical"]) for r in rows), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        last, start, end, edits = self.last.get() or (None, None, None, 0)
        timed, counts = end, {}
        for at, found in batch:
            if found is None:  # a version that can't be read is no state of the page
                yield Row(page_id=page_of(key), event="unreadable", ts=at, until=None, canonical=None, edits=None)
                continue
            if found not in counts:
                counts[found] = (self.seen.getValue((found,)) or (0,))[0]
            event = "new" if last is None else "repeat" if found == last else "revert" if counts[found] else "edit"
            counts[found] += 1
            yield Row(page_id=page_of(key), event=event, ts=at, until=None, canonical=found, edits=None)
            last, now = found, at // 1000
            if event == "repeat":
                continue
            if end is not None and now - end >= self.gap:
                yield self._session(key, start * 1000, end * 1000, edits)
                start = None
            start, end, edits = (now, now, 1) if start is None else (min(start, now), max(end, now), edits + 1)
        for found, n in counts.items():
            self.seen.updateValue((found,), (n,))
        if end != timed:
            if timed is not None:
                self.handle.deleteTimer(timed + self.gap)
            self.handle.registerTimer(end + self.gap)
        if counts:
            self.last.update((last, start, end, edits))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, start, end, edits = self.last.get()
        if end is not None and end + self.gap <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.update((last, None, None, 0))
            yield self._session(key, start * 1000, end * 1000, edits)

    def close(self) -> None:
        pass


def page_events(stream: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(page_id, event, ts, until, canonical, edits) of a stream of versions (page_id long, ts, xhtml).

    Each version gives a row: `new` for a page's first, `repeat` if its canonical form is that of the version before it,
    `revert` if it is that of an earlier one, else `edit`; `unreadable` if it has none. And each session of edits gives one,
    from ts until the last of its `edits` versions that are no repeats, as soon as the watermark is a gap later or a version
    comes that is. Versions of a page count in order of ts, then of hash, within a batch; batches as they come.
    Rows later than the watermark are left out by Spark. Null page_ids are one page; rows without ts are left out.

    Only hashes reach the state, and only they are shuffled. A page keeps one row, and a count for each canonical form
    it ever had. The frame's session must be one of `stateful_session`.
    """
    milliseconds = int(stream.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {gap})").first()[0])
    hashed = stream.filter("ts IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), "ts", storage_hash("xhtml", "xhtml")["hash"].alias("canonical"))
    rows = hashed.withWatermark("ts", late)
    rows = rows.select(F.coalesce("page_id", F.lit(0)).alias("page"), F.col("page_id").isNull().alias("nowhere"), "ts", F.unix_micros("ts").alias("at"), "canonical")
    events = rows.groupBy("page", "nowhere").transformWithState(PageHistory(milliseconds), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
    return events.withColumns({c: F.timestamp_micros(c) for c in ("ts", "until")})


def events_of(spark: SparkSession, versions: DataFrame, **how) -> DataFrame:
    """`page_events` over the rows of a frame, written to a folder and read as a stream of one batch; sessions that are open
    at the end are not among the rows."""
    own, home = stateful_session(spark), shared_folder(spark, "history")
    versions.write.parquet(f"{home}/in")
    stream = own.readStream.schema(versions.schema).parquet(f"{home}/in")
    run = page_events(stream, **how).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out")
