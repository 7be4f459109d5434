"""Streaming jobs whose state is bounded: watermarks, typed state with a time to live.

Progress is aggregated per scan and time window under a watermark, so the state of a window
is dropped once no event of it can arrive any more; the windows themselves live on in a
bucketed table, of which a micro-batch rewrites only the buckets it touches. Late events
and rate limits keep typed state by key, in one value per bucket of keys, and forget a key
some time after its last use.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinframe.streaming.buckets import BUCKETS, BucketedTable
from kinframe.streaming.progress import IGNORED_AFTER, _limit_columns, event_ms

WINDOW = "1 day"
LATENESS = "1 hour"

# Fixed value: buckets that the keys of typed state are dealt to, each one value.
STATE_BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# ------------------------------------------------------------------ status and totals


def _windows(events: DataFrame, width: str, lateness: str):
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width).alias("w"), "scan_id")


def status_windows(events: DataFrame, width: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Per scan and window its last event by time, then id; on a stream under a watermark."""
    last = F.max_by(F.struct("ts", "status", "event_id", "value"), F.struct("ts", "event_id")).alias("last")
    return _windows(events, width, lateness).agg(last).select("scan_id", F.col("w.start").alias("opened"), "last.*")


def count_windows(events: DataFrame, width: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Per scan and window its counts; on a stream under a watermark."""
    done = F.col("status") == "done"
    counts = _windows(events, width, lateness).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(done).alias("scanned"), F.count_if(F.col("status") == "error").alias("errors"),
        F.sum(F.when(done, F.floor("value"))).cast("long").alias("faces"),
    )
    return counts.select("scan_id", F.col("w.start").alias("opened"), "processed", "scanned", "errors", "faces")


def status_of_windows(table: DataFrame) -> DataFrame:
    """The latest state per scan from the windows."""
    last = F.max_by(F.struct("status", "event_id", "value"), F.struct("ts", "event_id")).alias("last")
    return table.groupBy("scan_id").agg(last, F.max("ts").alias("updated_at")).select("scan_id", "updated_at", "last.status", "last.event_id", "last.value")


def counts_of_windows(table: DataFrame) -> DataFrame:
    """Running totals per scan from the windows."""
    return table.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in ("processed", "scanned", "errors", "faces")])


def keep_windows(windows: DataFrame, root: str, state: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Maintain the table of windows from the stream; returns the running query.

    A window's row is replaced whenever it changes. ``window_table`` reads the result.
    """
    table = window_table(windows.sparkSession, root, windows.schema, buckets)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)

    return windows.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", state).trigger(availableNow=True).start()


def window_table(spark: SparkSession, root: str, schema: T.StructType, buckets: int = BUCKETS) -> BucketedTable:
    """Windows by scan, so that all windows of a scan lie in one bucket."""
    return BucketedTable(spark, root, ["scan_id", "opened"], schema, buckets)


# ------------------------------------------------------------------ typed state


@contextmanager
def rocks_state(spark: SparkSession):
    """Typed state needs the RocksDB store; queries started inside use it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _bucket(key: Column, buckets: int) -> Column:
    """The bucket whose state holds the key; -1 without key."""
    return F.when(key.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).alias("_bucket")


class _Buckets(StatefulProcessor):
    """One typed value per bucket of keys: its keys, what is known of each, and when it was last used.

    A value is read and written once per bucket and micro-batch, however many keys it holds.
    A key that was not used for ``ttl_ms`` counts as unknown and goes when its bucket is written
    next; the value of a bucket that is never written again goes as a whole.
    """

    fields: tuple[str, ...] = ()

    def __init__(self, key_type: str, ttl_ms: int | None):
        self.key_type, self.ttl_ms = key_type, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = [f"keys array<{self.key_type}>", *(f"{name} array<long>" for name in (*self.fields, "used"))]
        self.known = handle.getValueState("known", ", ".join(columns), self.ttl_ms)

    def _now(self, timers) -> int:
        return timers.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0

    def _read(self, now: int) -> dict:
        """What is known by key: the fields, then the time of the last use."""
        if not self.known.exists():
            return {}
        keys, *columns = self.known.get()
        found = dict(zip(keys, zip(*columns)))
        return found if self.ttl_ms is None else {k: v for k, v in found.items() if v[-1] + self.ttl_ms > now}

    def _write(self, known: dict) -> None:
        columns = zip(*known.values())
        self.known.update((list(known), *(list(c) for c in columns)))

    def close(self) -> None:
        pass


class _Stops(_Buckets):
    """The scans that stopped; their later events are dropped. Events without scan all stay."""

    def __init__(self, key_type: str, ttl_ms: int | None, ignored_after: tuple[str, ...], columns: list[str]):
        super().__init__(key_type, ttl_ms)
        self.ignored_after, self.columns = ignored_after, columns

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            for piece in rows:
                yield piece[self.columns]
            return
        now = self._now(timerValues)
        known = self._read(now)
        pieces = [p[~p["scan_id"].isin(list(known))] if known else p for p in rows]
        ends = pd.concat([p[p["status"].isin(self.ignored_after)] for p in pieces])
        firsts = ends.sort_values(["us", "event_id"]).drop_duplicates("scan_id")
        scans, us, events = pd.Index(firsts["scan_id"]), firsts["us"].to_numpy(), firsts["event_id"].to_numpy()
        for piece in pieces:
            if len(scans):
                at = scans.get_indexer(piece["scan_id"])
                own, number = piece["us"].to_numpy(), piece["event_id"].to_numpy()
                piece = piece[(at < 0) | (own < us[at]) | ((own == us[at]) & (number <= events[at]))]
            yield piece[self.columns]
        if len(scans):
            self._write(known | {scan: (now,) for scan in scans.tolist()})


def live_events_state(
    events: DataFrame, ignored_after: tuple[str, ...] = IGNORED_AFTER, ttl_ms: int | None = None, buckets: int = STATE_BUCKETS
) -> DataFrame:
    """Events up to each scan's first stopping one, on a stream.

    Within a micro-batch events are taken by time; a scan that stopped stays stopped for
    ``ttl_ms`` after that, or for good. A query with a time to live runs until it is stopped,
    so runs that end with their input leave it out. Start it inside ``rocks_state``. The number
    of ``buckets`` that scans are dealt to stays that of the first run.
    """
    rows = events.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "_bucket": _bucket(F.col("scan_id"), buckets)})
    stops = _Stops(events.schema["scan_id"].dataType.simpleString(), ttl_ms, tuple(ignored_after), events.columns)
    return rows.groupBy("_bucket").transformWithStateInPandas(stops, events.schema, "Append", "None" if ttl_ms is None else "ProcessingTime")


class _Limits(_Buckets):
    """The open windows of keys and the hits in them."""

    fields = ("opened", "hits")

    def __init__(self, key_type: str, ttl_ms: int | None, window_ms: int):
        super().__init__(key_type, ttl_ms)
        self.window_ms = window_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        known = self._read(now)
        frame = pd.concat(list(rows))
        codes, names = pd.factorize(frame["key"])
        ms, events = frame["ms"].to_numpy(), frame["event_id"].to_numpy()
        order = np.lexsort((events, ms, codes))
        codes, ms, events = codes[order], ms[order], events[order]
        opened, hits = np.empty(len(ms), np.int64), np.empty(len(ms), np.int64)
        ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
        at = 0
        for name, stop in zip(names.tolist(), ends):
            start, count, _ = known.get(name, (None, 0, 0))
            while at < stop:  # a step per window, not per event
                if start is None or ms[at] >= start + self.window_ms:
                    start, count = int(ms[at]), 0
                end = max(at + 1, at + int(np.searchsorted(ms[at:stop], start + self.window_ms)))
                opened[at:end], hits[at:end] = start, count + np.arange(1, end - at + 1)
                count, at = count + end - at, end
            known[name] = (start, count, now)
        self._write(known)
        yield pd.DataFrame({"event_id": events, "key": frame["key"].to_numpy()[order], "ms": ms, "opened": opened, "hits": hits})


def rate_limit_state(events: DataFrame, limit: int, window_ms: int, key: str | Column = "key", ttl_ms: int | None = None, buckets: int = STATE_BUCKETS) -> DataFrame:
    """Anchored fixed windows per key, on a stream: hit number, flag, remaining, retry-after.

    Within a micro-batch events are taken by time. A key's window is forgotten ``ttl_ms``
    after its last hit, which must be longer than a window; as above, such a query runs until
    it is stopped. Start it inside ``rocks_state``. The number of ``buckets`` that keys are dealt
    to stays that of the first run.
    """
    if ttl_ms is not None and ttl_ms < window_ms:
        raise ValueError("a window must not be forgotten before it ends")
    named = F.col(key) if isinstance(key, str) else key
    rows = events.where(named.isNotNull()).select("event_id", named.alias("key"), event_ms().alias("ms"))
    out = T.StructType([*rows.schema.fields, T.StructField("opened", T.LongType()), T.StructField("hits", T.LongType())])
    limits = _Limits(rows.schema["key"].dataType.simpleString(), ttl_ms, window_ms)
    dealt = rows.withColumn("_bucket", _bucket(F.col("key"), buckets)).groupBy("_bucket")
    counted = dealt.transformWithStateInPandas(limits, out, "Append", "None" if ttl_ms is None else "ProcessingTime")
    return _limit_columns(counted, limit, window_ms)
