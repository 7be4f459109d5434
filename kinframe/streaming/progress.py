"""Scan progress and rate limiting over tables; ``live`` has the streaming forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kinframe.operators.ranking import rank_in_group
from kinframe.session import materialize

# States after which a scan's later events are ignored.
IGNORED_AFTER = ("cancelled", "paused")


def event_ms(ts: str = "ts") -> Column:
    """Whole milliseconds of an event time (the zone does not matter for differences)."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")


# ------------------------------------------------------------------ latest state and running totals


def scan_status(events: DataFrame) -> DataFrame:
    """Latest state per scan, on a table or a stream: the last event by time, then id."""
    order = F.struct("ts", "event_id")
    return events.groupBy("scan_id").agg(
        F.max_by(F.struct("status", "event_id", "value"), order).alias("last"), F.max("ts").alias("updated_at")
    ).select("scan_id", "updated_at", "last.status", "last.event_id", "last.value")


def progress_counts(events: DataFrame) -> DataFrame:
    """Running totals per scan, on a table or a stream."""
    return events.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("status") == "done").alias("scanned"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum(F.when(F.col("status") == "done", F.floor("value"))).cast("long").alias("faces"),
    )


def live_events(events: DataFrame, ignored_after: tuple[str, ...] = IGNORED_AFTER) -> DataFrame:
    """Events up to and including each scan's first stopping event (batch form)."""
    order = F.struct("ts", "event_id")
    stops = events.where(F.col("status").isin(*ignored_after)).groupBy("scan_id").agg(F.min(order).alias("_stop"))
    return events.join(stops, "scan_id", "left").where(
        F.col("_stop").isNull() | (order <= F.col("_stop"))
    ).select(*events.columns)


# ------------------------------------------------------------------ rate limiting


def _limit_columns(df: DataFrame, limit: int, window_ms: int) -> DataFrame:
    over = F.col("hits") > limit
    return df.withColumns(
        {
            "limited": over,
            "remaining": F.greatest(F.lit(0), limit - F.col("hits")).cast("long"),
            "retry_after": F.when(over, F.ceil((F.col("opened") + window_ms - F.col("ms")) / 1000).cast("long")),
        }
    )


def window_openers(moments: DataFrame, window_ms: int) -> DataFrame:
    """``(key, ms, opened)`` for distinct moments of each key.

    A window opens at the first moment at or after the previous one's end, so a key is
    read in time order by one task. The task keeps a single number per key, and reads
    at most one row per key and millisecond, however many events there are.
    """
    schema = T.StructType([moments.schema["key"], T.StructField("ms", T.LongType()), T.StructField("opened", T.LongType())])

    def run(batches):
        current, opened = None, None
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            ms = batch.column("ms").to_numpy()
            found = np.zeros(len(ms), np.int64)
            cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(ms)] if len(ms) else [0]
            for start, stop in zip(cuts, cuts[1:]):
                if current is None or key[start] != current:
                    current, opened = key[start], ms[start]
                at = start
                while at < stop:
                    if ms[at] >= opened + window_ms:
                        opened = ms[at]
                    end = at + int(np.searchsorted(ms[at:stop], opened + window_ms))
                    found[at:end] = opened
                    at = end
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ms"), pa.array(found)], ["key", "ms", "opened"])

    return moments.repartition("key").sortWithinPartitions("key", "ms").mapInArrow(run, schema)


def rate_limit(events: DataFrame, limit: int, window_ms: int, key: str = "key") -> DataFrame:
    """Anchored fixed windows per key: hit number, limited flag, remaining, retry-after.

    ``events(event_id, ts, <key>)``; hits are numbered by time, then event id. A window
    that holds a large share of all events is numbered in ranges, not in one task.
    """
    rows = events.where(F.col(key).isNotNull()).select("event_id", F.col(key).alias("key"), event_ms().alias("ms"))
    moments = rows.select("key", "ms").distinct()
    placed = materialize(rows.join(window_openers(moments, window_ms), ["key", "ms"]))
    numbered = rank_in_group(placed, ["key", "opened"], ["ms", "event_id"], "hits")
    return _limit_columns(numbered, limit, window_ms).select(
        "event_id", "key", "ms", "opened", "hits", "limited", "remaining", "retry_after"
    )


# ------------------------------------------------------------------ running a job


def run_available(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into a Parquet folder, then stop."""
    return (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True).start()
    )
