"""Typed state is one value per bucket of keys, and ends where the batch forms do."""

import pytest
from pyspark.sql import functions as F
from test_streaming import events, rows_of, stream_of

from kinframe.streaming import live
from kinframe.streaming import progress as pg


@pytest.mark.parametrize("job", ["live", "limit"])
def test_values_follow_buckets_not_keys(spark, tmp_path, job):
    """Text keys, many to a bucket; events without scan all stay."""
    df = events(spark).withColumn("scan_id", F.when(F.col("event_id") % 23 > 0, F.concat(F.lit("s"), F.col("event_id") % 61)))
    stream = stream_of(spark, df, str(tmp_path / "in"))
    with live.rocks_state(spark):
        if job == "live":
            out, want = live.live_events_state(stream, buckets=4), pg.live_events(df)
        else:
            out, want = live.rate_limit_state(stream, 3, 600_000, "scan_id", buckets=4), pg.rate_limit(df, 3, 600_000, "scan_id")
        query = pg.run_available(out, str(tmp_path / "out"))
    assert query.awaitTermination(300) and query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert rows_of(got) == rows_of(want) and 0 < want.count()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]][-1]
    assert 0 < state["numRowsTotal"] <= 4


def test_a_key_is_forgotten_in_a_bucket_that_goes_on():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Timers:
        now = 0

        def getCurrentProcessingTimeInMs(self):
            return self.now

    import pandas as pd

    job, timers = live._Limits("string", 100, 50), Timers()
    job.known = Value()
    frame = lambda key, ms: iter([pd.DataFrame({"event_id": [ms], "key": [key], "ms": [ms]})])
    hits = []
    for timers.now, key, ms in [(0, "a", 1), (60, "b", 2), (90, "a", 3), (150, "b", 4), (195, "a", 5), (195, "b", 6)]:
        hits += next(iter(job.handleInputRows((0,), frame(key, ms), timers)))["hits"].tolist()
    # a comes back after 90 and 105 ms, b after 90 and 45.
    assert hits == [1, 1, 2, 2, 1, 3]
