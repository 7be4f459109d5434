"""Streams with bounded state end where their batch forms do."""

import pytest
from pyspark.sql import functions as F
from test_streaming import events, rows_of, stream_of

from kinframe.streaming import live
from kinframe.streaming import progress as pg
from kinframe.streaming.buckets import BucketedTable


def test_windows_equal_the_batch_and_old_state_goes(spark, tmp_path):
    df = events(spark)
    for name, make, read, batch in (
        ("status", live.status_windows, live.status_of_windows, pg.scan_status),
        ("counts", live.count_windows, live.counts_of_windows, pg.progress_counts),
    ):
        windows = make(stream_of(spark, df, str(tmp_path / f"in-{name}")), "10 minutes", "5 minutes")
        root = str(tmp_path / name)
        query = live.keep_windows(windows, root, str(tmp_path / f"state-{name}"), buckets=4)
        assert query.awaitTermination(120) and query.exception() is None
        got = read(live.window_table(spark, root, windows.schema).read())
        assert rows_of(got) == rows_of(batch(df).select(*got.columns))
        states = [p["stateOperators"][0] for p in query.recentProgress]
        assert sum(s["numRowsRemoved"] for s in states) > 0
        assert states[-1]["numRowsTotal"] < make(df, "10 minutes", "5 minutes").count()


def test_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    table = BucketedTable(spark, root, ["k"], "k long, v string", buckets=8)
    assert table.read().count() == 0 and table.last_batch() is None
    rows = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    assert len(table.upsert(rows([(i, "a") for i in range(100)]), 0)) == 8
    reader = table.read()
    touched = table.upsert(rows([(3, "b"), (500, "b")]), 1)
    assert 1 <= len(touched) <= 2 and table.upsert(rows([(3, "x")]), 1) == []
    assert reader.where("v = 'a'").count() == 100  # the version before stays readable
    for batch in range(2, 6):
        table.upsert(rows([(3, f"c{batch}")]), batch)
    assert rows_of(table.read().where("k IN (2, 3, 500)")) == [("2", "a"), ("3", "c5"), ("500", "b")]
    assert table.read().count() == 101
    names = sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert [n for n in names if n.startswith("MANIFEST")] == ["MANIFEST-000000000004.json", "MANIFEST-000000000005.json"]
    assert len([n for n in names if n.startswith("b-")]) <= 4


@pytest.mark.parametrize("hot", [False, True])
def test_typed_state(spark, tmp_path, hot):
    df = events(spark)
    if hot:  # nearly all events belong to one key
        df = df.withColumn("scan_id", F.when(F.col("event_id") % 17 == 0, F.col("scan_id")).otherwise(F.lit(1).cast("long")))
    jobs = {
        "live": (live.live_events_state, pg.live_events(df)),
        "limit": (lambda s: live.rate_limit_state(s, 3, 600_000, "scan_id"), pg.rate_limit(df, 3, 600_000, "scan_id")),
    }
    for name, (job, want) in jobs.items():
        with live.rocks_state(spark):
            query = pg.run_available(job(stream_of(spark, df, str(tmp_path / f"in-{name}"))), str(tmp_path / name))
        assert query.awaitTermination(300) and query.exception() is None
        got = spark.read.parquet(str(tmp_path / name)).select(*want.columns)
        assert rows_of(got) == rows_of(want) and 0 < want.count()


def test_typed_state_is_forgotten(spark, tmp_path):
    """A stream with a time to live runs on by itself; its state goes without new events."""
    df = events(spark).where("scan_id < 2")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    with live.rocks_state(spark):
        query = live.rate_limit_state(source, 3, 600, "scan_id", ttl_ms=1_000).writeStream.format("memory").queryName("forgotten").start()
    try:
        for _ in range(60):
            states = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
            if sum(m.get("numValuesRemovedDueToTTLExpiry", 0) for m in states) >= 2:
                break
            assert not query.awaitTermination(2)
        else:
            raise AssertionError("state was kept")
    finally:
        query.stop()
    with pytest.raises(ValueError):
        live.rate_limit_state(df, 3, 600_000, "scan_id", ttl_ms=10)


def test_store_equals_one_run_over_all_faces(spark, tmp_path):
    from test_merge_tree import crowd

    from kinframe.operators.cluster import cluster_faces
    from kinframe.streaming.cluster_store import ClusterStore

    faces = crowd(spark, 11, 50).drop("label")
    store = ClusterStore(spark, str(tmp_path / "store"), 0.8, 0.85, buckets=8)
    full = lambda df: rows_of(cluster_faces(df, 0.8, 0.85).select("face_order", "root", "cluster"))
    # Late pieces hold earlier faces, which become the first members of known clusters.
    pieces = [faces.where("face_order % 3 = 1 AND face_order > 40"), faces.where("face_order <= 90"), faces]
    assert store.add(pieces[0], 0) > 0
    assert rows_of(store.clusters()) == full(pieces[0])
    again = store.add(pieces[1], 1)
    assert rows_of(store.clusters()) == full(pieces[0].unionByName(pieces[1]).dropDuplicates(["face_order"]))
    assert store.add(pieces[1], 1) == 0 and store.add(pieces[1], 2) == 0
    assert store.add(pieces[2], 3) > 0 and again > 0
    assert rows_of(store.clusters()) == full(faces)
    less = faces.where("face_order % 7 <> 2")
    changed = store.sync(less, 4)
    assert rows_of(store.clusters()) == full(less) and changed < less.count()
