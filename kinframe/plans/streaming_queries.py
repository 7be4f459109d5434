"""The streaming jobs over the fixture views: batch forms, and streams over written files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinframe.operators.ingest import ingest
from kinframe.plans.ingest_queries import BATCH_SQL, INGEST_SQL, batch, new_detections
from kinframe.plans import vector_queries  # noqa: F401  (its SQL is shared)
from kinframe.plans.registry import REGISTRY, ctes, query
from kinframe.session import checkpoint_root, materialize
from kinframe.streaming import live
from kinframe.streaming import progress as pg
from kinframe.streaming.cluster_store import ClusterStore, cluster_stream

WINDOW_MS = 6 * 60 * 60 * 1000


@query("t01_scan_status", ctes("scan_events") + """
SELECT scan_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, arg_max(status, (ts, event_id)) AS status,
       arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM scan_events GROUP BY scan_id""")
def t01(v):
    rows = pg.scan_status(v.scan_events)
    return rows.withColumns({"updated_at": F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), "value": F.round("value", 6)})


@query("t02_live_events", ctes("scan_events") + """,
s AS (SELECT scan_id, min((ts, event_id)) AS stop FROM scan_events WHERE status = 'error' GROUP BY scan_id)
SELECT e.event_id, e.scan_id, e.status FROM scan_events e LEFT JOIN s ON s.scan_id = e.scan_id WHERE s.stop IS NULL OR (e.ts, e.event_id) <= s.stop""")
def t02(v):
    return pg.live_events(v.scan_events, ("error",)).select("event_id", "scan_id", "status")


@query("t03_incremental_ingest", ctes("photos", "detections") + "," + BATCH_SQL + "," + INGEST_SQL + """
SELECT photo_id, path, content_hash FROM photos UNION ALL SELECT photo_id, path, content_hash FROM kept""")
def t03(v):
    """The same batch twice: the repeat must add nothing."""
    photos, faces = ingest(v.photos, v.faces, batch(v), new_detections(v), min_quality=0.25)
    again, _ = ingest(photos, faces, batch(v), new_detections(v), min_quality=0.25)
    return again.select("photo_id", "path", "content_hash")


@query("t04_rate_limit", ctes("scan_events") + f""",
e AS (SELECT event_id, scan_id AS key, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM scan_events),
w AS (WITH RECURSIVE r(key, opened) AS (SELECT key, min(ms) FROM e GROUP BY key
      UNION ALL SELECT r.key, min(e.ms) FROM r JOIN e ON e.key = r.key AND e.ms >= r.opened + {WINDOW_MS} GROUP BY r.key) SELECT * FROM r),
o AS (SELECT e.event_id, e.key, e.ms, max(w.opened) AS opened FROM e JOIN w ON w.key = e.key AND w.opened <= e.ms GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY key, opened ORDER BY ms, event_id) AS hits FROM o)
SELECT *, hits > 1 AS limited, greatest(0, 1 - hits) AS remaining, CASE WHEN hits > 1 THEN CAST(ceil((opened + {WINDOW_MS} - ms) / 1000) AS BIGINT) END AS retry_after FROM h""")
def t04(v):
    return pg.rate_limit(v.scan_events, 1, WINDOW_MS, "scan_id")


@query("t05_progress_counts", ctes("scan_events") + """
SELECT scan_id, count(*) AS processed, count(*) FILTER (WHERE status = 'done') AS scanned, count(*) FILTER (WHERE status = 'error') AS errors,
       CAST(sum(floor(value)) FILTER (WHERE status = 'done') AS BIGINT) AS faces FROM scan_events GROUP BY scan_id""")
def t05(v):
    return pg.progress_counts(v.scan_events)


# ------------------------------------------------------------------ running streams


def _arriving(v, rows, order: str, pieces: int = 4):
    """The rows as files written one after the other in their order, and a stream over them.

    Every file is one micro-batch. The limits of the pieces are quantiles of ``order``.
    """
    folder = f"{checkpoint_root(v.spark)}/stream-{uuid.uuid4().hex}"
    rows = materialize(rows)
    number = F.col(order).cast("timestamp").cast("double") if order == "ts" else F.col(order).cast("double")
    cuts = rows.select(number.alias("n")).approxQuantile("n", [i / pieces for i in range(1, pieces)], 0.01)
    for i in range(pieces):
        piece = rows
        if i and i - 1 < len(cuts):
            piece = piece.where(number > cuts[i - 1])
        if i < len(cuts):
            piece = piece.where(number <= cuts[i])
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


def _finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _windows(v, make, read):
    stream, folder = _arriving(v, v.scan_events, "ts")
    windows = make(stream)
    _finish(live.keep_windows(windows, f"{folder}/table", f"{folder}/state"))
    return read(live.window_table(v.spark, f"{folder}/table", windows.schema).read())


@query("t01_scan_status_stream", REGISTRY["t01_scan_status"].sql)
def t01s(v):
    """A watermarked stream of windows, upserted bucket by bucket."""
    rows = _windows(v, live.status_windows, live.status_of_windows)
    return rows.withColumns({"updated_at": F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), "value": F.round("value", 6)})


@query("t05_progress_counts_stream", REGISTRY["t05_progress_counts"].sql)
def t05s(v):
    return _windows(v, live.count_windows, live.counts_of_windows)


def _typed(v, job):
    stream, folder = _arriving(v, v.scan_events, "ts")
    with live.rocks_state(v.spark):
        run = pg.run_available(job(stream), f"{folder}/out")
    _finish(run)
    return v.spark.read.parquet(f"{folder}/out")


@query("t02_live_events_stream", REGISTRY["t02_live_events"].sql)
def t02s(v):
    return _typed(v, lambda s: live.live_events_state(s, ("error",))).select("event_id", "scan_id", "status")


@query("t04_rate_limit_stream", REGISTRY["t04_rate_limit"].sql)
def t04s(v):
    return _typed(v, lambda s: live.rate_limit_state(s, 1, WINDOW_MS, "scan_id"))


@query("t03_incremental_clusters_stream", REGISTRY["v04_cluster_faces"].sql)
def t03s(v):
    """Faces arrive in pieces; each piece re-clusters only the components it touches."""
    faces = v.faces.select("face_order", "embedding", "face_quality")
    stream, folder = _arriving(v, faces, "face_order", 3)
    store = ClusterStore(v.spark, f"{folder}/store", 0.30)
    _finish(cluster_stream(stream, store, f"{folder}/state"))
    return store.clusters()
