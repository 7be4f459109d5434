"""Streaming jobs must end where their batch forms do."""

from pyspark.sql import functions as F

from kinframe.sources import catalog_io as io
from kinframe.streaming import ingest_job

EVENTS = "event_id long, ts timestamp, scan_id long, status string, value double"


def events(spark, n=120):
    rows = [(i, 1_700_000_000 + i * 37, i % 5, ["running", "running", "done", "cancelled"][(i * 7) % 40 % 4 if i % 40 > 20 else 0], i / 3) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, s long, scan_id long, status string, value double").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "scan_id", "status", "value"
    )


def stream_of(spark, df, folder, pieces=3):
    """The rows as files that arrive in time order, one per micro-batch."""
    for i in range(pieces):
        df.where(f"event_id >= {i * 40} AND event_id < {(i + 1) * 40}").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_incremental_ingest(spark, tmp_path):
    root = str(tmp_path / "cat")
    io.save_catalog(
        {
            "photos": spark.createDataFrame([(1, "/a.jpg", "h1", None)], "photo_id long, path string, content_hash string, deleted_at timestamp"),
            "faces": spark.createDataFrame(
                [(1, 1, 1, 5, 0, 0, 9, 9, [1.0, 0.0], "high", False, 0.9)],
                "face_id long, face_order long, photo_id long, person_id long, x1 int, y1 int, x2 int, y2 int, "
                "embedding array<float>, face_quality string, low_quality boolean, quality_score double",
            ),
            "persons": spark.createDataFrame([(5, "Ann")], "person_id long, name string"),
            "person_manual": spark.createDataFrame([], "person_id long"),
        },
        root,
    )
    schema = (
        "photo_id long, path string, content_hash string, faces array<struct<face_id: long, face_order: long, x1: double, "
        "y1: double, x2: double, y2: double, embedding: array<float>, face_quality: string, quality_score: double>>"
    )
    face = lambda i, v, q=0.9: (i, i, 0.4, 0.5, 9.5, 9.4, v, "high", q)
    rows = [
        (2, "/b.jpg", "h2", [face(2, [1.0, 0.1]), face(3, [0.0, 1.0])]),
        (3, "/c.jpg", "h1", [face(4, [1.0, 0.0])]),
        (4, "/d.jpg", "h4", [face(5, [0.1, 1.0], 0.1)]),
    ]
    manifest = str(tmp_path / "manifest")
    df = spark.createDataFrame(rows, schema)
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(manifest)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(manifest)
    ingest_job.incremental_ingest(stream, root, str(tmp_path / "state"), threshold=0.45).awaitTermination(60)
    after = io.load_catalog(spark, root)
    assert sorted(r["photo_id"] for r in after["photos"].collect()) == [1, 2]
    owner = {r["face_id"]: r["person_id"] for r in after["faces"].collect()}
    assert owner[1] == owner[2] != owner[3]
    names = {r["person_id"]: r["name"] for r in after["persons"].collect()}
    assert names[owner[1]] == "Ann" and names[owner[3]] == "Person 2"
