"""Readers, writers, schema upgrades and person edits on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from kinframe.operators import ingest as ing
from kinframe.sources import catalog_io as io
from kinframe.sources.schema import TABLES, upgrade_schema


def test_images_hash_and_storage(spark, tmp_path):
    for name, body in {"b/x.JPG": b"one", "a.png": b"one", "._a.png": b"no", "b/c/note.txt": b"no", "z.webp": b"four"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    listed = io.list_images(spark, str(tmp_path))
    names = [r["path"] for r in listed.collect()]
    assert names == sorted(str(tmp_path / n) for n in ("a.png", "b/x.JPG", "z.webp"))
    hashed = io.content_hash(io.read_contents(spark, str(tmp_path))).collect()
    assert all(len(r["content_hash"]) == 16 for r in hashed)
    assert len({r["content_hash"] for r in hashed}) == 2
    photos = spark.createDataFrame([(names[0], None), (names[2], None), ("/gone.jpg", None)], "path string, deleted_at timestamp")
    total = io.library_storage(photos, listed, listed).first()
    assert (total["photo_bytes"], total["thumb_bytes"]) == (7, 10)


def test_vectors_round_trip(spark):
    df = spark.createDataFrame([(1, [0.5, -1.25, 3.0]), (2, None)], "id int, v array<float>")
    blobs = df.select("id", io.embedding_to_blob("v").alias("b"))
    rows = {r["id"]: r for r in blobs.select("id", "b", io.embedding_from_blob("b").alias("v")).collect()}
    assert bytes(rows[1]["b"]) == b"\x00\x00\x00\x3f\x00\x00\xa0\xbf\x00\x00\x40\x40"
    assert rows[1]["v"] == [0.5, -1.25, 3.0] and rows[2]["v"] is None


def test_upgrade_schema(spark):
    old = spark.createDataFrame([("f1", "ph1")], "face_id string, photo_id string")
    new = upgrade_schema(old, "faces")
    row = new.first()
    assert (row["face_quality"], row["low_quality"], row["quality_score"]) == ("medium", False, 0.5)
    assert upgrade_schema(new, "faces").schema == new.schema
    assert "face_quality" not in upgrade_schema(old, "faces", version=1).columns


def test_catalog_versions(spark, tmp_path):
    root = str(tmp_path / "cat")
    catalog = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    catalog["photos"] = spark.createDataFrame([("p1", "/a.jpg")], "photo_id string, path string")
    io.save_catalog(catalog, root)
    loaded = io.load_catalog(spark, root)
    assert loaded["photos"].count() == 1 and "deleted_at" in loaded["photos"].columns
    io.save_catalog({**loaded, "photos": loaded["photos"].unionByName(loaded["photos"])}, root)
    assert io.load_catalog(spark, root)["photos"].count() == 2
    assert len(list((tmp_path / "cat").glob("v-*"))) == 2
    for _ in range(3):
        io.save_catalog({"photos": io.load_catalog(spark, root)["photos"].limit(1)}, root)
        assert len(list((tmp_path / "cat").glob("v-*"))) == 2
    assert io.load_catalog(spark, root)["photos"].count() == 1


def test_golden_and_reports(spark, tmp_path):
    face = {"bbox": [1, 2, 3, 4], "det_score": 0.9, "kps": [[1, 2]] * 5, "M": [[1, 0, 0], [0, 1, 0]], "embedding": [0.5, 0.5], "ref_embedding": None}
    path = tmp_path / "golden.json"
    path.write_text(json.dumps({"generated_by": "x", "reference": "y", "photos": [{"photo": "p.jpg", "width": 10, "height": 20, "faces": [face, face]}]}, indent=1))
    rows = io.read_golden(spark, str(path)).collect()
    assert [(r["face_seq"], r["x1"], r["y2"], r["kps"][0]["y"]) for r in rows] == [(0, 1.0, 4.0, 2.0), (1, 1.0, 4.0, 2.0)]
    io.write_report({"sweep": spark.range(3)}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "sweep")).count() == 3


@pytest.fixture
def library(spark):
    persons = spark.createDataFrame([(1, "Ann"), (2, "Person 2"), (3, "Person 3")], "person_id long, name string")
    faces = spark.createDataFrame(
        [(10 + i, i, 1 + i % 3, [1.0, float(i)], f"2024-01-0{1 + i}") for i in range(6)],
        "face_id long, face_order long, person_id long, embedding array<float>, day string",
    ).withColumn("created_at", F.to_timestamp("day")).drop("day")
    manual = spark.createDataFrame([], "person_id long")
    return persons, faces, manual


def test_merge_then_split(spark, library):
    persons, faces, manual = library
    p, f, m, n = ing.merge_persons(persons, faces, manual, 1, [1, 2, None, 3])
    assert n == 2
    assert [(r["person_id"], r["name"]) for r in p.collect()] == [(1, "Ann & Person 2 & Person 3")]
    assert {r["person_id"] for r in f.collect()} == {1} and [r["person_id"] for r in m.collect()] == [1]
    p2, f2, m2 = ing.split_person(p, f, m, 1)
    assert f2.count() == faces.count()
    owners = {r["face_id"]: r["person_id"] for r in f2.collect()}
    assert owners == {10 + i: 2 + i for i in range(6)}
    assert {r["person_id"] for r in m2.collect()} == set(owners.values())
    assert {r["name"] for r in p2.collect()} == {f"Person {i}" for i in range(2, 8)}
    assert ing.merge_persons(persons, faces, manual, 1, [1])[3] == 0


def test_split_of_single_face_only_marks(spark, library):
    persons, faces, manual = library
    one = faces.where("face_order < 3")
    p, f, m = ing.split_person(persons, one, manual, 2)
    assert p.count() == 3 and f.count() == 3 and [r["person_id"] for r in m.collect()] == [2]
