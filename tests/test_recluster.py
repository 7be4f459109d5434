"""Re-clustering keeps what it must keep, and its result works with the rest of the catalog."""

import pytest
from pyspark.sql import functions as F

from kinframe.operators import catalog, cluster, evaluate, ingest, pairs
from kinframe.functions.vectors import centroids
from kinframe.streaming.ingest_job import apply_batch

FACES = (
    "face_id {0}, face_order long, photo_id long, person_id {0}, face_quality string, quality_score double, embedding array<float>"
)
A, B, C = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]


def library(spark, text):
    key = (lambda x: None if x is None else f"id{x}") if text else (lambda x: x)
    kind = "string" if text else "long"
    rows = [(1, 1, 1, 10, A), (2, 2, 2, 10, A), (3, 3, 1, 12, B), (4, 4, 2, None, C), (5, 5, 3, 12, B)]
    faces = spark.createDataFrame([(key(i), o, p, key(n), "high", 0.5, v) for i, o, p, n, v in rows], FACES.format(kind))
    faces = faces.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    persons = spark.createDataFrame(
        [(key(10), "Ann", "ann.jpg", [0.5, 0.5, 0.5]), (key(12), "Bob", "bob.jpg", [9.0, 9.0, 9.0])],
        f"person_id {kind}, name string, avatar_path string, centroid array<double>",
    ).withColumns({c: F.lit("2020-01-01").cast("timestamp") for c in ("created_at", "updated_at")})
    photos = spark.createDataFrame([(i, f"/p{i}.jpg", f"h{i}") for i in (1, 2, 3)], "photo_id long, path string, content_hash string")
    photos = photos.withColumns({"deleted_at": F.lit(None).cast("timestamp"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    manual = spark.createDataFrame([(key(12),)], f"person_id {kind}")
    return photos, faces, persons, manual, key


@pytest.mark.parametrize("text", [False, True])
def test_frozen_persons_stay_whole(spark, text):
    photos, faces, persons, manual, key = library(spark, text)
    new_faces, new_persons = cluster.recluster_catalog(photos, faces, persons, manual)
    assert new_persons.columns == persons.columns
    frozen = new_persons.where(F.col("person_id") == key(12)).collect()
    assert frozen == persons.where(F.col("person_id") == key(12)).collect()
    owner = {r.face_id: r.person_id for r in new_faces.collect()}
    assert owner[key(1)] == owner[key(2)] != owner[key(4)] and owner[key(3)] == owner[key(5)] == key(12)
    if text:
        assert owner[key(1)] == "person-id1" and owner[key(4)] == "person-id4"
        again = cluster.recluster_catalog(photos, new_faces, new_persons, manual)[0]
        assert {r.face_id: r.person_id for r in again.collect()} == owner
    else:
        assert sorted({owner[1], owner[4]}) == [13, 14]
    listed = catalog.list_persons(new_persons, new_faces, photos, show_singletons=True).collect()
    assert {r["name"] for r in listed} == {"Ann", "Bob", "Person 2"}


@pytest.mark.parametrize("text", [False, True])
def test_nothing_to_cluster_changes_nothing(spark, text):
    photos, faces, persons, manual, _ = library(spark, text)
    bare = faces.withColumn("embedding", F.lit(None).cast("array<float>"))
    new_faces, new_persons = cluster.recluster_catalog(photos, bare, persons, manual)
    assert sorted(map(str, new_faces.collect())) == sorted(map(str, bare.collect()))
    assert sorted(map(str, new_persons.collect())) == sorted(map(str, persons.collect()))


def test_split_with_text_ids(spark):
    _, faces, persons, manual, key = library(spark, True)
    new_persons, new_faces, marks = ingest.split_person(persons, faces, manual, key(10))
    assert {r.face_id: r.person_id for r in new_faces.where("face_order < 3").collect()} == {"id1": "person-id1", "id2": "person-id2"}
    made = new_persons.where("person_id LIKE 'person-%'").collect()
    assert len(made) == 2 and all(r.created_at.year > 2024 and r.updated_at.year > 2024 for r in made)
    assert {r.person_id for r in marks.collect()} == {"id12", "person-id1", "person-id2"}
    merged = ingest.merge_persons(persons, faces, manual, key(10), [key(12)])[0].collect()
    assert merged[0].updated_at.year > 2024 and merged[0].created_at.year == 2020


def test_list_persons_after_a_batch(spark):
    photos, faces, persons, manual, _ = library(spark, False)
    face = (9, 9, "high", 0.9, 1.0, 1.0, 9.0, 9.0, A)
    kinds = "face_id:long,face_order:long,face_quality:string,quality_score:double,x1:double,y1:double,x2:double,y2:double,embedding:array<float>"
    manifest = spark.createDataFrame([(9, "/p9.jpg", "h9", [face])], f"photo_id long, path string, content_hash string, faces array<struct<{kinds}>>")
    manifest = manifest.withColumn("created_at", F.current_timestamp())
    out = apply_batch({"photos": photos, "faces": faces, "persons": persons, "person_manual": manual}, manifest)
    listed = catalog.list_persons(out["persons"], out["faces"], out["photos"], show_singletons=True).collect()
    assert {r["name"]: r["face_count"] for r in listed} == {"Ann": 3, "Bob": 2, "Person 2": 1}
    assert set(persons.columns) == set(out["persons"].columns)


def test_zero_vectors_do_not_merge(spark):
    rows = [(i, [0.0, 0.0], "high") for i in range(3)] + [(3, [1.0, 0.0], "high"), (4, [1.0, 0.0], "high")]
    faces = spark.createDataFrame(rows, "face_order long, embedding array<float>, face_quality string")
    got = {r.face_order: r.root for r in cluster.cluster_faces(faces, 0.45).collect()}
    assert len({got[i] for i in range(3)}) == 3 and got[3] == got[4]


def test_pairs_of_copies_are_listed(spark):
    near = [0.99, 0.1, 0.0]
    rows = [(1, 1, "a", "high", A), (2, 2, "a", "low", A), (3, 3, "b", "high", near)]
    faces = spark.createDataFrame(rows, "face_id long, photo_id long, label string, face_quality string, embedding array<float>")
    faces = faces.withColumns({"x1": F.lit(0), "y1": F.lit(0), "x2": F.lit(50), "y2": F.lit(50)})
    assert {(r.id_a, r.id_b) for r in pairs.similar_pairs(faces, 0.9).collect()} == {(1, 2), (1, 3), (2, 3)}
    listed = evaluate.pair_dataset(faces, 0.9).collect()
    assert len(listed) == 3 == sum(r.pairs for r in evaluate.pair_counts(faces).collect())
    kinds = {(r.id_a, r.id_b): r.q_pair for r in listed}
    assert kinds[1, 3] != kinds[2, 3]


def test_mixed_lengths_fail(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "person_id long, embedding array<float>")
    with pytest.raises(ValueError, match="different lengths"):
        centroids(df, ["person_id"])
