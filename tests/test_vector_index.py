"""A search over the stored index finds what a search over all faces finds, and reads less."""

import numpy as np
import pytest

from kinframe.operators import pairs, search
from kinframe.operators.vector_index import VectorIndex, build_index


def library(spark, kind, n=900, d=16):
    rng = np.random.default_rng(2)
    if kind == "persons":
        centres = rng.normal(size=(30, d))
        x = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, d)) * 0.15
    else:
        x = rng.normal(size=(n, d))
    x[10] = 0
    x[20:24] = x[19]  # equal similarities, settled by photo and face order
    rows = [(i, i, i // 3, i % 7, 0, 0, 9, 9, v.tolist() if i % 50 else None) for i, v in enumerate(x)]
    faces = spark.createDataFrame(rows, "face_id long, face_order long, photo_id long, person_id long, x1 int, y1 int, x2 int, y2 int, embedding array<double>")
    photos = spark.range(n // 3).selectExpr("id AS photo_id", "concat('/', id) AS path", "'' AS thumb_path", "1 AS width", "1 AS height", "CASE WHEN id % 9 = 0 THEN now() END AS deleted_at")
    persons = spark.range(7).selectExpr("id AS person_id", "concat('P', id) AS name")
    return faces, photos, persons


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("kind, min_sim", [("persons", 0.5), ("noise", 0.2)])
def test_same_hits_and_fewer_cells(spark, tmp_path, kind, min_sim):
    faces, photos, persons = library(spark, kind)
    built = build_index(faces, str(tmp_path / "index"), cell_rows=25)
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert len(index.cell) == len(built.cell) > 20 and index.size.sum() == faces.where("embedding IS NOT NULL").count()
    queries = search.query_faces(faces, [6, 7, 101, 250])
    for k in (1, 4):
        hits, report = index.search(queries, photos, k, min_sim)
        want = search.search_batch(queries, faces, photos, persons, k, min_sim)
        assert rows_of(index.search_photos(queries, faces, photos, persons, k, min_sim)) == rows_of(want)
        assert want.count() > 0 and 0 < report.cells_read <= report.cells and report.faces_read <= report.faces
        if kind == "persons":
            assert report.cells_read < 0.7 * report.cells and report.faces_read < 0.7 * report.faces


def test_nothing_to_find(spark, tmp_path):
    faces, photos, persons = library(spark, "noise", 60)
    index = build_index(faces, str(tmp_path / "index"), cell_rows=25)
    queries = search.query_faces(faces, [1])
    hits, report = index.search(queries, photos, 5, 1.5)
    assert hits.count() == 0 and report.cells_read == 0
    hits, report = index.search(queries.limit(0), photos)
    assert hits.count() == 0 and report.rounds == 0
    none = build_index(faces.limit(0), str(tmp_path / "none"))
    assert none.search(queries, photos)[0].count() == 0
    with pytest.raises(ValueError):
        index.search(queries.crossJoin(spark.range(pairs.SMALL_SIDE + 1)).drop("id"), photos)
