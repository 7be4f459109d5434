"""Physical plans: filters and columns reach the scan, and groups are pre-aggregated."""

import pytest

from kinframe.operators import catalog as cat
from kinframe.operators.ingest import new_files
from kinframe.sources.fixtures import Views

from conftest import SF


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    v = Views(spark, SF)
    out = {}
    for name in ("photos", "faces", "persons"):
        getattr(v, name).write.parquet(str(root / name))
        out[name] = spark.read.parquet(str(root / name))
    return out


def test_folder_filter_reaches_the_scan(stored):
    text = plan(cat.folder_photos(stored["photos"], "/lib/src1"))
    assert "StringStartsWith(path,/lib/src1/)" in text and "IsNull(deleted_at)" in text
    assert "content_hash" not in text.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("build", [
    lambda s: cat.list_persons(s["persons"], s["faces"], s["photos"]),
    lambda s: cat.list_photos(s["photos"], s["faces"]),
    lambda s: cat.duplicate_groups(s["photos"]),
    lambda s: cat.photo_counts(s["photos"], s["faces"]),
])
def test_listings_never_read_vectors(stored, build):
    text = plan(build(stored))
    assert "embedding" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_persons_aggregate_before_the_join(stored):
    text = plan(cat.list_persons(stored["persons"], stored["faces"], stored["photos"]))
    assert "partial_sum(quality_score" in text


def test_new_files_without_window(stored):
    text = plan(new_files(stored["photos"], stored["photos"].select("photo_id", "path", "content_hash", "created_at")))
    assert "Window" not in text and "LeftAnti" in text


def test_search_leaves_vectors_in_place(spark, stored):
    """The comparison reads the faces once and passes on matches, not vectors."""
    from kinframe.operators import search

    queries = search.query_faces(stored["faces"], [42])
    tree = plan(search.rank_hits(search.photo_hits(queries, stored["faces"], 10, 0.25, None), 10)).split("\n\n")[0]
    assert tree.count("Scan parquet") == 1
    below = tree[tree.index("MapInArrow") :]
    assert "Exchange" not in below and "Scan parquet" in below


def test_listings_hold_every_document(spark):
    from kinframe.plans import source_queries as q

    v = Views(spark, SF)
    n = v.raw("documents").count()
    assert q.listed(v, "doc_id % 3 <> 0").count() == q.thumbs(v).count() == q.cached(v).count() == n
    assert 0 < q.listed(v, "doc_id % 3 <> 0").where("path LIKE '/lost/%'").count() < n


def test_single_face_photos_over_all_faces(spark):
    """No face is left out: a photo with a second face never counts as single."""
    from kinframe.plans import catalog_queries as q

    rows = q.q29(Views(spark, SF)).collect()
    assert rows and all(r["photo_id"] == r["face_id"] + 200 for r in rows)
