"""A search over the stored index takes any number of faces of its query photos."""

from pyspark.sql import functions as F

from kinframe.operators import pairs, search
from kinframe.operators.vector_index import build_index
from test_vector_index import library, rows_of


def test_more_query_faces_than_a_small_side(spark, tmp_path):
    faces, photos, persons = library(spark, "persons", 200)
    index = build_index(faces, str(tmp_path / "index"), cell_rows=25)
    copies = spark.range(pairs.SMALL_SIDE // 5).withColumnRenamed("id", "c")
    queries = search.query_faces(faces, [6, 7]).crossJoin(copies).withColumn("query_order", F.col("query_order") * 10_000 + F.col("c"))
    queries = queries.withColumn("query_photo", F.lit(0).cast("long")).drop("c")
    assert queries.count() > pairs.SMALL_SIDE
    found = index.search_photos(queries, faces, photos, persons, 4, 0.3)
    assert rows_of(found) == rows_of(search.search_batch(queries, faces, photos, persons, 4, 0.3)) and found.count() == 4
