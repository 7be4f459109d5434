"""Search by face vectors: the best photos for one or many query photos."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.operators.catalog import live
from kinframe.operators.pairs import BLOCK_ROWS, Side, arrow_table, block_pairs, tiles
from kinframe.session import materialize

# Results per search, and the similarity a face must reach.
SEARCH_LIMIT = 10
SEARCH_MIN_SIM = 0.5
# Similarities closer than this many digits are ties, settled by query and face order.
SIM_DIGITS = 9


def searchable_faces(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Embedded faces on live photos."""
    return faces.where(F.col("embedding").isNotNull()).join(
        live(photos).select("photo_id"), "photo_id", "left_semi"
    )


def query_faces(faces: DataFrame, photo_ids: list | None = None) -> DataFrame:
    """Stored faces of the given photos (or of all photos) as queries."""
    rows = faces.where(F.col("embedding").isNotNull())
    if photo_ids is not None:
        rows = rows.where(F.col("photo_id").isin(*photo_ids))
    return rows.select(
        F.col("photo_id").alias("query_photo"), F.col("face_order").alias("query_order"), "embedding"
    )


def photo_hits(
    queries: DataFrame, faces: DataFrame, k: int, min_sim: float, block_rows: int | None = BLOCK_ROWS
) -> DataFrame:
    """Matches that hold the ``k`` best photos of every query photo: photo, face, similarity.

    A photo among the overall best is also among the best of the block its best face
    lies in, so a task only sends ``k`` photos per query photo.
    """
    schema = T.StructType(
        [
            T.StructField("query_photo", queries.schema["query_photo"].dataType),
            T.StructField("photo_id", faces.schema["photo_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("query_order", T.LongType()),
            T.StructField("face_order", T.LongType()),
        ]
    )

    def first_rows(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Positions in ``order`` where the leading keys change."""
        if not len(order):
            return np.zeros(0, bool)
        new = np.ones(len(order), bool)
        new[1:] = False
        for key in keys:
            sorted_key = key[order]
            new[1:] |= sorted_key[1:] != sorted_key[:-1]
        return new

    def keep_best(cols: list[np.ndarray]) -> list[np.ndarray]:
        q, photo, s, qo, fo = cols
        order = np.lexsort((fo, qo, -s, photo, q))
        order = order[first_rows([q, photo], order)]
        q, photo, s, qo, fo = (c[order] for c in (q, photo, s, qo, fo))
        order = np.lexsort((photo, -s, q))
        starts = np.nonzero(first_rows([q], order))[0]
        group = np.repeat(starts, np.diff(np.append(starts, len(order))))
        order = order[(np.arange(len(order)) - group) < k]
        return [c[order] for c in (q, photo, s, qo, fo)]

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        # Sort on dense codes, so ids may be numbers or text.
        asked, ask = np.unique(a.attr["query_photo"], return_inverse=True)
        shown, show = np.unique(b.attr["photo_id"], return_inverse=True)
        empty = np.zeros(0, np.int64)
        kept = [empty, empty, np.zeros(0), empty, empty]
        for start, _, s in tiles(a, b):
            s = np.round(s, SIM_DIGITS)
            i, j = np.nonzero(s >= min_sim)
            found = [ask[start + i], show[j], s[i, j], a.attr["id"][start + i], b.attr["id"][j]]
            kept = keep_best([np.concatenate([x, y]) for x, y in zip(kept, found)])
        return arrow_table(schema, [[asked[kept[0]]], [shown[kept[1]]], [kept[2]], [kept[3]], [kept[4]]])

    left = queries.select(F.col("query_order").alias("id"), F.col("embedding").alias("vec"), "query_photo",
                          F.lit(None).cast(faces.schema["photo_id"].dataType).alias("photo_id"))
    right = faces.select(F.col("face_order").alias("id"), F.col("embedding").alias("vec"),
                         F.lit(None).cast(queries.schema["query_photo"].dataType).alias("query_photo"), "photo_id")
    return block_pairs(left, right, reduce, schema, min_sim, block_rows)


def rank_hits(found: DataFrame, k: int) -> DataFrame:
    """Per query photo the ``k`` best photos of ``photo_hits``, each with its best face."""
    best = found.groupBy("query_photo", "photo_id").agg(
        F.max(F.struct("similarity", (-F.col("query_order")).alias("q"), (-F.col("face_order")).alias("f"))).alias("m")
    )
    rank = F.row_number().over(
        Window.partitionBy("query_photo").orderBy(F.col("m.similarity").desc(), "photo_id")
    )
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_photo", "rank", "photo_id", F.col("m.similarity").alias("similarity"),
        (-F.col("m.f")).alias("face_order"), (-F.col("m.q")).alias("query_order"),
    )


def describe_hits(best: DataFrame, faces: DataFrame, photos: DataFrame, persons: DataFrame) -> DataFrame:
    """Ranked photos with the matched face, its person, and the photo's file."""
    boxes = faces.select("face_order", "face_id", "person_id", "x1", "y1", "x2", "y2")
    names = persons.select("person_id", F.col("name").alias("person_name"))
    shown = photos.select("photo_id", "path", "thumb_path", "width", "height")
    return (
        best.join(boxes, "face_order").join(names, "person_id", "left").join(shown, "photo_id")
        .select(
            "query_photo", "rank", "photo_id", "path", "thumb_path", "face_id", "person_id", "person_name",
            "similarity", "x1", "y1", "x2", "y2", "width", "height",
        )
    )


def search_batch(
    queries: DataFrame,
    faces: DataFrame,
    photos: DataFrame,
    persons: DataFrame,
    k: int = SEARCH_LIMIT,
    min_sim: float = SEARCH_MIN_SIM,
    block_rows: int | None = BLOCK_ROWS,
    all_persons: bool = False,
) -> DataFrame:
    """The ``k`` best photos of every query photo, with the matched face and its person.

    ``all_persons`` adds ``matched_persons``: the names of all persons that any query face
    matches in the photo, at most as many as the photo has faces.
    """
    best = materialize(rank_hits(photo_hits(queries, searchable_faces(faces, photos), k, min_sim, block_rows), k))
    hits = describe_hits(best, faces, photos, persons)
    if not all_persons:
        return hits
    rows = matched_persons(best, queries, faces, persons, min_sim, block_rows)
    lists = rows.groupBy("query_photo", "photo_id").agg(F.array_sort(F.collect_list("person_name")).alias("matched_persons"))
    return hits.join(lists, ["query_photo", "photo_id"], "left").withColumn(
        "matched_persons", F.coalesce("matched_persons", F.array().cast("array<string>"))
    )


def search_faces(
    queries: DataFrame, faces: DataFrame, photos: DataFrame, persons: DataFrame,
    k: int = SEARCH_LIMIT, min_sim: float = SEARCH_MIN_SIM, block_rows: int | None = BLOCK_ROWS, all_persons: bool = False,
) -> DataFrame:
    """One search with all query faces together; best photos first."""
    together = queries.withColumn("query_photo", F.lit(0).cast("long"))
    hits = search_batch(together, faces, photos, persons, k, min_sim, block_rows, all_persons)
    return hits.drop("query_photo").orderBy("rank")


def search_by_photo(
    photo_id, faces: DataFrame, photos: DataFrame, persons: DataFrame,
    k: int = SEARCH_LIMIT, min_sim: float = SEARCH_MIN_SIM,
) -> DataFrame:
    """Search with the stored faces of one photo; also tells how many there were."""
    queries = query_faces(faces, [photo_id])
    hits = search_faces(queries, faces, photos, persons, k, min_sim).withColumn("_one", F.lit(1))
    count = queries.agg(F.count(F.lit(1)).alias("query_faces")).withColumn("_one", F.lit(1))
    return hits.join(count, "_one").drop("_one").orderBy("rank")


def matched_persons(
    hits: DataFrame, queries: DataFrame, faces: DataFrame, persons: DataFrame,
    min_sim: float = SEARCH_MIN_SIM, block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Every person matched by any query face in a result photo, one row each.

    Only faces of result photos are compared; a task sends each (query photo, photo,
    person) once. Hits of a single search need no ``query_photo``.
    """
    single = "query_photo" not in hits.columns
    if single:
        hits = hits.withColumn("query_photo", F.lit(0).cast("long"))
        queries = queries.withColumn("query_photo", F.lit(0).cast("long"))
    found_in = hits.select("photo_id").distinct()
    owned = faces.where(F.col("person_id").isNotNull() & F.col("embedding").isNotNull()).join(
        found_in, "photo_id", "left_semi"
    )
    kinds = {
        "query_photo": queries.schema["query_photo"].dataType,
        "photo_id": faces.schema["photo_id"].dataType,
        "person_id": faces.schema["person_id"].dataType,
    }
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        asked, ask = np.unique(a.attr["query_photo"], return_inverse=True)
        pair = np.stack([b.attr["photo_id"].astype(str), b.attr["person_id"].astype(str)], axis=1)
        _, lead, owner = np.unique(pair, axis=0, return_index=True, return_inverse=True)
        seen = np.zeros((len(asked), len(lead)), bool)
        for start, _, s in tiles(a, b):
            i, j = np.nonzero(np.round(s, SIM_DIGITS) >= min_sim)
            seen[ask[start + i], owner.ravel()[j]] = True
        q, o = np.nonzero(seen)
        return arrow_table(schema, [[asked[q]], [b.attr["photo_id"][lead[o]]], [b.attr["person_id"][lead[o]]]])

    empty = {n: F.lit(None).cast(t).alias(n) for n, t in kinds.items()}
    left = queries.select(
        F.col("query_order").alias("id"), F.col("embedding").alias("vec"), "query_photo", empty["photo_id"], empty["person_id"]
    )
    right = owned.select(
        F.col("face_order").alias("id"), F.col("embedding").alias("vec"), empty["query_photo"], "photo_id", "person_id"
    )
    rows = block_pairs(left, right, reduce, schema, min_sim, block_rows).distinct()
    named = (
        rows.join(hits.select("query_photo", "photo_id"), ["query_photo", "photo_id"], "left_semi")
        .join(persons.select("person_id", F.col("name").alias("person_name")), "person_id")
        .select("query_photo", "photo_id", "person_name").distinct()
    )
    return named.drop("query_photo") if single else named
