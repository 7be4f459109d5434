"""A stored index of face vectors: cells around pivots, visited best bound first.

Faces are written in one folder per cell, with the cell's pivot, radius and size in a small
table. By the triangle inequality on angles no face of a cell is more similar to a query
than ``cos(angle(query, pivot) - radius)``. A search reads a few cells with the best bounds,
then only cells whose bound still reaches the k-th best photo found for some query photo,
and so on until none is left. Other cells' files are never opened, and results are exactly
those of a search over all faces.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinframe.operators.catalog import live
from kinframe.operators.pairs import ANGLE_SLACK, MAX_PIVOTS, SMALL_SIDE, angles, column_values, place_rows, sample_rows, to_matrix, unit_rows
from kinframe.operators.search import SEARCH_LIMIT, SEARCH_MIN_SIM, describe_hits, photo_hits, rank_hits
from kinframe.session import materialize

# Faces a cell should hold, and how many cells the first round of a search reads.
CELL_ROWS = 50_000
FIRST_CELLS = 4


@dataclass(frozen=True)
class SearchReport:
    """What a search read: rounds, cells and faces, of how many."""

    rounds: int
    cells_read: int
    cells: int
    faces_read: int
    faces: int


def cell_bounds(queries: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Queries by cells: the most similar that a face of the cell can be."""
    if not len(radius):
        return np.zeros((len(queries), 0))
    gap = angles(unit_rows(queries), pivots) - radius[None, :] - ANGLE_SLACK
    return np.cos(np.clip(gap, 0, math.pi))


class VectorIndex:
    """Cells of faces below ``root``; ``build_index`` writes them."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root
        rows = spark.read.parquet(f"{root}/cells").orderBy("cell").collect()
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.pivots = np.array([r["pivot"] for r in rows], np.float64)
        self.radius = np.array([r["radius"] for r in rows], np.float64)
        self.size = np.array([r["n"] for r in rows], np.int64)
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{root}/schema").first()["value"]))
        self.vectors = spark.read.schema(schema).parquet(f"{root}/vectors")

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries by cells: the most similar that a face of the cell can be."""
        return cell_bounds(queries, self.pivots, self.radius)

    def search(
        self, queries: DataFrame, photos: DataFrame, k: int = SEARCH_LIMIT, min_sim: float = SEARCH_MIN_SIM, first_cells: int = FIRST_CELLS
    ) -> tuple[DataFrame, SearchReport]:
        """``(query_photo, rank, photo_id, similarity, face_order)`` and what was read.

        ``queries`` has ``query_photo, query_order, embedding``, at most ``SMALL_SIDE`` rows.
        """
        if queries.limit(SMALL_SIDE + 1).count() > SMALL_SIDE:
            raise ValueError(f"more than {SMALL_SIDE} query faces; use search_batch over all faces")
        return self._search(queries, photos, k, min_sim, first_cells)

    def _best_bounds(self, queries: DataFrame) -> tuple[list, np.ndarray]:
        """The query photos, and per photo and cell the best bound of its faces."""
        schema = T.StructType([queries.schema["query_photo"], T.StructField("place", T.IntegerType()), T.StructField("bound", T.DoubleType())])
        kind, cells = to_arrow_type(schema["query_photo"].dataType), len(self.cell)

        pivots, radius = self.pivots, self.radius

        def bounds_of(vectors):
            return cell_bounds(vectors, pivots, radius)

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, SMALL_SIDE):
                    part = batch.slice(at, SMALL_SIDE)
                    photos, own = np.unique(column_values(part.column("query_photo")), return_inverse=True)
                    most = np.full((len(photos), cells), -2.0)
                    np.maximum.at(most, own, bounds_of(to_matrix(pa.chunked_array([part.column("embedding")]))))
                    columns = [pa.array(np.repeat(photos, cells), kind), pa.array(np.tile(np.arange(cells, dtype=np.int32), len(photos))), pa.array(most.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        asked = sorted(r[0] for r in queries.select("query_photo").distinct().limit(SMALL_SIDE + 1).collect())
        if len(asked) > SMALL_SIDE:
            raise ValueError(f"more than {SMALL_SIDE} query photos; use search_batch over all faces")
        most, number = np.full((len(asked), cells), -2.0), {q: i for i, q in enumerate(asked)}
        if asked and cells:
            found = queries.select("query_photo", "embedding").mapInArrow(run, schema).groupBy("query_photo", "place").agg(F.max("bound").alias("bound"))
            # At most photos times cells rows, whatever the number of faces.
            for r in found.toLocalIterator():
                most[number[r["query_photo"]], r["place"]] = r["bound"]
        return asked, most

    def _search(self, queries: DataFrame, photos: DataFrame, k: int, min_sim: float, first_cells: int = FIRST_CELLS) -> tuple[DataFrame, SearchReport]:
        """As ``search``, for any number of faces of at most ``SMALL_SIDE`` query photos."""
        queries = materialize(queries)
        asked, most = self._best_bounds(queries)
        number = {q: i for i, q in enumerate(asked)}
        beat = np.full(len(asked), float(min_sim))
        left = np.ones(len(self.cell), bool)
        on_show = materialize(live(photos).select("photo_id"))
        hits, rounds, read = None, 0, np.zeros(len(self.cell), bool)
        while True:
            able = left & (most >= beat[:, None] - ANGLE_SLACK).any(0) if asked else np.zeros(0, bool)
            if not able.any():
                break
            # Twice as many cells in every round, so that rounds stay few.
            order = np.flatnonzero(able)[np.argsort(-most[:, able].max(0), kind="stable")]
            now = order[: first_cells * 2**rounds]
            left[now], read[now] = False, True
            rounds += 1
            cells = self.vectors.where(F.col("cell").isin(self.cell[now].tolist())).join(on_show, "photo_id", "left_semi")
            found = photo_hits(queries, cells, k, min_sim)
            hits = materialize(rank_hits(found if hits is None else found.unionByName(hits.select(*found.columns)), k))
            for r in hits.where(F.col("rank") == k).select("query_photo", "similarity").collect():
                beat[number[r["query_photo"]]] = max(min_sim, r["similarity"])
        report = SearchReport(rounds, int(read.sum()), len(self.cell), int(self.size[read].sum()), int(self.size.sum()))
        if hits is None:
            hits = rank_hits(photo_hits(queries, self.vectors.limit(0), k, min_sim), k)
        return hits.select("query_photo", "rank", "photo_id", "similarity", "face_order"), report

    def search_photos(
        self, queries: DataFrame, faces: DataFrame, photos: DataFrame, persons: DataFrame, k: int = SEARCH_LIMIT, min_sim: float = SEARCH_MIN_SIM
    ) -> DataFrame:
        """The hits of a batch with boxes, persons and paths, as ``search_batch`` gives them."""
        return describe_hits(self._search(queries, photos, k, min_sim)[0], faces, photos, persons)


def build_index(faces: DataFrame, root: str, cell_rows: int = CELL_ROWS) -> VectorIndex:
    """Write the embedded faces (``face_order, photo_id, embedding``) into cells below ``root``.

    Pivots are a fixed choice by hash; every face goes to its nearest one. Files of a large
    cell are cut by Spark's usual file size, as each task writes its own.
    """
    spark = faces.sparkSession
    rows = materialize(faces.where(F.col("embedding").isNotNull()).select(F.col("face_order").cast("long").alias("id"), F.col("embedding").alias("vec"), "photo_id"))
    wanted = min(MAX_PIVOTS, max(1, math.ceil(rows.count() / cell_rows)))
    pivots = sample_rows(rows)[:wanted]
    placed = place_rows(rows, pivots) if len(pivots) else rows.limit(0).withColumns({"cell": F.lit(0), "ang": F.lit(0.0)})
    placed = materialize(placed.select("cell", F.col("id").alias("face_order"), "photo_id", F.col("vec").alias("embedding"), "ang"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("ang").alias("radius")).collect()
    cells = [(r["cell"], pivots[r["cell"]].tolist(), r["radius"], r["n"]) for r in stats]
    # A cell's rows are spread over some tasks first, so that a hot cell is written by many.
    spread = F.pmod(F.xxhash64("face_order"), F.lit(8))
    vectors = placed.drop("ang")
    vectors.repartition("cell", spread).write.partitionBy("cell").parquet(f"{root}/vectors")
    spark.createDataFrame([(vectors.schema.json(),)], "value string").coalesce(1).write.text(f"{root}/schema")
    # The table of cells comes last: without it there is no index.
    spark.createDataFrame(cells, "cell int, pivot array<double>, radius double, n long").coalesce(1).write.parquet(f"{root}/cells")
    return VectorIndex(spark, root)
