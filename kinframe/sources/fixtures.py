"""Catalog views derived from the driver's raw tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ)"
TRASH_EPOCH = "CAST('2024-06-01 00:00:00' AS TIMESTAMP_NTZ)"


class Views:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def photos(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id AS photo_id",
            "concat('/lib/', source, '/', lang, '/', doc_id, '.jpg') AS path",
            "CAST(640 + n_chars % 3000 AS INT) AS width",
            "CAST(480 + (n_chars * 7) % 2000 AS INT) AS height",
            "CASE WHEN doc_id % 5 <> 4 THEN concat('asset-p', doc_id, '.jpg') END AS thumb_path",
            "md5(text) AS content_hash",
            f"{EPOCH} + doc_id * INTERVAL '1' MINUTE AS created_at",
            f"CASE WHEN doc_id % 17 = 3 THEN {TRASH_EPOCH} + doc_id * INTERVAL '1' MINUTE END AS deleted_at",
        )

    @cached_property
    def faces(self) -> DataFrame:
        side = "(vec_id * 13) % 120"
        return self.raw("embeddings").selectExpr(
            "vec_id AS face_id",
            "vec_id AS face_order",
            "(vec_id * vec_id + vec_id) % 199 AS photo_id",
            "CAST(CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 11 = 1 THEN 1000 + vec_id"
            " ELSE label END AS BIGINT) AS person_id",
            "CAST((vec_id * 37) % 500 AS INT) AS x1",
            "CAST((vec_id * 53) % 400 AS INT) AS y1",
            f"CAST((vec_id * 37) % 500 + 10 + {side} AS INT) AS x2",
            "CAST((vec_id * 53) % 400 + 10 + (vec_id * 13) % 110 AS INT) AS y2",
            f"CASE WHEN {side} < 10 THEN 'very_low' WHEN {side} < 22 THEN 'low'"
            f" WHEN {side} < 54 THEN 'medium' ELSE 'high' END AS face_quality",
            f"{side} < 10 AS low_quality",
            "CAST((vec_id * 29) % 100 AS DOUBLE) / 100 AS quality_score",
            f"CASE WHEN {side} >= 10 THEN embedding END AS embedding",
            "label AS true_label",
            f"{EPOCH} + vec_id * INTERVAL '1' MINUTE AS created_at",
        )

    @cached_property
    def persons(self) -> DataFrame:
        used = self.faces.where("person_id IS NOT NULL").select("person_id").distinct()
        empty = self.raw("region").selectExpr("CAST(900 + r_regionkey AS BIGINT) AS person_id")
        return used.unionByName(empty).selectExpr(
            "person_id",
            "CASE WHEN person_id = 0 THEN 'Alice' WHEN person_id = 1 THEN 'Bob & Carol'"
            " ELSE concat('Person ', person_id) END AS name",
            f"{EPOCH} + person_id * INTERVAL '1' MINUTE AS created_at",
        )

    @cached_property
    def person_manual(self) -> DataFrame:
        return self.raw("nation").where("n_nationkey IN (3, 7)").selectExpr(
            "CAST(n_nationkey AS BIGINT) AS person_id"
        )

    @cached_property
    def folders(self) -> DataFrame:
        own = self.raw("documents").groupBy("source").agg(F.min("doc_id").alias("first_doc")).selectExpr(
            "source AS folder_id",
            "concat('/lib/', source) AS host_path",
            "source AS name",
            f"{EPOCH} + first_doc * INTERVAL '1' MINUTE AS added_at",
        )
        everything = self.spark.range(1).selectExpr(
            "'all' AS folder_id",
            "'/lib' AS host_path",
            "'all' AS name",
            "CAST('2023-12-31 00:00:00' AS TIMESTAMP_NTZ) AS added_at",
        )
        return own.unionByName(everything)

    @cached_property
    def detections(self) -> DataFrame:
        base = self.raw("lineitem").selectExpr(
            "l_orderkey AS image_id",
            "CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,"
            " l_suppkey, l_extendedprice, l_quantity) AS INT) AS det_seq",
            "CAST(l_linenumber % 3 AS INT) AS pass",
            "CAST((l_partkey * 7) % 90 AS DOUBLE) AS x1",
            "CAST((l_suppkey * 11) % 60 AS DOUBLE) AS y1",
            "(l_partkey * 7) % 90 + 10 + l_quantity * 2 AS x2",
            "(l_suppkey * 11) % 60 + 12 + l_quantity * 2 AS y2",
            "CAST(200 + (l_partkey * 31) % 800 AS DOUBLE) / 1000 AS det_score",
            "CAST((l_suppkey * 17 + l_linenumber * 13) % 100 AS DOUBLE) / 100 AS eq_score",
        )
        spread = base.selectExpr("*", "0.01D + 0.04D * (det_seq % 7) AS _e", "0.1D * (det_seq % 5) AS _n")
        kps = (
            "array("
            "named_struct('x', x1 + (x2 - x1) * (0.5D - _e), 'y', y1 + 0.35D * (y2 - y1)),"
            "named_struct('x', x1 + (x2 - x1) * (0.5D + _e), 'y', y1 + 0.35D * (y2 - y1)),"
            "named_struct('x', x1 + (x2 - x1) * (0.5D + _n), 'y', y1 + 0.55D * (y2 - y1)),"
            "named_struct('x', x1 + 0.35D * (x2 - x1), 'y', y1 + 0.75D * (y2 - y1)),"
            "named_struct('x', x1 + 0.65D * (x2 - x1), 'y', y1 + 0.75D * (y2 - y1))) AS kps"
        )
        return spread.selectExpr(
            "image_id", "det_seq", "pass", "x1", "y1", "x2", "y2", "det_score", "eq_score", kps
        )

    @cached_property
    def images(self) -> DataFrame:
        """One row per detected image, with a size."""
        return self.raw("orders").selectExpr(
            "o_orderkey AS image_id",
            "CAST(640 + o_custkey % 3000 AS INT) AS width",
            "CAST(480 + (o_custkey * 7) % 2000 AS INT) AS height",
        )

    @cached_property
    def scan_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id",
            "ts",
            "user_id AS scan_id",
            "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'"
            " WHEN 'purchase' THEN 'done' ELSE 'error' END AS status",
            "value",
        )
