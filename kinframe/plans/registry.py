"""Registered queries: a Spark callable over the views, and its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kinframe.sources.fixtures import Views


@dataclass(frozen=True)
class Query:
    run: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = REGISTRY[name].run
    return lambda spark, sf_dir: fn(Views(spark, sf_dir))


VIEW_SQL = {
    "photos": """
SELECT doc_id AS photo_id,
       concat('/lib/', source, '/', lang, '/', doc_id, '.jpg') AS path,
       CAST(640 + n_chars % 3000 AS INT) AS width, CAST(480 + (n_chars * 7) % 2000 AS INT) AS height,
       CASE WHEN doc_id % 5 <> 4 THEN concat('asset-p', doc_id, '.jpg') END AS thumb_path,
       md5(text) AS content_hash,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' MINUTE AS created_at,
       CASE WHEN doc_id % 17 = 3 THEN CAST('2024-06-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' MINUTE END AS deleted_at
FROM documents""",
    "faces": """
SELECT vec_id AS face_id, vec_id AS face_order, (vec_id * vec_id + vec_id) % 199 AS photo_id,
       CAST(CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 11 = 1 THEN 1000 + vec_id ELSE label END AS BIGINT) AS person_id,
       CAST((vec_id * 37) % 500 AS INT) AS x1, CAST((vec_id * 53) % 400 AS INT) AS y1,
       CAST((vec_id * 37) % 500 + 10 + (vec_id * 13) % 120 AS INT) AS x2,
       CAST((vec_id * 53) % 400 + 10 + (vec_id * 13) % 110 AS INT) AS y2,
       CASE WHEN (vec_id * 13) % 120 < 10 THEN 'very_low' WHEN (vec_id * 13) % 120 < 22 THEN 'low'
            WHEN (vec_id * 13) % 120 < 54 THEN 'medium' ELSE 'high' END AS face_quality,
       (vec_id * 13) % 120 < 10 AS low_quality,
       CAST((vec_id * 29) % 100 AS DOUBLE) / 100 AS quality_score,
       CASE WHEN (vec_id * 13) % 120 >= 10 THEN CAST(embedding AS DOUBLE[]) END AS embedding,
       label AS true_label,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + vec_id * INTERVAL '1' MINUTE AS created_at
FROM embeddings""",
    "persons": """
SELECT person_id, CASE WHEN person_id = 0 THEN 'Alice' WHEN person_id = 1 THEN 'Bob & Carol'
            ELSE concat('Person ', person_id) END AS name,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + person_id * INTERVAL '1' MINUTE AS created_at
FROM (SELECT DISTINCT person_id FROM faces WHERE person_id IS NOT NULL
      UNION ALL SELECT CAST(900 + r_regionkey AS BIGINT) FROM region) t""",
    "person_manual": """
SELECT CAST(n_nationkey AS BIGINT) AS person_id FROM nation WHERE n_nationkey IN (3, 7)""",
    "folders": """
SELECT source AS folder_id, concat('/lib/', source) AS host_path, source AS name,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + min(doc_id) * INTERVAL '1' MINUTE AS added_at
FROM documents GROUP BY source
UNION ALL SELECT 'all', '/lib', 'all', CAST('2023-12-31 00:00:00' AS TIMESTAMP)""",
    "dets": """
SELECT *, 0.01::DOUBLE + 0.04::DOUBLE * (det_seq % 7) AS e, 0.1::DOUBLE * (det_seq % 5) AS nn,
       x2 - x1 AS w, y2 - y1 AS h
FROM (SELECT l_orderkey AS image_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS det_seq,
       CAST(l_linenumber % 3 AS INT) AS pass,
       CAST((l_partkey * 7) % 90 AS DOUBLE) AS x1, CAST((l_suppkey * 11) % 60 AS DOUBLE) AS y1,
       (l_partkey * 7) % 90 + 10 + l_quantity * 2 AS x2, (l_suppkey * 11) % 60 + 12 + l_quantity * 2 AS y2,
       CAST(200 + (l_partkey * 31) % 800 AS DOUBLE) / 1000 AS det_score,
       CAST((l_suppkey * 17 + l_linenumber * 13) % 100 AS DOUBLE) / 100 AS eq_score
FROM lineitem) d""",
    "detections": """
SELECT image_id, det_seq, pass, x1, y1, x2, y2, w, h, det_score, eq_score,
       x1 + w * (0.5::DOUBLE - e) AS rex, y1 + 0.35::DOUBLE * h AS rey,
       x1 + w * (0.5::DOUBLE + e) AS lex, y1 + 0.35::DOUBLE * h AS ley,
       x1 + w * (0.5::DOUBLE + nn) AS nox, y1 + 0.55::DOUBLE * h AS noy,
       x1 + 0.35::DOUBLE * w AS rmx, y1 + 0.75::DOUBLE * h AS rmy,
       x1 + 0.65::DOUBLE * w AS lmx, y1 + 0.75::DOUBLE * h AS lmy
FROM dets""",
    "images": """
SELECT o_orderkey AS image_id, CAST(640 + o_custkey % 3000 AS INT) AS width,
       CAST(480 + (o_custkey * 7) % 2000 AS INT) AS height FROM orders""",
    "scan_events": """
SELECT event_id, ts, user_id AS scan_id,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
            WHEN 'purchase' THEN 'done' ELSE 'error' END AS status, value
FROM events""",
}

NEEDS = {"persons": ["faces"], "detections": ["dets"]}


def ctes(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they build on)."""
    ordered: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in ordered) + "\n"
