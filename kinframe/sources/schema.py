"""Catalog schemas and their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 3


def _struct(*fields: tuple[str, str]) -> str:
    """A schema as DDL text, which needs no running session."""
    return ", ".join(f"{n} {t}" for n, t in fields)


VECTOR = "array<float>"
TABLES: dict[str, str] = {
    "persons": _struct(
        ("person_id", "string"), ("name", "string"), ("centroid", VECTOR), ("avatar_path", "string"),
        ("created_at", "timestamp"), ("updated_at", "timestamp"),
    ),
    "photos": _struct(
        ("photo_id", "string"), ("path", "string"), ("width", "int"), ("height", "int"), ("thumb_path", "string"),
        ("content_hash", "string"), ("deleted_at", "timestamp"), ("created_at", "timestamp"),
    ),
    "faces": _struct(
        ("face_id", "string"), ("face_order", "bigint"), ("photo_id", "string"), ("person_id", "string"),
        ("x1", "int"), ("y1", "int"), ("x2", "int"), ("y2", "int"), ("embedding", VECTOR),
        ("face_quality", "string"), ("low_quality", "boolean"), ("quality_score", "double"), ("created_at", "timestamp"),
    ),
    "folders": _struct(
        ("folder_id", "string"), ("host_path", "string"), ("name", "string"), ("added_at", "timestamp"),
        ("last_scanned_at", "timestamp"),
    ),
    "person_manual": _struct(("person_id", "string"), ("created_at", "timestamp")),
}

# Columns added per version, with the default older rows receive.
ADDED_COLUMNS: dict[int, list[tuple[str, str, str, object]]] = {
    2: [
        ("faces", "face_quality", "string", "medium"),
        ("faces", "low_quality", "boolean", False),
        ("faces", "quality_score", "double", 0.5),
        ("photos", "deleted_at", "timestamp", None),
    ],
    3: [("persons", "avatar_path", "string", None)],
}


def upgrade_schema(df: DataFrame, table: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """Add the columns ``table`` gained up to ``version``; existing columns stay as they are."""
    for step in range(1, version + 1):
        for name, column, kind, default in ADDED_COLUMNS.get(step, []):
            if name == table and column not in df.columns:
                df = df.withColumn(column, F.lit(default).cast(kind))
    return df


def read_versions(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Folders ``version=<n>`` of one table, written under different schemas, as one table.

    Columns are merged on read. A row from before the version that added a column gets that
    column's default; a null stored since then stays null.
    """
    df = spark.read.option("mergeSchema", True).parquet(root)
    for step, columns in sorted(ADDED_COLUMNS.items()):
        for name, column, kind, default in columns:
            if name == table:
                stored = F.col(column) if column in df.columns else F.lit(None)
                df = df.withColumn(column, F.when(F.col("version") < step, F.lit(default)).otherwise(stored).cast(kind))
    return df
