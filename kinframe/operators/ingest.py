"""Catalog changes. Every operator takes tables and returns new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.functions.boxes import round_half_up
from kinframe.functions.vectors import centroids
from kinframe.operators.catalog import folder_prefix, live, under_folder
from kinframe.operators.ranking import first_per_group, rank_in_group

# Defaults of stored faces, and the floor the application uses.
DEFAULT_TIER = "medium"
DEFAULT_SCORE = 0.5
APP_QUALITY_FLOOR = 0.25


def _now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


# ------------------------------------------------------------------ scanning


def resume_filter(files: DataFrame, photos: DataFrame) -> DataFrame:
    """Listed files whose path is not indexed and live yet."""
    return files.join(live(photos).select("path"), "path", "left_anti")


def quality_floor(new_photos: DataFrame, dets: DataFrame, min_quality: float = APP_QUALITY_FLOOR) -> tuple[DataFrame, DataFrame]:
    """Drop faces below the floor, then photos that have none left."""
    kept = dets if min_quality <= 0 else dets.where(F.col("quality_score") >= min_quality)
    return new_photos.join(kept.select("photo_id").distinct(), "photo_id", "left_semi"), kept


def round_boxes(faces: DataFrame) -> DataFrame:
    return faces.withColumns({c: round_half_up(F.col(c)).cast("int") for c in ("x1", "y1", "x2", "y2")})


def new_files(photos: DataFrame, candidates: DataFrame, trashed_blocks_reingest: bool = True) -> DataFrame:
    """Candidates with an unknown hash and path, one file per hash (first by path).

    ``candidates(photo_id, path, content_hash, ...)``. Trashed photos block a new copy
    unless told otherwise.
    """
    known = photos if trashed_blocks_reingest else live(photos)
    fresh = candidates.join(
        known.where(F.col("content_hash").isNotNull()).select("content_hash"), "content_hash", "left_anti"
    ).join(known.select("path"), "path", "left_anti")
    hashed = first_per_group(fresh.where(F.col("content_hash").isNotNull()), ["content_hash"], ["path", "photo_id"])
    unhashed = fresh.where(F.col("content_hash").isNull())
    return hashed.select(*candidates.columns).unionByName(unhashed.select(*candidates.columns))


def add_faces(faces: DataFrame, new_faces: DataFrame) -> DataFrame:
    """Append unassigned faces, with defaults for missing quality columns."""
    defaults = {
        "face_quality": F.lit(DEFAULT_TIER), "quality_score": F.lit(DEFAULT_SCORE), "low_quality": F.lit(False),
    }
    rows = new_faces.withColumn("person_id", F.lit(None).cast(faces.schema["person_id"].dataType))
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return faces.unionByName(rows.select(*[F.col(c) for c in faces.columns if c in rows.columns]), allowMissingColumns=True)


def ingest(
    photos: DataFrame,
    faces: DataFrame,
    new_photos: DataFrame,
    detections: DataFrame,
    min_quality: float = 0.0,
    keep_faceless: bool = False,
    trashed_blocks_reingest: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Add a batch of scanned files with their classified detections.

    Known files and copies within the batch are skipped before anything else; photos
    without a usable face are not stored unless ``keep_faceless``.
    """
    fresh = new_files(photos, new_photos, trashed_blocks_reingest)
    with_faces, kept = quality_floor(fresh, detections, min_quality)
    stored = fresh if keep_faceless else with_faces
    rows = round_boxes(kept.join(stored.select("photo_id"), "photo_id", "left_semi"))
    out_photos = photos.unionByName(stored.select(*[c for c in photos.columns if c in stored.columns]), allowMissingColumns=True)
    return out_photos, add_faces(faces, rows)


def rescan_removals(photos: DataFrame, listing: DataFrame, host_path: str, now: Column | None = None) -> DataFrame:
    """Soft-delete indexed live photos under a folder that are no longer listed."""
    present = listing.select("path").distinct().withColumn("_here", F.lit(True))
    gone = F.col("deleted_at").isNull() & under_folder("path", host_path) & F.col("_here").isNull()
    marked = F.when(gone, _now(now)).otherwise(F.col("deleted_at"))
    return photos.join(present, "path", "left").withColumn("deleted_at", marked).select(*photos.columns)


def upsert_folder(folders: DataFrame, host_path: str, name: str, folder_id: str, now: Column | None = None) -> DataFrame:
    """Add a folder or rename it; an existing row keeps its id and dates."""
    new = folders.sparkSession.range(1).select(
        F.lit(host_path).alias("host_path"), F.lit(name).alias("_name"), F.lit(folder_id).alias("_id"), _now(now).alias("_at")
    )
    joined = folders.join(new, "host_path", "full")
    picked = {
        "folder_id": F.coalesce("folder_id", "_id"),
        "name": F.coalesce("_name", "name"),
        "added_at": F.coalesce("added_at", F.col("_at").cast(folders.schema["added_at"].dataType)),
    }
    return joined.select(*[picked[c].alias(c) if c in picked else F.col(c) for c in folders.columns])


def mark_folder_scanned(folders: DataFrame, host_path: str, now: Column | None = None) -> DataFrame:
    old = F.col("last_scanned_at") if "last_scanned_at" in folders.columns else F.lit(None).cast("timestamp")
    return folders.withColumn("last_scanned_at", F.when(F.col("host_path") == host_path, _now(now)).otherwise(old))


def scan_summary(events: DataFrame) -> DataFrame:
    """Totals of each scan from its progress events.

    ``events(scan_id, ts, status, total, scanned, removed, faces, persons, errors)``
    carries running counters; the largest of each is the total.
    """
    highest = [F.max(c).alias(c) for c in ("total", "scanned", "removed", "faces", "errors") if c in events.columns]
    last = [F.max_by("persons", "ts").alias("persons")] if "persons" in events.columns else []
    # Whole microseconds: as doubles, times since 1970 are too coarse to round halves rightly.
    micros = F.expr(
        "((extract(DAY FROM max(ts) - min(ts)) * 24L + extract(HOUR FROM max(ts) - min(ts))) * 60 + extract(MINUTE FROM max(ts) - min(ts)))"
        " * 60000000 + CAST(extract(SECOND FROM max(ts) - min(ts)) * 1000000 AS LONG)"
    )
    return events.groupBy("scan_id").agg(
        *highest, *last,
        F.coalesce(F.max(F.col("status") == "cancelled"), F.lit(False)).alias("cancelled"),
        F.round(micros / 1000).cast("long").alias("elapsed_ms"),
    )


# ------------------------------------------------------------------ trash and folders


def soft_delete(photos: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """Move photos to the trash; ``ids(photo_id)``."""
    hit = ids.select("photo_id").distinct().withColumn("_hit", F.lit(True))
    return (
        photos.join(hit, "photo_id", "left")
        .withColumn("deleted_at", F.when(F.col("_hit"), _now(now)).otherwise(F.col("deleted_at")))
        .select(*photos.columns)
    )


def restore(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """Bring trashed photos back; ``restorable`` counts them."""
    hit = ids.select("photo_id").distinct().withColumn("_hit", F.lit(True))
    return (
        photos.join(hit, "photo_id", "left")
        .withColumn("deleted_at", F.when(F.col("_hit").isNull(), F.col("deleted_at")))
        .select(*photos.columns)
    )


def restorable(photos: DataFrame, ids: DataFrame) -> DataFrame:
    return photos.where(F.col("deleted_at").isNotNull()).join(
        ids.select("photo_id").distinct(), "photo_id", "left_semi"
    ).agg(F.count(F.lit(1)).alias("n"))


def _cascade(faces: DataFrame, photos: DataFrame) -> DataFrame:
    return faces.join(photos.select("photo_id"), "photo_id", "left_semi").select(*faces.columns)


def empty_trash(photos: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purge trashed photos and, with them, their faces."""
    kept = live(photos)
    return kept, _cascade(faces, kept)


def delete_folder(
    photos: DataFrame, faces: DataFrame, folders: DataFrame, host_path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop a folder, all photos below it and their faces."""
    kept = photos.where(~F.col("path").startswith(folder_prefix(host_path)))
    return kept, _cascade(faces, kept), folders.where(F.col("host_path") != host_path)


# ------------------------------------------------------------------ clean-up


def _drop_live_faces(faces: DataFrame, photos: DataFrame, condition: Column) -> DataFrame:
    doomed = faces.where(condition).select("face_id", "photo_id").join(
        live(photos).select("photo_id"), "photo_id", "left_semi"
    )
    return faces.join(doomed.select("face_id"), "face_id", "left_anti").select(*faces.columns)


def remove_unassigned_faces(faces: DataFrame, photos: DataFrame) -> DataFrame:
    return _drop_live_faces(faces, photos, F.col("person_id").isNull())


def remove_low_quality_faces(faces: DataFrame, photos: DataFrame) -> DataFrame:
    return _drop_live_faces(faces, photos, F.col("face_quality") == "very_low")


def remove_empty_persons(persons: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.where(F.col("person_id").isNotNull()).select("person_id").distinct()
    return persons.join(used, "person_id", "left_semi")


def missing_crops(faces: DataFrame, photos: DataFrame, assets: DataFrame) -> DataFrame:
    """Faces without a ``<face_id>.jpg`` among the cached files, with what is needed to cut one."""
    have = assets.select(F.regexp_replace("name", r"\.jpg$", "").alias("_id")).distinct()
    wanted = faces.withColumn("_id", F.col("face_id").cast("string")).join(have, "_id", "left_anti")
    return wanted.join(photos.select("photo_id", F.col("path").alias("photo_path")), "photo_id").select(
        "face_id", "photo_path", "x1", "y1", "x2", "y2"
    )


# ------------------------------------------------------------------ persons


def _with_optional(persons: DataFrame, name: str, kind: str) -> DataFrame:
    return persons if name in persons.columns else persons.withColumn(name, F.lit(None).cast(kind))


def rename_person(persons: DataFrame, person_id, name: str, now: Column | None = None) -> DataFrame:
    hit = F.col("person_id") == person_id
    rows = _with_optional(persons, "updated_at", "timestamp")
    return rows.withColumns(
        {"name": F.when(hit, F.lit(name)).otherwise(F.col("name")), "updated_at": F.when(hit, _now(now)).otherwise(F.col("updated_at"))}
    )


def set_person_avatar(persons: DataFrame, person_id, file_name: str | None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Store an avatar; also returns the previous file name of that person."""
    rows = _with_optional(_with_optional(persons, "avatar_path", "string"), "updated_at", "timestamp")
    hit = F.col("person_id") == person_id
    previous = rows.where(hit).select("person_id", F.col("avatar_path").alias("previous"))
    changed = rows.withColumns(
        {
            "avatar_path": F.when(hit, F.lit(file_name)).otherwise(F.col("avatar_path")),
            "updated_at": F.when(hit, _now(now)).otherwise(F.col("updated_at")),
        }
    )
    return changed, previous


def delete_person(persons: DataFrame, faces: DataFrame, person_id) -> tuple[DataFrame, DataFrame]:
    return persons.where(F.col("person_id") != person_id), _reassign(faces, [person_id], None)


def _reassign(faces: DataFrame, sources: Sequence, target) -> DataFrame:
    kind = faces.schema["person_id"].dataType
    moved = F.when(F.col("person_id").isin(*sources), F.lit(target).cast(kind)).otherwise(F.col("person_id"))
    return faces.withColumn("person_id", moved)


def set_face_person(faces: DataFrame, face_id, person_id) -> DataFrame:
    kind = faces.schema["person_id"].dataType
    return faces.withColumn(
        "person_id", F.when(F.col("face_id") == face_id, F.lit(person_id).cast(kind)).otherwise(F.col("person_id"))
    )


def merge_persons(
    persons: DataFrame, faces: DataFrame, person_manual: DataFrame, target, sources: Sequence
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Fold ``sources`` into ``target``: new persons, faces, manual marks, and the count.

    The target takes over all faces, gets a fresh unit centroid and a joined name, is
    marked as edited by hand, and ``updated_at``, where there is one, becomes the time of
    the call. Source rows go away.
    """
    valid = [s for s in sources if s is not None and s != "" and s != target]
    if not valid:
        return persons, faces, person_manual, 0
    new_faces = _reassign(faces, valid, target)
    order = F.array_position(F.array(*[F.lit(x) for x in [target, *valid]]), F.col("person_id"))
    # The list of merged persons is the caller's, so it fits in one row.
    joined = persons.where(F.col("person_id").isin(target, *valid)).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "name"))), lambda x: x["name"]), " & "
        ).alias("_joined")
    ).withColumn("person_id", F.lit(target))
    mean = centroids(new_faces.where(F.col("person_id") == target), ["person_id"], normalize=True).select(
        "person_id", F.col("centroid").alias("_mean")
    )
    rows = _with_optional(persons, "centroid", "array<double>")
    hit = F.col("person_id") == target
    merged = (
        rows.where(~F.col("person_id").isin(*valid))
        .join(joined, "person_id", "left").join(mean, "person_id", "left")
        .withColumns(
            {
                "name": F.when(hit, F.col("_joined")).otherwise(F.col("name")),
                "centroid": F.when(hit, F.col("_mean").cast(rows.schema["centroid"].dataType)).otherwise(F.col("centroid")),
            }
            | ({"updated_at": F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))} if "updated_at" in rows.columns else {})
        )
        .select(*rows.columns)
    )
    marked = mark_manual(person_manual, persons.where(hit).select("person_id"))
    marked = marked.where(~F.col("person_id").isin(*valid))
    return merged, new_faces, marked, len(valid)


def mark_manual(person_manual: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark persons as edited by hand; marking twice changes nothing."""
    new = ids.select("person_id").distinct().join(person_manual.select("person_id"), "person_id", "left_anti")
    return person_manual.unionByName(new, allowMissingColumns=True)


def split_person(
    persons: DataFrame, faces: DataFrame, person_manual: DataFrame, person_id
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn each face of a person into a person of its own, all marked as edited by hand.

    New names count on from the number of persons. Numeric ids count on from the largest
    id; text ids come from the face, so a repeat gives the same id. ``created_at`` and
    ``updated_at``, where there are any, become the time of the call. A person with at
    most one face is only marked.
    """
    own = faces.where(F.col("person_id") == person_id)
    if len(own.select("face_id").take(2)) < 2:
        return persons, faces, mark_manual(person_manual, persons.where(F.col("person_id") == person_id))
    base = persons.agg(F.max("person_id").alias("top"), F.count(F.lit(1)).alias("n")).first()
    ranked = rank_in_group(own.select("face_id", "face_order", "created_at", "embedding"), [], ["created_at", "face_order"])
    kind = persons.schema["person_id"].dataType
    text = isinstance(kind, T.StringType)
    new_id = F.concat(F.lit("person-"), F.col("face_id").cast("string")) if text else (F.col("rn") + F.lit(base["top"])).cast(kind)
    singles = ranked.select(
        "face_id", new_id.alias("_new"),
        F.concat(F.lit("Person "), (F.col("rn") + F.lit(base["n"])).cast("string")).alias("name"), "embedding",
    )
    times = {c: F.current_timestamp().cast(persons.schema[c].dataType) for c in ("created_at", "updated_at") if c in persons.columns}
    added = singles.select(F.col("_new").alias("person_id"), "name", F.col("embedding").alias("centroid")).withColumns(times)
    added = added.select(*[c for c in ("person_id", "name", "centroid", *times) if c in persons.columns])
    new_persons = persons.where(F.col("person_id") != person_id).unionByName(added, allowMissingColumns=True)
    new_faces = (
        faces.join(singles.select("face_id", "_new"), "face_id", "left")
        .withColumn("person_id", F.coalesce("_new", "person_id"))
        .select(*faces.columns)
    )
    marked = mark_manual(person_manual.where(F.col("person_id") != person_id), singles.select(F.col("_new").alias("person_id")))
    return new_persons, new_faces, marked
