"""Listings, counts and lookups over the catalog tables.

Faces are counted per photo or per (person, photo) before they meet the photos table,
so one photo or person holding a large share of the faces crosses each shuffle as a
handful of partial rows, and no ``count(DISTINCT)`` expansion is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.operators.ranking import first_per_group, rank_in_group

PHOTO_COLS = ["photo_id", "path", "thumb_path", "width", "height"]
# Persons below this mean quality are hidden, and the listing sizes.
MIN_AVG_QUALITY = 0.30
LIST_LIMIT = 500


def live(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("deleted_at").isNull())


def folder_prefix(host_path: str) -> str:
    return host_path.rstrip("/") + "/"


def under_folder(path: str, host_path: str) -> Column:
    return F.col(path).startswith(folder_prefix(host_path))


def basename(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """Every folder above ``path``: ``/a/b/c.jpg`` gives ``['', '/a', '/a/b']``."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(
        F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )


def _per_folder(folders: DataFrame, by_dir: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Roll per-directory rows up to every registered folder above them."""
    up = by_dir.select("*", F.explode("_above").alias("_folder"))
    keyed = folders.withColumn("_key", F.rtrim("host_path", F.lit("/")))
    joined = keyed.join(up, F.col("_key") == F.col("_folder"), "left")
    return joined.groupBy("folder_id", "host_path", "name", "added_at").agg(
        *[c.alias(n) for n, c in measures.items()]
    )


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def list_folders(folders: DataFrame, photos: DataFrame) -> DataFrame:
    """Live photos under each folder; nested folders both count a photo."""
    by_dir = (
        live(photos)
        .groupBy(_directory(F.col("path")).alias("_dir"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_above", ancestors(F.concat("_dir", F.lit("/"))))
    )
    out = _per_folder(folders, by_dir, {"photo_count": F.coalesce(F.sum("_n"), F.lit(0)).cast("long")})
    return out.orderBy(F.col("added_at").desc(), "folder_id")


def folder_breakdown(
    folders: DataFrame, photos: DataFrame, faces: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """Photos, faces, distinct persons and bytes per folder.

    ``files(path, length)`` is a listing of what is on disk; a folder is available when
    any file is listed under it. Without a listing both columns are null.
    """
    keep = live(photos).select("photo_id", "path", _directory(F.col("path")).alias("_dir"))
    per_photo = faces.groupBy("photo_id").agg(F.count(F.lit(1)).alias("_faces"))
    sized = keep.join(per_photo, "photo_id", "left")
    if files is not None:
        sized = sized.join(files.select("path", F.col("length").alias("_bytes")), "path", "left")
    else:
        sized = sized.withColumn("_bytes", F.lit(None).cast("long"))
    by_dir = (
        sized.groupBy("_dir")
        .agg(
            F.count(F.lit(1)).alias("_photos"),
            F.coalesce(F.sum("_faces"), F.lit(0)).alias("_faces"),
            F.sum("_bytes").alias("_bytes"),
        )
        .withColumn("_above", ancestors(F.concat("_dir", F.lit("/"))))
    )
    totals = _per_folder(
        folders,
        by_dir,
        {
            "photo_count": F.coalesce(F.sum("_photos"), F.lit(0)).cast("long"),
            "face_count": F.coalesce(F.sum("_faces"), F.lit(0)).cast("long"),
            "size_bytes": F.sum("_bytes").cast("long"),
        },
    )
    # Distinct persons: reduce to (directory, person) first, then to (folder, person).
    pairs = (
        faces.where(F.col("person_id").isNotNull())
        .select("photo_id", "person_id")
        .distinct()
        .join(keep.select("photo_id", "_dir"), "photo_id")
        .select("_dir", "person_id")
        .distinct()
        .select("person_id", F.explode(ancestors(F.concat("_dir", F.lit("/")))).alias("_folder"))
        .distinct()
        .groupBy("_folder")
        .agg(F.count(F.lit(1)).alias("person_count"))
    )
    out = totals.join(
        pairs, F.rtrim("host_path", F.lit("/")) == F.col("_folder"), "left"
    ).withColumn("person_count", F.coalesce("person_count", F.lit(0)).cast("long"))
    if files is not None:
        seen = (
            files.select(F.explode(ancestors(F.col("path"))).alias("_seen")).distinct()
        )
        out = (
            out.join(seen, F.rtrim("host_path", F.lit("/")) == F.col("_seen"), "left")
            .withColumn("available", F.col("_seen").isNotNull())
            .withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)).cast("long"))
        )
    else:
        out = out.withColumn("available", F.lit(None).cast("boolean"))
    return out.select(
        "folder_id", "host_path", "name", "added_at",
        "photo_count", "face_count", "person_count", "size_bytes", "available",
    ).orderBy(F.col("added_at").desc(), "folder_id")


def folder_photos(photos: DataFrame, host_path: str) -> DataFrame:
    return live(photos).where(under_folder("path", host_path)).select("photo_id", "path", "thumb_path")


def list_photos(
    photos: DataFrame,
    faces: DataFrame,
    host_path: str | None = None,
    limit: int = LIST_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """A page of live photos, newest first, with their face counts.

    The page is cut before faces are counted: only its photos meet the faces table.
    """
    rows = live(photos)
    if host_path:
        rows = rows.where(under_folder("path", host_path))
    newest = [F.col("created_at").desc(), F.col("photo_id").desc()]
    page = rows.orderBy(*newest).offset(offset).limit(limit)
    shown = faces.join(page.select("photo_id"), "photo_id", "left_semi")
    counts = shown.groupBy("photo_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        page.join(counts, "photo_id", "left")
        .select(*PHOTO_COLS, "created_at", F.coalesce("_n", F.lit(0)).cast("long").alias("faces_detected"))
        .orderBy(*newest)
    )


def _newest(df: DataFrame, limit: int | None, by: str = "created_at", tie: Sequence[str] = ("photo_id",)) -> DataFrame:
    out = df.orderBy(F.col(by).desc(), *[F.col(t).desc() for t in tie])
    return out if limit is None else out.limit(limit)


def photos_for_person(photos: DataFrame, faces: DataFrame, person_id, limit: int | None = LIST_LIMIT) -> DataFrame:
    ids = faces.where(F.col("person_id") == person_id).select("photo_id").distinct()
    return _newest(live(photos).join(ids, "photo_id", "left_semi"), limit).select(*PHOTO_COLS, "created_at")


def search_by_name(
    photos: DataFrame, faces: DataFrame, persons: DataFrame, text: str, limit: int | None = LIST_LIMIT
) -> DataFrame:
    """Photos of persons whose name contains ``text``, ignoring case."""
    wanted = persons.where(
        F.instr(F.lower("name"), F.lower(F.trim(F.lit(text)))) > 0
    ).select("person_id", F.col("name").alias("person_name"))
    seen = faces.select("photo_id", "person_id").join(wanted, "person_id").distinct()
    hits = live(photos).join(seen, "photo_id")
    return _newest(hits, limit, tie=("photo_id", "person_id")).select(
        *PHOTO_COLS, "created_at", "person_id", "person_name"
    )


def _without_faces(photos: DataFrame, faces: DataFrame) -> DataFrame:
    return live(photos).join(faces.select("photo_id").distinct(), "photo_id", "left_anti")


def photos_without_faces(photos: DataFrame, faces: DataFrame, limit: int | None = LIST_LIMIT) -> DataFrame:
    return _newest(_without_faces(photos, faces), limit).select(*PHOTO_COLS, "created_at")


def count_photos_without_faces(photos: DataFrame, faces: DataFrame) -> DataFrame:
    return _without_faces(photos, faces).agg(F.count(F.lit(1)).alias("n"))


def list_trash(photos: DataFrame, limit: int | None = LIST_LIMIT) -> DataFrame:
    gone = photos.where(F.col("deleted_at").isNotNull())
    return _newest(gone, limit, by="deleted_at").select(*PHOTO_COLS, "deleted_at")


def count_trash(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("deleted_at").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


def person_previews(persons: DataFrame, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """The face in the middle of each person's insertion order, with its live photo."""
    owned = faces.where(F.col("person_id").isNotNull()).select(
        "person_id", "face_id", "photo_id", "face_order"
    )
    ranked = rank_in_group(owned, ["person_id"], ["face_order"])
    middle = owned.groupBy("person_id").agg(
        F.floor((F.count(F.lit(1)) + 1) / 2).cast("long").alias("rn")
    )
    chosen = ranked.join(middle, ["person_id", "rn"], "left_semi").select("person_id", "face_id", "photo_id")
    paths = live(photos).select("photo_id", F.col("path").alias("photo_path"))
    return (
        persons.select("person_id")
        .join(chosen, "person_id", "left")
        .join(paths, "photo_id", "left")
        .select("person_id", "face_id", "photo_path")
    )


def person_sizes(persons: DataFrame, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Live photo and face counts and mean quality for every person."""
    per_photo = (
        faces.where(F.col("person_id").isNotNull())
        .groupBy("person_id", "photo_id")
        .agg(
            F.count(F.lit(1)).alias("_faces"),
            F.sum("quality_score").alias("_q"),
            F.count("quality_score").alias("_nq"),
        )
    )
    totals = (
        per_photo.join(live(photos).select("photo_id"), "photo_id", "left_semi")
        .groupBy("person_id")
        .agg(
            F.count(F.lit(1)).alias("photo_count"),
            F.sum("_faces").alias("face_count"),
            (F.sum("_q") / F.sum("_nq")).alias("avg_quality"),
        )
    )
    zero = F.lit(0).cast("long")
    persons = persons.select("person_id", "name", "created_at")
    return persons.join(totals, "person_id", "left").select(
        "person_id",
        "name",
        "created_at",
        F.coalesce("photo_count", zero).alias("photo_count"),
        F.coalesce("face_count", zero).alias("face_count"),
        "avg_quality",
    )


def list_persons(
    persons: DataFrame,
    faces: DataFrame,
    photos: DataFrame,
    include_noise: bool = False,
    show_singletons: bool = False,
    min_avg_quality: float = MIN_AVG_QUALITY,
) -> DataFrame:
    rows = person_sizes(persons, faces, photos).where("face_count > 0")
    if not include_noise:
        rows = rows.where(F.col("avg_quality") >= min_avg_quality)
        if not show_singletons:
            rows = rows.where("face_count >= 2 OR photo_count >= 2")
    return rows.orderBy(F.col("photo_count").desc(), "created_at", "person_id")


def person_assignments(faces: DataFrame, photos: DataFrame, persons: DataFrame) -> DataFrame:
    """One row per assigned face, trash included, ordered by path."""
    return (
        faces.select("face_id", "photo_id", "person_id")
        .join(persons.select("person_id", F.col("name").alias("person_name")), "person_id")
        .join(photos.select("photo_id", "path"), "photo_id")
        .select("path", "person_name", "face_id")
        .orderBy("path", "face_id")
    )


def photo_faces(faces: DataFrame, persons: DataFrame, photo_id=None) -> DataFrame:
    """Boxes, labels and quality of one photo's faces, or of every photo's."""
    rows = faces if photo_id is None else faces.where(F.col("photo_id") == photo_id)
    names = persons.select("person_id", F.col("name").alias("person_name"))
    return (
        rows.join(names, "person_id", "left")
        .select(
            "photo_id", "face_id", "x1", "y1", "x2", "y2", "person_id", "person_name",
            "face_quality", "low_quality", "quality_score", "created_at",
        )
        .orderBy("photo_id", "created_at", "face_id")
    )


def photo_embeddings(faces: DataFrame, photo_id=None) -> DataFrame:
    rows = faces if photo_id is None else faces.where(F.col("photo_id") == photo_id)
    return rows.where(F.col("embedding").isNotNull()).select(
        "photo_id", "face_id", "face_order", "embedding"
    ).orderBy("photo_id", "face_order")


def person_photo_paths(faces: DataFrame, photos: DataFrame, person_id=None) -> DataFrame:
    """Distinct photo paths per person, trash included."""
    rows = faces.where(F.col("person_id").isNotNull() if person_id is None else F.col("person_id") == person_id)
    return (
        rows.select("person_id", "photo_id").distinct()
        .join(photos.select("photo_id", "path"), "photo_id")
        .select("person_id", "path").distinct()
    )


def person_embeddings(faces: DataFrame, person_id, limit: int = 50) -> DataFrame:
    return (
        faces.where((F.col("person_id") == person_id) & F.col("embedding").isNotNull())
        .select("face_id", "face_order", "embedding")
        .orderBy("face_order")
        .limit(limit)
    )


def person_faces(faces: DataFrame, photos: DataFrame, person_id, limit: int = 200) -> DataFrame:
    """One person's faces on live photos, newest first."""
    rows = faces.where(F.col("person_id") == person_id).select(
        "face_id", "photo_id", "face_quality", "created_at"
    )
    paths = live(photos).select("photo_id", F.col("path").alias("photo_path"))
    return _newest(rows.join(paths, "photo_id"), limit, tie=("face_id",)).select(
        "face_id", "photo_path", "face_quality", "created_at"
    )


def _scalar(df: DataFrame, **measures: Column) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in measures.items()])


def _side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """Put one-row results next to each other."""
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def _faces_on_live(faces: DataFrame, photos: DataFrame) -> DataFrame:
    return faces.join(live(photos).select("photo_id"), "photo_id", "left_semi")


def library_stats(photos: DataFrame, faces: DataFrame, persons: DataFrame, folders: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return _side_by_side(
        [
            _scalar(live(photos), photos=n),
            _scalar(_faces_on_live(faces.select("photo_id"), photos), faces=n),
            _scalar(persons, persons=n),
            _scalar(folders, folders=n),
        ]
    )


def empty_persons(persons: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.where(F.col("person_id").isNotNull()).select("person_id").distinct()
    return persons.join(used, "person_id", "left_anti")


def orphan_assets(assets: DataFrame, photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Cache files named ``<uuid>.jpg`` that belong to neither a photo nor a face."""
    valid = (
        photos.where(F.col("thumb_path").isNotNull())
        .select(F.regexp_replace(basename("thumb_path"), r"\.jpg$", "").alias("_id"))
        .unionByName(faces.select(F.col("face_id").cast("string").alias("_id")))
    )
    named = assets.where(F.col("name").rlike(r"^[0-9a-f-]{36}\.jpg$"))
    return (
        named.withColumn("_id", F.regexp_replace("name", r"\.jpg$", ""))
        .join(valid, "_id", "left_anti")
        .drop("_id")
    )


def cleanup_stats(
    photos: DataFrame, faces: DataFrame, persons: DataFrame, assets: DataFrame | None = None
) -> DataFrame:
    """Counts of everything the cleanup actions would remove."""
    on_live = _faces_on_live(faces.select("photo_id", "person_id", "face_quality"), photos)
    groups = (
        live(photos).where(F.col("content_hash").isNotNull())
        .groupBy("content_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    parts = [
        _scalar(
            on_live,
            unassigned_faces=F.count_if(F.col("person_id").isNull()),
            low_quality_faces=F.count_if(F.col("face_quality") == "very_low"),
        ),
        _scalar(
            groups,
            duplicate_groups=F.count(F.lit(1)),
            duplicate_photos=F.coalesce(F.sum("_n"), F.lit(0)).cast("long"),
        ),
        _scalar(empty_persons(persons, faces), empty_persons=F.count(F.lit(1))),
    ]
    if assets is not None:
        parts.append(_scalar(orphan_assets(assets, photos, faces), orphan_thumbs=F.count(F.lit(1))))
    return _side_by_side(parts)


def duplicate_groups(photos: DataFrame) -> DataFrame:
    """Live photos sharing a content hash: one row per member, newest group first.

    Members stay rows rather than a list, so a hash shared by a large part of the
    library never becomes one giant value.
    """
    rows = live(photos).where(F.col("content_hash").isNotNull())
    groups = (
        rows.groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("created_at").alias("group_latest"))
        .where("group_size > 1")
    )
    return (
        rows.select("photo_id", "path", "thumb_path", "content_hash", "created_at")
        .join(groups, "content_hash")
        .orderBy(
            F.col("group_latest").desc(), "content_hash", F.col("created_at").desc(), "photo_id"
        )
    )


def get_photo(photos: DataFrame, photo_id) -> DataFrame:
    return photos.where(F.col("photo_id") == photo_id).select(*PHOTO_COLS)


def has_path(photos: DataFrame, path: str) -> bool:
    return not live(photos).where(F.col("path") == path).isEmpty()


def has_hash(photos: DataFrame, content_hash: str) -> bool:
    return not photos.where(F.col("content_hash") == content_hash).isEmpty()


def filter_persons(listed: DataFrame, text: str) -> DataFrame:
    """Person picker: names containing ``text``, most photos first."""
    needle = F.lower(F.trim(F.lit(text)))
    return listed.where((needle == "") | (F.instr(F.lower("name"), needle) > 0)).orderBy(
        F.col("photo_count").desc(), "created_at", "person_id"
    )


def persons_with_preview(listed: DataFrame, previews: DataFrame) -> DataFrame:
    return listed.join(previews, "person_id", "left")


def partition_photo_faces(faces: DataFrame, person_id, photo_id=None) -> DataFrame:
    """How many faces of a photo are this person's, someone else's, or unassigned."""
    rows = faces if photo_id is None else faces.where(F.col("photo_id") == photo_id)
    section = (
        F.when(F.col("person_id").isNull(), "unassigned")
        .when(F.col("person_id") == person_id, "selected")
        .otherwise("others")
    )
    return rows.groupBy("photo_id", section.alias("section")).agg(F.count(F.lit(1)).alias("faces"))


def photo_counts(photos: DataFrame, faces: DataFrame, host_path: str | None = None) -> DataFrame:
    """Faces and distinct persons of every photo, by path."""
    rows = photos if host_path is None else photos.where(under_folder("path", host_path))
    pairs = faces.groupBy("photo_id", "person_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = pairs.groupBy("photo_id").agg(
        F.sum("_n").alias("_faces"), F.count("person_id").alias("_persons")
    )
    zero = F.lit(0).cast("long")
    return (
        rows.select("photo_id", "path")
        .join(counts, "photo_id", "left")
        .select(
            "path",
            F.coalesce("_faces", zero).alias("faces"),
            F.coalesce("_persons", zero).alias("persons"),
        )
        .orderBy("path")
    )


def multi_photo_persons(faces: DataFrame, photos: DataFrame, persons: DataFrame, top: int = 10) -> DataFrame:
    """Largest persons that span more than one photo."""
    pairs = (
        faces.where(F.col("person_id").isNotNull())
        .groupBy("person_id", "photo_id").agg(F.count(F.lit(1)).alias("_n"))
        .join(photos.select("photo_id"), "photo_id", "left_semi")
    )
    sizes = pairs.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("photos"), F.sum("_n").alias("faces")
    ).where("photos > 1")
    return (
        sizes.join(persons.select("person_id", "name"), "person_id")
        .select("person_id", "name", "photos", "faces")
        .orderBy(F.col("faces").desc(), "person_id")
        .limit(top)
    )


def tier_counts(faces: DataFrame) -> DataFrame:
    return faces.groupBy("face_quality").agg(
        F.count(F.lit(1)).alias("faces"),
        F.count("embedding").alias("embedded"),
        F.count("person_id").alias("assigned"),
    )


def person_shape(faces: DataFrame) -> DataFrame:
    """How many persons own one face, and how many own several."""
    sizes = faces.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count(F.lit(1)).alias("_n"))
    return _side_by_side(
        [
            _scalar(
                sizes,
                persons=F.count(F.lit(1)),
                singletons=F.count_if(F.col("_n") == 1),
                multi=F.count_if(F.col("_n") > 1),
            ),
            _scalar(faces, faces=F.count(F.lit(1)), embedded=F.count("embedding")),
        ]
    )


def blur_band(faces: DataFrame, max_quality: float = 0.22) -> DataFrame:
    """Embedded faces whose quality score is below ``max_quality``, worst first."""
    return (
        faces.where(F.col("embedding").isNotNull() & (F.col("quality_score") < max_quality))
        .select(
            "face_id", "photo_id", "person_id", "face_quality", "quality_score",
            F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"),
        )
        .orderBy("quality_score", "face_id")
    )


def lowest_quality(faces: DataFrame, n: int = 25) -> DataFrame:
    return blur_band(faces, float("inf")).limit(n)


def suspect_faces(faces: DataFrame, max_quality: float = 0.35) -> DataFrame:
    """Embedded faces of a weak tier with a weak score."""
    return faces.where(
        F.col("embedding").isNotNull()
        & F.col("face_quality").isin("low", "very_low")
        & (F.col("quality_score") < max_quality)
    ).select("face_id", "photo_id", "person_id", "face_quality", "quality_score", "x1", "y1", "x2", "y2")


def single_face_photos(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Photos with exactly one face, with that face."""
    one = faces.groupBy("photo_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(F.struct("face_id", "x1", "y1", "x2", "y2")).alias("_f"),
    ).where("_n = 1")
    return photos.select("photo_id", "path").join(one, "photo_id").select("photo_id", "path", "_f.*")


def invariants(faces: DataFrame) -> DataFrame:
    """Counts that must be zero in a sound catalog."""
    return faces.agg(
        F.count_if(F.col("low_quality") & F.col("embedding").isNotNull()).alias("very_low_embedded"),
        F.count_if((F.col("face_quality") == "very_low") != F.col("low_quality")).alias("tier_flag_mismatch"),
        F.count_if((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))).alias("empty_boxes"),
    )
