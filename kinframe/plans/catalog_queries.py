"""Catalog queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.operators import catalog as cat
from kinframe.plans.registry import ctes, query


def shown(df: DataFrame) -> DataFrame:
    """Timestamps as text, so results compare without time zones."""
    return df.select(
        *[
            F.col(f.name).cast("string").alias(f.name)
            if f.dataType.typeName() in ("timestamp", "timestamp_ntz")
            else F.col(f.name)
            for f in df.schema
        ]
    )


PHOTO_SQL = "p.photo_id, p.path, p.thumb_path, p.width, p.height"


@query("q01_list_folders", ctes("photos", "folders") + """
SELECT f.folder_id, f.host_path, f.name, CAST(f.added_at AS VARCHAR) AS added_at, count(p.photo_id) AS photo_count
FROM folders f LEFT JOIN photos p ON starts_with(p.path, f.host_path || '/') AND p.deleted_at IS NULL
GROUP BY ALL""")
def q01(v):
    return shown(cat.list_folders(v.folders, v.photos))


@query("q02_folder_breakdown", ctes("photos", "faces", "folders") + """
SELECT f.folder_id, f.host_path, f.name, CAST(f.added_at AS VARCHAR) AS added_at, count(DISTINCT p.photo_id) AS photo_count,
       count(DISTINCT fa.face_id) AS face_count, count(DISTINCT fa.person_id) AS person_count
FROM folders f LEFT JOIN photos p ON starts_with(p.path, f.host_path || '/') AND p.deleted_at IS NULL
LEFT JOIN faces fa ON fa.photo_id = p.photo_id GROUP BY ALL""")
def q02(v):
    return shown(cat.folder_breakdown(v.folders, v.photos, v.faces)).drop("size_bytes", "available")


@query("q03_folder_photos", ctes("photos") + """
SELECT photo_id, path, thumb_path FROM photos WHERE deleted_at IS NULL AND starts_with(path, '/lib/')""")
def q03(v):
    return cat.folder_photos(v.photos, "/lib/")


@query("q04_list_photos", ctes("photos", "faces") + f"""
SELECT {PHOTO_SQL}, CAST(p.created_at AS VARCHAR) AS created_at, count(f.face_id) AS faces_detected
FROM photos p LEFT JOIN faces f ON f.photo_id = p.photo_id WHERE p.deleted_at IS NULL
GROUP BY ALL ORDER BY created_at DESC LIMIT 500 OFFSET 20""")
def q04(v):
    return shown(cat.list_photos(v.photos, v.faces, limit=500, offset=20))


@query("q05_photos_for_person", ctes("photos", "faces") + f"""
SELECT DISTINCT {PHOTO_SQL}, CAST(p.created_at AS VARCHAR) AS created_at FROM faces f JOIN photos p ON p.photo_id = f.photo_id
WHERE f.person_id = 4 AND p.deleted_at IS NULL ORDER BY created_at DESC LIMIT 500""")
def q05(v):
    return shown(cat.photos_for_person(v.photos, v.faces, 4))


@query("q06_search_by_name", ctes("photos", "faces", "persons") + f"""
SELECT * FROM (SELECT DISTINCT {PHOTO_SQL}, CAST(p.created_at AS VARCHAR) AS created_at, pe.person_id, pe.name AS person_name
FROM faces f JOIN photos p ON p.photo_id = f.photo_id JOIN persons pe ON pe.person_id = f.person_id
WHERE instr(lower(pe.name), 'person') > 0 AND p.deleted_at IS NULL)
ORDER BY created_at DESC, photo_id DESC, person_id DESC LIMIT 500""")
def q06(v):
    return shown(cat.search_by_name(v.photos, v.faces, v.persons, " PERSON "))


@query("q07_photos_without_faces", ctes("photos", "faces") + f"""
SELECT {PHOTO_SQL}, CAST(p.created_at AS VARCHAR) AS created_at FROM photos p LEFT JOIN faces f ON f.photo_id = p.photo_id
WHERE f.face_id IS NULL AND p.deleted_at IS NULL ORDER BY p.created_at DESC LIMIT 500""")
def q07(v):
    return shown(cat.photos_without_faces(v.photos, v.faces))


@query("q07_count_photos_without_faces", ctes("photos", "faces") + """
SELECT count(*) AS n FROM photos p LEFT JOIN faces f ON f.photo_id = p.photo_id
WHERE f.face_id IS NULL AND p.deleted_at IS NULL""")
def q07c(v):
    return cat.count_photos_without_faces(v.photos, v.faces)


@query("q08_list_trash", ctes("photos") + f"""
SELECT {PHOTO_SQL}, CAST(p.deleted_at AS VARCHAR) AS deleted_at FROM photos p
WHERE p.deleted_at IS NOT NULL ORDER BY p.deleted_at DESC LIMIT 500""")
def q08(v):
    return shown(cat.list_trash(v.photos))


@query("q08_count_trash", ctes("photos") + "SELECT count(*) AS n FROM photos WHERE deleted_at IS NOT NULL")
def q08c(v):
    return cat.count_trash(v.photos)


PREVIEW_SQL = """
ranked AS (SELECT person_id, face_id, photo_id, row_number() OVER (PARTITION BY person_id ORDER BY face_order) AS rn,
                  count(*) OVER (PARTITION BY person_id) AS cnt FROM faces),
previews AS (SELECT pe.person_id, r.face_id, p.path AS photo_path
  FROM persons pe LEFT JOIN ranked r ON r.person_id = pe.person_id AND r.rn = (r.cnt + 1) // 2
  LEFT JOIN photos p ON p.photo_id = r.photo_id AND p.deleted_at IS NULL)
"""


@query("q09_person_previews", ctes("photos", "faces", "persons") + "," + PREVIEW_SQL + "SELECT * FROM previews")
def q09(v):
    return cat.person_previews(v.persons, v.faces, v.photos)


LISTED_SQL = """
sizes AS (SELECT pe.person_id, pe.name, pe.created_at,
    count(DISTINCT CASE WHEN ph.photo_id IS NOT NULL AND ph.deleted_at IS NULL THEN f.photo_id END) AS photo_count,
    count(CASE WHEN ph.photo_id IS NOT NULL AND ph.deleted_at IS NULL THEN f.face_id END) AS face_count,
    avg(CASE WHEN ph.photo_id IS NOT NULL AND ph.deleted_at IS NULL THEN f.quality_score END) AS avg_quality
  FROM persons pe LEFT JOIN faces f ON f.person_id = pe.person_id LEFT JOIN photos ph ON ph.photo_id = f.photo_id
  GROUP BY ALL),
listed AS (SELECT person_id, name, CAST(created_at AS VARCHAR) AS created_at, photo_count, face_count, round(avg_quality, 6) AS avg_quality
  FROM sizes WHERE face_count > 0 AND avg_quality >= 0.3 AND (face_count >= 2 OR photo_count >= 2))
"""


def listed(v):
    return cat.list_persons(v.persons, v.faces, v.photos).withColumn("avg_quality", F.round("avg_quality", 6))


@query("q10_list_persons", ctes("photos", "faces", "persons") + "," + LISTED_SQL + "SELECT * FROM listed")
def q10(v):
    return shown(listed(v))


@query("q10_list_persons_with_noise", ctes("photos", "faces", "persons") + "," + LISTED_SQL + """
SELECT person_id, name, CAST(created_at AS VARCHAR) AS created_at, photo_count, face_count, round(avg_quality, 6) AS avg_quality
FROM sizes WHERE face_count > 0""")
def q10n(v):
    rows = cat.list_persons(v.persons, v.faces, v.photos, include_noise=True)
    return shown(rows.withColumn("avg_quality", F.round("avg_quality", 6)))


@query("q11_person_assignments", ctes("photos", "faces", "persons") + """
SELECT p.path, pe.name AS person_name, f.face_id FROM faces f JOIN photos p ON p.photo_id = f.photo_id
JOIN persons pe ON pe.person_id = f.person_id""")
def q11(v):
    return cat.person_assignments(v.faces, v.photos, v.persons)


@query("q12_photo_faces", ctes("faces", "persons") + """
SELECT f.photo_id, f.face_id, f.x1, f.y1, f.x2, f.y2, f.person_id, pe.name AS person_name, f.face_quality,
       f.low_quality, f.quality_score, CAST(f.created_at AS VARCHAR) AS created_at
FROM faces f LEFT JOIN persons pe ON pe.person_id = f.person_id""")
def q12(v):
    return shown(cat.photo_faces(v.faces, v.persons))


@query("q13_photo_embeddings", ctes("faces") + """
SELECT photo_id, face_id, face_order, len(embedding) AS dim,
       round(list_dot_product(embedding, embedding), 4) AS squared_norm
FROM faces WHERE embedding IS NOT NULL""")
def q13(v):
    rows = cat.photo_embeddings(v.faces)
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(
        "photo_id", "face_id", "face_order", F.size("embedding").cast("long").alias("dim"),
        F.round(squares, 4).alias("squared_norm"),
    )


@query("q14_person_photo_paths", ctes("photos", "faces") + """
SELECT DISTINCT f.person_id, p.path FROM faces f JOIN photos p ON p.photo_id = f.photo_id WHERE f.person_id IS NOT NULL""")
def q14(v):
    return cat.person_photo_paths(v.faces, v.photos)


@query("q15_person_embeddings", ctes("faces") + """
SELECT face_id, face_order, round(embedding[1], 6) + 0.0 AS first_component FROM faces
WHERE person_id = 4 AND embedding IS NOT NULL ORDER BY face_order LIMIT 50""")
def q15(v):
    return cat.person_embeddings(v.faces, 4).select(
        "face_id", "face_order", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_component")
    )


@query("q16_person_faces", ctes("photos", "faces") + """
SELECT f.face_id, p.path AS photo_path, f.face_quality, CAST(f.created_at AS VARCHAR) AS created_at
FROM faces f JOIN photos p ON p.photo_id = f.photo_id WHERE f.person_id = 4 AND p.deleted_at IS NULL
ORDER BY f.created_at DESC LIMIT 200""")
def q16(v):
    return shown(cat.person_faces(v.faces, v.photos, 4))


@query("q17_library_stats", ctes("photos", "faces", "persons", "folders") + """
SELECT (SELECT count(*) FROM photos WHERE deleted_at IS NULL) AS photos,
       (SELECT count(*) FROM faces f JOIN photos p ON p.photo_id = f.photo_id WHERE p.deleted_at IS NULL) AS faces,
       (SELECT count(*) FROM persons) AS persons, (SELECT count(*) FROM folders) AS folders""")
def q17(v):
    return cat.library_stats(v.photos, v.faces, v.persons, v.folders)


@query("q18_cleanup_stats", ctes("photos", "faces", "persons") + """,
lf AS (SELECT f.* FROM faces f JOIN photos p ON p.photo_id = f.photo_id WHERE p.deleted_at IS NULL),
dup AS (SELECT count(*) AS n FROM photos WHERE deleted_at IS NULL GROUP BY content_hash HAVING count(*) > 1)
SELECT (SELECT count(*) FROM lf WHERE person_id IS NULL) AS unassigned_faces,
       (SELECT count(*) FROM lf WHERE face_quality = 'very_low') AS low_quality_faces,
       (SELECT count(*) FROM dup) AS duplicate_groups,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM dup) AS duplicate_photos,
       (SELECT count(*) FROM persons WHERE person_id NOT IN (SELECT person_id FROM faces WHERE person_id IS NOT NULL)) AS empty_persons""")
def q18(v):
    return cat.cleanup_stats(v.photos, v.faces, v.persons)


@query("q19_duplicate_groups", ctes("photos") + """
SELECT content_hash, photo_id, path, thumb_path, CAST(created_at AS VARCHAR) AS created_at, group_size, CAST(group_latest AS VARCHAR) AS group_latest
FROM (SELECT *, count(*) OVER (PARTITION BY content_hash) AS group_size, max(created_at) OVER (PARTITION BY content_hash) AS group_latest
      FROM photos WHERE deleted_at IS NULL) WHERE group_size > 1""")
def q19(v):
    return shown(cat.duplicate_groups(v.photos))


@query("q20_get_photo", ctes("photos") + f"SELECT {PHOTO_SQL} FROM photos p WHERE photo_id = 42")
def q20(v):
    return cat.get_photo(v.photos, 42)


@query("q21_filter_persons", ctes("photos", "faces", "persons") + "," + LISTED_SQL + """
SELECT * FROM listed WHERE instr(lower(name), 'o') > 0""")
def q21(v):
    return shown(cat.filter_persons(listed(v), "O"))


@query("q22_persons_with_preview", ctes("photos", "faces", "persons") + "," + LISTED_SQL + "," + PREVIEW_SQL + """
SELECT l.*, pr.face_id, pr.photo_path FROM listed l LEFT JOIN previews pr ON pr.person_id = l.person_id""")
def q22(v):
    return shown(cat.persons_with_preview(listed(v), cat.person_previews(v.persons, v.faces, v.photos)))


@query("q23_partition_photo_faces", ctes("faces") + """
SELECT photo_id, CASE WHEN person_id IS NULL THEN 'unassigned' WHEN person_id = 4 THEN 'selected' ELSE 'others' END AS section,
       count(*) AS faces FROM faces GROUP BY ALL""")
def q23(v):
    return cat.partition_photo_faces(v.faces, 4)


@query("q24_photo_counts", ctes("photos", "faces") + """
SELECT p.path, count(f.face_id) AS faces, count(DISTINCT f.person_id) AS persons
FROM photos p LEFT JOIN faces f ON f.photo_id = p.photo_id GROUP BY p.photo_id, p.path""")
def q24(v):
    return cat.photo_counts(v.photos, v.faces)


@query("q25_multi_photo_persons", ctes("photos", "faces", "persons") + """
SELECT pe.person_id, pe.name, count(DISTINCT p.photo_id) AS photos, count(*) AS faces
FROM persons pe JOIN faces f ON f.person_id = pe.person_id JOIN photos p ON p.photo_id = f.photo_id
GROUP BY pe.person_id, pe.name HAVING count(DISTINCT p.photo_id) > 1 ORDER BY faces DESC, pe.person_id LIMIT 10""")
def q25(v):
    return cat.multi_photo_persons(v.faces, v.photos, v.persons)


@query("q26_tier_counts", ctes("faces") + """
SELECT face_quality, count(*) AS faces, count(embedding) AS embedded, count(person_id) AS assigned FROM faces GROUP BY face_quality""")
def q26(v):
    return cat.tier_counts(v.faces)


@query("q26_person_shape", ctes("faces") + """,
s AS (SELECT count(*) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY person_id)
SELECT (SELECT count(*) FROM s) AS persons, (SELECT count(*) FROM s WHERE n = 1) AS singletons,
       (SELECT count(*) FROM s WHERE n > 1) AS multi, (SELECT count(*) FROM faces) AS faces,
       (SELECT count(embedding) FROM faces) AS embedded""")
def q26s(v):
    return cat.person_shape(v.faces)


BLUR_COLS = """face_id, photo_id, person_id, face_quality, quality_score, greatest(x2 - x1, y2 - y1) AS side"""


@query("q27_blur_band", ctes("faces") + f"""
SELECT {BLUR_COLS} FROM faces WHERE embedding IS NOT NULL AND quality_score < 0.22""")
def q27(v):
    return cat.blur_band(v.faces)


@query("q27_lowest_quality", ctes("faces") + f"""
SELECT {BLUR_COLS} FROM faces WHERE embedding IS NOT NULL ORDER BY quality_score, face_id LIMIT 25""")
def q27l(v):
    return cat.lowest_quality(v.faces)


@query("q28_suspect_faces", ctes("faces") + """
SELECT face_id, photo_id, person_id, face_quality, quality_score, x1, y1, x2, y2 FROM faces
WHERE embedding IS NOT NULL AND face_quality IN ('low', 'very_low') AND quality_score < 0.35""")
def q28(v):
    return cat.suspect_faces(v.faces)


@query("q29_single_face_photos", ctes("photos", "faces") + """,
placed AS (SELECT face_id, CASE WHEN face_id < 150 THEN face_id + 200 ELSE photo_id END AS photo_id, x1, y1, x2, y2 FROM faces)
SELECT p.photo_id, p.path, f.face_id, f.x1, f.y1, f.x2, f.y2 FROM photos p JOIN placed f ON f.photo_id = p.photo_id
WHERE p.photo_id IN (SELECT photo_id FROM placed GROUP BY photo_id HAVING count(*) = 1)""")
def q29(v):
    """Over all faces, the first of which get photos of their own."""
    placed = v.faces.withColumn("photo_id", F.expr("CASE WHEN face_id < 150 THEN face_id + 200 ELSE photo_id END"))
    return cat.single_face_photos(v.photos, placed)


@query("q30_invariants", ctes("faces") + """
SELECT count(*) FILTER (WHERE low_quality AND embedding IS NOT NULL) AS very_low_embedded,
       count(*) FILTER (WHERE (face_quality = 'very_low') <> low_quality) AS tier_flag_mismatch,
       count(*) FILTER (WHERE x2 <= x1 OR y2 <= y1) AS empty_boxes FROM faces""")
def q30(v):
    return cat.invariants(v.faces)
