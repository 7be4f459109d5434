"""Catalog changes over the fixture views; results are the changed tables or their counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.operators import catalog as cat
from kinframe.operators import evaluate as ev
from kinframe.operators import ingest as ing
from kinframe.plans.catalog_queries import shown
from kinframe.plans.registry import ctes, query
from kinframe.plans.vector_queries import rounded
from kinframe.sources import catalog_io as io

def now():
    return F.expr("CAST('2025-01-01 00:00:00' AS TIMESTAMP_NTZ)")


NOW_SQL = "CAST('2025-01-01 00:00:00' AS TIMESTAMP)"


def batch(v):
    """A batch of scanned files: every document again under a new root, some text changed."""
    return v.raw("documents").selectExpr(
        "100000 + doc_id AS photo_id",
        "concat('/new/', source, '/', doc_id, '.jpg') AS path",
        "CASE WHEN n_chars % 2 = 0 THEN md5(text) ELSE md5(concat(text, '!')) END AS content_hash",
        "CAST('2025-01-01 00:00:00' AS TIMESTAMP_NTZ) AS created_at",
    )


BATCH_SQL = """
batch AS (SELECT 100000 + doc_id AS photo_id, concat('/new/', source, '/', doc_id, '.jpg') AS path,
  CASE WHEN n_chars % 2 = 0 THEN md5(text) ELSE md5(concat(text, '!')) END AS content_hash FROM documents),
fresh AS (SELECT * FROM batch WHERE content_hash NOT IN (SELECT content_hash FROM photos) AND path NOT IN (SELECT path FROM photos)
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY path) = 1),
nd AS (SELECT 100000 + l_orderkey % 2000 AS photo_id, 1000000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS face_id,
  l_quantity / 4 - 3 AS x1, l_discount AS q FROM lineitem)
"""


def new_detections(v):
    return v.detections.selectExpr(
        "100000 + image_id % 2000 AS photo_id", "image_id", "det_seq", "x1 / 4 - 3 AS x1", "y1 / 4 - 3 AS y1",
        "x2 / 4 AS x2", "y2 / 4 AS y2", "eq_score AS quality_score",
    )


@query("i01_ingest_new_files", ctes("photos") + "," + BATCH_SQL + "SELECT photo_id, path, content_hash FROM fresh")
def i01(v):
    return ing.new_files(v.photos, batch(v)).select("photo_id", "path", "content_hash")


INGEST_SQL = """
dn AS (SELECT 100000 + image_id % 2000 AS photo_id, floor(x1 / 4 - 3 + 0.5) AS x1, floor(y1 / 4 - 3 + 0.5) AS y1, floor(x2 / 4 + 0.5) AS x2, floor(y2 / 4 + 0.5) AS y2, eq_score FROM detections WHERE eq_score >= 0.25::DOUBLE),
kept AS (SELECT * FROM fresh WHERE photo_id IN (SELECT photo_id FROM dn)),
nf AS (SELECT dn.* FROM dn WHERE photo_id IN (SELECT photo_id FROM kept))
"""


@query("i01_ingest", ctes("photos", "faces", "detections") + "," + BATCH_SQL + "," + INGEST_SQL + """
SELECT (SELECT count(*) FROM photos) + (SELECT count(*) FROM kept) AS photos, (SELECT count(*) FROM faces) + (SELECT count(*) FROM nf) AS faces,
  CAST((SELECT sum(x1 + y1 + x2 + y2) FROM faces) + (SELECT sum(x1 + y1 + x2 + y2) FROM nf) AS BIGINT) AS box_sum,
  (SELECT count(*) FROM faces WHERE person_id IS NOT NULL) AS assigned, (SELECT count(*) FROM faces WHERE face_quality = 'medium') + (SELECT count(*) FROM nf) AS medium""")
def i01f(v):
    photos, faces = ing.ingest(v.photos, v.faces, batch(v), new_detections(v), min_quality=0.25)
    counted = faces.agg(
        F.count(F.lit(1)).alias("faces"), F.sum(F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2")).cast("long").alias("box_sum"),
        F.count("person_id").alias("assigned"), F.count_if(F.col("face_quality") == "medium").alias("medium"),
    )
    return cat._side_by_side([photos.agg(F.count(F.lit(1)).alias("photos")), counted])


@query("i02_resume_filter", ctes("photos") + """
SELECT concat('/lib/', source, '/', lang, '/', doc_id, '.jpg') AS path FROM documents
WHERE concat('/lib/', source, '/', lang, '/', doc_id, '.jpg') NOT IN (SELECT path FROM photos WHERE deleted_at IS NULL)""")
def i02(v):
    files = v.raw("documents").selectExpr("concat('/lib/', source, '/', lang, '/', doc_id, '.jpg') AS path")
    return ing.resume_filter(files, v.photos)


@query("i03_quality_floor", ctes("photos", "faces") + """,
k AS (SELECT * FROM faces WHERE quality_score >= 0.25::DOUBLE)
SELECT (SELECT count(*) FROM photos WHERE photo_id IN (SELECT photo_id FROM k)) AS photos, (SELECT count(*) FROM k) AS faces""")
def i03(v):
    photos, faces = ing.quality_floor(v.photos, v.faces)
    return cat._side_by_side([photos.agg(F.count(F.lit(1)).alias("photos")), faces.agg(F.count(F.lit(1)).alias("faces"))])


@query("i04_round_boxes", ctes("detections") + """
SELECT image_id, det_seq, CAST(floor(x1 / 4 - 3 + 0.5) AS INT) AS x1, CAST(floor(y1 / 4 - 3 + 0.5) AS INT) AS y1, CAST(floor(x2 / 4 + 0.5) AS INT) AS x2, CAST(floor(y2 / 4 + 0.5) AS INT) AS y2 FROM detections""")
def i04(v):
    return ing.round_boxes(new_detections(v)).select("image_id", "det_seq", "x1", "y1", "x2", "y2")


@query("i05_rescan_removals", ctes("photos") + f"""
SELECT photo_id, CAST(CASE WHEN deleted_at IS NULL AND width % 3 = 0 AND starts_with(path, '/lib/') THEN {NOW_SQL} ELSE deleted_at END AS VARCHAR) AS deleted_at FROM photos""")
def i05(v):
    listing = v.photos.where("width % 3 <> 0").select("path")
    return shown(ing.rescan_removals(v.photos, listing, "/lib", now()).select("photo_id", "deleted_at"))


@query("i06_upsert_folder", ctes("folders") + f"""
SELECT folder_id, host_path, CASE WHEN host_path = '/lib/src1' THEN 'renamed' ELSE name END AS name, CAST(added_at AS VARCHAR) AS added_at FROM folders
UNION ALL SELECT 'f-new', '/extra', 'extra', CAST({NOW_SQL} AS VARCHAR)""")
def i06(v):
    once = ing.upsert_folder(v.folders, "/lib/src1", "renamed", "unused", now())
    return shown(ing.upsert_folder(once, "/extra", "extra", "f-new", now()))


@query("i07_mark_folder_scanned", ctes("folders") + f"""
SELECT folder_id, CASE WHEN host_path = '/lib/src1' THEN CAST({NOW_SQL} AS VARCHAR) END AS last_scanned_at FROM folders""")
def i07(v):
    rows = v.folders.withColumn("last_scanned_at", F.lit(None).cast("timestamp_ntz"))
    return shown(ing.mark_folder_scanned(rows, "/lib/src1", now()).select("folder_id", "last_scanned_at"))


@query("i08_scan_summary", ctes("scan_events") + """
SELECT scan_id, max(event_id) AS total, max(event_id % 97) AS scanned, bool_or(status = 'done' AND event_id % 3 = 0) AS cancelled,
       CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS elapsed_ms FROM scan_events GROUP BY scan_id""")
def i08(v):
    ended = F.when((F.col("status") == "done") & (F.col("event_id") % 3 == 0), "cancelled").otherwise(F.col("status"))
    events = v.scan_events.withColumns({"total": F.col("event_id"), "scanned": F.col("event_id") % 97, "status": ended})
    return ing.scan_summary(events)


@query("i09_soft_delete", ctes("photos", "faces") + f"""
SELECT photo_id, CAST(CASE WHEN photo_id IN (SELECT photo_id FROM faces WHERE face_quality = 'low') THEN {NOW_SQL} ELSE deleted_at END AS VARCHAR) AS deleted_at FROM photos""")
def i09(v):
    ids = v.faces.where("face_quality = 'low'").select("photo_id")
    return shown(ing.soft_delete(v.photos, ids, now()).select("photo_id", "deleted_at"))


@query("i10_restore", ctes("photos", "faces") + """
SELECT photo_id, CAST(CASE WHEN photo_id NOT IN (SELECT photo_id FROM faces) THEN deleted_at END AS VARCHAR) AS deleted_at,
  (SELECT count(*) FROM photos WHERE deleted_at IS NOT NULL AND photo_id IN (SELECT photo_id FROM faces)) AS restored FROM photos""")
def i10(v):
    count = ing.restorable(v.photos, v.faces).select(F.col("n").alias("restored"), F.lit(1).alias("_one"))
    rows = ing.restore(v.photos, v.faces).select("photo_id", "deleted_at", F.lit(1).alias("_one"))
    return shown(rows.join(count, "_one").drop("_one"))


@query("i11_empty_trash", ctes("photos", "faces") + """
SELECT f.face_id, p.photo_id FROM photos p LEFT JOIN faces f ON f.photo_id = p.photo_id WHERE p.deleted_at IS NULL""")
def i11(v):
    photos, faces = ing.empty_trash(v.photos, v.faces)
    return photos.select("photo_id").join(faces.select("photo_id", "face_id"), "photo_id", "left").select("face_id", "photo_id")


@query("i12_delete_folder", ctes("photos", "faces", "folders") + """,
k AS (SELECT * FROM photos WHERE NOT starts_with(path, '/lib/src1/'))
SELECT (SELECT count(*) FROM k) AS photos, (SELECT count(*) FROM faces WHERE photo_id IN (SELECT photo_id FROM k)) AS faces,
       (SELECT count(*) FROM folders WHERE host_path <> '/lib/src1') AS folders""")
def i12(v):
    photos, faces, folders = ing.delete_folder(v.photos, v.faces, v.folders, "/lib/src1")
    n = F.count(F.lit(1))
    return cat._side_by_side([photos.agg(n.alias("photos")), faces.agg(n.alias("faces")), folders.agg(n.alias("folders"))])


@query("i13_remove_unassigned_faces", ctes("photos", "faces") + """
SELECT face_id FROM faces WHERE NOT (person_id IS NULL AND photo_id IN (SELECT photo_id FROM photos WHERE deleted_at IS NULL))""")
def i13(v):
    return ing.remove_unassigned_faces(v.faces, v.photos).select("face_id")


@query("i14_remove_low_quality_faces", ctes("photos", "faces") + """
SELECT face_id FROM faces WHERE NOT (face_quality = 'very_low' AND photo_id IN (SELECT photo_id FROM photos WHERE deleted_at IS NULL))""")
def i14(v):
    return ing.remove_low_quality_faces(v.faces, v.photos).select("face_id")


@query("i15_remove_empty_persons", ctes("faces", "persons") + """
SELECT person_id, name FROM persons WHERE person_id IN (SELECT person_id FROM faces WHERE person_id IS NOT NULL)""")
def i15(v):
    return ing.remove_empty_persons(v.persons, v.faces).select("person_id", "name")


@query("i16_orphan_assets", ctes("photos", "faces") + """,
u AS (SELECT concat(substr(md5(text), 1, 8), '-', substr(md5(text), 9, 4), '-', substr(md5(text), 13, 4), '-', substr(md5(text), 17, 4), '-', substr(md5(text), 21, 12)) AS id, n_chars FROM documents),
a AS (SELECT DISTINCT concat(id, CASE WHEN n_chars % 4 = 0 THEN '.png' ELSE '.jpg' END) AS name FROM u),
p AS (SELECT concat(id, '.jpg') AS name FROM u WHERE n_chars % 3 = 0)
SELECT name FROM a WHERE name LIKE '%.jpg' AND name NOT IN (SELECT name FROM p)""")
def i16(v):
    docs = v.raw("documents").selectExpr("md5(text) AS h", "n_chars")
    named = docs.selectExpr(
        "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS id", "n_chars"
    )
    assets = named.selectExpr("concat(id, CASE WHEN n_chars % 4 = 0 THEN '.png' ELSE '.jpg' END) AS name").distinct()
    photos = named.where("n_chars % 3 = 0").selectExpr("concat('/cache/', id, '.jpg') AS thumb_path")
    return cat.orphan_assets(assets, photos, v.faces)


@query("i17_rename_person", ctes("faces", "persons") + "SELECT person_id, CASE WHEN person_id = 4 THEN 'Dora' ELSE name END AS name FROM persons")
def i17(v):
    return ing.rename_person(v.persons, 4, "Dora").select("person_id", "name")


@query("i18_set_person_avatar", ctes("faces", "persons") + f"""
SELECT person_id, CASE WHEN person_id = 4 THEN 'person-4.jpg' END AS avatar_path, CASE WHEN person_id = 4 THEN CAST({NOW_SQL} AS VARCHAR) END AS updated_at FROM persons""")
def i18(v):
    persons = v.persons.withColumns({"avatar_path": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    changed, _ = ing.set_person_avatar(persons, 4, "person-4.jpg", now())
    return shown(changed.select("person_id", "avatar_path", "updated_at"))


@query("i19_delete_person", ctes("faces", "persons") + """
SELECT f.face_id, CASE WHEN f.person_id <> 4 THEN f.person_id END AS person_id, (SELECT count(*) FROM persons WHERE person_id <> 4) AS persons FROM faces f""")
def i19(v):
    persons, faces = ing.delete_person(v.persons, v.faces, 4)
    count = persons.agg(F.count(F.lit(1)).alias("persons"), F.lit(1).alias("_one"))
    return faces.select("face_id", "person_id", F.lit(1).alias("_one")).join(count, "_one").drop("_one")


@query("i20_merge_persons", ctes("faces", "persons", "person_manual") + """,
m AS (SELECT face_id, CASE WHEN person_id IN (2, 5) THEN 4 ELSE person_id END AS person_id, embedding FROM faces),
parts AS (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS val FROM m WHERE person_id = 4 AND embedding IS NOT NULL),
cent AS (SELECT pos, avg(val) AS c FROM parts GROUP BY pos),
n AS (SELECT person_id, count(*) AS faces FROM m GROUP BY 1)
SELECT p.person_id, CASE WHEN p.person_id = 4 THEN 'Person 4 & Person 2 & Person 5' ELSE p.name END AS name, coalesce(n.faces, 0) AS faces,
  p.person_id IN (3, 7, 4) AS manual, CASE WHEN p.person_id = 4 THEN (SELECT round(c / (SELECT sqrt(sum(c * c)) FROM cent), 6) FROM cent WHERE pos = 1) END AS first_component
FROM persons p LEFT JOIN n ON n.person_id = p.person_id WHERE p.person_id NOT IN (2, 5)""")
def i20(v):
    persons, faces, manual, _ = ing.merge_persons(v.persons, v.faces, v.person_manual, 4, [2, 4, 5])
    counts = faces.groupBy("person_id").agg(F.count(F.lit(1)).alias("faces"))
    marks = manual.select("person_id", F.lit(True).alias("manual"))
    return rounded(
        persons.join(counts, "person_id", "left").join(marks, "person_id", "left").select(
            "person_id", "name", F.coalesce("faces", F.lit(0)).cast("long").alias("faces"),
            F.coalesce("manual", F.lit(False)).alias("manual"), F.get("centroid", F.lit(0)).alias("first_component"),
        ),
        "first_component",
    )


@query("i21_split_person", ctes("faces", "persons") + """,
b AS (SELECT max(person_id) AS top, count(*) AS n FROM persons),
s AS (SELECT face_id, row_number() OVER (ORDER BY created_at, face_order) AS rn FROM faces WHERE person_id = 4)
SELECT f.face_id, coalesce(b.top + s.rn, f.person_id) AS person_id, CASE WHEN s.rn IS NOT NULL THEN concat('Person ', b.n + s.rn) ELSE p.name END AS name
FROM faces f CROSS JOIN b LEFT JOIN s ON s.face_id = f.face_id LEFT JOIN persons p ON p.person_id = f.person_id""")
def i21(v):
    persons, faces, _ = ing.split_person(v.persons, v.faces, v.person_manual, 4)
    return faces.join(persons.select("person_id", "name"), "person_id", "left").select("face_id", "person_id", "name")


@query("i22_set_face_person", ctes("faces") + "SELECT face_id, CASE face_id WHEN 11 THEN 4 WHEN 12 THEN NULL ELSE person_id END AS person_id FROM faces")
def i22(v):
    return ing.set_face_person(ing.set_face_person(v.faces, 11, 4), 12, None).select("face_id", "person_id")


@query("i23_add_faces", ctes("faces") + """
SELECT face_id, person_id, face_quality, quality_score, low_quality FROM faces UNION ALL
SELECT 1000000 + face_id, NULL, coalesce(CASE WHEN face_id % 2 = 0 THEN face_quality END, 'medium'), 0.5::DOUBLE, false FROM faces""")
def i23(v):
    new = v.faces.selectExpr(
        "1000000 + face_id AS face_id", "1000000 + face_order AS face_order", "photo_id", "x1", "y1", "x2", "y2",
        "CASE WHEN face_id % 2 = 0 THEN face_quality END AS face_quality",
    )
    return ing.add_faces(v.faces, new).select("face_id", "person_id", "face_quality", "quality_score", "low_quality")


@query("i24_missing_crops", ctes("photos", "faces") + """
SELECT f.face_id, p.path AS photo_path, f.x1, f.y1, f.x2, f.y2 FROM faces f JOIN photos p ON p.photo_id = f.photo_id WHERE f.face_quality <> 'high'""")
def i24(v):
    assets = v.faces.where("face_quality = 'high'").selectExpr("concat(face_id, '.jpg') AS name")
    return ing.missing_crops(v.faces, v.photos, assets)


@query("s08_assignment_lines", ctes("photos", "faces", "persons") + """
SELECT concat(regexp_extract(p.path, '[^/]*$'), ' ', CASE WHEN regexp_extract(pe.name, '^Person ([0-9]+)$', 1) = '' THEN 'NaN' ELSE regexp_extract(pe.name, '^Person ([0-9]+)$', 1) END) AS value
FROM faces f JOIN photos p ON p.photo_id = f.photo_id JOIN persons pe ON pe.person_id = f.person_id""")
def s08(v):
    return io.assignment_lines(v.faces, v.photos, v.persons)


@query("s09_sample_identities", ctes("photos") + """,
f AS (SELECT regexp_extract(path, '^/lib/([^/]+)/', 1) AS identity, path FROM photos),
d AS (SELECT identity, count(*) AS photos FROM f GROUP BY 1 HAVING count(*) >= 2 ORDER BY photos DESC, identity LIMIT 12)
SELECT d.identity, d.photos, f.path FROM f JOIN d ON d.identity = f.identity QUALIFY row_number() OVER (PARTITION BY f.identity ORDER BY path) <= 6""")
def s09(v):
    files = v.photos.select(ev.parse_identity(F.col("path"), r"^/lib/([^/]+)/").alias("identity"), "path")
    return io.sample_identities(files, 2, 12, 6)


@query("s11_parse_identity", ctes("photos") + """
SELECT photo_id, regexp_extract(path, '^/lib/([^/]+)/', 1) AS identity, nullif(regexp_extract(path, '/(src1[0-9])/', 1), '') AS partial FROM photos""")
def s11(v):
    return v.photos.select(
        "photo_id", ev.parse_identity(F.col("path"), r"^/lib/([^/]+)/").alias("identity"),
        ev.parse_identity(F.col("path"), r"/(src1[0-9])/").alias("partial"),
    )
