"""Sources and sinks over the given tables: listings, hashes, stored catalogs, vectors, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.operators import catalog as cat
from kinframe.plans.registry import ctes, query
from kinframe.session import checkpoint_root
from kinframe.sources import catalog_io as io
from kinframe.sources.schema import read_versions, upgrade_schema

# Fixed value: folders that the files of all documents are dealt to.
FOLDERS = 256

LISTING = (
    "concat('/lib/', source, '/', lang, '/', CASE WHEN doc_id % 13 = 0 THEN '._' ELSE '' END, doc_id, "
    "CASE doc_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' WHEN 4 THEN '.webp' ELSE '.pdf' END)"
)


def listing(v) -> DataFrame:
    """What a folder listing would show: names of images, of other files and of sidecars."""
    return v.raw("documents").selectExpr(f"{LISTING} AS path", "n_chars AS length")


def folder(v) -> str:
    return f"{checkpoint_root(v.spark)}/source-{uuid.uuid4().hex}"


@query("s01_image_files", f"""
SELECT path, length FROM (SELECT {LISTING} AS path, n_chars AS length FROM documents)
WHERE regexp_matches(lower(path), '[.](jpg|jpeg|png|bmp|webp)$') AND NOT contains(path, '/._')""")
def s01(v):
    return io.image_files(listing(v))


@query("s02_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def s02(v):
    return io.content_hash(v.raw("documents").select("doc_id", "text"), "text", "sha256").select("doc_id", "content_hash")


@query("s03_stored_catalog", ctes("photos", "faces") + """
SELECT p.photo_id, p.path, p.deleted_at IS NOT NULL AS trashed, count(f.face_id) AS faces
FROM photos p LEFT JOIN faces f ON f.photo_id = p.photo_id GROUP BY ALL""")
def s03(v):
    """Saved twice: readers get the newer version."""
    root = folder(v)
    io.save_catalog({"photos": v.photos.limit(0), "faces": v.faces.limit(0)}, root)
    io.save_catalog({"photos": v.photos, "faces": v.faces}, root)
    found = io.load_catalog(v.spark, root)
    counts = found["faces"].groupBy("photo_id").agg(F.count(F.lit(1)).alias("faces"))
    rows = found["photos"].join(counts, "photo_id", "left")
    return rows.select("photo_id", "path", F.col("deleted_at").isNotNull().alias("trashed"), F.coalesce("faces", F.lit(0)).cast("long").alias("faces"))


@query("s04_upgrade_schema", ctes("faces") + "SELECT face_id, 'medium' AS face_quality, false AS low_quality, 0.5::DOUBLE AS quality_score FROM faces")
def s04(v):
    old = v.faces.drop("face_quality", "low_quality", "quality_score")
    return upgrade_schema(old, "faces").select("face_id", "face_quality", "low_quality", "quality_score")


@query("s02_file_hashes", """
SELECT doc_id, octet_length(encode(text)) + 1 AS length, sha256(text || chr(10)) AS content_hash FROM documents WHERE text IS NOT NULL""")
def s02_files(v):
    """A file per document, written by the tasks, found by a scan of the folder and hashed."""
    root = folder(v)
    name = F.concat_ws("-", "doc_id", F.monotonically_increasing_id())
    docs = v.raw("documents").where("text IS NOT NULL").select(
        F.concat(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(FOLDERS)), F.lit("/doc_"), name, F.lit(".txt")).alias("path"),
        F.concat("text", F.lit("\n")).cast("binary").alias("content"),
    )
    io.write_files(docs, root)
    files = io.content_hash(io.read_files(v.spark, root, "*.txt"), method="sha256")
    return files.select(F.regexp_extract("path", r"/doc_(-?\d+)-\d+[.]txt$", 1).try_cast("long").alias("doc_id"), "length", "content_hash")


@query("s04_mixed_versions", ctes("faces") + """
SELECT face_id, version, CASE WHEN version < 2 THEN 'medium' ELSE face_quality END AS face_quality,
       CASE WHEN version < 2 THEN 0.5::DOUBLE ELSE quality_score END AS quality_score
FROM (SELECT *, CAST(1 + face_id % 3 AS INT) AS version FROM faces)""")
def s04_mixed(v):
    """Three versions side by side; the first knows no quality."""
    root, faces = folder(v), v.faces.withColumn("version", F.expr("CAST(1 + face_id % 3 AS INT)"))
    added = ["face_quality", "low_quality", "quality_score"]
    for version in (1, 2, 3):
        rows = faces.where(F.col("version") == version).drop("version", *(added if version < 2 else []))
        rows.write.parquet(f"{root}/version={version}")
    return read_versions(v.spark, root, "faces").select("face_id", "version", "face_quality", "quality_score")


@query("s05_vector_blobs", """
SELECT vec_id, 4 * len(embedding) AS bytes, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""")
def s05(v):
    blobs = v.raw("embeddings").select("vec_id", io.embedding_to_blob("embedding").alias("blob"))
    back = blobs.select("vec_id", F.length("blob").cast("long").alias("bytes"), io.embedding_from_blob("blob").alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", "bytes", F.round(total, 6).alias("total"))


@query("s07_report", ctes("faces") + """
SELECT face_quality, count(*) AS faces, round(avg(quality_score), 6) AS score FROM faces GROUP BY face_quality""")
def s07(v):
    root = folder(v)
    parts = v.faces.groupBy("face_quality").agg(F.count(F.lit(1)).alias("faces"), F.round(F.avg("quality_score"), 6).alias("score"))
    io.write_report({"tiers": parts}, root)
    return v.spark.read.schema("face_quality string, faces long, score double").json(f"{root}/tiers")


# Every document is listed; those that play missing files have a name that no photo has.
def listed(v, there: str) -> DataFrame:
    """A file of every document, under its photo's path only where ``there`` holds."""
    path = f"CASE WHEN {there} THEN concat('/lib/', source, '/', lang, '/', doc_id, '.jpg') ELSE concat('/lost/', doc_id, '.jpg') END"
    return v.raw("documents").selectExpr(f"{path} AS path", "n_chars AS length")


def thumbs(v) -> DataFrame:
    """A thumbnail of every document, empty where it plays a missing one."""
    return v.raw("documents").selectExpr("CASE WHEN doc_id % 5 <> 4 THEN n_chars ELSE 0 END AS length")


@query("s10_library_storage", ctes("photos") + """
SELECT (SELECT coalesce(sum(d.n_chars), 0)::BIGINT FROM documents d JOIN photos p ON p.photo_id = d.doc_id WHERE p.deleted_at IS NULL AND d.doc_id % 3 <> 0) AS photo_bytes,
       (SELECT coalesce(sum(n_chars), 0)::BIGINT FROM documents WHERE doc_id % 5 <> 4) AS thumb_bytes""")
def s10(v):
    return io.library_storage(v.photos, listed(v, "doc_id % 3 <> 0"), thumbs(v))


@query("q02_folder_bytes", ctes("photos", "folders") + """,
files AS (SELECT concat('/lib/', source, '/', lang, '/', doc_id, '.jpg') AS path, n_chars AS length FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src3')
SELECT f.folder_id, (SELECT coalesce(sum(length), 0)::BIGINT FROM files JOIN photos p ON p.path = files.path WHERE p.deleted_at IS NULL AND starts_with(p.path, f.host_path || '/')) AS size_bytes,
       EXISTS (SELECT 1 FROM files WHERE starts_with(files.path, f.host_path || '/')) AS available FROM folders f""")
def q02_bytes(v):
    files = listed(v, "doc_id % 3 <> 0 AND source <> 'src3'")
    return cat.folder_breakdown(v.folders, v.photos, v.faces, files).select("folder_id", "size_bytes", "available")


ASSET = "concat(substr(md5(CAST({0} AS VARCHAR(20))), 1, 8), '-0000-4000-8000-', lpad(CAST({0} AS VARCHAR(20)), 12, '0'), '{1}')"


def cached(v) -> DataFrame:
    """A cache file of every document, under another ending where it is no asset."""
    name = f"CASE WHEN doc_id % 4 <> 0 THEN {ASSET.format('doc_id', '.jpg')} ELSE {ASSET.format('doc_id', '.tmp')} END"
    return v.raw("documents").selectExpr(f"{name} AS name")


@query("q18_orphans", ctes("faces") + f"""
SELECT count(*) AS orphan_thumbs FROM (SELECT {ASSET.format('doc_id', '')} AS id FROM documents WHERE doc_id % 4 <> 0)
WHERE id NOT IN (SELECT {ASSET.format('face_id', '')} FROM faces)""")
def q18_orphans(v):
    faces = v.faces.withColumn("face_id", F.expr(ASSET.format("face_id", "")))
    return cat.cleanup_stats(v.photos, faces, v.persons, cached(v)).select("orphan_thumbs")


@query("q20_has_path_and_hash", ctes("photos") + """,
probe AS (SELECT path, content_hash FROM photos WHERE photo_id = 42), trashed AS (SELECT path, content_hash FROM photos WHERE photo_id = 20)
SELECT (SELECT count(*) > 0 FROM photos WHERE deleted_at IS NULL AND path = (SELECT path FROM probe)) AS path_known,
       (SELECT count(*) > 0 FROM photos WHERE deleted_at IS NULL AND path = (SELECT path FROM trashed)) AS trashed_path_known,
       (SELECT count(*) > 0 FROM photos WHERE content_hash = (SELECT content_hash FROM trashed)) AS trashed_hash_known,
       (SELECT count(*) > 0 FROM photos WHERE path = '/lib/none.jpg') AS other_path_known""")
def q20_known(v):
    probe, trashed = (v.photos.where(F.col("photo_id") == i).first() for i in (42, 20))
    known = [
        cat.has_path(v.photos, probe["path"]), cat.has_path(v.photos, trashed["path"]),
        cat.has_hash(v.photos, trashed["content_hash"]), cat.has_path(v.photos, "/lib/none.jpg"),
    ]
    names = ["path_known", "trashed_path_known", "trashed_hash_known", "other_path_known"]
    return v.photos.limit(1).select(*[F.lit(k).alias(n) for k, n in zip(known, names)])
