"""Readers and writers: image folders, catalogs, vectors, golden files and reports."""

from __future__ import annotations

import json
import math
import os
import uuid
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinframe.operators.catalog import basename, live
from kinframe.operators.ranking import rank_in_group
from kinframe.session import materialize
from kinframe.sources.schema import SCHEMA_VERSION, TABLES, upgrade_schema

# File extensions taken as images.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "webp"]

# Largest file whose content is read.
MAX_CONTENT = 256 << 20
# Files and bytes that one task reads, about; rows and bytes of content that it hands on at once.
TASK_FILES, TASK_BYTES = 10_000, 128 << 20
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def open_root(root: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of an address, the folder there, and what precedes that folder's paths in addresses.

    Local folders are named plainly or by ``file:``; all others are addresses that Arrow can
    open: HDFS or an object store.
    """
    if "://" not in root or root.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath("/" + root[5:].lstrip("/") if root.startswith("file:") else root), "file:"
    files, base = pafs.FileSystem.from_uri(root)
    return files, base, root[: -len(base)] if base and root.endswith(base) else root.split("://")[0] + "://"


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files under ``root`` by shell pattern of their name: ``path, length, modified_at``.

    Tasks list the folders, one level after the other, and store what they found; the
    driver never holds the files. Hidden names and empty files are left out, as Spark's
    readers do.
    """
    target, base, before = open_root(root)
    first = target.get_file_info(base)
    if first.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified_at", T.TimestampType()), T.StructField("folder", T.BooleanType())])
    names = schema.names

    def wanted(info):
        return info.type == pafs.FileType.Directory or (info.size > 0 and (pattern is None or fnmatchcase(info.base_name, pattern)))

    def rows(infos):
        stamp = pa.array([i.mtime_ns // 1000 if i.mtime_ns else None for i in infos], pa.int64()).cast(pa.timestamp("us", "UTC"))
        folder = [i.type == pafs.FileType.Directory for i in infos]
        size = [0 if f else i.size for i, f in zip(infos, folder)]
        return pa.RecordBatch.from_arrays([pa.array([before + i.path for i in infos], pa.string()), pa.array(size, pa.int64()), stamp, pa.array(folder, pa.bool_())], names)

    def run(batches):
        source = open_root(root)[0]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = source.get_file_info(pafs.FileSelector(path.removeprefix(before)))
                found = [i for i in found if not _hidden(i.base_name) and wanted(i)]
                for at in range(0, len(found), BATCH_ROWS):
                    yield rows(found[at : at + BATCH_ROWS])

    if first.type != pafs.FileType.Directory:
        return spark.createDataFrame(pa.Table.from_batches([rows([first] if wanted(first) else [])]), schema).drop("folder")
    level, tasks, levels = spark.createDataFrame([(before + base,)], "path string"), 1, []
    while tasks:
        found = materialize(level.repartition(tasks).mapInArrow(run, schema))
        levels.append(found.where("NOT folder").drop("folder"))
        level = found.where("folder").select("path")
        tasks = min(level.count(), 4 * spark.sparkContext.defaultParallelism)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files under ``root``, ordered by path: ``path, length, modified_at``.

    File contents are not read.
    """
    return image_files(list_files(spark, root)).orderBy("path")


def image_files(files: DataFrame) -> DataFrame:
    """Keep image extensions in any case, without ``._`` sidecar files."""
    name = basename("path")
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.where(extension.isin(*IMAGE_EXTENSIONS) & ~name.startswith("._")).withColumn(
        "path", F.regexp_replace("path", r"^file:/+", "/")
    )


def read_contents(spark: SparkSession, root: str, max_bytes: int = MAX_CONTENT) -> DataFrame:
    """``path, length, content`` of the image files under ``root``."""
    return image_files(read_files(spark, root, max_bytes=max_bytes))


def read_files(spark: SparkSession, root: str, pattern: str | None = None, max_bytes: int = MAX_CONTENT) -> DataFrame:
    """``path, length, content`` of files by name pattern.

    The pattern narrows the listing. A file's content is one value in memory, so content of
    files above ``max_bytes`` is null; it is never read, as the length is known before.
    The listing is stored and dealt to tasks by its number of files and bytes, so neither
    the driver nor a task holds more as folders grow.
    """
    files = list_files(spark, root, pattern).select("path", "length")
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("length") <= max_bytes, F.col("length"))), F.lit(0))).first()
    tasks = max(min(n, spark.sparkContext.defaultParallelism), math.ceil(n / TASK_FILES), math.ceil(size / TASK_BYTES), 1)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*held), schema)], schema.names)

    def run(batches):
        source, _, before = open_root(root)
        held, size = [], 0
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                content = None
                if length <= max_bytes:
                    if held and size + length > BATCH_BYTES:
                        yield rows(held)
                        held, size = [], 0
                    with source.open_input_file(path.removeprefix(before)) as file:
                        content = file.read()
                    size += length
                held.append((path, length, content))
                if len(held) == BATCH_ROWS:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return files.repartition(tasks).mapInArrow(run, schema)


def write_files(files: DataFrame, root: str) -> int:
    """Write a file per row of ``files(path, content)`` below ``root``; returns their number.

    Paths are relative and must differ. The tasks write the files themselves, as a commit by
    Spark's writers costs several steps a file, partly in the driver. A repeated task
    writes the same files again. ``root`` may be any address that ``open_root`` takes.
    """

    def run(batches):
        target, base, _ = open_root(root)
        made, n = set(), 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                full = f"{base}/{path}"
                folder = full.rpartition("/")[0]
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                with target.open_output_stream(full, compression=None) as out:
                    out.write(content)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    open_root(root)  # an address that Arrow does not know fails here, not in a task
    rows = files.select(F.col("path"), F.coalesce(F.col("content"), F.lit(b"")).alias("content"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def content_hash(df: DataFrame, content: str = "content", method: str = "xxhash64") -> DataFrame:
    """Add ``content_hash``: 16 hex digits of xxHash64, or SHA-256."""
    if method == "xxhash64":
        value = F.lower(F.lpad(F.hex(F.xxhash64(content)), 16, "0"))
    elif method == "sha256":
        value = F.sha2(F.col(content), 256)
    else:
        raise ValueError(f"unknown hash {method!r}")
    return df.withColumn("content_hash", value)


# ------------------------------------------------------------------ catalogs


POINTER = "CATALOG-{:012d}.json"


def _folder(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def _pointers(fs, folder) -> list[int]:
    """The numbers of the catalog's pointers, oldest first."""
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[8:-5]) for n in names if n.startswith("CATALOG-") and n.endswith(".json"))


def save_catalog(catalog: dict[str, DataFrame], root: str) -> str:
    """Write all tables to a new version folder, then point the catalog at it.

    Pointers are numbered and never replaced: the new one appears by one rename after
    every table is complete, and readers take the newest, so they see either the old or
    the new catalog. Two writers cannot both take a number; the later one fails. Pointers
    older than the last two go, and with them the folders of their versions: who reads the
    version before the newest can go on, until another one is saved.
    """
    spark = next(iter(catalog.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in catalog.items():
        df.write.parquet(f"{root}/v-{version}/{name}")
    fs, folder, jvm = _folder(spark, root)
    old = _pointers(fs, folder)
    number = old[-1] + 1 if old else 1
    fresh = jvm.org.apache.hadoop.fs.Path(folder, f"{version}.tmp")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"version": version, "schema": SCHEMA_VERSION, "tables": sorted(catalog)}), "utf-8"))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(folder, POINTER.format(number))
    if fs.exists(target) or not fs.rename(fresh, target):
        raise RuntimeError(f"could not switch {root} to version {version}")
    for gone in old[:-1]:
        pointer = f"{root}/{POINTER.format(gone)}"
        # The folder first: if this stops half-way, the next save finds the pointer again.
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"v-{_pointed(spark, pointer)['version']}"), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(pointer), False)
    return version


def _pointed(spark: SparkSession, pointer: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(pointer).first()["value"])


def load_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current tables, brought up to the newest schema version."""
    fs, folder, _ = _folder(spark, root)
    numbers = _pointers(fs, folder)
    if not numbers:
        raise FileNotFoundError(f"no catalog in {root}")
    info = _pointed(spark, f"{root}/{POINTER.format(numbers[-1])}")
    tables = {
        name: upgrade_schema(spark.read.parquet(f"{root}/v-{info['version']}/{name}"), name) for name in info["tables"]
    }
    if "person_manual" not in tables:
        tables["person_manual"] = spark.createDataFrame([], TABLES["person_manual"])
    return tables


def library_storage(photos: DataFrame, files: DataFrame, thumbs: DataFrame | None = None) -> DataFrame:
    """Bytes of indexed live photos still on disk, and of the thumbnail cache."""
    kept = files.join(live(photos).select("path").distinct(), "path", "left_semi")
    total = lambda df, name: df.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias(name)).withColumn("_one", F.lit(1))
    cache = total(thumbs, "thumb_bytes") if thumbs is not None else total(files.limit(0), "thumb_bytes")
    return total(kept, "photo_bytes").join(cache, "_one").drop("_one")


# ------------------------------------------------------------------ vectors


@F.arrow_udf(T.ArrayType(T.FloatType()))
def embedding_from_blob(blob: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to an array; null stays null."""
    size = pc.fill_null(pc.binary_length(blob), 0).to_numpy(zero_copy_only=False)
    starts = np.append(0, np.cumsum(size // 4)).astype(np.int32)
    values = np.frombuffer(b"".join(blob.drop_null().to_pylist()), "<f4")
    offsets = pa.array(starts, mask=np.append(blob.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32()))


@F.arrow_udf(T.BinaryType())
def embedding_to_blob(vector: pa.Array) -> pa.Array:
    """An array to little-endian float32 bytes; null stays null."""
    size = pc.fill_null(pc.list_value_length(vector), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vector.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4")
    offsets = (np.append(0, np.cumsum(size)) * 4).astype(np.int32)
    present = pa.array(~vector.is_null().to_numpy(zero_copy_only=False))
    packed = pa.Array.from_buffers(pa.binary(), len(vector), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
    return pc.if_else(present, packed, pa.scalar(None, pa.binary()))


# ------------------------------------------------------------------ golden files and reports

GOLDEN_SCHEMA = (
    "generated_by string, reference string, photos array<struct<photo: string, width: int, height: int, "
    "faces: array<struct<bbox: array<double>, det_score: double, kps: array<array<double>>, "
    "M: array<array<double>>, embedding: array<float>, ref_embedding: array<float>>>>>"
)


def write_golden(faces: DataFrame, root: str, photos_per_file: int = 25) -> None:
    """Faces as nested golden files: ``faces(photo, width, height, face_seq, x1..y2, embedding)``.

    A file holds some photos with all their faces, in the order of ``face_seq``.
    """
    face = F.struct(
        F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), F.lit(1.0).alias("det_score"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    photos = faces.groupBy("photo").agg(
        F.first("width").alias("width"), F.first("height").alias("height"),
        F.array_sort(F.collect_list(F.struct("face_seq", face.alias("f")))).alias("all"),
    )
    files = max(1, photos.count() // photos_per_file)
    photo = F.struct("photo", "width", "height", F.col("all.f").alias("faces"))
    rows = photos.groupBy(F.pmod(F.xxhash64("photo"), F.lit(files)).alias("part")).agg(F.collect_list(photo).alias("photos"))
    rows.select("part", F.to_json(F.struct("photos")).alias("value")).repartition("part").write.partitionBy("part").text(root)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A nested golden file as one row per face."""
    photos = spark.read.schema(GOLDEN_SCHEMA).option("recursiveFileLookup", True).json(path, multiLine=True).select(F.explode("photos").alias("p"))
    faces = photos.select("p.photo", "p.width", "p.height", F.posexplode("p.faces").alias("face_seq", "f"))
    box = [F.get("f.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    kps = F.transform("f.kps", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return faces.select(
        "photo", "width", "height", F.col("face_seq").cast("long").alias("face_seq"), *box,
        "f.det_score", kps.alias("kps"), F.col("f.M").alias("transform"), "f.embedding", "f.ref_embedding",
    )


def write_report(parts: dict[str, DataFrame], root: str) -> None:
    """Each part of a report as JSON lines under ``root/<part>``."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def assignment_lines(faces: DataFrame, photos: DataFrame, persons: DataFrame) -> DataFrame:
    """``<file name> <person number>`` per assigned face, ordered by path."""
    number = F.regexp_extract("name", r"(?i)^person (\d+)$", 1)
    return (
        faces.select("face_id", "photo_id", "person_id")
        .join(persons.select("person_id", number.alias("_n")), "person_id")
        .join(photos.select("photo_id", "path"), "photo_id")
        .orderBy("path", "face_id")
        .select(F.concat_ws(" ", basename("path"), F.when(F.col("_n") == "", "NaN").otherwise(F.col("_n"))).alias("value"))
    )


def write_assignment_dump(faces: DataFrame, photos: DataFrame, persons: DataFrame, path: str) -> None:
    assignment_lines(faces, photos, persons).write.mode("overwrite").text(path)


def sample_identities(
    files: DataFrame, min_photos: int = 2, max_identities: int = 40, per_identity: int = 6
) -> DataFrame:
    """The densest identities and their first files: ``files(identity, path)``."""
    counts = files.groupBy("identity").agg(F.count(F.lit(1)).alias("photos")).where(F.col("photos") >= min_photos)
    dense = counts.orderBy(F.col("photos").desc(), "identity").limit(max_identities)
    ranked = rank_in_group(files.join(dense.select("identity"), "identity", "left_semi"), ["identity"], ["path"])
    return ranked.where(F.col("rn") <= per_identity).join(dense, "identity").select("identity", "photos", "path")
