"""A keyed Parquet table that a stream updates bucket by bucket.

Rows are dealt into buckets by a hash of their keys. An update reads and rewrites only the
buckets of its keys, and a manifest, which appears by one rename, says in which folder each
bucket now lies: readers see all of an update or nothing. A batch that was applied before
changes nothing. Buckets that neither of the last two manifests names are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.session import materialize

BUCKETS = 64
BUCKET = "__bucket"
MANIFEST = "MANIFEST-{:012d}.json"


class BucketedTable:
    """``schema`` includes the ``keys``; the number of buckets is that of the first update."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: T.StructType | str, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("MANIFEST-") and n.endswith(".json"))

    def _manifest(self, batch: int) -> dict:
        line = self.spark.read.option("wholetext", True).text(f"{self.root}/{MANIFEST.format(batch)}").first()["value"]
        return json.loads(line)

    def _folders(self, folders: dict[str, str], wanted=None) -> DataFrame:
        paths = [f"{self.root}/{f}/{BUCKET}={b}" for b, f in folders.items() if wanted is None or int(b) in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def last_batch(self) -> int | None:
        """The newest batch that was applied."""
        found = self._batches()
        return found[-1] if found else None

    def read(self) -> DataFrame:
        """The table after the newest batch."""
        last = self.last_batch()
        return self.spark.createDataFrame([], self.schema) if last is None else self._folders(self._manifest(last)["folders"])

    def upsert(self, rows: DataFrame, batch: int, gone: DataFrame | None = None) -> list[int]:
        """Put ``rows`` in the place of all rows with their keys, and of those with the keys ``gone``.

        Returns the buckets that were written.
        """
        known = self._batches()
        if known and known[-1] >= batch:
            return []
        before = self._manifest(known[-1]) if known else {"buckets": self.buckets, "folders": {}}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(before["buckets"])).cast("int")
        names = self.schema.names
        rows = materialize(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(BUCKET, bucket))
        replaced = rows.select(*self.keys)
        if gone is not None:
            replaced = replaced.unionByName(gone.select(*self.keys))
        replaced = materialize(replaced.distinct())
        touched = sorted(r[0] for r in replaced.select(bucket).distinct().collect())
        old = self._folders(before["folders"], set(touched)).join(replaced, self.keys, "left_anti")
        folder = f"b-{batch:012d}"
        merged = old.withColumn(BUCKET, bucket).select(*names, BUCKET).unionByName(rows)
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        written = {f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{folder}"))}
        after = {b: f for b, f in before["folders"].items() if int(b) not in touched}
        after |= {str(b): folder for b in touched if f"{BUCKET}={b}" in written}
        self._switch(batch, {"buckets": before["buckets"], "folders": after})
        for gone in known[:-1]:
            self._forget(gone, [before["folders"], after])
        return touched

    def _switch(self, batch: int, manifest: dict) -> None:
        fresh = self._path(f"{self.root}/{batch}.tmp")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if not self._fs.rename(fresh, self._path(f"{self.root}/{MANIFEST.format(batch)}")):
            raise RuntimeError(f"could not switch {self.root} to batch {batch}")

    def _forget(self, batch: int, used: list[dict[str, str]]) -> None:
        """Remove an old manifest and what only it names."""
        kept = {(b, f) for folders in used for b, f in folders.items()}
        for b, f in self._manifest(batch)["folders"].items():
            if (b, f) not in kept:
                self._fs.delete(self._path(f"{self.root}/{f}/{BUCKET}={b}"), True)
        live = {f for _, f in kept}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("b-") and name not in live and int(name[2:]) <= batch:
                self._fs.delete(status.getPath(), True)
        self._fs.delete(self._path(f"{self.root}/{MANIFEST.format(batch)}"), False)
