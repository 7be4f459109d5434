"""Clusters kept up to date while faces come and go.

Two faces can only influence each other's cluster if a chain of allowed pairs connects
them, so the faces fall into components that are clustered one by one. The store keeps
every face with its component and cluster, in buckets of components. A change compares the
new faces with the stored ones once, joins the components that a new face connects, and
clusters only those again; all other components, and their files, stay as they are. The
result is that of clustering all faces at once.

Components may only be too large, never too small: a pair counts as a connection whatever
the tiers say, and removed faces do not split a component before it is clustered again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kinframe.operators.cluster import LINKAGE_THRESHOLD, LOW_JOIN, cluster_faces, connected_components
from kinframe.operators.pairs import Side, block_pairs, collapse_copies, rep_pairs, single_precision, tiles
from kinframe.session import materialize
from kinframe.streaming.buckets import BUCKETS, BucketedTable

FACES = "component long, face_order long, root long, cluster long, embedding array<double>, face_quality string"


def _reached(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """``(id_a, id_b)``: new faces with the components that hold a similar face.

    Tasks name a component once per new face, however many of its faces are similar.
    """
    schema = T.StructType([T.StructField("id_a", T.LongType()), T.StructField("id_b", T.LongType())])

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        found = [np.zeros((0, 2), np.int64)]
        for start, stop, s in tiles(a, b):
            i, j = np.nonzero(single_precision(s) > threshold)
            found.append(np.unique(np.stack([a.attr["id"][start + i], b.attr["component"][j]], 1).astype(np.int64), axis=0))
        pairs = np.concatenate(found)
        return pa.table({"id_a": pa.array(pairs[:, 0]), "id_b": pa.array(pairs[:, 1])})

    left = new.select(F.col("face_order").alias("id"), F.col("embedding").alias("vec"))
    right = old.select(F.col("face_order").alias("id"), F.col("embedding").alias("vec"), "component")
    return block_pairs(left, right, reduce, schema, threshold).distinct()


class ClusterStore:
    """Faces with component, root and cluster below ``root``; changed one batch at a time."""

    def __init__(self, spark: SparkSession, root: str, threshold: float = LINKAGE_THRESHOLD, low_join: float = LOW_JOIN, buckets: int = BUCKETS):
        self.spark, self.threshold, self.low_join = spark, threshold, low_join
        self.table = BucketedTable(spark, root, ["component"], FACES, buckets)

    def clusters(self) -> DataFrame:
        """``face_order, root, cluster`` of all faces."""
        return self.table.read().select("face_order", "root", "cluster")

    def add(self, faces: DataFrame, batch: int) -> int:
        """Add faces (``face_order, embedding, face_quality``); known ones are left alone."""
        return self._change(faces, None, batch)

    def sync(self, faces: DataFrame, batch: int) -> int:
        """Make the store hold exactly these faces: new ones come, others go."""
        return self._change(faces, faces.select("face_order"), batch)

    def _change(self, faces: DataFrame, all_ids: DataFrame | None, batch: int) -> int:
        """Apply one batch; returns how many faces were clustered again."""
        last = self.table.last_batch()
        if last is not None and last >= batch:
            return 0
        old = self.table.read()
        faces = faces.where(F.col("embedding").isNotNull()).select(
            F.col("face_order").cast("long").alias("face_order"), F.col("embedding").cast("array<double>").alias("embedding"), "face_quality"
        )
        new = materialize(faces.dropDuplicates(["face_order"]).join(old.select("face_order"), "face_order", "left_anti"))
        links = self._links(new, old)
        joined = connected_components(links).withColumnRenamed("component", "joined")
        met = links.select(F.col("id_b").alias("component")).join(old.select("component").distinct(), "component", "left_semi")
        kept = old
        if all_ids is not None:
            kept = old.join(all_ids, "face_order", "left_semi")
            met = met.unionByName(old.join(all_ids, "face_order", "left_anti").select("component"))
        met = materialize(met.distinct())
        again = kept.join(met, "component", "left_semi").select("component", "face_order", "embedding", "face_quality")
        again = again.unionByName(new.withColumn("component", F.col("face_order")))
        again = again.join(joined, F.col("component") == F.col("id"), "left")
        again = materialize(again.select(F.coalesce("joined", "component").alias("component"), "face_order", "embedding", "face_quality"))
        solved = cluster_faces(again, self.threshold, self.low_join)
        self.table.upsert(again.join(solved, "face_order"), batch, gone=met)
        return again.count()

    def _links(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """Connections between new faces, and from new faces to stored components."""
        distinct = materialize(collapse_copies(new, "face_order", "embedding"))
        leads = distinct.select(F.col("vec").alias("embedding"), F.col("id").alias("id_a"))
        twins = new.join(leads, "embedding").where("face_order <> id_a").select("id_a", F.col("face_order").alias("id_b"))
        fresh = rep_pairs(distinct, self.threshold, strict=True, single=True).select("id_a", "id_b")
        return materialize(_reached(new, old, self.threshold).unionByName(fresh).unionByName(twins))


def cluster_stream(faces: DataFrame, store: ClusterStore, state: str) -> StreamingQuery:
    """Add every micro-batch of a stream of faces to the store; a repeat changes nothing."""

    def step(batch: DataFrame, batch_id: int) -> None:
        store.add(batch, batch_id)

    return faces.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
