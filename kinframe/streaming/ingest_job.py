"""Incremental ingest: new manifest rows are added and only what a batch touches is clustered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinframe.operators.cluster import LINKAGE_THRESHOLD, recluster_catalog
from kinframe.operators.ingest import APP_QUALITY_FLOOR, ingest
from kinframe.sources.catalog_io import load_catalog, save_catalog
from kinframe.streaming.cluster_store import ClusterStore


def apply_batch(
    catalog: dict[str, DataFrame], manifest: DataFrame, min_quality: float = APP_QUALITY_FLOOR,
    threshold: float = LINKAGE_THRESHOLD, recluster: bool = True, solve=None,
) -> dict[str, DataFrame]:
    """One batch of manifest rows into a catalog.

    A manifest row is a photo with its classified faces:
    ``photo_id, path, content_hash, created_at, faces array<struct<...>>``. ``solve``
    clusters the pool of faces, as in ``recluster_catalog``.
    """
    photos = manifest.drop("faces")
    dets = manifest.select("photo_id", F.explode("faces").alias("f")).select("photo_id", "f.*")
    new_photos, new_faces = ingest(catalog["photos"], catalog["faces"], photos, dets, min_quality)
    out = {**catalog, "photos": new_photos, "faces": new_faces}
    if recluster:
        faces, persons = recluster_catalog(new_photos, new_faces, catalog["persons"], catalog["person_manual"], threshold, solve=solve)
        out |= {"faces": faces, "persons": persons}
    return out


def incremental_ingest(
    manifest: DataFrame, root: str, state: str, min_quality: float = APP_QUALITY_FLOOR, threshold: float = LINKAGE_THRESHOLD
) -> StreamingQuery:
    """Run ``apply_batch`` for every micro-batch of a manifest stream.

    Clusters are kept in a store beside the catalog: a batch compares its new faces with
    the stored ones and clusters only the components they touch. A repeated batch changes
    nothing: its files are known by hash and path, and the store knows its number.
    """
    spark = manifest.sparkSession
    store = ClusterStore(spark, f"{root}/clusters", threshold)

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return

        def solve(pool: DataFrame) -> DataFrame:
            store.sync(pool, batch_id)
            return store.clusters()

        save_catalog(apply_batch(load_catalog(spark, root), batch, min_quality, threshold, solve=solve), root)

    return (
        manifest.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
