"""Clusterings at many thresholds from one comparison of all faces.

Similarities between cluster roots never change, and root linkage merges in falling order
of them. A clustering at a higher threshold is therefore a prefix of the merges at the
lowest one: the merges form a forest, each root that is absorbed points to the one that
took it in with the similarity of that merge, similarities fall along every path, and
cutting the links at or below a threshold leaves the roots of that threshold.

Vectors are compared once, at the lowest threshold and without regard to quality tiers.
Tier rules only remove edges, so every rule set derives its edges from that table, and
each rule set has one forest for all its thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.functions.vectors import norm
from kinframe.operators.cluster import (
    EDGES_PER_FACE,
    LOCAL_EDGES,
    LOW_JOIN,
    LOW_TIERS,
    connected_components,
    foreseen,
    merge_steps,
    solve_rounds,
)
from kinframe.operators.pairs import BLOCK_ROWS, rep_pairs
from kinframe.session import materialize

LINKS = T.StructType([T.StructField("id", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("sim", T.DoubleType())])


class MergeForest:
    """Faces of one table, compared once; forests and cuts for any tier rules.

    ``faces`` has ``face_order`` (unique long), ``embedding`` and ``face_quality``.
    Thresholds of cuts must not lie below ``lowest``.
    """

    def __init__(self, faces: DataFrame, lowest: float, block_rows: int | None = BLOCK_ROWS, local_edges: int = LOCAL_EDGES, edges_per_face: int = EDGES_PER_FACE):
        self.lowest, self.block_rows, self.local_edges = lowest, block_rows, local_edges
        base = faces.where(F.col("embedding").isNotNull()).select(
            F.col("face_order").cast("long").alias("id"), F.col("embedding").alias("vec"), F.coalesce(F.col("face_quality").isin(*LOW_TIERS), F.lit(False)).alias("low")
        )
        groups = base.groupBy("vec").agg(F.min(F.struct("id", "low")).alias("lead"))
        placed = base.join(groups, "vec")
        # A vector without length is similar to nothing, not even to itself.
        alone = norm("vec") == 0
        self.members = materialize(
            placed.select(
                "id", "low", F.when(alone, F.col("id")).otherwise(F.col("lead.id")).alias("rep"),
                F.when(alone, F.col("low")).otherwise(F.col("lead.low")).alias("lead_low"),
            )
        )
        self.vectors = materialize(base.select("id", "vec").join(self.members.where("id = rep").select("id"), "id"))
        n = self.vectors.count()
        # A pair list that would dwarf the faces is never written; rounds need none.
        limit, plain = edges_per_face * max(n, 1), self.vectors.withColumn("low", F.lit(False))
        self.sparse = n * (n - 1) // 2 <= limit or foreseen(plain, lowest, LOW_JOIN)[0] <= limit
        self.edges = materialize(rep_pairs(self.vectors, lowest, True, True, block_rows)) if self.sparse else None

    def _nodes(self, gated: bool) -> tuple[DataFrame, DataFrame]:
        """Faces with their node, and nodes with size and tier, under the tier rules.

        Faces of one vector are one node; with tier rules, low faces stay apart where the
        first face of that vector is low as well.
        """
        low = F.col("low") if gated else F.lit(False)
        lead = F.col("lead_low") if gated else F.lit(False)
        faces = self.members.select("id", "rep", lead.alias("lead_low"), F.when(low & lead & (F.col("id") != F.col("rep")), F.col("id")).otherwise(F.col("rep")).alias("node"))
        nodes = faces.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.first("rep").alias("rep"), F.first("lead_low").alias("low"))
        return faces.select("id", "node"), materialize(nodes.withColumnRenamed("node", "id"))

    def _edges(self, nodes: DataFrame, gated: bool, low_join: float) -> DataFrame:
        """The compared pairs that the tier rules allow, between nodes."""
        if not gated:
            return self.edges
        tier = nodes.where("id = rep").select("id", "low")
        tagged = (
            self.edges.join(tier.select(F.col("id").alias("id_a"), F.col("low").alias("low_a")), "id_a")
            .join(tier.select(F.col("id").alias("id_b"), F.col("low").alias("low_b")), "id_b")
            .where(~(F.col("low_a") & F.col("low_b")) & ((F.col("sim") >= low_join) | ~(F.col("low_a") | F.col("low_b"))))
        )
        # Low copies of a low vector meet what their vector meets.
        apart = nodes.where("id <> rep").select("id", F.col("rep").alias("twin"))
        copies = [
            tagged.where(f"low_{own}").join(apart, F.col("twin") == F.col(f"id_{own}"))
            .select(F.least("id", f"id_{other}").alias("id_a"), F.greatest("id", f"id_{other}").alias("id_b"), "sim")
            for own, other in (("a", "b"), ("b", "a"))
        ]
        return tagged.select("id_a", "id_b", "sim").unionByName(copies[0]).unionByName(copies[1])

    def links(self, gated: bool = True, low_join: float = LOW_JOIN) -> tuple[DataFrame, DataFrame]:
        """``(id, node)`` of all faces and the forest ``(id, parent, sim)`` of their nodes."""
        faces, nodes = self._nodes(gated)
        if not self.sparse:
            return faces, self._by_rounds(nodes, low_join)
        edges = materialize(self._edges(nodes, gated, low_join))
        parts = connected_components(edges)
        tagged = edges.join(parts.withColumnRenamed("id", "id_a"), "id_a")
        placed = nodes.join(parts, "id").select("id", "size", "rep", "low", "component")
        sizes = materialize(tagged.groupBy("component").agg(F.count(F.lit(1)).alias("edges")))
        big = sizes.where(F.col("edges") > self.local_edges).select("component")
        total = sizes.agg(F.coalesce(F.sum("edges"), F.lit(0))).first()[0]
        if big.isEmpty():
            return faces, materialize(_small_trees(tagged, placed, total))
        small = _small_trees(tagged.join(big, "component", "left_anti"), placed.join(big, "component", "left_anti"), total)
        hard = placed.join(big, "component", "left_semi").select("id", "size", "rep", "low")
        return faces, materialize(small.unionByName(self._by_rounds(hard, low_join)))

    def _by_rounds(self, nodes: DataFrame, low_join: float) -> DataFrame:
        vectors = self.vectors.withColumnRenamed("id", "rep")
        rows = materialize(nodes.join(vectors, "rep").select("id", "vec", "low", "size", F.col("id").alias("first")))
        steps: list[DataFrame] = []
        solve_rounds(rows, self.lowest, low_join, self.block_rows, steps)
        out = self.vectors.sparkSession.createDataFrame([], LINKS)
        for step in steps:
            out = out.unionByName(step)
        return out

    def cuts(self, thresholds: Sequence[float], gated: bool = True, low_join: float = LOW_JOIN) -> DataFrame:
        """``(threshold, face_order, root, cluster)`` for every threshold, from one forest."""
        wanted = sorted({float(t) for t in thresholds})
        if wanted and wanted[0] < self.lowest:
            raise ValueError(f"{wanted[0]} lies below the compared threshold {self.lowest}")
        faces, links = self.links(gated, low_join)
        levels = F.explode(F.array(*[F.lit(t) for t in wanted])).alias("threshold")
        up = links.select("id", F.col("parent").alias("root"), "sim", levels).where("sim > threshold").select("threshold", "id", "root")
        up = materialize(up)
        while True:
            onward = up.select("threshold", F.col("id").alias("root"), F.col("root").alias("next"))
            moved = up.join(onward, ["threshold", "root"], "left").select("threshold", "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            moved = materialize(moved)
            up = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        rows = faces.select(F.col("id").alias("face_order"), "node", levels)
        roots = rows.join(up.withColumnRenamed("id", "node"), ["threshold", "node"], "left").select("threshold", "face_order", F.coalesce("root", "node").alias("root"))
        roots = materialize(roots)
        lowest = roots.groupBy("threshold", "root").agg(F.min("face_order").alias("cluster"))
        return roots.join(lowest, ["threshold", "root"]).select("threshold", "face_order", "root", "cluster")


def _small_trees(edges: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """The merges of many small components per task."""
    packs = max(1, total // LOCAL_EDGES + 1) * 8
    pack = F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack")

    def run(edge_table, node_table):
        sizes = dict(zip(node_table.column("id").to_pylist(), node_table.column("size").to_pylist()))
        steps = merge_steps(sizes, list(zip(*[edge_table.column(c).to_pylist() for c in ("sim", "id_a", "id_b")])))
        return pa.table({"id": pa.array(list(steps), pa.int64()), "parent": pa.array([p for p, _ in steps.values()], pa.int64()), "sim": pa.array([s for _, s in steps.values()], pa.float64())})

    left = edges.select(pack, "id_a", "id_b", "sim")
    return left.groupBy("pack").cogroup(nodes.select(pack, "id", "size").groupBy("pack")).applyInArrow(run, LINKS)
