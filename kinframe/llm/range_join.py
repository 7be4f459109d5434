"""Exact metric range join of vectors: which lie within a cosine of each other.

Vectors of unit length with ``cosine >= c`` are at most ``r = sqrt(2 - 2c)`` apart. Equal
vectors of one label form one class with a count. Pivots, chosen by hash, partition the
classes of a label: each goes to the cell of its nearest pivot, and a copy goes to every
other cell that can hold a partner. By the triangle inequality a partner in the cell of
``q`` is possible only if ``d(v, q) - d(v, p) <= 2r`` for the own pivot ``p``; among unit
vectors the distance to the plane between the pivots, ``(d(v, q)^2 - d(v, p)^2) /
(2 d(p, q)) <= r``, is sharper, and both are exact. Every cell then counts the links of
its own classes against own and copied ones, independently of all other cells.

A cell with more than ``block`` rows is dealt into blocks that are compared pairwise in
separate tasks, so a dense region never meets in one task. A task returns counts and one
edge per row to the smallest member of its component there, never the links themselves.

The pivots are the only broadcast: at most ``pivot_bytes`` in all, whatever the input.

Rows: vectors without a label or an id, null or empty vectors, zero vectors and vectors
with null or non-finite components link with nothing, nor do vectors of other lengths
with each other. A row without links is its own component; ids that repeat are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.operators.cluster import connected_components
from kinframe.session import materialize

CELL_ROWS = 512
BLOCK_ROWS = 1024
PIVOT_BYTES = 16 << 20
# Distances are widened by this much, so that rounding never drops a copy.
SLACK = 1e-6
ROW = "space string, cell int, own boolean, node long, weight long, k1 long, k2 long, vec array<double>"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _usable(id_col: str, vec_col: str, label_col: str):
    """True for rows that can link: id, label, and a finite vector that is not zero."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & fine


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(space, node, k1, k2, vec)`` of the rows that can link.

    ``space`` is the label with the vector's length; ``k1`` and ``k2`` name the vector.
    Components are scaled by the largest first, so that squares neither vanish nor overflow.
    """
    v = F.transform(vec_col, lambda x: x.cast("double"))
    space = F.concat_ws(":", F.size(vec_col).cast("string"), F.col(label_col).cast("string"))
    rows = vectors.where(_usable(id_col, vec_col, label_col)).select(F.col(id_col).cast("long").alias("node"), v.alias("vec"), space.alias("space"))
    top = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    rows = rows.withColumn("top", top).withColumn("vec", F.transform("vec", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    keys = [F.xxhash64("space", "vec").alias("k1"), F.xxhash64("vec", F.lit(7)).alias("k2")]
    return rows.select("space", "node", *keys, F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))


def _pivots(nodes: DataFrame, cell_rows: int, pivot_bytes: int) -> dict[str, np.ndarray]:
    """Pivots by space: a bounded number, spread over the spaces by their sizes."""
    n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    most = max(1, pivot_bytes // (8 * (width or 1)))
    cell_rows = max(cell_rows, -(-n // most))
    chosen = nodes.where(F.pmod(F.xxhash64("k1", F.lit(11)), F.lit(cell_rows)) == 0).orderBy("k1", "k2").limit(most)
    out: dict[str, list] = {}
    for r in chosen.select("space", "vec").collect():
        out.setdefault(r["space"], []).append(r["vec"])
    return {k: np.array(v) for k, v in out.items()}


def cells(nodes: DataFrame, pivots: dict[str, np.ndarray], radius: float) -> DataFrame:
    """Every class in its own cell, and copies in the cells that may hold a partner."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            space = np.array(batch.column("space").to_pylist(), object)
            for name in dict.fromkeys(space):
                at = np.flatnonzero(space == name)
                part = batch.take(pa.array(at))
                known = shared.value.get(name)
                if known is None or len(known) < 2:
                    yield dealt(part, np.arange(len(at)), np.zeros(len(at), int), np.ones(len(at), bool))
                    continue
                for a in range(0, len(at), 1024):
                    some = part.slice(a, 1024)
                    v = _matrix(some.column("vec"), some.num_rows)
                    square = np.maximum(2 - 2 * (v @ known.T), 0)
                    home = square.argmin(1)
                    near = square[np.arange(len(v)), home][:, None]
                    apart = np.sqrt(np.maximum(2 - 2 * (known @ known.T), 0))[home]
                    plane = (square - near) <= 2 * apart * (radius + SLACK) + SLACK
                    triangle = np.sqrt(square) - np.sqrt(near) <= 2 * radius + SLACK
                    keep = plane & triangle
                    keep[np.arange(len(v)), home] = True
                    row, cell = np.nonzero(keep)
                    for b in range(0, len(row), 8192):
                        yield dealt(some, row[b : b + 8192], cell[b : b + 8192], cell[b : b + 8192] == home[row[b : b + 8192]])

    def dealt(part, row, cell, own):
        p = part.take(pa.array(row))
        return pa.RecordBatch.from_arrays([p.column("space"), pa.array(cell.astype(np.int32)), pa.array(own), *(p.column(c) for c in ("node", "weight", "k1", "k2", "vec"))], ["space", "cell", "own", "node", "weight", "k1", "k2", "vec"])

    return nodes.select("space", "node", "weight", "k1", "k2", "vec").mapInArrow(run, ROW)


def _joined(cosine: float):
    """Counts and component edges of one pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy()
        left, right = table.filter(pa.array(side)), table.filter(pa.array(~side))
        empty = pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        col = lambda t, c: t.column(c).to_numpy()
        x, y = (_matrix(t.column("vec").combine_chunks(), t.num_rows) for t in (left, right))
        same = (col(left, "k1")[:, None] == col(right, "k1")) & (col(left, "k2")[:, None] == col(right, "k2"))
        a, b = np.nonzero((x @ y.T >= cosine) & ~same)
        n = np.bincount(a, col(right, "weight")[b], left.num_rows).astype(np.int64)
        la, lb = col(left, "node").copy(), col(right, "node").copy()
        while True:
            before = la.copy(), lb.copy()
            np.minimum.at(la, a, lb[b])
            np.minimum.at(lb, b, la[a])
            if (before[0] == la).all() and (before[1] == lb).all():
                break
        used = np.unique(b)
        rest = right.take(pa.array(used))
        return pa.table(
            {
                "k1": pa.concat_arrays([left.column("k1").combine_chunks(), rest.column("k1").combine_chunks()]),
                "k2": pa.concat_arrays([left.column("k2").combine_chunks(), rest.column("k2").combine_chunks()]),
                "node": pa.array(np.concatenate([col(left, "node"), col(rest, "node")])),
                "low": pa.array(np.concatenate([la, lb[used]])),
                "n": pa.array(np.concatenate([n, np.zeros(len(used), np.int64)])),
            }
        )

    return run


def range_join(
    vectors: DataFrame,
    cosine: float,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cell_rows: int = CELL_ROWS,
    block: int = BLOCK_ROWS,
    pivot_bytes: int = PIVOT_BYTES,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``."""
    rows = unit_vectors(vectors, id_col, vec_col, label_col)
    nodes = materialize(rows.groupBy("space", "k1", "k2").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec")))
    radius = float(np.sqrt(2 - 2 * cosine))
    spread = materialize(cells(nodes, _pivots(nodes, cell_rows, pivot_bytes), radius))
    sizes = spread.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("rows"), F.count_if("own").alias("owned"))
    large = sizes.select("space", "cell", F.ceil(F.col("rows") / block).cast("int").alias("nr"), F.ceil(F.col("owned") / block).cast("int").alias("nl"))
    placed = spread.join(large, ["space", "cell"])
    mine = lambda n: F.pmod(F.xxhash64("k1", F.lit(3)), n).cast("int")
    keep = ["space", "cell", "node", "weight", "k1", "k2", "vec"]
    left = placed.where("own").select(*keep, F.lit(True).alias("left"), mine(F.col("nl")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"))
    right = placed.where("nl > 0").select(*keep, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), mine(F.col("nr")).alias("j"))
    met = left.unionByName(right).groupBy("space", "cell", "i", "j").applyInArrow(_joined(cosine), "k1 long, k2 long, node long, low long, n long")
    met = materialize(met)
    counts = met.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    comps = connected_components(met.where("node <> low").select("node", "low"), "node", "low")
    info = nodes.select("k1", "k2", "node", "weight").join(counts, ["k1", "k2"], "left").join(comps.withColumnRenamed("id", "node"), "node", "left")
    info = info.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    usable = rows.select("node", "k1", "k2").join(info, ["k1", "k2"]).select(F.col("node").alias("vec_id"), "n_links", "component_id")
    own = F.col(id_col).cast("long")
    alone = vectors.where(~_usable(id_col, vec_col, label_col)).select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    return usable.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
