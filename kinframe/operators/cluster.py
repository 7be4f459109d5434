"""Clustering of face vectors into persons.

``cluster_faces`` reproduces a sequential agglomeration in which the similarity of two
clusters is the similarity of their root faces. Root similarities never change, so
merges that are each other's best choice commute and can be done together.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinframe.functions.vectors import centroids, norm
from kinframe.operators.catalog import live
from kinframe.operators.pairs import (
    ANGLE_SLACK,
    BLOCK_ROWS,
    SMALL_SIDE,
    Side,
    arrow_table,
    block_pairs,
    collapse_copies,
    column_values,
    copy_members,
    pairs_near,
    similar_pairs,
    single_precision,
    tiles,
    to_matrix,
    unit_rows,
)
from kinframe.operators.ranking import rank_in_group
from kinframe.session import checkpoint_root, materialize, release

# Linkage cut-off, and the similarity a low-tier face needs to join.
LINKAGE_THRESHOLD = 0.45
LOW_JOIN = 0.6
LOW_LOW_JOIN = 0.65
LOW_TIERS = ("low", "very_low")

# Components up to this many edges are solved inside one task, packed together; larger
# ones go through distributed rounds. Edge lists denser than EDGES_PER_FACE are never
# written out at all.
LOCAL_EDGES = 100_000
EDGES_PER_FACE = 200
SURE_EDGES = 5_000_000
# The best edges that one task merges at a time, and how finely their similarities are counted.
BAND_EDGES = 1_000_000
BAND_BINS = 4096
# Rows whose partners are counted to foresee how many edges lie over a similarity.
SAMPLE_NODES = 2048
# Sorted edges that one task decides at a time in the greedy pass, and those it compares at once.
SLICE_EDGES = 1_000_000
SLICE_BLOCK = 4096
# Edges that the greedy pass lists at a time; from how many clusters on it tells pairs of them
# apart, and how far below the threshold their centroids may lie for all their edges to be listed.
GREEDY_EDGES = 4_000_000
FIRST_EDGES = 8
LOCAL_CLUSTERS = 4096
NEAR_MARGIN = 0.05
# Faces that running-average clustering compares with all centroids at once.
LEADER_BLOCK = 256
# Person centroids whose remaining merges one task does: a table of at most 128 MB.
LOCAL_REPS = 4096


# ------------------------------------------------------------------ connected components


def _contract(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: every node linked to its local minimum."""

    def run(batches):
        parent: dict = {}

        def root(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                ru, rv = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                if ru != rv:
                    parent[max(ru, rv)] = min(ru, rv)
        links = [(n, root(n)) for n in parent]
        links = [x for x in links if x[0] != x[1]]
        for at in range(0, len(links), 100_000):
            part = links[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in part], kind), pa.array([x[1] for x in part], kind)], ["u", "v"]
            )

    kind = to_arrow_type(edges.schema["u"].dataType)
    return edges.mapInArrow(run, edges.schema)


def _settled(edges: DataFrame) -> bool:
    """True when every node has one parent and no parent has a parent."""
    parents = edges.select(F.col("v").alias("u")).distinct()
    chained = edges.join(parents, "u", "left_semi").select("u")
    split = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    return chained.unionByName(split).isEmpty()


def connected_components(edges: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """``(id, component)`` with the smallest member id as the component.

    Edges are first contracted inside their partitions. What is left alternates the
    large-star and small-star steps, in which every node above its smallest neighbour is
    re-linked to it, until all edges point at component minima. Each step is a partial
    aggregate and a lookup join. As soon as at most ``LOCAL_EDGES`` edges are left, one
    task contracts them: that many rows are a few megabytes, far below any task's share.
    """
    e = materialize(
        _contract(
            edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        ).distinct()
    )
    while True:
        if e.count() <= LOCAL_EDGES:
            e = materialize(_contract(e.coalesce(1)))
            break
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        e = materialize(_contract(small).distinct())
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


# ------------------------------------------------------------------ root linkage


def _nodes(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starting clusters, and which face is already part of which one.

    Faces with the same vector merge before anything else, the first of them keeping the
    root: all join it, except low-tier faces when that first face is low-tier as well. A
    vector without length is similar to nothing, not even to itself.
    """
    base = faces.where(F.col("embedding").isNotNull()).select(
        F.col("face_order").alias("id"),
        F.col("embedding").alias("vec"),
        F.col("face_quality").isin(*LOW_TIERS).alias("low"),
    )
    groups = base.groupBy("vec").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "low")).alias("lead")
    )
    shared = materialize(
        groups.where((F.col("n") > 1) & (norm("vec") > 0)).select(
            "vec", F.col("lead.id").alias("lead_id"), F.col("lead.low").alias("lead_low")
        )
    )
    if shared.isEmpty():
        nodes = base.select("id", "vec", "low", F.lit(1).cast("long").alias("size"), F.col("id").alias("first"))
        return materialize(nodes), base.select("id", F.col("id").alias("node"))
    placed = base.join(shared, "vec", "left").select(
        "id", "vec", "low",
        F.when(
            F.col("lead_id").isNull() | (F.col("low") & F.col("lead_low")), F.col("id")
        ).otherwise(F.col("lead_id")).alias("node"),
    )
    placed = materialize(placed)
    sizes = placed.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    nodes = placed.where("id = node").select("id", "vec", "low").join(sizes, "id")
    return materialize(nodes.withColumn("first", F.col("id"))), placed.select("id", "node")


def _allowed(s: np.ndarray, low_a: np.ndarray, low_b: np.ndarray, threshold: float, low_join: float) -> np.ndarray:
    """Pairs that may merge: over the threshold, strong when one side is low, never both low."""
    low_a, low_b = low_a.astype(bool)[:, None], low_b.astype(bool)[None, :]
    return (s > threshold) & ~(low_a & low_b) & ((s >= low_join) | ~(low_a | low_b))


def _gated_hits(a: Side, b: Side, same: bool, threshold: float, low_join: float):
    """Rows, columns and similarities of the pairs that may merge, tile by tile."""
    for i, j, s in pairs_near(a, b, threshold - ANGLE_SLACK):
        s = single_precision(s)
        low = a.attr["low"][i].astype(np.int8) + b.attr["low"][j].astype(np.int8)
        hit = (s > threshold) & ((low == 0) | ((low == 1) & (s >= low_join)))
        if same:
            hit &= i < j
        yield i[hit], j[hit], s[hit]


def _gated_edges(nodes: DataFrame, threshold: float, low_join: float, block_rows: int | None, count_only: bool) -> DataFrame:
    if count_only:
        schema = T.StructType([T.StructField("edges", T.LongType())])
    else:
        schema = T.StructType(
            [T.StructField("id_a", T.LongType()), T.StructField("id_b", T.LongType()), T.StructField("sim", T.DoubleType())]
        )

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        found = []
        for i, j, s in _gated_hits(a, b, same, threshold, low_join):
            if count_only:
                found.append(len(i))
            else:
                x, y = a.attr["id"][i], b.attr["id"][j]
                found.append((np.minimum(x, y), np.maximum(x, y), s))
        if count_only:
            return pa.table({"edges": pa.array([sum(found)], pa.int64())})
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3)]
        return pa.table(
            {
                "id_a": pa.array(columns[0].astype(np.int64)),
                "id_b": pa.array(columns[1].astype(np.int64)),
                "sim": pa.array(columns[2], pa.float64()),
            }
        )

    return block_pairs(nodes.select("id", "vec", "low"), None, reduce, schema, threshold, block_rows)


def merge_steps(sizes: dict, edges: list[tuple], firsts: dict | None = None) -> dict:
    """The merges of one component: ``{absorbed root: (root that took it in, similarity)}``.

    ``sizes`` maps node to its starting size, ``firsts`` to its first member, which is the
    node itself unless given; ``edges`` are ``(sim, a, b)``. The best edge between two live
    roots merges them; ties go to the smaller first members. The larger cluster keeps its
    root, then the one with the smaller first member.
    """
    size, first = dict(sizes), dict(firsts) if firsts else {n: n for n in sizes}
    around: dict = {n: [] for n in sizes}
    for s, a, b in edges:
        around[a].append((s, b))
        around[b].append((s, a))

    def entry(s, a, b):
        lo, hi = (a, b) if first[a] < first[b] else (b, a)
        return (-s, first[lo], first[hi], lo, hi)

    heap = [entry(*e) for e in edges]
    heapq.heapify(heap)
    steps: dict = {}
    while heap:
        item = heapq.heappop(heap)
        minus_s, f_lo, f_hi, lo, hi = item
        if lo in steps or hi in steps or first[lo] != f_lo or first[hi] != f_hi:
            continue
        keep, gone = (lo, hi) if size[lo] >= size[hi] else (hi, lo)
        steps[gone] = keep, -minus_s
        size[keep] += size[gone]
        if first[gone] < first[keep]:
            first[keep] = first[gone]
            for s, other in around[keep]:
                if other not in steps:
                    heapq.heappush(heap, entry(s, keep, other))
    return steps


def merge_by_root(sizes: dict, edges: list[tuple]) -> dict:
    """Agglomerate one component: ``{node: root}``."""
    steps = merge_steps(sizes, edges)

    def root(n):
        while n in steps:
            n = steps[n][0]
        return n

    return {n: root(n) for n in sizes}


def _solve_small(edges: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Agglomerate many small components per task: ``(id, root)``."""
    packs = max(1, total // LOCAL_EDGES + 1) * 8
    pack = F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("root", T.LongType())])

    def run(edge_table, node_table):
        sizes = dict(zip(node_table.column("id").to_pylist(), node_table.column("size").to_pylist()))
        rows = list(zip(*[edge_table.column(c).to_pylist() for c in ("sim", "id_a", "id_b")]))
        roots = merge_by_root(sizes, rows)
        return pa.table({"id": pa.array(list(roots), pa.int64()), "root": pa.array(list(roots.values()), pa.int64())})

    left = edges.select(pack, "id_a", "id_b", "sim")
    right = nodes.select(pack, "id", "size")
    return left.groupBy("pack").cogroup(right.groupBy("pack")).applyInArrow(run, schema)


def _sorted_side(side: Side, by: str = "first") -> Side:
    order = np.argsort(side.attr[by], kind="stable")
    side.units = side.units[order]
    side.attr = side.rows(order)
    return side


def _best_partner(live_nodes: DataFrame, threshold: float, low_join: float, block_rows: int | None) -> DataFrame:
    """Each root's best allowed partner: highest similarity, then smallest first member."""
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("sim", T.DoubleType()),
            T.StructField("other_first", T.LongType()),
            T.StructField("other", T.LongType()),
        ]
    )

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        a = _sorted_side(a)
        b = a if same else _sorted_side(b)
        row_s, row_at = np.full(len(a), -2.0), np.zeros(len(a), np.int64)
        col_s, col_at = np.full(len(b), -2.0), np.zeros(len(b), np.int64)
        for start, stop, s in tiles(a, b):
            s = single_precision(s)
            ok = _allowed(s, a.attr["low"][start:stop], b.attr["low"], threshold, low_join)
            if same:
                ok[np.arange(stop - start), np.arange(start, stop)] = False
            s = np.where(ok, s, -2.0)
            # Columns are ordered by first member, so the first maximum settles ties.
            row_at[start:stop] = s.argmax(axis=1)
            row_s[start:stop] = s.max(axis=1)
            at = s.argmax(axis=0)
            top = s[at, np.arange(len(b))]
            better = top > col_s
            col_s[better], col_at[better] = top[better], at[better] + start
        parts = [_best_rows(a, b, row_s, row_at)]
        if not same:
            parts.append(_best_rows(b, a, col_s, col_at))
        return pa.concat_tables(parts)

    found = block_pairs(
        live_nodes.select("id", "vec", "low", "first"), None, reduce, schema, threshold, block_rows
    )
    best = found.groupBy("id").agg(
        F.max(F.struct("sim", (-F.col("other_first")).alias("f"), "other")).alias("m")
    )
    return best.select(
        "id", F.col("m.sim").alias("sim"), (-F.col("m.f")).alias("partner_first"), F.col("m.other").alias("partner")
    )


def _best_rows(own: Side, other: Side, s: np.ndarray, at: np.ndarray) -> pa.Table:
    has = s > -2.0
    at = at[has]
    return pa.table(
        {
            "id": pa.array(own.attr["id"][has].astype(np.int64)),
            "sim": pa.array(s[has]),
            "other_first": pa.array(other.attr["first"][at].astype(np.int64)),
            "other": pa.array(other.attr["id"][at].astype(np.int64)),
        }
    )


def _first_obstacle(state: DataFrame, threshold: float, low_join: float, block_rows: int | None) -> DataFrame:
    """For each merge centre, its best edge to a root it may not absorb this round.

    Such a root prefers someone else or is larger; edges below it have to wait.
    """
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("sim", T.DoubleType()), T.StructField("neg_first", T.LongType())]
    )

    def rows(own: Side, other: Side, s: np.ndarray, own_slice) -> list:
        centre = own.attr["centre"][own_slice].astype(bool)
        if not centre.any():
            return []
        ids = own.attr["id"][own_slice][centre]
        sizes = own.attr["size"][own_slice][centre]
        blocked = (other.attr["partner"][None, :] != ids[:, None]) | (other.attr["size"][None, :] > sizes[:, None])
        masked = np.where(blocked, s[centre], -2.0)
        at, top = masked.argmax(axis=1), masked.max(axis=1)
        has = top > -2.0
        return [(ids[has], top[has], -other.attr["first"][at[has]])]

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        a = _sorted_side(a)
        b = a if same else _sorted_side(b)
        out: list = []
        for start, stop, s in tiles(a, b):
            s = single_precision(s)
            ok = _allowed(s, a.attr["low"][start:stop], b.attr["low"], threshold, low_join)
            if same:
                ok[np.arange(stop - start), np.arange(start, stop)] = False
            s = np.where(ok, s, -2.0)
            out += rows(a, b, s, slice(start, stop))
            if not same:
                part = Side.__new__(Side)
                part.units, part.attr = a.units[start:stop], a.rows(slice(start, stop))
                out += rows(b, part, s.T, slice(None))
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3)]
        return pa.table(
            {
                "id": pa.array(columns[0].astype(np.int64)),
                "sim": pa.array(columns[1], pa.float64()),
                "neg_first": pa.array(columns[2].astype(np.int64)),
            }
        )

    found = block_pairs(
        state.select("id", "vec", "low", "first", "size", "partner", "centre"), None, reduce, schema, threshold, block_rows
    )
    return found.groupBy("id").agg(F.max(F.struct("sim", "neg_first")).alias("stop"))


def _bins(threshold: float) -> np.ndarray:
    """Lower edges of the bins of similarities over a threshold."""
    return threshold + (1.0 - threshold) * np.arange(BAND_BINS) / BAND_BINS


def _binned(threshold: float, low_join: float):
    """A reducer that counts allowed pairs per bin, a row with itself left out, and its schema."""
    # A bin holds what lies over its edge and not over the next one, as an edge list would.
    edges = _bins(threshold)

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        total = np.zeros(BAND_BINS, np.int64)
        for i, j, s in _gated_hits(a, b, same, threshold, low_join):
            s = s[a.attr["id"][i] != b.attr["id"][j]]
            total += np.bincount(np.searchsorted(edges, s, side="left") - 1, minlength=BAND_BINS)
        at = np.nonzero(total)[0]
        return pa.table({"bin": pa.array(at.astype(np.int32)), "edges": pa.array(total[at])})

    return reduce, T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("edges", T.LongType())])


def _above(counts: DataFrame) -> np.ndarray:
    """How many edges lie over the lower edge of every bin."""
    total = np.zeros(BAND_BINS)
    for r in counts.groupBy("bin").agg(F.sum("edges").alias("edges")).collect():
        total[r["bin"]] = r["edges"]
    return total[::-1].cumsum()[::-1]


def foreseen(alive: DataFrame, threshold: float, low_join: float) -> np.ndarray:
    """About how many edges lie over each bin's lower edge, from the partners of some roots.

    A fixed, hash-chosen set of roots meets all others where they lie, so this is linear.
    """
    reduce, schema = _binned(threshold, low_join)
    rows = alive.select("id", "vec", "low")
    chosen, n = rows.orderBy(F.xxhash64("id")).limit(SAMPLE_NODES), alive.count()
    return _above(block_pairs(chosen, rows, reduce, schema, threshold)) * (n / (2 * max(1, min(n, SAMPLE_NODES))))


def _cut_of(above: np.ndarray, threshold: float, band_edges: int) -> float | None:
    """The lowest edge of a bin over which at most ``band_edges`` edges lie; none if there are none over it."""
    if above[0] <= band_edges:
        return threshold
    fits = int(np.argmax(above <= band_edges)) if above[-1] <= band_edges else -1
    return float(_bins(threshold)[fits]) if fits >= 0 and above[fits] else None


def _next_cut(alive: DataFrame, threshold: float, low_join: float, block_rows: int | None, band_edges: int) -> float | None:
    """The lowest similarity above which at most ``band_edges`` edges lie; none if even the top bin has more."""
    reduce, schema = _binned(threshold, low_join)
    return _cut_of(_above(block_pairs(alive.select("id", "vec", "low"), None, reduce, schema, threshold, block_rows)), threshold, band_edges)


def _best_edges(alive: DataFrame, threshold: float, low_join: float, block_rows: int | None, band_edges: int) -> tuple[DataFrame | None, float | None]:
    """At most ``band_edges`` of the best edges, and the similarity over which they are all.

    The cut is foreseen from some roots and the edges over it are listed with one comparison.
    Where they are more than fit, the cut is raised among them; where there are none, or too
    many for any cut, the edges are counted exactly by a comparison of their own.
    """
    n = alive.count()
    if n * (n - 1) // 2 <= band_edges:
        return materialize(_gated_edges(alive, threshold, low_join, block_rows, False)), threshold
    cut = _cut_of(foreseen(alive, threshold, low_join), threshold, int(0.9 * band_edges))
    if cut is not None:
        edges = materialize(_gated_edges(alive, cut, low_join, block_rows, False))
        found = edges.count()
        if found > band_edges:
            width = (1.0 - threshold) / BAND_BINS
            counts = edges.groupBy(F.greatest(F.lit(0), F.ceil((F.col("sim") - threshold) / width) - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("edges"))
            # A bin of room for rounding: what is kept is what lies over the cut.
            cut = _cut_of(_above(counts), threshold, int(0.9 * band_edges))
            edges = None if cut is None else edges.where(F.col("sim") > cut)
            found = 0 if edges is None else edges.count()
        if 0 < found <= band_edges or (cut == threshold and not found):
            return edges, cut
    cut = _next_cut(alive, threshold, low_join, block_rows, band_edges)
    return (None, None) if cut is None else (materialize(_gated_edges(alive, cut, low_join, block_rows, False)), cut)


def _merge_band(edges: DataFrame, alive: DataFrame) -> DataFrame:
    """The merges along at most ``BAND_EDGES`` edges, in one task: ``(id, parent, sim, into)``."""
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("sim", T.DoubleType()), T.StructField("into", T.LongType())]
    )

    def run(edge_table, node_table):
        ids = node_table.column("id").to_pylist()
        sizes, firsts = (dict(zip(ids, node_table.column(c).to_pylist())) for c in ("size", "first"))
        steps = merge_steps(sizes, list(zip(*[edge_table.column(c).to_pylist() for c in ("sim", "id_a", "id_b")])), firsts)
        into: dict = {}
        # A root that is absorbed late is met before those it had taken in.
        for gone in reversed(list(steps)):
            into[gone] = into.get(steps[gone][0], steps[gone][0])
        columns = [list(steps), [p for p, _ in steps.values()], [s for _, s in steps.values()], [into[n] for n in steps]]
        return pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(schema, columns)})

    ends = edges.select(F.col("id_a").alias("id")).unionByName(edges.select(F.col("id_b").alias("id"))).distinct()
    touched = alive.join(ends, "id", "left_semi").select("id", "size", "first")
    one = F.lit(0).alias("pack")
    return edges.select(one, "id_a", "id_b", "sim").groupBy("pack").cogroup(touched.select(one, "*").groupBy("pack")).applyInArrow(run, schema)


def _merged(alive: DataFrame, gone: DataFrame) -> DataFrame:
    """The live roots after ``gone(id, into, size, first)`` has joined them."""
    gains = gone.groupBy(F.col("into").alias("id")).agg(F.sum("size").alias("gain"), F.min("first").alias("gain_first"))
    return materialize(
        alive.join(gone.select("id"), "id", "left_anti")
        .join(gains, "id", "left")
        .select(
            "id", "vec", "low",
            (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"),
            F.least("first", F.coalesce("gain_first", "first")).alias("first"),
        )
    )


def solve_rounds(
    nodes: DataFrame, threshold: float, low_join: float, block_rows: int | None, steps: list[DataFrame] | None = None, band_edges: int | None = None
) -> DataFrame:
    """Agglomerate without an edge list: ``(id, root)``.

    Similarities of roots never change, so only edges over some similarity decide the merges
    over it. Each round lists the best edges, at most ``band_edges`` of them, and merges along
    them in one task; roots that are gone take all their lower edges with them. Where so many
    edges are level that they would not fit, a round has every root look up its best partner
    with one blocked comparison instead. Mutual best pairs merge; the survivor also takes in,
    best first, every root that prefers it, up to the first edge that has to wait. Memory and
    shuffles follow the live roots. ``steps`` collects the merges ``(id, parent, sim)``.
    """
    alive = nodes
    assign = nodes.select("id", F.col("id").alias("root"))
    while True:
        edges, cut = _best_edges(alive, threshold, low_join, block_rows, BAND_EDGES if band_edges is None else band_edges)
        if cut is not None:
            found = materialize(_merge_band(edges, alive))
            if steps is not None:
                steps.append(found.select("id", "parent", "sim"))
            assign = materialize(
                assign.join(found.select(F.col("id").alias("root"), "into"), "root", "left").select("id", F.coalesce("into", "root").alias("root"))
            )
            if cut <= threshold:
                return assign
            alive = _merged(alive, found.join(alive.select("id", "size", "first"), "id"))
            continue
        best = materialize(_best_partner(alive, threshold, low_join, block_rows))
        if best.isEmpty():
            return assign
        state = alive.join(best, "id")
        other = state.select(
            F.col("id").alias("partner"),
            F.col("partner").alias("back"),
            F.col("size").alias("partner_size"),
            F.col("first").alias("now_first"),
        )
        wins = (F.col("size") > F.col("partner_size")) | (
            (F.col("size") == F.col("partner_size")) & (F.col("first") < F.col("now_first"))
        )
        state = materialize(
            state.join(other, "partner")
            .withColumn("centre", (F.col("back") == F.col("id")) & wins)
            .select("id", "vec", "low", "size", "first", "sim", "partner", "centre")
        )
        stops = _first_obstacle(state, threshold, low_join, block_rows)
        centres = state.where("centre").select(F.col("id").alias("partner")).join(
            stops.withColumnRenamed("id", "partner"), "partner", "left"
        )
        mine = F.struct(F.col("sim").alias("sim"), (-F.col("first")).alias("neg_first"))
        gone = materialize(
            state.join(centres, "partner")
            .where(F.col("stop").isNull() | (mine > F.col("stop")))
            .select("id", F.col("partner").alias("into"), "size", "first", "sim")
        )
        if steps is not None:
            steps.append(gone.select("id", F.col("into").alias("parent"), "sim"))
        alive = _merged(state, gone)
        moved = gone.select(F.col("id").alias("root"), "into")
        assign = materialize(
            assign.join(moved, "root", "left").select("id", F.coalesce("into", "root").alias("root"))
        )


def cluster_faces(
    faces: DataFrame,
    threshold: float = LINKAGE_THRESHOLD,
    low_join: float = LOW_JOIN,
    linkage: str = "root",
    block_rows: int | None = BLOCK_ROWS,
    local_edges: int = LOCAL_EDGES,
    edges_per_face: int = EDGES_PER_FACE,
    sure_edges: int = SURE_EDGES,
) -> DataFrame:
    """Cluster embedded faces: ``face_order, root, cluster``.

    Needs ``face_order`` (unique long), ``embedding`` and ``face_quality``. ``cluster``
    is the smallest face order in the cluster. ``linkage="centroid"`` compares cluster
    centroids instead of root faces.
    """
    if linkage == "centroid":
        out = cluster_greedy(faces, threshold, low_join=low_join, low_low=None, block_rows=block_rows)
        return out.select("face_order", F.col("cluster").alias("root"), "cluster")
    if linkage != "root":
        raise ValueError(f"unknown linkage {linkage!r}")
    nodes, members = _nodes(faces)
    n = nodes.count()
    explicit = n * (n - 1) // 2 <= sure_edges
    if not explicit:
        # Either way gives the same clusters, so a forecast is enough to choose one.
        explicit = foreseen(nodes, threshold, low_join)[0] <= edges_per_face * n
    if explicit:
        edges = materialize(_gated_edges(nodes, threshold, low_join, block_rows, False))
        solved = _solve_edges(edges, nodes, threshold, low_join, block_rows, local_edges)
    else:
        solved = solve_rounds(nodes, threshold, low_join, block_rows)
    roots = members.join(solved.withColumnRenamed("id", "node"), "node", "left").select(
        F.col("id").alias("face_order"), F.coalesce("root", "node").alias("root")
    )
    roots = materialize(roots)
    lowest = roots.groupBy("root").agg(F.min("face_order").alias("cluster"))
    return roots.join(lowest, "root").select("face_order", "root", "cluster")


def _component_sizes(tagged: DataFrame) -> tuple[DataFrame, int, int]:
    """Edges per component, with the largest and the sum."""
    sizes = materialize(tagged.groupBy("component").agg(F.count(F.lit(1)).alias("edges")))
    row = sizes.agg(F.coalesce(F.max("edges"), F.lit(0)), F.coalesce(F.sum("edges"), F.lit(0))).first()
    return sizes, row[0], row[1]


def _solve_edges(edges, nodes, threshold, low_join, block_rows, local_edges) -> DataFrame:
    parts = connected_components(edges)
    tagged = edges.join(parts.withColumnRenamed("id", "id_a"), "id_a")
    placed = nodes.join(parts, "id")
    sizes, largest, total = _component_sizes(tagged)
    if largest <= local_edges:
        return _solve_small(tagged, placed.select("id", "size", "component"), total)
    big = sizes.where(F.col("edges") > local_edges).select("component")
    small = _solve_small(
        tagged.join(big, "component", "left_anti"),
        placed.join(big, "component", "left_anti").select("id", "size", "component"),
        total,
    )
    hard = placed.join(big, "component", "left_semi").select(*nodes.columns)
    return small.unionByName(solve_rounds(materialize(hard), threshold, low_join, block_rows))


# ------------------------------------------------------------------ greedy centroid linkage


def _greedy_gate(edges: DataFrame, tiers: DataFrame, threshold, anchor, low_join, low_low, drop_very_low) -> DataFrame:
    """Keep the pairs whose two tiers allow a merge at their similarity."""
    a = tiers.select(F.col("id").alias("id_a"), F.col("tier").alias("tier_a"))
    b = tiers.select(F.col("id").alias("id_b"), F.col("tier").alias("tier_b"))
    rows = edges.join(a, "id_a").join(b, "id_b")
    low_a, low_b = F.col("tier_a") == "low", F.col("tier_b") == "low"
    need = (
        F.when(low_a & low_b, F.lit(low_join if low_low is None else low_low))
        .when(low_a | low_b, F.lit(low_join))
        .otherwise(F.lit(threshold if anchor is None else anchor))
    )
    if drop_very_low:
        rows = rows.where((F.col("tier_a") != "very_low") & (F.col("tier_b") != "very_low"))
    return rows.where(F.col("sim") >= need).select("id_a", "id_b", "sim")


def _unit_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.astype(np.float64), b.astype(np.float64)
    scale = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / scale) if scale > 0 else 0.0


def merge_by_centroid(vectors: dict, edges: list[tuple], threshold: float) -> dict:
    """Greedy pass over ``(sim, a, b)``, best first: ``{id: smallest member}``.

    Two clusters merge when their centroids are similar enough; the centroid is the
    size-weighted mean, not renormalised.
    """
    parent = {n: n for n in vectors}
    centroid = {n: np.asarray(v, np.float32) for n, v in vectors.items()}
    size = {n: 1 for n in vectors}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for s, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        ra, rb = root(a), root(b)
        if ra == rb or _unit_cosine(centroid[ra], centroid[rb]) < threshold:
            continue
        keep, gone = min(ra, rb), max(ra, rb)
        total = size[keep] + size[gone]
        mixed = centroid[keep].astype(np.float64) * size[keep] + centroid[gone].astype(np.float64) * size[gone]
        centroid[keep] = (mixed / total).astype(np.float32)
        size[keep] = total
        parent[gone] = keep
    return {n: root(n) for n in vectors}


def _greedy_small(edges: DataFrame, nodes: DataFrame, threshold: float, total: int) -> DataFrame:
    packs = max(1, total // LOCAL_EDGES + 1) * 8
    pack = F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.LongType())])

    def run(edge_table, node_table):
        matrix = to_matrix(node_table.column("vec"))
        vectors = dict(zip(node_table.column("id").to_pylist(), matrix))
        rows = list(zip(*[edge_table.column(c).to_pylist() for c in ("sim", "id_a", "id_b")]))
        found = merge_by_centroid(vectors, rows, threshold)
        return pa.table({"id": pa.array(list(found), pa.int64()), "cluster": pa.array(list(found.values()), pa.int64())})

    left = edges.select(pack, "id_a", "id_b", "sim")
    return left.groupBy("pack").cogroup(nodes.select(pack, "id", "vec").groupBy("pack")).applyInArrow(run, schema)


class _Merged:
    """Clusters of one slice of sorted edges: positions in id order, with centroid and size."""

    def __init__(self, centroids: np.ndarray, sizes: np.ndarray, threshold: float):
        self.centroids, self.sizes, self.threshold = centroids.astype(np.float32), sizes.copy(), threshold
        self.parent = np.arange(len(sizes))

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def _alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.centroids[a].astype(np.float64), self.centroids[b].astype(np.float64)
        scale = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
        s = np.divide((x * y).sum(1), scale, out=np.zeros(len(a)), where=scale > 0)
        return (s >= self.threshold) & (a != b)

    def merged(self, keep: int, gone: int) -> None:
        """What else a merge changes."""

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        """Decide edges in their order. Only those that touch a merge are compared again."""
        a, b = self.roots(a), self.roots(b)
        ok, at = self._alike(a, b), 0
        while at < len(a) and ok[at:].any():
            at += int(ok[at:].argmax())
            keep, gone = min(a[at], b[at]), max(a[at], b[at])
            total = self.sizes[keep] + self.sizes[gone]
            mixed = self.centroids[keep].astype(np.float64) * self.sizes[keep] + self.centroids[gone].astype(np.float64) * self.sizes[gone]
            self.centroids[keep], self.sizes[keep], self.parent[gone] = (mixed / total).astype(np.float32), total, keep
            self.merged(keep, gone)
            at += 1
            a[at:][a[at:] == gone] = keep
            b[at:][b[at:] == gone] = keep
            moved = at + np.flatnonzero((a[at:] == keep) | (b[at:] == keep))
            ok[moved] = self._alike(a[moved], b[moved])


def _greedy_slices(edges: DataFrame, nodes: DataFrame, threshold: float, slice_edges: int | None = None) -> DataFrame:
    """The greedy pass for components too large for one task: ``(id, cluster)``."""
    state = materialize(nodes.select("id", F.col("vec").cast("array<float>").alias("vec"), F.lit(1).cast("long").alias("size")))
    return _merge_slices(edges, state, nodes.select("id", F.col("id").alias("cluster")), threshold, slice_edges)[1]


def _merge_slices(edges: DataFrame, state: DataFrame, assign: DataFrame, threshold: float, slice_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Decide edges best first: the clusters ``(id, vec, size)`` after them, and ``(id, cluster)``.

    Edges are sorted by Spark and cut into slices of about ``slice_edges``, which are decided
    one after the other. A task holds one slice and the clusters that it touches; edges
    inside a cluster are dropped before they come to it.
    """
    spark, folder = edges.sparkSession, f"{checkpoint_root(edges.sparkSession)}/slices-{uuid.uuid4().hex}"
    slices = max(1, math.ceil(edges.count() / (slice_edges or SLICE_EDGES)))
    ranged = edges.repartitionByRange(slices, F.col("sim").desc(), "id_a", "id_b").withColumn("slice", F.spark_partition_id())
    ranged.write.partitionBy("slice").parquet(folder)
    stored = spark.read.parquet(folder)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("into", T.LongType()), *state.schema.fields[1:]])
    one = F.lit(0).alias("pack")

    def run(edge_table, node_table):
        node_table = node_table.sort_by("id")
        edge_table = edge_table.sort_by([("sim", "descending"), ("id_a", "ascending"), ("id_b", "ascending")])
        ids = column_values(node_table.column("id"))
        a, b = (np.searchsorted(ids, column_values(edge_table.column(c))) for c in ("ca", "cb"))
        found = _Merged(to_matrix(node_table.column("vec")), column_values(node_table.column("size")), threshold)
        for at in range(0, len(a), SLICE_BLOCK):
            found.take(a[at : at + SLICE_BLOCK], b[at : at + SLICE_BLOCK])
        into = found.roots(np.arange(len(ids)))
        gone = np.flatnonzero(into != np.arange(len(ids)))
        out = np.concatenate([gone, np.unique(into[gone])])
        columns = [ids[out], ids[into[out]], list(found.centroids[out]), found.sizes[out]]
        return pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(schema, columns)})

    for number in sorted(r[0] for r in stored.select("slice").distinct().collect()):
        part = (
            stored.where(F.col("slice") == number)
            .join(assign.select(F.col("id").alias("id_a"), F.col("cluster").alias("ca")), "id_a")
            .join(assign.select(F.col("id").alias("id_b"), F.col("cluster").alias("cb")), "id_b")
            .where("ca <> cb")
        )
        part = materialize(part.select(one, "sim", "id_a", "id_b", "ca", "cb"))
        ends = part.select(F.col("ca").alias("id")).unionByName(part.select(F.col("cb").alias("id"))).distinct()
        touched = state.join(ends, "id", "left_semi").select(one, "*")
        changed = materialize(part.groupBy("pack").cogroup(touched.groupBy("pack")).applyInArrow(run, schema))
        if changed.isEmpty():
            continue
        state = materialize(
            state.join(changed.select("id"), "id", "left_anti").unionByName(changed.where("id = into").select("id", "vec", "size"))
        )
        moved = changed.where("id <> into").select(F.col("id").alias("cluster"), "into")
        assign = materialize(
            assign.join(moved, "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster"))
        )
    return state, assign


def _wanted_edges(needs: Sequence[float], low: float, high: float, known: np.ndarray | None):
    """Pairs of unlike clusters from ``low`` up to below ``high`` that their tiers allow, as a generator over blocks.

    ``known`` marks the pairs of clusters to look at, packed in bits; without it all are.
    """
    needs = np.asarray(needs)

    def hits(a: Side, b: Side, same: bool):
        marks = None if known is None else np.unpackbits(known.value, axis=1).astype(bool)

        def wanted(i, j):
            x, y = a.attr["cluster"][i], b.attr["cluster"][j]
            return (x != y) if marks is None else (x != y) & marks[x, y]

        for i, j, s in pairs_near(a, b, low - ANGLE_SLACK, wanted):
            hit = (s >= needs[a.attr["low"][i].astype(np.int8) + b.attr["low"][j].astype(np.int8)]) & (s >= low) & (s < high)
            if same:
                hit &= i < j
            yield i[hit], j[hit], s[hit]

    return hits


BAND_EDGE = T.StructType([T.StructField(c, T.DoubleType() if c == "sim" else T.LongType()) for c in ("sim", "id_a", "id_b", "ca", "cb")])


def _band_edges(placed: DataFrame, needs: Sequence[float], low: float, high: float, known, block_rows: int | None) -> DataFrame:
    """Edges between clusters of ``placed(id, vec, low, cluster)``, with the clusters."""
    hits = _wanted_edges(needs, low, high, known)

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        found = []
        for i, j, s in hits(a, b, same):
            x, y = a.attr["id"][i], b.attr["id"][j]
            cx, cy, turned = a.attr["cluster"][i], b.attr["cluster"][j], x > y
            found.append((s, np.where(turned, y, x), np.where(turned, x, y), np.where(turned, cy, cx), np.where(turned, cx, cy)))
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(5)]
        return pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(BAND_EDGE, [columns[0], *[c.astype(np.int64) for c in columns[1:]]])})

    return block_pairs(placed, None, reduce, BAND_EDGE, low, block_rows)


def _greedy_above(placed: DataFrame, needs: Sequence[float], threshold: float, high: float, known) -> np.ndarray:
    """About how many edges lie at or over each bin's lower edge, from the partners of some faces."""
    hits, edges = _wanted_edges(needs, threshold, high, known), _bins(threshold)

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        total = np.zeros(BAND_BINS, np.int64)
        for _, _, s in hits(a, b, same):
            total += np.bincount(np.searchsorted(edges, s, side="right") - 1, minlength=BAND_BINS)
        at = np.nonzero(total)[0]
        return pa.table({"bin": pa.array(at.astype(np.int32)), "edges": pa.array(total[at])})

    schema = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("edges", T.LongType())])
    chosen, n = placed.orderBy(F.xxhash64("id")).limit(SAMPLE_NODES), placed.count()
    return _above(block_pairs(chosen, placed, reduce, schema, threshold)) * (n / (2 * max(1, min(n, SAMPLE_NODES))))


def _greedy_cut(above: np.ndarray, threshold: float, band_edges: int) -> float:
    """The lower edge of a bin over which about ``band_edges`` edges lie; that of the best ones if they are more."""
    cut = _cut_of(above, threshold, band_edges)
    return float(_bins(threshold)[np.flatnonzero(above)[-1]]) if cut is None else cut


def _greedy_band(placed: DataFrame, needs, threshold: float, high: float, known, block_rows, band_edges: int) -> tuple[DataFrame, float]:
    """About ``band_edges`` of the best edges below ``high``, and the similarity from which on they are all."""
    cut = _greedy_cut(_greedy_above(placed, needs, threshold, high, known), threshold, int(0.9 * band_edges))
    edges = materialize(_band_edges(placed, needs, cut, high, known, block_rows))
    if edges.count() > band_edges:
        # Foreseen too low: the cut is raised to a bin's edge among the edges that were listed.
        at = F.floor((F.col("sim") - threshold) / (1.0 - threshold) * BAND_BINS).cast("int")
        counts = edges.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(BAND_BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("edges"))
        cut = max(cut, _greedy_cut(_above(counts), threshold, band_edges))
        edges = edges.where(F.col("sim") >= cut)
    return edges, cut


class _Foreseeing(_Merged):
    """Decides edges of known pairs of clusters, and tells which unknown pairs it would have needed.

    A pair of clusters is known if all pairs of what they were made of are. As long as the
    centroids of all others stay below the threshold, their edges would be turned down.
    """

    def __init__(self, centroids: np.ndarray, sizes: np.ndarray, threshold: float, known: np.ndarray):
        super().__init__(centroids, sizes, threshold)
        self.known, self.asked = known.copy(), np.zeros_like(known)
        self.members = [[k] for k in range(len(sizes))]

    def merged(self, keep: int, gone: int) -> None:
        both = self.known[keep] & self.known[gone]
        self.known[keep], self.known[:, keep] = both, both
        self.members[keep] += self.members[gone]
        live = np.flatnonzero((self.parent == np.arange(len(self.parent))) & ~both)
        live = live[live != keep]
        x, y = self.centroids[live].astype(np.float64), self.centroids[keep].astype(np.float64)
        scale = np.sqrt((x * x).sum(1)) * np.sqrt(y @ y)
        s = np.divide(x @ y, scale, out=np.zeros(len(live)), where=scale > 0)
        for other in live[s >= self.threshold - ANGLE_SLACK]:
            self.asked[np.ix_(self.members[keep], self.members[other])] = True
            self.known[keep, other] = self.known[other, keep] = True


def _foresee(edges: DataFrame, ids: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, threshold: float, known: np.ndarray) -> tuple:
    """Decide a band in one task: parents, centroids and sizes of the clusters, and the pairs it asks for."""
    shared = edges.sparkSession.sparkContext.broadcast((centroids, sizes, np.packbits(known, axis=1)))
    schema = T.StructType([T.StructField(c, T.BinaryType()) for c in ("parent", "centroids", "sizes", "asked")])

    def run(table):
        centroids, sizes, packed = shared.value
        found = _Foreseeing(centroids, sizes, threshold, np.unpackbits(packed, axis=1)[:, : len(sizes)].astype(bool))
        sim, x, y, a, b = (column_values(table.column(c)) for c in ("sim", "id_a", "id_b", "ca", "cb"))
        order = np.lexsort((y, x, -sim))
        a, b = a[order], b[order]
        for at in range(0, len(a), SLICE_BLOCK):
            found.take(a[at : at + SLICE_BLOCK], b[at : at + SLICE_BLOCK])
        asked = found.asked | found.asked.T
        out = (found.roots(np.arange(len(sizes))).astype(np.int64), found.centroids, found.sizes, np.packbits(asked, axis=1))
        return pa.table({f.name: pa.array([c.tobytes()], pa.binary()) for f, c in zip(schema, out)})

    one = edges.select(F.lit(0).alias("pack"), *BAND_EDGE.names)
    row = one.groupBy("pack").applyInArrow(run, schema).first()
    if row is None:
        return np.arange(len(ids)), centroids, sizes, np.zeros_like(known)
    asked = np.unpackbits(np.frombuffer(row["asked"], np.uint8).reshape(len(ids), -1), axis=1)[:, : len(ids)].astype(bool)
    return np.frombuffer(row["parent"], np.int64), np.frombuffer(row["centroids"], np.float32).reshape(centroids.shape), np.frombuffer(row["sizes"], np.int64), asked & ~known


def _greedy_rounds(rows: DataFrame, threshold: float, needs: Sequence[float], block_rows: int | None) -> DataFrame:
    """The greedy pass without a list of all edges: ``(id, cluster)`` of ``rows(id, vec, low, size)``.

    Edges are met in bands of falling similarity. A band holds about ``GREEDY_EDGES`` edges
    between unlike clusters, is decided and not needed again. From ``LOCAL_CLUSTERS`` clusters
    on a band holds only edges of clusters whose centroids are near the threshold or over it:
    the others are turned down while they stay below it. If a merge brings such a pair over it,
    the pair's edges in the band are listed too and the band is decided anew, until none is missing.
    """
    spark = rows.sparkSession
    state = materialize(rows.select("id", F.col("vec").cast("array<float>").alias("vec"), "size"))
    # A few edges a face leave few enough clusters; more than that are better met with their help.
    first_edges = min(GREEDY_EDGES, max(SLICE_EDGES, FIRST_EDGES * rows.count()))
    assign, high = rows.select("id", F.col("id").alias("cluster")), math.inf
    while high > threshold and state.count() > LOCAL_CLUSTERS:
        placed = materialize(rows.select("id", "vec", "low").join(assign, "id"))
        edges, high = _greedy_band(placed, needs, threshold, high, None, block_rows, first_edges)
        if not edges.isEmpty():
            state, assign = _merge_slices(edges.select("sim", "id_a", "id_b"), state, assign, threshold)
        del edges, placed
        release(spark)
    while high > threshold:
        table = state.toArrow().sort_by("id")
        ids, sizes = column_values(table.column("id")), column_values(table.column("size"))
        centroids = to_matrix(table.column("vec")).astype(np.float32)
        units = unit_rows(centroids.astype(np.float64))
        known = units @ units.T >= threshold - NEAR_MARGIN
        known |= known.T
        numbers = pa.table({"cluster": pa.array(ids, pa.int64()), "number": pa.array(np.arange(len(ids)))})
        placed = materialize(assign.join(spark.createDataFrame(numbers), "cluster").join(rows.select("id", "vec", "low"), "id").select("id", "vec", "low", F.col("number").alias("cluster")))
        packed = lambda marks: spark.sparkContext.broadcast(np.packbits(marks, axis=1))
        edges, low = _greedy_band(placed, needs, threshold, high, packed(known), block_rows, GREEDY_EDGES)
        while True:
            parent, centroids_after, sizes_after, asked = _foresee(edges, ids, centroids, sizes, threshold, known)
            if not asked.any():
                break
            some = spark.createDataFrame(pa.table({"cluster": pa.array(np.flatnonzero(asked.any(axis=1)))}))
            part = materialize(placed.join(some, "cluster", "left_semi").select("id", "vec", "low", "cluster"))
            edges = edges.unionByName(materialize(_band_edges(part, needs, low, high, packed(asked), block_rows)))
            known |= asked
        roots = parent == np.arange(len(ids))
        moved = pa.table({"cluster": pa.array(ids, pa.int64()), "into": pa.array(ids[parent], pa.int64())})
        assign = materialize(assign.join(spark.createDataFrame(moved), "cluster").select("id", F.col("into").alias("cluster")))
        state = spark.createDataFrame(pa.table({"id": pa.array(ids[roots], pa.int64()), "vec": pa.array(list(centroids_after[roots]), pa.list_(pa.float32())), "size": pa.array(sizes_after[roots], pa.int64())}))
        high = low
        del edges, placed
        release(spark)
    return assign


def cluster_greedy(
    faces: DataFrame,
    threshold: float,
    anchor: float | None = None,
    low_join: float = LOW_JOIN,
    low_low: float | None = LOW_LOW_JOIN,
    drop_very_low: bool = True,
    block_rows: int | None = BLOCK_ROWS,
    local_edges: int = LOCAL_EDGES,
) -> DataFrame:
    """Greedy centroid linkage: ``face_order, cluster`` (smallest member).

    Every merge needs a face pair over the threshold, so connected components of those
    pairs are independent.
    """
    rows = materialize(
        faces.where(F.col("embedding").isNotNull()).select(
            F.col("face_order").alias("id"), F.col("embedding").alias("vec"), F.col("face_quality").alias("tier")
        )
    )
    least = [max(threshold, x) for x in (threshold if anchor is None else anchor, low_join, low_join if low_low is None else low_low)]
    n = rows.count()
    if 0 < threshold and max(least) < 1 and n * (n - 1) // 2 > GREEDY_EDGES:
        base = (rows.where(F.col("tier") != "very_low") if drop_very_low else rows).withColumn("tier", F.coalesce("tier", F.lit("")))
        reps = materialize(collapse_copies(base, "id", "vec", ["tier"]))
        nodes = reps.where(norm("vec") > 0).select("id", "vec", F.coalesce(F.col("tier") == "low", F.lit(False)).cast("long").alias("low"), F.col("n").alias("size"))
        placed = nodes.select("id", "vec", "low", F.col("id").alias("cluster"))
        if _greedy_above(placed, least, threshold, math.inf, None)[0] > GREEDY_EDGES:
            found = _greedy_rounds(nodes, threshold, least, block_rows)
            members = copy_members(base, reps.where(norm("vec") > 0), "id", "vec", ["tier"])
            joined = rows.select("id").join(members, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
            return joined.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
                F.col("id").alias("face_order"), F.coalesce("cluster", "id").alias("cluster")
            )
    # Copies of one tier always merge first, so linking them to their first face is enough.
    edges = similar_pairs(rows, threshold, "id", "vec", block_rows=block_rows, copies="linked", keep=["tier"])
    edges = materialize(
        _greedy_gate(edges, rows.select("id", "tier"), threshold, anchor, low_join, low_low, drop_very_low)
    )
    parts = connected_components(edges)
    tagged = edges.join(parts.withColumnRenamed("id", "id_a"), "id_a")
    placed = rows.join(parts, "id").select("id", "vec", "component")
    sizes, largest, total = _component_sizes(tagged)
    if largest <= local_edges:
        found = _greedy_small(tagged, placed, threshold, total)
    else:
        big = sizes.where(F.col("edges") > local_edges).select("component")
        found = _greedy_small(
            tagged.join(big, "component", "left_anti"), placed.join(big, "component", "left_anti"), threshold, total
        ).unionByName(
            _greedy_slices(
                tagged.join(big, "component", "left_semi").select("id_a", "id_b", "sim"),
                placed.join(big, "component", "left_semi").select("id", "vec"),
                threshold,
            )
        )
    return rows.select("id").join(found, "id", "left").select(
        F.col("id").alias("face_order"), F.coalesce("cluster", "id").alias("cluster")
    )


# ------------------------------------------------------------------ running average


class _Leaders:
    """The centroids of one label, in the order in which they came up.

    Faces come in blocks: one matrix product compares the whole block with all centroids as
    they stand. A face moves or adds a single centroid, so only that one's similarities to
    the faces left in the block are worked out again; the others stay right.
    """

    def __init__(self, size: int, threshold: float):
        self.threshold, self.used = threshold, 0
        self.centres, self.lengths = np.zeros((16, size), np.float32), np.zeros(16)

    def _cosines(self, rows: np.ndarray, norms: np.ndarray, which) -> np.ndarray:
        scale = norms[:, None] * self.lengths[which][None, :]
        return np.divide(rows @ self.centres[which].astype(np.float64).T, scale, out=np.zeros(scale.shape), where=scale > 0)

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The cluster of every row, from 1, each decided in its turn."""
        while self.used + len(rows) > len(self.centres):
            self.centres = np.concatenate([self.centres, np.zeros_like(self.centres)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        norms = np.sqrt((rows * rows).sum(axis=1))
        s = np.zeros((len(rows), self.used + len(rows)))
        s[:, : self.used] = self._cosines(rows, norms, slice(0, self.used))
        out = np.zeros(len(rows), np.int64)
        for i, v in enumerate(rows):
            pick = int(s[i, : self.used].argmax()) if self.used and norms[i] > 0 else -1
            if pick < 0 or s[i, pick] <= self.threshold:
                pick = self.used
                self.used += 1
                self.centres[pick] = v
            else:
                self.centres[pick] = (self.centres[pick].astype(np.float64) + v) / 2
            c = self.centres[pick].astype(np.float64)
            self.lengths[pick] = np.sqrt(c @ c)
            if i + 1 < len(rows):
                s[i + 1 :, pick : pick + 1] = self._cosines(rows[i + 1 :], norms[i + 1 :], slice(pick, pick + 1))
            out[i] = pick + 1
        return out


def cluster_running_average(faces: DataFrame, threshold: float, label: str = "label") -> DataFrame:
    """Sequential leader clustering inside each label: ``label, face_order, cluster`` (from 1).

    A face joins the most similar centroid strictly above the threshold, which moves to
    the midpoint; otherwise it starts a new one. The result depends on the order of the
    faces, so a label is read in order by one task, which holds only its centroids.

    The rows are dealt by a struct of the label: dealt by the label itself, Spark would drop
    the shuffle behind a join by label, and the adaptive plan may turn that join into a
    broadcast one that leaves the rows of a label in several tasks.
    """
    label_type = faces.schema[label].dataType
    schema = T.StructType(
        [T.StructField(label, label_type), T.StructField("face_order", T.LongType()), T.StructField("cluster", T.LongType())]
    )
    ordered = (
        faces.where(F.col("embedding").isNotNull() & F.col(label).isNotNull())
        .select(label, "face_order", "embedding")
        .repartition(F.struct(label))
        .sortWithinPartitions(label, "face_order")
    )

    def run(batches):
        current, found = None, None
        for batch in batches:
            vectors = to_matrix(pa.chunked_array([batch.column("embedding")]))
            names = batch.column(label).to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if names else [0]
            clusters = []
            for start, stop in zip(cuts, cuts[1:]):
                if found is None or names[start] != current:
                    current, found = names[start], _Leaders(vectors.shape[1], threshold)
                for at in range(start, stop, LEADER_BLOCK):
                    clusters.append(found.take(vectors[at : min(stop, at + LEADER_BLOCK)]))
            numbers = np.concatenate(clusters) if clusters else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(label), batch.column("face_order"), pa.array(numbers)], [label, "face_order", "cluster"]
            )

    return ordered.mapInArrow(run, schema)


# ------------------------------------------------------------------ catalog level


def recluster_catalog(
    photos: DataFrame,
    faces: DataFrame,
    persons: DataFrame,
    person_manual: DataFrame,
    threshold: float = LINKAGE_THRESHOLD,
    low_join: float = LOW_JOIN,
    solve=None,
    **kwargs,
) -> tuple[DataFrame, DataFrame]:
    """Rebuild persons from scratch: new ``(faces, persons)``.

    Persons edited by hand, and their faces, stay exactly as they are. All other live
    embedded faces are clustered; a cluster keeps the custom name of its first named
    member and is otherwise called ``Person N`` in order of its first face. Without such
    faces nothing changes.

    The persons have the columns of ``persons`` and a ``centroid``; a new person's
    ``created_at`` and ``updated_at`` are the time of the call, other columns are null.
    Numeric ids continue after the largest id in use. Text ids come from the first face of
    the cluster, so a repeat gives the same id. ``solve`` may take the pool of faces and
    return their clusters some other way, as from a store that knows most of them.
    """
    manual = person_manual.select("person_id").distinct()
    frozen = faces.join(manual, "person_id", "left_semi")
    auto = faces.join(frozen.select("face_id"), "face_id", "left_anti")
    pool = materialize(
        auto.where(F.col("embedding").isNotNull()).join(live(photos).select("photo_id"), "photo_id", "left_semi")
    )
    if pool.isEmpty():
        return faces, persons
    found = materialize(solve(pool) if solve else cluster_faces(pool, threshold, low_join, **kwargs))
    named = persons.where(~F.lower("name").like("person %")).select("person_id", "name")
    custom = (
        found.join(pool.select("face_order", "person_id"), "face_order")
        .join(named, "person_id")
        .groupBy("cluster").agg(F.min_by("name", "face_order").alias("custom"))
    )
    starts = found.groupBy("cluster").agg(F.min("face_order").alias("face_order"))
    starts = starts.join(pool.select("face_order", "face_id"), "face_order").select("cluster", "face_id")
    numbered = rank_in_group(starts, [], ["cluster"], "number")
    kind = persons.schema["person_id"].dataType
    if isinstance(kind, T.StringType):
        new_id = F.concat(F.lit("person-"), F.col("face_id").cast("string"))
    else:
        highest = persons.agg(F.coalesce(F.max("person_id"), F.lit(0)).alias("highest")).first()["highest"]
        new_id = (F.col("number") + F.lit(highest)).cast(kind)
    means = centroids(found.join(pool.select("face_order", "embedding"), "face_order"), ["cluster"])
    stored = persons if "centroid" in persons.columns else persons.withColumn("centroid", F.lit(None).cast("array<double>"))
    now = F.current_timestamp()
    values = {
        "person_id": F.col("_id"),
        "name": F.coalesce("custom", F.concat(F.lit("Person "), F.col("number").cast("string"))),
        "centroid": F.col("centroid"),
        "created_at": now,
        "updated_at": now,
    }
    rows = materialize(numbered.withColumn("_id", new_id).join(custom, "cluster", "left").join(means, "cluster"))
    created = rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema])
    links = found.join(rows.select("cluster", F.col("_id").alias("new_person")), "cluster").select("face_order", "new_person")
    rest = auto.drop("person_id").join(links, "face_order", "left").withColumnRenamed("new_person", "person_id")
    new_faces = rest.select(*faces.columns).unionByName(frozen.select(*faces.columns))
    kept = stored.join(manual, "person_id", "left_semi").select(*stored.columns)
    return new_faces, materialize(created).unionByName(kept)


def _closest(reps: DataFrame, others: DataFrame | None, threshold: float, block_rows: int | None) -> DataFrame:
    """``id, mate, sim``: the best partners that each pair of blocks holds, equal ones by smallest id.

    With ``others``, which hold all of ``reps``, these meet them; otherwise ``reps`` meet themselves.
    """
    kind = reps.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("mate", kind), T.StructField("sim", T.DoubleType())])

    def firsts(rows: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Where each row has its best hit, the first of equal ones."""
        order = np.lexsort((-s, rows))
        return order[np.flatnonzero(np.diff(rows[order], prepend=-1))]

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        a = _sorted_side(a, "id")
        b = a if same else _sorted_side(b, "id")
        ids_a, ids_b = a.attr["id"], b.attr["id"]
        col_s, col_at = np.full(len(b), -2.0), np.zeros(len(b), np.int64)
        ids, mates, sims = [], [], []
        for i, j, s in pairs_near(a, b, threshold - ANGLE_SLACK):
            hit = (s >= threshold) & (ids_a[i] != ids_b[j])
            i, j, s = i[hit], j[hit], s[hit]
            at = firsts(i, s)
            ids.append(ids_a[i[at]])
            mates.append(ids_b[j[at]])
            sims.append(s[at])
            if not same:
                at = firsts(j, s)
                at = at[s[at] > col_s[j[at]]]
                col_s[j[at]], col_at[j[at]] = s[at], i[at]
        has = np.flatnonzero(col_s > -2.0)
        return arrow_table(schema, [[*ids, ids_b[has]], [*mates, ids_a[col_at[has]]], [*sims, col_s[has]]])

    keep = ["id", "vec"]
    return block_pairs(reps.select(keep), None if others is None else others.select(keep), reduce, schema, threshold, block_rows)


def _merge_rest(ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """All rounds over a bounded number of centroids in order of their ids: where each ends up."""
    n = len(ids)
    vectors, sizes, into = vectors.copy(), sizes.astype(np.float64), np.arange(n)
    live, table = np.ones(n, bool), np.full((n, n), -2.0)

    def compare(rows: np.ndarray) -> None:
        at = np.flatnonzero(live)
        own, other = Side.__new__(Side), Side.__new__(Side)
        own.units, other.units = unit_rows(vectors[rows]), unit_rows(vectors[at])
        for i, j, s in pairs_near(own, other, threshold - ANGLE_SLACK):
            i, j = rows[i], at[j]
            hit = (s >= threshold) & (i != j)
            table[i[hit], j[hit]] = s[hit]
            table[j[hit], i[hit]] = s[hit]

    compare(np.arange(n))
    while True:
        # Columns are ordered by id, so the first maximum settles ties.
        mate = table.argmax(axis=1)
        a = np.flatnonzero((table[np.arange(n), mate] > -2.0) & (mate[mate] == np.arange(n)) & (np.arange(n) < mate))
        if not len(a):
            break
        b = mate[a]
        keep, gone = np.where(sizes[a] >= sizes[b], a, b), np.where(sizes[a] >= sizes[b], b, a)
        own, other = sizes[keep][:, None], sizes[gone][:, None]
        vectors[keep] = (vectors[keep] * own + vectors[gone] * other) / (own + other)
        sizes[keep] += sizes[gone]
        into[gone], live[gone] = keep, False
        for rows in (keep, gone):
            table[rows] = table[:, rows] = -2.0
        compare(keep)
    while not np.array_equal(into, into[into]):
        into = into[into]
    return into


def merge_duplicate_persons(
    faces: DataFrame,
    threshold: float = 0.5,
    dry_run: bool = False,
    block_rows: int | None = BLOCK_ROWS,
    local_rows: int = LOCAL_REPS,
) -> DataFrame:
    """Fold near-identical persons together: ``person_id, merged_into``.

    Each round compares person centroids; two persons that are each other's best match
    merge, the smaller into the larger, and centroids are recomputed. A pair is final
    once merged. ``dry_run`` stops after the first round.

    A round lists each centroid's best partner only. Where few lost theirs or moved, these
    alone are compared again. Rounds are many and the late ones merge a pair or two: as soon
    as a round leaves at most ``local_rows`` centroids, one task does those that remain over
    a bounded table of similarities, however many persons there were.
    """
    rows = materialize(
        faces.where(F.col("person_id").isNotNull() & F.col("embedding").isNotNull()).select("person_id", "embedding")
    )
    # Sums are additive, so a merge only adds vectors; faces are read once.
    means = centroids(rows, ["person_id"])
    state = materialize(
        means.select(F.col("person_id").alias("id"), "n", F.col("centroid").alias("vec"))
    )
    mapping = state.select(F.col("id").alias("person_id"), F.col("id").alias("merged_into"))
    left, best, dirty = state.count(), None, None
    while best is None or left > local_rows:
        if dirty is None or dirty.count() > SMALL_SIDE:
            found = _closest(state, None, threshold, block_rows)
        else:
            # All others still have the partner they had, or a moved one that is better.
            found = _closest(dirty, state, threshold, block_rows).unionByName(
                best.join(dirty.select("id"), "id", "left_anti")
            )
        best = materialize(
            found.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "mate")).alias("m"))
            .select("id", F.col("m.mate").alias("mate"), (-F.col("m.s")).alias("sim"))
        )
        mutual = best.alias("x").join(
            best.alias("y"), (F.col("x.mate") == F.col("y.id")) & (F.col("y.mate") == F.col("x.id"))
        ).where("x.id < x.mate").select(F.col("x.id").alias("a"), F.col("x.mate").alias("b"))
        sizes = state.select("id", "n")
        merged = materialize(
            mutual.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
            .select(
                F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("keep"),
                F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("gone"),
            )
        )
        merges = merged.count()
        if not merges:
            return mapping
        mapping = materialize(
            mapping.join(merged.select(F.col("gone").alias("merged_into"), "keep"), "merged_into", "left")
            .select("person_id", F.coalesce("keep", "merged_into").alias("merged_into"))
        )
        if dry_run:
            return mapping
        taken = state.select(F.col("id").alias("gone"), F.col("vec").alias("v2"), F.col("n").alias("n2"))
        mean = F.zip_with(
            "vec", "v2", lambda x, y: (x * F.col("n") + y * F.col("n2")) / (F.col("n") + F.col("n2"))
        )
        state = materialize(
            state.join(merged.select(F.col("gone").alias("id")), "id", "left_anti")
            .join(merged.withColumnRenamed("keep", "id"), "id", "left")
            .join(taken, "gone", "left")
            .select(
                "id",
                F.when(F.col("n2").isNull(), F.col("vec")).otherwise(mean).alias("vec"),
                (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
            )
        )
        left -= merges
        if left > local_rows:
            ends = merged.select(F.col("keep").alias("mate")).unionByName(merged.select(F.col("gone").alias("mate")))
            changed = best.join(ends, "mate", "left_semi").select("id").unionByName(merged.select(F.col("keep").alias("id")))
            dirty = materialize(state.join(changed, "id", "left_semi").select("id", "vec"))

    kind = state.schema["id"].dataType
    schema = T.StructType([T.StructField("merged_into", kind), T.StructField("rep", kind)])

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if tables:
            side = pa.concat_tables(tables)
            order = np.argsort(column_values(side.column("id")), kind="stable")
            ids, sizes = (column_values(side.column(c))[order] for c in ("id", "n"))
            into = _merge_rest(ids, to_matrix(side.column("vec"))[order], sizes, threshold)
            yield from arrow_table(schema, [[ids], [ids[into]]]).to_batches()

    rest = materialize(state.select("id", "vec", "n").coalesce(1).mapInArrow(run, schema))
    return mapping.join(rest, "merged_into").select("person_id", F.col("rep").alias("merged_into"))
