"""Similarity joins and pair statistics over vectors.

Vectors are grouped around pivots, each group is cut into blocks of bounded size, and
only block pairs that can hold a pair above the threshold meet in a task, where one
matrix product compares them. By the triangle inequality on angles a vector ``x`` can
match something in a group with pivot ``p`` and radius ``r`` only when
``angle(x, p) <= r + acos(threshold)``. At low thresholds that alone prunes little, so
each group also knows, in the leading ``k`` principal directions of a sample, how far its
members lie from the pivot (``gap``) and how much of them lies outside (``tail``): no
member can be more similar to ``x`` than ``head(x).head(p) + |head(x)| gap + |tail(x)| tail``.
Both bounds are exact, so the pruning never loses a pair.

What leaves a task is decided by a reducer: the pairs above a threshold, counts per
bin, the best partner per row, or whether a row has any partner. The last three stay
proportional to the number of rows however many pairs qualify. Equal vectors are
collapsed to one representative with a multiplicity before anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinframe.functions.vectors import norm
from kinframe.session import materialize

# Rows per block: chosen from the input size and the parallelism unless given. More
# blocks mean more tasks but also more copies of every row.
BLOCK_ROWS = None
MIN_BLOCK_ROWS, MAX_BLOCK_ROWS, BLOCKS_WANTED = 2048, 32768, 256
MAX_TASKS = 20_000
TILE_CELLS = 4_000_000
# Named pairs that are worked out at once.
PAIRS_AT_ONCE = 65_536
# Pairs of one stratum that are counted at once, and how many groups of attributes are told apart.
STRATA_CELLS = 1_000_000
MAX_GROUPS = 256
MAX_PIVOTS = 512
ANGLE_SLACK = 1e-6
# Leading directions for which groups keep bounds.
HEADS = (4, 8, 16, 32, 64, 128)


def to_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    merged = column.combine_chunks()
    if isinstance(merged, pa.ChunkedArray):
        merged = merged.chunk(0) if merged.num_chunks else pa.array([], column.type)
    flat = merged.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(merged), -1) if len(merged) else np.zeros((0, 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True)) if m.size else np.ones((len(m), 1))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def column_values(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if hasattr(column, "num_chunks") else np.asarray(column)


# ------------------------------------------------------------------ equal vectors


def collapse_copies(
    df: DataFrame, id_col: str, vec_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct (vector, ``keep``): smallest id, vector and multiplicity ``n``."""
    return (
        df.where(F.col(vec_col).isNotNull())
        .groupBy(F.col(vec_col).alias("vec"), *keep)
        .agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
        .select("id", "vec", "n", *keep)
    )


def copy_members(
    df: DataFrame, reps: DataFrame, id_col: str, vec_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """``(id, rep)`` for members of groups with more than one copy."""
    shared = reps.where("n > 1").select("vec", *keep, F.col("id").alias("rep"))
    return (
        df.where(F.col(vec_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *keep)
        .join(shared, ["vec", *keep])
        .select("id", "rep")
    )


# ------------------------------------------------------------------ placement


@dataclass(frozen=True)
class Group:
    """What is known of the rows around one pivot: number, largest angle, bounds per head."""

    rows: int
    radius: float
    gap: tuple[float, ...] = ()
    tail: tuple[float, ...] = ()


class Placement:
    """Pivots, principal directions, and the groups of each side with their blocks."""

    def __init__(self, pivots: np.ndarray, basis: np.ndarray, sides: list[dict[int, Group]], block_rows: int):
        self.pivots, self.basis, self.sides = pivots, basis, sides
        self.heads = _heads(basis)
        self.offset: list[dict[int, int]] = []
        self.blocks: list[dict[int, int]] = []
        for groups in sides:
            offset, blocks, at = {}, {}, 0
            for cell in sorted(groups):
                blocks[cell] = max(1, math.ceil(groups[cell].rows / block_rows))
                offset[cell] = at
                at += blocks[cell]
            self.offset.append(offset)
            self.blocks.append(blocks)

    def reachable(self, units: np.ndarray, side: int, threshold: float | None, bounds: bool = True) -> np.ndarray:
        """Rows by groups of ``side``: where a row may find a partner over the threshold."""
        groups = [self.sides[side][q] for q in sorted(self.sides[side])]
        if not len(self.pivots) or threshold is None or threshold <= 0:
            return np.ones((len(units), len(groups)), bool)
        cells = sorted(self.sides[side])
        reach = math.acos(min(1.0, threshold)) + ANGLE_SLACK
        near = angles(units, self.pivots[cells]) <= np.array([g.radius for g in groups])[None, :] + reach
        if bounds:
            turned, centres = units @ self.basis, self.pivots[cells] @ self.basis
            for i, k in enumerate(self.heads):
                head, tail = turned[:, :k], np.sqrt((turned[:, k:] ** 2).sum(1))
                most = head @ centres[:, :k].T
                most += np.sqrt((head**2).sum(1))[:, None] * np.array([g.gap[i] for g in groups])[None, :]
                most += tail[:, None] * np.array([g.tail[i] for g in groups])[None, :]
                near &= most >= threshold - ANGLE_SLACK
        return near


def _heads(basis: np.ndarray) -> list[int]:
    return [k for k in HEADS if k < len(basis)]


def sample_rows(df: DataFrame) -> np.ndarray:
    """A fixed, hash-chosen set of at most MAX_PIVOTS vectors."""
    rows = df.orderBy(F.xxhash64("vec")).limit(MAX_PIVOTS).select("vec").collect()
    return unit_rows(np.array([r["vec"] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 0))


def _directions(sample: np.ndarray) -> np.ndarray:
    """Orthonormal directions of a sample, the most telling first; all of the space."""
    return np.linalg.svd(sample, full_matrices=True)[2].T


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def place_rows(df: DataFrame, pivots: np.ndarray, basis: np.ndarray | None = None) -> DataFrame:
    """Add the nearest pivot ``cell``, the angle to it, and the bounds per head."""
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("ang", T.DoubleType()), T.StructField("gap", numbers), T.StructField("tail", numbers)])
    basis = np.eye(pivots.shape[1]) if basis is None else basis
    heads, turned_pivots = _heads(basis), pivots @ basis

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            units = unit_rows(to_matrix(table.column("vec")))
            if not len(units):
                continue
            near = angles(units, pivots)
            cell = near.argmin(axis=1)
            turned = units @ basis
            apart = np.cumsum((turned - turned_pivots[cell]) ** 2, axis=1)
            inside = np.cumsum(turned**2, axis=1)
            gap = np.sqrt(np.stack([apart[:, k - 1] for k in heads], 1)) if heads else np.zeros((len(cell), 0))
            tail = np.sqrt(np.maximum(np.stack([inside[:, -1] - inside[:, k - 1] for k in heads], 1), 0)) if heads else gap
            table = table.append_column("cell", pa.array(cell.astype(np.int32)))
            table = table.append_column("ang", pa.array(near[np.arange(len(cell)), cell]))
            for name, values in (("gap", gap), ("tail", tail)):
                table = table.append_column(name, pa.array(list(values), pa.list_(pa.float64())))
            yield from table.to_batches()

    return df.mapInArrow(run, schema)


def _placement(left: DataFrame, right: DataFrame | None, block_rows: int | None, prune: bool):
    """Put both sides into groups; returns the placed sides and their layout."""
    sides = [left] if right is None else [left, right]
    sizes = [s.count() for s in sides]
    if block_rows is None:
        # About two block pairs per core, within the bounds.
        cores = left.sparkSession.sparkContext.defaultParallelism
        blocks = min(BLOCKS_WANTED, math.ceil(math.sqrt(4 * cores)))
        block_rows = min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, math.ceil(max(sizes) / blocks)))
    wanted = math.ceil(max(sizes) / block_rows) if sizes and prune else 1
    if wanted <= 1:
        # One group around no pivot: blocks alone bound the work.
        placed = [s.withColumn("cell", F.lit(0)).withColumn("ang", F.lit(0.0)) for s in sides]
        groups = [{0: Group(n, math.pi)} for n in sizes]
        return placed, Placement(np.zeros((0, 0)), np.zeros((0, 0)), groups, block_rows)
    sample = sample_rows(sides[-1])
    pivots, basis = sample[:wanted], _directions(sample)
    heads = range(len(_heads(basis)))
    placed = [materialize(place_rows(s, pivots, basis)) for s in sides]
    groups = []
    for p in placed:
        most = [F.max(F.col(c)[i]).alias(f"{c}{i}") for c in ("gap", "tail") for i in heads]
        rows = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("ang").alias("r"), *most).collect()
        groups.append({r["cell"]: Group(r["n"], r["r"], tuple(r[f"gap{i}"] for i in heads), tuple(r[f"tail{i}"] for i in heads)) for r in rows})
    return placed, Placement(pivots, basis, groups, block_rows)


def _spread(df: DataFrame, side: int, self_join: bool, place: Placement, threshold: float | None) -> DataFrame:
    """Copy each row to every block pair it can contribute to."""
    extra = [
        T.StructField("block_a", T.IntegerType()),
        T.StructField("block_b", T.IntegerType()),
        T.StructField("is_a", T.BooleanType()),
    ]
    kept = [f for f in df.schema.fields if f.name not in ("cell", "ang", "gap", "tail", "sub")]
    other = 0 if self_join else 1 - side

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cell = column_values(table.column("cell"))
            sub = column_values(table.column("sub"))
            first = np.array([place.offset[side][c] for c in cell.tolist()], dtype=np.int64)
            count = np.array([place.blocks[side][c] for c in cell.tolist()], dtype=np.int64)
            mine = first + np.mod(sub, count)
            reachable = place.reachable(unit_rows(to_matrix(table.column("vec"))), other, threshold)
            plain = table.select([f.name for f in kept])
            for column, q in enumerate(sorted(place.sides[other])):
                near = np.nonzero(reachable[:, column])[0]
                if not len(near):
                    continue
                own, copies = mine[near], plain.take(pa.array(near))
                # One target block at a time, so a batch never holds more than one copy.
                for theirs in range(place.offset[other][q], place.offset[other][q] + place.blocks[other][q]):
                    fixed = np.full(len(near), theirs)
                    if self_join:
                        a, b, is_a = np.minimum(own, theirs), np.maximum(own, theirs), own <= theirs
                    else:
                        a, b = (own, fixed) if side == 0 else (fixed, own)
                        is_a = np.full(len(near), side == 0)
                    out = copies.append_column("block_a", pa.array(a.astype(np.int32)))
                    out = out.append_column("block_b", pa.array(b.astype(np.int32)))
                    yield from out.append_column("is_a", pa.array(is_a)).to_batches()

    salted = df.withColumn("sub", F.pmod(F.xxhash64("id"), F.lit(2**31 - 1)).cast("int"))
    return salted.mapInArrow(run, T.StructType([*kept, *extra]))


class Side:
    """One side of a block pair: ids, unit vectors and attribute arrays."""

    def __init__(self, table: pa.Table):
        self.units = unit_rows(to_matrix(table.column("vec")))
        self.attr = {
            name: column_values(table.column(name))
            for name in table.column_names
            if name not in ("vec", "block_a", "block_b", "is_a")
        }

    def __len__(self):
        return len(self.units)

    def rows(self, index) -> dict[str, np.ndarray]:
        return {k: x[index] for k, x in self.attr.items()}


Reducer = Callable[[Side, Side, bool], pa.Table]

# A left side of at most so many rows is sent to the tasks; a larger one is blocked.
SMALL_SIDE = 2048


def _beside_small(left: pa.Table, right: DataFrame, reducer: Reducer, schema: T.StructType) -> DataFrame:
    """Compare a bounded left side with every row of ``right`` where it lies."""
    shared = right.sparkSession.sparkContext.broadcast(left)
    names = schema.names

    def run(batches):
        a = Side(shared.value)
        for batch in batches:
            if batch.num_rows:
                yield from reducer(a, Side(pa.Table.from_batches([batch])), False).select(names).to_batches()

    return right.mapInArrow(run, schema)


def block_pairs(
    left: DataFrame,
    right: DataFrame | None,
    reducer: Reducer,
    schema: T.StructType,
    threshold: float | None = None,
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Run ``reducer`` on every pair of blocks that may hold similar rows.

    Inputs carry ``id`` and ``vec``, plus any attributes the reducer reads. Without
    ``right`` the input meets itself, each unordered block pair once. A threshold at or
    below zero (or none) switches pruning off. A left side of at most ``SMALL_SIDE`` rows
    is compared with the right side in place: the right vectors are not moved or written.
    """
    self_join = right is None
    if not self_join:
        small = left.limit(SMALL_SIDE + 1).toArrow()
        if small.num_rows <= SMALL_SIDE:
            return _beside_small(small, right, reducer, schema)
        if right.isEmpty():
            return right.sparkSession.createDataFrame([], schema)
    prune = threshold is not None and threshold > 0
    placed, place = _placement(left, right, block_rows, prune)
    spread = _spread(placed[0], 0, self_join, place, threshold if prune else None)
    if not self_join:
        other = _spread(placed[1], 1, False, place, threshold if prune else None)
        spread = spread.unionByName(other, allowMissingColumns=True)
    arrow = [f.name for f in schema]

    def run(key, table):
        block_a, block_b = key[0].as_py(), key[1].as_py()
        flags = column_values(table.column("is_a")).astype(bool)
        if self_join and block_a == block_b:
            side = Side(table)
            return reducer(side, side, True).select(arrow)
        a = Side(table.filter(pa.array(flags)))
        b = Side(table.filter(pa.array(~flags)))
        return reducer(a, b, False).select(arrow)

    counts = [sum(b.values()) for b in place.blocks]
    pairs = counts[0] * (counts[0] + 1) // 2 if self_join else counts[0] * counts[1]
    tasks = max(1, min(2 * pairs, MAX_TASKS))
    keys = ["block_a", "block_b"]
    return spread.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, schema)


def pruning_report(reps: DataFrame, threshold: float, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """How much a self join at a threshold is pruned: one row.

    ``meetings`` counts rows times blocks, ``by_angle`` those that the angle bound alone
    would keep, ``kept`` those that remain; ``block_pairs`` and ``block_pairs_kept`` count
    pairs of blocks, the latter those where both blocks have rows for the other.
    """
    placed, place = _placement(reps.select("id", "vec"), None, block_rows, threshold > 0)
    cells = sorted(place.sides[0])
    blocks = np.array([place.blocks[0][c] for c in cells])

    def run(batches):
        for batch in batches:
            units = unit_rows(to_matrix(pa.chunked_array([batch.column("vec")])))
            if not len(units):
                continue
            cell = column_values(batch.column("cell"))
            angle, kept = (place.reachable(units, 0, threshold, both) for both in (False, True))
            for c in np.unique(cell):
                mine = cell == c
                for q, (x, y) in enumerate(zip(angle[mine].sum(0), kept[mine].sum(0))):
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (int(c), cells[q], int(mine.sum() * blocks[q]), int(x * blocks[q]), int(y * blocks[q]))], ["a", "b", "meetings", "by_angle", "kept"])

    rows = placed[0].mapInArrow(run, "a long, b long, meetings long, by_angle long, kept long")
    cell_pairs = rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") <= F.col("b")).alias("up")).agg(*[F.sum(c).alias(c) for c in ("meetings", "by_angle", "kept")])
    numbers = reps.sparkSession.createDataFrame([(int(c), int(n)) for c, n in zip(cells, blocks)] or [(0, 0)], "cell long, n long")
    cell_pairs = cell_pairs.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("meetings", "by_angle", "kept")], F.min("kept").alias("least"))
    pairs = cell_pairs.join(numbers.select(F.col("cell").alias("a"), F.col("n").alias("na")), "a").join(numbers.select(F.col("cell").alias("b"), F.col("n").alias("nb")), "b")
    count = F.when(F.col("a") == F.col("b"), F.expr("na * (na + 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return pairs.agg(total("meetings", "meetings"), total("by_angle", "by_angle"), total("kept", "kept"), total(count, "block_pairs"), total(F.when(F.col("least") > 0, count), "block_pairs_kept"))


def tiles(a: Side, b: Side):
    """Similarity tiles ``(start, stop, S)`` of bounded size."""
    rows = max(1, TILE_CELLS // max(1, len(b)))
    for start in range(0, len(a), rows):
        stop = min(len(a), start + rows)
        if len(b):
            yield start, stop, np.clip(a.units[start:stop] @ b.units.T, -1.0, 1.0)


def pairs_near(a: Side, b: Side, over: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
    """Rows, columns and similarities over ``over``, tile by tile.

    A product in single precision, with room for its rounding, names the pairs; only these,
    and of them those that ``wanted`` marks, are worked out in double precision.
    """
    own, other = a.units.astype(np.float32), np.ascontiguousarray(b.units.astype(np.float32).T)
    room = (own.shape[1] + 8) * 2.0**-23
    rows = max(1, TILE_CELLS // max(1, len(b)))
    for start in range(0, len(a) if len(b) else 0, rows):
        i, j = np.divmod(np.flatnonzero(own[start : start + rows] @ other > np.float32(over - room)), len(b))
        i += start
        if wanted is not None:
            mark = wanted(i, j)
            i, j = i[mark], j[mark]
        parts = [np.einsum("ij,ij->i", a.units[i[k : k + PAIRS_AT_ONCE]], b.units[j[k : k + PAIRS_AT_ONCE]]) for k in range(0, len(i), PAIRS_AT_ONCE)]
        s = np.clip(np.concatenate(parts), -1.0, 1.0) if parts else np.zeros(0)
        hit = s > over
        yield i[hit], j[hit], s[hit]


def single_precision(s: np.ndarray) -> np.ndarray:
    """Round similarities to float32 and widen again, for comparisons at that precision."""
    return s.astype(np.float32).astype(np.float64)


def _above(s: np.ndarray, threshold: float, strict: bool) -> np.ndarray:
    return s > threshold if strict else s >= threshold


# ------------------------------------------------------------------ pairs above a threshold


def _id_pair_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("sim", T.DoubleType())]
    )


def rep_pairs(
    reps: DataFrame,
    threshold: float,
    strict: bool = False,
    single: bool = False,
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of distinct vectors over the threshold, ``id_a < id_b``."""
    schema = _id_pair_schema(reps.schema["id"].dataType)

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        ids_a, ids_b, sims = [], [], []
        for start, stop, s in tiles(a, b):
            s = single_precision(s) if single else s
            hit = _above(s, threshold, strict)
            if same:
                hit &= np.arange(start, stop)[:, None] < np.arange(len(b))[None, :]
            i, j = np.nonzero(hit)
            x, y = a.attr["id"][start + i], b.attr["id"][j]
            flip = x > y
            ids_a.append(np.where(flip, y, x))
            ids_b.append(np.where(flip, x, y))
            sims.append(s[i, j])
        return _pair_table(ids_a, ids_b, sims, schema)

    return block_pairs(reps.select("id", "vec"), None, reduce, schema, threshold, block_rows)


def _pair_table(ids_a, ids_b, sims, schema: T.StructType) -> pa.Table:
    return arrow_table(schema, [ids_a, ids_b, sims])


def arrow_table(schema: T.StructType, columns: Sequence[Sequence[np.ndarray]]) -> pa.Table:
    """An Arrow table of ``schema`` from lists of array pieces, one list per column."""
    out = {}
    for field, parts in zip(schema, columns):
        kind = to_arrow_type(field.dataType)
        parts = [p for p in parts if len(p)]
        out[field.name] = pa.array(np.concatenate(parts), kind, from_pandas=True) if parts else pa.array([], kind)
    return pa.table(out)


def similar_pairs(
    df: DataFrame,
    threshold: float,
    id_col: str = "face_id",
    vec_col: str = "embedding",
    strict: bool = False,
    single: bool = False,
    block_rows: int | None = BLOCK_ROWS,
    copies: str = "spelled",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Pairs of rows over the threshold: ``id_a < id_b, sim``.

    Rows with the same vector (and ``keep`` columns) are compared once, as their
    smallest id. Every pair of rows is listed, copies included. ``copies="linked"`` lists
    pairs of those ids only, and one row per further copy, linking it to its id with
    similarity 1: everything needed to rebuild all pairs, in linear size.
    """
    if threshold <= 0:
        raise ValueError("a similarity join needs a threshold above zero")
    if copies not in ("linked", "spelled"):
        raise ValueError(f"unknown copies mode {copies!r}")
    reps = materialize(collapse_copies(df, id_col, vec_col, keep))
    pairs = rep_pairs(reps, threshold, strict, single, block_rows)
    if reps.where("n > 1").isEmpty():
        return pairs
    members = materialize(copy_members(df, reps, id_col, vec_col, keep))
    ok = (F.lit(1.0) > threshold) if strict else (F.lit(1.0) >= threshold)
    # Vectors without length are similar to nothing.
    zero = reps.where(norm("vec") == 0).select(F.col("id").alias("rep"))
    members_ok = members.join(zero, "rep", "left_anti").where(ok)
    if copies == "linked":
        links = members_ok.where("id <> rep").select(
            F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("sim")
        )
        return pairs.unionByName(links)
    left = members.select(F.col("rep").alias("id_a"), F.col("id").alias("_a"))
    right = members.select(F.col("rep").alias("id_b"), F.col("id").alias("_b"))
    spelled = (
        pairs.join(left, "id_a", "left").join(right, "id_b", "left")
        .select(F.coalesce("_a", "id_a").alias("x"), F.coalesce("_b", "id_b").alias("y"), "sim")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "sim")
    )
    twins = (
        members_ok.alias("l")
        .join(members_ok.alias("r"), (F.col("l.rep") == F.col("r.rep")) & (F.col("l.id") < F.col("r.id")))
        .select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b"), F.lit(1.0).alias("sim"))
    )
    return spelled.unionByName(twins)


def cross_pairs(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Pairs between two sets of ``(id, vec)`` rows with similarity at or over the threshold."""
    schema = T.StructType(
        [
            T.StructField("id_a", left.schema["id"].dataType),
            T.StructField("id_b", right.schema["id"].dataType),
            T.StructField("sim", T.DoubleType()),
        ]
    )

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        ids_a, ids_b, sims = [], [], []
        for start, _, s in tiles(a, b):
            i, j = np.nonzero(s >= threshold)
            ids_a.append(a.attr["id"][start + i])
            ids_b.append(b.attr["id"][j])
            sims.append(s[i, j])
        return _pair_table(ids_a, ids_b, sims, schema)

    return block_pairs(left.select("id", "vec"), right.select("id", "vec"), reduce, schema, threshold, block_rows)


# ------------------------------------------------------------------ reducers that stay small


def rows_with_partner(reps: DataFrame, threshold: float, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Distinct ids that have at least one partner at or over the threshold."""
    schema = T.StructType([T.StructField("id", reps.schema["id"].dataType)])

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        row, col = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for start, stop, s in tiles(a, b):
            hit = s >= threshold
            if same:
                hit[np.arange(stop - start), np.arange(start, stop)] = False
            row[start:stop] |= hit.any(axis=1)
            col |= hit.any(axis=0)
        return arrow_table(schema, [[a.attr["id"][row], b.attr["id"][col]]])

    found = block_pairs(reps.select("id", "vec"), None, reduce, schema, threshold, block_rows)
    copies = reps.where((F.col("n") > 1) & (norm("vec") > 0)).select("id")
    return found.unionByName(copies).distinct()


def closest_pairs(reps: DataFrame, top: int, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """The ``top`` most similar pairs; each block pair sends only its own best ones."""
    schema = _id_pair_schema(reps.schema["id"].dataType)

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        best: list[tuple] = []
        for start, stop, s in tiles(a, b):
            if same:
                s = np.where(np.arange(start, stop)[:, None] < np.arange(len(b))[None, :], s, -2.0)
            flat = s.ravel()
            k = min(top, flat.size)
            # Keep everything level with the k-th value so ties are settled globally.
            cut = np.partition(flat, flat.size - k)[flat.size - k]
            i, j = np.nonzero((s >= cut) & (s > -2.0))
            x, y = a.attr["id"][start + i], b.attr["id"][j]
            best += list(zip(s[i, j].tolist(), np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
            best = sorted(best, key=lambda r: (-r[0], r[1], r[2]))[:top]
        return _pair_table(
            [np.array([r[1] for r in best])] if best else [],
            [np.array([r[2] for r in best])] if best else [],
            [np.array([r[0] for r in best])] if best else [],
            schema,
        )

    found = block_pairs(reps.select("id", "vec"), None, reduce, schema, None, block_rows)
    return found.orderBy(F.col("sim").desc(), "id_a", "id_b").limit(top)


Stratify = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def _attr_groups(side: Side, attrs: Sequence[str]) -> list[np.ndarray] | None:
    """Row numbers by equal attributes; none if there are too many groups to gain from them."""
    if not attrs or not len(side):
        return [np.arange(len(side))]
    at = np.zeros(len(side), np.int64)
    for c in attrs:
        values, own = np.unique(side.attr[c], return_inverse=True)
        at = np.unique(at * len(values) + own.ravel(), return_inverse=True)[1].ravel()
    if at.max() >= MAX_GROUPS:
        return None
    order = np.argsort(at, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(at[order])) + 1)


def strata_tiles(a: Side, b: Side, same: bool, attrs: Sequence[str], stratify: Stratify, apart: str | None):
    """``(stratum, similarities, weights)`` of the row pairs, tile by tile; no weights where all are 1.

    Rows are grouped by attributes, so that a tile has one stratum and none is worked out
    per pair. With very many groups the strata of a tile are worked out and taken apart.
    """
    by_a = _attr_groups(a, attrs)
    by_b = by_a if same else _attr_groups(b, attrs)
    grouped = by_a is not None and by_b is not None
    if not grouped:
        by_a, by_b = [np.arange(len(a))], [np.arange(len(b))]
    n_a, n_b = a.attr["n"].astype(float), b.attr["n"].astype(float)
    plain = bool((n_a == 1).all() and (n_b == 1).all())
    for p, rows in enumerate(by_a):
        for q in range(p if same else 0, len(by_b)):
            cols = by_b[q]
            if not len(rows) or not len(cols):
                continue
            theirs = {k: x[cols][None, :] for k, x in b.attr.items()}
            if grouped:
                code = int(np.ravel(stratify({k: x[rows[:1], None] for k, x in a.attr.items()}, {k: x[:, :1] for k, x in theirs.items()}))[0])
                if code < 0:
                    continue
            units, step = b.units[cols].T, max(1, STRATA_CELLS // len(cols))
            for start in range(0, len(rows), step):
                own = rows[start : start + step]
                s = np.clip(a.units[own] @ units, -1.0, 1.0)
                keep = None
                if same and p == q:
                    keep = np.arange(start, start + len(own))[:, None] < np.arange(len(cols))[None, :]
                if apart is not None:
                    other = a.attr[apart][own, None] != b.attr[apart][cols][None, :]
                    keep = other if keep is None else keep & other
                weight = None if plain else n_a[own, None] * n_b[cols][None, :]
                if grouped:
                    parts = [(code, keep)]
                else:
                    codes = np.broadcast_to(stratify({k: x[own, None] for k, x in a.attr.items()}, theirs), s.shape)
                    parts = [(int(c), (codes == c) if keep is None else keep & (codes == c)) for c in np.unique(codes) if c >= 0]
                for c, mask in parts:
                    if mask is None or mask.all():
                        yield c, s.ravel(), None if weight is None else weight.ravel()
                    else:
                        yield c, s[mask], None if weight is None else weight[mask]
    if same and len(a) and apart is None and not plain:
        # Pairs among the copies behind one row.
        own = {k: x[:, None] for k, x in a.attr.items()}
        codes = np.broadcast_to(stratify(own, own), (len(a), 1)).ravel()
        whole = np.sign((a.units * a.units).sum(axis=1)).clip(0, 1)
        for c in np.unique(codes[codes >= 0]):
            mine = codes == c
            yield int(c), whole[mine], (n_a * (n_a - 1) / 2)[mine]


def _count_pairs(
    reps: DataFrame, attrs: Sequence[str], stratify: Stratify, bin_of: Callable[[np.ndarray, int], np.ndarray], bins: int,
    right: DataFrame | None, block_rows: int | None, at_least: float | None, apart: str | None = None,
) -> DataFrame:
    """Number of row pairs per ``(stratum, bin)``; ``bin_of`` takes similarities and their stratum."""
    schema = T.StructType(
        [
            T.StructField("stratum", T.IntegerType()),
            T.StructField("bin", T.IntegerType()),
            T.StructField("pairs", T.LongType()),
        ]
    )
    grouped = [c for c in attrs if c != apart]

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        totals: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def add(code, found, weight=None):
            total = totals.setdefault(code, np.zeros(bins, np.int64))
            total += np.rint(np.bincount(found, weights=weight, minlength=bins)).astype(np.int64)

        for code, s, weight in strata_tiles(a, b, same, grouped, stratify, apart):
            found = bin_of(s, code)
            if len(found) and found.min() < 0:
                keep = found >= 0
                found, weight = found[keep], None if weight is None else weight[keep]
            if weight is not None:
                add(code, found, weight)
                continue
            waiting.setdefault(code, []).append(found.astype(np.int32))
            if sum(map(len, waiting[code])) >= max(STRATA_CELLS, bins):
                add(code, np.concatenate(waiting.pop(code)))
        for code, parts in waiting.items():
            add(code, np.concatenate(parts))
        at = {code: np.flatnonzero(total) for code, total in totals.items()}
        return arrow_table(
            schema,
            [
                [np.full(len(k), code, np.int32) for code, k in at.items()],
                [k.astype(np.int32) for k in at.values()],
                [totals[code][k] for code, k in at.items()],
            ],
        )

    cols = list(dict.fromkeys(["id", "vec", "n", *attrs, *([apart] if apart else [])]))
    parts = block_pairs(
        reps.select(*cols), None if right is None else right.select(*cols), reduce, schema, at_least, block_rows
    )
    return parts.groupBy("stratum", "bin").agg(F.sum("pairs").alias("pairs"))


def binned_counts(
    reps: DataFrame,
    attrs: Sequence[str],
    stratify: Stratify,
    strata: int,
    bin_of: Callable[[np.ndarray], np.ndarray],
    bins: int,
    right: DataFrame | None = None,
    block_rows: int | None = BLOCK_ROWS,
    at_least: float | None = None,
) -> DataFrame:
    """Number of row pairs per ``(stratum, bin)``, weighted by copy multiplicities.

    ``stratify`` maps attribute arrays shaped (rows, 1) and (1, cols) to stratum codes;
    pairs with a negative code are left out. ``bin_of`` maps similarities to bin codes,
    negative meaning left out. ``at_least`` promises that lower similarities are not
    wanted, so that blocks too far apart need not meet.
    """
    return _count_pairs(reps, attrs, stratify, lambda s, _: bin_of(s), bins, right, block_rows, at_least)


def threshold_bins(thresholds: Sequence[float]) -> tuple[Callable, int]:
    """Bin code = how many of the (sorted) thresholds a similarity reaches."""
    edges = np.array(sorted(thresholds), dtype=np.float64)
    return (lambda s: np.searchsorted(edges, s, side="right")), len(edges) + 1


# ------------------------------------------------------------------ exact quantiles of similarities


def _ordered_bits(s: np.ndarray) -> np.ndarray:
    """float32 bit patterns mapped to unsigned integers in value order."""
    bits = (s.astype(np.float32) + np.float32(0.0)).view(np.int32)
    return (bits ^ ((bits >> 31) | np.int32(-(2**31)))).view(np.uint32)


# Low bits of a similarity's pattern that the second pass counts.
LOW_BITS = 12


def _from_ordered(code: int) -> float:
    bits = code - 2**31 if code >= 2**31 else 2**32 - 1 - code
    return float(np.array([bits], dtype=np.uint32).view(np.float32)[0])


def quantile_rank(p, n: int, rule) -> int:
    """0-based position of quantile ``p``: ``floor(p*n)``, ``floor(p*(n-1))``, or ``rule(p, n)``."""
    if callable(rule):
        return rule(p, n)
    if rule == "n":
        return min(n - 1, max(0, math.floor(p * n)))
    if rule == "n-1":
        return math.floor(p * (n - 1))
    raise ValueError(f"unknown quantile rule {rule!r}")


def _at_ranks(counts: DataFrame, groups: list[str], wanted: list[tuple], kinds: list[str]) -> list:
    """The bin of each wanted rank of its group, and the rank inside the bin."""
    names = [*groups, "p", "rank"]
    asked = counts.sparkSession.createDataFrame(wanted, ", ".join(f"{n} {k}" for n, k in zip(names, [*kinds, "int", "long"])))
    upto = F.sum("pairs").over(Window.partitionBy(*groups).orderBy("bin"))
    rows = counts.withColumn("upto", upto).join(F.broadcast(asked), groups)
    hit = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("pairs") <= F.col("rank"))
    return rows.where(hit).select(*groups, "p", "bin", (F.col("rank") - F.col("upto") + F.col("pairs")).alias("rest")).collect()


def similarity_quantiles(
    reps: DataFrame,
    attrs: Sequence[str],
    stratify: Stratify,
    strata: int,
    probabilities: Sequence,
    rule="n",
    right: DataFrame | None = None,
    block_rows: int | None = BLOCK_ROWS,
    apart: str | None = None,
) -> dict[int, tuple[int, dict[float, float]]]:
    """Exact quantiles of all pair similarities per stratum, at float32 resolution.

    Two counting passes over the block pairs: the high bits of the ordered bit pattern
    locate the bin of each requested rank, the low bits pick the value inside it. No
    pair is ever written out, and Spark looks the ranks up in the counts. Returns
    ``{stratum: (n, {p: value})}``; the driver only sees sizes and the bins asked for.
    Pairs that share the attribute ``apart`` are left out.
    """
    low = 1 << LOW_BITS
    high = materialize(
        _count_pairs(reps, attrs, stratify, lambda s, _: (_ordered_bits(s) >> LOW_BITS).astype(np.int64), 2**32 >> LOW_BITS, right, block_rows, None, apart)
    )
    sizes = {r["stratum"]: r["n"] for r in high.groupBy("stratum").agg(F.sum("pairs").alias("n")).collect()}
    if not sizes:
        return {}
    ranks = [(c, i, quantile_rank(p, n, rule)) for c, n in sizes.items() for i, p in enumerate(probabilities)]
    found = _at_ranks(high, ["stratum"], ranks, ["int"])
    bins: dict[int, list[int]] = {c: sorted({r["bin"] for r in found if r["stratum"] == c}) for c in sizes}
    # Place of a high half among those asked for in its stratum, or -1.
    listed = {c: np.array(b, np.int64) for c, b in bins.items()}

    def bin_of(s: np.ndarray, code: int) -> np.ndarray:
        bits = _ordered_bits(s)
        top, own = (bits >> LOW_BITS).astype(np.int64), listed[code]
        at = np.minimum(np.searchsorted(own, top), len(own) - 1)
        return np.where(own[at] == top, at * low + (bits & (low - 1)), -1)

    most = max(map(len, bins.values()))
    fine = _count_pairs(reps, attrs, stratify, bin_of, most * low, right, block_rows, None, apart)
    fine = materialize(fine.withColumn("place", F.floor(F.col("bin") / low).cast("int")))
    inside = [(r["stratum"], bins[r["stratum"]].index(r["bin"]), r["p"], r["rest"]) for r in found]
    out: dict[int, tuple[int, dict[float, float]]] = {c: (n, {}) for c, n in sizes.items()}
    for r in _at_ranks(fine, ["stratum", "place"], inside, ["int", "int"]):
        code = (bins[r["stratum"]][r["place"]] << LOW_BITS) + r["bin"] % low
        out[r["stratum"]][1][probabilities[r["p"]]] = _from_ordered(code)
    return out


# ------------------------------------------------------------------ pairs inside groups

GROUP_CHUNK = 1024


def group_pairs(
    left: DataFrame,
    right: DataFrame | None,
    reducer: Reducer,
    schema: T.StructType,
    chunk: int = GROUP_CHUNK,
) -> DataFrame:
    """Run ``reducer`` on rows that share ``group``, within bounded chunks.

    Inputs carry ``id``, ``vec``, ``group`` and attributes. Groups up to ``chunk`` rows
    share tasks; a larger group is cut into chunks that meet pairwise, so no task ever
    holds more than two chunks of one group. Without ``right`` a group meets itself.
    """
    self_join = right is None
    sides = [left] if self_join else [left, right]
    counts = None
    for i, s in enumerate(sides):
        c = s.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(f"_k{i}"))
        counts = c if counts is None else counts.join(c, "group")
    if self_join:
        counts = counts.withColumn("_k1", F.col("_k0"))
    # One pack of small groups holds about as many rows as two chunks.
    total = sides[0].count()
    packs = max(8, total // (2 * chunk) + 1)
    small = (F.col("_k0") == 1) & (F.col("_k1") == 1)
    pack = F.when(small, F.pmod(F.xxhash64("group"), F.lit(packs))).otherwise(packs + F.pmod(F.xxhash64("group"), F.lit(2**40)))
    parts = []
    for i, s in enumerate(sides):
        own = F.pmod(F.xxhash64("id"), F.col(f"_k{i}")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(f"_k{1 - i}") - 1))
        rows = s.join(counts, "group").select(*s.columns, pack.alias("pack"), own.alias("_own"), other.alias("_other"))
        if self_join:
            keyed = rows.select(
                *s.columns, "pack", F.least("_own", "_other").alias("block_a"),
                F.greatest("_own", "_other").alias("block_b"), (F.col("_own") <= F.col("_other")).alias("is_a"),
            )
        else:
            a, b = ("_own", "_other") if i == 0 else ("_other", "_own")
            keyed = rows.select(
                *s.columns, "pack", F.col(a).alias("block_a"), F.col(b).alias("block_b"), F.lit(i == 0).alias("is_a")
            )
        parts.append(keyed)
    keyed = parts[0] if self_join else parts[0].unionByName(parts[1], allowMissingColumns=True)
    arrow = [f.name for f in schema]

    def run(key, table):
        same = self_join and key[1].as_py() == key[2].as_py()
        table = table.drop_columns(["pack"]).sort_by("group")
        group = column_values(table.column("group"))
        cuts = np.nonzero(group[1:] != group[:-1])[0] + 1
        out = []
        for start, stop in zip([0, *cuts], [*cuts, len(group)]):
            part = table.slice(start, stop - start)
            if same:
                if len(part) > 1 or "n" in part.column_names:
                    side = Side(part)
                    out.append(reducer(side, side, True).select(arrow))
                continue
            flags = column_values(part.column("is_a")).astype(bool)
            if flags.all() or not flags.any():
                continue
            out.append(reducer(Side(part.filter(pa.array(flags))), Side(part.filter(pa.array(~flags))), False).select(arrow))
        return pa.concat_tables(out) if out else arrow_table(schema, [[] for _ in schema])

    return keyed.groupBy("pack", "block_a", "block_b").applyInArrow(run, schema)
