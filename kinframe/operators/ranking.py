"""Ordering inside groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 1024


def _bounds(df: DataFrame, order: Sequence[str], pieces: int) -> list:
    """Split points over the order columns, from a fixed-size hash sample of the rows."""
    rows = (
        df.select(*order)
        .orderBy(F.xxhash64(*order))
        .limit(SAMPLE_ROWS)
        .collect()
    )
    keys = sorted({tuple(r) for r in rows if all(v is not None for v in r)})
    step = max(1, len(keys) // pieces)
    return keys[step::step][: pieces - 1]


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rn",
    descending: bool = False,
    pieces: int = 32,
) -> DataFrame:
    """``row_number()`` per group (or over the whole table when ``keys`` is empty).

    Rows are cut into ranges of the order columns; each (group, range) is ranked on its
    own and shifted by the sizes of the ranges before it. The split points only decide
    how the work is spread, never the result. ``order`` must end in a unique column and
    may not contain nulls.
    """
    keys, order = list(keys), list(order)
    probe = F.struct(*[F.col(c) for c in order])
    piece = F.lit(0)
    for bound in _bounds(df, order, pieces):
        here = F.struct(
            *[F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(bound, order)]
        )
        piece = piece + (probe >= here).cast("int")
    if descending:
        piece = -piece
    cut = df.withColumn("_piece", piece)

    counts = cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    local = cut.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*direction))
    )
    joined = local.alias("l").join(
        offsets.alias("o"),
        [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_piece"]],
    )
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("_before") + F.col("_local")).cast("long").alias(name),
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The row that sorts first in each group, by partial aggregation instead of a sort.

    ``order`` holds columns or expressions; the smallest tuple wins.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
