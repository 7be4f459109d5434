"""Box, landmark and quality-tier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tier order, worst last.
TIERS = ["high", "medium", "low", "very_low"]


def width() -> Column:
    return F.col("x2") - F.col("x1")


def height() -> Column:
    return F.col("y2") - F.col("y1")


def long_side() -> Column:
    return F.greatest(width(), height())


def short_side() -> Column:
    return F.least(width(), height())


def round_half_up(value: Column) -> Column:
    """``floor(x + 0.5)``: halves go up for negative numbers as well."""
    return F.floor(value + 0.5)


def iou(a: str, b: str, pixel: float = 0.0) -> Column:
    """Overlap of the boxes in struct columns ``a`` and ``b``.

    ``pixel=1`` counts border pixels (inclusive coordinates); 0 is the plain area.
    """
    def area(s):
        return (F.col(f"{s}.x2") - F.col(f"{s}.x1") + pixel) * (F.col(f"{s}.y2") - F.col(f"{s}.y1") + pixel)

    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1")) + pixel)
    h = F.greatest(zero, F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1")) + pixel)
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def kp(i: int, axis: str) -> Column:
    """Landmark ``i`` (right eye, left eye, nose, right mouth, left mouth)."""
    return F.get(F.col("kps"), F.lit(i))[axis]


def eye_distance() -> Column:
    return F.hypot(kp(0, "x") - kp(1, "x"), kp(0, "y") - kp(1, "y"))


def tier_name(ordinal: Column) -> Column:
    names = F.array(*[F.lit(t) for t in TIERS])
    return F.get(names, F.least(F.lit(len(TIERS) - 1), F.greatest(F.lit(0), ordinal)).cast("int"))


def tier_ordinal(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier).cast("int") - 1


def lower_tier(tier: Column, steps: Column) -> Column:
    return tier_name(tier_ordinal(tier) + steps)
