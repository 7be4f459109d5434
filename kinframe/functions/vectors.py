"""Vector expressions on array columns. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(v) -> Column:
    """Unit vector; a zero vector stays zero."""
    v = _col(v)
    length = norm(v)
    return F.when(
        length > 0, F.transform(v, lambda x: x.cast("double") / length)
    ).otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_dim(df: DataFrame, vec: str = "embedding") -> int:
    """The one length of all vectors in ``df`` (0 when there are none); lengths must agree."""
    size = F.size(vec)
    low, high = df.where(F.col(vec).isNotNull()).agg(F.min(size), F.max(size)).first()
    if low != high:
        raise ValueError(f"vectors of different lengths in {vec}: {low} to {high}")
    return low or 0


def centroids(
    df: DataFrame,
    by: Sequence[str],
    vec: str = "embedding",
    normalize: bool = False,
    dim: int | None = None,
) -> DataFrame:
    """Element-wise mean per group: ``by..., n, centroid``.

    One sum per component keeps the work in the map-side hash aggregate, so a group
    holding most of the rows reaches the shuffle as one row per input partition.
    """
    by = list(by)
    rows = df.where(F.col(vec).isNotNull())
    dim = dim if dim is not None else vector_dim(df, vec)
    sums = [F.sum(F.get(F.col(vec), F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(dim)]
    grouped = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    mean = F.array(*[F.col(f"_s{i}") / F.col("n") for i in range(dim)]).cast("array<double>")
    out = grouped.select(*by, "n", mean.alias("centroid"))
    if normalize:
        out = out.withColumn("centroid", l2_normalize("centroid"))
    return out
