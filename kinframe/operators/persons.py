"""Diagnostics of persons and their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.vectors import centroids, cosine, dot, l2_normalize, vector_dim
from kinframe.operators.pairs import (
    BLOCK_ROWS,
    binned_counts,
    closest_pairs,
    collapse_copies,
    copy_members,
    rep_pairs,
    rows_with_partner,
    similarity_quantiles,
    threshold_bins,
)
from kinframe.operators.ranking import rank_in_group
from kinframe.session import materialize

# Integer size bands of a face side, largest first.
WHOLE_PIXEL_BANDS = [(101, ">100"), (65, "64-100"), (33, "32-64"), (21, "20-32"), (1, "<20")]


def band(side: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    out = None
    for low, name in bands:
        out = F.when(side >= low, name) if out is None else out.when(side >= low, name)
    return out.otherwise(otherwise)


def _embedded(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("embedding").isNotNull())


def mean_sim_to_first(faces: DataFrame, limit: int = 50) -> DataFrame:
    """Cohesion per person: mean similarity of its next faces to its first one."""
    rows = _embedded(faces).where(F.col("person_id").isNotNull()).select("person_id", "face_order", "embedding")
    ranked = rank_in_group(rows, ["person_id"], ["face_order"]).where(F.col("rn") <= limit)
    first = ranked.where("rn = 1").select("person_id", F.col("embedding").alias("_first"))
    return (
        ranked.where("rn > 1").join(first, "person_id")
        .groupBy("person_id")
        .agg(F.count(F.lit(1)).alias("compared"), F.avg(cosine("embedding", "_first")).alias("mean_sim"))
    )


def person_centroids(faces: DataFrame, normalize: bool = False) -> DataFrame:
    return centroids(faces.where(F.col("person_id").isNotNull()), ["person_id"], normalize=normalize)


def _centroid_reps(faces: DataFrame) -> DataFrame:
    return materialize(
        person_centroids(faces).select(
            F.col("person_id").alias("id"), F.col("centroid").alias("embedding"), F.col("n").alias("faces")
        )
    )


def closest_person_pairs(faces: DataFrame, top: int = 30, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Person pairs with the most similar centroids."""
    means = _centroid_reps(faces)
    rows = means.select("id", F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("n"))
    return closest_pairs(rows, top, block_rows).select(
        F.col("id_a").alias("person_a"), F.col("id_b").alias("person_b"), "sim"
    )


def grey_zone(faces: DataFrame, low: float = 0.45, high: float = 0.55, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Person pairs whose centroid similarity lies between the two bounds."""
    means = _centroid_reps(faces)
    pairs = rep_pairs(means.select("id", F.col("embedding").alias("vec")), low, block_rows=block_rows)
    size = means.select("id", "faces")
    return (
        pairs.where(F.col("sim") <= high)
        .join(size.select(F.col("id").alias("id_a"), F.col("faces").alias("faces_a")), "id_a")
        .join(size.select(F.col("id").alias("id_b"), F.col("faces").alias("faces_b")), "id_b")
        .select(F.col("id_a").alias("person_a"), F.col("id_b").alias("person_b"), "faces_a", "faces_b", "sim")
    )


def person_pair_detail(faces: DataFrame, a, b, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Face-to-face similarities of two persons: max, p90, mean, min and counts.

    The mean follows from the two vector sums; the order statistics come from counting
    passes, so the face pairs themselves are never written out.
    """
    rows = _embedded(faces)
    sides = [
        materialize(collapse_copies(rows.where(F.col("person_id") == p), "face_id", "embedding")) for p in (a, b)
    ]
    both = rows.where(F.col("person_id").isin(a, b)).withColumn("embedding", l2_normalize("embedding"))
    sums = centroids(both, ["person_id"])
    one = lambda p, tag: sums.where(F.col("person_id") == p).select(
        F.lit(1).alias("_one"), F.col("n").alias(f"faces_{tag}"), F.col("centroid").alias(f"_{tag}")
    )
    mean = one(a, "a").join(one(b, "b"), "_one").select(
        "faces_a", "faces_b", dot("_a", "_b").alias("mean_sim"), F.lit(1).alias("_one")
    )
    zero = lambda x, y: (x["n"] * 0).astype(int)
    stats = similarity_quantiles(
        sides[0], [], zero, 1, ["max", "p90", "min"], rule=_pair_detail_rank, right=sides[1], block_rows=block_rows
    )
    n, values = stats.get(0, (0, {}))
    cuts = [0.45, 0.5]
    bin_of, bins = threshold_bins(cuts)
    counts = binned_counts(sides[0], [], zero, 1, bin_of, bins, sides[1], block_rows).agg(
        F.coalesce(F.sum(F.when(F.col("bin") >= 2, F.col("pairs"))), F.lit(0)).cast("long").alias("at_050"),
        F.coalesce(F.sum(F.when(F.col("bin") >= 1, F.col("pairs"))), F.lit(0)).cast("long").alias("at_045"),
    )
    return mean.join(counts.withColumn("_one", F.lit(1)), "_one").select(
        F.lit(a).alias("person_a"), F.lit(b).alias("person_b"), "faces_a", "faces_b",
        F.lit(n).cast("long").alias("pairs"),
        *[F.lit(values.get(k)).cast("double").alias(f"{k}_sim") for k in ("max", "p90", "min")],
        "mean_sim", "at_050", "at_045",
    )


def _pair_detail_rank(p: str, n: int) -> int:
    """Positions in ascending order; p90 is counted from the top."""
    return {"max": n - 1, "p90": max(0, n - 1 - int(n * 0.1)), "min": 0}[p]


def co_occurrence(faces: DataFrame, photos: DataFrame, a, b) -> DataFrame:
    """Photos showing both persons."""
    def seen(p):
        return faces.where(F.col("person_id") == p).select("photo_id").distinct()

    both = seen(a).join(seen(b), "photo_id", "left_semi")
    return photos.join(both, "photo_id", "left_semi").select("photo_id", "path")


def cluster_vs_main(faces: DataFrame, identity: str = "true_label") -> DataFrame:
    """How close each smaller cluster of an identity lies to its largest cluster."""
    rows = _embedded(faces).where(F.col("person_id").isNotNull() & F.col(identity).isNotNull())
    rows = rows.select(F.col(identity).alias("identity"), "person_id", "face_id", "embedding")
    means = materialize(centroids(rows, ["identity", "person_id"]))
    main = means.groupBy("identity").agg(
        F.min(F.struct((-F.col("n")).alias("s"), "person_id", F.col("centroid").alias("c"))).alias("m")
    ).select("identity", F.col("m.person_id").alias("main_person"), F.col("m.c").alias("main_centroid"))
    return (
        rows.join(main, "identity")
        .where(F.col("person_id") != F.col("main_person"))
        .groupBy("identity", "person_id", "main_person")
        .agg(F.count(F.lit(1)).alias("faces"), F.avg(cosine("embedding", "main_centroid")).alias("mean_sim"))
    )


def useful_faces(faces: DataFrame, threshold: float = 0.5, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Embedded faces with at least one other face at the threshold, per size band."""
    rows = _embedded(faces)
    reps = materialize(collapse_copies(rows, "face_id", "embedding"))
    useful = materialize(rows_with_partner(reps, threshold, block_rows))
    copies = copy_members(rows, reps, "face_id", "embedding").join(
        useful.withColumnRenamed("id", "rep"), "rep", "left_semi"
    )
    matched = useful.unionByName(copies.select("id")).distinct().withColumnRenamed("id", "face_id")
    side = F.col("x2") - F.col("x1")
    flagged = rows.select("face_id", band(side, WHOLE_PIXEL_BANDS, "?").alias("bucket")).join(
        matched.withColumn("_hit", F.lit(True)), "face_id", "left"
    )
    return flagged.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("embedded"),
        F.count("_hit").alias("has_match"),
        F.count_if(F.col("_hit").isNull()).alias("no_match"),
    )


def embedding_drift(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Cosine between two versions of each face's vector."""
    a = _embedded(stored).select(*keys, F.col("embedding").alias("_a"))
    b = _embedded(fresh).select(*keys, F.col("embedding").alias("_b"))
    return a.join(b, keys).select(*keys, cosine("_a", "_b").alias("sim"))


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(F.count(F.lit(1)).alias("faces"), F.avg("sim").alias("mean_sim"), F.min("sim").alias("min_sim"))


def intra_inter_means(faces: DataFrame, label: str = "true_label") -> DataFrame:
    """Mean similarity inside each label, and across labels, without forming pairs.

    With unit vectors the similarities of all pairs add up to
    ``(|sum|^2 - sum(|v|^2)) / 2``.
    """
    rows = _embedded(faces).where(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), l2_normalize("embedding").alias("embedding")
    )
    rows = rows.withColumn("_self", dot("embedding", "embedding"))
    dim = vector_dim(rows)
    sums = [F.sum(F.get("embedding", F.lit(i))).alias(f"_s{i}") for i in range(dim)]
    per = materialize(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("_self").alias("own"), *sums))
    square = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(dim)), F.lit(0.0))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    inside = per.select(
        F.lit("intra").alias("kind"), F.col("label").cast("string").alias("label"), pairs.cast("long").alias("pairs"),
        F.when(pairs > 0, (square - F.col("own")) / 2 / pairs).alias("mean_sim"),
    )
    total = per.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(square).alias("within"),
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(dim)],
    )
    across = (F.col("n") * F.col("n") - F.col("nn")) / 2
    outside = total.select(
        F.lit("inter").alias("kind"), F.lit("all").alias("label"), across.cast("long").alias("pairs"),
        F.when(across > 0, (square - F.col("within")) / 2 / across).alias("mean_sim"),
    )
    return inside.unionByName(outside)
