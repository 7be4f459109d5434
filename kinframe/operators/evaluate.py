"""Evaluation of clusterings and similarity thresholds against known labels.

Counts over pairs are derived from group sizes wherever the pair's own similarity is
not needed: a group of n rows holds n(n-1)/2 pairs, so agreement between two
groupings follows from a contingency table. Where similarities are needed they are
counted inside the tasks that compute them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.functions import boxes as bx
from kinframe.functions.vectors import cosine
from kinframe.operators.cluster import LOW_JOIN, cluster_running_average
from kinframe.operators.merge_tree import MergeForest
from kinframe.operators.pairs import (
    BLOCK_ROWS,
    Side,
    arrow_table,
    binned_counts,
    collapse_copies,
    group_pairs,
    similar_pairs,
    similarity_quantiles,
    threshold_bins,
    tiles,
)
from kinframe.operators.persons import band
from kinframe.operators.ranking import rank_in_group
from kinframe.session import materialize

# Thresholds swept by default, quantiles shown, crop match level, and the
# two sets of size bands.
THRESHOLDS = [0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65]
QUANTILES = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
CROP_MATCH_SIM = 0.6
FRAME_IOU = 0.5
QUALITY_BANDS = [(64, "64-100"), (32, "32-64"), (20, "20-32")]
HALF_PIXEL_BANDS = [(100.5, ">100"), (64.5, "64-100"), (32.5, "32-64"), (20.5, "20-32"), (1, "<20")]
BUCKET_ORDER = ["<20", "20-32", "32-64", "64-100", ">100"]


def size_bucket(side: Column, edges: str = "quality") -> Column:
    """Size band of a face side; ``edges`` picks the boundary set."""
    if edges == "quality":
        return F.when(side > 100, ">100").otherwise(band(side, QUALITY_BANDS, "<20"))
    if edges == "half_pixel":
        return band(side, HALF_PIXEL_BANDS, "?")
    raise ValueError(f"unknown size edges {edges!r}")


def quality_pair(a: Column, b: Column) -> Column:
    """Ordered label of two tiers, best first."""
    x, y = bx.tier_ordinal(a), bx.tier_ordinal(b)
    return F.concat_ws("-", bx.tier_name(F.least(x, y)), bx.tier_name(F.greatest(x, y)))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _choose2(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


# ------------------------------------------------------------------ labels


def parse_identity(path: Column, pattern: str) -> Column:
    """First capture group of ``pattern`` in the path; null when absent."""
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found)


def subjects(faces: DataFrame, label: str = "label", keep_ties: bool = False) -> DataFrame:
    """The largest labelled face of each photo; it carries the photo's label."""
    rows = faces.where(F.col(label).isNotNull()).withColumn("side", bx.long_side())
    if keep_ties:
        top = rows.groupBy("photo_id").agg(F.max("side").alias("side"))
        return rows.join(top, ["photo_id", "side"], "left_semi")
    top = rows.groupBy("photo_id").agg(F.min(F.struct((-F.col("side")).alias("s"), "face_order")).alias("m"))
    winners = top.select("photo_id", F.col("m.face_order").alias("face_order"))
    return rows.join(winners, ["photo_id", "face_order"], "left_semi")


def propagate_labels(crops: DataFrame, faces: DataFrame, threshold: float = CROP_MATCH_SIM) -> DataFrame:
    """Faces close to a crop of their own folder's label: ``face_id, label``.

    ``crops(id, label, embedding)`` are labelled; ``faces(face_id, folder_label,
    embedding)`` only know their folder.
    """
    schema = T.StructType([T.StructField("face_id", faces.schema["face_id"].dataType)])

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        hit = np.zeros(len(a), bool)
        for start, stop, s in tiles(a, b):
            hit[start:stop] = (s >= threshold).any(axis=1)
        return arrow_table(schema, [[a.attr["id"][hit]]])

    left = faces.where(F.col("embedding").isNotNull()).select(
        F.col("face_id").alias("id"), F.col("embedding").alias("vec"), F.col("folder_label").cast("string").alias("group")
    ).where(F.col("group").isNotNull())
    right = crops.where(F.col("embedding").isNotNull()).select(
        "id", F.col("embedding").alias("vec"), F.col("label").cast("string").alias("group")
    )
    matched = group_pairs(left, right, reduce, schema).distinct()
    return faces.join(matched, "face_id", "left_semi").select("face_id", F.col("folder_label").alias("label"))


# ------------------------------------------------------------------ pair data


def pair_dataset(
    faces: DataFrame, min_sim: float, label: str = "label", block_rows: int | None = BLOCK_ROWS, copies: str = "spelled"
) -> DataFrame:
    """Labelled face pairs at or over ``min_sim`` with kind, tiers and size band.

    Every pair is listed with the attributes of both faces; ``copies="linked"`` lists
    faces with the same vector and label by the first of them only. Totals over all pairs
    come from ``pair_counts``; lower similarities only matter as counts, which
    ``sim_distribution`` and ``threshold_sweep`` take without listing them.
    """
    rows = materialize(
        faces.where(F.col("embedding").isNotNull() & F.col(label).isNotNull()).select(
            "face_id", "photo_id", F.col(label).alias("label"), "face_quality", bx.long_side().alias("side"), "embedding"
        )
    )
    pairs = similar_pairs(rows, min_sim, block_rows=block_rows, copies=copies, keep=["label"])
    slim = rows.drop("embedding")

    def tagged(tag):
        return slim.select(*[F.col(c).alias(f"{'id' if c == 'face_id' else c}_{tag}") for c in slim.columns])

    joined = pairs.join(tagged("a"), "id_a").join(tagged("b"), "id_b")
    return joined.select(
        "id_a", "id_b", "sim",
        F.when(F.col("label_a") == F.col("label_b"), "same").otherwise("diff").alias("kind"),
        (F.col("photo_id_a") != F.col("photo_id_b")).alias("cross_photo"),
        quality_pair(F.col("face_quality_a"), F.col("face_quality_b")).alias("q_pair"),
        size_bucket(F.least("side_a", "side_b")).alias("size_bucket"),
    )


def pair_counts(faces: DataFrame, label: str = "label") -> DataFrame:
    """How many same-label and different-label pairs there are, across and within photos."""
    rows = faces.where(F.col("embedding").isNotNull() & F.col(label).isNotNull())
    cell = rows.groupBy(F.col(label).alias("l"), F.col("photo_id").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda c: F.coalesce(F.sum(_choose2(F.col(c))), F.lit(0)).cast("long")
    one = F.lit(1).alias("_one")
    parts = [
        cell.agg(c2("n").alias("same_within")).select("*", one),
        cell.groupBy("l").agg(F.sum("n").alias("n")).agg(c2("n").alias("same_all")).select("*", one),
        cell.groupBy("p").agg(F.sum("n").alias("n")).agg(c2("n").alias("all_within")).select("*", one),
        cell.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(_choose2(F.col("n")).alias("all_pairs"), one),
    ]
    t = parts[0]
    for p in parts[1:]:
        t = t.join(p, "_one")
    same_cross = F.col("same_all") - F.col("same_within")
    diff_within = F.col("all_within") - F.col("same_within")
    diff_cross = F.col("all_pairs") - F.col("same_all") - diff_within
    kinds = [("same", True, same_cross), ("same", False, F.col("same_within")), ("diff", True, diff_cross), ("diff", False, diff_within)]
    return t.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("cross_photo"), c.alias("pairs")) for k, x, c in kinds])
        ).alias("r")
    ).select("r.*")


def within_photo_pairs(faces: DataFrame, min_sim: float, label: str | None = None, chunk: int = 1024) -> DataFrame:
    """Face pairs inside one photo at or over ``min_sim``; only unlabelled faces when ``label`` is given."""
    id_type = faces.schema["face_id"].dataType
    schema = T.StructType(
        [T.StructField("photo_id", faces.schema["photo_id"].dataType), T.StructField("id_a", id_type),
         T.StructField("id_b", id_type), T.StructField("sim", T.DoubleType())]
    )

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        out = []
        for start, stop, s in tiles(a, b):
            hit = s >= min_sim
            if same:
                hit &= np.arange(start, stop)[:, None] < np.arange(len(b))[None, :]
            i, j = np.nonzero(hit)
            x, y = a.attr["id"][start + i], b.attr["id"][j]
            flip = x > y
            out.append((a.attr["group"][start + i], np.where(flip, y, x), np.where(flip, x, y), s[i, j]))
        return arrow_table(schema, [[o[k] for o in out] for k in range(4)])

    return group_pairs(_photo_rows(faces, label), None, reduce, schema, chunk)


def _photo_rows(faces: DataFrame, label: str | None) -> DataFrame:
    rows = faces.where(F.col("embedding").isNotNull())
    if label is not None:
        rows = rows.where(F.col(label).isNull())
    return rows.select(F.col("face_id").alias("id"), F.col("embedding").alias("vec"), F.col("photo_id").alias("group"))


def false_merge_risk(
    faces: DataFrame, thresholds: Sequence[float] = THRESHOLDS, label: str | None = None, chunk: int = 1024
) -> DataFrame:
    """How many within-photo pairs each threshold would wrongly merge."""
    bin_of, bins = threshold_bins(thresholds)
    schema = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("pairs", T.LongType())])

    def reduce(a: Side, b: Side, same: bool) -> pa.Table:
        total = np.zeros(bins, np.int64)
        for start, stop, s in tiles(a, b):
            code = bin_of(s)
            if same:
                code = code[np.arange(start, stop)[:, None] < np.arange(len(b))[None, :]]
            total += np.bincount(code.ravel(), minlength=bins)
        at = np.nonzero(total)[0]
        return pa.table({"bin": pa.array(at.astype(np.int32)), "pairs": pa.array(total[at])})

    counts = group_pairs(_photo_rows(faces, label), None, reduce, schema, chunk)
    cuts = sorted(thresholds)
    n = F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("n")
    at = [F.coalesce(F.sum(F.when(F.col("bin") > i, F.col("pairs"))), F.lit(0)).cast("long").alias(f"_t{i}") for i in range(len(cuts))]
    row = counts.agg(n, *at)
    listed = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_t{i}").alias("risky")) for i, t in enumerate(cuts)]))
    return row.select("n", listed.alias("r")).select(
        "r.threshold", F.col("n").alias("pairs"), "r.risky",
        (100 * F.col("r.risky") / F.greatest(F.lit(1), F.col("n"))).alias("percent"),
    )


def cross_frame_pairs(faces: DataFrame, photos: DataFrame, min_iou: float = FRAME_IOU) -> DataFrame:
    """Faces of consecutive frames (photos of one folder by path) whose boxes overlap.

    Overlap of at least ``min_iou`` bounds how far two boxes can differ in width and
    position, so faces are matched on width class and grid cell, then checked exactly.
    """
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must be above 0")
    frames = photos.select(
        "photo_id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")
    )
    numbered = materialize(rank_in_group(frames, ["folder"], ["path"], "frame").select("photo_id", "folder", "frame"))
    step = -np.log2(min_iou)
    rows = faces.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & F.col("embedding").isNotNull()).join(
        numbered, "photo_id"
    ).select(
        "folder", "frame", "face_id", "embedding", F.struct("x1", "y1", "x2", "y2").alias("box"),
        F.floor(F.log2(bx.width().cast("double")) / F.lit(max(step, 1e-9))).alias("size_class"),
    )
    if step == 0:
        rows = rows.withColumn("size_class", F.lit(0).cast("long"))

    # Widths differ by at most 1/min_iou (one class up or down) and left edges by at
    # most one width, hence a cell of the larger class's upper width.
    def cell(df, cls):
        pitch = F.pow(F.lit(2.0), (cls + 1) * step)
        return F.floor(F.col("box.x1") / pitch).alias("cell")

    around = F.sequence(F.lit(-1), F.lit(1)).cast("array<long>")
    base = rows.withColumn("key_class", F.explode(F.transform(around, lambda d: F.col("size_class") + d)))
    # A pair meets once, under the larger of its two classes.
    a = base.where("key_class >= size_class").select(
        "folder", "frame", F.col("face_id").alias("id_a"), F.col("embedding").alias("va"), F.col("box").alias("a"),
        F.col("size_class").alias("ca"), "key_class", cell(base, F.col("key_class")),
    )
    b = base.where("key_class >= size_class").select(
        "folder", (F.col("frame") - 1).alias("frame"), F.col("face_id").alias("id_b"), F.col("embedding").alias("vb"),
        F.col("box").alias("b"), F.col("size_class").alias("cb"), "key_class",
        F.explode(F.transform(around, lambda d: F.floor(F.col("box.x1") / F.pow(F.lit(2.0), (F.col("key_class") + 1) * step)) + d)).alias("cell"),
    )
    hits = a.join(b, ["folder", "frame", "key_class", "cell"]).where(
        (F.col("key_class") == F.greatest("ca", "cb")) & (bx.iou("a", "b") >= min_iou)
    )
    return hits.select("folder", "frame", "id_a", "id_b", bx.iou("a", "b").alias("iou"), cosine("va", "vb").alias("sim"))


# ------------------------------------------------------------------ distributions and sweeps


def _tier_codes(faces: DataFrame) -> DataFrame:
    return faces.withColumn("tier", bx.tier_ordinal(F.col("face_quality")))


def sim_distribution(
    faces: DataFrame,
    label: str = "label",
    by_quality: bool = True,
    quantiles: Sequence[float] = QUANTILES,
    rule: str = "n",
    cross_photo_only: bool = True,
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Exact quantiles of pair similarities per kind (and tier pair).

    Similarities are taken at float32 resolution, as a stored similarity matrix has them.
    """
    rows = _tier_codes(faces.where(F.col("embedding").isNotNull() & F.col(label).isNotNull()))
    rows = rows.withColumn("label_key", F.xxhash64(F.col(label).cast("string"))).withColumn("photo_key", F.xxhash64("photo_id"))
    attrs = ["label_key", "photo_key", "tier"]
    reps = materialize(collapse_copies(rows, "face_id", "embedding", attrs))
    width = 16 if by_quality else 1

    def stratify(a, b):
        code = np.where(a["label_key"] == b["label_key"], 0, width)
        if by_quality:
            code = code + np.minimum(a["tier"], b["tier"]) * 4 + np.maximum(a["tier"], b["tier"])
        return code

    attrs = ["label_key", "tier"] if by_quality else ["label_key"]
    apart = "photo_key" if cross_photo_only else None
    stats = similarity_quantiles(reps, attrs, stratify, 2 * width, list(quantiles), rule, block_rows=block_rows, apart=apart)
    out = []
    for code, (n, values) in sorted(stats.items()):
        kind = "same" if code < width else "diff"
        pair = f"{bx.TIERS[code % width // 4]}-{bx.TIERS[code % 4]}" if by_quality else "all"
        out += [(kind, pair, n, float(q), values[q]) for q in quantiles]
    return faces.sparkSession.createDataFrame(out, "kind string, q_pair string, pairs long, quantile double, sim double")


def threshold_sweep(
    faces: DataFrame, thresholds: Sequence[float] = THRESHOLDS, label: str = "label", block_rows: int | None = BLOCK_ROWS
) -> DataFrame:
    """Pair-level TP, FP, FN, TN and rates at each threshold.

    Only pairs at or over the lowest threshold are compared; the others are what group
    sizes say there must be besides.
    """
    rows = faces.where(F.col("embedding").isNotNull() & F.col(label).isNotNull()).withColumn(
        "label_key", F.xxhash64(F.col(label).cast("string"))
    )
    reps = materialize(collapse_copies(rows, "face_id", "embedding", ["label_key"]))
    bin_of, bins = threshold_bins(thresholds)
    same = lambda a, b: (a["label_key"] != b["label_key"]).astype(np.int64)
    cuts = sorted(thresholds)
    counts = binned_counts(reps, ["label_key"], same, 2, bin_of, bins, block_rows=block_rows, at_least=cuts[0])
    sizes = reps.groupBy("label_key").agg(F.sum("n").alias("n"))
    totals = sizes.agg(
        F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).cast("long").alias("_same"),
        _choose2(F.coalesce(F.sum("n"), F.lit(0))).alias("_all"), F.lit(1).alias("_one"),
    )

    def total(kind, above):
        hit = (F.col("stratum") == kind) & (F.col("bin") > above)
        return F.coalesce(F.sum(F.when(hit, F.col("pairs"))), F.lit(0)).cast("long")

    row = counts.agg(
        F.lit(1).alias("_one"),
        *[total(0, i).alias(f"_tp{i}") for i in range(len(cuts))],
        *[total(1, i).alias(f"_fp{i}") for i in range(len(cuts))],
    ).join(totals, "_one").withColumn("_diff", F.col("_all") - F.col("_same"))
    listed = F.explode(
        F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp")) for i, t in enumerate(cuts)])
    )
    r = row.select("_same", "_diff", listed.alias("r")).select(
        "r.*", (F.col("_same") - F.col("r.tp")).alias("fn"), (F.col("_diff") - F.col("r.fp")).alias("tn")
    )
    return _with_rates(r).withColumn("far", _ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def _with_rates(r: DataFrame) -> DataFrame:
    r = r.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    return r.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def capped_pairs(
    faces: DataFrame, label: str = "label", max_pos: int = 3000, max_neg: int = 3000, per_label: int = 3
) -> DataFrame:
    """The first ``max_pos`` same-label and ``max_neg`` cross-label pairs in label order.

    A sampling report: labels are taken in order of their first face, faces in order,
    and a cross-label pair only uses the first ``per_label`` faces of each side. Only
    ranks that can fall under the caps are joined.
    """
    rows = faces.where(F.col("embedding").isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("label"), "face_order", "embedding"
    )
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("face_order").alias("_at")).where("n >= 2")
    # Every label adds at least one pair, so no more labels than pairs can matter.
    wanted = sizes.orderBy("_at").limit(max(max_pos, max_neg) + 1)
    order = Window.orderBy("_at")
    before = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    labels = materialize(wanted.select("label", "n", F.row_number().over(order).alias("lab"), before.cast("long").alias("before")))
    ranked = materialize(
        rank_in_group(rows.join(labels, "label", "left_semi"), ["label"], ["face_order"], "i")
        .where(F.col("i") <= max(max_pos, per_label) + 1)
        .join(labels, "label")
    )
    a = ranked.where(F.col("before") < max_pos).select("label", "n", "before", "i", F.col("face_order").alias("id_a"), F.col("embedding").alias("_a"))
    b = ranked.where(F.col("before") < max_pos).select("label", F.col("i").alias("j"), F.col("face_order").alias("id_b"), F.col("embedding").alias("_b"))
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    position = F.col("before") + (i - 1) * n - i * (i - 1) / 2 + (j - i - 1)
    pos = a.join(b, "label").where((i < j) & (position < max_pos)).select(
        F.lit("positive").alias("kind"), "id_a", "id_b", cosine("_a", "_b").alias("sim")
    )
    count = labels.count()
    heads = ranked.where(F.col("i") <= per_label).select("lab", "i", "face_order", "embedding")
    left = heads.where(F.col("lab") < count).select(
        F.col("lab").alias("la"), F.col("i").alias("ia"), F.col("face_order").alias("id_a"), F.col("embedding").alias("_a"),
        F.explode(F.sequence(F.col("lab") + 1, F.least(F.lit(count), F.col("lab") + max_neg))).alias("lb"),
    )
    right = heads.select(F.col("lab").alias("lb"), F.col("i").alias("ib"), F.col("face_order").alias("id_b"), F.col("embedding").alias("_b"))
    neg = left.join(right, "lb").orderBy("la", "lb", "ia", "ib").limit(max_neg).select(
        F.lit("negative").alias("kind"), "id_a", "id_b", cosine("_a", "_b").alias("sim")
    )
    return pos.unionByName(neg)


# ------------------------------------------------------------------ clusterings against labels


def contingency(assign: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Counts per (cluster, label); rows without a label stay out."""
    return assign.where(F.col(label).isNotNull() & F.col(cluster).isNotNull()).groupBy(
        F.col(cluster).alias("cluster"), F.col(label).alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))


def pair_metrics(assign: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Pair TP, FP, FN, TN with precision, recall and F1, from group sizes alone."""
    cells = contingency(assign, cluster, label)
    one = F.lit(1).alias("_one")
    pairs = lambda df, name: df.agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).cast("long").alias(name)).select(name, one)
    by_cluster = cells.groupBy("cluster").agg(F.sum("n").alias("n"))
    by_label = cells.groupBy("label").agg(F.sum("n").alias("n"))
    everything = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    t = pairs(cells, "tp").join(pairs(by_cluster, "_c"), "_one").join(pairs(by_label, "_l"), "_one").join(
        pairs(everything, "_all"), "_one"
    )
    r = t.select(
        "tp", (F.col("_c") - F.col("tp")).alias("fp"), (F.col("_l") - F.col("tp")).alias("fn"),
        (F.col("_all") - F.col("_c") - F.col("_l") + F.col("tp")).alias("tn"),
    )
    return _with_rates(r)


def recall_by_size(assign: DataFrame, cluster: str = "cluster", label: str = "label", side: str = "side") -> DataFrame:
    """Same-label pairs and how many share a cluster, by the smaller face's size band.

    In a group with ``c_b`` rows in band b, the pairs whose smaller side falls in b
    number ``c_b(c_b-1)/2 + c_b * (rows in larger bands)``.
    """
    rows = assign.where(F.col(label).isNotNull() & F.col(cluster).isNotNull())
    position = F.array_position(F.array(*[F.lit(b) for b in BUCKET_ORDER]), size_bucket(F.col(side)))
    cells = rows.groupBy(
        F.col(label).alias("label"), F.col(cluster).alias("cluster"), position.cast("int").alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))

    def pairs(df, keys, name):
        # At most five bands per group, so the group's bands fit in one row.
        wide = df.groupBy(*keys).agg(
            *[F.coalesce(F.sum(F.when(F.col("b") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(1, 6)]
        )
        sums = []
        for i in range(1, 6):
            n = F.col(f"n{i}")
            larger = sum((F.col(f"n{k}") for k in range(i + 1, 6)), F.lit(0))
            sums.append(F.coalesce(F.sum(_choose2(n) + n * larger), F.lit(0)).cast("long").alias(f"p{i}"))
        row = wide.agg(*sums)
        return row.select(
            F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"p{i}").alias(name)) for i, b in enumerate(BUCKET_ORDER, 1)])).alias("r")
        ).select("r.*")

    same = pairs(cells, ["label"], "same_pairs")
    recovered = pairs(cells, ["label", "cluster"], "recovered")
    return same.join(recovered, "bucket").withColumn(
        "recall", F.when(F.col("same_pairs") > 0, F.col("recovered") / F.col("same_pairs"))
    )


def purity(assign: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Share of labelled faces that carry their cluster's commonest label."""
    top = contingency(assign, cluster, label).groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return top.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("top").alias("pure"), F.sum("n").alias("labelled"),
        (F.sum("top") / F.sum("n")).alias("purity"),
    )


def _cluster_profile(assign, cluster, label):
    cells = materialize(contingency(assign, cluster, label))
    top = cells.groupBy("cluster").agg(
        F.min(F.struct((-F.col("n")).alias("s"), "label")).alias("m"), F.sum("n").alias("labelled"),
    ).select("cluster", F.col("m.label").alias("dominant"), "labelled")
    return cells, top


def false_merges(assign: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Minority labels inside clusters, one row per (cluster, minority label)."""
    cells, top = _cluster_profile(assign, cluster, label)
    sizes = assign.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("cluster_size"))
    return (
        cells.join(top, "cluster").where(F.col("label") != F.col("dominant"))
        .join(sizes.where("cluster_size >= 2"), "cluster")
        .select("cluster", "cluster_size", "dominant", F.col("label").alias("minority"), F.col("n").alias("faces"))
    )


def false_splits(assign: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Labels found in several clusters, one row per (label, cluster)."""
    cells = materialize(contingency(assign, cluster, label))
    several = cells.groupBy("label").agg(F.count(F.lit(1)).alias("clusters")).where("clusters > 1")
    return cells.join(several, "label").select("label", "clusters", "cluster", F.col("n").alias("faces"))


def split_report(assign: DataFrame, persons: DataFrame, label: str = "label") -> DataFrame:
    """Persons of each true identity, largest first, one row per (identity, person)."""
    cells = materialize(contingency(assign, "person_id", label))
    counts = cells.groupBy("label").agg(F.count(F.lit(1)).alias("clusters"))
    return (
        cells.join(counts, "label")
        .join(persons.select(F.col("person_id").alias("cluster"), F.col("name").alias("person_name")), "cluster")
        .select(
            F.col("label").alias("identity"), "clusters", (F.col("clusters") > 1).alias("split"),
            F.col("cluster").alias("person_id"), "person_name", F.col("n").alias("faces"),
        )
        .orderBy("identity", F.col("faces").desc(), "person_id")
    )


def split_summary(assign: DataFrame, label: str = "label") -> DataFrame:
    counts = contingency(assign, "person_id", label).groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(
        F.count(F.lit(1)).alias("identities"),
        F.count_if(F.col("c") > 1).alias("split"),
        (100 * F.count_if(F.col("c") > 1) / F.count(F.lit(1))).alias("split_percent"),
        F.coalesce(F.max(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("max_clusters"),
    )


def mean_clusters_per_identity(faces: DataFrame, thresholds: Sequence[float], label: str = "label") -> DataFrame:
    """Running-average clusters per identity with at least two faces, at each threshold."""
    rows = materialize(
        faces.where(F.col("embedding").isNotNull() & F.col(label).isNotNull()).select(label, "face_order", "embedding")
    )
    out = None
    for t in thresholds:
        per = cluster_running_average(rows, t, label).groupBy(label).agg(
            F.max("cluster").alias("c"), F.count(F.lit(1)).alias("n")
        ).where("n >= 2")
        part = per.agg(
            F.lit(t).alias("threshold"), F.avg("c").alias("clusters_per_identity"), F.sum("c").alias("clusters"),
            F.count(F.lit(1)).alias("identities"), F.count_if(F.col("c") > 1).alias("split"),
            F.coalesce(F.max(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("max_clusters"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def purity_check(assign: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Per cluster the number of identities, per identity the number of clusters."""
    cells = contingency(assign, cluster, label)
    by_cluster = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    by_label = cells.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    one = F.lit(1).alias("_one")
    a = by_cluster.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("k") > 1).alias("mixed_clusters")).select("*", one)
    b = by_label.agg(F.count(F.lit(1)).alias("identities"), F.count_if(F.col("k") > 1).alias("split_identities")).select("*", one)
    return a.join(b, "_one").drop("_one").withColumn(
        "passed", (F.col("mixed_clusters") == 0) & (F.col("split_identities") == 0)
    )


def compare_clusterings(assign: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Clusters of ``a`` whose faces land in several clusters of ``b``.

    ``assign`` has ``face_id, photo_id, quality_score`` and both cluster columns.
    """
    rows = assign.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(F.col(a).alias("cluster"), F.col(b).alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality_score").alias("q")
    )
    shots = rows.select(F.col(a).alias("cluster"), "photo_id").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("photos"))
    return (
        cells.groupBy("cluster")
        .agg(F.sum("n").alias("faces"), (F.sum("q") / F.sum("n")).alias("avg_quality"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .join(shots, "cluster")
    )


def changed_faces(assign: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Faces whose cluster has different members in the two clusterings."""
    rows = assign.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = materialize(rows.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("n")))
    in_a = cells.groupBy("_a").agg(F.sum("n").alias("na"))
    in_b = cells.groupBy("_b").agg(F.sum("n").alias("nb"))
    kept = cells.join(in_a, "_a").join(in_b, "_b").where("n = na AND n = nb")
    one = F.lit(1).alias("_one")
    totals = cells.agg(F.sum("n").alias("faces")).select("*", one)
    same = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_same")).select("*", one)
    clusters = [
        df.agg(F.count(F.lit(1)).alias(name)).select("*", one) for df, name in ((in_a, "clusters_a"), (in_b, "clusters_b"))
    ]
    return totals.join(same, "_one").join(clusters[0], "_one").join(clusters[1], "_one").select(
        "faces", (F.col("faces") - F.col("_same")).alias("changed"), "clusters_a", "clusters_b"
    )


def persons_per_photo(assign: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Faces and distinct clusters per photo in both clusterings."""
    def distinct(col, name):
        return (
            assign.where(F.col(col).isNotNull()).select("photo_id", col).distinct()
            .groupBy("photo_id").agg(F.count(F.lit(1)).alias(name))
        )

    faces = assign.groupBy("photo_id").agg(F.count(F.lit(1)).alias("faces"))
    zero = F.lit(0).cast("long")
    return (
        faces.join(distinct(a, "_a"), "photo_id", "left").join(distinct(b, "_b"), "photo_id", "left")
        .select("photo_id", "faces", F.coalesce("_a", zero).alias("persons_a"), F.coalesce("_b", zero).alias("persons_b"))
    )


def persons_per_photo_summary(per_photo: DataFrame) -> DataFrame:
    return per_photo.agg(
        F.count(F.lit(1)).alias("photos"), F.sum("persons_a").alias("total_a"), F.sum("persons_b").alias("total_b"),
        F.avg("persons_a").alias("avg_a"), F.avg("persons_b").alias("avg_b"),
    )


def size_report(assign: DataFrame, cluster: str = "cluster", top: int = 10) -> DataFrame:
    """Cluster count, singletons, large clusters, and the ``top`` sizes as rows."""
    sizes = assign.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") >= 5).alias("large"),
    )
    best = sizes.orderBy(F.col("n").desc()).limit(top).select(
        F.row_number().over(Window.orderBy(F.col("n").desc())).alias("position"), F.col("n").alias("size")
    )
    return best.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one").drop("_one")


def config_sweep(faces: DataFrame, configs: Sequence[dict], label: str = "label", **limits) -> DataFrame:
    """Cluster at several settings and report sizes and pair metrics for each.

    A config has ``name``, ``threshold`` and ``gated`` (tier rules on or off), and may
    set ``low_join``. Faces are compared once, at the lowest threshold; every set of tier
    rules has one forest of merges, which each of its thresholds cuts.
    """
    base = materialize(faces.select("face_order", "embedding", "face_quality", F.col(label).alias("label")))
    forest = MergeForest(base, min(float(c["threshold"]) for c in configs), **limits)
    rules: dict[tuple, list[dict]] = {}
    for c in configs:
        gated = c.get("gated", True)
        rules.setdefault((gated, c.get("low_join", LOW_JOIN) if gated else LOW_JOIN), []).append(c)
    assign = None
    for (gated, low_join), group in rules.items():
        cuts = forest.cuts([c["threshold"] for c in group], gated, low_join)
        named = F.array(*[F.struct(F.lit(c["name"]).alias("config"), F.lit(float(c["threshold"])).alias("at")) for c in group])
        cuts = cuts.select("*", F.explode(named).alias("c")).where("threshold = c.at").select("c.config", "threshold", "face_order", "cluster")
        assign = cuts if assign is None else assign.unionByName(cuts)
    assign = assign.join(base.select("face_order", "label"), "face_order")
    every = [(c["name"], float(c["threshold"])) for c in configs]
    return grouped_metrics(assign, base.sparkSession.createDataFrame(every, "config string, threshold double"), ["config", "threshold"])


def grouped_metrics(assign: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster sizes, pair metrics and purity for every row of ``groups``, in one pass.

    ``assign`` has the keys, ``cluster`` and ``label``; a group without faces has zeros.
    """
    n, zero = F.col("n"), F.lit(0).cast("long")
    cells = materialize(assign.groupBy(*keys, "cluster", "label").agg(F.count(F.lit(1)).alias("n")))
    labelled = cells.where(F.col("label").isNotNull())
    sizes = cells.groupBy(*keys, "cluster").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(n == 1).alias("singletons"), F.max("n").alias("largest")
    )
    by_cluster = labelled.groupBy(*keys, "cluster").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(_choose2(n)).alias("same"))
    by_cluster = by_cluster.groupBy(*keys).agg(
        F.sum("same").alias("tp"), F.sum(_choose2(n)).alias("_c"), _choose2(F.sum("n")).alias("_all"), (F.sum("top") / F.sum("n")).alias("purity")
    )
    by_label = labelled.groupBy(*keys, "label").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_choose2(n)).alias("_l"))
    t = groups.join(sizes, keys, "left").join(by_cluster, keys, "left").join(by_label, keys, "left")
    t = t.withColumns({c: F.coalesce(c, zero) for c in ("clusters", "singletons", "tp", "_c", "_l", "_all")})
    t = t.select(
        *keys, "clusters", "singletons", "largest", "tp", (F.col("_c") - F.col("tp")).alias("fp"), (F.col("_l") - F.col("tp")).alias("fn"),
        (F.col("_all") - F.col("_c") - F.col("_l") + F.col("tp")).alias("tn"), "purity",
    )
    return _with_rates(t)


# ------------------------------------------------------------------ golden comparison


def golden_match(dets: DataFrame, golden: DataFrame, min_iou: float = 0.9, min_cos: float = 0.97) -> DataFrame:
    """One-to-one match of detections to golden faces, each detection in turn.

    ``dets(photo, det_seq, x1..y2, embedding)`` and ``golden(photo, face_seq, x1..y2,
    embedding)``. Every detection takes the unused golden face with the best overlap.
    Detections are expected after suppression, when the boxes in one photo are bounded
    by its area.
    """
    schema = (
        "photo string, det_seq long, face_seq long, iou double, cos double, passed boolean"
    )

    def run(d, g):
        d = d.sort_by("det_seq").to_pydict()
        g = {k.removeprefix("g_"): v for k, v in g.sort_by("g_face_seq").to_pydict().items()}
        boxes = np.array([g["x1"], g["y1"], g["x2"], g["y2"]], dtype=float).T.reshape(-1, 4)
        free = np.ones(len(boxes), bool)
        out = {k: [] for k in ("photo", "det_seq", "face_seq", "iou", "cos", "passed")}
        for i in range(len(d["det_seq"])):
            x1, y1, x2, y2 = (float(d[c][i]) for c in ("x1", "y1", "x2", "y2"))
            at, overlap, cos = None, None, None
            if free.any():
                w = np.clip(np.minimum(x2, boxes[:, 2]) - np.maximum(x1, boxes[:, 0]), 0, None)
                h = np.clip(np.minimum(y2, boxes[:, 3]) - np.maximum(y1, boxes[:, 1]), 0, None)
                inter = w * h
                union = (x2 - x1) * (y2 - y1) + (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) - inter
                ratio = np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)
                best = int(np.where(free, ratio, -1.0).argmax())
                free[best] = False
                at, overlap = g["face_seq"][best], float(ratio[best])
                a, b = d["embedding"][i], g["embedding"][best]
                if a is not None and b is not None:
                    a, b = np.array(a, float), np.array(b, float)
                    scale = np.sqrt(a @ a) * np.sqrt(b @ b)
                    cos = float(a @ b / scale) if scale > 0 else 0.0
            passed = None if at is not None and cos is None else bool(at is not None and overlap >= min_iou and cos >= min_cos)
            for k, value in zip(out, (d["photo"][i], d["det_seq"][i], at, overlap, cos, passed)):
                out[k].append(value)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    # Own names for the golden side, also when both sides come from one table.
    right = golden.select(*[F.col(c).alias(f"g_{c}") for c in ("photo", "face_seq", "x1", "y1", "x2", "y2", "embedding")])
    return dets.groupBy("photo").cogroup(right.groupBy("g_photo")).applyInArrow(run, schema)


def golden_summary(matches: DataFrame, dets: DataFrame, golden: DataFrame) -> DataFrame:
    """Pass and fail counts, and photos whose face counts differ."""
    per_d = dets.groupBy("photo").agg(F.count(F.lit(1)).alias("d"))
    per_g = golden.groupBy("photo").agg(F.count(F.lit(1)).alias("g"))
    uneven = per_d.join(per_g, "photo", "full").where(~F.col("d").eqNullSafe(F.col("g")))
    one = F.lit(1).alias("_one")
    return (
        matches.agg(
            F.count(F.lit(1)).alias("detections"), F.count_if("passed").alias("passed"),
            F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("skipped"),
        ).select("*", one)
        .join(uneven.agg(F.count(F.lit(1)).alias("count_mismatches")).select("*", one), "_one")
        .drop("_one")
    )
