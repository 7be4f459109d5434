"""Post-processing of raw face detections: suppression, gating and quality tiers.

Everything except suppression is a column expression, so the whole chain from score
filter to tier runs as one narrow stage.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.functions import boxes as bx
from kinframe.operators.persons import WHOLE_PIXEL_BANDS, band
from kinframe.operators.ranking import rank_in_group
from kinframe.session import materialize

# Detection thresholds, tier bands and gate limits.
DETECT_THRESHOLD = 0.5
TILE_TRIGGER_PX = 80
CROWD_FACES = 6
CROWD_FACES_SMALL_IMAGE = 3
SMALL_IMAGE_MPX = 4
MIN_FACE_PX = 16
MIN_FACE_SCORE = 0.3
LANDMARK_PAD = 0.9
MIN_EYE_RATIO = 0.04
POSE_YAW = 1.6
POSE_EYE_RATIO = 0.08
FALSE_POSITIVE_SCORE = 0.6
FALSE_POSITIVE_SIDE = 250
GATE_DET_SCORE = 0.5
GATE_EQ_SCORE = 0.25
GATE_TINY_SIDE = 80
GATE_EQ_TINY = 0.15
BLUR_EQ = 0.15
NMS_PRESETS = {"detector": (0.4, 1.0), "cross_source": (0.3, 0.0)}
# Images above this many detections are suppressed in distributed rounds.
NMS_IMAGE_ROWS = 4096


def score_threshold(dets: DataFrame, threshold: float = DETECT_THRESHOLD) -> DataFrame:
    return dets.where(F.col("det_score") >= threshold)


def unscale(dets: DataFrame, det_scale: Column | str = "det_scale") -> DataFrame:
    """Map boxes and landmarks from detector space back to image space."""
    scale = F.col(det_scale) if isinstance(det_scale, str) else det_scale
    return _map_points(dets, lambda p, axis: p / scale)


def shift_tile(dets: DataFrame, dx: Column | str = "tile_x", dy: Column | str = "tile_y") -> DataFrame:
    """Move tile-local boxes and landmarks to image coordinates."""
    offset = {"x": F.col(dx) if isinstance(dx, str) else dx, "y": F.col(dy) if isinstance(dy, str) else dy}
    return _map_points(dets, lambda p, axis: p + offset[axis])


def _map_points(dets: DataFrame, move) -> DataFrame:
    kps = F.transform("kps", lambda p: F.struct(move(p["x"], "x").alias("x"), move(p["y"], "y").alias("y")))
    return dets.withColumns(
        {
            "x1": move(F.col("x1"), "x"), "y1": move(F.col("y1"), "y"),
            "x2": move(F.col("x2"), "x"), "y2": move(F.col("y2"), "y"), "kps": kps,
        }
    )


def tile_grid(images: DataFrame, n: int, overlap: float = 0.0) -> DataFrame:
    """The n x n tiles of each image; neighbours share ``overlap`` of their size."""
    steps = n - (n - 1) * overlap
    tile_w, tile_h = F.col("width") / steps, F.col("height") / steps
    grid = images.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "tx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    x1 = F.floor(F.col("tx") * (1 - overlap) * tile_w)
    y1 = F.floor(F.col("ty") * (1 - overlap) * tile_h)
    last = F.lit(n - 1)
    x2 = F.when(F.col("tx") == last, F.col("width")).otherwise(F.least(F.col("width"), F.ceil(x1 + tile_w)))
    y2 = F.when(F.col("ty") == last, F.col("height")).otherwise(F.least(F.col("height"), F.ceil(y1 + tile_h)))
    return grid.select(
        "image_id", "tx", "ty",
        *[c.cast("long").alias(name) for c, name in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))],
    )


def plan_tiling(images: DataFrame, dets: DataFrame, face_px: int = TILE_TRIGGER_PX) -> DataFrame:
    """Tile grid wanted per image: 0 or 2, and whether tiny faces call for a 3 x 3 pass."""
    seen = dets.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("faces"), F.max(bx.width() < face_px).alias("tiny")
    )
    mpx = F.col("width") * F.col("height") / 1e6
    crowded = (F.col("faces") >= CROWD_FACES) | (
        (F.col("faces") >= CROWD_FACES_SMALL_IMAGE) & (mpx <= SMALL_IMAGE_MPX)
    )
    rows = images.join(seen, "image_id", "left").withColumns(
        {"faces": F.coalesce("faces", F.lit(0)).cast("long"), "tiny": F.coalesce("tiny", F.lit(False))}
    )
    return rows.select(
        "image_id", "faces",
        F.when((F.col("faces") > 0) & (F.col("tiny") | crowded), 2).otherwise(0).alias("grid"),
        F.col("tiny").alias("refine"),
    )


# ------------------------------------------------------------------ suppression


def _greedy_keep(image: np.ndarray, b: np.ndarray, limit: float, pixel: float) -> np.ndarray:
    """Positions kept when boxes, best first within each image, drop later overlapping ones.

    Every pass settles the best remaining box of all images at once.
    """
    area = (b[:, 2] - b[:, 0] + pixel) * (b[:, 3] - b[:, 1] + pixel)
    kept = []
    left = np.arange(len(b))
    while len(left):
        first = np.ones(len(left), bool)
        first[1:] = image[left[1:]] != image[left[:-1]]
        heads = left[first]
        kept.append(heads)
        head = heads[np.cumsum(first) - 1][~first]
        left = left[~first]
        w = np.maximum(0.0, np.minimum(b[head, 2], b[left, 2]) - np.maximum(b[head, 0], b[left, 0]) + pixel)
        h = np.maximum(0.0, np.minimum(b[head, 3], b[left, 3]) - np.maximum(b[head, 1], b[left, 1]) + pixel)
        inter = w * h
        union = area[head] + area[left] - inter
        ratio = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        left = left[ratio <= limit]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _suppress_groups(rows: DataFrame, limit: float, pixel: float, per_pack: int) -> DataFrame:
    """Greedy suppression with many whole images per task: kept ``(image_id, det_seq)``."""
    schema = T.StructType([rows.schema["image_id"], rows.schema["det_seq"]])

    def run(table):
        # Dense codes, so image ids may be numbers or text.
        _, image = np.unique(table.column("image_id").to_numpy(), return_inverse=True)
        seq = table.column("det_seq").to_numpy()
        score = table.column("det_score").to_numpy()
        box = np.stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
        order = np.lexsort((seq, -score, image))
        keep = order[_greedy_keep(image[order], box[order], limit, pixel)]
        return table.select(["image_id", "det_seq"]).take(pa.array(keep))

    packs = max(2 * rows.sparkSession.sparkContext.defaultParallelism, per_pack)
    pack = F.pmod(F.xxhash64("image_id"), F.lit(packs)).alias("pack")
    return rows.select(pack, *rows.columns).repartition(packs, "pack").groupBy("pack").applyInArrow(run, schema)


def nms(dets: DataFrame, preset: str = "cross_source", iou: float | None = None, image_rows: int = NMS_IMAGE_ROWS) -> DataFrame:
    """Greedy non-maximum suppression per image, best score first, then ``det_seq``.

    Images with at most ``image_rows`` detections are handled whole. Larger ones go in
    rounds: the best ``image_rows`` detections are suppressed among themselves, those
    kept then remove everything they overlap, wherever it is stored. This is the same
    outcome, because a detection is only ever removed by a better kept one. The columns that
    the caller goes on with are shuffled once; steps by row are cheaper before than after.
    """
    limit, pixel = NMS_PRESETS[preset]
    limit = limit if iou is None else iou
    slim = dets.select("image_id", "det_seq", "det_score", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    sizes = slim.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    largest, total = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    packs = int(total // (64 * image_rows)) + 1
    if largest <= image_rows:
        kept = _suppress_groups(slim, limit, pixel, packs)
    else:
        big = materialize(sizes.where(F.col("_n") > image_rows).select("image_id"))
        kept = _suppress_groups(slim.join(big, "image_id", "left_anti"), limit, pixel, packs)
        kept = kept.unionByName(_suppress_rounds(materialize(slim.join(big, "image_id", "left_semi")), limit, pixel, image_rows))
    return dets.join(kept, ["image_id", "det_seq"], "left_semi")


def _suppress_rounds(rows: DataFrame, limit: float, pixel: float, image_rows: int) -> DataFrame:
    kept_all = None
    salts = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    while not rows.isEmpty():
        ranked = materialize(
            rank_in_group(rows.withColumn("_neg", -F.col("det_score")), ["image_id"], ["_neg", "det_seq"]).drop("_neg")
        )
        head = ranked.where(F.col("rn") <= image_rows).drop("rn")
        kept = materialize(head.join(_suppress_groups(head, limit, pixel, 1), ["image_id", "det_seq"], "left_semi"))
        part = kept.select("image_id", "det_seq")
        kept_all = part if kept_all is None else kept_all.unionByName(part)
        # Each image's remainder is spread over salts; its kept boxes go to all of them.
        rest = ranked.where(F.col("rn") > image_rows).select(
            "image_id", "det_seq", "det_score", F.struct("x1", "y1", "x2", "y2").alias("r"),
            F.pmod(F.xxhash64("det_seq"), F.lit(salts)).alias("_salt"),
        )
        winners = kept.select(
            F.col("image_id"), F.struct("x1", "y1", "x2", "y2").alias("k"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("_salt"),
        )
        clear = rest.alias("a").join(
            winners.alias("b"),
            (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a._salt") == F.col("b._salt"))
            & (bx.iou("a.r", "b.k", pixel) > limit),
            "left_anti",
        )
        rows = materialize(clear.select("image_id", "det_seq", "det_score", "r.x1", "r.y1", "r.x2", "r.y2"))
    return kept_all


# ------------------------------------------------------------------ geometry, gate and tiers


def face_geometry(dets: DataFrame) -> DataFrame:
    """Add ``pose_valid``, ``eye_dist_ratio`` and ``yaw_ratio`` from the landmarks."""
    one = F.lit(1.0)
    bw, bh = F.greatest(one, bx.width()), F.greatest(one, bx.height())
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    inside = F.forall(
        "kps",
        lambda p: finite(p["x"]) & finite(p["y"])
        & p["x"].between(F.col("x1") - LANDMARK_PAD * bw, F.col("x2") + LANDMARK_PAD * bw)
        & p["y"].between(F.col("y1") - LANDMARK_PAD * bh, F.col("y2") + LANDMARK_PAD * bh),
    )
    eyes = bx.eye_distance()
    ratio = eyes / F.greatest(one, F.least(bw, bh))
    valid = F.coalesce((F.size("kps") == 5) & inside & (ratio >= MIN_EYE_RATIO), F.lit(False))
    yaw = F.when(eyes > 0, (bx.kp(2, "x") - (bx.kp(0, "x") + bx.kp(1, "x")) / 2) / eyes).otherwise(F.lit(0.0))
    return dets.withColumn("pose_valid", valid).withColumns(
        {
            "eye_dist_ratio": F.when(F.col("pose_valid"), ratio).otherwise(F.lit(0.0)),
            "yaw_ratio": F.when(F.col("pose_valid"), yaw).otherwise(F.lit(0.0)),
        }
    )


def gate(dets: DataFrame, min_px: float = MIN_FACE_PX, min_score: float = MIN_FACE_SCORE) -> DataFrame:
    """Add ``reject_reason``: tiny, score, kps, or null for accepted detections.

    Expects the columns of ``face_geometry``.
    """
    reason = (
        F.when(bx.short_side() < min_px, "tiny")
        .when(F.col("det_score") < min_score, "score")
        .when(~F.col("pose_valid"), "kps")
    )
    return dets.withColumn("reject_reason", reason)


def geometric_score() -> Column:
    """0..1 from box size, eye distance and detector confidence."""
    one = F.lit(1.0)
    size = F.least(one, bx.long_side() / 120)
    eyes = F.least(one, bx.eye_distance() / F.greatest(one, 0.3 * bx.long_side()))
    sure = F.least(one, F.greatest(F.lit(0.0), (F.col("det_score") - 0.3) / 0.6))
    return F.least(one, 0.45 * size + 0.35 * eyes + 0.2 * sure)


def pose_penalty() -> Column:
    weak = (F.abs("yaw_ratio") > POSE_YAW) | (F.col("eye_dist_ratio") < POSE_EYE_RATIO)
    return F.when(weak, 1).otherwise(0)


def quality_tier(dets: DataFrame, use_eq: bool = True, blur_eq: float = BLUR_EQ) -> DataFrame:
    """Add ``geo_score`` and ``base_tier``: size band, then pose and blur penalties."""
    side, q = bx.long_side(), F.col("geo_score")
    banded = (
        F.when(side >= 64, F.when(q >= 0.5, 0).otherwise(1))
        .when(side >= 32, 1)
        .when(side >= 20, F.when(q >= 0.45, 2).otherwise(3))
        .otherwise(3)
    )
    step = F.least(F.lit(3), banded + pose_penalty())
    if use_eq and blur_eq > 0:
        eq = F.col("eq_score")
        blur = F.when(eq < blur_eq / 2, 2).when(eq < blur_eq, 1).otherwise(0)
        step = F.least(F.lit(3), step + blur)
    return dets.withColumn("geo_score", geometric_score()).withColumn("base_tier", bx.tier_name(step))


def composite_gate(
    dets: DataFrame,
    det_score: float | Column = GATE_DET_SCORE,
    eq_score: float | Column = GATE_EQ_SCORE,
    tiny_side: float | Column = GATE_TINY_SIDE,
    eq_tiny: float | Column = GATE_EQ_TINY,
    use_eq: bool = True,
) -> DataFrame:
    """Add ``downgraded`` and the final ``face_quality``.

    Weak detections with a poor blur score drop to the last tier; pose and
    false-positive penalties come on top. Limits may be columns, one per row.
    """
    side, eq = bx.long_side(), F.col("eq_score")
    weak = ((F.col("det_score") < det_score) & (eq < eq_score)) | ((side < tiny_side) & (eq < eq_tiny))
    hit = F.coalesce(weak, F.lit(False)) if use_eq else F.lit(False)
    suspect = F.when((F.col("det_score") < FALSE_POSITIVE_SCORE) & (side < FALSE_POSITIVE_SIDE), 2).otherwise(0)
    start = F.when(F.col("downgraded"), 3).otherwise(bx.tier_ordinal(F.col("base_tier")))
    return dets.withColumn("downgraded", hit).withColumn(
        "face_quality", bx.tier_name(F.least(F.lit(3), start + pose_penalty()) + suspect)
    )


def embed_eligible(dets: DataFrame, embed_low: bool = False, use_eq: bool = True) -> DataFrame:
    """Add the stored columns: eligibility, quality score and the low-quality flag."""
    last = F.col("face_quality") == "very_low"
    score = F.coalesce("eq_score", F.lit(0.0)) if use_eq else F.col("geo_score")
    return dets.withColumns(
        {"embed": F.lit(True) if embed_low else ~last, "quality_score": score, "low_quality": last}
    )


def classify(dets: DataFrame, use_eq: bool = True) -> DataFrame:
    """Geometry, gate, tier and eligibility in one pass; rejected rows keep their reason."""
    rows = gate(face_geometry(dets))
    return embed_eligible(composite_gate(quality_tier(rows, use_eq), use_eq=use_eq), use_eq=use_eq)


def detection_breakdown(raw: DataFrame, classified: DataFrame) -> DataFrame:
    """Counts per stage and image, plus one total row (null image).

    ``raw`` is before suppression, ``classified`` the suppressed rows after ``classify``.
    """
    kept = ["image_id", "reject_reason", "face_quality", "downgraded", "embed"]
    rows = raw.select("image_id", "pass").unionByName(classified.select(*kept, F.lit(True).alias("_after")), allowMissingColumns=True)
    after = F.coalesce("_after", F.lit(False))
    ok = after & F.col("reject_reason").isNull()
    counts = {
        "raw_full": ~after & (F.col("pass") == 0),
        "raw_tile": ~after & (F.col("pass") > 0),
        "after_nms": after,
        "after_gate": ok,
        **{f"rejected_{r}": after & (F.col("reject_reason") == r) for r in ("tiny", "score", "kps")},
        "quality_downgraded": ok & F.col("downgraded"),
        "embedded": ok & F.col("embed"),
        **{t: ok & (F.col("face_quality") == t) for t in bx.TIERS},
    }
    per_image = rows.groupBy("image_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return per_image.rollup("image_id").agg(*[F.sum(n).cast("long").alias(n) for n in counts])


def landmark_ratios(dets: DataFrame) -> DataFrame:
    """Eye, nose and mouth positions relative to the box."""
    one = F.lit(1.0)
    bw, bh = F.greatest(one, bx.width()), F.greatest(one, bx.height())
    eyes = bx.eye_distance()
    span = F.when(eyes == 0, one).otherwise(eyes)
    mid_x, mid_y = (bx.kp(0, "x") + bx.kp(1, "x")) / 2, (bx.kp(0, "y") + bx.kp(1, "y")) / 2
    mouth_y = (bx.kp(3, "y") + bx.kp(4, "y")) / 2
    return dets.select(
        "image_id", "det_seq",
        bx.round_half_up(bx.long_side()).cast("long").alias("size"),
        (eyes / bw).alias("eye_dist"),
        (span / F.greatest(one, F.least(bx.width(), bx.height()))).alias("eye_dist_ratio"),
        ((mid_y - F.col("y1")) / bh).alias("eye_y_ratio"),
        ((bx.kp(2, "y") - mid_y) / bh).alias("nose_below_eye"),
        (mouth_y - bx.kp(2, "y")).alias("mouth_below_nose"),
        ((mouth_y - mid_y) / bh).alias("eye_mouth_span"),
        ((bx.kp(2, "x") - mid_x) / span).alias("yaw_ratio"),
        ((mid_x - F.col("x1")) / bw).alias("eye_mid_x_ratio"),
    )


def gate_sweep(
    dets: DataFrame, gates: Sequence[float] = (0.5, 0.55, 0.6, 0.65, 0.7), eq: float = GATE_EQ_SCORE, min_side: float = 64
) -> DataFrame:
    """How many large faces each detector-score gate would downgrade."""
    counts = dets.where(bx.long_side() >= min_side).agg(
        F.count(F.lit(1)).alias("faces"),
        *[
            F.count_if((F.col("det_score") < g) & (F.col("eq_score") < eq)).alias(f"_g{i}")
            for i, g in enumerate(gates)
        ],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"_g{i}").alias("n")) for i, g in enumerate(gates)]))
    return counts.select("faces", rows.alias("r")).select(
        F.col("r.gate").alias("gate"), "faces", F.col("r.n").alias("downgraded"),
        F.when(F.col("faces") > 0, 100.0 * F.col("r.n") / F.col("faces")).alias("percent"),
    )


def cell_key() -> list[Column]:
    """Box centre on a grid of ten pixels."""
    return [
        bx.round_half_up((F.col("x1") + F.col("x2")) / 20).cast("long").alias("_cx"),
        bx.round_half_up((F.col("y1") + F.col("y2")) / 20).cast("long").alias("_cy"),
    ]


def gate_effect(classified: DataFrame, truth: DataFrame) -> DataFrame:
    """What a gate setting did: tiers, target faces still embedded, good faces lost.

    ``truth(image_id, x1..y2)`` lists unwanted target faces, matched by grid cell. A good
    face is any other of at least 64 px with a detector score of 0.7 or more.
    """
    return _marked(classified, truth).agg(*_effects())


def _marked(classified: DataFrame, truth: DataFrame) -> DataFrame:
    """Accepted detections with ``_target``: whether they are one of the listed faces."""
    keys = ["image_id", "_cx", "_cy"]
    targets = truth.select("image_id", *cell_key()).distinct().withColumn("_target", F.lit(True))
    return classified.where(F.col("reject_reason").isNull()).select("*", *cell_key()).join(targets, keys, "left")


def _effects() -> list[Column]:
    target = F.col("_target").isNotNull()
    good = ~target & (bx.long_side() >= 64) & (F.col("det_score") >= 0.7)
    return [
        F.count(F.lit(1)).alias("detections"),
        F.count_if("embed").alias("embedded"),
        *[F.count_if(F.col("face_quality") == t).alias(t) for t in bx.TIERS],
        F.count_if(target).alias("target_faces"),
        F.count_if(target & F.col("embed")).alias("target_embedded"),
        F.count_if(good).alias("good_faces"),
        F.count_if(good & ~F.col("embed")).alias("good_downgraded"),
    ]


def gate_comparison(dets: DataFrame, truth: DataFrame, settings: Sequence[dict]) -> DataFrame:
    """``gate_effect`` of several gate settings side by side, from one pass over the detections.

    A setting has a ``name`` and may set ``det_score``, ``eq_score``, ``tiny_side`` and
    ``eq_tiny``; ``"off": True`` switches the gate off. Geometry, tiers and targets do not
    depend on the setting and are found once; each detection then meets every setting.
    """
    limits = {"det_score": GATE_DET_SCORE, "eq_score": GATE_EQ_SCORE, "tiny_side": GATE_TINY_SIDE, "eq_tiny": GATE_EQ_TINY}
    rows = _marked(quality_tier(gate(face_geometry(dets))), truth)
    # A blur score never lies below zero, so with limits of zero the gate stays open.
    values = [{**limits, **({"eq_score": 0.0, "eq_tiny": 0.0} if c.get("off") else c)} for c in settings]
    each = F.array(*[F.struct(F.lit(c["name"]).alias("setting"), *[F.lit(float(v[k])).alias(k) for k in limits]) for c, v in zip(settings, values)])
    rows = rows.withColumn("_s", F.explode(each))
    gated = embed_eligible(composite_gate(rows, *[F.col(f"_s.{k}") for k in limits]))
    return gated.groupBy(F.col("_s.setting").alias("setting")).agg(*_effects())


def detection_recall(dets: DataFrame, expected: DataFrame) -> DataFrame:
    """Detected against hand-counted faces: per image, and one total row (null image)."""
    found = dets.groupBy("image_id").agg(F.count(F.lit(1)).alias("detected"))
    rows = expected.join(found, "image_id", "left").withColumn("detected", F.coalesce("detected", F.lit(0)).cast("long"))
    rows = rows.withColumns(
        {
            "missed": F.greatest(F.lit(0), F.col("expected") - F.col("detected")).cast("long"),
            "extra": F.greatest(F.lit(0), F.col("detected") - F.col("expected")).cast("long"),
        }
    )
    totals = rows.rollup("image_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("expected", "detected", "missed", "extra")])
    return totals.select(
        "*",
        (F.col("expected") / F.greatest(F.lit(1), F.col("detected"))).alias("precision"),
        F.when(F.col("expected") > 0, (F.col("expected") - F.col("missed")) / F.col("expected")).alias("recall"),
    )


def detections_by_size(classified: DataFrame) -> DataFrame:
    """Accepted detections, embeddings and tiers per size band."""
    rows = classified.where(F.col("reject_reason").isNull())
    return rows.groupBy(band(bx.width(), WHOLE_PIXEL_BANDS, "?").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("embed").alias("embedded"),
        *[F.count_if(F.col("face_quality") == t).alias(t) for t in bx.TIERS],
    )


def pixel_budget(dets: DataFrame, images: DataFrame) -> DataFrame:
    """Image area in megapixels and each box as a share of the image width."""
    return dets.join(images, "image_id").select(
        "image_id", "det_seq",
        (F.col("width") * F.col("height") / 1e6).alias("area_mpx"),
        F.when(F.col("width") > 0, 100 * bx.width() / F.col("width")).alias("width_percent"),
        bx.long_side().alias("largest_side"),
    )


def nearest_detection(refs: DataFrame, dets: DataFrame, min_tolerance: float = 12.0, side_share: float = 0.4) -> DataFrame:
    """For each detection its nearest reference in the same image, when close enough.

    ``refs(image_id, ref_id, cx, cy, side)`` and ``dets(image_id, det_id, cx, cy)``. The
    tolerance is the larger of ``min_tolerance`` and a share of the reference's side.
    A match can be no further than the image's largest tolerance, so references are
    laid on a grid of that pitch and only neighbouring cells are compared.
    """
    tolerance = F.greatest(F.lit(min_tolerance), F.col("side") * side_share)
    pitch = refs.groupBy("image_id").agg(F.max(tolerance).alias("_pitch"))
    near = F.sequence(F.lit(-1), F.lit(1)).cast("array<long>")
    r = (
        refs.join(pitch, "image_id")
        .select("*", tolerance.alias("_tol"), F.explode(near).alias("_dx"))
        .select("*", F.explode(near).alias("_dy"))
        .select(
            "image_id", "ref_id", F.col("cx").alias("_rx"), F.col("cy").alias("_ry"), "_tol",
            (F.floor(F.col("cx") / F.col("_pitch")) + F.col("_dx")).alias("_gx"),
            (F.floor(F.col("cy") / F.col("_pitch")) + F.col("_dy")).alias("_gy"),
        )
    )
    d = dets.join(pitch, "image_id").withColumns(
        {"_gx": F.floor(F.col("cx") / F.col("_pitch")), "_gy": F.floor(F.col("cy") / F.col("_pitch"))}
    )
    distance = F.hypot(F.col("cx") - F.col("_rx"), F.col("cy") - F.col("_ry"))
    best = (
        d.join(r, ["image_id", "_gx", "_gy"])
        .groupBy("image_id", "det_id")
        .agg(F.min(F.struct(distance.alias("distance"), "ref_id", "_tol")).alias("m"))
    )
    return best.select("image_id", "det_id", "m.ref_id", "m.distance", "m._tol").where(
        F.col("distance") <= F.col("_tol")
    ).drop("_tol")
