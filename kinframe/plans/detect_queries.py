"""Detection post-processing queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions import boxes as bx
from kinframe.operators import detect as dt
from kinframe.plans.registry import REGISTRY, ctes, query
from kinframe.plans.vector_queries import rounded

GEO_SQL = """
g0 AS (SELECT *, greatest(1, w) AS bw, greatest(1, h) AS bh, sqrt((rex - lex) * (rex - lex) + (rey - ley) * (rey - ley)) AS eyes FROM detections),
g1 AS (SELECT *, eyes / greatest(1, least(bw, bh)) AS er,
  (least(rex, lex, nox, rmx, lmx) >= x1 - 0.9::DOUBLE * bw AND greatest(rex, lex, nox, rmx, lmx) <= x2 + 0.9::DOUBLE * bw
   AND least(rey, ley, noy, rmy, lmy) >= y1 - 0.9::DOUBLE * bh AND greatest(rey, ley, noy, rmy, lmy) <= y2 + 0.9::DOUBLE * bh) AS inside FROM g0),
geo AS (SELECT *, (inside AND er >= 0.04::DOUBLE) AS pose_valid,
  CASE WHEN inside AND er >= 0.04::DOUBLE THEN er ELSE 0 END AS eye_dist_ratio,
  CASE WHEN inside AND er >= 0.04::DOUBLE THEN (nox - (rex + lex) / 2) / eyes ELSE 0 END AS yaw_ratio,
  greatest(w, h) AS side FROM g1),
c0 AS (SELECT *, CASE WHEN least(w, h) < 16 THEN 'tiny' WHEN det_score < 0.3::DOUBLE THEN 'score' WHEN NOT pose_valid THEN 'kps' END AS reject_reason,
  least(1, 0.45::DOUBLE * least(1, side / 120) + 0.35::DOUBLE * least(1, eyes / greatest(1, 0.3::DOUBLE * side)) + 0.2::DOUBLE * least(1, greatest(0, (det_score - 0.3::DOUBLE) / 0.6::DOUBLE))) AS geo_score,
  CASE WHEN abs(yaw_ratio) > 1.6::DOUBLE OR eye_dist_ratio < 0.08::DOUBLE THEN 1 ELSE 0 END AS pp FROM geo),
c1 AS (SELECT *, least(3, least(3, CASE WHEN side >= 64 THEN CASE WHEN geo_score >= 0.5::DOUBLE THEN 0 ELSE 1 END WHEN side >= 32 THEN 1
   WHEN side >= 20 THEN CASE WHEN geo_score >= 0.45::DOUBLE THEN 2 ELSE 3 END ELSE 3 END + pp)
   + CASE WHEN eq_score < 0.075::DOUBLE THEN 2 WHEN eq_score < 0.15::DOUBLE THEN 1 ELSE 0 END) AS t0,
  ((det_score < 0.5::DOUBLE AND eq_score < 0.25::DOUBLE) OR (side < 80 AND eq_score < 0.15::DOUBLE)) AS downgraded FROM c0),
c2 AS (SELECT *, least(3, least(3, CASE WHEN downgraded THEN 3 ELSE t0 END + pp) + CASE WHEN det_score < 0.6::DOUBLE AND side < 250 THEN 2 ELSE 0 END) AS t1 FROM c1),
cls AS (SELECT *, (['high', 'medium', 'low', 'very_low'])[t0 + 1] AS base_tier, (['high', 'medium', 'low', 'very_low'])[t1 + 1] AS face_quality, t1 < 3 AS embed FROM c2)
"""


def classified(v):
    return dt.classify(v.detections)


@query("p01_score_threshold", ctes("detections") + """
SELECT image_id, det_seq, det_score FROM detections WHERE det_score >= 0.5::DOUBLE""")
def p01(v):
    return dt.score_threshold(v.detections).select("image_id", "det_seq", "det_score")


@query("p02_unscale_and_shift", ctes("detections") + """
SELECT image_id, det_seq, round(x1 / 0.5 + 10, 6) AS x1, round(y1 / 0.5 + 20, 6) AS y1, round(x2 / 0.5 + 10, 6) AS x2, round(y2 / 0.5 + 20, 6) AS y2,
       round(nox / 0.5 + 10, 6) AS nose_x, round(noy / 0.5 + 20, 6) AS nose_y FROM detections""")
def p02(v):
    moved = dt.shift_tile(dt.unscale(v.detections, F.lit(0.5)), F.lit(10), F.lit(20))
    rows = moved.select("image_id", "det_seq", "x1", "y1", "x2", "y2", bx.kp(2, "x").alias("nose_x"), bx.kp(2, "y").alias("nose_y"))
    return rounded(rows, "x1", "y1", "x2", "y2", "nose_x", "nose_y")


@query("p03_tile_grid", ctes("images") + """,
g AS (SELECT *, width / 2.8::DOUBLE AS tw, height / 2.8::DOUBLE AS th FROM images, (SELECT unnest([0, 1, 2]) AS tx), (SELECT unnest([0, 1, 2]) AS ty)),
b AS (SELECT *, floor(tx * 0.9::DOUBLE * tw) AS bx, floor(ty * 0.9::DOUBLE * th) AS bb FROM g)
SELECT image_id, tx, ty, CAST(bx AS BIGINT) AS x1, CAST(bb AS BIGINT) AS y1,
       CAST(CASE WHEN tx = 2 THEN width ELSE least(width, ceil(bx + tw)) END AS BIGINT) AS x2,
       CAST(CASE WHEN ty = 2 THEN height ELSE least(height, ceil(bb + th)) END AS BIGINT) AS y2 FROM b""")
def p03(v):
    return dt.tile_grid(v.images, 3, 0.1)


@query("p04_plan_tiling", ctes("images", "detections") + """,
s AS (SELECT image_id, count(*) AS faces, bool_or(w < 80) AS tiny FROM detections GROUP BY image_id)
SELECT i.image_id, coalesce(faces, 0) AS faces,
  CASE WHEN faces > 0 AND (tiny OR faces >= 6 OR (faces >= 3 AND width * height / 1e6 <= 4)) THEN 2 ELSE 0 END AS grid, coalesce(tiny, false) AS refine
FROM images i LEFT JOIN s ON s.image_id = i.image_id""")
def p04(v):
    return dt.plan_tiling(v.images, v.detections)


def nms_sql(limit: float, pixel: int) -> str:
    """Greedy suppression as a recursion over the ranks of each image."""
    overlap = f"greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1) + {pixel}) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1) + {pixel})"
    areas = f"(k.x2 - k.x1 + {pixel}) * (k.y2 - k.y1 + {pixel}) + (o.x2 - o.x1 + {pixel}) * (o.y2 - o.y1 + {pixel})"
    box = "{'seq': o.det_seq, 'score': o.det_score, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}"
    return ctes("detections") + f""",
o AS (SELECT image_id, det_seq, det_score, x1, y1, x2, y2, row_number() OVER (PARTITION BY image_id ORDER BY det_score DESC, det_seq) AS rn FROM detections),
r AS (WITH RECURSIVE s(image_id, rn, kept) AS (
  SELECT image_id, rn, [{box}] FROM o WHERE rn = 1
  UNION ALL SELECT s.image_id, o.rn, CASE WHEN len(list_filter(s.kept, lambda k: ({overlap}) / ({areas} - ({overlap})) > {limit}::DOUBLE)) = 0 THEN list_append(s.kept, {box}) ELSE s.kept END
  FROM s JOIN o ON o.image_id = s.image_id AND o.rn = s.rn + 1) SELECT * FROM s),
f AS (SELECT image_id, unnest(arg_max(kept, rn)) AS k FROM r GROUP BY image_id)
SELECT image_id, k.seq AS det_seq, k.score AS det_score FROM f"""


@query("p05_nms", nms_sql(0.3, 0))
def p05(v):
    return dt.nms(v.detections).select("image_id", "det_seq", "det_score")


@query("p05_nms_detector", nms_sql(0.4, 1))
def p05d(v):
    return dt.nms(v.detections, "detector").select("image_id", "det_seq", "det_score")


@query("p06_iou", ctes("detections") + """,
p AS (SELECT a.image_id, a.det_seq AS seq_a, b.det_seq AS seq_b,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
  a.w * a.h + b.w * b.h AS areas FROM detections a JOIN detections b ON a.image_id = b.image_id AND b.det_seq = a.det_seq + 1)
SELECT image_id, seq_a, seq_b, round(inter / (areas - inter), 6) AS iou FROM p""")
def p06(v):
    box = F.struct("x1", "y1", "x2", "y2")
    a = v.detections.select("image_id", F.col("det_seq").alias("seq_a"), box.alias("a"), (F.col("det_seq") + 1).alias("seq_b"))
    b = v.detections.select("image_id", F.col("det_seq").alias("seq_b"), box.alias("b"))
    rows = a.join(b, ["image_id", "seq_b"]).withColumn("iou", bx.iou("a", "b"))
    return rounded(rows.select("image_id", "seq_a", "seq_b", "iou"), "iou")


@query("p07_face_geometry", ctes("detections") + "," + GEO_SQL + """
SELECT image_id, det_seq, pose_valid, round(eye_dist_ratio, 6) AS eye_dist_ratio, round(yaw_ratio, 6) + 0.0 AS yaw_ratio FROM geo""")
def p07(v):
    rows = dt.face_geometry(v.detections).select("image_id", "det_seq", "pose_valid", "eye_dist_ratio", "yaw_ratio")
    return rounded(rows, "eye_dist_ratio", "yaw_ratio")


@query("p08_gate", ctes("detections") + "," + GEO_SQL + "SELECT image_id, det_seq, reject_reason FROM cls")
def p08(v):
    return dt.gate(dt.face_geometry(v.detections)).select("image_id", "det_seq", "reject_reason")


@query("p09_geometric_score", ctes("detections") + "," + GEO_SQL + "SELECT image_id, det_seq, round(geo_score, 6) AS geo_score FROM cls")
def p09(v):
    return rounded(v.detections.select("image_id", "det_seq", dt.geometric_score().alias("geo_score")), "geo_score")


@query("p10_quality_tier", ctes("detections") + "," + GEO_SQL + "SELECT image_id, det_seq, base_tier FROM cls")
def p10(v):
    return dt.quality_tier(dt.face_geometry(v.detections)).select("image_id", "det_seq", "base_tier")


@query("p11_composite_gate", ctes("detections") + "," + GEO_SQL + "SELECT image_id, det_seq, downgraded, face_quality FROM cls")
def p11(v):
    return classified(v).select("image_id", "det_seq", "downgraded", "face_quality")


@query("p12_embed_eligible", ctes("detections") + "," + GEO_SQL + """
SELECT image_id, det_seq, face_quality, embed, eq_score AS quality_score, NOT embed AS low_quality FROM cls WHERE reject_reason IS NULL""")
def p12(v):
    rows = classified(v).where("reject_reason IS NULL")
    return rows.select("image_id", "det_seq", "face_quality", "embed", "quality_score", "low_quality")


@query("p13_detection_breakdown", ctes("detections") + "," + GEO_SQL + """
SELECT image_id, count(*) FILTER (WHERE pass = 0) AS raw_full, count(*) FILTER (WHERE pass > 0) AS raw_tile, count(*) AS after_nms,
  count(*) FILTER (WHERE reject_reason IS NULL) AS after_gate, count(*) FILTER (WHERE reject_reason = 'tiny') AS rejected_tiny,
  count(*) FILTER (WHERE reject_reason = 'score') AS rejected_score, count(*) FILTER (WHERE reject_reason = 'kps') AS rejected_kps,
  count(*) FILTER (WHERE reject_reason IS NULL AND downgraded) AS quality_downgraded, count(*) FILTER (WHERE reject_reason IS NULL AND embed) AS embedded,
  count(*) FILTER (WHERE reject_reason IS NULL AND face_quality = 'high') AS high, count(*) FILTER (WHERE reject_reason IS NULL AND face_quality = 'medium') AS medium,
  count(*) FILTER (WHERE reject_reason IS NULL AND face_quality = 'low') AS low, count(*) FILTER (WHERE reject_reason IS NULL AND face_quality = 'very_low') AS very_low
FROM cls GROUP BY ROLLUP (image_id)""")
def p13(v):
    return dt.detection_breakdown(v.detections, classified(v))


@query("p13_breakdown_after_nms", nms_sql(0.3, 0).rsplit("SELECT image_id, k.seq", 1)[0] + "," + GEO_SQL + """,
m AS (SELECT cls.*, q.det_seq IS NOT NULL AS kept, q.det_seq IS NOT NULL AND reject_reason IS NULL AS ok
      FROM cls LEFT JOIN (SELECT image_id, k.seq AS det_seq FROM f) q ON q.image_id = cls.image_id AND q.det_seq = cls.det_seq)
SELECT image_id, count(*) FILTER (WHERE pass = 0) AS raw_full, count(*) FILTER (WHERE pass > 0) AS raw_tile, count(*) FILTER (WHERE kept) AS after_nms,
  count(*) FILTER (WHERE ok) AS after_gate, count(*) FILTER (WHERE kept AND reject_reason = 'tiny') AS rejected_tiny,
  count(*) FILTER (WHERE kept AND reject_reason = 'score') AS rejected_score, count(*) FILTER (WHERE kept AND reject_reason = 'kps') AS rejected_kps,
  count(*) FILTER (WHERE ok AND downgraded) AS quality_downgraded, count(*) FILTER (WHERE ok AND embed) AS embedded,
  count(*) FILTER (WHERE ok AND face_quality = 'high') AS high, count(*) FILTER (WHERE ok AND face_quality = 'medium') AS medium,
  count(*) FILTER (WHERE ok AND face_quality = 'low') AS low, count(*) FILTER (WHERE ok AND face_quality = 'very_low') AS very_low
FROM m GROUP BY ROLLUP (image_id)""")
def p13n(v):
    """Rows are classified before suppression, so that their flags are shuffled and not their landmarks."""
    return dt.detection_breakdown(v.detections, dt.nms(dt.classify(v.detections)))


@query("p14_landmark_ratios", ctes("detections") + """,
m AS (SELECT *, sqrt((rex - lex) * (rex - lex) + (rey - ley) * (rey - ley)) AS eyes, (rex + lex) / 2 AS mx, (rey + ley) / 2 AS my, (rmy + lmy) / 2 AS mo,
      greatest(1, w) AS bw, greatest(1, h) AS bh FROM detections),
s AS (SELECT *, CASE WHEN eyes = 0 THEN 1 ELSE eyes END AS span FROM m)
SELECT image_id, det_seq, CAST(floor(greatest(w, h) + 0.5) AS BIGINT) AS size, round(eyes / bw, 6) AS eye_dist, round(span / greatest(1, least(w, h)), 6) AS eye_dist_ratio,
  round((my - y1) / bh, 6) AS eye_y_ratio, round((noy - my) / bh, 6) AS nose_below_eye, round(mo - noy, 6) AS mouth_below_nose,
  round((mo - my) / bh, 6) AS eye_mouth_span, round((nox - mx) / span, 6) + 0.0 AS yaw_ratio, round((mx - x1) / bw, 6) AS eye_mid_x_ratio FROM s""")
def p14(v):
    rows = dt.landmark_ratios(v.detections)
    return rounded(rows, *[c for c in rows.columns if c not in ("image_id", "det_seq", "size")])


@query("p15_gate_sweep", ctes("detections") + """,
f AS (SELECT * FROM detections WHERE greatest(w, h) >= 64)
SELECT g AS gate, (SELECT count(*) FROM f) AS faces, count(*) FILTER (WHERE det_score < g AND eq_score < 0.25::DOUBLE) AS downgraded,
       round(100.0::DOUBLE * count(*) FILTER (WHERE det_score < g AND eq_score < 0.25::DOUBLE) / count(*), 6) AS percent
FROM f, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7]::DOUBLE[]) AS g) GROUP BY g""")
def p15(v):
    return rounded(dt.gate_sweep(v.detections), "percent")


@query("p16_gate_effect", ctes("detections") + "," + GEO_SQL + """,
k AS (SELECT *, floor((x1 + x2) / 20 + 0.5) AS cx, floor((y1 + y2) / 20 + 0.5) AS cy FROM cls),
t AS (SELECT DISTINCT image_id, cx, cy FROM k WHERE eq_score < 0.05::DOUBLE),
r AS (SELECT k.*, t.image_id IS NOT NULL AS target FROM k LEFT JOIN t ON t.image_id = k.image_id AND t.cx = k.cx AND t.cy = k.cy WHERE reject_reason IS NULL)
SELECT count(*) AS detections, count(*) FILTER (WHERE embed) AS embedded, count(*) FILTER (WHERE face_quality = 'high') AS high,
  count(*) FILTER (WHERE face_quality = 'medium') AS medium, count(*) FILTER (WHERE face_quality = 'low') AS low, count(*) FILTER (WHERE face_quality = 'very_low') AS very_low,
  count(*) FILTER (WHERE target) AS target_faces, count(*) FILTER (WHERE target AND embed) AS target_embedded,
  count(*) FILTER (WHERE NOT target AND side >= 64 AND det_score >= 0.7::DOUBLE) AS good_faces,
  count(*) FILTER (WHERE NOT target AND side >= 64 AND det_score >= 0.7::DOUBLE AND NOT embed) AS good_downgraded FROM r""")
def p16(v):
    truth = v.detections.where("eq_score < 0.05D")
    return dt.gate_effect(classified(v), truth)


SETTINGS = [
    {"name": "off", "off": True},
    {"name": "blur 0.15", "eq_score": 0.15},
    {"name": "default"},
    {"name": "strict", "det_score": 0.7, "eq_score": 0.4, "tiny_side": 100, "eq_tiny": 0.3},
]


def gate_comparison_sql() -> str:
    values = []
    for c in SETTINGS:
        limits = (0.5, 0, 80, 0) if c.get("off") else (c.get("det_score", 0.5), c.get("eq_score", 0.25), c.get("tiny_side", 80), c.get("eq_tiny", 0.15))
        values.append(f"('{c['name']}', {', '.join(f'{x}::DOUBLE' for x in limits)})")
    settings = f"settings(setting, g_det, g_eq, g_side, g_tiny) AS (VALUES {', '.join(values)})"
    default = "((det_score < 0.5::DOUBLE AND eq_score < 0.25::DOUBLE) OR (side < 80 AND eq_score < 0.15::DOUBLE)) AS downgraded FROM c0)"
    gated = "((det_score < g_det AND eq_score < g_eq) OR (side < g_side AND eq_score < g_tiny)) AS downgraded FROM c0, settings)"
    assert default in GEO_SQL
    report = REGISTRY["p16_gate_effect"].sql.split(GEO_SQL)[1]
    report = report.replace("SELECT count(*) AS detections", "SELECT setting, count(*) AS detections") + " GROUP BY setting"
    return ctes("detections") + f", {settings}, " + GEO_SQL.replace(default, gated) + report


@query("p16_gate_comparison", gate_comparison_sql())
def p16c(v):
    return dt.gate_comparison(v.detections, v.detections.where("eq_score < 0.05D"), SETTINGS)


EXPECTED = "SELECT o_orderkey AS image_id, CAST(1 + o_custkey % 7 AS BIGINT) AS expected FROM orders"


@query("p17_detection_recall", ctes("detections") + f""", x AS ({EXPECTED}),
d AS (SELECT image_id, count(*) AS n FROM detections GROUP BY image_id),
r AS (SELECT x.image_id, expected, coalesce(n, 0) AS detected, greatest(0, expected - coalesce(n, 0)) AS missed, greatest(0, coalesce(n, 0) - expected) AS extra
      FROM x LEFT JOIN d ON d.image_id = x.image_id),
s AS (SELECT image_id, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extra) AS BIGINT) AS extra FROM r GROUP BY ROLLUP (image_id))
SELECT *, round(expected / greatest(1, detected), 6) AS "precision", round((expected - missed) / expected, 6) AS recall FROM s""")
def p17(v):
    expected = v.raw("orders").selectExpr("o_orderkey AS image_id", "CAST(1 + o_custkey % 7 AS BIGINT) AS expected")
    return rounded(dt.detection_recall(v.detections, expected), "precision", "recall")


@query("p17_detections_by_size", ctes("detections") + "," + GEO_SQL + """
SELECT CASE WHEN w >= 101 THEN '>100' WHEN w >= 65 THEN '64-100' WHEN w >= 33 THEN '32-64' WHEN w >= 21 THEN '20-32' WHEN w >= 1 THEN '<20' ELSE '?' END AS bucket,
  count(*) AS n, count(*) FILTER (WHERE embed) AS embedded, count(*) FILTER (WHERE face_quality = 'high') AS high,
  count(*) FILTER (WHERE face_quality = 'medium') AS medium, count(*) FILTER (WHERE face_quality = 'low') AS low, count(*) FILTER (WHERE face_quality = 'very_low') AS very_low
FROM cls WHERE reject_reason IS NULL GROUP BY 1""")
def p17s(v):
    return dt.detections_by_size(classified(v))


@query("p18_pixel_budget", ctes("images", "detections") + """
SELECT d.image_id, d.det_seq, round(width * height / 1e6, 6) AS area_mpx, round(100 * w / width, 6) AS width_percent, greatest(w, h) AS largest_side
FROM detections d JOIN images i ON i.image_id = d.image_id""")
def p18(v):
    return rounded(dt.pixel_budget(v.detections, v.images), "area_mpx", "width_percent")


@query("v19_nearest_detection", ctes("detections") + """,
r AS (SELECT image_id, det_seq AS ref_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(w, h) AS side FROM detections WHERE pass = 0),
d AS (SELECT image_id, det_seq AS det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM detections WHERE pass > 0),
b AS (SELECT d.image_id, d.det_id, r.ref_id, round(sqrt((d.cx - r.cx) * (d.cx - r.cx) + (d.cy - r.cy) * (d.cy - r.cy)), 6) AS distance, greatest(12, 0.4::DOUBLE * r.side) AS tol
      FROM d JOIN r ON r.image_id = d.image_id QUALIFY row_number() OVER (PARTITION BY d.image_id, d.det_id ORDER BY distance, ref_id) = 1)
SELECT image_id, det_id, ref_id, distance FROM b WHERE distance <= tol""")
def v19(v):
    cx, cy = ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy")
    refs = v.detections.where("pass = 0").select("image_id", F.col("det_seq").alias("ref_id"), cx, cy, bx.long_side().alias("side"))
    dets = v.detections.where("pass > 0").select("image_id", F.col("det_seq").alias("det_id"), cx, cy)
    return rounded(dt.nearest_detection(refs, dets), "distance")
