"""Evaluation queries over the fixture views.

Two clusterings serve as input: ``person_id``, and faces spread over seven groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinframe.functions import boxes as bx
from kinframe.operators import evaluate as ev
from kinframe.plans.registry import ctes, query
from kinframe.plans.vector_queries import COS, LOW, recursive, root_linkage_sql, rounded, running_average_sql
from kinframe.session import checkpoint_root
from kinframe.sources import catalog_io as io


def labelled(v):
    return v.faces.withColumn("label", F.col("true_label"))


def assigned(v):
    return labelled(v).withColumns({"cluster": F.col("face_id") % 7, "side": bx.long_side()})


def both(v):
    return v.faces.select("face_id", "photo_id", "quality_score", F.col("person_id").alias("a"), (F.col("face_id") % 7).alias("b"))


EMB = "e AS (SELECT *, greatest(x2 - x1, y2 - y1) AS side FROM faces WHERE embedding IS NOT NULL)"
ASG = "g AS (SELECT *, face_id % 7 AS cluster, true_label AS label, greatest(x2 - x1, y2 - y1) AS side FROM faces)"
BUCKET = "CASE WHEN {s} > 100 THEN '>100' WHEN {s} >= 64 THEN '64-100' WHEN {s} >= 32 THEN '32-64' WHEN {s} >= 20 THEN '20-32' ELSE '<20' END"
TIER = "CASE {q} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
NAMES = "(['high', 'medium', 'low', 'very_low'])"
QPAIR = f"concat({NAMES}[least(ta, tb) + 1], '-', {NAMES}[greatest(ta, tb) + 1])"
PAIRS = f""",
pr AS (SELECT a.face_id AS id_a, b.face_id AS id_b, {COS}(a.embedding, b.embedding) AS s, a.true_label = b.true_label AS same, a.photo_id <> b.photo_id AS cross_photo,
       {TIER.format(q='a.face_quality')} AS ta, {TIER.format(q='b.face_quality')} AS tb, least(a.side, b.side) AS ms
       FROM e a JOIN e b ON a.face_id < b.face_id)
"""
RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"""
F1 = """CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END"""


@query("e01_subjects", ctes("faces") + f""", {EMB}
SELECT photo_id, face_id, true_label AS label FROM (SELECT *, greatest(x2 - x1, y2 - y1) AS side FROM faces)
QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY side DESC, face_order) = 1""")
def e01(v):
    return ev.subjects(labelled(v)).select("photo_id", "face_id", "label")


@query("e01_subjects_with_ties", ctes("faces") + """
SELECT photo_id, face_id, true_label AS label FROM (SELECT *, greatest(x2 - x1, y2 - y1) AS side FROM faces)
QUALIFY side = max(side) OVER (PARTITION BY photo_id)""")
def e01t(v):
    return ev.subjects(labelled(v), keep_ties=True).select("photo_id", "face_id", "label")


@query("e02_propagate_labels", ctes("faces") + f"""
SELECT DISTINCT f.face_id, f.true_label AS label FROM faces f JOIN faces c ON c.true_label = f.true_label AND c.face_quality = 'high' AND f.face_quality <> 'high'
 AND f.embedding IS NOT NULL AND c.embedding IS NOT NULL AND {COS}(f.embedding, c.embedding) >= 0.30""")
def e02(v):
    f = labelled(v)
    crops = f.where("face_quality = 'high'").select(F.col("face_id").alias("id"), "label", "embedding")
    faces = f.where("face_quality <> 'high'").select("face_id", F.col("label").alias("folder_label"), "embedding")
    return ev.propagate_labels(crops, faces, 0.30)


@query("e03_pair_dataset", ctes("faces") + f", {EMB}" + PAIRS + f"""
SELECT id_a, id_b, round(s, 6) AS sim, CASE WHEN same THEN 'same' ELSE 'diff' END AS kind, cross_photo, {QPAIR} AS q_pair, {BUCKET.format(s='ms')} AS size_bucket
FROM pr WHERE s >= 0.30""")
def e03(v):
    return rounded(ev.pair_dataset(labelled(v), 0.30), "sim")


@query("e03_pair_counts", ctes("faces") + f", {EMB}" + PAIRS + """,
k AS (SELECT * FROM (VALUES ('same', true), ('same', false), ('diff', true), ('diff', false)) t(kind, cross_photo))
SELECT k.kind, k.cross_photo, count(pr.id_a) AS pairs FROM k LEFT JOIN pr ON k.kind = CASE WHEN pr.same THEN 'same' ELSE 'diff' END AND k.cross_photo = pr.cross_photo GROUP BY ALL""")
def e03c(v):
    return ev.pair_counts(labelled(v))


@query("e04_within_photo_pairs", ctes("faces") + f"""
SELECT a.photo_id, a.face_id AS id_a, b.face_id AS id_b, round({COS}(a.embedding, b.embedding), 6) AS sim FROM faces a JOIN faces b
ON a.photo_id = b.photo_id AND a.face_id < b.face_id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL WHERE {COS}(a.embedding, b.embedding) >= 0.10""")
def e04(v):
    return rounded(ev.within_photo_pairs(v.faces, 0.10), "sim")


@query("e05_cross_frame_pairs", ctes("photos", "faces") + f""",
fr AS (SELECT photo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY path) AS frame FROM photos),
b AS (SELECT f.*, folder, frame FROM faces f JOIN fr ON fr.photo_id = f.photo_id WHERE embedding IS NOT NULL),
p AS (SELECT l.folder, l.frame, l.face_id AS id_a, r.face_id AS id_b, l.embedding AS ea, r.embedding AS eb,
  greatest(0, least(l.x2, r.x2) - greatest(l.x1, r.x1)) * greatest(0, least(l.y2, r.y2) - greatest(l.y1, r.y1)) AS inter,
  (l.x2 - l.x1) * (l.y2 - l.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) AS areas FROM b l JOIN b r ON l.folder = r.folder AND r.frame = l.frame + 1)
SELECT folder, frame, id_a, id_b, round(inter / (areas - inter), 6) AS iou, round({COS}(ea, eb), 6) + 0.0 AS sim FROM p WHERE inter / (areas - inter) >= 0.02""")
def e05(v):
    return rounded(ev.cross_frame_pairs(v.faces, v.photos, 0.02), "iou", "sim")


@query("e06_quality_pair", ctes("faces") + f""",
c AS (SELECT a.photo_id, {TIER.format(q='a.face_quality')} AS ta, {TIER.format(q='b.face_quality')} AS tb FROM faces a JOIN faces b ON a.face_order + 1 = b.face_order)
SELECT {QPAIR} AS q_pair, count(*) AS pairs FROM c GROUP BY 1""")
def e06(v):
    a = v.faces.select((F.col("face_order") + 1).alias("o"), F.col("face_quality").alias("qa"))
    b = v.faces.select(F.col("face_order").alias("o"), F.col("face_quality").alias("qb"))
    return a.join(b, "o").groupBy(ev.quality_pair(F.col("qa"), F.col("qb")).alias("q_pair")).agg(F.count(F.lit(1)).alias("pairs"))


@query("e07_size_bucket", ctes("faces") + f""", {ASG}
SELECT {BUCKET.format(s='side')} AS quality_band, CASE WHEN side >= 100.5 THEN '>100' WHEN side >= 64.5 THEN '64-100' WHEN side >= 32.5 THEN '32-64' WHEN side >= 20.5 THEN '20-32' WHEN side >= 1 THEN '<20' ELSE '?' END AS pixel_band,
count(*) AS faces FROM g GROUP BY ALL""")
def e07(v):
    side = bx.long_side()
    return v.faces.groupBy(
        ev.size_bucket(side).alias("quality_band"), ev.size_bucket(side, "half_pixel").alias("pixel_band")
    ).agg(F.count(F.lit(1)).alias("faces"))


def dist_sql(group: str, rank: str, where: str) -> str:
    return ctes("faces") + f", {EMB}" + PAIRS + f""",
d AS (SELECT CASE WHEN same THEN 'same' ELSE 'diff' END AS kind, {group} AS q_pair, CAST(s AS FLOAT) AS s FROM pr {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, q_pair ORDER BY s) - 1 AS rn, count(*) OVER (PARTITION BY kind, q_pair) AS n FROM d),
t AS (SELECT unnest({ev.QUANTILES}::DOUBLE[]) AS quantile)
SELECT kind, q_pair, n AS pairs, quantile, round(CAST(s AS DOUBLE), 6) + 0.0 AS sim FROM r JOIN t ON rn = {rank}"""


@query("e08_sim_distribution", dist_sql(QPAIR, "least(n - 1, CAST(floor(quantile * n) AS BIGINT))", "WHERE cross_photo"))
def e08(v):
    return rounded(ev.sim_distribution(labelled(v)), "sim")


@query("e08_sim_distribution_lower_rule", dist_sql("'all'", "CAST(floor(quantile * (n - 1)) AS BIGINT)", ""))
def e08l(v):
    return rounded(ev.sim_distribution(labelled(v), by_quality=False, rule="n-1", cross_photo_only=False), "sim")


@query("e09_capped_pairs", ctes("faces") + f""",
f AS (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY face_order) AS i, count(*) OVER (PARTITION BY true_label) AS n, min(face_order) OVER (PARTITION BY true_label) AS first_at FROM faces WHERE embedding IS NOT NULL),
m AS (SELECT *, dense_rank() OVER (ORDER BY first_at) AS lab FROM f WHERE n >= 2),
p AS (SELECT 'positive' AS kind, a.face_order AS id_a, b.face_order AS id_b, {COS}(a.embedding, b.embedding) AS sim FROM m a JOIN m b ON a.lab = b.lab AND a.i < b.i ORDER BY a.lab, a.i, b.i LIMIT 3000),
q AS (SELECT 'negative' AS kind, a.face_order AS id_a, b.face_order AS id_b, {COS}(a.embedding, b.embedding) AS sim FROM m a JOIN m b ON a.lab < b.lab AND a.i <= 3 AND b.i <= 3 ORDER BY a.lab, b.lab, a.i, b.i LIMIT 300)
SELECT kind, id_a, id_b, round(sim, 6) + 0.0 AS sim FROM (SELECT * FROM p UNION ALL SELECT * FROM q)""")
def e09(v):
    return rounded(ev.capped_pairs(labelled(v), max_pos=3000, max_neg=300), "sim")


SWEEP = [0.05, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4]


@query("e10_threshold_sweep", ctes("faces") + f", {EMB}" + PAIRS + f""",
t AS (SELECT unnest({SWEEP}::DOUBLE[]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE same AND s >= threshold) AS tp, count(*) FILTER (WHERE NOT same AND s >= threshold) AS fp,
  count(*) FILTER (WHERE same AND s < threshold) AS fn, count(*) FILTER (WHERE NOT same AND s < threshold) AS tn FROM pr, t GROUP BY threshold),
m AS (SELECT *, {RATES}, fp / (fp + tn) AS far FROM c)
SELECT threshold, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(far, 6) AS far, round({F1}, 6) AS f1 FROM m""")
def e10(v):
    return rounded(ev.threshold_sweep(labelled(v), SWEEP), "precision", "recall", "far", "f1")


@query("e11_false_merge_risk", ctes("faces") + f", {EMB}" + PAIRS + f""",
t AS (SELECT unnest({SWEEP}::DOUBLE[]) AS threshold)
SELECT threshold, count(*) AS pairs, count(*) FILTER (WHERE s >= threshold) AS risky, round(100 * count(*) FILTER (WHERE s >= threshold) / count(*), 6) AS percent
FROM pr, t WHERE NOT cross_photo GROUP BY threshold""")
def e11(v):
    return rounded(ev.false_merge_risk(v.faces, SWEEP), "percent")


@query("e12_pair_metrics", ctes("faces") + f""", {ASG},
p AS (SELECT a.label = b.label AS same, a.cluster = b.cluster AS pred FROM g a JOIN g b ON a.face_id < b.face_id),
c AS (SELECT count(*) FILTER (WHERE same AND pred) AS tp, count(*) FILTER (WHERE NOT same AND pred) AS fp, count(*) FILTER (WHERE same AND NOT pred) AS fn, count(*) FILTER (WHERE NOT same AND NOT pred) AS tn FROM p),
m AS (SELECT *, {RATES} FROM c)
SELECT tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round({F1}, 6) AS f1 FROM m""")
def e12(v):
    return rounded(ev.pair_metrics(assigned(v)), "precision", "recall", "f1")


@query("e13_recall_by_size", ctes("faces") + f""", {ASG},
p AS (SELECT a.cluster = b.cluster AS pred, {BUCKET.format(s='least(a.side, b.side)')} AS bucket FROM g a JOIN g b ON a.face_id < b.face_id AND a.label = b.label),
k AS (SELECT unnest(['<20', '20-32', '32-64', '64-100', '>100']) AS bucket)
SELECT k.bucket, count(pred) AS same_pairs, count(*) FILTER (WHERE pred) AS recovered, round(CASE WHEN count(pred) > 0 THEN count(*) FILTER (WHERE pred) / count(pred) END, 6) AS recall
FROM k LEFT JOIN p ON p.bucket = k.bucket GROUP BY k.bucket""")
def e13(v):
    return rounded(ev.recall_by_size(assigned(v)), "recall")


@query("e14_purity", ctes("faces") + f""", {ASG},
c AS (SELECT cluster, label, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT cluster, max(n) AS top, sum(n) AS n FROM c GROUP BY cluster)
SELECT count(*) AS clusters, CAST(sum(top) AS BIGINT) AS pure, CAST(sum(n) AS BIGINT) AS labelled, round(sum(top) / sum(n), 6) AS purity FROM t""")
def e14(v):
    return rounded(ev.purity(assigned(v)), "purity")


CONFIGS = [
    {"name": "global 0.30", "threshold": 0.30, "gated": False},
    {"name": "global 0.35", "threshold": 0.35, "gated": False},
    {"name": "gated 0.30", "threshold": 0.30, "gated": True, "low_join": 0.35},
]


def config_sweep_sql() -> str:
    """The clustering of every config, and its sizes and pair metrics."""
    parts, rows = [], []
    for i, c in enumerate(CONFIGS):
        low = LOW if c["gated"] else "false AS low"
        faces = f"SELECT face_order, true_label AS label, embedding AS e, {low} FROM faces WHERE embedding IS NOT NULL"
        parts.append(root_linkage_sql(faces, c["threshold"], c.get("low_join", 0.6), f"_{i}"))
        rows.append(f"SELECT '{c['name']}' AS config, {c['threshold']}::DOUBLE AS threshold, cluster, label FROM linked_{i}")
    return recursive(ctes("faces")) + "," + ",".join(parts) + f""",
a AS MATERIALIZED ({' UNION ALL '.join(rows)}),
s AS (SELECT config, threshold, count(*) AS clusters, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS largest
      FROM (SELECT config, threshold, cluster, count(*) AS n FROM a GROUP BY ALL) GROUP BY ALL),
cell AS (SELECT config, cluster, label, count(*) AS n FROM a WHERE label IS NOT NULL GROUP BY ALL),
tp AS (SELECT config, sum(n * (n - 1) // 2)::BIGINT AS tp FROM cell GROUP BY config),
pc AS (SELECT config, sum(n * (n - 1) // 2)::BIGINT AS c, sum(top) / sum(n) AS purity FROM (SELECT config, cluster, sum(n)::BIGINT AS n, max(n) AS top FROM cell GROUP BY ALL) GROUP BY config),
pl AS (SELECT config, sum(n * (n - 1) // 2)::BIGINT AS l FROM (SELECT config, label, sum(n)::BIGINT AS n FROM cell GROUP BY ALL) GROUP BY config),
al AS (SELECT config, (sum(n) * (sum(n) - 1) // 2)::BIGINT AS t FROM cell GROUP BY config),
c AS (SELECT s.*, tp.tp, pc.c - tp.tp AS fp, pl.l - tp.tp AS fn, al.t - pc.c - pl.l + tp.tp AS tn, purity
      FROM s JOIN tp USING (config) JOIN pc USING (config) JOIN pl USING (config) JOIN al USING (config)),
m AS (SELECT *, {RATES} FROM c)
SELECT clusters, singletons, largest, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round({F1}, 6) AS f1,
       round(purity, 6) AS purity, config, threshold FROM m"""


@query("e15_config_sweep", config_sweep_sql())
def e15(v):
    return rounded(ev.config_sweep(labelled(v), CONFIGS), "precision", "recall", "f1", "purity")


@query("e16_false_merges", ctes("faces") + f""", {ASG},
c AS (SELECT person_id AS cluster, label % 3 AS label, count(*) AS n FROM (SELECT person_id, cluster AS label FROM g) WHERE person_id IS NOT NULL GROUP BY ALL),
d AS (SELECT cluster, label AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1),
z AS (SELECT person_id AS cluster, count(*) AS cluster_size FROM faces WHERE person_id IS NOT NULL GROUP BY 1)
SELECT c.cluster, cluster_size, dominant, c.label AS minority, c.n AS faces FROM c JOIN d ON d.cluster = c.cluster JOIN z ON z.cluster = c.cluster WHERE c.label <> dominant AND cluster_size >= 2""")
def e16(v):
    rows = v.faces.select("face_id", F.col("person_id").alias("cluster"), (F.col("face_id") % 7 % 3).alias("label"))
    return ev.false_merges(rows)


@query("e16_false_splits", ctes("faces") + f""", {ASG},
c AS (SELECT cluster, label, count(*) AS n FROM g GROUP BY ALL)
SELECT label, count(*) OVER (PARTITION BY label) AS clusters, cluster, n AS faces FROM c QUALIFY clusters > 1""")
def e16s(v):
    return ev.false_splits(assigned(v))


@query("e17_split_report", ctes("faces", "persons") + """,
c AS (SELECT true_label AS identity, person_id, count(*) AS faces FROM faces WHERE person_id IS NOT NULL GROUP BY ALL)
SELECT identity, count(*) OVER (PARTITION BY identity) AS clusters, count(*) OVER (PARTITION BY identity) > 1 AS split, c.person_id, pe.name AS person_name, faces
FROM c JOIN persons pe ON pe.person_id = c.person_id""")
def e17(v):
    return ev.split_report(labelled(v), v.persons)


@query("e17_split_summary", ctes("faces") + """,
c AS (SELECT true_label, count(DISTINCT person_id) AS c FROM faces WHERE person_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS identities, count(*) FILTER (WHERE c > 1) AS split, round(100 * count(*) FILTER (WHERE c > 1) / count(*), 6) AS split_percent, coalesce(max(c) FILTER (WHERE c > 1), 0) AS max_clusters FROM c""")
def e17s(v):
    return rounded(ev.split_summary(labelled(v)), "split_percent")


@query("e18_mean_clusters_per_identity", recursive(ctes("faces")) + "," + running_average_sql("true_label", "[0.05, 0.1, 0.2]") + """,
p AS (SELECT threshold, label, max(cluster) AS c FROM r WHERE label IN (SELECT true_label FROM faces WHERE embedding IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) GROUP BY ALL)
SELECT threshold, round(avg(c), 6) AS clusters_per_identity, sum(c)::BIGINT AS clusters, count(*) AS identities, count(*) FILTER (WHERE c > 1) AS split,
       coalesce(max(c) FILTER (WHERE c > 1), 0)::BIGINT AS max_clusters FROM p GROUP BY threshold""")
def e18(v):
    return rounded(ev.mean_clusters_per_identity(labelled(v), [0.05, 0.1, 0.2]), "clusters_per_identity")


@query("e19_purity_check", ctes("faces") + f""", {ASG},
c AS (SELECT DISTINCT cluster, label FROM g), a AS (SELECT cluster, count(*) AS k FROM c GROUP BY 1), b AS (SELECT label, count(*) AS k FROM c GROUP BY 1)
SELECT (SELECT count(*) FROM a) AS clusters, (SELECT count(*) FROM a WHERE k > 1) AS mixed_clusters, (SELECT count(*) FROM b) AS identities,
       (SELECT count(*) FROM b WHERE k > 1) AS split_identities, (SELECT count(*) FROM a WHERE k > 1) = 0 AND (SELECT count(*) FROM b WHERE k > 1) = 0 AS passed""")
def e19(v):
    return ev.purity_check(assigned(v))


@query("e20_compare_clusterings", ctes("faces") + """
SELECT person_id AS cluster, count(*) AS faces, round(avg(quality_score), 6) AS avg_quality, count(DISTINCT face_id % 7) AS parts, count(DISTINCT photo_id) AS photos
FROM faces WHERE person_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT face_id % 7) > 1""")
def e20(v):
    return rounded(ev.compare_clusterings(both(v)), "avg_quality")


@query("e20_changed_faces", ctes("faces") + """,
c AS (SELECT person_id AS a, face_id % 7 AS b, count(*) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c)
SELECT CAST(sum(n) AS BIGINT) AS faces, CAST(sum(n) - coalesce(sum(n) FILTER (WHERE n = na AND n = nb), 0) AS BIGINT) AS changed, count(DISTINCT a) AS clusters_a, count(DISTINCT b) AS clusters_b FROM s""")
def e20c(v):
    return ev.changed_faces(both(v))


@query("e21_persons_per_photo", ctes("faces") + """
SELECT photo_id, count(*) AS faces, count(DISTINCT person_id) AS persons_a, count(DISTINCT face_id % 7) AS persons_b FROM faces GROUP BY photo_id""")
def e21(v):
    return ev.persons_per_photo(both(v))


@query("e21_persons_per_photo_summary", ctes("faces") + """,
p AS (SELECT photo_id, count(DISTINCT person_id) AS a, count(DISTINCT face_id % 7) AS b FROM faces GROUP BY photo_id)
SELECT count(*) AS photos, CAST(sum(a) AS BIGINT) AS total_a, CAST(sum(b) AS BIGINT) AS total_b, round(avg(a), 6) AS avg_a, round(avg(b), 6) AS avg_b FROM p""")
def e21s(v):
    return rounded(ev.persons_per_photo_summary(ev.persons_per_photo(both(v))), "avg_a", "avg_b")


@query("e22_size_report", ctes("faces") + """,
s AS (SELECT person_id, count(*) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY n DESC) AS INT) AS position, n AS size, (SELECT count(*) FROM s) AS clusters, (SELECT count(*) FROM s WHERE n = 1) AS singletons,
  (SELECT count(*) FROM s WHERE n >= 5) AS large FROM s ORDER BY n DESC LIMIT 10""")
def e22(v):
    return ev.size_report(both(v), "a")


IOU = "CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0 END"
INTER = "greatest(least(o.x2, b.x2) - greatest(o.x1, b.x1), 0) * greatest(least(o.y2, b.y2) - greatest(o.y1, b.y1), 0)"
UNION_AREA = f"((o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {INTER})"
GOLDEN_SQL = f"""
o AS (SELECT CAST(photo_id AS VARCHAR) AS photo, face_order AS det_seq, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, embedding AS e,
             row_number() OVER (PARTITION BY photo_id ORDER BY face_order) AS rn FROM faces),
gl AS (SELECT photo, list(struct_pack(face_seq := det_seq, x1 := x1 + 1, y1 := y1, x2 := x2 + 1, y2 := y2, e := e) ORDER BY det_seq) AS boxes FROM o GROUP BY photo),
r AS (SELECT photo, 0::BIGINT AS rn, 0::BIGINT AS det_seq, 0::BIGINT AS pick, 0.0::DOUBLE AS iou, NULL::DOUBLE AS cos, CAST([] AS BIGINT[]) AS used FROM gl
      UNION ALL
      SELECT photo, rn, det_seq, best, ratios[best], CASE WHEN e IS NOT NULL AND boxes[best].e IS NOT NULL THEN {COS}(e, boxes[best].e) END, list_append(used, best)
      FROM (SELECT *, list_position(ratios, list_max(ratios))::BIGINT AS best FROM (
        SELECT o.photo, o.rn, o.det_seq, o.e, gl.boxes, r.used,
               list_transform(gl.boxes, lambda b, i: CASE WHEN list_contains(r.used, i) THEN -1.0::DOUBLE ELSE {IOU.format(i=INTER, u=UNION_AREA)} END) AS ratios
        FROM r JOIN o ON o.photo = r.photo AND o.rn = r.rn + 1 JOIN gl ON gl.photo = r.photo)))
SELECT r.photo, r.det_seq, gl.boxes[pick].face_seq AS face_seq, round(iou, 6) AS iou, round(cos, 6) AS cos,
       CASE WHEN cos IS NOT NULL THEN iou >= 0.9 AND cos >= 0.97 END AS passed FROM r JOIN gl ON gl.photo = r.photo WHERE r.rn > 0"""


@query("e23_golden_match", recursive(ctes("faces")) + "," + GOLDEN_SQL)
def e23(v):
    rows = v.faces.select(
        F.col("photo_id").cast("string").alias("photo"), F.col("face_order").alias("det_seq"), "x1", "y1", "x2", "y2", "embedding"
    )
    # The golden side is the same faces with boxes moved by a pixel.
    golden = rows.select(
        "photo", F.col("det_seq").alias("face_seq"), (F.col("x1") + 1).alias("x1"), "y1", (F.col("x2") + 1).alias("x2"), "y2", "embedding"
    )
    return rounded(ev.golden_match(rows, golden), "iou", "cos")


@query("s06_golden_files", recursive(ctes("faces")) + "," + GOLDEN_SQL.replace("gl.boxes[pick].face_seq AS face_seq", "pick - 1 AS face_seq"))
def s06(v):
    """The golden side of e23 written as nested files and read back."""
    rows = v.faces.select(
        F.col("photo_id").cast("string").alias("photo"), F.col("face_order").alias("det_seq"), "x1", "y1", "x2", "y2", "embedding"
    )
    root = f"{checkpoint_root(v.spark)}/golden-{uuid.uuid4().hex}"
    io.write_golden(rows.selectExpr("photo", "640 AS width", "480 AS height", "det_seq AS face_seq", "x1 + 1 AS x1", "y1", "x2 + 1 AS x2", "y2", "embedding"), root)
    return rounded(ev.golden_match(rows, io.read_golden(v.spark, root)), "iou", "cos")
