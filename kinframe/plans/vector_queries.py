"""Vector, search and clustering queries over the fixture views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinframe.functions.vectors import centroids, cosine, dot, l2_normalize
from kinframe.operators import cluster, pairs, persons, search, vector_index
from kinframe.plans.registry import REGISTRY, ctes, query
from kinframe.session import checkpoint_root

COS = "list_cosine_similarity"


def rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query("v01_vector_functions", ctes("faces") + f"""
SELECT f.face_id, round({COS}(f.embedding, m.embedding), 6) + 0.0 AS cos_to_main, round(list_dot_product(f.embedding, m.embedding), 6) + 0.0 AS dot_to_main,
       round(f.embedding[1] / sqrt(list_dot_product(f.embedding, f.embedding)), 6) + 0.0 AS unit_first
FROM faces f JOIN (SELECT true_label, arg_min(embedding, face_id) AS embedding FROM faces WHERE embedding IS NOT NULL GROUP BY true_label) m
  ON m.true_label = f.true_label WHERE f.embedding IS NOT NULL""")
def v01(v):
    f = v.faces.where(F.col("embedding").isNotNull())
    main = f.groupBy("true_label").agg(F.min_by("embedding", "face_id").alias("main"))
    return f.join(main, "true_label").select(
        "face_id",
        F.round(cosine("embedding", "main"), 6).alias("cos_to_main"),
        F.round(dot("embedding", "main"), 6).alias("dot_to_main"),
        F.round(F.get(l2_normalize("embedding"), F.lit(0)), 6).alias("unit_first"),
    )


CENTROID_SQL = """
parts AS (SELECT person_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS val FROM faces
          WHERE embedding IS NOT NULL AND person_id IS NOT NULL),
means AS (SELECT person_id, pos, avg(val) AS m, count(*) AS n FROM parts GROUP BY ALL),
cents AS (SELECT person_id, list(m ORDER BY pos) AS c, max(n) AS n FROM means GROUP BY person_id)
"""


@query("v02_centroids", ctes("faces") + "," + CENTROID_SQL + """
SELECT person_id, CAST(pos - 1 AS INT) AS pos, round(m, 6) + 0.0 AS val,
       round(m / sqrt(sum(m * m) OVER (PARTITION BY person_id)), 6) + 0.0 AS unit_val FROM means""")
def v02(v):
    owned = v.faces.where(F.col("person_id").isNotNull())
    means = centroids(owned, ["person_id"])
    both = means.select("person_id", F.arrays_zip("centroid", l2_normalize("centroid").alias("unit")).alias("z"))
    return both.select("person_id", F.posexplode("z").alias("pos", "z")).select(
        "person_id", "pos", F.round("z.centroid", 6).alias("val"), F.round("z.unit", 6).alias("unit_val")
    )


@query("v03_similarity_join", ctes("faces") + f"""
SELECT a.face_id AS id_a, b.face_id AS id_b, round({COS}(a.embedding, b.embedding), 6) + 0.0 AS sim
FROM faces a JOIN faces b ON a.face_id < b.face_id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL
WHERE {COS}(a.embedding, b.embedding) >= 0.30""")
def v03(v):
    return rounded(pairs.similar_pairs(v.faces, 0.30), "sim")


def recursive(ctes_sql: str) -> str:
    return ctes_sql.replace("WITH ", "WITH RECURSIVE ", 1)


def root_linkage_sql(rows: str, threshold: float, low_join: float = 0.6, tag: str = "") -> str:
    """Best pair of live roots first, the larger one kept: the state holds size, first member and parent.

    Root similarities never change, so pairs are met in falling order and a pair whose root
    is gone never counts again. ``tag`` ends the names of the parts.
    """
    return f"""
n{tag} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY face_order) AS k FROM ({rows})),
x{tag} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY s DESC, a, b) AS rn FROM (
  SELECT a.k AS a, b.k AS b, a.low AS la, b.low AS lb, CAST(CAST({COS}(a.e, b.e) AS FLOAT) AS DOUBLE) AS s FROM n{tag} a JOIN n{tag} b ON a.k < b.k)
  WHERE s > {threshold} AND NOT (la AND lb) AND (s >= {low_join} OR NOT (la OR lb))),
m{tag} AS (SELECT 0::BIGINT AS rn, (SELECT list(1::BIGINT ORDER BY k) FROM n{tag} n) AS size, (SELECT list(k ORDER BY k) FROM n{tag} n) AS first, (SELECT list(k ORDER BY k) FROM n{tag} n) AS up
      UNION ALL
      SELECT rn, list_transform(size, lambda v, i: CASE WHEN i = gone THEN 0 WHEN i = keep THEN v + size[gone] ELSE v END),
             list_transform(first, lambda v, i: CASE WHEN i = keep THEN least(v, first[gone]) ELSE v END),
             list_transform(up, lambda v, i: CASE WHEN i = gone THEN keep ELSE v END)
      FROM (SELECT *, CASE WHEN size[p] >= size[q] THEN p ELSE q END AS keep, CASE WHEN size[p] >= size[q] THEN q ELSE p END AS gone
            FROM (SELECT x.rn, m.size, m.first, m.up, CASE WHEN m.first[x.a] < m.first[x.b] THEN x.a ELSE x.b END AS p, CASE WHEN m.first[x.a] < m.first[x.b] THEN x.b ELSE x.a END AS q
                  FROM m{tag} m JOIN x{tag} x ON x.rn > m.rn AND m.size[x.a] > 0 AND m.size[x.b] > 0 ORDER BY x.rn LIMIT 1))),
u{tag} AS (SELECT unnest(up) AS up, unnest(range(1, len(up) + 1)) AS k FROM (SELECT up FROM m{tag} m ORDER BY rn DESC LIMIT 1)),
w{tag} AS (SELECT k, k AS root FROM u{tag} u UNION ALL SELECT w.k, u.up FROM w{tag} w JOIN u{tag} u ON u.k = w.root AND u.up <> w.root),
z{tag} AS (SELECT w.k, w.root FROM w{tag} w JOIN u{tag} u ON u.k = w.root AND u.up = u.k),
linked{tag} AS (SELECT f.*, r.face_order AS root, min(f.face_order) OVER (PARTITION BY z.root) AS cluster FROM z{tag} z JOIN n{tag} f ON f.k = z.k JOIN n{tag} r ON r.k = z.root)"""


LOW = "face_quality IN ('low', 'very_low') AS low"


@query("v04_cluster_faces", recursive(ctes("faces")) + "," + root_linkage_sql(f"SELECT face_order, embedding AS e, {LOW} FROM faces WHERE embedding IS NOT NULL", 0.30) + """
SELECT face_order, root, cluster FROM linked""")
def v04(v):
    return cluster.cluster_faces(v.faces.select("face_order", "embedding", "face_quality"), 0.30)


@query("v05_cluster_greedy", recursive(ctes("faces")) + f""",
n AS MATERIALIZED (SELECT face_order, row_number() OVER (ORDER BY face_order) AS k, CAST(embedding AS DOUBLE[]) AS e, face_quality AS tier FROM faces WHERE embedding IS NOT NULL),
x AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY s DESC, a, b) AS rn FROM (
  SELECT a.k AS a, b.k AS b, {COS}(a.e, b.e) AS s, (a.tier = 'low')::INT + (b.tier = 'low')::INT AS lows FROM n a JOIN n b ON a.k < b.k WHERE a.tier <> 'very_low' AND b.tier <> 'very_low')
  WHERE s >= [0.30, 0.35, 0.40][lows + 1]),
m AS (SELECT 0::BIGINT AS rn, (SELECT list(k ORDER BY k) FROM n) AS cl, (SELECT list(1::BIGINT ORDER BY k) FROM n) AS size, (SELECT list(CAST(e AS FLOAT[]) ORDER BY k) FROM n) AS cent
      UNION ALL
      SELECT rn, list_transform(cl, lambda v: CASE WHEN v = q THEN p ELSE v END),
             list_transform(size, lambda v, i: CASE WHEN i = p THEN v + size[q] ELSE v END),
             list_transform(cent, lambda v, i: CASE WHEN i = p THEN CAST(list_transform(list_zip(v, cent[q]), lambda z: (CAST(z[1] AS DOUBLE) * size[p] + CAST(z[2] AS DOUBLE) * size[q]) / (size[p] + size[q])) AS FLOAT[]) ELSE v END)
      FROM (SELECT x.rn, m.cl, m.size, m.cent, m.cl[x.a] AS p, m.cl[x.b] AS q FROM m JOIN x ON x.rn > m.rn AND m.cl[x.a] <> m.cl[x.b]
            WHERE {COS}(CAST(m.cent[m.cl[x.a]] AS DOUBLE[]), CAST(m.cent[m.cl[x.b]] AS DOUBLE[])) >= 0.30 ORDER BY x.rn LIMIT 1)),
u AS (SELECT unnest(cl) AS c, unnest(range(1, len(cl) + 1)) AS k FROM (SELECT cl FROM m ORDER BY rn DESC LIMIT 1))
SELECT n.face_order, min(n.face_order) OVER (PARTITION BY u.c) AS cluster FROM u JOIN n ON n.k = u.k""")
def v05(v):
    return cluster.cluster_greedy(v.faces, 0.30, low_join=0.35, low_low=0.40)


def running_average_sql(label: str, thresholds: str) -> str:
    """One pass per label and threshold in face order, carrying the list of centroids."""
    return f"""
o AS (SELECT {label} AS label, face_order, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY {label} ORDER BY face_order) AS rn
      FROM faces WHERE embedding IS NOT NULL AND {label} IS NOT NULL),
t AS (SELECT unnest({thresholds}::DOUBLE[]) AS threshold),
r AS (SELECT threshold, label, rn, face_order, 1::BIGINT AS cluster, [CAST(e AS FLOAT[])] AS cents FROM o, t WHERE rn = 1
      UNION ALL
      SELECT threshold, label, rn, face_order, CASE WHEN best > threshold THEN pick ELSE len(cents) + 1 END::BIGINT,
             CASE WHEN best > threshold
                  THEN list_transform(cents, lambda c, i: CASE WHEN i = pick THEN CAST(list_transform(list_zip(c, e), lambda z: (CAST(z[1] AS DOUBLE) + z[2]) / 2) AS FLOAT[]) ELSE c END)
                  ELSE list_append(cents, CAST(e AS FLOAT[])) END
      FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS pick
            FROM (SELECT r.threshold, o.label, o.rn, o.face_order, o.e, r.cents,
                         list_transform(r.cents, lambda c: list_cosine_similarity(CAST(c AS DOUBLE[]), o.e)) AS sims
                  FROM r JOIN o ON o.label = r.label AND o.rn = r.rn + 1)))"""


@query("v06_cluster_running_average", recursive(ctes("faces")) + "," + running_average_sql("true_label", "[0.10]") + """
SELECT label AS true_label, face_order, cluster FROM r""")
def v06(v):
    return cluster.cluster_running_average(v.faces, 0.10, "true_label")


@query("v07_connected_components", ctes("faces") + f""",
p AS (SELECT a.face_id AS a, b.face_id AS b FROM faces a JOIN faces b ON a.face_id < b.face_id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL
      WHERE {COS}(a.embedding, b.embedding) >= 0.40),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (WITH RECURSIVE w(id, reach) AS (SELECT DISTINCT a, a FROM e UNION SELECT w.id, e.b FROM w JOIN e ON w.reach = e.a) SELECT * FROM w)
SELECT id, min(reach) AS component FROM r GROUP BY id""")
def v07(v):
    return cluster.connected_components(pairs.similar_pairs(v.faces, 0.40))


@query("v08_recluster_catalog", recursive(ctes("photos", "faces", "persons", "person_manual")) + "," + root_linkage_sql(f"""
  SELECT f.face_order, f.face_id, f.person_id, embedding AS e, {LOW} FROM faces f JOIN photos p ON p.photo_id = f.photo_id
  WHERE p.deleted_at IS NULL AND embedding IS NOT NULL AND (f.person_id IS NULL OR f.person_id NOT IN (SELECT person_id FROM person_manual))""", 0.30) + """,
c AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS number, arg_min(name, face_order) AS custom
      FROM linked l LEFT JOIN (SELECT person_id AS pid, name FROM persons WHERE lower(name) NOT LIKE 'person %') pe ON pe.pid = l.person_id GROUP BY cluster),
made AS (SELECT l.face_id, (SELECT max(person_id) FROM persons) + c.number AS person_id, coalesce(c.custom, concat('Person ', c.number)) AS name FROM linked l JOIN c ON c.cluster = l.cluster)
SELECT f.face_id, CASE WHEN mm.face_id IS NOT NULL THEN mm.person_id WHEN f.person_id IN (SELECT person_id FROM person_manual) THEN f.person_id END AS person_id,
       CASE WHEN mm.face_id IS NOT NULL THEN mm.name WHEN f.person_id IN (SELECT person_id FROM person_manual) THEN pe.name END AS name
FROM faces f LEFT JOIN made mm ON mm.face_id = f.face_id LEFT JOIN persons pe ON pe.person_id = f.person_id""")
def v08(v):
    faces, people = cluster.recluster_catalog(v.photos, v.faces, v.persons, v.person_manual, 0.30)
    return faces.join(people.select("person_id", "name"), "person_id", "left").select("face_id", "person_id", "name")


@query("v09_merge_duplicate_persons", recursive(ctes("faces")) + f""",
v AS (SELECT person_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS val FROM faces WHERE person_id IS NOT NULL AND embedding IS NOT NULL),
means AS (SELECT person_id, list(val ORDER BY pos) AS vec FROM (SELECT person_id, pos, avg(val) AS val FROM v GROUP BY ALL) GROUP BY person_id),
sizes AS (SELECT person_id, count(*) AS n FROM faces WHERE person_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1),
r AS (SELECT 0 AS round, person_id, person_id AS rep, vec, n FROM means JOIN sizes USING (person_id)
      UNION ALL
      SELECT * FROM (
        WITH reps AS (SELECT DISTINCT round, rep, vec, n FROM r),
        ends AS (SELECT a.rep AS a, b.rep AS b, {COS}(a.vec, b.vec) AS s FROM reps a JOIN reps b ON a.rep <> b.rep),
        best AS (SELECT a, arg_min(b, (-s, b)) AS b FROM ends WHERE s >= 0.35 GROUP BY a),
        mutual AS (SELECT x.a, x.b FROM best x JOIN best y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b),
        pick AS (SELECT CASE WHEN p.n >= q.n THEN p.rep ELSE q.rep END AS keep, CASE WHEN p.n >= q.n THEN q.rep ELSE p.rep END AS gone
                 FROM mutual m JOIN reps p ON p.rep = m.a JOIN reps q ON q.rep = m.b),
        fresh AS (SELECT k.rep, CASE WHEN g.rep IS NULL THEN k.vec ELSE list_transform(list_zip(k.vec, g.vec), lambda z: (z[1] * k.n + z[2] * g.n) / (k.n + g.n)) END AS vec, k.n + coalesce(g.n, 0) AS n
                  FROM reps k LEFT JOIN pick ON pick.keep = k.rep LEFT JOIN reps g ON g.rep = pick.gone)
        SELECT r.round + 1, r.person_id, coalesce(pick.keep, r.rep), fresh.vec, fresh.n
        FROM r LEFT JOIN pick ON pick.gone = r.rep JOIN fresh ON fresh.rep = coalesce(pick.keep, r.rep) WHERE EXISTS (SELECT 1 FROM pick)))
SELECT person_id, rep AS merged_into FROM r WHERE round = (SELECT max(round) FROM r)""")
def v09(v):
    return cluster.merge_duplicate_persons(v.faces, 0.35)


HIT_SQL = f"""
live AS (SELECT f.*, p.path, p.thumb_path, p.width, p.height FROM faces f JOIN photos p ON p.photo_id = f.photo_id
         WHERE p.deleted_at IS NULL AND f.embedding IS NOT NULL),
q AS (SELECT photo_id AS query_photo, face_order AS query_order, embedding AS qe FROM faces WHERE embedding IS NOT NULL)
"""


def hits_sql(where: str, group: str, min_sim: float, k: int) -> str:
    return ctes("photos", "faces", "persons") + "," + HIT_SQL + f""",
pairs AS (SELECT {group} AS query_photo, q.query_order, l.*, round({COS}(q.qe, l.embedding), 9) AS s FROM q JOIN live l
          ON round({COS}(q.qe, l.embedding), 9) >= {min_sim} {where}),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_photo, photo_id ORDER BY s DESC, query_order, face_order) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY query_photo ORDER BY s DESC, photo_id) AS rank FROM best)
"""


HIT_COLS = """CAST(t.rank AS INT) AS rank, t.photo_id, t.path, t.thumb_path, t.face_id, t.person_id, pe.name AS person_name,
       round(t.s, 6) AS similarity, t.x1, t.y1, t.x2, t.y2, t.width, t.height"""


@query("v10_search_faces", hits_sql("AND q.query_photo IN (42, 90)", "0", 0.25, 10) + f"""
SELECT {HIT_COLS} FROM top t LEFT JOIN persons pe ON pe.person_id = t.person_id WHERE t.rank <= 10""")
def v10(v):
    queries = search.query_faces(v.faces, [42, 90])
    return rounded(search.search_faces(queries, v.faces, v.photos, v.persons, 10, 0.25), "similarity")


@query("v10_matched_persons", hits_sql("AND q.query_photo IN (42, 90)", "0", 0.25, 10) + """
SELECT DISTINCT p.photo_id, pe.name AS person_name FROM pairs p JOIN persons pe ON pe.person_id = p.person_id
WHERE p.photo_id IN (SELECT photo_id FROM top WHERE rank <= 10)""")
def v10m(v):
    queries = search.query_faces(v.faces, [42, 90])
    hits = search.search_faces(queries, v.faces, v.photos, v.persons, 10, 0.25)
    return search.matched_persons(hits, queries, v.faces, v.persons, 0.25)


@query("v11_search_by_photo", hits_sql("AND q.query_photo = 42", "0", 0.25, 10) + f"""
SELECT {HIT_COLS}, (SELECT count(*) FROM q WHERE query_photo = 42) AS query_faces
FROM top t LEFT JOIN persons pe ON pe.person_id = t.person_id WHERE t.rank <= 10""")
def v11(v):
    return rounded(search.search_by_photo(42, v.faces, v.photos, v.persons, 10, 0.25), "similarity")


@query("v12_search_batch", hits_sql("", "q.query_photo", 0.25, 5) + f"""
SELECT t.query_photo, {HIT_COLS} FROM top t LEFT JOIN persons pe ON pe.person_id = t.person_id WHERE t.rank <= 5""")
def v12(v):
    queries = search.query_faces(v.faces)
    return rounded(search.search_batch(queries, v.faces, v.photos, v.persons, 5, 0.25), "similarity")


def index(v):
    root = f"{checkpoint_root(v.spark)}/index-{uuid.uuid4().hex}"
    return vector_index.build_index(v.faces.select("face_order", "photo_id", "embedding"), root, cell_rows=100)


@query("v10_indexed_search", REGISTRY["v10_search_faces"].sql)
def v10i(v):
    """The cells of a stored index, best bound first, instead of all faces."""
    queries = search.query_faces(v.faces, [42, 90]).withColumn("query_photo", F.lit(0).cast("long"))
    hits = index(v).search_photos(queries, v.faces, v.photos, v.persons, 10, 0.25)
    return rounded(hits.drop("query_photo"), "similarity")


@query("v13_mean_sim_to_first", ctes("faces") + f""",
r AS (SELECT person_id, embedding, row_number() OVER (PARTITION BY person_id ORDER BY face_order) AS rn FROM faces
      WHERE embedding IS NOT NULL AND person_id IS NOT NULL)
SELECT a.person_id, count(*) AS compared, round(avg({COS}(a.embedding, f.embedding)), 6) + 0.0 AS mean_sim
FROM r a JOIN r f ON f.person_id = a.person_id AND f.rn = 1 WHERE a.rn BETWEEN 2 AND 50 GROUP BY a.person_id""")
def v13(v):
    return rounded(persons.mean_sim_to_first(v.faces, 50), "mean_sim")


@query("v14_closest_person_pairs", ctes("faces") + "," + CENTROID_SQL + f"""
SELECT a.person_id AS person_a, b.person_id AS person_b, round({COS}(a.c, b.c), 6) + 0.0 AS sim
FROM cents a JOIN cents b ON a.person_id < b.person_id ORDER BY {COS}(a.c, b.c) DESC, 1, 2 LIMIT 30""")
def v14(v):
    return rounded(persons.closest_person_pairs(v.faces, 30), "sim")


@query("v14_grey_zone", ctes("faces") + "," + CENTROID_SQL + f"""
SELECT a.person_id AS person_a, b.person_id AS person_b, a.n AS faces_a, b.n AS faces_b, round({COS}(a.c, b.c), 6) + 0.0 AS sim
FROM cents a JOIN cents b ON a.person_id < b.person_id WHERE {COS}(a.c, b.c) BETWEEN 0.25 AND 0.45""")
def v14g(v):
    return rounded(persons.grey_zone(v.faces, 0.25, 0.45), "sim")


@query("v15_person_pair_detail", ctes("faces") + f""",
s AS (SELECT {COS}(a.embedding, b.embedding) AS s, a.face_id AS fa, b.face_id AS fb FROM faces a JOIN faces b
      ON a.person_id = 2 AND b.person_id = 5 AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
r AS (SELECT CAST(CAST(s AS FLOAT) AS DOUBLE) AS s, row_number() OVER (ORDER BY CAST(s AS FLOAT) DESC) AS rn, count(*) OVER () AS n FROM s)
SELECT CAST(2 AS INT) AS person_a, CAST(5 AS INT) AS person_b, (SELECT count(DISTINCT fa) FROM s) AS faces_a, (SELECT count(DISTINCT fb) FROM s) AS faces_b,
       (SELECT count(*) FROM s) AS pairs, (SELECT round(max(s), 6) FROM r) AS max_sim,
       (SELECT round(s, 6) FROM r WHERE rn = 1 + CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) AS p90_sim, (SELECT round(min(s), 6) FROM r) AS min_sim,
       (SELECT round(avg(s), 6) FROM s) AS mean_sim,
       (SELECT count(*) FROM s WHERE s >= 0.5) AS at_050, (SELECT count(*) FROM s WHERE s >= 0.45) AS at_045""")
def v15(v):
    return rounded(persons.person_pair_detail(v.faces, 2, 5), "max_sim", "p90_sim", "min_sim", "mean_sim")


@query("v16_co_occurrence", ctes("photos", "faces") + """
SELECT photo_id, path FROM photos WHERE photo_id IN (SELECT photo_id FROM faces WHERE person_id = 2 INTERSECT SELECT photo_id FROM faces WHERE person_id = 5)""")
def v16(v):
    return persons.co_occurrence(v.faces, v.photos, 2, 5)


@query("v17_cluster_vs_main", ctes("faces") + f""",
o AS (SELECT true_label AS identity, person_id, face_id, embedding FROM faces WHERE embedding IS NOT NULL AND person_id IS NOT NULL),
cnt AS (SELECT identity, person_id, count(*) AS n FROM o GROUP BY ALL),
main AS (SELECT identity, person_id AS main_person FROM cnt QUALIFY row_number() OVER (PARTITION BY identity ORDER BY n DESC, person_id) = 1),
parts AS (SELECT o.identity, m.main_person, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS val FROM o JOIN main m ON m.identity = o.identity AND m.main_person = o.person_id),
cent AS (SELECT identity, main_person, list(mv ORDER BY pos) AS c FROM (SELECT identity, main_person, pos, avg(val) AS mv FROM parts GROUP BY ALL) GROUP BY ALL)
SELECT o.identity, o.person_id, c.main_person, count(*) AS faces, round(avg({COS}(o.embedding, c.c)), 6) + 0.0 AS mean_sim
FROM o JOIN cent c ON c.identity = o.identity WHERE o.person_id <> c.main_person GROUP BY ALL""")
def v17(v):
    return rounded(persons.cluster_vs_main(v.faces), "mean_sim")


@query("v18_useful_faces", ctes("faces") + f""",
e AS (SELECT face_id, embedding, x2 - x1 AS side FROM faces WHERE embedding IS NOT NULL),
u AS (SELECT DISTINCT a.face_id FROM e a JOIN e b ON a.face_id <> b.face_id AND {COS}(a.embedding, b.embedding) >= 0.35)
SELECT CASE WHEN side >= 101 THEN '>100' WHEN side >= 65 THEN '64-100' WHEN side >= 33 THEN '32-64' WHEN side >= 21 THEN '20-32' WHEN side >= 1 THEN '<20' ELSE '?' END AS bucket,
       count(*) AS embedded, count(u.face_id) AS has_match, count(*) - count(u.face_id) AS no_match
FROM e LEFT JOIN u ON u.face_id = e.face_id GROUP BY 1""")
def v18(v):
    return persons.useful_faces(v.faces, 0.35)


@query("v20_embedding_drift", ctes("faces") + f"""
SELECT count(*) AS faces, round(avg(s), 6) + 0.0 AS mean_sim, round(min(s), 6) + 0.0 AS min_sim
FROM (SELECT {COS}(embedding, list_transform(embedding, lambda x: round(x, 1))) AS s FROM faces WHERE embedding IS NOT NULL)""")
def v20(v):
    coarse = v.faces.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 1)))
    drift = persons.embedding_drift(v.faces, coarse, ["photo_id", "face_id"])
    return rounded(persons.drift_summary(drift), "mean_sim", "min_sim")


@query("e24_intra_inter_means", ctes("faces") + f""",
s AS (SELECT a.true_label AS la, b.true_label AS lb, {COS}(a.embedding, b.embedding) AS s FROM faces a JOIN faces b
      ON a.face_id < b.face_id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL)
SELECT 'intra' AS kind, CAST(la AS VARCHAR) AS label, count(*) AS pairs, round(avg(s), 6) + 0.0 AS mean_sim FROM s WHERE la = lb GROUP BY la
UNION ALL SELECT 'inter', 'all', count(*), round(avg(s), 6) + 0.0 FROM s WHERE la <> lb""")
def e24(v):
    return rounded(persons.intra_inter_means(v.faces), "mean_sim")
