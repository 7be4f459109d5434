"""The greedy pass in bands decides as one pass over all edges, and lists few of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.operators import cluster


def plain(vectors, tiers, needs, threshold):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims, low = units @ units.T, [t == "low" for t in tiers]
    near = [(i, j) for i in range(len(vectors)) for j in range(i + 1, len(vectors)) if "very_low" not in (tiers[i], tiers[j])]
    edges = [(round(float(sims[i, j]), 13), i, j) for i, j in near if sims[i, j] >= needs[low[i] + low[j]] - 1e-13]
    return cluster.merge_by_centroid(dict(enumerate(vectors)), edges, threshold), len(edges)


@pytest.mark.parametrize("local", [60, 10_000])
def test_bands_decide_like_one_pass(spark, monkeypatch, local):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 6))
    vectors[250:270] = vectors[:20] + 0.01 * rng.normal(size=(20, 6))
    vectors[270:290] = vectors[20]
    tiers = [("high", "low", "medium", "high", "very_low", "medium")[i % 6] for i in range(300)]
    want, edges = plain(vectors, tiers, [0.4, 0.45, 0.5], 0.4)
    monkeypatch.setattr(cluster, "GREEDY_EDGES", edges // 4, raising=False)
    monkeypatch.setattr(cluster, "LOCAL_CLUSTERS", local, raising=False)
    monkeypatch.setattr(cluster, "SLICE_EDGES", edges // 3)
    monkeypatch.setattr(cluster, "NEAR_MARGIN", 0.02, raising=False)
    # Where the list of all edges would have been made.
    monkeypatch.setattr(cluster, "similar_pairs", None)
    asked, foresee = [], getattr(cluster, "_foresee", None)
    monkeypatch.setattr(cluster, "_foresee", lambda *a: asked.append(foresee(*a)) or asked[-1], raising=False)
    faces = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(vectors, tiers))] + [(300, [0.0] * 6, "high"), (301, None, "low")], "face_order long, embedding array<double>, face_quality string")
    found = cluster.cluster_greedy(faces, 0.4, low_join=0.45, low_low=0.5)
    got = {r["face_order"]: r["cluster"] for r in found.collect()}
    assert got == {**want, 300: 300}
    assert any(a[3].any() for a in asked) or local == 60
    assert found.agg(F.count(F.lit(1))).first()[0] == 301
