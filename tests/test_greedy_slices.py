"""The greedy pass over slices of sorted edges decides as one pass over all of them."""

import numpy as np

from kinframe.operators import cluster


def test_slices_decide_like_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(120, 5))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = units @ units.T
    edges = [(float(sims[i, j]), i, j) for i in range(120) for j in range(i + 1, 120) if sims[i, j] >= 0.5]
    want = cluster.merge_by_centroid(dict(enumerate(vectors)), edges, 0.5)
    monkeypatch.setattr(cluster, "SLICE_EDGES", len(edges) // 3, raising=False)
    monkeypatch.setattr(cluster, "SLICE_BLOCK", 16, raising=False)
    faces = spark.createDataFrame([(i, v.tolist(), "high") for i, v in enumerate(vectors)], "face_order long, embedding array<double>, face_quality string")
    steps, materialize = [], cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda df: steps.append(1) or materialize(df))
    found = cluster.cluster_greedy(faces, 0.5, local_edges=1)
    assert {r["face_order"]: r["cluster"] for r in found.collect()} == want
    assert len(steps) <= 25
