"""Root linkage along bands of edges compares the roots only a few times."""

import numpy as np

from kinframe.operators import cluster


def test_few_comparisons_and_the_same_roots(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(150, 6))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = (units @ units.T).astype(np.float32).astype(float)
    edges = [(sims[i, j], i, j) for i in range(150) for j in range(i + 1, 150) if sims[i, j] > 0.3]
    rows = [(i, v.tolist(), False, 1, i) for i, v in enumerate(vectors)]
    nodes = spark.createDataFrame(rows, "id long, vec array<double>, low boolean, size long, first long")
    calls, block_pairs = [], cluster.block_pairs
    monkeypatch.setattr(cluster, "block_pairs", lambda *a, **k: calls.append(1) or block_pairs(*a, **k))
    monkeypatch.setattr(cluster, "BAND_EDGES", len(edges) // 4, raising=False)
    steps = []
    found = cluster.solve_rounds(nodes, 0.3, 0.6, None, steps)
    assert {r["id"]: r["root"] for r in found.collect()} == cluster.merge_by_root({i: 1 for i in range(150)}, edges)
    want = cluster.merge_steps({i: 1 for i in range(150)}, edges)
    assert {r["id"]: (r["parent"], r["sim"]) for s in steps for r in s.collect()} == want
    assert len(calls) <= 8
