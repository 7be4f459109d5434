"""Root linkage lists its best edges with one comparison of all roots, cut where a forecast says."""

import numpy as np

from kinframe.operators import cluster


def table(spark, n=300, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim)).round(3)
    return spark.createDataFrame([(i, v.tolist(), bool(i % 9 == 0), 1, i) for i, v in enumerate(vectors)], "id long, vec array<double>, low boolean, size long, first long")


def plain_edges(nodes, threshold, low_join):
    rows = nodes.collect()
    units = np.array([r.vec for r in rows])
    units /= np.sqrt((units * units).sum(1, keepdims=True))
    s = (units @ units.T).astype(np.float32).astype(float)
    return {(a.id, b.id): s[i, j] for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and s[i, j] > threshold and not (a.low and b.low) and (s[i, j] >= low_join or not (a.low or b.low))}


def test_best_edges_are_complete_over_their_cut(spark, monkeypatch):
    nodes = table(spark).cache()
    want = plain_edges(nodes, 0.3, 0.6)
    for sample in (2048, 25):
        monkeypatch.setattr(cluster, "SAMPLE_NODES", sample)
        for most in (100, 2000, 10**6):
            edges, cut = cluster._best_edges(nodes, 0.3, 0.6, 32, most)
            got = {(r.id_a, r.id_b): r.sim for r in edges.collect()}
            assert 0 < len(got) <= most and got.keys() == {k for k, s in want.items() if s > cut}
            assert all(abs(s - want[k]) < 1e-6 for k, s in got.items())


def test_a_wrong_forecast_changes_nothing(spark, monkeypatch):
    nodes = table(spark).cache()
    right = {r.id: r.root for r in cluster.solve_rounds(nodes, 0.3, 0.6, 32, band_edges=10**6).collect()}
    for factor in (0.0, 1e-3, 1e3, 1e9):
        monkeypatch.setattr(cluster, "foreseen", lambda *a, f=factor: real(*a) * f)
        assert {r.id: r.root for r in cluster.solve_rounds(nodes, 0.3, 0.6, 32, band_edges=500).collect()} == right


real = cluster.foreseen


def test_a_round_compares_all_roots_once(spark, monkeypatch):
    nodes, calls = table(spark).cache(), []
    compare = cluster.block_pairs

    def counted(left, right, *args, **kwargs):
        calls.append(right is None)
        return compare(left, right, *args, **kwargs)

    monkeypatch.setattr(cluster, "block_pairs", counted)
    cluster._best_edges(nodes, 0.3, 0.6, 32, 500)
    assert calls.count(True) == 1
