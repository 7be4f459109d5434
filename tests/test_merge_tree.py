"""One forest of merges gives the clusterings of all thresholds."""

import random

import pytest

from kinframe.operators import cluster
from kinframe.operators.evaluate import config_sweep, pair_metrics, purity
from kinframe.operators.merge_tree import MergeForest

SCHEMA = "face_order long, embedding array<float>, face_quality string, label long"


def crowd(spark, seed, n=45):
    """Few distinct directions, so similarities tie; copies, low tiers, empty vectors."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [float(rng.randrange(-1, 3)) for _ in range(4)] if i % 5 else rows[rng.randrange(len(rows))][1] if rows else [1.0, 0.0, 0.0, 0.0]
        rows.append((i * 3 + 1, v, rng.choice(["high", "medium", "low", "very_low"]), rng.choice([1, 2, 3, None])))
    rows += [(900, None, "high", 1), (901, [0.0] * 4, "low", 1), (902, [0.0] * 4, "high", 2)]
    return spark.createDataFrame(rows, SCHEMA)


THRESHOLDS = [0.3, 0.6, 0.70710677]


@pytest.mark.parametrize("limits", [{}, {"local_edges": 5}, {"edges_per_face": 0}])
@pytest.mark.parametrize("gated", [True, False])
def test_cuts_equal_separate_runs(spark, limits, gated):
    faces = crowd(spark, 4)
    got = {}
    for r in MergeForest(faces, 0.3, **limits).cuts(THRESHOLDS, gated, 0.65).collect():
        got.setdefault(r.threshold, set()).add((r.face_order, r.root, r.cluster))
    rows = faces if gated else faces.selectExpr("face_order", "embedding", "'high' AS face_quality")
    for t in THRESHOLDS:
        want = {(r.face_order, r.root, r.cluster) for r in cluster.cluster_faces(rows, t, 0.65).collect()}
        assert got[t] == want, t
    assert len({frozenset(x[2] for x in v) for v in got.values()}) >= 2


def test_sweep_reports_every_config(spark):
    faces = crowd(spark, 9)
    configs = [{"name": "a", "threshold": 0.6}, {"name": "b", "threshold": 0.6, "gated": False}, {"name": "c", "threshold": 0.45, "low_join": 0.5}, {"name": "d", "threshold": 0.6, "low_join": 0.5}]
    rows = {r.config: r for r in config_sweep(faces, configs).collect()}
    assert set(rows) == set("abcd")
    for c in configs:
        base = faces if c.get("gated", True) else faces.selectExpr("face_order", "embedding", "'high' AS face_quality", "label")
        assign = cluster.cluster_faces(base, c["threshold"], c.get("low_join", 0.6)).join(faces.select("face_order", "label"), "face_order")
        want = pair_metrics(assign).first()
        got = rows[c["name"]]
        assert [got[k] for k in ("tp", "fp", "fn", "tn")] == [want[k] for k in ("tp", "fp", "fn", "tn")]
        assert got.purity == purity(assign).first().purity and got.clusters == assign.select("cluster").distinct().count()
    none = config_sweep(faces.limit(0), configs).collect()
    assert [(r.clusters, r.tp) for r in none] == [(0, 0)] * 4


def test_cuts_below_the_compared_threshold_fail(spark):
    with pytest.raises(ValueError):
        MergeForest(crowd(spark, 1, 10), 0.5).cuts([0.4])
