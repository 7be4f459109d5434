"""Bounds on leading directions skip work at low thresholds and lose no pair."""

import numpy as np
import pytest

from kinframe.operators import pairs


def vectors(spark, kind, n=1200, d=32):
    rng = np.random.default_rng(6)
    if kind == "subspaces":  # groups in few directions, with a little noise around them
        centres = np.linalg.qr(rng.normal(size=(d, d)))[0][:8]
        x = centres[rng.integers(0, 8, n)] * rng.choice([-1, 1], n)[:, None] + rng.normal(size=(n, d)) * 0.02
    else:
        x = rng.normal(size=(n, d))
    x[5], x[6] = 0, x[7]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("kind", ["subspaces", "noise"])
def test_pairs_are_whole_and_meetings_are_counted(spark, kind):
    x, df = vectors(spark, kind)
    u = pairs.unit_rows(x)
    s = u @ u.T
    i, j = np.nonzero(np.triu(s >= 0.45, 1))
    got = {(r.id_a, r.id_b) for r in pairs.rep_pairs(df, 0.45, block_rows=60).collect()}
    assert got == set(zip(i.tolist(), j.tolist())) and got
    report = pairs.pruning_report(df, 0.45, block_rows=60).first()
    assert report.kept <= report.by_angle <= report.meetings
    assert 0 < report.block_pairs_kept <= report.block_pairs
    if kind == "subspaces":
        assert report.kept < report.by_angle < report.meetings and report.block_pairs_kept < report.block_pairs


def test_bounds_hold_between_two_sides(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SMALL_SIDE", 10)
    x, df = vectors(spark, "subspaces", 500)
    u = pairs.unit_rows(x)
    i, j = np.nonzero((u[:200] @ u[200:].T) >= 0.6)
    got = {(r.id_a, r.id_b) for r in pairs.cross_pairs(df.where("id < 200"), df.where("id >= 200"), 0.6, block_rows=40).collect()}
    assert got == {(a, b + 200) for a, b in zip(i.tolist(), j.tolist())} and got


def test_report_of_nothing(spark):
    _, df = vectors(spark, "noise", 10)
    assert pairs.pruning_report(df.limit(0), 0.45).first().meetings == 0
