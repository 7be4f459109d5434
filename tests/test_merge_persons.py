"""Merging of duplicate persons: rounds over all centroids, over a few, and the bounded rest."""

import numpy as np
import pytest

from kinframe.operators import cluster


def library(spark, vectors, persons, text=False):
    kind = "string" if text else "long"
    key = (lambda p: f"id{p:04d}") if text else int
    rows = [(key(p), [float(x) for x in v]) for p, v in zip(persons, vectors)]
    return spark.createDataFrame(rows, f"person_id {kind}, embedding array<float>"), key


def plain(vectors, persons, threshold):
    """The rounds as plain loops: person to the person it ends in, and how many rounds merged something."""
    vec = {p: np.mean([v for v, q in zip(vectors, persons) if q == p], axis=0) for p in set(persons)}
    size = {p: list(persons).count(p) for p in vec}
    into, rounds = {p: p for p in vec}, 0
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b))) if a.any() and b.any() else 0.0
    while True:
        best = {}
        for p in vec:
            found = [(-s, q) for q in vec if q != p for s in [cos(vec[p], vec[q])] if s >= threshold]
            if found:
                best[p] = min(found)[1]
        mutual = [(p, q) for p, q in best.items() if p < q and best.get(q) == p]
        if not mutual:
            return into, rounds
        rounds += 1
        for p, q in mutual:
            keep, gone = (p, q) if size[p] >= size[q] else (q, p)
            vec[keep] = (vec[keep] * size[keep] + vec[gone] * size[gone]) / (size[keep] + size[gone])
            size[keep] += size[gone]
            into = {k: keep if v == gone else v for k, v in into.items()}
            del vec[gone], size[gone]


@pytest.mark.parametrize("text", [False, True])
def test_all_ways_give_the_plain_rounds(spark, monkeypatch, text):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(150, 16)).astype(np.float32)
    # Three persons share a vector, and one has no direction.
    vectors[[40, 41, 97]] = vectors[3]
    vectors[60] = 0
    persons = np.r_[np.arange(100), rng.integers(0, 12, 50)].tolist()
    want, rounds = plain(vectors.astype(float), persons, 0.4)
    assert rounds >= 5 and len(set(want.values())) < 50
    df, key = library(spark, vectors, persons, text)
    want = {key(p): key(q) for p, q in want.items()}
    for local_rows, few in ((0, 2048), (50, 1)) if text else ((4096, 2048), (50, 2048), (0, 2048), (50, 1)):
        monkeypatch.setattr(cluster, "SMALL_SIDE", few)
        got = cluster.merge_duplicate_persons(df, 0.4, block_rows=32, local_rows=local_rows).collect()
        assert len(got) == len(want) and {r.person_id: r.merged_into for r in got} == want


def test_many_rounds_take_few_jobs(spark):
    vector = np.random.default_rng(2).normal(size=16)
    df, _ = library(spark, [vector] * 25, range(25))
    spark.sparkContext.setJobGroup("merge", "merge")
    try:
        got = {r.person_id: r.merged_into for r in cluster.merge_duplicate_persons(df, 0.9).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("merge"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(25), 0)
    # Of equal persons two merge in a round, so there are 24 rounds.
    assert jobs < 60


def test_nobody_to_merge(spark):
    df, _ = library(spark, np.eye(5), range(5))
    for faces in (df, df.where("person_id < 0")):
        got = {r.person_id: r.merged_into for r in cluster.merge_duplicate_persons(faces, 0.5).collect()}
        assert got == {r.person_id: r.person_id for r in faces.collect()}


def test_side_against_itself_leaves_rows_alone(spark):
    """A few rows against all: no row is its own mate, both ends of a pair are told."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "id long, vec array<double>")
    found = cluster._closest(df.where("id = 1"), df, 0.9, None).collect()
    assert {(r.id, r.mate) for r in found} == {(1, 2), (2, 1)}
