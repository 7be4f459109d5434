"""Exact quantiles of similarities: Spark looks the ranks up, the driver sees only what is asked."""

import numpy as np

from kinframe.operators import pairs


def test_ranks_are_found_without_collecting_counts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors, label, photo = rng.normal(size=(200, 4)), rng.integers(0, 3, 200), rng.integers(0, 9, 200)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    i, j = np.triu_indices(200, 1)
    sims, same, cross = (units @ units.T)[i, j].astype(np.float32), label[i] == label[j], photo[i] != photo[j]
    rows = [(k, v.tolist(), 1, int(a), int(b)) for k, (v, a, b) in enumerate(zip(vectors, label, photo))]
    reps = spark.createDataFrame(rows, "id long, vec array<double>, n long, label long, photo long")
    seen, collect = [], type(reps).collect
    monkeypatch.setattr(type(reps), "collect", lambda df: seen.append(collect(df)) or seen[-1])
    stratify = lambda a, b: (a["label"] != b["label"]).astype(int)
    got = pairs.similarity_quantiles(reps, ["label"], stratify, 2, [0.0, 0.3, 0.5, 1.0], block_rows=70, apart="photo")
    assert max(len(r) for r in seen) <= 8
    for code, kind in ((0, same), (1, ~same)):
        values = np.sort(sims[kind & cross])
        assert got[code][0] == len(values)
        assert got[code][1] == {p: float(values[min(len(values) - 1, int(p * len(values)))]) for p in (0.0, 0.3, 0.5, 1.0)}
