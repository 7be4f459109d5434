"""A sweep does not compare all faces only to learn whether a pair list would fit."""

import numpy as np

from kinframe.operators import cluster, merge_tree, pairs


def test_the_choice_of_rounds_needs_no_comparison_of_all_faces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    faces = spark.createDataFrame([(i, v.tolist(), "high") for i, v in enumerate(rng.normal(size=(80, 5)))], "face_order long, embedding array<double>, face_quality string")
    calls, compare = [], pairs.block_pairs

    def counted(left, right, *args, **kwargs):
        calls.append(right is None)
        return compare(left, right, *args, **kwargs)

    for module in (pairs, cluster):
        monkeypatch.setattr(module, "block_pairs", counted)
    assert not merge_tree.MergeForest(faces, 0.3, edges_per_face=0).sparse
    assert calls == [False]
    assert merge_tree.MergeForest(faces, 0.3, edges_per_face=10**6).sparse
