"""Block pairs of sides that differ much in size."""

import numpy as np

from kinframe.operators import pairs


def test_many_rows_meet_an_empty_side(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(pairs.SMALL_SIDE + 2)]
    many = spark.createDataFrame(rows, "id long, vec array<double>")
    assert pairs.cross_pairs(many, many.limit(0), 0.5, block_rows=500).count() == 0
    assert pairs.cross_pairs(many.limit(0), many, 0.5, block_rows=500).count() == 0
