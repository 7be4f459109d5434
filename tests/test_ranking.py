"""Ranks stay exact when one group holds most rows and lead values repeat."""

import random

from pyspark.sql import functions as F

from kinframe.operators.ranking import first_per_group, rank_in_group


def data(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 9)}", rnd.choice([1, 1, 1, 2, 7, 9]), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, t int, id long").repartition(7)


def test_rank_in_group(spark):
    rows, df = data(spark)
    for keys, descending in ((["g"], False), (["g"], True), ([], False)):
        got = {r["id"]: r["rn"] for r in rank_in_group(df, keys, ["t", "id"], descending=descending).collect()}
        want, groups = {}, {}
        for g, t, i in rows:
            groups.setdefault(g if keys else None, []).append((t, i))
        for members in groups.values():
            for n, (_, i) in enumerate(sorted(members, reverse=descending), 1):
                want[i] = n
        assert got == want


def test_first_per_group(spark):
    rows, df = data(spark)
    got = {r["g"]: r["id"] for r in first_per_group(df, ["g"], [-F.col("t"), "id"]).collect()}
    want = {}
    for g, t, i in rows:
        want[g] = min(want.get(g, (-t, i)), (-t, i))
    assert got == {g: i for g, (_, i) in want.items()}
