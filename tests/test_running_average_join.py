import numpy as np

from kinframe.operators import cluster, evaluate
from kinframe.session import materialize


def test_running_average_behind_a_join_by_label(spark):
    """The adaptive plan turns the join into a broadcast one that leaves a label in several tasks."""
    rng = np.random.default_rng(8)
    rows = [(i, f"l{i % 12}", rng.normal(size=4).tolist()) for i in range(1200)]
    df = materialize(spark.createDataFrame(rows, "face_order long, label string, embedding array<double>").repartition(6))
    want = {r.face_order: r.cluster for r in cluster.cluster_running_average(df, 0.8).collect()}
    labels = df.groupBy("label").count().where("count >= 2").select("label")
    # The estimate of the labels lies above the limit, their size below; small rows stay in several tasks.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "4KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = {r.face_order: r.cluster for r in cluster.cluster_running_average(df.join(labels, "label", "left_semi"), 0.8).collect()}
        per = evaluate.mean_clusters_per_identity(df.unionByName(df.limit(1).selectExpr("-1L AS face_order", "'one' AS label", "embedding")), [0.8]).first()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert got == want
    assert (per["identities"], per["clusters"]) == (12, sum(max(want[i] for i in range(k, 1200, 12)) for k in range(12)))
