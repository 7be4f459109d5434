"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinframe.plans import all_queries
from kinframe.session import local_session
from kinframe.sources.fixtures import Views

HEADLINE = [
    "q01_list_folders",
    "q10_list_persons",
    "q19_duplicate_groups",
    "v02_centroids",
    "v03_similarity_join",
    "v04_cluster_faces",
    "v10_search_faces",
    "v12_search_batch",
    "v14_closest_person_pairs",
    "p05_nms",
    "p11_composite_gate",
    "p13_detection_breakdown",
    "e08_sim_distribution",
    "e10_threshold_sweep",
    "e12_pair_metrics",
    "i01_ingest_new_files",
    "t04_rate_limit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry = all_queries()
    # One small run starts the JVM's code paths and the Python workers.
    registry["v10_search_faces"].run(Views(spark, sf_dir)).count()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(Views(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
