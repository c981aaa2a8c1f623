"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from signalloom.plans.catalogue import QUERIES
from signalloom.session import build_session

HEADLINE = [
    "evidence_classify",
    "base_values",
    "event_normalize",
    "testcase_overview",
    "value_distribution",
    "raw_evidence",
    "chunk_bounds_events",
    "chunk_aggregate",
    "knn_self",
    "retry_report",
    "health_topk",
    "rca_prompt",
    "line_explode",
    "storm_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("testcase_overview")  # starts the JVM's and the workers' code paths
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
