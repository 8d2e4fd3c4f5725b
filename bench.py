"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``. Results go to
Spark's no-op sink, so every row and column is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from veritrail import build_session
from veritrail.plans.queries import QUERIES

HEADLINE = (
    "prefix_index", "last_state", "prefix_quality", "train_val_split", "train_grader", "guided_replay",
    "best_candidate", "puct_choice", "tree_backup", "sibling_priors", "masked_mean_pool", "seeded_order",
    "confusion_metrics", "batch_loss", "left_truncate", "grade_residual", "extraction_catalog", "guided_rounds",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "veritrail-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # starts the JVM code paths and the Python workers; not timed
    QUERIES["prefix_quality"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
