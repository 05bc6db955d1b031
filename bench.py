"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rasterlab.plans import QUERIES  # noqa: E402
from rasterlab.session import session  # noqa: E402

HEADLINE = [
    "view_mean_max", "head_label_join", "scored_scans", "advice_level", "dataset_stats", "range_check", "scale_check",
    "truth_upsert", "robust_z_audit", "feature_ranges", "class_histogram", "auc_ranking", "youden",
    "threshold_midpoint_kappa", "fold_metrics", "paired_delta", "bootstrap_ci", "importance_topk",
    "colour_stats", "box_mean", "laplacian", "components4", "subject_mask", "normalise", "garlic_uv_mask",
    "view_features", "forest_cv", "knn", "session_machine",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
                                         "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start-up is not a query
    times = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
