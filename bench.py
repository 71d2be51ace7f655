"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnkit.models import draws as D  # noqa: E402
from tarnkit.plans import all_queries  # noqa: E402
from tarnkit.plans.bindings import draws  # noqa: E402
from tarnkit.session import local_session  # noqa: E402

HEADLINE = [
    "chem_table_yearly", "chem_table", "missing_fraction", "drop_sparse_columns", "key_violations", "weekly_max",
    "long_value_lod", "climate_wide", "rolling_climate_days", "lagged_predictors", "site_climate_join",
    "detection_summary", "paired_detections", "kruskal_wallis", "dunn_pairs", "bh_adjust", "pearson_pairs",
    "detection_correlation", "midranks", "residual_acf", "zscores", "cumulative_stats", "sorted_positions",
    "top_k_ties", "quantile_summary", "auc_by_model", "roc_points", "roc_bands", "auc_summary",
    "importance_summary", "top_predictors_shared", "loo_compare", "prediction_grid", "mean_draws",
    "threshold_draws", "threshold_summary", "calibration", "grouped_checks", "holdout_forest",
]


def dense_thresholds(spark, folder):
    """Thresholds of 200-point curves, the grid size of the published analysis."""
    return D.threshold_summary(D.crossing_points(draws(spark, folder, n_draws=4, n_x=200, n_weeks=4)))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "8g"))
    found = all_queries()
    work = {name: found[name] for name in HEADLINE} | {"dense_thresholds": dense_thresholds}
    chosen = sys.argv[1:] or list(work)
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds = {}
    for name in chosen:
        began = time.perf_counter()
        work[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
