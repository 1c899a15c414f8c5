"""Times the headline queries: one JSON line with seconds by query, each the better of two runs after a warm-up."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from gridloom import registry  # noqa: E402

HEADLINE = [
    "frp_seasonal_series", "frp_trend_fdr", "country_season_totals_shares", "country_season_trend", "hotspot_recurrence", "count_distribution_audit", "column_inventory",
    "fai_daily", "climate_window_weighted_mean", "spearman_battery", "high_correlation_pairs", "metric_overall", "roc_auc", "calibration_bins", "grid_residual_summary",
    "cluster_sufficient_stats", "cluster_bootstrap_ci", "knn_edges", "moran_i", "glm_poisson_offset", "sessions_by_type", "content_signature", "kendall_exact", "metric_reconciliation", "knn_components", "mixed_given_ratio", "response_curves", "hurdle_cluster_metrics", "season_correlations", "model_rank_sums",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    spark.range(1000).groupBy().count().collect()
    for name in HEADLINE:
        best = None
        for _ in range(2):
            t = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - t
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
