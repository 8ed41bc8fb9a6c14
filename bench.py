"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dyadic.session import tuned_session  # noqa: E402

HEADLINE = [
    "interaction_regression", "paired_delta", "topk_variance", "bh_fdr", "residualise", "simple_regression",
    "fold_preprocess", "loo_topk_variance", "ulm_activity", "ssgsea", "interval_semi_join", "hypergeom_enrichment",
    "permanova", "proximity_test", "variance_components", "mondrian_conformal", "spearman", "pca_scores", "deconvolve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from dyadic.catalog import QUERIES

    spark = tuned_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    # One small untimed run starts the JVM code paths and the Python workers.
    QUERIES["interaction_regression"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
