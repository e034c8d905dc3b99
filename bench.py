"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pulsegrid.plans import catalog
from pulsegrid.session import build_session

HEADLINE = (
    "window_table_flagship", "sliding_window_agg", "window_gap_filter", "window_panes", "multiscale_union", "asof_nearest", "interval_join",
    "archetype_label", "anchor_range_join", "sample_index", "label_family", "clean_numeric", "group_summary", "partial_final_counts",
    "baseline_relative", "dataset_robust_z", "ternary_score", "softmax_pref", "univariate_auc_rank", "metric_auc", "bh_fdr", "corr_redundancy",
    "group_kfold", "even_spaced_sample", "resample_linear", "shape_moments", "autocorr", "spectral_features", "wavelet_energy", "cross_corr_lag",
    "stream_sliding",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["scan_pruned"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start executors
    timings: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
