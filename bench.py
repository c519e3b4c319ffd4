"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from routelens.plans import catalog
from routelens.session import build_session

HEADLINE = (
    "route_confirmatory_report",
    "auroc_by_verifier",
    "auprc_unsupported",
    "decision_quality",
    "calibration_error_left",
    "latency_profile",
    "risk_coverage_curve",
    "rank_correlation",
    "verifier_scorecard",
    "threshold_mcc",
    "gamma_risk_curve",
    "stratified_group_folds",
    "score_matrix_pivot",
    "baseline_suite",
    "escalate_cascade",
    "bm25_top",
    "tfidf_top",
    "evidence_features",
    "coverage_and_counts",
    "source_lexical_entropy",
    "token_windows",
    "bootstrap_clusters_paired",
    "shapley_values",
    "forest_router",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["auroc_by_verifier"](spark, sf_dir).collect()  # start the JVM's compiler and caches
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
