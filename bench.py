"""Headline queries on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all).
"""

from __future__ import annotations

import json
import os
import sys
import time

from wardspan.queries import QUERIES
from wardspan.session import build_session

HEADLINE = [
    "grid_score_tiers", "hourly_grid", "grid_ffill", "first_window_agg", "point_in_interval", "asof_latest", "asof_bidirectional",
    "range_self_min", "trailing_boundary_sums", "islands", "elementary_segments", "rolling_mean_std_slope", "percentile_cutpoints",
    "corr_matrix", "autocorr_lags", "star_join", "ranked_metrics", "boot_ci", "dedup_alerts_4h", "return_within_30d", "lace_features",
    "hash_chain_verify", "early_warning", "wasserstein_1d", "sentence_ledger", "tfidf_topk", "concept_vitalsign", "concept_ventilation",
    "concept_sofa", "concept_suspicion_of_infection", "clinical_hourly_grid",
]


def main() -> int:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "20g", "spark.sql.files.maxPartitionBytes": "32m"},
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
        print(f"{n}: {times[n]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
