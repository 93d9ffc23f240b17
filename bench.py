"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a6_table_fingerprint", "b4_superset_with_membership", "b5_label_prevalence", "c3_asof_prior",
    "c6_covering_latest", "c10_leakage_audit", "d5_effective_sample", "d8_balance_table", "e1_auroc",
    "e8_within_stratum_concordance", "e11_clustered_auroc_ci_poisson", "e12_paired_auroc_diff",
    "e14_clustered_concordance_ci", "e18_gain_retained", "f5_ece_ci", "f11_net_benefit_curve",
    "g2_fit_gbt_arm", "h2_signal_decimate",
]


def main() -> None:
    from stampline.plans.catalog import QUERIES
    from stampline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), app="bench")
    QUERIES["b7_split_counts"](spark, sf_dir).collect()  # start the JVM paths once
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
