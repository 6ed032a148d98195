"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helixmart.plans import queries  # noqa: E402
from helixmart.session import get_session  # noqa: E402

HEADLINE = [
    "model_mart_treatment_recommendations", "model_mart_drug_subtype_profile", "model_mart_risk_features_combined",
    "model_mart_dose_response_summary", "d1_gene_pivot", "d2_gene_summary", "c12_similar_patient_count",
    "c12_nearest_by_burden", "c12_nearest_by_age_and_burden", "c14_nearest_profiles", "i1_chunks", "i3_hashes",
    "j1_text_search", "j6_golden_match", "a9_pdf_links", "l1_flat_events", "d29_feature_usage", "l4_gap_sessions",
    "d18_fold_change", "k5_stratified_split",
]


def run(fn, spark, folder: str) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    jobs = queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(jobs[name], spark, folder)  # warm-up
        times = sorted(run(jobs[name], spark, folder) for _ in range(3))
        seconds[name] = round(times[1], 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").split("/")[-1].removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
