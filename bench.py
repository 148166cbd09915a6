"""Benchmark: wall-clock seconds of the headline queries, one JSON line on stdout.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from benefica.plans import load
from benefica.session import local_session

HEADLINE = [
    "flagship_risk_levels", "b06_rule_scores", "c02_feature_star", "c03_shared_phone", "d02_payment_features",
    "d17_global_thresholds", "k13_hybrid_scan", "b14_manager_chain", "c13_batch_status", "c16_digital_payloads",
    "c18_funds_gate", "c20_interval_overlap", "a08_statement_transactions", "c21_reconcile_lines", "d10_dashboard_rows",
    "d12_household_indicator", "e02_numbered_ledger", "e03_priority_rank", "e05_greedy_approval", "e06_payment_batches",
    "i01_duplicates_by_document", "i05_survivor_rule", "i06_fuzzy_duplicates", "i07_registry_flags", "i10_mapping_after",
    "j01_degrees_and_strength", "j02_weighted_pagerank", "k09_area_under_curve", "l03_stage_machine_stream",
]


def model_quality(spark, folder: str) -> dict:
    """Held-out quality of the forest on the beneficiaries of the given tables."""
    from benefica.operators import learning
    from benefica.plans.learning import held_out
    from benefica.scale import stage
    from benefica.tables import Tables

    scored = stage(held_out(Tables(spark, folder), "random_forest"), "scored")
    m = learning.confusion(scored, "is_fraud", "ml_score", 0.5).first()
    return {"random_forest_auc": round(learning.auc(scored, "is_fraud", "ml_score").first()[0], 4),
            **{k: round(m[k], 4) for k in ("accuracy", "precision", "recall", "f1")}}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8))
    registry = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    start = time.perf_counter()
    quality = model_quality(spark, folder)
    seconds["k05_train_and_evaluate"] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf.group(1)) if sf else None, "model_quality": quality}))


if __name__ == "__main__":
    main()
