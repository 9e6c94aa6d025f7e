"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is timed from building its plan to the last row written to a
``noop`` sink (every row is produced, nothing is collected to the driver).
One untimed warm-up query starts the JVM and JIT first.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from txrisk.plans import catalog  # noqa: E402
from txrisk.plans.dashboard import page_records  # noqa: E402
from txrisk.session import build_session  # noqa: E402
from txrisk.sources.fixture import transactions  # noqa: E402

# The two Spark SQL group-bys of the reference first, then every other
# operator family; the model is trained once (train_model).
HEADLINE = [
    "card_fraud_sql",
    "mode_risk_sql",
    "card_fraud",
    "count_risk",
    "count_card",
    "count_mode",
    "fraud_rate_by_card",
    "dataset_summary",
    "kpis_labelled",
    "kpis_risk",
    "high_risk_amount",
    "risk_share",
    "dashboard_rollup",
    "features_all",
    "features_all_dirty",
    "rule_flags",
    "rule_hit_counts",
    "risk_tier",
    "risk_equal_width",
    "risk_chain",
    "account_index",
    "filter_account",
    "filter_high_risk",
    "account_summary_top10",
    "account_summary_all",
    "account_details",
    "account_lookup_many",
    "first_txn_per_account",
    "first_accounts",
    "numeric_profile",
    "profile_long",
    "profile_report",
    "label_encode",
    "feature_matrix",
    "standardize",
    "class_weights",
    "scan_transactions",
    "csv_round_trip",
    "scan_csv_inferred",
    "upload_risk_counts",
    "upload_kpis",
    "stream_features",
    "train_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app="txrisk-bench", spark__driver__memory="16g")
    qs = catalog.queries()
    qs["card_fraud"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up, untimed
    times: dict[str, float] = {}
    for key in only or HEADLINE:
        start = time.perf_counter()
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(f"{key}: {times[key]}s", file=sys.stderr, flush=True)
    if not only:
        # a whole page load: every base-table figure from the roll-up + accounts
        start = time.perf_counter()
        page_records(transactions(spark, sf_dir))
        times["dashboard_page"] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
