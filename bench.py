"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on the tables in ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": "total_query_seconds", "value": N, "unit": "sec",
"queries": {...}, "sf": ...}``.  Every query is fully executed through the
``noop`` sink (no result is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "series_mod_z_lineitem",
    "series_mod_z_events",
    "series_rolling_events",
    "series_rolling_wide_events",
    "entities_documents_text",
    "entities_customer_text",
    "entities_audit_events",
    "enrich_audit_events",
    "behavior_profiles_events",
    "behavior_prior_events",
    "behavior_rare_pairs_orders",
    "behavior_escalation_events_24h",
    "engine_aggregate_events",
    "analysis_metrics_events",
    "analysis_threshold_sweep_events",
    "labels_tokens_documents",
    "labels_auto_bio_documents",
    "labels_metrics_quality",
    "govern_compliance_report_orders",
    "govern_reconcile_summary_orders",
    "stream_error_alarm_events",
    "stream_profile_prior_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from logsleuth import suite
    from logsleuth.session import checkpoint_dir, get_spark

    spark = get_spark(f"local[{cpus}]", app="logsleuth-bench", shuffle_partitions=int(cpus) * 2)
    checkpoint_dir(spark)
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        df = suite.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
