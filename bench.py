"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names,
comma separated; default the headline list, ``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.catalog import REGISTRY  # noqa: E402
from workload.session import local_session  # noqa: E402

HEADLINE = """
area_risk_heat customer_view newest_submission deduplicated_loans quarantine_split missing_marks
quality_report ingest_check incremental_upsert year_quarter_table trailing_windows
trailing_windows_hot_keys application_bursts time_features derived_ratios area_stats drill_down
monthly_overdue_rate overdue_rate_by_product_and_segment event_effect kpis risk_tiers tier_exposure
cluster_profile score_histogram scorecard_with_weight classifier_metrics cost_threshold
similar_customers similar_cases frequent_items association_rules repair_by_rule rule_repair_metrics
factor_repair neighbour_repair default_predictions amount_model_comparison amount_quantiles
shap_importance segments customer_timelines improvement_trends fraud_features stream_decisions
batch_decisions dashboard_panels
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(cpus, shuffle=cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    # Start the engine and its Python workers outside the timing.
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    spark.range(0, 64, 1, cpus).mapInPandas(lambda parts: parts, "id long").count()
    took = {}
    for name in names:
        start = time.perf_counter()
        try:
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # a failure must show up, not end the run
            took[name] = None
            print(f"{name}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
    live = took.get("stream_decisions")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(t for t in took.values() if t is not None), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": took,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "stream_rows_per_second": round(events / live, 1) if live else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
