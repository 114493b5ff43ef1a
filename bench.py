"""Time the headline queries; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``. Each query runs once to warm up, then the median of
``BENCH_RUNS`` runs (default 3) is reported; rows are consumed without being brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from gatehouse.session import build_session
from suite import load
from suite.registry import REGISTRY

HEADLINE = (
    "e8_ingest_full", "e8_ingest_append_skip", "e8_ingest_append_update", "b2_infer_lineitem_types", "d11_document_suite",
    "d11_all_errors", "b8_typed_projection", "a11_typed_long", "e2_first_wins", "e5_upsert", "l2_version_edits",
    "l6_lifecycle_requests", "l8_pin_config", "l10_allocate_codes", "l11_sync_tags_mapping", "q9_current_version_report",
    "q12_run_issues", "q14_tenant_graph", "g9_sorted_tag_lists", "j2_keyword_search", "j12_catalog_search", "a1_read_delimited",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    load()
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
