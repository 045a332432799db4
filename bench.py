"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lakewright.plans import QUERIES
from lakewright.session import local_session

HEADLINE = (
    "fc_regression", "fc_binary", "fc_kappa", "fc_daily_energy", "fc_peak_hour", "fc_lag_by_user",
    "num_parse_generic", "ts_parse_multi", "probe_columns", "unify_orders_variants", "year_partition_counts",
    "doc_size_prefilter_dups", "dup_canonical", "dedup_summary", "budget_cross", "budget_greedy", "url_route",
    "catalog_tables", "catalog_search", "count_reconcile",
    "doc_changed_only", "doc_state_latest", "page_links", "page_text", "doc_chunks", "embed_default",
    "lexical_score", "vector_topk", "hybrid_topk_cap3", "signature_changed",
    "answer_accuracy", "latency_index_rule", "label_confusion", "last_n_messages",
    "mart_monthly", "noise_floor", "plant_registry_join", "validity_join", "radius_join", "stream_slots",
)


REPEAT_SECONDS = 200


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session("lakewright-bench", cores=cores, shuffle=int(cores) if cores.isdigit() else 8, memory="12g")
    QUERIES["fc_regression"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    began = time.perf_counter()
    failed: dict[str, str] = {}
    for name in names:
        best = None
        for i in range(repeats):
            if i and time.perf_counter() - began > REPEAT_SECONDS:
                break  # late queries are timed once, so that a slow machine still finishes
            start = time.perf_counter()
            try:
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            except Exception as error:  # one query that fails is reported and does not cost the others' times
                failed[name] = f"{type(error).__name__}: {error}"[:300]
                break
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        if best is not None and name not in failed:
            times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), **({"failed": failed} if failed else {}),
    }))


if __name__ == "__main__":
    main()
