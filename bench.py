"""Benchmark: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall seconds.

Each query is fully executed through the ``noop`` sink (no driver collect),
so the time covers scan, shuffles and the final stage.  ``queries`` holds the
steady-state time (best of two warm executions); ``cold`` the first execution
of each query, which includes JIT / code generation of its plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "retrieve_rules", "retrieval_context", "match_patterns", "kg_expand", "via_signature",
    "replay_outcomes", "decay_rules", "next_ids", "summary_rules", "suggest_repairs",
    "resolve_bindings", "cell_neighbors", "template_profile", "layout_compat", "rule_extract",
    "extract_cascade", "few_shot_text", "build_prompts", "data_diff", "check_formulas",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    from refbank.session import get_spark
    from refbank.plans.catalog import REGISTRY

    from refbank.plans import fixtures as X

    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    # JVM / codegen warm-up on a cheap scan (not timed)
    REGISTRY["input_signature"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # The bank tables (rules, edges, patterns, anchors, cells, and the session's
    # retrieval that prompts go on from) are stored
    # Parquet in a deployment; here they are derived from the driver tables
    # once per session.  That one-time build is timed and reported beside the
    # total, as ``bank_build_sec``.
    t0 = time.perf_counter()
    for build in (X.rules, X.edges, X.patterns, X.anchors, X.cells, X.forms, X.retrieved):
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    bank_build = round(time.perf_counter() - t0, 3)
    # Each query: one cold execution (JIT / codegen compile of its plan,
    # reported as ``cold``), then two warm executions; the faster warm one is
    # the steady-state time reported in ``queries``.
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for k in keys:
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            REGISTRY[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        cold[k], times[k] = runs[0], min(runs[1:])
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "cold": cold, "cold_total": round(sum(cold.values()), 3),
                      "bank_build_sec": bank_build, "sf": sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
