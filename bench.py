"""Time the headline queries: one warm-up and three timed runs each (``BENCH_RUNS``), median seconds.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores;
``BENCH_QUERIES`` (comma separated, or ``all``) chooses other queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditweave.plans.registry import QUERIES
from auditweave.session import build_session

HEADLINE = [
    "skip_reason", "scan_stats", "max_files_cap", "repo_profile", "manifest_counts",
    "evidence_semgrep", "dep_findings", "attempt_fallback",
    "first_match", "top_security_risks", "roadmap", "repair_or_reject",
    "evidence_dedup", "evidence_cap", "dep_top_n", "token_counts", "context_tier",
    "redact_text", "summary_json",
    "latest_state", "transition_chain", "stage_spans", "run_manifest", "upsert_runs",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(QUERIES[name], spark, sf_dir)
        seconds[name] = round(statistics.median(timed(QUERIES[name], spark, sf_dir) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
