"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from repoaudit.queries import QUERIES  # noqa: E402
from repoaudit.session import build_session  # noqa: E402

HEADLINE = [
    "secret_exposure",
    "cleanup_findings",
    "cleanup_verdict",
    "side_effect_findings",
    "error_contract_verdict",
    "test_quality_states",
    "security_posture_states",
    "contract_gate_states",
    "durable_gate_states",
    "silent_failure_js",
    "silent_failure_python",
    "domain_drift_findings",
    "module_shape_findings",
    "long_functions_report",
    "line_shingles",
    "duplicate_documents",
    "api_candidates",
    "page_broken_links",
    "structure_tool_findings",
    "rollup_health",
    "rollup_ordered_actions",
    "validate_summaries",
    "tree_diff",
    "running_numbers",
    "run_state_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("secret_exposure")
    run("python_imports")
    times = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
