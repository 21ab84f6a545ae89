"""Time registered queries on one data folder and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [prefix ...]

Every query runs once to its last row (the ``noop`` sink); queries that write files or run
streams do that inside the measured time. ``value`` is the sum over the headline queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workweave.plans import registry  # noqa: E402
from workweave.session import session  # noqa: E402

HEADLINE = [
    "h1_conflicts_by_severity", "f1_occupancy", "f1_occupancy_by_days", "f3_accounts",
    "f4_account_figures", "f5_conflict_figures", "f7_department_shares", "f11_heatmap",
    "g1_conflict_people", "g2_tight_periods", "g3_bridges", "g4_load_runs", "g6_lanes",
    "g12_shown_on_top", "e4_absent_on", "e6_conflicted_entries", "e8_screening", "d8_workdays",
    "j12_after_request", "b2_entry_report", "b8_calendar_events", "c1_clean_departments",
    "j13_merge", "j15_merge_years", "j17_apply_changes", "e16_stale_writes", "g13_attempts",
    "g7_admitted_calls", "e12_cache_lookup", "f13_usage_totals", "j8_usable_answers",
    "k1_body_text", "k2_paragraphs", "k4_links", "k8_emails", "k11_metadata",
    "k14_reduction_profile", "k16_structure_per_page", "k21_preset_job", "k13_repeated_records",
    "k17_learned_templates", "k18_quality_gate", "k22_fallback_chain", "k19_link_expansion",
    "k23_relevant_links", "e10_robots", "s2_bursts", "s3_latest_task_state", "s4_throttle",
    "s8_offline_queue",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    prefixes = sys.argv[1:]
    queries = registry()
    names = HEADLINE if not prefixes else [
        n for n in queries if prefixes == ["all"] or n.startswith(tuple(prefixes))]
    spark = session("bench", cpus)
    # start-up (class loading, code generation) is not charged to the first query
    queries["c2_countable"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
