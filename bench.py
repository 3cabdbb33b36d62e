"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every timed query starts from the source files: staged tables of earlier
queries are forgotten first. One untimed pass over a small query warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import QUERIES  # noqa: E402
from tidemark.catalog.registry import forget  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "daily_bars", "signal_counts", "signal_frame_with_liquidity", "weekly_asof_fill", "availability_audit", "daily_score_rows",
    "bracket_exit_outcomes", "independent_trades", "scenario_sensitivity", "yearly_table", "sector_capped_universe",
    "one_shot_outcomes", "position_day_pnl", "signal_dispositions", "capacity_attribution", "cluster_bootstrap",
    "alert_validation", "accepted_only_dedup", "pending_admission", "adjustment_continuity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = round(time.perf_counter() - start, 3)
        print(f"{name} {took}", file=sys.stderr, flush=True)
        return took

    run("signal_counts")
    seconds = {name: run(name) for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
