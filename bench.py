"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["session_index", "build_panel", "resolve_entities", "back_adjust", "quarantine_jumps", "bad_prints", "compute_factors", "rank_top_n",
            "decile_spread", "fama_macbeth", "stage1_verdict", "holdings_return_curve", "random_null", "regime_table", "select_universe", "clenow_ranking",
            "route_signals", "first_touch_exit", "session_limit_audit", "session_record", "evidence_scorecard", "log_cause_groups", "build_features",
            "rank_ic_deciles", "stream_confirmed_bars"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tapeloom.session import build_session
    from tapeloom.suite import load_all
    queries, _ = load_all()
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries["session_index"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
