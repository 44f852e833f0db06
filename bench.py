"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run twice into a sink that reads all rows and keeps none; the second, warm run counts. The cold run, which
also stores what later queries read again, is printed beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stratalens import catalog  # noqa: E402
from stratalens.session import get_session  # noqa: E402

HEADLINE = [
    "w1_w3_j5_p24_month_bars",
    "j1_asof_inclusive_daily",
    "j2_asof_strict",
    "p25_ratios",
    "a4_winsorized",
    "panel_build",
    "w8_neutralized",
    "w9_rank_target",
    "a14_universe_cap_weighted",
    "b2_a17_w16_factor_periods",
    "a31_performance",
    "l2_l4_fifo_disposals",
    "w21_l11_running_positions",
    "l3_rejected_sales",
    "l12_l14_j14_o3_rebalance_orders",
    "d1_d5_panel_checks",
    "j11_a8_price_correlations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    pool = catalog.load()
    chosen = [q for q in HEADLINE if q in pool]
    cold, seconds = {}, {}
    for name in chosen:
        for run in (cold, seconds):
            start = time.perf_counter()
            pool[name][0](spark, folder).write.format("noop").mode("overwrite").save()
            run[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, warm run", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "cold": cold, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
