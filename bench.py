"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, and
BENCH_QUERIES (optional) a comma list of query names.  BENCH_WORK_DIR (optional) is the
folder for written intermediates; without it, a new temporary folder serves.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from epilode.catalog import QUERIES  # noqa: E402
from epilode.session import build_session  # noqa: E402

HEADLINE = [
    "weekly_report", "match_town", "match_closest", "match_closest_all_words", "match_unique_edit1", "match_method_compare",
    "fn_town_rules", "fn_address", "fn_race_eth", "agg_median_sd", "win_first_row", "win_share",
    "win_batch_id", "ww_prepare", "trend_derivative_ci", "agg_jurisdiction", "agg_acs_table",
    "src_details_json", "sink_geocode_payload", "join_spatial_intersects", "sp_clip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # Matching is bound by processors, not bytes: keep small shuffles spread.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="epilode-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    # Start the Python workers and the code generator before timing.
    QUERIES["fn_jaro"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    out = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if "match_town" in times:
        out["match_town_rows_per_sec"] = round(lines / times["match_town"], 1)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
