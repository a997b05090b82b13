"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["top_n_segments", "top_n_flows", "io_series_100ms", "flow_rollup", "protocol_hierarchy", "flow_sessions_gap", "txn_fifo", "service_time_summary", "retransmit_mark", "packet_loss", "filter_nested"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from netloom.plans.core import QUERIES

    took: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda n=name: QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
