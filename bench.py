"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "windows_tumbling", "windows_volume", "windows_hosts", "windows_size_entropy", "windows_sliding", "state_windows",
    "flows_cleaned", "label_transfer", "split_stratified", "sequences", "forecast_alerts", "rules_windows",
    "eval_binary_scores", "eval_per_family", "graph_nodes", "flows_simple", "flows_assembled_classic", "scan_statistics",
)


def main() -> None:
    from tidewatch.plans.catalog import load
    from tidewatch.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, "bench")
    queries, oracles = load()
    seconds, duck_seconds = {}, {}
    try:
        import duckdb
        con = duckdb.connect()
        con.execute(f"SET threads={cpus}")
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    except ImportError:
        con = None
    for name in names:
        times = []
        for i in range(repeats + 1):                    # the first run warms up
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        if con is not None and name in oracles:
            start = time.perf_counter()
            con.execute(oracles[name]).fetchall()
            duck_seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "repeats": repeats, "duckdb_queries": duck_seconds,
        "settings": {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}}))
    spark.stop()


if __name__ == "__main__":
    main()
