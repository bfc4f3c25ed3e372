"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. With
"""

from __future__ import annotations

import json
import os
import re
import time

from tablewright.plans import registry
from tablewright.plans.mapping import BASE_TABLES
from tablewright.session import build_session

HEADLINE = (
    "order_header order_lines_detail customer_monthly_sales inventory_valuation slow_movers supplier_performance "
    "daily_revenue_summary product_velocity category_totals customer_order_summary dq_unique dq_suite "
    "dq_referential_integrity cdc_apply latest_run_per_pipeline kpi_dashboard kpi_windowed throughput_hourly run_rollup "
    "task_run_upsert run_upsert alert_rules_eval daily_pipeline_metrics explore_summarize"
).split()
RUNS = 3


def timed(action) -> float:
    """Best of a few runs, so that class loading and code generation do not count."""
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def duckdb_seconds(folder: str, cpus: int, checks: dict[str, str]) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": cpus})
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return {name: timed(lambda sql=checks[name]: con.execute(sql).to_arrow_table()) for name in HEADLINE}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, checks = registry.load()
    seconds = {
        name: timed(lambda fn=queries[name]: fn(spark, folder).write.format("noop").mode("overwrite").save())
        for name in HEADLINE
    }
    scale = re.search(r"sf([0-9.]+)", folder)
    report = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }
    if os.environ.get("BENCH_DUCKDB"):
        report["duckdb"] = duckdb_seconds(folder, cpus, checks)
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
