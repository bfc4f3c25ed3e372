"""Properties of the physical plans that matter at scale."""

import io
from contextlib import redirect_stdout

import pytest

from tablewright.plans import business as b
from tablewright.plans import registry
from tablewright.sources import windows

FOLDER = "/root/testdata/sf0.001"
QUERIES, _ = registry.load()


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_") and "dataflow" not in n))
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark):
    t = registry.Tables(spark, FOLDER)
    text = plan(windows.rolling_window(t.lineitem, "l_shipdate", windows.F.lit("2001-08-01").cast("timestamp_ntz")).select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_orders_meet_lines_without_extra_shuffles(spark):
    """Per-order totals are joined and regrouped on the partitioning they already have."""
    t = registry.Tables(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(b.customer_monthly_sales(t.raw_customers, t.raw_orders, t.raw_order_lines))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    head = text.split("\n(1)")[0]
    # orders and lines once for the totals and once for the items, the two regroupings and their
    # join on a key that may be NULL, the distinct items, and the customers
    assert head.count("Exchange") <= 12
    assert "Expand" not in head


def test_panels_read_their_window_only(spark):
    from tablewright.operators import runlog as r

    runs, tasks, alerts = (spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr(
        "ts AS start_time", "ts AS created_at", "ts AS fired_at", "event_type AS status", "event_id > 5 AS is_resolved", "value AS duration_seconds",
        "event_id AS total_rows_processed") for _ in range(3))
    at = "2026-01-01 00:00:00"
    for df in (r.panel_active_runs(runs, at), r.panel_runs_today(runs, at), r.panel_open_alerts(alerts, at), r.kpi_windowed(runs, at)):
        text = plan(df)
        assert "GreaterThan" in text.split("PushedFilters:")[1].split("\n")[0]
    assert plan(r.kpi_dashboard(runs, alerts, tasks, at)).count("PushedFilters: []") == 0


def test_checks_share_one_scan(spark):
    from tablewright.operators.quality import check_results

    t = registry.Tables(spark, FOLDER)
    checks = [{"type": "not_null", "column": c} for c in t.orders.columns] + [{"type": "row_count_min"}]
    assert plan(check_results(t.orders, checks)).split("\n(1)")[0].count("Scan parquet") == 1
    unique = [{"type": "unique", "column": c} for c in ("o_orderkey", "o_custkey", "o_orderdate")]
    assert plan(check_results(t.orders, unique)).split("\n(1)")[0].count("Scan parquet") == 1
