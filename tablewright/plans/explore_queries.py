"""Explorer questions over the mapped tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.sqltext import run_sql
from tablewright.operators import explore as e
from tablewright.plans.business import inventory_valuation
from tablewright.plans.mapping import BASE_TABLES
from tablewright.plans.registry import query


@query("explore_select", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def explore_select(t):
    """Comment header, trailing semicolon and the default row limit."""
    return e.explore(t.spark, """-- [1] alias: extract_orders
-- largest finished orders
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_totalprice DESC, o_orderkey;""", {"orders": t.orders})


@query("explore_join", """
SELECT i.StockItemID, i.StockItemName, CAST(h.QuantityOnHand AS BIGINT) AS QuantityOnHand,
       CAST(ROUND(h.QuantityOnHand * h.LastCostPrice, 2) AS DOUBLE) AS StockCostValue
FROM raw_stock_holdings h JOIN raw_stock_items i ON h.StockItemID = i.StockItemID
WHERE h.QuantityOnHand > 0 ORDER BY StockCostValue DESC, i.StockItemID LIMIT 100""")
def explore_join(t):
    valued = inventory_valuation(t.raw_stock_items, t.raw_stock_holdings, t.raw_suppliers)
    return e.explore(t.spark, """
SELECT iv.StockItemID, iv.StockItemName, h.QuantityOnHand, iv.StockCostValue
FROM extract_stock_holdings.raw_stock_holdings h
JOIN transform_inventory_valuation.inventory_valuation iv ON h.StockItemID = iv.StockItemID
WHERE h.QuantityOnHand > 0 ORDER BY iv.StockCostValue DESC, iv.StockItemID""", {
        f"{e.explorer_alias('Extract-Stock-Holdings')}.raw_stock_holdings": t.raw_stock_holdings,
        f"{e.explorer_alias('transform_inventory_valuation')}.inventory_valuation": valued}, limit=100)


_NULLS_SQL = """
SELECT run_id, duration_seconds, ROW_NUMBER() OVER (ORDER BY error_message DESC, run_id) AS place
FROM pipeline_runs ORDER BY duration_seconds, end_time DESC, run_id LIMIT 700"""


@query("explore_null_order", _NULLS_SQL)
def explore_null_order(t):
    """Sort keys with NULLs, in a window too: they come last, whatever the direction."""
    return e.explore(t.spark, _NULLS_SQL, {"pipeline_runs": t.pipeline_runs}, limit=700)


_NUMBERS_SQL = """
SELECT event_id, event_id / 4 AS quarter, event_id / 4 / (1 + event_id % 3) AS again, CAST(value AS DECIMAL(10,2)) / 3 AS third,
       event_id / (event_id % 2) > 1e300 AS endless, (-1 - event_id) / (event_id % 2) < -1e300 AS endless_below,
       CAST(event_id / 4 AS BIGINT) AS to_even, TRY_CAST(CAST(event_id / 4 AS VARCHAR) AS BIGINT) AS from_text,
       TRY_CAST(event_type AS BIGINT) AS no_number, CAST(CAST(event_id / 4 AS DECIMAL(12,2)) AS BIGINT) AS from_decimal
FROM events"""


@query("explore_numbers", _NUMBERS_SQL)
def explore_numbers(t):
    """Divisions, by zero too, and casts that round."""
    return run_sql(t.spark, _NUMBERS_SQL, {"events": t.events})


@query("explore_summarize", """
SELECT column_name, column_type, min, max, count, CAST(null_percentage AS DOUBLE) AS null_percentage
FROM (SUMMARIZE SELECT * FROM raw_orders)""")
def explore_summarize(t):
    """The exact statistics; the approximate ones are left to the tests."""
    return e.explore(t.spark, "SUMMARIZE SELECT * FROM raw_orders", {"raw_orders": t.raw_orders}).select(
        "column_name", "column_type", "min", "max", "count", "null_percentage")


@query("explore_describe", """
SELECT column_name, column_type, (SELECT COUNT(*) FROM lineitem) AS total_rows
FROM (DESCRIBE SELECT * FROM lineitem)""")
def explore_describe(t):
    rows = e.row_count(t.lineitem).first()["total_rows"]
    return e.explore(t.spark, "DESCRIBE lineitem", {"lineitem": t.lineitem}).withColumn("total_rows", F.lit(rows))


@query("explore_show_tables", "\nUNION ALL ".join(
    f"SELECT '{name}' AS name, COUNT(*) AS total_rows FROM {name}" for name in BASE_TABLES))
def explore_show_tables(t):
    tables = {name: t.base(name) for name in BASE_TABLES}
    listed = e.explore(t.spark, "SHOW TABLES", tables)
    counts = [e.row_count(df).withColumn("name", F.lit(name)) for name, df in tables.items()]
    return listed.join(reduce(DataFrame.unionByName, counts), "name")


@query("explore_preview", "SELECT OrderID, CustomerID, OrderDate FROM raw_orders ORDER BY OrderID LIMIT 100")
def explore_preview(t):
    return e.preview(t.raw_orders.select("OrderID", "CustomerID", "OrderDate").orderBy("OrderID"))


@query("explore_row_count", "SELECT COUNT(*) AS total_rows FROM lineitem")
def explore_row_count(t):
    return e.row_count(t.lineitem)


@query("explore_null_check", """
SELECT COUNT(*) FILTER (WHERE PickingCompletedWhen IS NULL) AS nulls, COUNT(*) AS total FROM raw_order_lines""")
def explore_null_check(t):
    return e.null_check(t.raw_order_lines, "PickingCompletedWhen")


@query("explore_distinct_values", """
SELECT StockItemID, COUNT(*) AS cnt FROM raw_order_lines GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 50""")
def explore_distinct_values(t):
    return e.distinct_values(t.raw_order_lines, "StockItemID")


@query("explore_filter_top", """
SELECT StockItemID, CAST(QuantityOnHand AS BIGINT) AS QuantityOnHand FROM raw_stock_holdings
WHERE QuantityOnHand > 0 ORDER BY QuantityOnHand DESC, StockItemID LIMIT 100""")
def explore_filter_top(t):
    rows = t.raw_stock_holdings.select("StockItemID", "QuantityOnHand")
    return e.filter_top(rows, F.col("QuantityOnHand") > 0, [F.desc("QuantityOnHand"), "StockItemID"])


@query("explore_recent", """
SELECT OrderID, OrderDate FROM raw_orders WHERE OrderDate >= DATE '2001-01-01' ORDER BY OrderDate DESC, OrderID LIMIT 100""")
def explore_recent(t):
    return e.recent(t.raw_orders.select("OrderID", "OrderDate"), "OrderDate", "2001-01-01", "OrderID")
