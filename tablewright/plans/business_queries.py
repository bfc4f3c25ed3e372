"""Business tables over the mapped inputs, with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.plans import business as b
from tablewright.plans.registry import query

# Shared by the checks: line amounts as exact decimals.
DETAIL_SQL = """
SELECT OrderLineID, OrderID, StockItemID, Description AS StockItemDescription, Quantity, UnitPrice, TaxRate,
       CAST(ROUND(Quantity * UnitPrice, 2) AS DOUBLE) AS LineTotal,
       CAST(ROUND(Quantity * UnitPrice * TaxRate * 0.01, 2) AS DOUBLE) AS TaxAmount,
       CAST(ROUND(Quantity * UnitPrice + Quantity * UnitPrice * TaxRate * 0.01, 2) AS DOUBLE) AS LineTotalIncTax,
       PickedQuantity, Quantity - PickedQuantity AS OutstandingQty,
       CASE WHEN PickedQuantity >= Quantity THEN 'FULLY_PICKED' WHEN PickedQuantity > 0 THEN 'PARTIALLY_PICKED'
            ELSE 'NOT_PICKED' END AS PickingStatus,
       PickingCompletedWhen
FROM raw_order_lines"""

MONTHLY_SQL = """
SELECT c.CustomerID, c.CustomerName, c.IsOnCreditHold, CAST(c.CreditLimit AS DOUBLE) AS CreditLimit,
       DATE_TRUNC('month', CAST(o.OrderDate AS TIMESTAMP)) AS OrderMonth,
       COUNT(DISTINCT o.OrderID) AS OrderCount, COUNT(l.OrderLineID) AS TotalOrderLines,
       CAST(SUM(l.Quantity) AS BIGINT) AS TotalUnits,
       CAST(ROUND(SUM(l.Quantity * l.UnitPrice), 2) AS DOUBLE) AS TotalRevenue,
       CAST(ROUND(SUM(l.Quantity * l.UnitPrice * l.TaxRate * 0.01), 2) AS DOUBLE) AS TotalTax,
       CAST(ROUND(SUM(l.Quantity * l.UnitPrice) + SUM(l.Quantity * l.UnitPrice * l.TaxRate * 0.01), 2) AS DOUBLE)
         AS TotalRevIncTax,
       FLOOR(CAST(SUM(l.Quantity * l.UnitPrice) AS DOUBLE) / COUNT(l.Quantity * l.UnitPrice) * 100 + 0.5) / 100
         AS AvgLineValue,
       COUNT(DISTINCT l.StockItemID) AS UniqueItemsBought
FROM raw_customers c
JOIN raw_orders o ON c.CustomerID = o.CustomerID
JOIN raw_order_lines l ON o.OrderID = l.OrderID
GROUP BY ALL"""


@query("order_header", """
SELECT o.OrderID, o.CustomerID, c.CustomerName, c.IsOnCreditHold, CAST(c.CreditLimit AS DOUBLE) AS CreditLimit,
       CAST(c.StandardDiscountPercentage AS DOUBLE) AS StandardDiscountPercentage,
       o.SalespersonPersonID, s.SalespersonName, o.OrderDate, o.ExpectedDeliveryDate,
       o.CustomerPurchaseOrderNumber, o.IsUndersupplyBackordered, o.Comments,
       DATEDIFF('day', TRY_CAST(o.OrderDate AS DATE), TRY_CAST(o.ExpectedDeliveryDate AS DATE)) AS PromisedLeadDays
FROM raw_orders o
LEFT JOIN raw_customers c ON o.CustomerID = c.CustomerID
LEFT JOIN raw_salespeople s ON o.SalespersonPersonID = s.PersonID""")
def order_header(t):
    return b.order_header(t.raw_orders, t.raw_customers, t.raw_salespeople)


@query("order_lines_detail", f"""
SELECT * REPLACE (CAST(UnitPrice AS DOUBLE) AS UnitPrice, CAST(TaxRate AS DOUBLE) AS TaxRate,
                  CAST(Quantity AS BIGINT) AS Quantity, CAST(PickedQuantity AS BIGINT) AS PickedQuantity,
                  CAST(OutstandingQty AS BIGINT) AS OutstandingQty)
FROM ({DETAIL_SQL}) d""")
def order_lines_detail(t):
    return b.order_lines_detail(t.raw_order_lines)


@query("customer_monthly_sales", MONTHLY_SQL)
def customer_monthly_sales(t):
    return b.customer_monthly_sales(t.raw_customers, t.raw_orders, t.raw_order_lines)


@query("inventory_valuation", """
SELECT i.StockItemID, i.StockItemName, i.SupplierID, s.SupplierName,
       CAST(i.UnitPrice AS DOUBLE) AS CurrentSalePrice, CAST(i.RecommendedRetailPrice AS DOUBLE) AS RecommendedRetailPrice,
       CAST(i.TaxRate AS DOUBLE) AS TaxRate, CAST(i.LeadTimeDays AS BIGINT) AS LeadTimeDays, i.IsChillerStock,
       i.Brand, i.Size, CAST(h.QuantityOnHand AS BIGINT) AS QuantityOnHand, h.BinLocation,
       CAST(h.LastCostPrice AS DOUBLE) AS LastCostPrice, CAST(h.LastStocktakeQuantity AS BIGINT) AS LastStocktakeQuantity,
       CAST(h.ReorderLevel AS BIGINT) AS ReorderLevel, CAST(h.TargetStockLevel AS BIGINT) AS TargetStockLevel,
       CAST(ROUND(h.QuantityOnHand * h.LastCostPrice, 2) AS DOUBLE) AS StockCostValue,
       CAST(ROUND(h.QuantityOnHand * i.RecommendedRetailPrice, 2) AS DOUBLE) AS StockRetailValue,
       CAST(ROUND(h.QuantityOnHand * i.UnitPrice, 2) AS DOUBLE) AS StockSaleValue,
       CAST(h.TargetStockLevel - h.QuantityOnHand AS BIGINT) AS StockGap,
       CASE WHEN h.QuantityOnHand <= 0 THEN 'OUT_OF_STOCK' WHEN h.QuantityOnHand <= h.ReorderLevel THEN 'BELOW_REORDER'
            WHEN h.QuantityOnHand >= h.TargetStockLevel THEN 'AT_TARGET' ELSE 'NORMAL' END AS StockStatus
FROM raw_stock_items i
LEFT JOIN raw_stock_holdings h ON i.StockItemID = h.StockItemID
LEFT JOIN raw_suppliers s ON i.SupplierID = s.SupplierID""")
def inventory_valuation(t):
    return b.inventory_valuation(t.raw_stock_items, t.raw_stock_holdings, t.raw_suppliers)


@query("slow_movers", """
WITH moved AS (
  SELECT StockItemID, COUNT(*) AS tx,
         CAST(SUM(CASE WHEN TRY_CAST(Quantity AS BIGINT) < 0 THEN ABS(TRY_CAST(Quantity AS BIGINT)) ELSE 0 END) AS BIGINT)
           AS units_out
  FROM raw_stock_transactions GROUP BY StockItemID)
SELECT i.StockItemID, i.StockItemName, i.SupplierID, s.SupplierName, i.IsChillerStock,
       CAST(h.QuantityOnHand AS BIGINT) AS QuantityOnHand, CAST(h.ReorderLevel AS BIGINT) AS ReorderLevel,
       CAST(h.LastCostPrice AS DOUBLE) AS LastCostPrice,
       CAST(ROUND(h.QuantityOnHand * h.LastCostPrice, 2) AS DOUBLE) AS StockValue,
       COALESCE(m.tx, 0) AS TxCount30Days, COALESCE(m.units_out, 0) AS TotalQtyOut30Days,
       FLOOR(CAST(COALESCE(m.units_out, 0) AS DOUBLE) / 30.0 * 100 + 0.5) / 100 AS AvgDailyMovement,
       CASE WHEN h.QuantityOnHand > 0 AND COALESCE(m.units_out, 0) > 0
            THEN FLOOR(CAST(h.QuantityOnHand * 30 AS DOUBLE) / m.units_out + 0.5) END AS DaysOfStock,
       CASE WHEN COALESCE(m.tx, 0) = 0 THEN 'DORMANT' WHEN COALESCE(m.units_out, 0) < 30 THEN 'SLOW'
            WHEN COALESCE(m.units_out, 0) < 150 THEN 'MODERATE' ELSE 'ACTIVE' END AS MovementCategory
FROM raw_stock_items i
LEFT JOIN raw_stock_holdings h ON i.StockItemID = h.StockItemID
LEFT JOIN raw_suppliers s ON i.SupplierID = s.SupplierID
LEFT JOIN moved m ON i.StockItemID = m.StockItemID
WHERE h.QuantityOnHand > 0""")
def slow_movers(t):
    return b.slow_movers(t.raw_stock_items, t.raw_stock_holdings, t.raw_suppliers, t.raw_stock_transactions)


@query("supplier_performance", """
WITH moved AS (
  SELECT i.SupplierID, COUNT(*) AS tx,
         CAST(SUM(CASE WHEN x.Quantity > 0 THEN x.Quantity ELSE 0 END) AS BIGINT) AS received,
         CAST(SUM(CASE WHEN x.Quantity < 0 THEN ABS(x.Quantity) ELSE 0 END) AS BIGINT) AS returned
  FROM raw_stock_transactions x JOIN raw_stock_items i ON x.StockItemID = i.StockItemID GROUP BY i.SupplierID)
SELECT s.SupplierID, s.SupplierName, s.PhoneNumber, CAST(s.PaymentDays AS BIGINT) AS PaymentDays,
       FLOOR(SUM(CAST(i.LeadTimeDays AS DOUBLE)) / NULLIF(COUNT(i.LeadTimeDays), 0) * 10 + 0.5) / 10 AS AvgLeadTimeDays,
       COUNT(DISTINCT i.StockItemID) AS UniqueItemsStocked,
       COALESCE(m.tx, 0) AS TotalTransactions30Days, COALESCE(m.received, 0) AS TotalUnitsReceived30Days,
       COALESCE(m.returned, 0) AS TotalUnitsReturned30Days,
       CASE WHEN COALESCE(m.received, 0) > 0
            THEN FLOOR(CAST(COALESCE(m.returned, 0) AS DOUBLE) * 100.0 / m.received * 100 + 0.5) / 100
            ELSE 0.0 END AS ReturnRatePct
FROM raw_suppliers s
LEFT JOIN raw_stock_items i ON s.SupplierID = i.SupplierID
LEFT JOIN moved m ON s.SupplierID = m.SupplierID
GROUP BY s.SupplierID, s.SupplierName, s.PhoneNumber, s.PaymentDays, m.tx, m.received, m.returned""")
def supplier_performance(t):
    return b.supplier_performance(t.raw_suppliers, t.raw_stock_items, t.raw_stock_transactions)


@query("daily_revenue_summary", f"""
WITH details AS ({DETAIL_SQL})
SELECT DATE_TRUNC('day', CAST(o.OrderDate AS TIMESTAMP)) AS SalesDate, c.CustomerName, s.SalespersonName,
       COUNT(DISTINCT o.OrderID) AS OrderCount, CAST(SUM(d.Quantity) AS BIGINT) AS TotalUnits,
       CAST(ROUND(SUM(d.Quantity * d.UnitPrice), 2) AS DOUBLE) AS TotalRevenue,
       CAST(ROUND(SUM(d.Quantity * d.UnitPrice * d.TaxRate * 0.01), 2) AS DOUBLE) AS TotalTax,
       CAST(ROUND(SUM(d.Quantity * d.UnitPrice) + SUM(d.Quantity * d.UnitPrice * d.TaxRate * 0.01), 2) AS DOUBLE)
         AS TotalRevenueIncTax
FROM raw_orders o
JOIN details d ON o.OrderID = d.OrderID
LEFT JOIN raw_customers c ON o.CustomerID = c.CustomerID
LEFT JOIN raw_salespeople s ON o.SalespersonPersonID = s.PersonID
GROUP BY 1, 2, 3""")
def daily_revenue_summary(t):
    """The header columns it needs are the orders' own, so the header joins are not repeated here."""
    return b.daily_revenue_summary(
        t.raw_orders, b.order_lines_detail(t.raw_order_lines), t.raw_customers, t.raw_salespeople
    )


@query("product_velocity", f"""
WITH details AS ({DETAIL_SQL})
SELECT StockItemID, StockItemDescription, CAST(SUM(Quantity) AS BIGINT) AS TotalUnitsSold,
       COUNT(DISTINCT OrderID) AS OrderCount,
       CAST(ROUND(SUM(Quantity * UnitPrice), 2) AS DOUBLE) AS TotalRevenue,
       FLOOR(CAST(SUM(UnitPrice) AS DOUBLE) / COUNT(UnitPrice) * 100 + 0.5) / 100 AS AvgUnitPrice
FROM details GROUP BY 1, 2 ORDER BY 3 DESC, 1""")
def product_velocity(t):
    return b.product_velocity(b.order_lines_detail(t.raw_order_lines))


@query("limited_projection", """
SELECT StockItemID, StockItemName, SupplierID, 'success' AS status
FROM raw_stock_items ORDER BY StockItemID LIMIT 100""")
def limited_projection(t):
    return b.limited_projection(t.raw_stock_items)


@query("order_tier", """
SELECT o.o_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date, o.o_totalprice AS total_amount,
       c.c_name AS customer_name, c.c_mktsegment AS region,
       CASE WHEN o.o_totalprice > 300000 THEN 'high' WHEN o.o_totalprice > 100000 THEN 'medium' ELSE 'low' END
         AS order_tier
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE CASE WHEN o.o_orderstatus = 'P' THEN 'CANCELLED' ELSE o.o_orderstatus END <> 'CANCELLED'""")
def order_tier(t):
    orders = t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_totalprice").alias("total_amount"),
        F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    customers = t.customer.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("region"),
    )
    return b.order_tier(orders, customers, high=300000, medium=100000)


@query("category_totals", """
SELECT l.l_orderkey AS order_id, p.p_type AS category, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""")
def category_totals(t):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    parts = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))
    return b.category_totals(lines, parts)


@query("customer_order_summary", """
SELECT o_custkey AS CustomerID, COUNT(*) AS order_count,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY 1""")
def customer_order_summary(t):
    return b.customer_order_summary(t.orders.select(
        F.col("o_custkey").alias("CustomerID"), F.col("o_totalprice").cast("decimal(18,2)").alias("OrderTotal")))


@query("running_total_by_key", """
WITH raw AS (SELECT o_custkey AS CustomerID, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders)
SELECT CustomerID, CAST(SUM(total) AS DOUBLE) AS total FROM raw GROUP BY 1""")
def running_total_by_key(t):
    return b.running_total_by_key(t.orders.select(
        F.col("o_custkey").alias("CustomerID"), F.col("o_totalprice").cast("decimal(18,2)").alias("total")))
