"""Business tables against their plain SQL meaning on data with NULLs, repeated keys and a hot key."""

import datetime
import random
from decimal import Decimal

import pytest

from tablewright.functions.sqltext import run_sql
from tablewright.plans import business as b
from tablewright.plans.registry import comparable

DAY = datetime.date(2026, 5, 4)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    maybe = lambda value, share=0.1: None if rng.random() < share else value
    money = lambda: Decimal(rng.randrange(100000)) / 100
    hot = lambda n: 1 if rng.random() < 0.35 else rng.randrange(n)
    orders = [(maybe(i, 0.02), maybe(hot(12)), hot(5), maybe(DAY + datetime.timedelta(days=rng.randrange(70)), 0.05),
               DAY + datetime.timedelta(days=rng.randrange(90))) for i in range(150)]
    orders += orders[:10]  # repeated order rows
    lines = [(maybe(i), maybe(hot(170), 0.05), maybe(hot(20)), f"d{rng.randrange(3)}", maybe(rng.randrange(-3, 30)), money(),
              Decimal(rng.randrange(20000)) / 1000, rng.randrange(30)) for i in range(900)]
    customers = [(i, f"c{i % 7}", maybe(i % 2 == 0), money()) for i in range(10)]
    customers += customers[:3] + [(4, "other", True, None)]  # repeated and conflicting customers
    items = [(i, f"i{i}", maybe(hot(6)), maybe(rng.randrange(40)), money()) for i in range(22)] + [(3, "again", 2, 9, money())]
    holdings = [(i, maybe(rng.randrange(-2, 40)), money(), 10) for i in range(0, 22, 2)]
    moves = [(hot(25), rng.randrange(-20, 8)) for _ in range(700)]
    make = spark.createDataFrame
    return {
        "orders": make(orders, "OrderID bigint, CustomerID bigint, SalespersonPersonID bigint, OrderDate date, ExpectedDeliveryDate date"),
        "lines": make(lines, "OrderLineID bigint, OrderID bigint, StockItemID bigint, StockItemDescription string, Quantity int, "
                             "UnitPrice decimal(18,2), TaxRate decimal(18,3), PickedQuantity int"),
        "customers": make(customers, "CustomerID bigint, CustomerName string, IsOnCreditHold boolean, CreditLimit decimal(18,2)"),
        "people": make([(i, f"s{i % 2}") for i in range(4)], "PersonID bigint, SalespersonName string"),
        "items": make(items, "StockItemID bigint, StockItemName string, SupplierID bigint, LeadTimeDays int, UnitPrice decimal(18,2)"),
        "holdings": make(holdings, "StockItemID bigint, QuantityOnHand int, LastCostPrice decimal(18,2), ReorderLevel int"),
        "suppliers": make([(i, f"sup{i}", "555", 7) for i in range(8)], "SupplierID bigint, SupplierName string, PhoneNumber string, PaymentDays int"),
        "moves": make(moves, "StockItemID bigint, Quantity int"),
    }


def same(spark, rows, tables, got, sql):
    expected = comparable(run_sql(spark, sql, tables))
    got = comparable(got)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.select(*sorted(got.columns))) == rows(expected.select(*sorted(got.columns)))


NET = "l.Quantity * l.UnitPrice"
TAX = f"CAST({NET} * l.TaxRate AS DECIMAL(34,5)) * CAST(0.01 AS DECIMAL(2,2))"


def test_monthly_sales(spark, rows, tables):
    same(spark, rows, tables, b.customer_monthly_sales(tables["customers"], tables["orders"], tables["lines"]), f"""
SELECT c.CustomerID, c.CustomerName, c.IsOnCreditHold, c.CreditLimit,
       CAST(DATE_TRUNC('month', CAST(o.OrderDate AS TIMESTAMP)) AS TIMESTAMP_NTZ) AS OrderMonth,
       COUNT(DISTINCT o.OrderID) AS OrderCount, COUNT(l.OrderLineID) AS TotalOrderLines, SUM(l.Quantity) AS TotalUnits,
       ROUND(SUM({NET}), 2) AS TotalRevenue, ROUND(SUM({TAX}), 2) AS TotalTax,
       ROUND(SUM({NET}) + SUM({TAX}), 2) AS TotalRevIncTax,
       FLOOR(CAST(SUM({NET}) AS DOUBLE) / NULLIF(COUNT({NET}), 0) * 100 + 0.5) / 100 AS AvgLineValue,
       COUNT(DISTINCT l.StockItemID) AS UniqueItemsBought
FROM customers c JOIN orders o ON c.CustomerID = o.CustomerID JOIN lines l ON o.OrderID = l.OrderID
GROUP BY 1, 2, 3, 4, 5""")


def test_daily_revenue(spark, rows, tables):
    got = b.daily_revenue_summary(tables["orders"], tables["lines"], tables["customers"], tables["people"])
    same(spark, rows, tables, got, f"""
SELECT CAST(DATE_TRUNC('day', CAST(o.OrderDate AS TIMESTAMP)) AS TIMESTAMP_NTZ) AS SalesDate, c.CustomerName, p.SalespersonName,
       COUNT(DISTINCT o.OrderID) AS OrderCount, SUM(l.Quantity) AS TotalUnits, ROUND(SUM({NET}), 2) AS TotalRevenue,
       ROUND(SUM({TAX}), 2) AS TotalTax, ROUND(SUM({NET}) + SUM({TAX}), 2) AS TotalRevenueIncTax
FROM orders o JOIN lines l ON o.OrderID = l.OrderID LEFT JOIN customers c ON o.CustomerID = c.CustomerID
LEFT JOIN people p ON o.SalespersonPersonID = p.PersonID GROUP BY 1, 2, 3""")


def test_product_velocity(spark, rows, tables):
    same(spark, rows, tables, b.product_velocity(tables["lines"]), f"""
SELECT StockItemID, StockItemDescription, SUM(Quantity) AS TotalUnitsSold, COUNT(DISTINCT OrderID) AS OrderCount,
       ROUND(SUM({NET}), 2) AS TotalRevenue,
       FLOOR(CAST(SUM(UnitPrice) AS DOUBLE) / COUNT(UnitPrice) * 100 + 0.5) / 100 AS AvgUnitPrice
FROM lines l GROUP BY 1, 2""")


def test_slow_movers(spark, rows, tables):
    got = b.slow_movers(tables["items"].withColumn("IsChillerStock", tables["items"].StockItemID > 3), tables["holdings"],
                        tables["suppliers"], tables["moves"])
    same(spark, rows, tables, got, """
WITH m AS (SELECT StockItemID, COUNT(*) AS n, SUM(CASE WHEN Quantity < 0 THEN ABS(Quantity) ELSE 0 END) AS qty_out
           FROM moves GROUP BY 1)
SELECT i.StockItemID, i.StockItemName, i.SupplierID, s.SupplierName, i.StockItemID > 3 AS IsChillerStock, h.QuantityOnHand,
       h.ReorderLevel, h.LastCostPrice, ROUND(h.QuantityOnHand * h.LastCostPrice, 2) AS StockValue, COALESCE(m.n, 0) AS TxCount30Days,
       COALESCE(m.qty_out, 0) AS TotalQtyOut30Days, FLOOR(CAST(COALESCE(m.qty_out, 0) AS DOUBLE) / 30 * 100 + 0.5) / 100 AS AvgDailyMovement,
       CASE WHEN COALESCE(m.qty_out, 0) > 0 THEN CAST(FLOOR(h.QuantityOnHand * 30 / CAST(m.qty_out AS DOUBLE) + 0.5) AS DOUBLE) END AS DaysOfStock,
       CASE WHEN COALESCE(m.n, 0) = 0 THEN 'DORMANT' WHEN COALESCE(m.qty_out / 30.0, 0) < 1 THEN 'SLOW'
            WHEN COALESCE(m.qty_out / 30.0, 0) < 5 THEN 'MODERATE' ELSE 'ACTIVE' END AS MovementCategory
FROM items i LEFT JOIN holdings h ON i.StockItemID = h.StockItemID LEFT JOIN suppliers s ON i.SupplierID = s.SupplierID
LEFT JOIN m ON i.StockItemID = m.StockItemID WHERE h.QuantityOnHand > 0""")
    categories = {row["MovementCategory"] for row in got.collect()}
    assert len(categories) > 1


def test_supplier_performance(spark, rows, tables):
    same(spark, rows, tables, b.supplier_performance(tables["suppliers"], tables["items"], tables["moves"]), """
WITH m AS (SELECT i.SupplierID, COUNT(*) AS n, SUM(CASE WHEN x.Quantity > 0 THEN x.Quantity ELSE 0 END) AS qty_in,
                  SUM(CASE WHEN x.Quantity < 0 THEN ABS(x.Quantity) ELSE 0 END) AS qty_out
           FROM moves x JOIN items i ON x.StockItemID = i.StockItemID GROUP BY 1)
SELECT s.SupplierID, s.SupplierName, s.PhoneNumber, s.PaymentDays,
       FLOOR(AVG(CAST(i.LeadTimeDays AS DOUBLE)) * 10 + 0.5) / 10 AS AvgLeadTimeDays,
       COUNT(DISTINCT i.StockItemID) AS UniqueItemsStocked, COALESCE(m.n, 0) AS TotalTransactions30Days,
       COALESCE(m.qty_in, 0) AS TotalUnitsReceived30Days, COALESCE(m.qty_out, 0) AS TotalUnitsReturned30Days,
       CASE WHEN COALESCE(m.qty_in, 0) > 0 THEN FLOOR(CAST(m.qty_out AS DOUBLE) * 100 / m.qty_in * 100 + 0.5) / 100 ELSE 0.0D END AS ReturnRatePct
FROM suppliers s LEFT JOIN items i ON s.SupplierID = i.SupplierID LEFT JOIN m ON s.SupplierID = m.SupplierID
GROUP BY s.SupplierID, s.SupplierName, s.PhoneNumber, s.PaymentDays, m.n, m.qty_in, m.qty_out""")


def test_valuation_without_holding_is_normal(spark, tables):
    holdings = tables["holdings"].selectExpr("*", "'b' AS BinLocation", "1 AS LastStocktakeQuantity", "30 AS TargetStockLevel")
    items = tables["items"].selectExpr("*", "UnitPrice AS RecommendedRetailPrice", "TRUE AS IsChillerStock", "'x' AS Brand", "'y' AS Size",
                                       "CAST(15 AS DECIMAL(18,3)) AS TaxRate")
    got = b.inventory_valuation(items, holdings, tables["suppliers"])
    assert {r["StockStatus"] for r in got.where("QuantityOnHand IS NULL").collect()} == {"NORMAL"}
    assert got.where("QuantityOnHand <= 0 AND StockStatus <> 'OUT_OF_STOCK'").count() == 0


def test_tier_bands(spark, rows):
    orders = spark.createDataFrame([(1, 1, DAY, 10000.5, "OPEN"), (2, 9, DAY, 1000.0, "OPEN"), (3, 1, DAY, 1000.5, "CANCELLED"), (4, 1, DAY, 5000.0, None)],
                                   "order_id int, customer_id int, order_date date, total_amount double, status string")
    customers = spark.createDataFrame([(1, "n", "r")], "customer_id int, customer_name string, region string")
    got = b.order_tier(orders, customers).select("order_id", "customer_name", "order_tier")
    assert rows(got) == [(1, "n", "high"), (2, None, "low")]
