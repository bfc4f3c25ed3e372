"""The nine business tables and the four small report queries.

Every aggregate runs before the join that would repeat its rows, so a customer,
item or supplier that holds a large share of the data is reduced on the map side
and only its partial sums are shuffled. No side is hinted for broadcast: Spark
broadcasts a dimension when its size allows and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numeric import half_up, hundredth, mean_of, money, no_null
from tablewright.operators.distinct import distinct_count, group_with_distinct, join_groups


def order_header(orders: DataFrame, customers: DataFrame, salespeople: DataFrame) -> DataFrame:
    """Orders with customer and salesperson attributes and the promised lead time in days."""
    people = salespeople.select(F.col("PersonID").alias("SalespersonPersonID"), "SalespersonName")
    customer_columns = ["CustomerName", "IsOnCreditHold", "CreditLimit", "StandardDiscountPercentage"]
    lead = F.datediff(F.expr("try_cast(ExpectedDeliveryDate AS DATE)"), F.expr("try_cast(OrderDate AS DATE)"))
    return (
        orders.join(customers.select("CustomerID", *customer_columns), "CustomerID", "left")
        .join(people, "SalespersonPersonID", "left")
        .select(
            "OrderID", "CustomerID", *customer_columns, "SalespersonPersonID", "SalespersonName",
            "OrderDate", "ExpectedDeliveryDate", "CustomerPurchaseOrderNumber",
            "IsUndersupplyBackordered", "Comments", lead.alias("PromisedLeadDays"),
        )
    )


def order_lines_detail(lines: DataFrame) -> DataFrame:
    """Line amounts, tax, open quantity and picking state; a map-only plan."""
    net = F.col("Quantity") * F.col("UnitPrice")
    tax = hundredth(net * F.col("TaxRate"))
    picked, wanted = F.col("PickedQuantity"), F.col("Quantity")
    return lines.select(
        "OrderLineID", "OrderID", "StockItemID", F.col("Description").alias("StockItemDescription"),
        "Quantity", "UnitPrice", "TaxRate",
        money(net).alias("LineTotal"),
        money(tax).alias("TaxAmount"),
        money(net + tax).alias("LineTotalIncTax"),
        "PickedQuantity", (wanted - picked).alias("OutstandingQty"),
        F.when(picked >= wanted, "FULLY_PICKED").when(picked > 0, "PARTIALLY_PICKED")
        .otherwise("NOT_PICKED").alias("PickingStatus"),
        "PickingCompletedWhen",
    )


_LINE_TOTALS = ("n_lines", "units", "net", "n_net", "net_rate")


def _per_order(lines: DataFrame) -> DataFrame:
    """Line totals of each order: an order with very many lines is one row per map task in the shuffle."""
    net = F.col("Quantity") * F.col("UnitPrice")
    totals = (
        F.count("OrderLineID"), F.sum("Quantity"), F.sum(net), F.count(net), F.sum(net * F.col("TaxRate"))
    )
    return lines.groupBy("OrderID").agg(*[t.alias(n) for t, n in zip(totals, _LINE_TOTALS, strict=True)])


def customer_monthly_sales(customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Sales per customer and month.

    Lines shrink to one row per order before they meet the orders; grouping by
    order there needs no further shuffle and makes the distinct orders a plain
    count. Distinct items take a second, two-column read of the lines. The customer
    table is joined last, to one row per customer and month, so no shuffle ever
    brings all lines of one customer together. Its rows are grouped first and their
    multiplicity scales the sums, which keeps the result equal to joining first even
    if a customer row is repeated.
    """
    heads = orders.where(F.col("CustomerID").isNotNull()).select(
        "OrderID", "CustomerID", F.date_trunc("month", "OrderDate").alias("OrderMonth")
    )
    keys = ["CustomerID", "OrderMonth"]
    order_totals = (
        heads.join(_per_order(lines), "OrderID")
        .groupBy("OrderID", *keys).agg(*[F.sum(c).alias(c) for c in _LINE_TOTALS])
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("OrderCount"), *[F.sum(c).alias(c) for c in _LINE_TOTALS])
    )
    bought = heads.join(lines.select("OrderID", "StockItemID"), "OrderID")
    monthly = join_groups(order_totals, distinct_count(bought, keys, "StockItemID", "UniqueItemsBought"), keys)
    named = customers.groupBy("CustomerID", "CustomerName", "IsOnCreditHold", "CreditLimit").agg(
        F.count(F.lit(1)).alias("copies")
    )
    net, tax, copies = F.col("net"), hundredth(F.col("net_rate")), F.col("copies")
    return monthly.join(named, "CustomerID").select(
        "CustomerID", "CustomerName", "IsOnCreditHold", "CreditLimit",
        F.col("OrderMonth").cast("timestamp_ntz").alias("OrderMonth"),
        "OrderCount", (F.col("n_lines") * copies).alias("TotalOrderLines"),
        (F.col("units") * copies).alias("TotalUnits"),
        money(net * copies).alias("TotalRevenue"),
        money(tax * copies).alias("TotalTax"),
        money((net + tax) * copies).alias("TotalRevIncTax"),
        mean_of(net, F.col("n_net")).alias("AvgLineValue"),
        "UniqueItemsBought",
    )


def inventory_valuation(items: DataFrame, holdings: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Stock value at cost, retail and sale price, gap to target and stock state.

    An item without a holding compares as NULL everywhere and so counts as NORMAL.
    """
    on_hand = F.col("QuantityOnHand")
    return (
        items.join(holdings, "StockItemID", "left")
        .join(suppliers.select("SupplierID", "SupplierName"), "SupplierID", "left")
        .select(
            "StockItemID", "StockItemName", "SupplierID", "SupplierName",
            F.col("UnitPrice").alias("CurrentSalePrice"), "RecommendedRetailPrice", "TaxRate",
            "LeadTimeDays", "IsChillerStock", "Brand", "Size", "QuantityOnHand", "BinLocation",
            "LastCostPrice", "LastStocktakeQuantity", "ReorderLevel", "TargetStockLevel",
            money(on_hand * F.col("LastCostPrice")).alias("StockCostValue"),
            money(on_hand * F.col("RecommendedRetailPrice")).alias("StockRetailValue"),
            money(on_hand * F.col("UnitPrice")).alias("StockSaleValue"),
            (F.col("TargetStockLevel") - on_hand).alias("StockGap"),
            F.when(on_hand <= 0, "OUT_OF_STOCK").when(on_hand <= F.col("ReorderLevel"), "BELOW_REORDER")
            .when(on_hand >= F.col("TargetStockLevel"), "AT_TARGET").otherwise("NORMAL").alias("StockStatus"),
        )
    )


def _movements(transactions: DataFrame) -> DataFrame:
    """Per item: transactions, units in and units out."""
    qty = F.expr("try_cast(Quantity AS BIGINT)")
    return transactions.groupBy("StockItemID").agg(
        F.count(F.lit(1)).alias("tx"),
        F.sum(F.when(qty > 0, qty).otherwise(0)).alias("units_in"),
        F.sum(F.when(qty < 0, F.abs(qty)).otherwise(0)).alias("units_out"),
    )


def slow_movers(
    items: DataFrame, holdings: DataFrame, suppliers: DataFrame, transactions: DataFrame, days: int = 30
) -> DataFrame:
    """Items in stock with their movement over the extracted window and a movement band."""
    out, tx, on_hand = no_null(F.col("units_out")), no_null(F.col("tx")), F.col("QuantityOnHand")
    daily = out.cast("double") / float(days)
    return (
        items.join(holdings.where(on_hand > 0), "StockItemID")
        .join(suppliers.select("SupplierID", "SupplierName"), "SupplierID", "left")
        .join(_movements(transactions), "StockItemID", "left")
        .select(
            "StockItemID", "StockItemName", "SupplierID", "SupplierName", "IsChillerStock",
            "QuantityOnHand", "ReorderLevel", "LastCostPrice",
            money(on_hand * F.col("LastCostPrice")).alias("StockValue"),
            tx.alias("TxCount30Days"), out.alias("TotalQtyOut30Days"),
            half_up(daily, 2).alias("AvgDailyMovement"),
            F.when(out > 0, half_up(on_hand * F.lit(float(days)) / out.cast("double"), 0)).alias("DaysOfStock"),
            F.when(tx == 0, "DORMANT").when(out < days, "SLOW").when(out < 5 * days, "MODERATE")
            .otherwise("ACTIVE").alias("MovementCategory"),
        )
    )


def supplier_performance(suppliers: DataFrame, items: DataFrame, transactions: DataFrame) -> DataFrame:
    """Lead time, items stocked and return rate per supplier.

    Transactions shrink to one row per item and items to one row per supplier
    before anything is joined, so a supplier with a third of all stock costs one
    partial row per task.
    """
    stock = items.groupBy("SupplierID").agg(
        F.sum(F.col("LeadTimeDays").cast("double")).alias("lead_sum"),
        F.count("LeadTimeDays").alias("lead_n"),
        F.count_distinct("StockItemID").alias("n_items"),
    )
    moved = (
        _movements(transactions).join(items.select("StockItemID", "SupplierID"), "StockItemID")
        .groupBy("SupplierID")
        .agg(F.sum("tx").alias("tx"), F.sum("units_in").alias("received"), F.sum("units_out").alias("returned"))
    )
    received, returned = no_null(F.col("received")), no_null(F.col("returned"))
    return (
        suppliers.select("SupplierID", "SupplierName", "PhoneNumber", "PaymentDays").distinct()
        .join(stock, "SupplierID", "left")
        .join(moved, "SupplierID", "left")
        .select(
            "SupplierID", "SupplierName", "PhoneNumber", "PaymentDays",
            mean_of(F.col("lead_sum"), F.col("lead_n"), 1).alias("AvgLeadTimeDays"),
            no_null(F.col("n_items")).alias("UniqueItemsStocked"),
            no_null(F.col("tx")).alias("TotalTransactions30Days"),
            received.alias("TotalUnitsReceived30Days"), returned.alias("TotalUnitsReturned30Days"),
            F.when(received > 0, half_up(returned.cast("double") * 100.0 / received, 2))
            .otherwise(F.lit(0.0)).alias("ReturnRatePct"),
        )
    )


def daily_revenue_summary(
    headers: DataFrame, details: DataFrame, customers: DataFrame, salespeople: DataFrame
) -> DataFrame:
    """Revenue by day, customer name and salesperson name.

    Lines shrink to one row per order before they meet the headers, and the final
    count of distinct orders is spread over tasks by order, so a day or name with
    many orders is never held by one task.
    """
    details = details.select(F.lit(1).alias("OrderLineID"), "OrderID", "Quantity", "UnitPrice", "TaxRate")
    per_order = headers.select(
        "OrderID", "CustomerID", "SalespersonPersonID", F.date_trunc("day", "OrderDate").alias("SalesDate")
    ).join(_per_order(details), "OrderID")
    tax = hundredth(F.col("net_rate"))
    people = salespeople.select(F.col("PersonID").alias("SalespersonPersonID"), "SalespersonName")
    return (
        per_order.join(customers.select("CustomerID", "CustomerName"), "CustomerID", "left")
        .join(people, "SalespersonPersonID", "left")
        .groupBy("SalesDate", "CustomerName", "SalespersonName")
        .agg(
            F.count_distinct("OrderID").alias("OrderCount"), F.sum("units").alias("TotalUnits"),
            F.sum("net").alias("net"), F.sum("net_rate").alias("net_rate"),
        )
        .select(
            F.col("SalesDate").cast("timestamp_ntz").alias("SalesDate"), "CustomerName", "SalespersonName",
            "OrderCount", "TotalUnits", money(F.col("net")).alias("TotalRevenue"),
            money(tax).alias("TotalTax"), money(F.col("net") + tax).alias("TotalRevenueIncTax"),
        )
    )


def product_velocity(details: DataFrame) -> DataFrame:
    """Units, orders, revenue and mean price per item, best sellers first."""
    totals = [
        F.sum("Quantity").alias("TotalUnitsSold"),
        money(F.sum(F.col("Quantity") * F.col("UnitPrice"))).alias("TotalRevenue"),
        mean_of(F.sum("UnitPrice"), F.count("UnitPrice")).alias("AvgUnitPrice"),
    ]
    grouped = group_with_distinct(details, ["StockItemID", "StockItemDescription"], totals, {"OrderCount": "OrderID"})
    return grouped.orderBy(F.desc("TotalUnitsSold"), "StockItemID")


def limited_projection(items: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` items by key with a constant status column."""
    return (
        items.select("StockItemID", "StockItemName", "SupplierID", F.lit("success").alias("status"))
        .orderBy("StockItemID").limit(n)
    )


def order_tier(orders: DataFrame, customers: DataFrame, high: float = 10000, medium: float = 1000) -> DataFrame:
    """Orders that are not cancelled, with customer columns and a band by amount."""
    amount = F.col("total_amount")
    return (
        orders.where(F.col("status") != "CANCELLED").join(customers, "customer_id", "left")
        .select(
            "order_id", "order_date", "total_amount", "customer_name", "region",
            F.when(amount > high, "high").when(amount > medium, "medium").otherwise("low").alias("order_tier"),
        )
    )


def category_totals(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Amount per order and product category; amounts shrink per order and product first."""
    return (
        orders.groupBy("order_id", "product_id").agg(F.sum("amount").alias("amount"))
        .join(products, "product_id")
        .groupBy("order_id", "category").agg(F.sum("amount").alias("total"))
    )


def customer_order_summary(orders: DataFrame) -> DataFrame:
    """Orders and amount per customer."""
    return orders.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("OrderTotal").alias("total")
    )


def running_total_by_key(rows: DataFrame) -> DataFrame:
    """Total per customer over one upstream table."""
    return rows.groupBy("CustomerID").agg(F.sum("total").alias("total"))
