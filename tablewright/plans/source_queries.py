"""Extracts, file and message ingest over the mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.sqltext import render, run_sql
from tablewright.functions.types import schema_names
from tablewright.operators.transform import routine, transform
from tablewright.plans import business as b
from tablewright.plans.dataflow import run_pipeline
from tablewright.plans.mapping import AS_OF_ORDERS, DS
from tablewright.plans.registry import query
from tablewright.session import scratch_path
from tablewright.sinks.store import TableStore
from tablewright.sinks.targets import write_files
from tablewright.sources import files, messages, windows
from tablewright.sources.artifacts import Artifacts
from tablewright.sources.jdbc import chunk_bounds, chunk_predicates

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query("extract_query", f"""
SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= '{DS}'""")
def extract_query(t):
    sql = "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= '{{ ds }}'"
    return run_sql(t.spark, render(sql, DS), {"orders": t.orders})


@query("extract_table", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def extract_table(t):
    return run_sql(t.spark, "SELECT * FROM nation", {"nation": t.nation})


@query("extract_in_ranges", """
SELECT o_orderkey, o_orderdate, o_orderpriority, o_totalprice FROM orders""")
def extract_in_ranges(t):
    """Config extracts in ranges of a text column with few values, of a date and of a number: every row once in each."""
    source = {"connection": "shop", "query": "SELECT o_orderkey, o_orderdate, o_orderpriority, o_totalprice FROM orders", "num_partitions": 7}
    ranges = (("o_orderpriority", "quantile"), ("o_orderdate", "range"), ("o_totalprice", "quantile"))
    tasks = [{"task_id": column, "type": "sql_extract", "source": {**source, "partition_column": column, "partition_by": how}} for column, how in ranges]
    root = scratch_path(t.spark, "pipeline")
    run = run_pipeline(t.spark, {"pipeline_id": "ranges", "tasks": tasks}, Artifacts(t.spark, f"{root}/artifacts"), TableStore(t.spark, f"{root}/targets"),
                       {"shop": {"orders": t.orders}}, ds=DS, run_id="run_1")
    whole = [run.output(column).where(F.pmod("o_orderkey", F.lit(len(ranges))) == i) for i, (column, _) in enumerate(ranges)]
    return whole[0].unionByName(whole[1]).unionByName(whole[2])


@query("extract_chunked", """
WITH b AS (SELECT MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, (MAX(o_orderkey) - MIN(o_orderkey) + 16) // 16 AS step FROM orders)
SELECT (o_orderkey - lo) // step AS chunk, COUNT(*) AS n_rows, MIN(o_orderkey) AS low_key, MAX(o_orderkey) AS high_key
FROM orders CROSS JOIN b GROUP BY 1""")
def extract_chunked(t):
    """Row and key ranges of 16 chunks: together they cover the table once."""
    orders = t.orders.select("o_orderkey")
    ranges = chunk_predicates("o_orderkey", *chunk_bounds(orders, "o_orderkey"), 16)
    chunk = F.coalesce(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(ranges)])
    return orders.groupBy(chunk.cast("bigint").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("low_key"), F.max("o_orderkey").alias("high_key"))


@query("extract_empty_typed", """
SELECT column_name AS "column", CASE column_type WHEN 'INTEGER' THEN 'INTEGER' ELSE column_type END AS type,
       (SELECT COUNT(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1900-01-01') AS n_rows
FROM (DESCRIBE SELECT * FROM lineitem)""")
def extract_empty_typed(t):
    """An extract with no rows, written and read back, still has its column types."""
    path = scratch_path(t.spark, "empty")
    t.lineitem.where(F.col("l_shipdate") < F.lit("1900-01-01").cast("timestamp_ntz")).write.parquet(path)
    back = t.spark.read.parquet(path)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("type")) for c, k in schema_names(back).items()]
    return back.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(F.array(*cells)).alias("c")).select(
        "c.column", "c.type", "n_rows")


@query("extract_day_window", f"""
SELECT OrderID, CustomerID, OrderDate FROM raw_orders
WHERE OrderDate >= DATE '{DS}' - 1 AND OrderDate < DATE '{DS}'""")
def extract_day_window(t):
    return windows.day_window(t.raw_orders, "OrderDate", DS).select("OrderID", "CustomerID", "OrderDate")


@query("extract_child_by_parent_window", f"""
SELECT l.OrderLineID, l.OrderID, l.StockItemID, CAST(l.Quantity AS BIGINT) AS Quantity, CAST(l.UnitPrice AS DOUBLE) AS UnitPrice
FROM raw_order_lines l JOIN raw_orders o ON l.OrderID = o.OrderID
WHERE o.OrderDate >= DATE '{DS}' - 1 AND o.OrderDate < DATE '{DS}'""")
def extract_child_by_parent_window(t):
    lines = t.raw_order_lines.select("OrderLineID", "OrderID", "StockItemID", "Quantity", "UnitPrice")
    return windows.child_by_parent_window(lines, t.raw_orders, "OrderID", "OrderDate", DS)


@query("extract_rolling_window", f"""
SELECT StockItemTransactionID, StockItemID, TransactionOccurredWhen, CAST(Quantity AS BIGINT) AS Quantity
FROM raw_stock_transactions WHERE TransactionOccurredWhen >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL '30' DAY""")
def extract_rolling_window(t):
    as_of = F.lit(AS_OF_ORDERS).cast("timestamp_ntz")
    return windows.rolling_window(t.raw_stock_transactions, "TransactionOccurredWhen", as_of).select(
        "StockItemTransactionID", "StockItemID", "TransactionOccurredWhen", "Quantity")


@query("extract_current_version", f"""
SELECT CustomerID, CustomerName, IsOnCreditHold, ValidTo FROM customers WHERE ValidTo = '{windows.OPEN_END}'""")
def extract_current_version(t):
    return windows.current_version(t.customers).select("CustomerID", "CustomerName", "IsOnCreditHold", "ValidTo")


@query("extract_flagged_projection", f"""
SELECT PersonID, FullName AS SalespersonName FROM people WHERE IsSalesperson AND ValidTo = '{windows.OPEN_END}'""")
def extract_flagged_projection(t):
    return windows.flagged_projection(t.people, "IsSalesperson", {"PersonID": "PersonID", "SalespersonName": "FullName"})


@query("extract_full_projection", """
SELECT StockItemID, CAST(QuantityOnHand AS BIGINT) AS QuantityOnHand, BinLocation FROM raw_stock_holdings""")
def extract_full_projection(t):
    return windows.full_projection(t.raw_stock_holdings, ["StockItemID", "QuantityOnHand", "BinLocation"])


@query("extract_incremental", """
SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 1 ELSE 2 END::BIGINT AS batch FROM orders""")
def extract_incremental(t):
    """Two runs: the second sees the grown table and takes only rows past the stored mark."""
    state, out = scratch_path(t.spark, "mark"), scratch_path(t.spark, "increments")
    columns = t.orders.select("o_orderkey", "o_orderdate")
    early = columns.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    for batch, source in enumerate((early, columns), start=1):
        step = windows.Increment(t.spark, state, "o_orderdate")
        step.rows(source).write.parquet(f"{out}/batch={batch}")
        step.commit()
    return t.spark.read.parquet(out)


@query("cdc_extract", """
SELECT c.OrderID, c.SeqNo::BIGINT AS SeqNo, c.operation::BIGINT AS operation, c.ChangedAt, o.CustomerID, o.OrderDate
FROM order_changes c JOIN raw_orders o ON c.OrderID = o.OrderID WHERE c.operation IN (2, 4)""")
def cdc_extract(t):
    changes = t.order_changes.select("OrderID", "SeqNo", "operation", "ChangedAt")
    return windows.cdc_extract(changes, t.raw_orders.select("OrderID", "CustomerID", "OrderDate"), "OrderID")


CDC_SQL = """
WITH latest AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY OrderID ORDER BY ChangedAt DESC, SeqNo DESC, StockItemID DESC,
                                              operation DESC, Quantity DESC) AS rn
                 FROM order_changes WHERE operation <> 3) r WHERE rn = 1),
base AS (SELECT OrderID, CAST(0 AS BIGINT) AS Quantity, CustomerPurchaseOrderNumber AS Priority FROM raw_orders
         WHERE OrderDate < DATE '1999-01-01')
SELECT b.OrderID, CASE WHEN l.OrderID IS NULL THEN b.Quantity ELSE l.Quantity END AS Quantity, b.Priority
FROM base b LEFT JOIN latest l ON b.OrderID = l.OrderID WHERE l.operation IS NULL OR l.operation <> 1
UNION ALL
SELECT l.OrderID, l.Quantity, NULL AS Priority FROM latest l
WHERE l.operation <> 1 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.OrderID = l.OrderID)"""


def _cdc_base(t):
    return t.raw_orders.where(F.col("OrderDate") < F.lit("1999-01-01").cast("date")).select(
        "OrderID", F.lit(0).cast("bigint").alias("Quantity"), F.col("CustomerPurchaseOrderNumber").alias("Priority"))


CDC_ORDER = ["ChangedAt", "SeqNo", "StockItemID", "operation", "Quantity"]


@query("cdc_apply", CDC_SQL)
def cdc_apply(t):
    return windows.cdc_apply(_cdc_base(t), t.order_changes, ["OrderID"], CDC_ORDER)


@query("cdc_apply_table", CDC_SQL)
def cdc_apply_table(t):
    """The same changes applied to a stored table, in two batches of different orders.

    Batches by time would differ where an order is deleted and added again: the table then has a new row.
    """
    store = TableStore(t.spark, scratch_path(t.spark, "store"))
    store.merge("orders", _cdc_base(t), ["OrderID"])
    for odd in (0, 1):
        windows.cdc_apply_to(store, "orders", t.order_changes.where(F.pmod("OrderID", F.lit(2)) == odd), ["OrderID"], CDC_ORDER)
    return store.read("orders")


def _round_trip(t, kind: str, source: dict, sep: str | None = None):
    path = scratch_path(t.spark, f"ingest-{kind}")
    write_files(t.orders, kind, path, sep=sep)
    return files.ingest(t.spark, {"path": path, "format": kind, **source})


_ORDER_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                 "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")


@query("ingest_csv", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def ingest_csv(t):
    """Types inferred, custom delimiter, column choice."""
    return _round_trip(t, "csv", {"delimiter": "|", "read_options": {
        "usecols": ["o_orderkey", "o_totalprice", "o_orderpriority"], "dtype": {"o_orderkey": "bigint"}}}, sep="|")


@query("ingest_tsv", _ORDERS)
def ingest_tsv(t):
    return _round_trip(t, "tsv", {"delimiter": ";", "schema": _ORDER_SCHEMA})


@query("ingest_parquet", _ORDERS)
def ingest_parquet(t):
    return _round_trip(t, "parquet", {})


@query("ingest_jsonl", _ORDERS)
def ingest_jsonl(t):
    return _round_trip(t, "jsonl", {"schema": _ORDER_SCHEMA})


@query("ingest_format_guard", "SELECT 'Unsupported file format: avro' AS message, COUNT(*) AS n_rows FROM orders")
def ingest_format_guard(t):
    """An unknown format is refused before anything is read; CSV is the default."""
    path = scratch_path(t.spark, "guard")
    write_files(t.orders.select("o_orderkey"), "csv", path)
    try:
        files.ingest(t.spark, {"path": path, "format": "avro"})
        message = "accepted"
    except ValueError as error:
        message = str(error)
    return files.ingest(t.spark, {"s3_path": path}).agg(F.count("o_orderkey").alias("n_rows")).withColumn("message", F.lit(message))


@query("consume_json_messages", """
SELECT event_id AS id, event_type AS event, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events
WHERE event_type <> 'error'""")
def consume_json_messages(t):
    """Typed rows of a topic in which every message is JSON; the schema is found from the messages."""
    topic = t.messages.where(F.col("topic") == "events")
    rows = messages.decode_json(topic, value="message_value")
    return rows.select(F.col("id").cast("bigint").alias("id"), "event", F.col("props.k").cast("bigint").alias("k"))


@query("consume_json_or_raw", """
SELECT CASE WHEN event_type <> 'error' THEN event_id END AS id, CASE WHEN event_type <> 'error' THEN event_type END AS event,
       CASE WHEN event_type = 'error' THEN message_value END AS raw
FROM messages m JOIN events e ON m.message_offset = e.event_id""")
def consume_json_or_raw(t):
    rows = messages.decode_json_or_raw(t.messages, "id BIGINT, event STRING, props STRUCT<k: BIGINT>", "message_value")
    return rows.select("id", "event", "raw")


@query("scan_artifact", "SELECT OrderID, CustomerID, OrderDate FROM raw_orders")
def scan_artifact(t):
    """A task output found again by pipeline, run and task."""
    store = Artifacts(t.spark, scratch_path(t.spark, "artifacts"))
    store.write(t.raw_orders.select("OrderID", "CustomerID", "OrderDate"), "sales", "run_1", "extract-orders", "raw_orders")
    return store.scan("sales", "run_1", "extract-orders", "raw_orders")


@query("scan_explicit_artifact", """
SELECT CustomerID, COUNT(*) AS n_orders, MAX(OrderDate) AS last_order FROM raw_orders GROUP BY 1""")
def scan_explicit_artifact(t):
    store = Artifacts(t.spark, scratch_path(t.spark, "artifacts"))
    written = store.write(t.raw_orders.select("OrderID", "CustomerID", "OrderDate"), "other", "run_9", "extract", "raw_orders")
    return transform(
        t.spark, "SELECT CustomerID, COUNT(*) AS n_orders, MAX(OrderDate) AS last_order FROM _explicit.raw_orders GROUP BY 1",
        {}, explicit={"raw_orders": store.scan_path(written.path)})


@query("routine_resultset", """
SELECT OrderDate, COUNT(*) AS Orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS TotalSales
FROM raw_orders r JOIN orders o ON r.OrderID = o.o_orderkey WHERE OrderDate <= DATE '2000-12-31' GROUP BY 1""")
def routine_resultset(t):
    """A parameterised daily summary; its OUT value is the number of rows returned."""
    result, _ = routine(
        t.spark,
        "SELECT CAST(o_orderdate AS DATE) AS OrderDate, COUNT(*) AS Orders, "
        "SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS TotalSales FROM orders "
        "WHERE CAST(o_orderdate AS DATE) <= CAST(:ProcessDate AS DATE) GROUP BY 1",
        {"orders": t.orders}, {"ProcessDate": "2000-12-31"}, {"RowsInserted": F.count(F.lit(1))})
    return result


# ---- SQL transforms ----------------------------------------------------------

_TRANSFORM = """
SELECT o.SalespersonPersonID AS person, c.IsOnCreditHold AS held, COUNT(l.OrderLineID) AS n_lines,
       CAST(SUM(l.Quantity) AS BIGINT) AS units, CAST(SUM(l.UnitPrice) AS DOUBLE) AS prices,
       DATEDIFF('day', MIN(o.OrderDate), MAX(o.OrderDate)) AS span_days
FROM extract_orders.raw_orders o
JOIN extract_customers.raw_customers c ON c.CustomerID = o.CustomerID
JOIN extract_lines.raw_order_lines l ON o.OrderID = l.OrderID
GROUP BY ALL"""
_PLAIN = _TRANSFORM.replace("extract_orders.", "").replace("extract_customers.", "").replace("extract_lines.", "")


@query("sql_transform", _PLAIN)
def sql_transform(t):
    """User SQL over three upstream tasks; ``extract-orders`` is named ``extract_orders`` in it."""
    return transform(t.spark, _TRANSFORM, {
        "extract-customers": {"raw_customers": t.raw_customers},
        "extract-orders": {"raw_orders": t.raw_orders},
        "extract/lines": {"raw_order_lines": t.raw_order_lines}})


@query("sql_template", f"""
SELECT OrderID, DATEDIFF('day', OrderDate, DATE '{DS}') AS age_days, 'run_001' AS run_id
FROM raw_orders WHERE OrderDate < DATE '{DS}'""")
def sql_template(t):
    return transform(
        t.spark,
        "SELECT OrderID, DATEDIFF('day', OrderDate, CAST('{{ ds }}' AS DATE)) AS age_days, '{{run_id}}' AS run_id "
        "FROM x.raw_orders WHERE OrderDate < CAST('{{ds}}' AS DATE)",
        {"x": {"raw_orders": t.raw_orders}}, ds=DS, run_id="run_001")


@query("output_stats", """
SELECT 'order_lines_detail' AS output_table, COUNT(*) AS row_count, 'DECIMAL(18,2)' AS unit_price_type, TRUE AS has_bytes
FROM raw_order_lines""")
def output_stats(t):
    """Rows, types and bytes of a written output; the rows are counted by the write itself."""
    store = Artifacts(t.spark, scratch_path(t.spark, "artifacts"))
    stats = store.write(b.order_lines_detail(t.raw_order_lines), "sales", "run_1", "lines", "order_lines_detail")
    row = [("order_lines_detail", stats.rows, stats.schema["UnitPrice"], stats.size_bytes > 0)]
    return t.spark.createDataFrame(row, "output_table string, row_count bigint, unit_price_type string, has_bytes boolean")
