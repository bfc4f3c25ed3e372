"""Source tables of the pipelines, read from the benchmark's tables.

Each view is one SQL text used twice: by Spark for the inputs of an operator and
by the SQL check as a leading ``WITH``, so that only the operator differs.
``@name`` is a base table, ``@SEQ(a, b)`` one row per whole number from a to b.
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

AS_OF_ORDERS = "2001-08-01 00:00:00"
AS_OF_RUNS = "2024-01-30 12:00:00"
DS = "1998-06-15"

VIEWS: dict[str, str] = {}

# ---- business tables ---------------------------------------------------------

VIEWS["raw_orders"] = """
SELECT o_orderkey AS OrderID, o_custkey AS CustomerID, o_custkey % 10 AS SalespersonPersonID,
       CAST(o_orderdate AS DATE) AS OrderDate,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 AS INT) AS ExpectedDeliveryDate,
       o_orderpriority AS CustomerPurchaseOrderNumber, o_orderstatus = 'P' AS IsUndersupplyBackordered,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'call first' END AS Comments,
       o_orderdate AS LastEditedWhen
FROM @orders"""

VIEWS["raw_order_lines"] = """
SELECT l_orderkey * 10 + l_linenumber AS OrderLineID, l_orderkey AS OrderID, l_partkey AS StockItemID,
       concat('Item ', CAST(l_partkey AS STRING)) AS Description, CAST(l_quantity AS INT) AS Quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS UnitPrice, CAST(l_tax * 100 AS DECIMAL(18,3)) AS TaxRate,
       CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity WHEN l_returnflag = 'R' THEN l_quantity - 1
                 ELSE 0 END AS INT) AS PickedQuantity,
       CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS PickingCompletedWhen
FROM @lineitem"""

VIEWS["customers"] = """
SELECT c_custkey AS CustomerID, c_name AS CustomerName, c_acctbal < 0 AS IsOnCreditHold,
       CAST(c_acctbal AS DECIMAL(18,2)) AS CreditLimit,
       CAST(c_custkey % 5 AS DECIMAL(18,3)) AS StandardDiscountPercentage,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '2020-01-01 00:00:00'
            ELSE '9999-12-31 23:59:59.9999999' END AS ValidTo
FROM @customer"""

VIEWS["raw_customers"] = """
SELECT c_custkey AS CustomerID, c_name AS CustomerName, c_acctbal < 0 AS IsOnCreditHold,
       CAST(c_acctbal AS DECIMAL(18,2)) AS CreditLimit,
       CAST(c_custkey % 5 AS DECIMAL(18,3)) AS StandardDiscountPercentage
FROM @customer WHERE c_mktsegment <> 'HOUSEHOLD'"""

VIEWS["people"] = """
SELECT s_suppkey AS PersonID, s_name AS FullName, s_acctbal > 1000 AS IsSalesperson,
       CASE WHEN s_nationkey = 3 THEN '2020-01-01 00:00:00'
            ELSE '9999-12-31 23:59:59.9999999' END AS ValidTo
FROM @supplier"""

VIEWS["raw_salespeople"] = """
SELECT s_suppkey AS PersonID, s_name AS SalespersonName FROM @supplier WHERE s_acctbal > 1000"""

VIEWS["raw_stock_items"] = """
SELECT p_partkey AS StockItemID, p_name AS StockItemName, p_partkey % 100 AS SupplierID,
       CAST(p_retailprice AS DECIMAL(18,2)) AS UnitPrice,
       CAST(p_retailprice AS DECIMAL(18,2)) + 10 AS RecommendedRetailPrice,
       CAST(15 AS DECIMAL(18,3)) AS TaxRate, p_size AS LeadTimeDays, p_type = 'PROMO' AS IsChillerStock,
       p_brand AS Brand, p_type AS Size
FROM @part"""

VIEWS["raw_stock_holdings"] = """
SELECT p_partkey AS StockItemID, CAST(p_partkey % 40 AS INT) - 2 AS QuantityOnHand,
       concat('L-', p_brand) AS BinLocation, CAST(p_partkey % 40 AS INT) AS LastStocktakeQuantity,
       CAST(p_retailprice AS DECIMAL(18,2)) AS LastCostPrice, 10 AS ReorderLevel, 30 AS TargetStockLevel
FROM @part WHERE p_type <> 'ECONOMY'"""

VIEWS["raw_suppliers"] = """
SELECT s_suppkey AS SupplierID, s_name AS SupplierName, concat('555-', CAST(s_suppkey AS STRING)) AS PhoneNumber,
       CAST(s_suppkey % 30 AS INT) AS PaymentDays
FROM @supplier"""

VIEWS["raw_stock_transactions"] = """
SELECT l_orderkey * 10 + l_linenumber AS StockItemTransactionID, l_partkey AS StockItemID, l_suppkey AS SupplierID,
       l_shipdate AS TransactionOccurredWhen,
       CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS INT) AS Quantity
FROM @lineitem"""

# change rows: 1 delete, 2 insert, 3 before update, 4 after update
VIEWS["order_changes"] = """
SELECT l_orderkey AS OrderID, l_linenumber AS SeqNo,
       CAST(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 1 WHEN l_returnflag = 'N' THEN 2
                 WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 3 ELSE 4 END AS INT) AS operation,
       l_shipdate AS ChangedAt, l_partkey AS StockItemID, CAST(l_quantity AS BIGINT) AS Quantity
FROM @lineitem"""

# ---- messages ----------------------------------------------------------------

VIEWS["messages"] = """
SELECT event_id AS message_offset, ts AS message_time, CASE WHEN event_type = 'error' THEN 'raw' ELSE 'events' END AS topic,
       CASE WHEN event_type = 'error' THEN concat('not json ', CAST(event_id AS STRING))
            ELSE concat('{"id": ', CAST(event_id AS STRING), ', "event": "', event_type,
                        '", "props": ', props, '}') END AS message_value
FROM @events"""

# ---- run log -----------------------------------------------------------------

VIEWS["pipelines"] = """
SELECT concat('p', CAST(c_custkey AS STRING)) AS pipeline_id, c_name AS name,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'paused' ELSE 'active' END AS status,
       CASE WHEN c_nationkey < 10 THEN 'sqlserver' WHEN c_nationkey < 18 THEN 'oracle' ELSE 'file' END AS source_type,
       CAST(1 + c_nationkey % 9 AS INT) AS sla_minutes
FROM @customer"""

VIEWS["pipeline_runs"] = """
SELECT concat('run_', CAST(event_id AS STRING)) AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id,
       CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'success' WHEN 'error' THEN 'failed'
                       WHEN 'click' THEN 'running' ELSE 'queued' END AS status,
       CASE WHEN event_id % 4 = 0 THEN 'manual' ELSE 'scheduled' END AS trigger_type,
       ts AS start_time, ts AS created_at,
       CASE WHEN event_type NOT IN ('click', 'signup') THEN ts + INTERVAL '5' MINUTE END AS end_time,
       CASE WHEN event_type NOT IN ('click', 'signup') THEN value END AS duration_seconds,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS total_rows_processed,
       CASE WHEN event_type = 'error' THEN concat('stopped at ', props) END AS error_message
FROM @events"""

# up to three attempts of three tasks per run; every attempt but the last failed
VIEWS["task_runs"] = """
SELECT concat('run_', CAST(event_id AS STRING), '_t', CAST(n AS STRING), '_attempt', CAST(a AS STRING))
         AS task_run_id,
       concat('run_', CAST(event_id AS STRING)) AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id,
       concat('t', CAST(n AS STRING)) AS task_id,
       CASE n WHEN 1 THEN 'sql_extract' WHEN 2 THEN 'duckdb_transform' ELSE 'load_target' END AS task_type,
       CASE WHEN a < 1 + event_id % 3 THEN 'failed'
            WHEN event_type = 'error' AND n = 3 THEN 'failed' WHEN event_type = 'click' AND n = 3 THEN 'running'
            WHEN event_type = 'signup' THEN 'pending' ELSE 'success' END AS status,
       CAST(a AS INT) AS attempt_number,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS start_time, ts + INTERVAL '2' SECOND AS created_at,
       CASE WHEN event_type NOT IN ('click', 'signup') THEN ts + INTERVAL '3' MINUTE END AS end_time,
       CASE WHEN a < 1 + event_id % 3 THEN NULL
            ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * n END AS output_row_count,
       CASE WHEN event_type = 'signup' THEN NULL
            ELSE concat('store/p', CAST(user_id AS STRING), '/run_', CAST(event_id AS STRING), '/t',
                        CAST(n AS STRING)) END AS output_path,
       CASE WHEN a < 1 + event_id % 3 OR (event_type = 'error' AND n = 3)
            THEN concat('error in ', props) END AS error_message
FROM (SELECT *, @SEQ(1, 1 + event_id % 3) AS a
      FROM (SELECT *, @SEQ(1, 3) AS n FROM @events) runs) attempts"""

# two log entries per task: it started, then it ended
VIEWS["task_events"] = """
SELECT concat('run_', CAST(event_id AS STRING), '_t', CAST(n AS STRING), '_attempt1') AS task_run_id,
       concat('run_', CAST(event_id AS STRING)) AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id,
       concat('t', CAST(n AS STRING)) AS task_id, CAST(phase AS INT) AS seq,
       CASE WHEN phase = 1 THEN 'RUNNING' WHEN event_type = 'error' AND n = 3 THEN 'FAILED'
            WHEN event_type IN ('click', 'signup') AND n = 3 THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
       CASE WHEN phase = 1 THEN ts ELSE ts + INTERVAL '1' MINUTE END AS start_time,
       CASE WHEN phase = 2 THEN ts + INTERVAL '3' MINUTE END AS end_time,
       CASE WHEN phase = 2 AND event_type <> 'view'
            THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * n
            WHEN phase = 1 AND event_type = 'view' THEN CAST(0 AS BIGINT) END AS output_row_count,
       CASE WHEN phase = 1 THEN concat('store/', CAST(event_id AS STRING)) END AS output_path,
       CASE WHEN phase = 2 AND event_type = 'error' AND n = 3 THEN concat('failed: ', props) END AS error_message,
       CASE WHEN phase = 1 AND n = 1 THEN 'raw' WHEN phase = 2 AND n <> 2 THEN event_type END AS output_table,
       CASE WHEN phase = 2 AND event_type <> 'view' THEN event_id * n WHEN phase = 1 THEN CAST(7 AS BIGINT) END AS output_size_bytes,
       CASE WHEN phase = 1 THEN '{"id": "BIGINT"}' WHEN event_type = 'purchase' THEN '{"id": "INTEGER"}' END AS output_schema,
       CASE WHEN phase = 1 THEN 'sql_extract' ELSE 'other' END AS task_type, concat('host', CAST(phase AS STRING)) AS worker_host,
       CASE WHEN phase = 2 THEN value END AS duration_seconds,
       CASE WHEN phase = 2 AND n = 2 THEN '{"checks": []}' END AS qc_results, CASE WHEN phase = 1 OR n = 2 THEN event_type <> 'error' END AS qc_passed,
       CAST(phase AS BIGINT) AS qc_warnings, CASE WHEN event_type = 'error' THEN CAST(n AS BIGINT) ELSE CAST(0 AS BIGINT) END AS qc_failures,
       CASE WHEN phase = 1 THEN '{"cpu": 1}' END AS metrics
FROM (SELECT *, @SEQ(1, 2) AS phase
      FROM (SELECT *, @SEQ(1, 3) AS n FROM @events) tasks) entries"""

# pipelines of two, three and four tasks
VIEWS["run_configs"] = """
SELECT DISTINCT concat('p', CAST(user_id AS STRING)) AS pipeline_id, TRUE AS is_active,
       concat('{"tasks":[{"task_id":"t1"},{"task_id":"t2"}',
              CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',{"task_id":"t3"}' ELSE ',{"task_id":"t3"},{"task_id":"t4"}' END, ']}') AS config
FROM @events"""

VIEWS["alerts"] = """
SELECT event_id AS id, 'TASK_FAILURE' AS alert_type,
       CASE WHEN event_id % 3 = 0 THEN 'critical' ELSE 'error' END AS severity,
       concat('p', CAST(user_id AS STRING)) AS pipeline_id, event_id % 2 = 0 AS is_resolved, ts AS fired_at
FROM @events WHERE event_type = 'error'"""

VIEWS["audit_logs"] = """
SELECT event_id AS id,
       CASE event_type WHEN 'click' THEN 'run_started' WHEN 'view' THEN 'query_executed'
                       WHEN 'error' THEN 'task_failed' WHEN 'purchase' THEN 'run_completed'
                       ELSE 'config_updated' END AS event_type,
       concat('p', CAST(user_id AS STRING)) AS pipeline_id, concat('run_', CAST(event_id AS STRING)) AS run_id,
       CASE WHEN value > 50 THEN 'scheduler' ELSE 'api' END AS user_name,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, props AS details, ts AS logged_at
FROM @events"""

VIEWS["pipeline_configs"] = """
SELECT concat('p', CAST(o_custkey AS STRING)) AS pipeline_id,
       concat('1.', CAST(o_orderkey AS STRING)) AS version, o_orderstatus = 'O' AS is_active,
       o_orderpriority <> '5-LOW' AS is_valid, o_orderpriority AS created_by, o_orderdate AS created_at,
       concat('{"pipeline_id":"p', CAST(o_custkey AS STRING),
              '","store":"$', '{pipeline_configs}/$', '{registry.transform}/$', '{unknown}","tasks":[',
              CASE WHEN o_orderstatus = 'F'
                   THEN '{"task_id":"t2","depends_on":[]},{"task_id":"t1","depends_on":["t2"]},{"task_id":"t3","depends_on":["t1"]}'
                   ELSE '{"task_id":"t1","depends_on":[]},{"task_id":"t2","depends_on":["t1"]},{"task_id":"t3","depends_on":["t1","t2"]},{"task_id":"t4","depends_on":["t3"]}'
                   END, ']}') AS config
FROM @orders"""

VIEWS["deployments"] = """
SELECT o_orderkey AS deployment_number, concat('p', CAST(o_custkey AS STRING)) AS pipeline_id,
       CASE o_orderstatus WHEN 'P' THEN 'pending_approval' WHEN 'F' THEN 'deployed' ELSE 'rejected' END AS status,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'production' ELSE 'staging' END AS environment,
       o_orderdate AS submitted_at
FROM @orders"""

VIEWS["compute_jobs"] = """
SELECT l_orderkey * 10 + l_linenumber AS job_no, concat('p', CAST(l_suppkey AS STRING)) AS pipeline_id,
       l_partkey AS part_no, l_quantity AS cpu_seconds,
       CASE WHEN l_returnflag = 'N' THEN 'running' WHEN l_returnflag = 'R' THEN 'failed'
            WHEN l_linestatus = 'F' THEN 'success' ELSE 'completed' END AS status,
       l_shipdate AS submitted_at
FROM @lineitem"""

VIEWS["data_connections"] = """
SELECT concat('conn_', CAST(s_suppkey AS STRING)) AS connection_id, s_name AS name,
       CASE WHEN s_nationkey < 8 THEN 'sqlserver' WHEN s_nationkey < 16 THEN 'oracle' ELSE 'postgresql' END
         AS connection_type,
       s_acctbal > 1000 AS is_active
FROM @supplier"""

VIEWS["alert_rules"] = """
SELECT concat('rule_', CAST(c_custkey AS STRING)) AS rule_name, concat('p', CAST(c_custkey AS STRING)) AS pipeline_id,
       CASE WHEN c_nationkey < 8 THEN 'task_failed' WHEN c_nationkey < 16 THEN 'sla_breach'
            ELSE 'row_count_drop' END AS rule_condition,
       CAST(50 AS DOUBLE) AS drop_pct, 'error' AS severity, c_mktsegment <> 'BUILDING' AS is_active
FROM @customer
UNION ALL
SELECT concat('global_', r_name) AS rule_name, CAST(NULL AS STRING) AS pipeline_id,
       CASE WHEN r_regionkey < 1 THEN 'task_failed' WHEN r_regionkey < 3 THEN 'sla_breach'
            ELSE 'row_count_drop' END AS rule_condition,
       CAST(90 AS DOUBLE) AS drop_pct, 'warning' AS severity, TRUE AS is_active
FROM @region"""

VIEWS["task_quality"] = """
SELECT concat('run_', CAST(event_id AS STRING), '_t2_attempt1') AS task_run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id,
       concat('{"checks": [{"check_type": "not_null", "column": "id", "passed": true, "count": 0, "action": "fail"}, ',
              '{"check_type": "', CASE WHEN event_type = 'error' THEN 'unique' ELSE 'value_range' END,
              '", "column": "v", "passed": ', CASE WHEN event_type IN ('error', 'click') THEN 'false' ELSE 'true' END,
              ', "count": ', regexp_extract(props, '([0-9]+)', 1), ', "action": "warn"}]}') AS qc_results
FROM @events"""

VIEWS["task_inputs"] = """
SELECT concat('run_', CAST(event_id AS STRING)) AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id, 't2' AS task_id,
       concat('store/', event_type, '/t2') AS output_path,
       concat('[{"type": "duckdb", "path": "store/', event_type, '/t1"}',
              CASE WHEN event_type IN ('view', 'click')
                   THEN concat(', {"type": "file", "path": "in/', CAST(user_id AS STRING), '.csv"}') ELSE '' END,
              ']') AS input_sources
FROM @events"""

VIEWS["task_schemas"] = """
SELECT concat('run_', CAST(event_id AS STRING)) AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id, 't1' AS task_id,
       ts AS created_at, event_id,
       concat('{"id": "BIGINT", "v": "', CASE WHEN event_type = 'view' THEN 'DOUBLE' ELSE 'INTEGER' END, '"',
              CASE WHEN event_type = 'purchase' THEN ', "k": "VARCHAR"' ELSE '' END, '}') AS output_schema
FROM @events"""

# state reported by the platform the runs were started on
VIEWS["external_runs"] = """
SELECT concat('run_', CAST(event_id + 100 AS STRING)) AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id,
       CASE event_type WHEN 'view' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running'
                       WHEN 'signup' THEN 'queued' ELSE 'restarting' END AS state,
       CASE WHEN event_id % 5 = 0 THEN 'Manual' ELSE 'scheduled' END AS run_type,
       ts AS start_time, CASE WHEN event_type <> 'click' THEN ts + INTERVAL '90' SECOND END AS end_time
FROM @events"""

VIEWS["external_tasks"] = """
SELECT concat('run_', CAST(event_id AS STRING)) AS run_id, 't3' AS task_id,
       CASE event_type WHEN 'view' THEN 'success' WHEN 'error' THEN 'upstream_failed' WHEN 'click' THEN 'skipped'
                       WHEN 'signup' THEN 'up_for_retry' ELSE 'failed' END AS state,
       CASE WHEN event_type <> 'purchase' THEN ts END AS start_time,
       CASE WHEN event_type <> 'click' THEN ts + INTERVAL '90' SECOND END AS end_time
FROM @events"""

VIEWS["task_failures"] = """
SELECT concat('run_', CAST(event_id AS STRING), '_t3_attempt',
              CASE WHEN event_type = 'view' THEN '9' ELSE CAST(1 + event_id % 3 AS STRING) END) AS task_run_id,
       concat('run_', CAST(event_id AS STRING)) AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id, 't3' AS task_id,
       ts + INTERVAL '4' MINUTE AS end_time, concat('killed: ', props) AS error_message
FROM @events WHERE event_type IN ('click', 'view', 'error')"""

VIEWS["run_updates"] = """
SELECT concat('run_', CAST(event_id + 50 AS STRING)) AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline_id,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN event_type <> 'click' THEN ts + INTERVAL '9' MINUTE END AS end_time,
       CASE WHEN event_type <> 'click' THEN value END AS duration_seconds,
       event_id % 7 AS total_tasks, event_id % 5 AS completed_tasks, event_id % 3 AS failed_tasks, CASE WHEN event_type = 'error' THEN props END AS error_message
FROM @events"""

# one request per pipeline: its newest version again, or a new one
VIEWS["activations"] = """
SELECT concat('p', CAST(o_custkey AS STRING)) AS pipeline_id,
       CASE WHEN MAX(o_orderkey) % 2 = 0 THEN concat('1.', CAST(MAX(o_orderkey) AS STRING)) ELSE '2.0' END AS version,
       'api' AS created_by, MAX(o_orderdate) AS created_at, '{"tasks":[]}' AS config
FROM @orders GROUP BY o_custkey"""

_BASE = re.compile(r"@([a-z]\w*)")
_SEQ = re.compile(r"@SEQ\(([^,]+), ([^)]+)\)")


def spark_text(view: str, prefix: str) -> str:
    """View text for Spark, over temporary views called ``<prefix><base table>``."""
    text = _SEQ.sub(r"explode(sequence(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))", VIEWS[view])
    # Spark reads VARCHAR(n) casts as STRING
    return _BASE.sub(lambda m: prefix + m.group(1), text)


def check_text(view: str) -> str:
    """View text for the SQL check."""
    text = _SEQ.sub(r"unnest(range(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT) + 1))", VIEWS[view])
    return _BASE.sub(r"\1", text)


def with_views(sql: str) -> str:
    """Put the views that ``sql`` names in front of it."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not names:
        return sql
    ctes = ",\n".join(f"{v} AS ({check_text(v)})" for v in names)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{ctes},\n{body[len(start):]}"
    return f"WITH {ctes}\n{body}"
