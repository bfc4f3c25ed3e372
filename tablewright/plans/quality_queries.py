"""Data checks over the mapped tables. Each query mixes checks that hold and checks that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import quality as q
from tablewright.plans.mapping import AS_OF_ORDERS
from tablewright.plans.registry import query
from tablewright.session import scratch_path


def _literal(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else "'" + text.replace("'", "''") + "'"


def _expect(no, kind, column, count, passed, message, source, action="fail", about=None) -> str:
    """SELECT giving the expected result row; ``count``, ``passed`` and ``message`` are SQL, ``n`` the count."""
    about = about or f"{kind} on {column or 'table'}"
    return (
        f"SELECT {no} AS check_no, '{kind}' AS check_type, {_literal(column)} AS \"column\", "
        f"{_literal(about)} AS description, {passed} AS passed, {message} AS message, "
        f"CAST(n AS BIGINT) AS \"count\", '{action}' AS action FROM (SELECT {count} AS n FROM {source}) s{no}"
    )


def _union(*rows: str) -> str:
    body = "\nUNION ALL ".join(rows)
    return f"SELECT * REPLACE (CAST(check_no AS BIGINT) AS check_no) FROM ({body}) u"


def _nulls(no, column, source, action="fail", about=None):
    return _expect(no, "not_null", column, f"COUNT(*) FILTER (WHERE {column} IS NULL)", "n = 0",
                   f"concat(n, ' null values in ''{column}''')", source, action, about)


def _dups(no, column, source, action="fail"):
    return _expect(no, "unique", column, "COUNT(*)", "n = 0", f"concat(n, ' duplicate values in ''{column}''')",
                   f"(SELECT {column} FROM {source} GROUP BY {column} HAVING COUNT(*) > 1) g", action)


def _range(no, column, where, low, high, source, action="fail"):
    return _expect(no, "value_range", column, f"COUNT(*) FILTER (WHERE {where})", "n = 0",
                   f"concat(n, ' values out of range [{low}, {high}] in ''{column}''')", source, action)


def _at_least(no, value, source, action="fail"):
    return _expect(no, "row_count_min", None, "COUNT(*)", f"n >= {value}",
                   f"concat('Row count ', n, ' < minimum {value}')", source, action)


def _at_most(no, value, source, action="fail"):
    return _expect(no, "row_count_max", None, "COUNT(*)", f"n <= {value}",
                   f"concat('Row count ', n, ' > maximum {value}')", source, action)


def _regex(no, column, pattern, source, action="fail"):
    return _expect(no, "regex_match", column,
                   f"COUNT(*) FILTER (WHERE NOT regexp_matches(CAST({column} AS STRING), '{pattern}'))", "n = 0",
                   f"concat(n, ' values in ''{column}'' don''t match ''{pattern}''')", source, action)


def _custom(no, count, source, action="fail"):
    return _expect(no, "custom_sql", None, count, "n = 0",
                   "concat('Custom SQL check returned ', n, ' failing rows')", source, action)


def _headers(t):
    return t.raw_orders.join(t.raw_customers.select("CustomerID", "CustomerName"), "CustomerID", "left")


@query("dq_not_null", "WITH headers AS (SELECT o.*, c.CustomerName FROM raw_orders o "
       "LEFT JOIN raw_customers c ON o.CustomerID = c.CustomerID) "
       + _union(_nulls(1, "CustomerName", "headers"), _nulls(2, "OrderID", "headers")))
def dq_not_null(t):
    return q.check_results(_headers(t), [{"type": "not_null", "column": "CustomerName"},
                                         {"type": "not_null", "column": "OrderID"}])


@query("dq_unique", _union(_dups(1, "OrderLineID", "raw_order_lines"), _dups(2, "PickingCompletedWhen", "raw_order_lines"),
                           _dups(3, "StockItemID, OrderID", "raw_order_lines")))
def dq_unique(t):
    return q.check_results(t.raw_order_lines, [
        {"type": "unique", "column": "OrderLineID"}, {"type": "unique", "column": "PickingCompletedWhen"},
        {"type": "unique", "column": "StockItemID, OrderID"}])


@query("dq_row_count_min", _union(_at_least(1, 1, "raw_orders"), _at_least(2, 1000000000, "raw_orders", "warn")))
def dq_row_count_min(t):
    return q.check_results(t.raw_orders, [{"type": "row_count_min"},
                                          {"type": "row_count_min", "value": 1000000000, "action": "warn"}])


@query("dq_row_count_max", _union(_at_most(1, 1000000000, "raw_orders"), _at_most(2, 1, "raw_orders")))
def dq_row_count_max(t):
    return q.check_results(t.raw_orders, [{"type": "row_count_max", "value": 1000000000},
                                          {"type": "row_count_max", "value": 1}])


@query("dq_freshness", f"""
WITH age AS (SELECT (epoch_us(TIMESTAMP '{AS_OF_ORDERS}') - epoch_us(MAX(LastEditedWhen))) / 3600000000.0 AS h
             FROM raw_orders)
SELECT CAST(no AS BIGINT) AS check_no, 'freshness' AS check_type, 'LastEditedWhen' AS "column",
       'freshness on LastEditedWhen' AS description, h - late <= max_hours AS passed,
       printf('Most recent data is %.1fh old (max %dh)', CAST(h AS DOUBLE), max_hours) AS message,
       CAST(NULL AS BIGINT) AS "count", 'fail' AS action
FROM age CROSS JOIN (VALUES (1, 24, 0), (2, -1, 0)) limits(no, max_hours, late)""")
def dq_freshness(t):
    as_of = F.lit(AS_OF_ORDERS).cast("timestamp")
    return q.check_results(t.raw_orders, [{"type": "freshness", "column": "LastEditedWhen", "max_hours": 24},
                                          {"type": "freshness", "column": "LastEditedWhen", "max_hours": -1}], as_of=as_of)


@query("dq_value_range", _union(
    _range(1, "CreditLimit", "CreditLimit < 0", 0, None, "raw_customers"),
    _range(2, "CreditLimit", "CreditLimit < -1000 OR CreditLimit > 5000", -1000, 5000, "raw_customers", "warn"),
    _range(3, "CreditLimit", "1 = 0", None, None, "raw_customers")))
def dq_value_range(t):
    return q.check_results(t.raw_customers, [
        {"type": "value_range", "column": "CreditLimit", "min": 0},
        {"type": "value_range", "column": "CreditLimit", "min": -1000, "max": 5000, "action": "warn"},
        {"type": "value_range", "column": "CreditLimit"}])


@query("dq_regex_match", _union(
    _regex(1, "CustomerPurchaseOrderNumber", "^[1-4]-", "raw_orders"), _regex(2, "Comments", "first", "raw_orders"),
    _regex(3, "OrderID", "5", "raw_orders", "warn")))
def dq_regex_match(t):
    return q.check_results(t.raw_orders, [
        {"type": "regex_match", "column": "CustomerPurchaseOrderNumber", "pattern": "^[1-4]-"},
        {"type": "regex", "column": "Comments", "pattern": "first"},
        {"type": "regex_match", "column": "OrderID", "pattern": "5", "action": "warn"}])


@query("dq_custom_sql", _union(
    _custom(1, "COUNT(*)", "(SELECT * FROM raw_orders WHERE CustomerPurchaseOrderNumber NOT IN ('1-URGENT', '2-HIGH')) b"),
    _custom(2, "COUNT(*)", "(SELECT * FROM raw_orders WHERE OrderID IS NULL) b")))
def dq_custom_sql(t):
    orders = t.raw_orders
    return q.check_results(orders, [
        {"type": "custom_sql", "sql": "SELECT COUNT(*) FROM raw_orders "
                                      "WHERE CustomerPurchaseOrderNumber NOT IN ('1-URGENT', '2-HIGH')"},
        {"type": "custom_sql", "sql": "SELECT COUNT(*) FROM raw_orders WHERE OrderID IS NULL"}],
        {"raw_orders": orders})


@query("dq_schema_match", """
WITH actual AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM orders)),
     wanted AS (SELECT * FROM (VALUES (1, 'o_orderkey', 'INT'), (1, 'o_totalprice', 'double'), (2, 'o_custkey', 'INTEGER'),
                                      (2, 'o_clerk', 'VARCHAR')) w(no, name, type)),
     issues AS (
       SELECT w.no, CASE WHEN a.column_name IS NULL THEN concat('Missing column ''', w.name, '''')
                         ELSE concat('Column ''', w.name, ''': expected ', w.type, ', got ', a.column_type) END AS note
       FROM wanted w LEFT JOIN actual a ON w.name = a.column_name
       WHERE a.column_name IS NULL OR position(upper(w.type) IN upper(a.column_type)) = 0)
SELECT CAST(k.no AS BIGINT) AS check_no, 'schema_match' AS check_type, CAST(NULL AS STRING) AS "column",
       'schema_match on table' AS description, COUNT(i.note) = 0 AS passed,
       COALESCE(string_agg(i.note, '; ' ORDER BY i.note), 'Schema matches') AS message, COUNT(i.note) AS "count",
       'fail' AS action
FROM (VALUES (1), (2)) k(no) LEFT JOIN issues i ON i.no = k.no GROUP BY k.no""")
def dq_schema_match(t):
    return q.check_results(t.orders, [
        {"type": "schema_match", "columns": {"o_orderkey": "INT", "o_totalprice": "double"}},
        {"type": "schema_match", "columns": {"o_custkey": "INTEGER", "o_clerk": "VARCHAR"}}])


@query("dq_referential_integrity", _union(
    _expect(1, "referential_integrity", "CustomerID", "COUNT(*)", "n = 0",
            "concat(n, ' values in ''CustomerID'' not found in ''raw_customers''')",
            "(SELECT o.CustomerID FROM raw_orders o WHERE o.CustomerID IS NOT NULL AND NOT EXISTS "
            "(SELECT 1 FROM raw_customers c WHERE c.CustomerID = o.CustomerID)) x"),
    _expect(2, "referential_integrity", "SupplierID", "COUNT(*)", "n = 0",
            "concat(n, ' values in ''SupplierID'' not found in ''supplier''')",
            "(SELECT x.SupplierID FROM raw_stock_transactions x WHERE x.SupplierID IS NOT NULL AND NOT EXISTS "
            "(SELECT 1 FROM supplier s WHERE s.s_suppkey = x.SupplierID)) y")))
def dq_referential_integrity(t):
    first = q.check_results(t.raw_orders, [
        {"type": "referential_integrity", "column": "CustomerID", "parent_table": "raw_customers"}],
        {"raw_customers": t.raw_customers})
    second = q.check_results(t.raw_stock_transactions, [
        {"type": "referential_integrity", "column": "SupplierID", "parent_table": "supplier", "parent_column": "s_suppkey"}],
        {"supplier": t.supplier}).withColumn("check_no", F.lit(2))
    return first.unionByName(second)


@query("dq_unknown_type", _union(
    _expect(1, "checksum", "OrderID", "CAST(NULL AS BIGINT)", "TRUE",
            "'Unknown check type ''checksum'' — skipped'", "(SELECT 1) one"),
    _at_least(2, 1, "raw_orders")))
def dq_unknown_type(t):
    return q.check_results(t.raw_orders, [{"type": "checksum", "column": "OrderID"}, {"type": "row_count_min"}])


LINE_CHECKS = [
    {"type": "row_count_min", "value": 1, "action": "warn"},
    {"type": "not_null", "column": "OrderLineID"},
    {"type": "not_null", "column": "PickingCompletedWhen", "action": "warn", "description": "Lines still open"},
    {"type": "unique", "column": "OrderLineID"},
    {"type": "unique", "column": "OrderID", "action": "skip"},
    {"type": "value_range", "column": "UnitPrice", "min": 0},
    {"type": "value_range", "column": "Quantity", "min": 10, "max": 50},
    {"type": "regex_match", "column": "Description", "pattern": "^Item [0-9]+$"},
    {"type": "custom_sql", "sql": "SELECT COUNT(*) FROM raw_order_lines WHERE PickedQuantity > Quantity", "action": "warn"},
]
SUITE_SQL = _union(
    _at_least(1, 1, "raw_order_lines", "warn"), _nulls(2, "OrderLineID", "raw_order_lines"),
    _nulls(3, "PickingCompletedWhen", "raw_order_lines", "warn", "Lines still open"),
    _dups(4, "OrderLineID", "raw_order_lines"), _dups(5, "OrderID", "raw_order_lines", "skip"),
    _range(6, "UnitPrice", "UnitPrice < 0", 0, None, "raw_order_lines"),
    _range(7, "Quantity", "Quantity < 10 OR Quantity > 50", 10, 50, "raw_order_lines"),
    _regex(8, "Description", "^Item [0-9]+$", "raw_order_lines"),
    _custom(9, "COUNT(*)", "(SELECT * FROM raw_order_lines WHERE PickedQuantity > Quantity) b", "warn"))


def _suite(t):
    return q.check_results(t.raw_order_lines, LINE_CHECKS, {"raw_order_lines": t.raw_order_lines})


@query("dq_suite", SUITE_SQL)
def dq_suite(t):
    return _suite(t)


@query("dq_actions", f"""
WITH results AS ({SUITE_SQL})
SELECT COUNT(*) FILTER (WHERE NOT passed AND action = 'fail') = 0 AS passed,
       COUNT(*) FILTER (WHERE NOT passed AND action = 'fail') AS failures,
       COUNT(*) FILTER (WHERE NOT passed AND action = 'warn') AS warnings FROM results""")
def dq_actions(t):
    return q.verdict(_suite(t))


_BAD_LINES = """
WITH marked AS (
  SELECT OrderLineID, OrderID, CAST(Quantity AS BIGINT) AS Quantity, PickingCompletedWhen,
         PickingCompletedWhen IS NULL AS open_line, Quantity < 10 AS small,
         OrderLineID IN (SELECT OrderLineID FROM raw_order_lines GROUP BY 1 HAVING COUNT(*) > 1) AS repeated,
         NOT EXISTS (SELECT 1 FROM known_orders k WHERE k.OrderID = l.OrderID) AS orphan
  FROM raw_order_lines l)"""
_KNOWN = "WITH known_orders AS (SELECT OrderID FROM raw_orders WHERE NOT IsUndersupplyBackordered), "


@query("dq_drop_rows", _KNOWN + _BAD_LINES[6:] + """
SELECT OrderLineID, OrderID, Quantity, PickingCompletedWhen,
       array_to_string(list_filter([CASE WHEN open_line THEN 'not_null on PickingCompletedWhen' END,
                                    CASE WHEN small THEN 'value_range on Quantity' END,
                                    CASE WHEN repeated THEN 'unique on OrderLineID' END,
                                    CASE WHEN orphan THEN 'referential_integrity on OrderID' END],
                                   lambda x: x IS NOT NULL), '; ') AS violations
FROM marked""")
def dq_drop_rows(t):
    """Clean and quarantined rows together; a clean row has no violation text."""
    lines = t.raw_order_lines.select("OrderLineID", "OrderID", "Quantity", "PickingCompletedWhen")
    known = t.raw_orders.where(~F.col("IsUndersupplyBackordered")).select("OrderID")
    clean, bad = q.drop_rows(lines, [
        {"type": "not_null", "column": "PickingCompletedWhen"},
        {"type": "value_range", "column": "Quantity", "min": 10},
        {"type": "unique", "column": "OrderLineID"},
        {"type": "referential_integrity", "column": "OrderID", "parent_table": "known_orders"}],
        scratch_path(t.spark, "quarantine"), {"known_orders": known})
    text = bad.withColumn("violations", F.concat_ws("; ", "violations"))
    return clean.withColumn("violations", F.lit("")).unionByName(text)


@query("dq_passthrough", """
SELECT OrderID, CustomerID, SalespersonPersonID, OrderDate, ExpectedDeliveryDate, CustomerPurchaseOrderNumber,
       IsUndersupplyBackordered, Comments, LastEditedWhen FROM raw_orders""")
def dq_passthrough(t):
    """A check task hands its input on unchanged."""
    orders = t.raw_orders
    q.run_suite(orders, [{"type": "row_count_min"}, {"type": "unique", "column": "OrderID"}])
    return orders


@query("schema_validate", """
WITH actual AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM lineitem)),
     wanted AS (SELECT * FROM (VALUES ('l_orderkey', 'INT'), ('l_quantity', 'DECIMAL'), ('l_shipdate', 'timestamp'),
                                      ('l_comment', 'VARCHAR'), ('l_linenumber', 'BIGINT')) w(name, type))
SELECT w.name AS "column", CASE WHEN a.column_name IS NULL THEN 'missing' ELSE 'type_mismatch' END AS issue,
       CASE WHEN a.column_name IS NOT NULL THEN w.type END AS expected, a.column_type AS actual,
       (SELECT COUNT(*) FROM lineitem) AS rows_passed_on
FROM wanted w LEFT JOIN actual a ON w.name = a.column_name
WHERE a.column_name IS NULL OR position(upper(w.type) IN upper(a.column_type)) = 0""")
def schema_validate(t):
    """Issues of the table's schema; the table itself flows on unchanged."""
    issues = q.schema_validate(t.lineitem, {
        "l_orderkey": "INT", "l_quantity": "DECIMAL", "l_shipdate": "timestamp", "l_comment": "VARCHAR",
        "l_linenumber": "BIGINT"}, fail_on_error=False)
    return issues.withColumn("rows_passed_on", F.lit(t.lineitem.count()))


@query("anti_join_orphans", """
SELECT o.CustomerID, COUNT(*) AS orphan_rows FROM raw_orders o
WHERE NOT EXISTS (SELECT 1 FROM raw_customers c WHERE c.CustomerID = o.CustomerID) AND o.CustomerID IS NOT NULL
GROUP BY 1""")
def anti_join_orphans(t):
    return q.orphan_keys(t.raw_orders, "CustomerID", t.raw_customers, "CustomerID").withColumnRenamed("_rows", "orphan_rows")
