"""Sinks: each query writes, then reads back what a user of the target would see."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.plans import business as b
from tablewright.plans.business_queries import DETAIL_SQL
from tablewright.plans.registry import query
from tablewright.session import scratch_path
from tablewright.sinks import targets
from tablewright.sinks.store import TableStore, fit_columns
from tablewright.sources.artifacts import Artifacts

_EARLY = "o_orderdate < TIMESTAMP '1999-01-01'"
_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def _early():
    return F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")


def _store(t) -> TableStore:
    return TableStore(t.spark, scratch_path(t.spark, "store"))


@query("write_artifact", f"""
SELECT OrderLineID, OrderID, LineTotal, TaxAmount, PickingStatus FROM ({DETAIL_SQL}) d""")
def write_artifact(t):
    """Written twice: the second write replaces the first."""
    store = Artifacts(t.spark, scratch_path(t.spark, "artifacts"))
    lines = b.order_lines_detail(t.raw_order_lines).select("OrderLineID", "OrderID", "LineTotal", "TaxAmount", "PickingStatus")
    for _ in range(2):
        store.write(lines, "sales", "run_1", "transform_lines", "order_lines_detail")
    return store.scan("sales", "run_1", "transform_lines", "order_lines_detail")


@query("load_append", f"SELECT {_COLUMNS} FROM orders")
def load_append(t):
    """Two runs append; the second runs again and still counts once."""
    store, target = _store(t), {"type": "table", "table": "OrderEnriched", "mode": "append"}
    targets.load_target(_orders(t).where(_early()), target, store, run_id="r1")
    for _ in range(2):
        targets.load_target(_orders(t).where(~_early()), target, store, run_id="r2")
    return store.read("OrderEnriched")


@query("load_append_tasks", f"SELECT {_COLUMNS} FROM orders")
def load_append_tasks(t):
    """Two tasks of one run append to one table."""
    store, target = _store(t), {"type": "table", "table": "Shared", "mode": "append"}
    targets.load_target(_orders(t).where(_early()), target, store, run_id="r1", task_id="early")
    targets.load_target(_orders(t).where(~_early()), target, store, run_id="r1", task_id="late")
    return store.read("Shared")


@query("load_merge_then_append", f"""
SELECT {_COLUMNS} FROM orders UNION ALL SELECT {_COLUMNS} FROM orders WHERE NOT ({_EARLY})""")
def load_merge_then_append(t):
    """An append of a run that merged before adds to the merged rows; it reads the table it appends to."""
    store, merged = _store(t), {"type": "table", "table": "Orders", "mode": "merge", "keys": ["o_orderkey"]}
    targets.load_target(_orders(t), merged, store, run_id="r1")
    added = {"type": "table", "table": "Orders", "mode": "append"}
    targets.load_target(store.read("Orders").where(~_early()), added, store, run_id="r1")
    return store.read("Orders")


@query("load_overwrite", f"SELECT {_COLUMNS} FROM orders WHERE NOT ({_EARLY})")
def load_overwrite(t):
    store, target = _store(t), {"type": "table", "table": "StockLevels", "write_mode": "replace"}
    targets.load_target(_orders(t), target, store)
    # reads the table it replaces
    targets.load_target(store.read("StockLevels").where(~_early()), target, store)
    return store.read("StockLevels")


@query("load_merge", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN o_orderstatus END AS state,
       CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN o_custkey END AS owner, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2
            ELSE o_totalprice END AS amount
FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' OR o_orderstatus = 'F'""")
def load_merge(t):
    """Finished orders update the early ones and are added where missing; ``owner`` is not staged."""
    store, target = _store(t), {"type": "table", "table": "Orders", "mode": "upsert", "keys": ["o_orderkey"]}
    early = t.orders.where(_early()).select(
        "o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("amount"))
    done = t.orders.where("o_orderstatus = 'F'").select(
        "o_orderkey", F.lit("done").alias("state"), (F.col("o_totalprice") * 2).alias("amount"))
    targets.load_target(early, target, store)
    targets.load_target(done, target, store)
    return store.read("Orders")


@query("load_drop_audit_column", f"SELECT {_COLUMNS} FROM orders")
def load_drop_audit_column(t):
    return targets.drop_audit_column(_orders(t).withColumn("etl_loaded_at", F.current_timestamp()))


@query("load_column_fit", """
SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, CAST(NULL AS STRING) AS note FROM orders""")
def load_column_fit(t):
    """Columns the target generates or lacks are dropped, the rest take its types."""
    target = t.spark.createDataFrame([], "o_orderkey bigint, O_CUSTKEY string, note string, row_version bigint")
    fitted = fit_columns(t.orders, target, generated=["row_version"])
    return fitted.withColumnRenamed("O_CUSTKEY", "o_custkey")


def _files(t, kind: str, read):
    store, path = _store(t), scratch_path(t.spark, f"load-{kind}")
    targets.load_target(_orders(t), {"type": kind, "path": path}, store, "sales")
    return read(path)


@query("load_parquet", f"SELECT {_COLUMNS} FROM orders")
def load_parquet(t):
    """Default path of the pipeline; an unknown file type lands as Parquet too."""
    store = _store(t)
    report = targets.load_target(_orders(t), {"type": "s3"}, store, "sales")
    return t.spark.read.parquet(report.where)


@query("load_csv", f"SELECT {_COLUMNS} FROM orders")
def load_csv(t):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    return _files(t, "csv", lambda path: t.spark.read.schema(schema).option("header", True).csv(path))


@query("load_json", f"SELECT {_COLUMNS} FROM orders")
def load_json(t):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    return _files(t, "json", lambda path: t.spark.read.schema(schema).json(path))


@query("publish_json", """
SELECT concat('{"id":', o_orderkey, ',"status":"', o_orderstatus, '","customer":', o_custkey, ',"note":',
              CASE WHEN o_orderpriority = '1-URGENT' THEN '"call"' ELSE 'null' END, '}') AS value FROM orders""")
def publish_json(t):
    """The message texts; only the connector is left out."""
    note = F.when(F.col("o_orderpriority") == "1-URGENT", "call")
    return targets.to_messages(t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"),
        note.alias("note")))


@query("export_result", """
SELECT c_mktsegment, COUNT(*) AS customers, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM customer GROUP BY 1""")
def export_result(t):
    """A result saved as TSV and read again."""
    path = scratch_path(t.spark, "export")
    result = t.customer.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("balance"))
    targets.write_files(result, "tsv", path)
    return t.spark.read.schema("c_mktsegment string, customers bigint, balance double").option("header", True).option(
        "sep", "\t").csv(path)


@query("load_report", """
SELECT concat('Loaded ', COUNT(*), ' rows to table:Lines') AS report, COUNT(*) AS n_rows FROM lineitem""")
def load_report(t):
    store = _store(t)
    report = targets.load_target(t.lineitem, {"type": "table", "table": "Lines"}, store, run_id="r1")
    return store.read("Lines").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("report", F.lit(str(report)))
