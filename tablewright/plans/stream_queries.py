"""Streams fed from files of the mapped tables; each must equal the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.plans.dataflow import run_pipeline
from tablewright.plans.mapping import AS_OF_RUNS, DS
from tablewright.plans.pipelines import ARRIVALS, REACH, SCARCITY, SEGMENTS
from tablewright.plans.registry import query
from tablewright.plans.runlog_queries import TASK_STATE_SQL
from tablewright.session import scratch_path
from tablewright.sinks.store import TableStore
from tablewright.sources.artifacts import Artifacts
from tablewright.streaming import streams


def _feed(t, df, files: int = 4):
    """The rows as a folder of files, read as a stream of one file per batch."""
    path = scratch_path(t.spark, "feed")
    df.repartition(files).write.parquet(path)
    schema = t.spark.read.parquet(path).schema
    return streams.file_stream(t.spark, path, schema, files_per_batch=1)


def _store(t) -> TableStore:
    return TableStore(t.spark, scratch_path(t.spark, "store"))


@query("stream_consume", """
SELECT CASE WHEN event_type <> 'error' THEN event_id END AS id, CASE WHEN event_type <> 'error' THEN event_type END AS event,
       CASE WHEN event_type = 'error' THEN message_value END AS raw
FROM messages m JOIN events e ON m.message_offset = e.event_id""")
def stream_consume(t):
    out, checkpoint = scratch_path(t.spark, "out"), scratch_path(t.spark, "stream")
    streams.consume(_feed(t, t.messages), "id BIGINT, event STRING", out, checkpoint, "message_value")
    return t.spark.read.parquet(out).select("id", "event", "raw")


@query("stream_throughput", """
SELECT DATE_TRUNC('hour', start_time) AS hour, COUNT(*) AS run_count, COUNT(*) FILTER (WHERE status = 'success') AS success,
       CAST(COALESCE(SUM(total_rows_processed), 0) AS BIGINT) AS rows_processed
FROM pipeline_runs GROUP BY 1""")
def stream_throughput(t):
    store = _store(t)
    runs = t.pipeline_runs.select("status", F.col("start_time").cast("timestamp").alias("start_time"), "total_rows_processed")
    streams.throughput(_feed(t, runs, files=2), store, "throughput", scratch_path(t.spark, "stream"), late="40 days")
    return store.read("throughput")


@query("stream_quality", """
SELECT check_type, SUM(n)::BIGINT AS failing FROM (
  SELECT 'not_null' AS check_type, COUNT(*) FILTER (WHERE duration_seconds IS NULL) AS n FROM pipeline_runs
  UNION ALL SELECT 'value_range', COUNT(*) FILTER (WHERE total_rows_processed < 10 OR total_rows_processed > 90) FROM pipeline_runs) c
GROUP BY 1""")
def stream_quality(t):
    """Failing rows per check over all micro-batches."""
    store = _store(t)
    checks = [{"type": "not_null", "column": "duration_seconds", "action": "warn"},
              {"type": "value_range", "column": "total_rows_processed", "min": 10, "max": 90}]
    runs = t.pipeline_runs.select("run_id", "duration_seconds", "total_rows_processed")
    streams.quality(_feed(t, runs), checks, store, "results", scratch_path(t.spark, "stream"), "runs")
    return store.read("results").groupBy("check_type").agg(F.sum("count").alias("failing"))


@query("stream_task_upsert", TASK_STATE_SQL)
def stream_task_upsert(t):
    """Ends arrive first, then starts, then the ends again; the fold equals the batch upsert."""
    store, checkpoint = _store(t), scratch_path(t.spark, "stream")
    path = scratch_path(t.spark, "feed")
    for seq in (2, 1, 2):
        t.task_events.where(F.col("seq") == seq).write.mode("append").parquet(path, compression="zstd")
        feed = streams.file_stream(t.spark, path, t.task_events.schema)
        streams.task_upsert(feed, store, "task_events", checkpoint)
    return streams.task_state(store, "task_events")


# ---- whole pipelines -----------------------------------------------------------

def _run(t, config, connections=None, upstream=None, run_id="run_1"):
    root = scratch_path(t.spark, "pipeline")
    return run_pipeline(
        t.spark, config, Artifacts(t.spark, f"{root}/artifacts"), TableStore(t.spark, f"{root}/targets"),
        connections, upstream, ds=DS, run_id=run_id, as_of=F.lit(AS_OF_RUNS))


def _segments(t):
    return _run(t, SEGMENTS, {"shop": {"customer": t.customer, "orders": t.orders}})


@query("config_dataflow", """
WITH s AS (SELECT o_custkey, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS spent,
                  DATEDIFF('day', MIN(o_orderdate), MAX(o_orderdate)) AS days FROM orders GROUP BY 1)
SELECT c_mktsegment AS segment, COUNT(*) AS buyers, COUNT(o_custkey) AS active_buyers, CAST(SUM(n) AS BIGINT) AS n_orders,
       MAX(days) AS longest_days, CAST(SUM(spent) AS DOUBLE) AS spent
FROM customer LEFT JOIN s ON c_custkey = o_custkey GROUP BY 1""")
def config_dataflow(t):
    """The segment pipeline from its config: extracts, checks, transforms and loads."""
    return _segments(t).output("segments")


@query("config_dataflow_log", """
SELECT 'buyers' AS task_id, 'sql_extract' AS task_type, 'success' AS status, COUNT(*) AS output_row_count FROM customer
UNION ALL SELECT 'demand', 'sql_extract', 'success', COUNT(*) FROM orders
UNION ALL SELECT 'buyers_shape', 'schema_validate', 'success', NULL
UNION ALL SELECT 'demand_guard', 'data_quality', 'success', NULL
UNION ALL SELECT 'spend', 'duckdb_transform', 'success', NULL
UNION ALL SELECT 'segments', 'eks_job', 'success', COUNT(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'segments_guard', 'data_quality', 'success', NULL
UNION ALL SELECT 'keep', 'load_target', 'success', COUNT(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'page', 'notification', 'skipped', NULL""")
def config_dataflow_log(t):
    """Run-log rows of the segment pipeline; a lazy output has no count of its own."""
    return _segments(t).log().select("task_id", "task_type", "status", "output_row_count")


@query("inventory_dataflow", """
WITH o AS (SELECT l_partkey, COUNT(DISTINCT l_suppkey) AS suppliers, CAST(SUM(l_quantity) AS DOUBLE) AS units
           FROM lineitem WHERE l_quantity > 0 GROUP BY 1)
SELECT p_brand AS brand, COUNT(*) AS parts, COUNT(l_partkey) AS sold_parts,
       CAST(SUM(CASE WHEN COALESCE(suppliers, 0) < 2 THEN 1 ELSE 0 END) AS BIGINT) AS scarce_parts, SUM(units) AS units
FROM part LEFT JOIN o ON l_partkey = p_partkey GROUP BY 1""")
def inventory_dataflow(t):
    """Extracts in ranges of a text and of a date column, merged into a target that is read back."""
    root = scratch_path(t.spark, "pipeline")
    store = TableStore(t.spark, f"{root}/targets")
    run_pipeline(t.spark, SCARCITY, Artifacts(t.spark, f"{root}/artifacts"), store,
                 {"shop": {"part": t.part, "lineitem": t.lineitem}}, ds=DS, run_id="run_1")
    return store.read("BrandScarcity")


@query("arrivals_dataflow", """
SELECT event_id AS id, event_type AS event, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events
WHERE event_type <> 'error'""")
def arrivals_dataflow(t):
    """A topic consumed by three runs: half of what is there, that run again, and the rest with what has come since."""
    root = scratch_path(t.spark, "pipeline")
    store, artifacts = TableStore(t.spark, f"{root}/targets"), Artifacts(t.spark, f"{root}/artifacts")
    topic = t.messages.where(F.col("topic") == "events").select(
        F.col("message_value").alias("value"), F.pmod("message_offset", F.lit(3)).cast("int").alias("partition"), F.col("message_offset").alias("offset"))
    early = topic.where(F.col("offset") < topic.agg(F.max("offset") / 2).first()[0])
    for run_id, messages in (("run_1", early), ("run_1", topic), ("run_2", topic)):
        run_pipeline(t.spark, ARRIVALS, artifacts, store, topics={"events": messages}, ds=DS, run_id=run_id)
    return store.read("Arrivals")


@query("cross_pipeline_dataflow", """
SELECT c_mktsegment AS segment, COUNT(DISTINCT c_nationkey) AS nations,
       CAST(MAX(n) AS DOUBLE) / COUNT(DISTINCT c_custkey) AS rate
FROM customer JOIN (SELECT c_mktsegment, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) o
  USING (c_mktsegment) GROUP BY 1""")
def cross_pipeline_dataflow(t):
    """A pipeline that reads the published tables of another one under its pipeline id."""
    return _run(t, REACH, upstream={"segment_demand": _segments(t).published()}, run_id="run_2").output("reach")
