"""Run-log analytics over the mapped log tables, with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import runlog as r
from tablewright.plans.mapping import AS_OF_RUNS
from tablewright.plans.registry import query

NOW = f"TIMESTAMP '{AS_OF_RUNS}'"
TODAY = f"DATE_TRUNC('day', {NOW})"
DAY_AGO = f"{NOW} - INTERVAL '1' DAY"
ENV = {"s3_buckets": {"pipeline_configs": "configs-dev"}, "container_registries": {"transform": "registry/transform:1"},
       "secrets": {"source": "arn-source"}}


def mean_sql(value: str = "duration_seconds", digits: int = 1) -> str:
    scale = 10**digits
    return (f"FLOOR(CAST(SUM(CAST({value} AS DECIMAL(20,6))) AS DOUBLE) / NULLIF(COUNT({value}), 0) * {scale}.0 + 0.5)"
            f" / {scale}.0")


def percent_sql(part: str, whole: str, digits: int = 1) -> str:
    scale = float(10**digits)
    return f"FLOOR(CAST({part} AS DOUBLE) * 100.0 / NULLIF({whole}, 0) * {scale} + 0.5) / {scale}"


# ---- configs -------------------------------------------------------------------

@query("active_pipeline_configs", """
SELECT c.pipeline_id, c.version, c.config FROM pipeline_configs c JOIN pipelines p ON c.pipeline_id = p.pipeline_id
WHERE c.is_active AND p.status = 'active'""")
def active_pipeline_configs(t):
    return r.active_pipeline_configs(t.pipeline_configs, t.pipelines).select("pipeline_id", "version", "config")


@query("config_resolve", """
SELECT pipeline_id, version, replace(replace(config, '${pipeline_configs}', 'configs-dev'),
                                     '${registry.transform}', 'registry/transform:1') AS config
FROM pipeline_configs""")
def config_resolve(t):
    resolved = r.resolve_placeholders(F.col("config"), r.substitutions(ENV))
    return t.pipeline_configs.select("pipeline_id", "version", resolved.alias("config"))


@query("config_versions", """
SELECT pipeline_id, version, is_active, is_valid, created_by, created_at FROM pipeline_configs ORDER BY created_at DESC, 1, 2""")
def config_versions(t):
    return r.config_versions(t.pipeline_configs).drop("config")


@query("config_activate", """
SELECT c.pipeline_id, c.version, a.version IS NOT NULL AND c.version = a.version AS is_active, c.is_valid, c.created_by,
       c.created_at, CASE WHEN c.version = a.version THEN a.config ELSE c.config END AS config
FROM pipeline_configs c JOIN activations a ON c.pipeline_id = a.pipeline_id
UNION ALL
SELECT a.pipeline_id, a.version, TRUE, TRUE, a.created_by, a.created_at, a.config FROM activations a
WHERE NOT EXISTS (SELECT 1 FROM pipeline_configs c WHERE c.pipeline_id = a.pipeline_id AND c.version = a.version)""")
def config_activate(t):
    return r.config_activate(t.pipeline_configs, t.activations)


@query("downstream_tasks", """
WITH RECURSIVE nodes AS (
  SELECT pipeline_id, version, unnest(from_json(config, '{"tasks":[{"task_id":"VARCHAR","depends_on":["VARCHAR"]}]}').tasks) AS task
  FROM pipeline_configs),
edges AS (SELECT pipeline_id, version, task.task_id AS child, unnest(task.depends_on) AS parent FROM nodes),
reached AS (
  SELECT pipeline_id, version, 't1' AS task_id FROM pipeline_configs
  UNION
  SELECT e.pipeline_id, e.version, e.child FROM reached r JOIN edges e
    ON e.pipeline_id = r.pipeline_id AND e.version = r.version AND e.parent = r.task_id)
SELECT * FROM reached""")
def downstream_tasks(t):
    """For every config: what must run again when t1 does."""
    return r.downstream_tasks(t.pipeline_configs, "t1")


# ---- listings ------------------------------------------------------------------

@query("search_pipelines", """
SELECT * REPLACE (sla_minutes::BIGINT AS sla_minutes) FROM pipelines
WHERE status = 'active' AND source_type = 'sqlserver' AND (pipeline_id ILIKE '%01%' OR name ILIKE '%01%')
ORDER BY pipeline_id LIMIT 50 OFFSET 50""")
def search_pipelines(t):
    return r.search_pipelines(t.pipelines, "active", "sqlserver", "01", number=2)


@query("latest_run_per_pipeline", """
WITH ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pipeline_id ORDER BY created_at DESC, run_id DESC) AS rn
                FROM pipeline_runs)
SELECT p.pipeline_id, p.name, p.status, l.run_id, l.status AS run_status, l.start_time, l.duration_seconds
FROM pipelines p LEFT JOIN ranked l ON p.pipeline_id = l.pipeline_id AND l.rn = 1""")
def latest_run_per_pipeline(t):
    return r.latest_run_per_pipeline(t.pipelines.select("pipeline_id", "name", "status"), t.pipeline_runs)


@query("runs_page", """
SELECT run_id, pipeline_id, status, created_at FROM pipeline_runs WHERE status = 'failed'
ORDER BY created_at DESC, run_id LIMIT 50 OFFSET 100""")
def runs_page(t):
    return r.runs_page(t.pipeline_runs, status="failed", number=3).select("run_id", "pipeline_id", "status", "created_at")


@query("run_detail_tasks", """
WITH active AS (
  SELECT pipeline_id, list_transform(from_json(config, '{"tasks":[{"task_id":"VARCHAR"}]}').tasks, lambda x: x.task_id) AS ids
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pipeline_id ORDER BY created_at DESC, version DESC) AS rn
        FROM pipeline_configs WHERE is_active) a WHERE rn = 1)
SELECT t.task_run_id, t.run_id, t.pipeline_id, t.task_id, t.status, t.start_time,
       CAST(COALESCE(NULLIF(COALESCE(list_position(a.ids, t.task_id), 0), 0) - 1, len(a.ids), 0) AS BIGINT) AS config_position
FROM task_runs t LEFT JOIN active a ON t.pipeline_id = a.pipeline_id""")
def run_detail_tasks(t):
    """Every run's tasks, placed in the order of their pipeline's active config."""
    return r.run_detail_tasks(t.task_runs, t.pipeline_configs).select(
        "task_run_id", "run_id", "pipeline_id", "task_id", "status", "start_time", "config_position")


@query("tasks_page", """
SELECT task_run_id, pipeline_id, status, created_at FROM task_runs WHERE status = 'running'
ORDER BY created_at DESC, task_run_id LIMIT 100""")
def tasks_page(t):
    return r.tasks_page(t.task_runs, status="running").select("task_run_id", "pipeline_id", "status", "created_at")


@query("latest_task_attempt", """
SELECT task_run_id, run_id, task_id, status, attempt_number::BIGINT AS attempt_number FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, task_id ORDER BY created_at DESC, attempt_number DESC, task_run_id DESC) AS rn
  FROM task_runs) a WHERE rn = 1""")
def latest_task_attempt(t):
    tasks = t.task_runs.select("task_run_id", "run_id", "task_id", "status", "attempt_number", "created_at")
    return r.latest_task_attempt(tasks).drop("created_at")


@query("audit_search", """
SELECT * FROM audit_logs WHERE event_type IN ('task_failed', 'query_executed') AND user_name = 'scheduler'
ORDER BY logged_at DESC, id LIMIT 100 OFFSET 100""")
def audit_search(t):
    return r.audit_search(t.audit_logs, event_type=["task_failed", "query_executed"], user="scheduler", number=2)


@query("alerts_search", """
SELECT * FROM alerts WHERE NOT is_resolved AND severity = 'critical' ORDER BY fired_at DESC, id LIMIT 50""")
def alerts_search(t):
    return r.alerts_search(t.alerts, resolved=False, severity="critical")


@query("active_connections", "SELECT * FROM data_connections WHERE is_active ORDER BY connection_id")
def active_connections(t):
    return r.active_connections(t.data_connections)


@query("deployments_recent", """
SELECT * FROM deployments WHERE environment = 'production' ORDER BY submitted_at DESC, deployment_number DESC LIMIT 100""")
def deployments_recent(t):
    return r.deployments_recent(t.deployments, environment="production")


@query("deployments_pending", "SELECT COUNT(*) FILTER (WHERE status = 'pending_approval') AS pending FROM deployments")
def deployments_pending(t):
    return r.pending_approvals(t.deployments)


@query("compute_jobs_recent", """
SELECT * FROM compute_jobs WHERE status = 'failed' ORDER BY submitted_at DESC, job_no, part_no, cpu_seconds, pipeline_id LIMIT 100""")
def compute_jobs_recent(t):
    order = [F.desc("submitted_at"), "job_no", "part_no", "cpu_seconds", "pipeline_id"]
    return r.compute_jobs_recent(t.compute_jobs, order, status="failed")


@query("compute_job_counts", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'running') AS running, COUNT(*) FILTER (WHERE status = 'failed') AS failed,
       COUNT(*) FILTER (WHERE status IN ('success', 'completed')) AS success FROM compute_jobs""")
def compute_job_counts(t):
    return r.compute_job_counts(t.compute_jobs)


# ---- dashboards ----------------------------------------------------------------

@query("kpi_dashboard", f"""
WITH runs AS (
  SELECT COUNT(*) FILTER (WHERE status IN ('running', 'queued')) AS active_runs,
         COUNT(*) FILTER (WHERE created_at >= {TODAY}) AS today_runs,
         COUNT(*) FILTER (WHERE created_at >= {TODAY} AND status = 'success') AS today_success,
         COUNT(*) FILTER (WHERE created_at >= {TODAY} AND status = 'failed') AS today_failed,
         COALESCE({mean_sql(f"CASE WHEN created_at >= {TODAY} AND status = 'success' THEN duration_seconds END")}, 0.0)
           AS avg_duration_seconds,
         CAST(COALESCE(SUM(CASE WHEN created_at >= {TODAY} THEN total_rows_processed END), 0) AS BIGINT) AS rows_today
  FROM pipeline_runs)
SELECT *, COALESCE({percent_sql('today_success', 'today_runs')}, 0.0) AS success_rate,
       (SELECT COUNT(*) FROM alerts WHERE NOT is_resolved) AS active_alerts,
       (SELECT COUNT(*) FROM task_runs WHERE created_at >= {TODAY} AND status = 'failed') AS failed_tasks_today
FROM runs""")
def kpi_dashboard(t):
    return r.kpi_dashboard(t.pipeline_runs, t.alerts, t.task_runs, AS_OF_RUNS)


@query("throughput_hourly", f"""
SELECT DATE_TRUNC('hour', start_time) AS hour, COUNT(*) AS run_count,
       CAST(COALESCE(SUM(total_rows_processed), 0) AS BIGINT) AS rows_processed, COALESCE({mean_sql()}, 0.0) AS avg_duration
FROM pipeline_runs WHERE start_time >= {NOW} - INTERVAL '720' HOUR GROUP BY 1 ORDER BY 1""")
def throughput_hourly(t):
    return r.throughput_hourly(t.pipeline_runs, AS_OF_RUNS, hours=720)


@query("panel_active_runs", f"""
SELECT COUNT(*) AS value FROM pipeline_runs WHERE status IN ('running', 'queued') AND start_time > {NOW} - INTERVAL '1' HOUR""")
def panel_active_runs(t):
    return r.panel_active_runs(t.pipeline_runs, AS_OF_RUNS)


@query("panel_runs_today", f"SELECT COUNT(*) AS value FROM pipeline_runs WHERE start_time >= {TODAY}")
def panel_runs_today(t):
    return r.panel_runs_today(t.pipeline_runs, AS_OF_RUNS)


@query("panel_success_rate_24h", f"""
SELECT {percent_sql("SUM(CASE WHEN status = 'success' THEN 1 ELSE 0 END)", "COUNT(*)")} AS value
FROM pipeline_runs WHERE start_time > {DAY_AGO}""")
def panel_success_rate_24h(t):
    return r.panel_success_rate(t.pipeline_runs, AS_OF_RUNS)


@query("panel_open_alerts", f"SELECT COUNT(*) AS value FROM alerts WHERE is_resolved = false AND fired_at > {DAY_AGO}")
def panel_open_alerts(t):
    return r.panel_open_alerts(t.alerts, AS_OF_RUNS)


@query("panel_runs_per_hour", f"""
SELECT DATE_TRUNC('hour', start_time) AS time, COUNT(*) AS value, COUNT(*) FILTER (WHERE status = 'success') AS success
FROM pipeline_runs WHERE start_time > {DAY_AGO} GROUP BY 1 ORDER BY 1""")
def panel_runs_per_hour(t):
    return r.panel_runs_per_hour(t.pipeline_runs, AS_OF_RUNS)


@query("panel_rows_per_hour", f"""
SELECT DATE_TRUNC('hour', start_time) AS time, CAST(COALESCE(SUM(total_rows_processed), 0) AS BIGINT) AS value
FROM pipeline_runs WHERE start_time > {DAY_AGO} GROUP BY 1 ORDER BY 1""")
def panel_rows_per_hour(t):
    return r.panel_rows_per_hour(t.pipeline_runs, AS_OF_RUNS)


@query("panel_failed_tasks", f"""
SELECT task_run_id, pipeline_id, task_id, task_type, error_message, start_time FROM task_runs
WHERE status = 'failed' AND start_time > {DAY_AGO} ORDER BY start_time DESC, task_run_id LIMIT 50""")
def panel_failed_tasks(t):
    return r.panel_failed_tasks(t.task_runs, AS_OF_RUNS)


@query("kpi_windowed", f"""
WITH w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in r.WINDOWS.items())}) v(time_window, minutes))
SELECT w.time_window, COUNT(*) FILTER (WHERE p.status = 'running') AS running, COUNT(*) FILTER (WHERE p.status = 'failed') AS failed,
       COUNT(*) FILTER (WHERE p.status = 'success') AS success,
       COALESCE({percent_sql("COUNT(*) FILTER (WHERE p.status = 'success')",
                             "COUNT(*) FILTER (WHERE p.status IN ('success', 'failed'))", 0)}, 0.0) AS success_rate
FROM w JOIN pipeline_runs p ON p.start_time >= {NOW} - to_minutes(w.minutes::INT) GROUP BY 1""")
def kpi_windowed(t):
    return r.kpi_windowed(t.pipeline_runs, AS_OF_RUNS)


@query("duration_series", f"""
SELECT run_id, pipeline_id, start_time, FLOOR(COALESCE(duration_seconds, 0.0) / 60.0 * 10.0 + 0.5) / 10.0 AS duration_minutes,
       status, CASE WHEN status IN ('success', 'failed') THEN status ELSE 'running' END AS series
FROM pipeline_runs WHERE start_time >= {NOW} - INTERVAL '43200' MINUTE""")
def duration_series(t):
    return r.duration_series(t.pipeline_runs, AS_OF_RUNS, minutes=43200)


@query("status_counts", """
SELECT COUNT(*) FILTER (WHERE status = 'running') AS running, COUNT(*) FILTER (WHERE status = 'failed') AS failed,
       COUNT(*) FILTER (WHERE status = 'success') AS success FROM pipeline_runs""")
def status_counts(t):
    return r.status_counts(t.pipeline_runs)


@query("run_rollup", """
SELECT run_id, MIN(pipeline_id) AS pipeline_id, MIN(start_time) AS min_start, MAX(end_time) AS max_end, COUNT(*) AS tasks,
       COUNT(*) FILTER (WHERE status = 'success') AS success, COUNT(*) FILTER (WHERE status = 'failed') AS failed,
       CAST(COALESCE(SUM(output_row_count), 0) AS BIGINT) AS total_rows,
       CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed'
            WHEN bool_and(status = 'success') THEN 'success' ELSE 'pending' END AS status
FROM task_runs GROUP BY run_id""")
def run_rollup(t):
    return r.run_rollup(t.task_runs)


# ---- state folds ---------------------------------------------------------------

COUNTERS_SQL = """
SELECT run_id, MIN(pipeline_id) AS pipeline_id, COUNT(*) FILTER (WHERE status = 'success') AS completed_tasks,
       COUNT(*) FILTER (WHERE status = 'failed') AS failed_tasks,
       CAST(COALESCE(SUM(CASE WHEN status = 'success' THEN n END), 0) AS BIGINT) AS total_rows_processed,
       MAX(total) AS total_tasks, MIN(start_time) AS start_time,
       MIN(CASE WHEN status IN ('success', 'failed') AND rn >= total THEN end_time END) AS ended_at,
       COUNT(*) FILTER (WHERE status = 'failed' AND rn <= total) AS failed_by_then
FROM (
  SELECT a.*, GREATEST(declared, stored) AS total, ROW_NUMBER() OVER (
    PARTITION BY a.run_id ORDER BY CASE WHEN a.status IN ('success', 'failed') THEN 0 ELSE 1 END, a.end_time, task_run_id) AS rn
  FROM (SELECT e2.task_run_id, e1.run_id, e1.pipeline_id, LOWER(e2.status) AS status, e1.start_time, e2.end_time,
               COALESCE(e2.output_row_count, e1.output_row_count) AS n
        FROM task_events e1 JOIN task_events e2 ON e1.task_run_id = e2.task_run_id AND e1.seq = 1 AND e2.seq = 2) a
  JOIN (SELECT pipeline_id, CAST(json_array_length(config, '$.tasks') AS BIGINT) AS declared FROM run_configs) c ON c.pipeline_id = a.pipeline_id
  JOIN (SELECT run_id, CAST(CASE WHEN trigger_type = 'manual' THEN 3 ELSE 0 END AS BIGINT) AS stored FROM pipeline_runs) s ON s.run_id = a.run_id) r
GROUP BY run_id"""


def _counters(t):
    """Every end is in the log twice; pipelines declare two to four tasks and manual runs have three on record."""
    events = t.task_events.unionByName(t.task_events.where(F.col("seq") == 2))
    stored = t.pipeline_runs.select("run_id", F.when(F.col("trigger_type") == "manual", 3).otherwise(0).cast("bigint").alias("total_tasks"))
    return r.run_counters(events, r.declared_tasks(t.run_configs), stored)


@query("run_counters", COUNTERS_SQL)
def run_counters(t):
    return _counters(t)


@query("run_finalize", f"""
WITH c AS ({COUNTERS_SQL}), e AS (SELECT *, total_tasks > 0 AND completed_tasks + failed_tasks >= total_tasks AS ended FROM c)
SELECT run_id, pipeline_id, CASE WHEN NOT ended THEN 'running' WHEN failed_by_then > 0 THEN 'failed' ELSE 'success' END AS status,
       total_tasks, completed_tasks, failed_tasks, total_rows_processed, start_time, CASE WHEN ended THEN ended_at END AS end_time,
       CASE WHEN ended THEN (epoch_us(ended_at) - epoch_us(start_time)) / 1000000.0::DOUBLE END AS duration_seconds
FROM e""")
def run_finalize(t):
    return r.run_finalize(_counters(t))


TASK_STATE_SQL = """
SELECT e2.task_run_id, e1.run_id, e1.pipeline_id, e1.task_id, e1.start_time, LOWER(e2.status) AS status, e2.end_time,
       e2.error_message, COALESCE(e2.output_row_count, e1.output_row_count) AS output_row_count,
       COALESCE(e2.output_path, e1.output_path) AS output_path, COALESCE(e2.output_table, e1.output_table) AS output_table,
       COALESCE(e2.output_size_bytes, e1.output_size_bytes) AS output_size_bytes, COALESCE(e2.output_schema, e1.output_schema) AS output_schema,
       e1.task_type, e1.worker_host, e2.duration_seconds, e2.qc_results, e2.qc_passed, e2.qc_warnings, e2.qc_failures, e2.metrics
FROM task_events e1 JOIN task_events e2 ON e1.task_run_id = e2.task_run_id AND e1.seq = 1 AND e2.seq = 2"""


@query("task_run_upsert", TASK_STATE_SQL)
def task_run_upsert(t):
    return r.task_run_upsert(t.task_events)


@query("run_upsert", """
SELECT COALESCE(u.run_id, o.run_id) AS run_id, COALESCE(u.status, o.status) AS status,
       COALESCE(u.end_time, o.end_time) AS end_time, COALESCE(u.duration_seconds, o.duration_seconds) AS duration_seconds,
       COALESCE(u.error_message, o.error_message) AS error_message, GREATEST(u.total_tasks, CASE WHEN o.run_id IS NOT NULL THEN 3 END) AS total_tasks,
       CASE WHEN o.run_id IS NOT NULL THEN o.pipeline_id ELSE u.pipeline_id END AS pipeline_id,
       CASE WHEN u.run_id IS NOT NULL THEN u.completed_tasks ELSE 0 END AS completed_tasks,
       CASE WHEN u.run_id IS NOT NULL THEN u.failed_tasks ELSE 0 END AS failed_tasks, o.trigger_type, o.start_time
FROM pipeline_runs o FULL OUTER JOIN run_updates u ON o.run_id = u.run_id""")
def run_upsert(t):
    runs = t.pipeline_runs.select("run_id", "pipeline_id", "status", "trigger_type", "start_time", "end_time",
                                  "duration_seconds", "error_message", F.lit(3).cast("bigint").alias("total_tasks"),
                                  F.lit(0).cast("bigint").alias("completed_tasks"), F.lit(0).cast("bigint").alias("failed_tasks"))
    return r.run_upsert(runs, t.run_updates)


@query("run_insert_if_absent", """
SELECT run_id, pipeline_id, status, start_time FROM pipeline_runs
UNION ALL
SELECT run_id, pipeline_id, status, NULL FROM run_updates u
WHERE NOT EXISTS (SELECT 1 FROM pipeline_runs p WHERE p.run_id = u.run_id)""")
def run_insert_if_absent(t):
    runs = t.pipeline_runs.select("run_id", "pipeline_id", "status", "start_time")
    return r.run_insert_if_absent(runs, t.run_updates.select("run_id", "pipeline_id", "status"))


@query("mark_failed_once", """
SELECT t.task_run_id, t.run_id, t.pipeline_id, t.task_id,
       CASE WHEN f.task_run_id IS NOT NULL THEN 'failed' ELSE t.status END AS status,
       CASE WHEN f.task_run_id IS NOT NULL AND t.status <> 'failed' THEN COALESCE(t.end_time, f.end_time) ELSE t.end_time END AS end_time,
       CASE WHEN f.task_run_id IS NOT NULL AND t.status <> 'failed' THEN COALESCE(t.error_message, f.error_message)
            ELSE t.error_message END AS error_message,
       f.task_run_id IS NOT NULL AND t.status <> 'failed' AS newly_failed
FROM task_runs t LEFT JOIN task_failures f ON t.task_run_id = f.task_run_id
UNION ALL
SELECT task_run_id, run_id, pipeline_id, task_id, 'failed', end_time, error_message, TRUE FROM task_failures f
WHERE NOT EXISTS (SELECT 1 FROM task_runs t WHERE t.task_run_id = f.task_run_id)""")
def mark_failed_once(t):
    tasks = t.task_runs.select("task_run_id", "run_id", "pipeline_id", "task_id", "status", "end_time", "error_message")
    return r.mark_failed_once(tasks, t.task_failures)


@query("run_backfill", """
WITH seen AS (SELECT run_id, pipeline_id, CASE WHEN state IN ('success', 'failed', 'running', 'queued') THEN state ELSE 'success' END AS status,
                     CASE WHEN LOWER(run_type) LIKE '%manual%' THEN 'manual' ELSE 'scheduled' END AS trigger_type, start_time, end_time
              FROM external_runs)
SELECT p.run_id, p.pipeline_id, CASE WHEN p.status = 'running' AND s.run_id IS NOT NULL THEN s.status ELSE p.status END AS status,
       p.trigger_type, p.start_time,
       CASE WHEN p.status = 'running' AND s.run_id IS NOT NULL THEN COALESCE(s.end_time, p.end_time) ELSE p.end_time END AS end_time
FROM pipeline_runs p LEFT JOIN seen s ON p.run_id = s.run_id
UNION ALL
SELECT run_id, pipeline_id, status, trigger_type, start_time, end_time FROM seen s
WHERE NOT EXISTS (SELECT 1 FROM pipeline_runs p WHERE p.run_id = s.run_id)""")
def run_backfill(t):
    runs = t.pipeline_runs.select("run_id", "pipeline_id", "status", "trigger_type", "start_time", "end_time")
    return r.run_backfill(runs, t.external_runs)


@query("state_reconcile", """
WITH x AS (SELECT * FROM external_tasks WHERE state IN ('success', 'failed', 'upstream_failed', 'skipped', 'running'))
SELECT t.task_run_id, t.run_id, t.task_id, COALESCE(x.state, t.status) AS status, COALESCE(x.end_time, t.end_time) AS end_time,
       (epoch_us(x.end_time) - epoch_us(x.start_time)) / 1000000.0::DOUBLE AS duration_seconds
FROM task_runs t LEFT JOIN x ON t.run_id = x.run_id AND t.task_id = x.task_id""")
def state_reconcile(t):
    tasks = t.task_runs.select("task_run_id", "run_id", "task_id", "status", "end_time").withColumn(
        "duration_seconds", F.lit(None).cast("double"))
    return r.state_reconcile(tasks, t.external_tasks, ["run_id", "task_id"], r.TASK_STATES)


# ---- alerts and metrics --------------------------------------------------------

@query("failure_alerts", """
SELECT 'TASK_FAILURE' AS alert_type, 'error' AS severity, concat('Task Failed: ', task_id) AS title,
       concat('Pipeline `', pipeline_id, '` task `', task_id, '` failed: ', substr(COALESCE(error_message, 'Unknown error'), 1, 500)) AS message,
       pipeline_id, run_id, task_id, task_run_id
FROM task_runs WHERE status = 'failed'""")
def failure_alerts(t):
    return r.failure_alerts(t.task_runs)


BREACH_SQL = """
SELECT r.run_id, r.pipeline_id, r.start_time, r.duration_seconds, p.sla_minutes::BIGINT AS sla_minutes
FROM pipeline_runs r JOIN pipelines p ON r.pipeline_id = p.pipeline_id WHERE r.duration_seconds > p.sla_minutes * 60"""


@query("sla_breaches", BREACH_SQL)
def sla_breaches(t):
    return r.sla_breaches(t.pipeline_runs, t.pipelines)


@query("alert_rules_eval", f"""
WITH late AS ({BREACH_SQL}),
counted AS (
  SELECT *, LAG(output_row_count) OVER (PARTITION BY pipeline_id, task_id ORDER BY created_at, task_run_id) AS prev
  FROM task_runs WHERE status = 'success' AND output_row_count IS NOT NULL),
found AS (
  SELECT 'task_failed' AS rule_condition, pipeline_id, run_id, task_id, CAST(NULL AS DOUBLE) AS measure FROM task_runs WHERE status = 'failed'
  UNION ALL SELECT 'sla_breach', pipeline_id, run_id, NULL, duration_seconds FROM late
  UNION ALL SELECT 'row_count_drop', pipeline_id, run_id, task_id, CAST(prev - output_row_count AS DOUBLE) * 100.0 / prev
            FROM counted WHERE prev > 0 AND output_row_count < prev)
SELECT u.rule_name, u.rule_condition, u.severity, f.pipeline_id, f.run_id, f.task_id, f.measure
FROM found f JOIN alert_rules u ON u.rule_condition = f.rule_condition AND (u.pipeline_id IS NULL OR u.pipeline_id = f.pipeline_id)
WHERE u.is_active AND (u.rule_condition <> 'row_count_drop' OR f.measure >= u.drop_pct)""")
def alert_rules_eval(t):
    return r.alert_rules_eval(t.alert_rules, t.task_runs, t.pipeline_runs, t.pipelines)


@query("daily_pipeline_metrics", f"""
WITH late AS ({BREACH_SQL})
SELECT r.pipeline_id, CAST(r.start_time AS DATE) AS metric_date, COUNT(*) AS total_runs,
       COUNT(*) FILTER (WHERE r.status = 'success') AS successful_runs, COUNT(*) FILTER (WHERE r.status = 'failed') AS failed_runs,
       {mean_sql('r.duration_seconds', 3)} AS avg_duration_seconds,
       CAST(COALESCE(SUM(r.total_rows_processed), 0) AS BIGINT) AS total_rows_processed,
       FLOOR(quantile_cont(r.duration_seconds, 0.95) * 1000000.0 + 0.5) / 1000000.0 AS p95_duration_seconds,
       COUNT(l.run_id) AS sla_breaches
FROM pipeline_runs r LEFT JOIN late l ON r.run_id = l.run_id GROUP BY 1, 2""")
def daily_pipeline_metrics(t):
    return r.daily_metrics(t.pipeline_runs, t.pipelines)


_QC_SQL = """
WITH flat AS (
  SELECT task_run_id, pipeline_id, unnest(from_json(qc_results,
    '{"checks":[{"check_type":"VARCHAR","column":"VARCHAR","passed":"BOOLEAN","count":"BIGINT","action":"VARCHAR"}]}').checks) AS c
  FROM task_quality)"""


@query("qc_results_flat", _QC_SQL + """
SELECT task_run_id, pipeline_id, c.check_type AS check_type, c."column" AS "column", c.passed AS passed, c."count" AS "count",
       c.action AS action FROM flat""")
def qc_results_flat(t):
    return r.qc_results_flat(t.task_quality)


@query("qc_check_counts", _QC_SQL + """
SELECT c.check_type AS check_type, COUNT(*) FILTER (WHERE c.passed) AS passed, COUNT(*) FILTER (WHERE NOT c.passed) AS failed
FROM flat GROUP BY 1""")
def qc_check_counts(t):
    return r.qc_check_counts(t.task_quality)


@query("lineage_edges", """
WITH flat AS (SELECT task_id, output_path, unnest(from_json(input_sources, '[{"type":"VARCHAR","path":"VARCHAR"}]')) AS s FROM task_inputs)
SELECT s.type AS source_type, s.path AS source_path, task_id, output_path, COUNT(*) AS runs FROM flat GROUP BY ALL""")
def lineage_edges(t):
    return r.lineage_edges(t.task_inputs)


@query("schema_drift", """
WITH paired AS (
  SELECT *, LAG(output_schema) OVER (PARTITION BY pipeline_id, task_id ORDER BY created_at, event_id) AS prev FROM task_schemas),
changed AS (SELECT * FROM paired WHERE prev IS NOT NULL AND prev <> output_schema),
named AS (SELECT pipeline_id, task_id, run_id, unnest(json_keys(output_schema)) AS col FROM changed
          UNION SELECT pipeline_id, task_id, run_id, unnest(json_keys(prev)) FROM changed),
typed AS (
  SELECT n.*, json_extract_string(c.prev, concat('$.', n.col)) AS old_type, json_extract_string(c.output_schema, concat('$.', n.col)) AS new_type
  FROM named n JOIN changed c ON n.run_id = c.run_id)
SELECT pipeline_id, task_id, run_id, col AS "column",
       CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' ELSE 'retyped' END AS change, old_type, new_type
FROM typed WHERE old_type IS DISTINCT FROM new_type""")
def schema_drift(t):
    return r.schema_drift(t.task_schemas)


@query("enum_normalize", "SELECT task_run_id, seq::BIGINT AS seq, LOWER(status) AS status FROM task_events")
def enum_normalize(t):
    return r.enum_normalize(t.task_events.select("task_run_id", "seq", "status"))


@query("retry_stats", """
SELECT pipeline_id, task_id, MAX(attempt_number)::BIGINT AS max_attempt, COUNT(*) FILTER (WHERE attempt_number > 1) AS retries,
       COUNT(*) AS attempts FROM task_runs GROUP BY 1, 2""")
def retry_stats(t):
    return r.retry_stats(t.task_runs)


@query("artifact_catalog", """
SELECT output_path, pipeline_id, run_id, task_id, output_row_count, created_at, task_run_id FROM task_runs
WHERE status = 'success' AND output_path IS NOT NULL ORDER BY created_at DESC, task_run_id LIMIT 500""")
def artifact_catalog(t):
    return r.artifact_catalog(t.task_runs)


@query("artifact_tree", """
SELECT pipeline_id, run_id, COUNT(*) AS outputs, CAST(COALESCE(SUM(output_row_count), 0) AS BIGINT) AS total_rows
FROM task_runs WHERE status = 'success' AND output_path IS NOT NULL AND contains(LOWER(pipeline_id), 'p1') GROUP BY 1, 2""")
def artifact_tree(t):
    return r.artifact_tree(t.task_runs, "P1")
