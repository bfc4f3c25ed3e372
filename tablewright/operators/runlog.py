"""Analytics and upkeep of the run log.

The log is append-only event rows; the latest state of a key is a fold over its
events. Folds use ``max_by`` and other mergeable aggregates, and newest-row lookups
use a ranked filter that Spark limits on the map side, so a pipeline that owns a
large share of the log does not end up in one task.

``as_of`` stands for the present everywhere, which keeps results repeatable.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tablewright.functions.numeric import half_up, mean_of
from tablewright.operators.merge import absent_rows, insert_if_absent, new, upsert
from tablewright.operators.ordered import newest_per_key, percentile_bracket, percentile_within, with_previous
from tablewright.session import scratch_path, shared_root

RUN_STATES = ["success", "failed", "running", "queued"]
TASK_STATES = ["success", "failed", "upstream_failed", "skipped", "running"]

# Dashboard windows in minutes.
WINDOWS = {"15m": 15, "30m": 30, "1h": 60, "6h": 360, "12h": 720, "1d": 1440, "7d": 10080, "30d": 43200}


def instant(as_of: str | Column) -> Column:
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp_ntz")


def ago(as_of: str | Column, minutes: int) -> Column:
    """The instant ``minutes`` before ``as_of``."""
    return instant(as_of) - F.expr(f"INTERVAL '{minutes}' MINUTE")


def day_start(as_of: str | Column) -> Column:
    return F.date_trunc("day", instant(as_of)).cast("timestamp_ntz")


def hour_of(column: str) -> Column:
    return F.date_trunc("hour", column).cast("timestamp_ntz")


def exact(seconds: Column) -> Column:
    """Durations add up exactly as DECIMAL, whatever order the partial sums arrive in."""
    return seconds.cast("decimal(20,6)")


def mean_seconds(condition: Column | None = None, digits: int = 1) -> Column:
    value = F.col("duration_seconds") if condition is None else F.when(condition, F.col("duration_seconds"))
    return F.coalesce(mean_of(F.sum(exact(value)), F.count(value), digits), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, NULL when there is no whole."""
    return half_up(part.cast("double") * 100.0 / F.nullif(whole, F.lit(0)), digits)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of a total order; Spark keeps only the rows up to the page end per task."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """Filter by every value that is given; a list means any of its values."""
    for column, value in wanted.items():
        if value is None:
            continue
        df = df.where(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == F.lit(value))
    return df


# ---- configs -------------------------------------------------------------------

def active_pipeline_configs(configs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Active configs of active pipelines."""
    active = pipelines.where(F.col("status") == "active").select("pipeline_id")
    return configs.where("is_active").join(active, "pipeline_id")


def substitutions(env: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    """``${key}`` names an environment defines: buckets plain, registries and secrets prefixed."""
    out = {k: str(v) for k, v in env.get("s3_buckets", {}).items()}
    out |= {f"registry.{k}": str(v) for k, v in env.get("container_registries", {}).items()}
    return out | {f"secret.{k}": str(v) for k, v in env.get("secrets", {}).items()}


def resolve_placeholders(text: Column, values: Mapping[str, str]) -> Column:
    """Replace ``${key}`` in one pass over the JSON text, values escaped for it; unknown keys stay as they are."""
    if not values:
        return text
    lookup = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, json.dumps(v, ensure_ascii=False)[1:-1])])

    def fill(piece: Column) -> Column:
        end = F.instr(piece, "}")
        value = F.element_at(lookup, F.substring(piece, F.lit(1), end - 1))
        rest = F.substring(piece, end + 1, F.length(piece))
        return F.when((end > 1) & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("${"), piece))

    pieces = F.split(text, r"\$\{", -1)
    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), fill)
    return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))


def config_versions(configs: DataFrame, pipeline_id: str | None = None, version: str | None = None) -> DataFrame:
    """Versions newest first."""
    found = matching(configs, pipeline_id=pipeline_id, version=version)
    return found.orderBy(F.desc("created_at"), "pipeline_id", "version")


def config_activate(configs: DataFrame, requests: DataFrame, order: Sequence[str] = ("version",)) -> DataFrame:
    """Make the requested version of each pipeline its only active one, adding it when new.

    Requests follow one another by ``order``: every version is added, the newest is
    the active one.
    """
    newest_first = [F.desc(c) for c in order] + [F.desc("config")]
    requests = one_per_key(requests, ["pipeline_id", "version"], newest_first)
    newest = one_per_key(requests, ["pipeline_id"], newest_first)
    asked = newest.select("pipeline_id", F.struct("version", "config").alias("_asked"))
    known, chosen = F.col("_asked").isNotNull(), F.col("version") == F.col("_asked.version")
    changes = {
        "is_active": F.when(known, chosen).otherwise(F.col("is_active")),
        "config": F.when(chosen, F.col("_asked.config")).otherwise(F.col("config")),
    }
    updated = configs.join(asked, "pipeline_id", "left").select(*[
        changes[c].alias(c) if c in changes else F.col(c) for c in configs.columns
    ])
    added = absent_rows(configs, requests, ["pipeline_id", "version"]).join(asked, "pipeline_id").withColumn("is_active", chosen)
    return updated.unionByName(added.select(*requests.columns, "is_active", F.lit(True).alias("is_valid")), allowMissingColumns=True)


_TASKS = "STRUCT<tasks: ARRAY<STRUCT<task_id: STRING, depends_on: ARRAY<STRING>>>>"


def config_tasks(config: Column) -> Column:
    return F.from_json(config, _TASKS)["tasks"]


def downstream(config: Column, task_id: Column) -> Column:
    """The task and everything that depends on it, directly or not, from one config; the config is parsed once.

    For configs of some dozen tasks: as many rounds as there are tasks, each over all
    of them. ``downstream_tasks`` takes graphs of any size.
    """
    def closed(tasks: Column) -> Column:
        def step(reached: Column, _round: Column) -> Column:
            ready = F.filter(tasks, lambda t: F.arrays_overlap(F.coalesce(t["depends_on"], F.array()), reached))
            return F.array_union(reached, F.transform(ready, lambda t: t["task_id"]))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(tasks), F.lit(1))), F.array(task_id), step)

    return F.get(F.transform(F.array(config_tasks(config)), closed), F.lit(0))


_EDGES = "ARRAY<STRUCT<parent: STRING, child: STRING>>"
FEW_EDGES = 64  # a config of so many dependencies is followed within its row


def config_edges(config: Column) -> Column:
    """``(parent, child)`` of every dependency in a config, as an array."""
    def of(task: Column) -> Column:
        parents = F.coalesce(task["depends_on"], F.array().cast("array<string>"))
        return F.transform(parents, lambda p: F.struct(p.alias("parent"), task["task_id"].alias("child")))

    return F.coalesce(F.flatten(F.transform(config_tasks(config), of)), F.array().cast(_EDGES))


def reached_from(start: str, edges: Column) -> Column:
    """``start`` and all that follows from it along the edges of the row, in passes until one adds nothing."""
    def follow(reached: Column, edge: Column) -> Column:
        met = F.coalesce(F.array_contains(reached, edge["parent"]), F.lit(False))
        return F.when(met, F.array_union(reached, F.array(edge["child"]))).otherwise(reached)

    def once(state: Column, _pass: Column) -> Column:
        def told(grown: Column) -> Column:
            return F.struct(grown.alias("reached"), (F.size(grown) > F.size(state["reached"])).alias("open"))

        more = F.get(F.transform(F.array(F.aggregate(edges, state["reached"], follow)), told), F.lit(0))
        return F.when(state["open"], more).otherwise(state)

    begin = F.struct(F.array(F.lit(start)).alias("reached"), F.lit(True).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.size(edges) + 1), begin, once)["reached"]


def downstream_tasks(configs: DataFrame, start: str, keys: Sequence[str] = ("pipeline_id", "version")) -> DataFrame:
    """``(keys, task_id)``: in every config the task ``start`` and all that depends on it, directly or not.

    A config with at most ``FEW_EDGES`` dependencies that is the only one of its keys is
    followed within its row. Larger ones, and the dependencies of several configs with
    equal keys, which make one graph, go through a fixpoint over edges. Parsed
    configs are written once, as both read them. A config that lacks a key has ``start`` alone.
    """
    keys = list(keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    parsed = configs.where(known).select(*keys, config_edges(F.col("config")).alias("_edges"))
    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    graphs = parsed.withColumn("_few", alone & (F.size("_edges") <= FEW_EDGES))
    seen, path = Observation(), scratch_path(configs.sparkSession, "graphs")
    graphs.observe(seen, F.count_if(~F.col("_few")).alias("others")).write.parquet(path)
    graphs = configs.sparkSession.read.parquet(path)
    few = graphs.where("_few").select(*keys, F.explode(reached_from(start, F.col("_edges"))).alias("task_id"))
    unnamed = configs.where(~known).select(*keys, F.lit(start).alias("task_id")).distinct()
    found = few.unionByName(unnamed)
    return found.unionByName(_fixpoint(graphs.where(~F.col("_few")), start, keys)) if seen.get["others"] else found


def _fixpoint(graphs: DataFrame, start: str, keys: list[str]) -> DataFrame:
    """``(keys, task_id)`` over the edges of all graphs at once.

    A round adds what is as many steps away as all rounds before have covered, from
    paths of that length, which are then joined to paths of twice the length; so a chain of n tasks takes log n rounds.
    It stops when a round adds nothing, also where tasks depend on each other in a circle.
    Rounds are checkpointed, which keeps plans short and survives lost executors.
    """
    shared_root(graphs.sparkSession)
    reached = graphs.select(*keys, F.lit(start).alias("task_id")).distinct().checkpoint()
    edges = graphs.select(*keys, F.explode("_edges").alias("e"))
    paths = edges.select(*keys, "e.parent", "e.child").distinct().checkpoint()
    while True:
        found = reached.withColumnRenamed("task_id", "parent").join(paths, [*keys, "parent"]).select(*keys, F.col("child").alias("task_id"))
        added = found.distinct().join(reached, [*keys, "task_id"], "left_anti").checkpoint()
        if added.isEmpty():
            return reached
        reached = reached.unionByName(added).checkpoint()
        onward = paths.select(*keys, F.col("parent").alias("child"), F.col("child").alias("_end"))
        paths = paths.join(onward, [*keys, "child"]).select(*keys, "parent", F.col("_end").alias("child")).distinct().checkpoint()


# ---- listings ------------------------------------------------------------------

def search_pipelines(
    pipelines: DataFrame, status: str | None = None, source_type: str | None = None,
    search: str | None = None, number: int = 1, size: int = 50,
) -> DataFrame:
    found = matching(pipelines, status=status, source_type=source_type)
    if search:
        found = found.where(F.col("pipeline_id").ilike(f"%{search}%") | F.col("name").ilike(f"%{search}%"))
    return page(found, [F.asc("pipeline_id")], number, size)


def latest_run_per_pipeline(pipelines: DataFrame, runs: DataFrame) -> DataFrame:
    """Every pipeline with its newest run, NULL when it has none."""
    newest = newest_per_key(runs, ["pipeline_id"], [F.desc("created_at"), F.desc("run_id")])
    last = newest.select(
        "pipeline_id", "run_id", F.col("status").alias("run_status"), "start_time", "duration_seconds"
    )
    return pipelines.join(last, "pipeline_id", "left")


def runs_page(runs: DataFrame, pipeline_id=None, status=None, number: int = 1, size: int = 50) -> DataFrame:
    return page(matching(runs, pipeline_id=pipeline_id, status=status), [F.desc("created_at"), F.asc("run_id")], number, size)


def tasks_page(
    tasks: DataFrame, pipeline_id=None, run_id=None, status=None, number: int = 1, size: int = 100
) -> DataFrame:
    found = matching(tasks, pipeline_id=pipeline_id, run_id=run_id, status=status)
    return page(found, [F.desc("created_at"), F.asc("task_run_id")], number, size)


def with_config_position(tasks: DataFrame, configs: DataFrame) -> DataFrame:
    """Task rows with the place of their task in the pipeline's newest active config.

    Tasks the config does not name come after it.
    """
    active = newest_per_key(
        configs.where("is_active"), ["pipeline_id"], [F.desc("created_at"), F.desc("version")]
    )
    named = active.select("pipeline_id", F.transform(config_tasks(F.col("config")), lambda t: t["task_id"]).alias("_ids"))
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    # the last mention of a repeated task id counts
    place = F.array_position(F.reverse(ids), F.col("task_id"))
    position = F.when(place > 0, F.size(ids) - place).otherwise(F.size(ids))
    return tasks.join(named, "pipeline_id", "left").withColumn("config_position", position).drop("_ids")


def run_detail_tasks(tasks: DataFrame, configs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Tasks of a run in config order, then by start with open starts last.

    Without a run the tasks of all runs come with their ``config_position``, unsorted.
    """
    placed = with_config_position(matching(tasks, run_id=run_id), configs)
    return placed if run_id is None else placed.orderBy(
        "run_id", "config_position", F.asc_nulls_last("start_time"), "created_at", "task_run_id"
    )


def latest_task_attempt(tasks: DataFrame) -> DataFrame:
    order = [F.desc("created_at"), F.desc("attempt_number"), F.desc("task_run_id")]
    return newest_per_key(tasks, ["run_id", "task_id"], order)


def audit_search(
    logs: DataFrame, pipeline_id=None, run_id=None, event_type=None, user=None, severity=None,
    number: int = 1, size: int = 100,
) -> DataFrame:
    """Audit events newest first; ``event_type`` may be a list."""
    found = matching(logs, pipeline_id=pipeline_id, run_id=run_id, event_type=event_type, user_name=user, severity=severity)
    return page(found, [F.desc("logged_at"), F.asc("id")], number, size)


def alerts_search(alerts: DataFrame, pipeline_id=None, resolved=None, severity=None, number: int = 1, size: int = 50):
    found = matching(alerts, pipeline_id=pipeline_id, is_resolved=resolved, severity=severity)
    return page(found, [F.desc("fired_at"), F.asc("id")], number, size)


def active_connections(connections: DataFrame) -> DataFrame:
    return connections.where("is_active").orderBy("connection_id")


def deployments_recent(
    deployments: DataFrame, pipeline_id=None, status=None, environment=None, number: int = 1, size: int = 100,
) -> DataFrame:
    found = matching(deployments, pipeline_id=pipeline_id, status=status, environment=environment)
    return page(found, [F.desc("submitted_at"), F.desc("deployment_number")], number, size)


def pending_approvals(deployments: DataFrame) -> DataFrame:
    return deployments.agg(F.count_if(F.col("status") == "pending_approval").alias("pending"))


def compute_jobs_recent(
    jobs: DataFrame, order: Sequence[Column], pipeline_id=None, status=None, number: int = 1, size: int = 100,
) -> DataFrame:
    return page(matching(jobs, pipeline_id=pipeline_id, status=status), order, number, size)


def compute_job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs running, failed and finished; ``completed`` counts as success."""
    state = F.col("status")
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state == "running").alias("running"),
        F.count_if(state == "failed").alias("failed"),
        F.count_if(state.isin("success", "completed")).alias("success"),
    )


# ---- dashboards ----------------------------------------------------------------

def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row frames as one wide row: stacked with NULLs, then folded."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def kpi_dashboard(runs: DataFrame, alerts: DataFrame, tasks: DataFrame, as_of: str) -> DataFrame:
    """The nine dashboard numbers; one pass over the rows of each table that count for any of them."""
    today = F.col("created_at") >= day_start(as_of)
    ok, bad, live = F.col("status") == "success", F.col("status") == "failed", F.col("status").isin("running", "queued")
    of_runs = runs.where(today | live).agg(
        F.count_if(live).alias("active_runs"),
        F.count_if(today).alias("today_runs"),
        F.count_if(today & ok).alias("today_success"),
        F.count_if(today & bad).alias("today_failed"),
        mean_seconds(today & ok).alias("avg_duration_seconds"),
        F.coalesce(F.sum(F.when(today, F.col("total_rows_processed"))), F.lit(0)).alias("rows_today"),
    ).withColumn("success_rate", F.coalesce(percent(F.col("today_success"), F.col("today_runs")), F.lit(0.0)))
    of_alerts = alerts.where(~F.col("is_resolved")).agg(F.count(F.lit(1)).alias("active_alerts"))
    of_tasks = tasks.where(today & bad).agg(F.count(F.lit(1)).alias("failed_tasks_today"))
    return side_by_side(of_runs, of_alerts, of_tasks)


def throughput_hourly(runs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return (
        runs.where(F.col("start_time") >= ago(as_of, hours * 60)).groupBy(hour_of("start_time").alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.coalesce(F.sum("total_rows_processed"), F.lit(0)).alias("rows_processed"),
            mean_seconds().alias("avg_duration"),
        )
        .orderBy("hour")
    )


def panel_active_runs(runs: DataFrame, as_of: str) -> DataFrame:
    live = F.col("status").isin("running", "queued") & (F.col("start_time") > ago(as_of, 60))
    return runs.where(live).agg(F.count(F.lit(1)).alias("value"))


def panel_runs_today(runs: DataFrame, as_of: str) -> DataFrame:
    return runs.where(F.col("start_time") >= day_start(as_of)).agg(F.count(F.lit(1)).alias("value"))


def panel_success_rate(runs: DataFrame, as_of: str) -> DataFrame:
    recent = runs.where(F.col("start_time") > ago(as_of, 1440))
    counted = recent.agg(F.count_if(F.col("status") == "success").alias("ok"), F.count(F.lit(1)).alias("n"))
    return counted.select(percent(F.col("ok"), F.col("n")).alias("value"))


def panel_open_alerts(alerts: DataFrame, as_of: str) -> DataFrame:
    return alerts.where(~F.col("is_resolved") & (F.col("fired_at") > ago(as_of, 1440))).agg(F.count(F.lit(1)).alias("value"))


def _recent_hours(runs: DataFrame, as_of: str):
    return runs.where(F.col("start_time") > ago(as_of, 1440)).groupBy(hour_of("start_time").alias("time"))


def panel_runs_per_hour(runs: DataFrame, as_of: str) -> DataFrame:
    return _recent_hours(runs, as_of).agg(
        F.count(F.lit(1)).alias("value"), F.count_if(F.col("status") == "success").alias("success")
    ).orderBy("time")


def panel_rows_per_hour(runs: DataFrame, as_of: str) -> DataFrame:
    rows = F.coalesce(F.sum("total_rows_processed"), F.lit(0))
    return _recent_hours(runs, as_of).agg(rows.alias("value")).orderBy("time")


def panel_failed_tasks(tasks: DataFrame, as_of: str, number: int = 1, size: int = 50) -> DataFrame:
    """Newest failed tasks of the last day, a page of them."""
    found = tasks.where((F.col("status") == "failed") & (F.col("start_time") > ago(as_of, 1440)))
    return page(found, [F.desc("start_time"), F.asc("task_run_id")], number, size).select(
        "task_run_id", "pipeline_id", "task_id", "task_type", "error_message", "start_time"
    )


def kpi_windowed(runs: DataFrame, as_of: str, fallback_rate: float = 0.0) -> DataFrame:
    """Running, failed and successful runs for each dashboard window, in one pass.

    Every window is a set of conditional counts in the same aggregate, so no row is
    repeated per window.
    """
    states = ("running", "failed", "success")
    counts = [
        F.count_if((F.col("start_time") >= ago(as_of, minutes)) & (F.col("status") == state)).alias(f"{state}_{minutes}")
        for minutes in WINDOWS.values() for state in states
    ]
    rows = [
        F.struct(F.lit(label).alias("time_window"), *[F.col(f"{s}_{minutes}").alias(s) for s in states])
        for label, minutes in WINDOWS.items()
    ]
    longest = F.col("start_time") >= ago(as_of, max(WINDOWS.values()))
    unpivoted = runs.where(longest & F.col("status").isin(*states)).agg(*counts).select(F.explode(F.array(*rows)).alias("w")).select("w.*")
    done = F.col("success") + F.col("failed")
    rate = F.coalesce(percent(F.col("success"), done, 0), F.lit(fallback_rate))
    return unpivoted.withColumn("success_rate", rate)


def duration_series(runs: DataFrame, as_of: str, minutes: int = 1440) -> DataFrame:
    """Start and duration in minutes of each run; other states are drawn as running."""
    known = F.when(F.col("status").isin("success", "failed"), F.col("status")).otherwise("running")
    length = half_up(F.coalesce("duration_seconds", F.lit(0.0)) / 60.0, 1)
    return runs.where(F.col("start_time") >= ago(as_of, minutes)).select(
        "run_id", "pipeline_id", "start_time", length.alias("duration_minutes"), "status", known.alias("series")
    )


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("running", "failed", "success")])


def run_rollup(tasks: DataFrame) -> DataFrame:
    """Tasks folded per run: span, counts, rows and one state; a task without its pipeline takes the run's."""
    state = F.col("status")
    folded = (
        F.when(F.bool_or(state == "running"), "running").when(F.bool_or(state == "failed"), "failed")
        .when(F.every(state == "success"), "success").otherwise("pending")
    )
    return tasks.groupBy("run_id").agg(
        F.max("pipeline_id").alias("pipeline_id"),
        F.min("start_time").alias("min_start"), F.max("end_time").alias("max_end"),
        F.count(F.lit(1)).alias("tasks"), F.count_if(state == "success").alias("success"),
        F.count_if(state == "failed").alias("failed"),
        F.coalesce(F.sum("output_row_count"), F.lit(0)).alias("total_rows"), folded.alias("status"),
    )


# ---- state folds ---------------------------------------------------------------

def declared_tasks(configs: DataFrame) -> DataFrame:
    """``(pipeline_id, total_tasks)``: how many tasks the active config of a pipeline declares."""
    tasks = F.from_json("config", "tasks array<struct<task_id string>>")["tasks"]
    sizes = configs.where("is_active").select("pipeline_id", F.when(tasks.isNotNull(), F.size(tasks)).otherwise(0).cast("bigint").alias("total_tasks"))
    return sizes.groupBy("pipeline_id").agg(F.max("total_tasks").alias("total_tasks"))


def run_counters(events: DataFrame, declared: DataFrame, stored: DataFrame | None = None, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Completed and failed attempts and rows per run from the task event log.

    Events are folded to one final state per attempt first, so a replayed event counts
    once. ``declared`` has the tasks of each pipeline, ``stored`` the total that a run
    has on record; the larger holds, and a run without either has a total of 0.
    ``ended_at`` is when so many attempts had ended as the run has tasks, and
    ``failed_by_then`` counts the failures among these.
    """
    attempts = task_run_upsert(events, order).select(
        "task_run_id", "run_id", "pipeline_id", "status", "start_time", "end_time", "output_row_count"
    )
    attempts = attempts.join(declared.select("pipeline_id", F.col("total_tasks").alias("_declared")), "pipeline_id", "left")
    total = F.col("_declared")
    if stored is not None:
        attempts = attempts.join(stored.select("run_id", F.col("total_tasks").alias("_stored")), "run_id", "left")
        total = F.greatest("_declared", "_stored")
    over = F.col("status").isin("success", "failed")
    along = Window.partitionBy("run_id").orderBy(F.when(over, 0).otherwise(1), F.col("end_time").asc_nulls_last(), "task_run_id")
    ranked = attempts.withColumn("_total", F.coalesce(total, F.lit(0)).cast("bigint")).withColumn("_rank", F.row_number().over(along))
    return ranked.groupBy("run_id").agg(
        F.max("pipeline_id").alias("pipeline_id"),
        F.count_if(F.col("status") == "success").alias("completed_tasks"),
        F.count_if(F.col("status") == "failed").alias("failed_tasks"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("output_row_count"))), F.lit(0)).alias("total_rows_processed"),
        F.max("_total").alias("total_tasks"),
        F.min("start_time").alias("start_time"),
        F.min(F.when(over & (F.col("_rank") >= F.col("_total")), F.col("end_time"))).alias("ended_at"),
        F.count_if((F.col("status") == "failed") & (F.col("_rank") <= F.col("_total"))).alias("failed_by_then"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds, whatever the session time zone."""
    elapsed = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    return elapsed.cast("interval second").cast("decimal(18,6)").cast("double")


def run_finalize(counters: DataFrame) -> DataFrame:
    """Runs with as many ended attempts as tasks get a final state, end and duration; the rest keep running."""
    ended = (F.col("total_tasks") > 0) & (F.col("completed_tasks") + F.col("failed_tasks") >= F.col("total_tasks"))
    final = F.when(F.col("failed_by_then") > 0, "failed").otherwise("success")
    end = F.when(ended, F.col("ended_at"))
    return counters.select(
        "run_id", "pipeline_id", F.when(ended, final).otherwise("running").alias("status"),
        "total_tasks", "completed_tasks", "failed_tasks", "total_rows_processed", "start_time",
        end.alias("end_time"), seconds_between(F.col("start_time"), end).alias("duration_seconds"),
    )


# what the events of an attempt write: some columns keep their last known value, some
# follow the newest event, also into NULL, and some stay as first written
KNOWN = ["run_id", "pipeline_id", "task_id", "output_row_count", "output_path", "output_table", "output_size_bytes", "output_schema"]
NEWEST = ["status", "end_time", "duration_seconds", "qc_results", "qc_passed", "qc_warnings", "qc_failures", "error_message", "error_traceback", "metrics"]
FIRST = ["start_time", "task_type", "attempt_number", "max_attempts", "input_sources", "queued_at", "task_config_snapshot", "worker_host"]


def _held(columns: Sequence[str], df: DataFrame) -> list[str]:
    return [c for c in columns if c in df.columns]


def _fold_marks(rows: DataFrame, newest: Column, first: Column, known: Mapping[str, Column]) -> DataFrame:
    """One row per attempt.

    The structs are built by the aggregate and not below it, so that what Spark sorts are
    the flat rows, a third of their size.
    """
    latest = [F.max(value).alias(f"known_{c}") for c, value in known.items()]
    return rows.groupBy("task_run_id").agg(F.max(newest).alias("newest"), F.min(first).alias("first"), *latest)


def task_marks(events: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Task events folded to one row per attempt that still says at which event each value was written.

    Two such tables fold into one with ``merge_marks``, in any order and however often.
    Events are dealt by attempt before they are folded: Spark sorts what it folds by
    structs, and the partition of a scan can be of any size, that of a shuffle is bounded.
    """
    return _fold_marks(events.repartition("task_run_id"), *_marks_of(events, order))


def event_marks(events: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Every task event as a row of its own in the form of ``task_marks``; nothing is folded or shuffled yet."""
    newest, first, known = _marks_of(events, order)
    return events.select("task_run_id", newest.alias("newest"), first.alias("first"), *[m.alias(f"known_{c}") for c, m in known.items()])


def _marks_of(events: DataFrame, order: Sequence[str]) -> tuple[Column, Column, dict[str, Column]]:
    at = F.struct(*order).alias("at")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("value"))) for c in _held(KNOWN, events)}
    return F.struct(at, *_held(NEWEST, events)), F.struct(at, *_held(FIRST, events)), known


def merge_marks(one: DataFrame, other: DataFrame, slices: int | None = None) -> DataFrame:
    """Both tables folded into one, in ``slices`` parts dealt by attempt (None: as many as Spark takes).

    Rows travel flat, as structs inside a row take about twice the bytes, and with the
    orders of all events side by side, which compresses well.
    """
    both = one.unionByName(other)
    orders, others, built = [], [], {}
    for mark in both.schema:
        if mark.name == "task_run_id":
            continue
        at = [f"{mark.name}.at.{f.name}" for f in mark.dataType["at"].dataType]
        values = [f"{mark.name}.{f.name}" for f in mark.dataType if f.name != "at"]
        orders += [F.col(path).alias(path) for path in at]
        others += [F.col(path).alias(path) for path in values]
        at, values = ([F.col(f"`{path}`").alias(path.rpartition(".")[2]) for path in paths] for paths in (at, values))
        built[mark.name] = F.struct(F.struct(*at).alias("at"), *values)
    dealt = both.select("task_run_id", *orders, *others).repartition(*([slices] if slices else []), "task_run_id")
    # a value that no event has written has no mark
    known = {c.removeprefix("known_"): F.when(F.col(f"`{c}.value`").isNotNull(), m) for c, m in built.items() if c.startswith("known_")}
    return _fold_marks(dealt, built["newest"], built["first"], known)


def marked_state(marks: DataFrame) -> DataFrame:
    """The state of every attempt from its marks; no aggregate."""
    newest, first = ([f.name for f in marks.schema[c].dataType if f.name != "at"] for c in ("newest", "first"))
    status = {"status": F.lower("newest.status").alias("status")}
    return marks.select(
        "task_run_id", *[F.col(f"{c}.value").alias(c.removeprefix("known_")) for c in marks.columns if c.startswith("known_")],
        *[F.col(f"first.{c}") for c in first], *[status.get(c, F.col(f"newest.{c}")) for c in newest],
    )


def task_run_upsert(events: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Task events folded to one row per attempt.

    State, end, checks, metrics and error come from the newest event; outputs keep
    their last known value, as do run, pipeline and task, which single events may lack;
    the start and what describes the attempt stay as first written. Columns the events
    lack are left out. Repeated events change nothing; of different events of one
    order the larger row counts as newer.
    """
    return marked_state(task_marks(events, order))


def one_per_key(updates: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The newest update of each key, so that repeated ones do not multiply target rows.

    An update without its key names no row and is left out.
    """
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return newest_per_key(updates.where(named), keys, newest_first)


def run_upsert(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Runs after one batch of updates: state and counters replaced, gaps filled, task count never shrinking.

    Of several updates of a run the one that ends last counts, one without an end first.
    """
    updates = one_per_key(updates, ["run_id"], [F.desc("end_time"), F.asc("status")])
    filled = {c: F.coalesce(new(c), F.col(c)) for c in ("end_time", "duration_seconds", "error_message")}
    changes = {"status": new("status"), "total_tasks": F.greatest(new("total_tasks"), "total_tasks"), **filled}
    changes |= {c: new(c) for c in ("completed_tasks", "failed_tasks") if c in runs.columns and c in updates.columns}
    return upsert(runs, updates, ["run_id"], changes)


def run_insert_if_absent(runs: DataFrame, started: DataFrame) -> DataFrame:
    return insert_if_absent(runs, started, ["run_id"])


def mark_failed_once(tasks: DataFrame, failures: DataFrame, error_chars: int = 2000) -> DataFrame:
    """Task runs after failure reports, with ``newly_failed`` on the rows this batch failed.

    Of an error the first ``error_chars`` characters are kept. A row already failed is left alone; a report without a row adds one; of repeated
    reports the one with the latest end counts. Summing
    ``newly_failed`` per run gives the amount to add to its failure counter.
    """
    failures = one_per_key(failures, ["task_run_id"], [F.desc("end_time"), F.asc("error_message")])
    reports = failures.withColumns({
        "status": F.lit("failed"), "newly_failed": F.lit(True), "error_message": F.substring("error_message", 1, error_chars),
    })
    open_ = F.col("status") != "failed"
    changes = {
        "status": new("status"),
        "newly_failed": F.coalesce(open_, F.lit(False)),
        **{c: F.when(open_, F.coalesce(F.col(c), new(c))).otherwise(F.col(c)) for c in ("end_time", "error_message")},
    }
    return upsert(tasks.withColumn("newly_failed", F.lit(False)), reports, ["task_run_id"], changes)


def run_backfill(runs: DataFrame, external: DataFrame) -> DataFrame:
    """Runs after taking over an external list: rows still running follow it, unknown runs are added."""
    state = F.when(F.col("state").isin(RUN_STATES), F.col("state")).otherwise("success")
    trigger = F.when(F.lower("run_type").contains("manual"), "manual").otherwise("scheduled")
    seen = external.where(F.length("run_id") > 0).select(
        "run_id", "pipeline_id", state.alias("status"), trigger.alias("trigger_type"), "start_time", "end_time"
    )
    seen = one_per_key(seen, ["run_id"], [F.desc("end_time"), F.desc("start_time"), F.asc("status"), F.asc("trigger_type")])
    running = F.col("status") == "running"
    changes = {
        "status": F.when(running, new("status")).otherwise(F.col("status")),
        "end_time": F.when(running, F.coalesce(new("end_time"), "end_time")).otherwise(F.col("end_time")),
    }
    return upsert(runs, seen, ["run_id"], changes)


def state_reconcile(rows: DataFrame, external: DataFrame, keys: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Rows follow an external state table; states outside ``states`` are ignored.

    The end is taken when reported, and the duration when both ends are known.
    """
    news = external.where(F.col("state").isin(list(states))).select(
        *keys, F.col("state").alias("_state"), F.col("start_time").alias("_start"), F.col("end_time").alias("_end")
    )
    news = one_per_key(news, list(keys), [F.desc("_end"), F.desc("_start"), F.asc("_state")])
    found = F.col("_state").isNotNull()
    changes = {
        "status": F.when(found, F.col("_state")).otherwise(F.col("status")),
        "end_time": F.when(found, F.coalesce("_end", "end_time")).otherwise(F.col("end_time")),
        "duration_seconds": F.coalesce(
            F.when(found, seconds_between(F.col("_start"), F.col("_end"))), F.col("duration_seconds")
        ),
    }
    return rows.join(news, list(keys), "left").select(
        *[changes[c].alias(c) if c in changes else F.col(c) for c in rows.columns]
    )


# ---- alerts and metrics --------------------------------------------------------

def failure_alerts(tasks: DataFrame, error_chars: int = 500) -> DataFrame:
    """One alert per failed task; its message holds the first ``error_chars`` characters of the error."""
    message = F.concat(
        F.lit("Pipeline `"), "pipeline_id", F.lit("` task `"), "task_id", F.lit("` failed: "),
        F.substring(F.coalesce("error_message", F.lit("Unknown error")), 1, error_chars),
    )
    return tasks.where(F.col("status") == "failed").select(
        F.lit("TASK_FAILURE").alias("alert_type"), F.lit("error").alias("severity"),
        F.concat(F.lit("Task Failed: "), "task_id").alias("title"), message.alias("message"),
        "pipeline_id", "run_id", "task_id", "task_run_id",
    )


def sla_breaches(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Runs that took longer than their pipeline allows."""
    allowed = pipelines.where(F.col("sla_minutes").isNotNull()).select("pipeline_id", "sla_minutes")
    return (
        runs.where(F.col("duration_seconds").isNotNull()).join(allowed, "pipeline_id")
        .where(F.col("duration_seconds") > F.col("sla_minutes") * 60)
        .select("run_id", "pipeline_id", "start_time", "duration_seconds", "sla_minutes")
    )


def row_count_changes(tasks: DataFrame) -> DataFrame:
    """Drop in percent of each task output against the previous run of the same task."""
    counted = tasks.where((F.col("status") == "success") & F.col("output_row_count").isNotNull()).select(
        "pipeline_id", "task_id", "run_id", "created_at", "task_run_id", "output_row_count"
    )
    paired = with_previous(counted, ["pipeline_id", "task_id"], ["created_at", "task_run_id"], ["output_row_count"])
    before, now = F.col("prev_output_row_count"), F.col("output_row_count")
    return paired.where(before > 0).withColumn(
        "drop_pct", (before - now).cast("double") * 100.0 / before
    )


def alert_rules_eval(rules: DataFrame, tasks: DataFrame, runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Alerts the active rules raise. Declared conditions: task_failed, sla_breach and row_count_drop.

    A rule without a pipeline applies to all. Each finding meets the list of its
    pipeline's rules and the list of the rules for all, and every rule of both that
    fires gives a row. The list for all stands under as many numbers as there are
    slices, and a finding looks under one of them, so no key gathers the findings
    however the lists are joined.
    """
    none = F.lit(None).cast("double")
    failed = tasks.where(F.col("status") == "failed").select(
        F.lit("task_failed").alias("rule_condition"), "pipeline_id", "run_id", "task_id", none.alias("measure")
    )
    late = sla_breaches(runs, pipelines).select(
        F.lit("sla_breach").alias("rule_condition"), "pipeline_id", "run_id",
        F.lit(None).cast("string").alias("task_id"), F.col("duration_seconds").alias("measure"),
    )
    dropped = row_count_changes(tasks).where("drop_pct > 0").select(
        F.lit("row_count_drop").alias("rule_condition"), "pipeline_id", "run_id", "task_id",
        F.col("drop_pct").alias("measure"),
    )
    found = failed.unionByName(late).unionByName(dropped)
    slices = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rule = F.collect_list(F.struct("rule_name", "severity", "drop_pct"))
    active = rules.where("is_active")
    of_pipeline = active.where(F.col("pipeline_id").isNotNull()).groupBy("rule_condition", "pipeline_id").agg(rule.alias("_own"))
    of_all = active.where(F.col("pipeline_id").isNull()).groupBy("rule_condition").agg(rule.alias("_all"))
    of_all = of_all.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = (
        found.withColumn("_slice", F.pmod(F.xxhash64("pipeline_id", "run_id", "task_id"), F.lit(slices)).cast("int"))
        .join(of_pipeline, ["rule_condition", "pipeline_id"], "left").join(of_all, ["rule_condition", "_slice"], "left")
    )
    lists = F.concat(F.coalesce("_own", F.array()), F.coalesce("_all", F.array()))
    fires = (F.col("rule_condition") != "row_count_drop") | (F.col("measure") >= F.col("_rule.drop_pct"))
    return met.withColumn("_rule", F.explode(lists)).where(fires).select(
        "_rule.rule_name", "rule_condition", "_rule.severity", "pipeline_id", "run_id", "task_id", "measure"
    )


def daily_metrics(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Declared metrics table: per pipeline and day runs, mean and p95 duration, rows and SLA breaches.

    The runs are read twice: once for all counts, with a sketch of the durations, and
    once for the exact percentile inside what the sketch leaves open.
    """
    keys = ["pipeline_id", "metric_date"]
    allowed = pipelines.groupBy("pipeline_id").agg(F.max("sla_minutes").alias("_minutes"))
    dated = runs.withColumn("metric_date", F.to_date("start_time"))
    base = dated.join(allowed, "pipeline_id", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == "success").alias("successful_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        mean_of(F.sum(exact(F.col("duration_seconds"))), F.count("duration_seconds"), 3).alias("avg_duration_seconds"),
        F.coalesce(F.sum("total_rows_processed"), F.lit(0)).alias("total_rows_processed"),
        F.count_if(F.col("duration_seconds") > F.col("_minutes") * 60).alias("sla_breaches"),
        F.count("duration_seconds").alias("_n"), percentile_bracket("duration_seconds", 0.95).alias("_bracket"),
    )
    p95 = percentile_within(dated, base.where("_n > 0"), keys, "duration_seconds", 0.95, "p95")
    return base.join(p95, keys, "left").withColumn("p95_duration_seconds", half_up(F.col("p95"), 6)).drop("p95", "_n", "_bracket")


_CHECKS = "STRUCT<checks: ARRAY<STRUCT<check_type: STRING, `column`: STRING, passed: BOOLEAN, `count`: BIGINT, action: STRING>>>"


def qc_results_flat(tasks: DataFrame) -> DataFrame:
    """One row per recorded check."""
    check = F.explode(F.from_json("qc_results", _CHECKS)["checks"])
    return tasks.select("task_run_id", "pipeline_id", check.alias("c")).select("task_run_id", "pipeline_id", "c.*")


def qc_check_counts(tasks: DataFrame) -> DataFrame:
    return qc_results_flat(tasks).groupBy("check_type").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")
    )


def lineage_edges(tasks: DataFrame) -> DataFrame:
    """Source to output, one row per recorded input, with the number of runs that used it."""
    source = F.explode(F.from_json("input_sources", "ARRAY<STRUCT<type: STRING, path: STRING>>"))
    edges = tasks.select("task_id", "output_path", source.alias("s"))
    return edges.groupBy(
        F.col("s.type").alias("source_type"), F.col("s.path").alias("source_path"), "task_id", "output_path"
    ).agg(F.count(F.lit(1)).alias("runs"))


def schema_drift(tasks: DataFrame) -> DataFrame:
    """Columns added, removed or retyped against the previous run of the same task."""
    paired = with_previous(
        tasks.select("pipeline_id", "task_id", "run_id", "created_at", "event_id", "output_schema"),
        ["pipeline_id", "task_id"], ["created_at", "event_id"], ["output_schema"],
    ).where(F.col("prev_output_schema").isNotNull() & (F.col("prev_output_schema") != F.col("output_schema")))
    kind = "MAP<STRING, STRING>"
    now, before = F.from_json("output_schema", kind), F.from_json("prev_output_schema", kind)
    names = F.array_union(F.map_keys(now), F.map_keys(before))
    changes = paired.select("pipeline_id", "task_id", "run_id", now.alias("now"), before.alias("before"),
                            F.explode(names).alias("column"))
    old, new = F.element_at("before", F.col("column")), F.element_at("now", F.col("column"))
    change = F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old != new, "retyped")
    return changes.select(
        "pipeline_id", "task_id", "run_id", "column", change.alias("change"), old.alias("old_type"), new.alias("new_type")
    ).where(F.col("change").isNotNull())


def enum_normalize(df: DataFrame, column: str = "status") -> DataFrame:
    return df.withColumn(column, F.lower(column))


def retry_stats(tasks: DataFrame) -> DataFrame:
    """Highest attempt and number of retried attempts per task."""
    return tasks.groupBy("pipeline_id", "task_id").agg(
        F.max("attempt_number").alias("max_attempt"), F.count_if(F.col("attempt_number") > 1).alias("retries"),
        F.count(F.lit(1)).alias("attempts"),
    )


# ---- outputs -------------------------------------------------------------------

def outputs(tasks: DataFrame, pipeline_id=None, run_id=None) -> DataFrame:
    """Successful task outputs."""
    found = tasks.where((F.col("status") == "success") & F.col("output_path").isNotNull())
    return matching(found, pipeline_id=pipeline_id, run_id=run_id)


def artifact_catalog(tasks: DataFrame, pipeline_id=None, run_id=None, number: int = 1, size: int = 500) -> DataFrame:
    """Newest outputs, a page of them."""
    listed = page(outputs(tasks, pipeline_id, run_id), [F.desc("created_at"), F.asc("task_run_id")], number, size)
    return listed.select("output_path", "pipeline_id", "run_id", "task_id", "output_row_count", "created_at", "task_run_id")


def artifact_tree(tasks: DataFrame, search: str = "") -> DataFrame:
    """Outputs per pipeline and run, for pipelines whose id contains the search text."""
    found = outputs(tasks).where(F.lower(F.coalesce("pipeline_id", F.lit("unknown"))).contains(search.lower()))
    return found.groupBy(
        F.coalesce("pipeline_id", F.lit("unknown")).alias("pipeline_id"),
        F.coalesce("run_id", F.lit("unknown")).alias("run_id"),
    ).agg(F.count(F.lit(1)).alias("outputs"), F.coalesce(F.sum("output_row_count"), F.lit(0)).alias("total_rows"))
