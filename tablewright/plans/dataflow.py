"""Run one declared pipeline: a chain of lazy DataFrames from its sources to its targets.

The order of the tasks comes from ``depends_on``. A transform sees the nearest table
producer above it: checks hand their input through. A producer is written to the
artifact store, and read back from there, when it is checked, loaded or used more than
once; otherwise it stays a plan that Spark optimises together with its consumer.
"""

from __future__ import annotations

import json
import uuid
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.sqltext import render, run_sql
from tablewright.functions.types import schema_names
from tablewright.operators.ordered import tile_borders
from tablewright.operators.quality import run_suite, schema_validate
from tablewright.operators.runlog import substitutions
from tablewright.operators.transform import routine, transform
from tablewright.sinks.store import TableStore
from tablewright.sinks.targets import load_target
from tablewright.sources.artifacts import Artifacts
from tablewright.sources.files import ingest
from tablewright.sources.jdbc import by_predicates, extract_source, partition_predicates
from tablewright.sources.messages import Offsets, decode_json, decode_json_or_raw, next_batch, read_topic

# Task types by what they do, and the table name each uses when none is given.
EXTRACTS = {"sql_extract": "raw_data", "cdc_extract": "cdc_changes"}
INGESTS = {"file_ingest": "file_data"}
CONSUMERS = {"kafka_consume": "kafka_messages", "pubsub_consume": "pubsub_messages"}
TRANSFORMS = {"duckdb_transform": "result", "sql_transform": "result", "duckdb_query": "result",
              "eks_job": "result", "eks_transform": "result"}
ROUTINES = {"stored_proc": "result"}
PRODUCERS = {**EXTRACTS, **INGESTS, **CONSUMERS, **TRANSFORMS, **ROUTINES}
CHECKS = ("data_quality", "schema_validate", "schema_validation")
MAX_MESSAGES = 10_000  # of a consumer task that says nothing else; None takes all there are
LOADS = ("load_target", "kafka_produce", "pubsub_publish")

RECORD = ("run_id string, pipeline_id string, task_id string, task_type string, status string, output_table string, "
          "output_path string, output_row_count bigint, output_size_bytes bigint, output_schema string, "
          "input_sources string, qc_passed boolean, qc_warnings int, qc_failures int, qc_results string, message string")


def resolve_config(config: Mapping, env: Mapping) -> dict:
    """Config with ``${key}`` filled in every text and connection names replaced by their definitions."""
    values = substitutions(env)

    def fill(value):
        if isinstance(value, str):
            return re.sub(r"\$\{([^}]+)\}", lambda m: values.get(m[1], m[0]), value)
        if isinstance(value, Mapping):
            return {k: fill(v) for k, v in value.items()}
        return [fill(v) for v in value] if isinstance(value, list) else value

    resolved = fill(config)
    for task in resolved.get("tasks", []):
        for part in ("source", "target"):
            section = task.get(part)
            found = env.get("connections", {}).get(section.get("connection")) if isinstance(section, dict) else None
            if found:
                task[part] = {**found, **section}
    return resolved


@dataclass
class Run:
    """Outputs of a run and its run-log rows."""

    spark: SparkSession
    pipeline_id: str
    run_id: str
    tables: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    records: list[dict] = field(default_factory=list)

    def output(self, task_id: str) -> DataFrame:
        return self.tables[task_id][1]

    def published(self) -> dict[str, DataFrame]:
        """All outputs by table name, as another pipeline sees them under this pipeline's id."""
        return dict(self.tables.values())

    def log(self) -> DataFrame:
        names = [c.split()[0] for c in RECORD.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.records], RECORD)


def task_order(config: Mapping) -> list[str]:
    """Task ids with every task after those it depends on; unknown parents and cycles raise."""
    tasks = {t["task_id"]: t for t in config.get("tasks", [])}
    parents = {k: t.get("depends_on", []) for k, t in tasks.items()}
    missing = sorted({p for ps in parents.values() for p in ps} - set(tasks))
    if missing:
        raise ValueError(f"unknown upstream tasks: {', '.join(missing)}")
    try:
        return list(TopologicalSorter(parents).static_order())
    except CycleError as error:
        raise ValueError(f"tasks depend on each other: {' -> '.join(error.args[1])}") from error


def producer_of(tasks: Mapping[str, Mapping], task_id: str, seen: frozenset = frozenset()) -> str | None:
    """The task itself when it makes a table, else the nearest producer its checks pass through."""
    if task_id in seen or task_id not in tasks:
        return None
    if tasks[task_id].get("type") in PRODUCERS:
        return task_id
    if tasks[task_id].get("type") not in CHECKS:
        return None
    found = (producer_of(tasks, p, seen | {task_id}) for p in tasks[task_id].get("depends_on", []))
    return next((p for p in found if p), None)


def run_pipeline(
    spark: SparkSession,
    config: Mapping,
    artifacts: Artifacts,
    store: TableStore,
    connections: Mapping[str, Mapping] | None = None,
    upstream: Mapping[str, Mapping[str, DataFrame]] | None = None,
    topics: Mapping[str, DataFrame | Mapping | Callable[[], DataFrame]] | None = None,
    ds: str = "",
    run_id: str | None = None,
    as_of: Column | None = None,
) -> Run:
    """Run every table task of a config; notifications and outside triggers are recorded as skipped.

    A connection is a database description, or a ``{table: frame}`` mapping to query.
    ``upstream`` holds the published tables of other pipelines by pipeline id. A re-run
    gives the ``run_id`` of the run it repeats; without one this is a new run.
    ``topics`` says where the topics and subscriptions of consumer tasks are: messages as a frame of
    value, partition and offset, a Kafka description (``{"servers": …}``), or a function that returns
    finished rows. Messages are read from where the consumer's last run ended, as its
    offsets in the store say.
    """
    run_id = run_id or f"manual-{uuid.uuid4().hex[:12]}"
    tasks = {t["task_id"]: t for t in config["tasks"]}
    pipeline_id = config["pipeline_id"]
    run = Run(spark, pipeline_id, run_id)
    order = task_order(config)
    uses = [producer_of(tasks, p) for t in tasks.values() if t.get("type") not in CHECKS for p in t.get("depends_on", [])]
    checked = {producer_of(tasks, t["depends_on"][0]) for t in tasks.values()
               if t.get("type") in CHECKS + LOADS and t.get("depends_on")}

    def keep(task: Mapping, df: DataFrame, record: dict) -> None:
        task_id, table = task["task_id"], task.get("output", {}).get("table", PRODUCERS[task["type"]])
        record["output_table"], record["output_schema"] = table, json.dumps(schema_names(df))
        if task_id in checked or uses.count(task_id) != 1 or task["type"] in ROUTINES or task["type"] in CONSUMERS:
            stats = artifacts.write(df, pipeline_id, run_id, task_id, table)
            record |= {"output_path": stats.path, "output_row_count": stats.rows, "output_size_bytes": stats.size_bytes}
            df = artifacts.scan(pipeline_id, run_id, task_id, table)
        run.tables[task_id] = (table, df)

    def upstream_of(task: Mapping) -> dict[str, dict[str, DataFrame]]:
        found = [producer_of(tasks, p) for p in task.get("depends_on", [])]
        own = {p: dict([run.tables[p]]) for p in found if p}
        return {**{k: dict(v) for k, v in (upstream or {}).items()}, **own}

    def source_frame(task: Mapping) -> DataFrame:
        """Input of a check or load: the table of its first parent."""
        return run.output(producer_of(tasks, task["depends_on"][0]))

    for task_id in order:
        task, kind = tasks[task_id], tasks[task_id].get("type", "")
        record = {"run_id": run_id, "pipeline_id": pipeline_id, "task_id": task_id, "task_type": kind, "status": "success"}
        run.records.append(record)
        record["input_sources"] = json.dumps(
            [{"type": "duckdb", "task_id": p} for p in (producer_of(tasks, d) for d in task.get("depends_on", [])) if p])
        try:
            if kind in EXTRACTS:
                keep(task, _extract(spark, task["source"], connections or {}, ds, run_id), record)
            elif kind in INGESTS:
                source = {k: render(v, ds, run_id) if isinstance(v, str) else v for k, v in task["source"].items()}
                keep(task, ingest(spark, source), record)
            elif kind in CONSUMERS:
                _consume(spark, task, topics or {}, pipeline_id, run_id, store, keep, record)
            elif kind in TRANSFORMS:
                path = task.get("source", {}).get("duckdb_path")
                explicit = {task.get("source", {}).get("table", "result"): artifacts.scan_path(path)} if path else None
                keep(task, transform(spark, task["sql"], upstream_of(task), explicit, ds, run_id), record)
            elif kind in ROUTINES:
                _routine(spark, task, upstream_of(task), keep, record, ds, run_id)
            elif kind == "data_quality":
                _check(task, source_frame(task), run, record, as_of)
            elif kind in CHECKS:
                schema_validate(source_frame(task), task.get("expected_schema", {}), task.get("fail_on_error", True))
            elif kind in LOADS:
                target = dict(task.get("target", {}))
                if kind != "load_target":
                    target.setdefault("type", kind.split("_")[0])
                report = load_target(source_frame(task), target, store, pipeline_id, run_id, task_id)
                record |= {"message": str(report), "output_row_count": report.rows, "output_table": target.get("table")}
            else:
                record["status"] = "skipped"
        except Exception as error:
            record |= {"status": "failed", "message": str(error)}
            error.run_log = run.records
            raise
    return run


def _extract(spark: SparkSession, source: Mapping, connections: Mapping, ds: str, run_id: str) -> DataFrame:
    connection = connections.get(source.get("connection"), source)
    frames = {k: v for k, v in connection.items() if isinstance(v, DataFrame)}
    if not frames:
        return extract_source(spark, connection, source, ds, run_id)
    sql = render(source.get("query") or f"SELECT * FROM {source['table']}", ds, run_id)
    rows = run_sql(spark, sql, frames)
    # the ranges that readers of a database would take, found and applied in the same way
    predicates = partition_predicates(
        source, sql, lambda q: run_sql(spark, q, frames).collect(), "spark", lambda column, tiles: tile_borders(rows, column, tiles))
    return by_predicates(rows, predicates) if predicates else rows


def _consume(spark, task, topics, pipeline_id, run_id, store, keep, record) -> None:
    """A batch of messages as the task's table; its offsets are committed once the table is written."""
    topic = task.get("topic") or task.get("subscription")
    if topic not in topics:
        raise ValueError(f"no source given for topic {topic!r}")
    source = topics[topic]
    if callable(source) and not isinstance(source, DataFrame):
        keep(task, source(), record)
        return
    offsets, consumer = Offsets(store), task.get("group_id") or f"tablewright-{pipeline_id}"
    reset = task.get("auto_offset_reset", "earliest")
    if not isinstance(source, DataFrame):
        source = read_topic(spark, source["servers"], topic, "earliest", offsets.starts(consumer, topic))
    batch, ranges = next_batch(source, offsets, consumer, topic, run_id, task["task_id"], task.get("max_messages", MAX_MESSAGES), reset)
    decode = decode_json if task["type"] == "kafka_consume" else decode_json_or_raw
    keep(task, decode(batch, task.get("schema")), record)
    offsets.commit(consumer, topic, run_id, task["task_id"], ranges)


def _routine(spark, task, inputs, keep, record, ds, run_id) -> None:
    """Result set as the task's table, OUT values in the record. Column names are kept."""
    frames = {f"{t}.{name}": df for t, tables in inputs.items() for name, df in tables.items()}
    given = {p["name"]: render(str(p["value"]), ds, run_id) for p in task.get("parameters", []) if p.get("direction", "in") == "in"}
    out = {p["name"]: F.expr(p.get("value") or "count(1)") for p in task.get("parameters", []) if p.get("direction") == "out"}
    result, seen = routine(spark, render(task["sql"], ds, run_id), frames, given, out or {"rows": F.count(F.lit(1))})
    keep(task, result, record)
    record["message"] = json.dumps(seen.get, default=str)


def _check(task: Mapping, df: DataFrame, run: Run, record: dict, as_of: Column | None) -> None:
    named = {task.get("source", {}).get("table", "raw_data"): df, **run.published()}
    result = run_suite(df, task.get("checks", []), named, as_of, fail_pipeline_on_error=False)
    record |= {
        "qc_passed": result.passed, "qc_warnings": result.warnings, "qc_failures": result.failures,
        "qc_results": json.dumps({"checks": result.results}), "status": "success" if result.passed else "failed",
    }
    if not result.passed:
        record["message"] = f"{result.failures} QC check(s) failed"
        if task.get("fail_pipeline_on_error", True):
            raise ValueError(f"Data quality failed: {result.failures} checks failed. Results: {result.results}")
