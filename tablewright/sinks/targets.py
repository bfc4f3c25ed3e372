"""Load targets: databases, file folders and message topics."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.sinks.store import TableStore
from tablewright.sources.jdbc import connection_options, dialect_of

AUDIT_COLUMN = "etl_loaded_at"
MODES = {"append": "append", "overwrite": "overwrite", "replace": "overwrite", "merge": "merge", "upsert": "merge"}
BATCH_ROWS = 5000


@dataclass
class LoadReport:
    rows: int
    target_type: str
    where: str

    def __str__(self) -> str:
        return f"Loaded {self.rows} rows to {self.target_type}:{self.where}"


def write_mode(target: Mapping) -> str:
    wanted = target.get("mode", target.get("write_mode", "append"))
    if wanted not in MODES:
        raise ValueError(f"unknown write mode '{wanted}'")
    return MODES[wanted]


def drop_audit_column(df: DataFrame) -> DataFrame:
    """Leave the load time to the target's default."""
    return df.drop(AUDIT_COLUMN)


def to_messages(df: DataFrame) -> DataFrame:
    """One JSON text per row in column ``value``, NULL fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def publish(df: DataFrame, topic: str, servers: str, **options: str) -> None:
    """Send each row as a JSON message; needs the Kafka connector on the class path."""
    writer = to_messages(df).write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("topic", topic).options(**options).save()


def write_files(df: DataFrame, kind: str, path: str, mode: str = "overwrite", sep: str | None = None) -> None:
    """Parquet, CSV, TSV or JSON lines; any other kind lands as Parquet."""
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", sep or ("\t" if kind == "tsv" else ",")).csv(path)
    elif kind in ("json", "jsonl", "ndjson"):
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def qualified(dialect: str, schema: str, table: str) -> str:
    mark = {"mssql": ("[", "]"), "postgresql": ('"', '"')}.get(dialect, ("", ""))
    return ".".join(f"{mark[0]}{part}{mark[1]}" for part in (schema, table) if part)


def merge_statement(
    dialect: str, schema: str, table: str, stage: str, columns: Sequence[str], keys: Sequence[str]
) -> str:
    """The one statement a database runs to fold a staged table into its target.

    Spark's writer creates the stage with its column names quoted as they are, so on
    Oracle, where the target's names are written plainly, those of the stage are quoted.
    """
    if not keys:
        raise ValueError(f"target.keys is required when mode='merge' (task loading into {schema}.{table})")
    left, right = {"mssql": ("[", "]"), "postgresql": ('"', '"'), "oracle": ("", "")}.get(dialect, (None, None))
    if left is None:
        raise ValueError(f"merge mode is not supported for dialect: {dialect}")
    quoted = {c: f"{left}{c}{right}" for c in columns}
    target, staged = qualified(dialect, schema, table), qualified(dialect, schema, stage)
    listed = ", ".join(quoted.values())
    if dialect == "postgresql":
        others = [quoted[c] for c in columns if c not in keys]
        action = "DO UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in others) if others else "DO NOTHING"
        conflict = ", ".join(quoted[k] for k in keys)
        return f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {staged} ON CONFLICT ({conflict}) {action}"
    own = {c: f's."{c}"' if dialect == "oracle" else f"s.{quoted[c]}" for c in columns}
    match = " AND ".join(f"t.{quoted[k]} = {own[k]}" for k in keys)
    changes = ", ".join(f"t.{quoted[c]} = {own[c]}" for c in columns if c not in keys)
    update = f"WHEN MATCHED THEN UPDATE SET {changes} " if changes else ""
    values = ", ".join(own.values())
    alias = "AS " if dialect == "mssql" else ""
    end = ";" if dialect == "mssql" else ""
    return (
        f"MERGE INTO {target} {alias}t USING {staged} {alias}s ON ({match}) {update}"
        f"WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({values}){end}"
    )


def run_statement(spark: SparkSession, options: Mapping[str, str], statement: str) -> None:
    """Run one statement on the database over the driver's JDBC connection; drivers given with ``--jars`` are found too."""
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    properties = jvm.java.util.Properties()
    for key in ("user", "password"):
        if options.get(key):
            properties.setProperty(key, options[key])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        connection.createStatement().execute(statement)
    finally:
        connection.close()


def write_database(df: DataFrame, target: Mapping, generated: Sequence[str] = ()) -> None:
    """Append, truncate and append, or stage and merge over JDBC.

    ``generated`` names columns the database fills itself (row versions).
    """
    options = connection_options(target)
    dialect, mode = dialect_of(target["type"]), write_mode(target)
    schema, table = target.get("schema", "dbo"), target.get("table", "output")
    df = drop_audit_column(df).drop(*generated)
    writer = df.write.format("jdbc").options(**options).option("batchsize", BATCH_ROWS)
    if mode == "merge":
        keys = target.get("keys", [])
        stage = f"{table}_stage_{uuid.uuid4().hex[:8]}"
        statement = merge_statement(dialect, schema, table, stage, df.columns, keys)
        writer.option("dbtable", qualified(dialect, schema, stage)).mode("overwrite").save()
        try:
            run_statement(df.sparkSession, options, statement)
        finally:
            run_statement(df.sparkSession, options, f"DROP TABLE {qualified(dialect, schema, stage)}")
    elif mode == "overwrite":
        writer.option("dbtable", qualified(dialect, schema, table)).option("truncate", True).mode("overwrite").save()
    else:
        writer.option("dbtable", qualified(dialect, schema, table)).mode("append").save()


def load_target(
    df: DataFrame, target: Mapping, store: TableStore, pipeline_id: str = "default", run_id: str = "", task_id: str = "load"
) -> LoadReport:
    """Load one table into its target and report the rows written.

    ``type`` ``table`` is the Parquet store with append, overwrite and merge; an append
    needs ``run_id``, and is replaced by the same run and task again. ``s3``,
    ``parquet``, ``csv``, ``json`` write files; ``kafka`` publishes; database types
    go over JDBC.
    """
    kind = target.get("type", "s3")
    seen = Observation()
    counted = drop_audit_column(df).observe(seen, F.count(F.lit(1)).alias("rows"))
    where = target.get("path", target.get("table", "output"))
    if kind == "table":
        mode, table = write_mode(target), target.get("table", "output")
        if mode == "merge":
            store.merge(table, counted, target.get("keys", []))
        elif mode == "overwrite":
            store.overwrite(table, counted)
        else:
            store.append(table, counted, run_id, f"{pipeline_id}/{task_id}")
    elif kind in ("sqlserver", "mssql", "oracle", "postgresql", "postgres", "mysql"):
        write_database(counted, target)
    elif kind in ("kafka", "pubsub"):
        publish(counted, target.get("topic", pipeline_id), target["servers"])
    else:
        path = target.get("path") or f"{store.root}/output/{pipeline_id}/output.parquet"
        write_files(counted, kind, path)
        where = path
    return LoadReport(seen.get["rows"], kind, where)
