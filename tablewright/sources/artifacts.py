"""Outputs of earlier tasks, found by pipeline, run and task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.functions.sqltext import safe_alias
from tablewright.sinks.store import WriteStats, path_exists, write_counted


class Artifacts:
    """``<root>/<pipeline>/<run>/<task>/<table>`` Parquet folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, pipeline_id: str, run_id: str, task_id: str, table: str) -> str:
        return f"{self.root}/{pipeline_id}/{run_id}/{task_id}/{table}"

    def write(self, df: DataFrame, pipeline_id: str, run_id: str, task_id: str, table: str) -> WriteStats:
        """Create or replace a task output; a repeated task overwrites only itself."""
        return write_counted(df, self.path(pipeline_id, run_id, task_id, table))

    def scan(self, pipeline_id: str, run_id: str, task_id: str, table: str) -> DataFrame:
        path = self.path(pipeline_id, run_id, task_id, table)
        if not path_exists(self.spark, path):
            raise ValueError(f"no output {task_id}.{table} in run {run_id} of {pipeline_id}")
        return self.spark.read.parquet(path)

    def scan_path(self, path: str) -> DataFrame:
        """An explicit input from any path."""
        return self.spark.read.parquet(path)

    def publish(self, pipeline_id: str, run_id: str, task_id: str, table: str, database: str | None = None) -> str:
        """Make an output queryable as ``<database>.<table>``, by default under its task id."""
        database = safe_alias(database or task_id)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        path = self.path(pipeline_id, run_id, task_id, table)
        self.spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{table}` AS SELECT * FROM parquet.`{path}`")
        return f"{database}.{table}"
