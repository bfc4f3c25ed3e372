"""SQL transforms over named upstream outputs, and parameterised routines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from tablewright.functions.sqltext import render, run_sql, safe_alias


def transform(
    spark: SparkSession,
    sql: str,
    inputs: Mapping[str, Mapping[str, DataFrame]],
    explicit: Mapping[str, DataFrame] | None = None,
    ds: str = "",
    run_id: str = "",
) -> DataFrame:
    """Run ``sql`` over ``{task: {table: frame}}``, named ``task.table`` in the text.

    ``explicit`` tables are named ``_explicit.table``. The result is lazy, so
    filters and column choices reach through it into the upstream scans.
    """
    names = {f"{safe_alias(task)}.{table}": df for task, tables in inputs.items() for table, df in tables.items()}
    names |= {f"_explicit.{table}": df for table, df in (explicit or {}).items()}
    return run_sql(spark, render(sql, ds, run_id), names)


def routine(
    spark: SparkSession,
    sql: str,
    inputs: Mapping[str, DataFrame],
    args: Mapping[str, object],
    out: Mapping[str, Column],
) -> tuple[DataFrame, Observation]:
    """A parameterised statement with a result set and OUT values.

    ``args`` are named parameters (``:name``). OUT values are aggregates taken while
    the result is written or collected; read them from the observation afterwards.
    """
    seen = Observation()
    result = run_sql(spark, sql, inputs, args)
    return result.observe(seen, *[value.alias(name) for name, value in out.items()]), seen
