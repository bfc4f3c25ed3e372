"""Read-only questions over task outputs."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.sqltext import run_sql
from tablewright.functions.types import schema_names, sql_type_name

DEFAULT_ROWS, MAX_ROWS = 1000, 10_000
ALLOWED = ("SELECT", "DESCRIBE", "SHOW", "SUMMARIZE")
REFUSED = "Only SELECT / DESCRIBE / SHOW / SUMMARIZE queries are allowed in Query Explorer"
_COMMENTS = re.compile(r"\A(\s*--[^\n]*(\n|\Z))+")


def statement(sql: str) -> tuple[str, str]:
    """Verb and text of a read-only statement, leading comment lines removed; other verbs raise."""
    text = _COMMENTS.sub("", sql.strip()).strip().rstrip(";").strip()
    verb = text.split(None, 1)[0].upper() if text else ""
    if verb not in ALLOWED:
        raise ValueError(REFUSED)
    return verb, text


def explorer_alias(task_id: str) -> str:
    """Name under which a selected output is queried."""
    return re.sub(r"[^a-z0-9_]", "_", task_id.lower())


def explore(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], limit: int = DEFAULT_ROWS) -> DataFrame:
    """Answer one statement over ``{table or alias.table: frame}``.

    Only SELECT and SUMMARIZE are cut to ``limit`` rows. ``WITH`` is refused.
    """
    if not 0 < limit <= MAX_ROWS:
        raise ValueError(f"limit must be 1 to {MAX_ROWS}")
    verb, text = statement(sql)
    if verb == "SELECT":
        return run_sql(spark, text, tables).limit(limit)
    rest = text[len(verb):].strip()
    if verb == "SHOW":
        return show_tables(spark, tables)
    target = tables[rest] if rest in tables else run_sql(
        spark, rest if rest.upper().startswith("SELECT") else f"SELECT * FROM {rest}", tables
    )
    return describe(target) if verb == "DESCRIBE" else summarize(target).limit(limit)


def show_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([(name,) for name in sorted(tables)], "name string")


def describe(df: DataFrame) -> DataFrame:
    """Column names and types."""
    return df.sparkSession.createDataFrame(list(schema_names(df).items()), "column_name string, column_type string")


def _mean_instant(column: Column, dates: bool) -> Column:
    """Mean of dates or instants, to the microsecond."""
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    if dates:
        return (zero + F.make_dt_interval(secs=(F.avg(F.unix_date(column)) * 86_400).cast("decimal(18,6)"))).cast("string")
    seconds = (column.cast("timestamp_ntz") - zero).cast("interval second").cast("decimal(18,6)")
    return (zero + F.make_dt_interval(secs=F.avg(seconds).cast("decimal(18,6)"))).cast("string")


def summarize(df: DataFrame) -> DataFrame:
    """Twelve statistics per column, all taken in one aggregate over the table.

    Distinct counts and quartiles are approximate, from sketches that merge; min, max,
    mean, count and the share of NULLs are exact. Mean, deviation and quartiles are
    texts, as they are numbers of numbers but instants of dates and instants, which
    have no deviation. Other types have none of them.
    """
    totals, rows = [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(df.schema.fields):
        column, numeric = F.col(f"`{field.name}`"), isinstance(field.dataType, T.NumericType)
        timed = isinstance(field.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)
        simple = not isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType)
        text = F.lit(None).cast("string")
        totals += [
            (F.min(column).cast("string") if simple else text).alias(f"min{i}"),
            (F.max(column).cast("string") if simple else text).alias(f"max{i}"),
            (F.approx_count_distinct(column) if simple else F.lit(None).cast("bigint")).alias(f"dist{i}"),
            (F.avg(column).cast("double").cast("string") if numeric else _mean_instant(column, isinstance(field.dataType, T.DateType)) if timed else text).alias(f"avg{i}"),
            (F.stddev(column).cast("string") if numeric else text).alias(f"std{i}"),
            (F.percentile_approx(column.cast("double") if numeric else column, [0.25, 0.5, 0.75]).cast("array<string>") if numeric or timed
             else F.lit(None).cast("array<string>")).alias(f"q{i}"),
            F.count_if(column.isNull()).alias(f"nulls{i}"),
        ]
        quartile = [F.get(F.col(f"q{i}"), F.lit(k)) for k in range(3)]
        nulls = F.round(F.col(f"nulls{i}") * F.lit(100).cast("decimal(3,0)") / F.nullif(F.col("n"), F.lit(0)), 2)
        rows.append(F.struct(
            F.lit(field.name).alias("column_name"), F.lit(sql_type_name(field.dataType)).alias("column_type"),
            F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"dist{i}").alias("approx_unique"),
            F.col(f"avg{i}").alias("avg"), F.col(f"std{i}").alias("std"),
            *[q.alias(name) for q, name in zip(quartile, ("q25", "q50", "q75"), strict=True)],
            F.col("n").alias("count"), nulls.cast("decimal(9,2)").alias("null_percentage"),
        ))
    return df.agg(*totals).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def null_check(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("nulls"), F.count(F.lit(1)).alias("total"))


def distinct_values(df: DataFrame, column: str, n: int = 50) -> DataFrame:
    """Most frequent values; equal counts are ordered by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), F.asc_nulls_last(column)).limit(n)


def filter_top(df: DataFrame, condition: Column, order: list, n: int = 100) -> DataFrame:
    """Largest rows that meet a condition."""
    return df.where(condition).orderBy(*order).limit(n)


def recent(df: DataFrame, column: str, since: str, tie: str, n: int = 100) -> DataFrame:
    """Rows since a date, newest first."""
    day = F.lit(since).cast("date")
    return df.where(F.col(column) >= day).orderBy(F.desc(column), F.asc(tie)).limit(n)
