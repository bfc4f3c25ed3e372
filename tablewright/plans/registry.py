"""Registered queries: a Spark plan and, where SQL can say it, the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.plans import mapping

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


class Tables:
    """Base tables and mapped views of one data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._prefix = "tw_" + re.sub(r"\W", "_", self.folder).strip("_") + "_"
        self._known: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._known:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            df.createOrReplaceTempView(self._prefix + name)
            self._known[name] = df
        return self._known[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in mapping.BASE_TABLES:
            return self.base(name)
        if name not in mapping.VIEWS:
            raise AttributeError(name)
        if name not in self._known:
            for used in set(re.findall(r"@([a-z]\w*)", mapping.VIEWS[name])):
                self.base(used)
            self._known[name] = self.spark.sql(mapping.spark_text(name, self._prefix))
        return self._known[name]


def comparable(df: DataFrame) -> DataFrame:
    """Plain column types, the same on both sides of a check.

    Money and averages become DOUBLE after exact DECIMAL arithmetic, whole
    numbers BIGINT, instants zone-free timestamps.
    """
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType | T.FloatType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.ByteType | T.ShortType | T.IntegerType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its check SQL."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(fn(Tables(spark, folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if check is not None:
            _CHECKS[name] = mapping.with_views(check)
        return fn

    return add


def load() -> tuple[dict, dict]:
    """All registered queries and checks."""
    from tablewright.plans import (  # noqa: F401
        business_queries,
        explore_queries,
        quality_queries,
        runlog_queries,
        sink_queries,
        source_queries,
        stream_queries,
    )

    return dict(_QUERIES), dict(_CHECKS)
