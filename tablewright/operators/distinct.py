"""Grouped aggregates next to distinct counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two results grouped by the same keys; a NULL key is a group like any other."""
    side = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(side, on).drop(*[f"_{k}" for k in keys])


def distinct_count(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values per group. Rows are spread by key and value, so a large group is many tasks' work."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(F.count(column).alias(name))


def group_with_distinct(
    df: DataFrame, keys: Sequence[str], totals: Sequence[Column], distinct: Mapping[str, str]
) -> DataFrame:
    """``GROUP BY keys`` with plain aggregates and ``COUNT(DISTINCT)`` of one or more columns.

    In one aggregate Spark would carry every plain total along in the rows it
    shuffles per distinct value. Apart, the totals shrink to one row per group and
    task, and the distinct side shuffles nothing but keys and values.
    """
    base = df.groupBy(*keys).agg(*totals)
    sides = [distinct_count(df, keys, column, name) for name, column in distinct.items()]
    return reduce(lambda a, b: join_groups(a, b, keys), sides, base)
