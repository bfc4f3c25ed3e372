"""Keyed merge of staged rows into a target, as a plan over DataFrames.

The staged side is usually far smaller than the target, so every join has it on the
right, where Spark can broadcast it and leave the target unshuffled. The target is
read once in full and once for its key columns. A key that many target rows share is
split by adaptive execution in the left joins and folded early in the key list.

Staged rows are read three times: pass a table or checkpoint, not a costly plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW = "_new"


def new(column: str) -> Column:
    """Staged value of a column inside the ``changes`` of an upsert."""
    return F.col(f"{NEW}.{column}")


def _all_present(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def require_unique_keys(staged: DataFrame, keys: Sequence[str]) -> None:
    """A target row must not be updated twice; NULL keys match nothing and may repeat."""
    repeated = staged.where(_all_present(keys)).groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        found = {k: repeated[0][k] for k in keys}
        raise ValueError(f"staged rows repeat key {found}")


def absent_rows(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staged rows whose key the target lacks; a NULL key is never found."""
    wanted = staged.where(_all_present(keys)).select(*keys)
    matched = target.where(_all_present(keys)).select(*keys).join(wanted, list(keys), "left_semi").distinct()
    return staged.join(matched, list(keys), "left_anti")


def upsert(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    changes: Mapping[str, Column],
    remove: Column | None = None,
) -> DataFrame:
    """Matched target rows take ``changes``, unmatched staged rows are added.

    A change is an expression over the target's columns and ``new(column)``. Matched
    rows for which ``remove`` holds are dropped, and so are staged rows that meet it
    without a match. Added rows have NULL where the target has more columns.
    """
    others = [c for c in staged.columns if c not in keys]
    kept = target
    if changes or remove is not None:
        news = staged.where(_all_present(keys)).select(*keys, F.struct(*others).alias(NEW))
        kept = target.join(news, list(keys), "left")
        if remove is not None:
            kept = kept.where(F.col(NEW).isNull() | ~remove)
        kept = kept.select(*[
            F.when(F.col(NEW).isNotNull(), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in target.columns
        ])
    added = absent_rows(target, staged, keys)
    if remove is not None:
        added = added.withColumn(NEW, F.struct(*others)).where(~remove)
    types = {f.name: f.dataType for f in target.schema.fields}
    fitted = added.select(*[F.col(c).cast(types[c]).alias(c) for c in staged.columns if c in types])
    return kept.unionByName(fitted, allowMissingColumns=True)


def merge(target: DataFrame, staged: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Matched rows take the staged columns, the rest of the staged rows are added.

    Columns the staged table lacks keep their target value; a table of keys only is
    insert-only.
    """
    if not keys:
        raise ValueError("target.keys is required when mode='merge'")
    if check:
        require_unique_keys(staged, keys)
    types = {f.name: f.dataType for f in target.schema.fields}
    changes = {c: new(c).cast(types[c]) for c in staged.columns if c in types and c not in keys}
    return upsert(target, staged, keys, changes)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add only the rows whose key the target lacks."""
    return upsert(target, rows, keys, {})
