"""Ordered operators that stay spread out when one group is very large.

A window over ``PARTITION BY key`` sorts the whole group in one task. When the
largest group is small that is the right plan. Otherwise rows are range-sliced by
``(key, order)``, so a large group covers many slices; each slice is handled on its
own and the little that must cross a slice border (one carry row per border) is
joined back. The sliced rows are checkpointed once, since the slice borders come
from a sample and both sides of that join must see the same ones.

``order`` must end in a column that makes it unique within the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import shared_root

_SLICE, _CARRY = "_slice", "_carry"


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows ranged over slices by key and order, so that a large group spreads over many tasks.

    Written once: all uses must see the same borders.
    """
    spark = df.sparkSession
    shared_root(spark)
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartitionByRange(slices, *keys, *order).withColumn(_SLICE, F.spark_partition_id()).checkpoint()


def _join_borders(rows: DataFrame, borders: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Attach border rows. Only the first and the last key of a slice can reach past its borders, so
    there are at most two border rows per slice and they can be broadcast whatever the data size."""
    renamed = borders.select(
        F.col(_SLICE).alias("_b_slice"), *[F.col(k).alias(f"_b_{k}") for k in keys], *columns
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys],
        F.col(_SLICE) == F.col("_b_slice"),
    )
    return rows.join(F.broadcast(renamed), on, "left").drop("_b_slice", *[f"_b_{k}" for k in keys])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add each group's previous row, column by column (``LAG`` of every column in ``columns``)."""
    packed = F.struct(*columns)
    out = [c for c in df.columns]
    added = [F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in columns]
    rows = _sliced(df, keys, order)
    tails = rows.groupBy(_SLICE, *keys).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    borders = tails.withColumn(_CARRY, F.lag("_tail").over(across)).where(F.col(_CARRY).isNotNull())
    inside = Window.partitionBy(_SLICE, *keys).orderBy(*order)
    local = rows.withColumn("_prev", F.lag(packed).over(inside))
    return (
        _join_borders(local, borders, keys, [_CARRY])
        .withColumn("_prev", F.coalesce("_prev", _CARRY))
        .select(*out, *added)
    )


def with_rank_and_size(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_rank`` (1-based row number) and ``_size`` of each group, slice by slice."""
    rows = _sliced(df, keys, order)
    counts = rows.groupBy(_SLICE, *keys).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        counts.withColumn("_before", F.sum("_n").over(before))
        .withColumn("_total", F.sum("_n").over(group))
        .where(F.col("_total") > F.col("_n"))
    )
    here = Window.partitionBy(_SLICE, *keys)
    local = rows.withColumn("_rank", F.row_number().over(here.orderBy(*order))).withColumn(
        "_size", F.count(F.lit(1)).over(here)
    )
    return (
        _join_borders(local, borders, keys, ["_before", "_total"])
        .withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
        .withColumn("_size", F.coalesce("_total", "_size"))
        .drop("_before", "_total", _SLICE)
    )


def tile_borders(df: DataFrame, column: str, tiles: int) -> list:
    """The smallest value of every tile that ``NTILE(tiles) OVER (ORDER BY column)`` makes of the rows that have a value.

    Values are counted and ranged over slices; the driver gets the number of rows of
    each slice and the borders, and only the slices that hold one are put in order.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    rows = _sliced(counts, [], [column])
    sizes = {r[0]: r[1] for r in rows.groupBy(_SLICE).agg(F.sum("_n")).collect()}
    total = sum(sizes.values())
    # NTILE gives the first ``total % tiles`` tiles a row more
    starts = [t * (total // tiles) + min(t, total % tiles) for t in range(min(tiles, total))]
    wanted, before = [], 0
    for part in sorted(sizes):
        wanted += [(part, start - before) for start in starts if before <= start < before + sizes[part]]
        before += sizes[part]
    if not wanted:
        return []
    inside = Window.partitionBy(_SLICE).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranks = df.sparkSession.createDataFrame(wanted, f"{_SLICE} int, _rank bigint")
    held = rows.where(F.col(_SLICE).isin(sorted({part for part, _ in wanted}))).withColumn("_upto", F.sum("_n").over(inside))
    met = held.join(ranks, _SLICE).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
    return [r[2] for r in sorted(met.select(_SLICE, "_rank", column).collect(), key=lambda r: (r[0], r[1]))]


ACCURACY = 10_000  # a quantile sketch misses a rank by at most this part of a group's rows


def percentile_bracket(value: str, q: float) -> Column:
    """Sketch of a group, to be taken in any aggregate: values between which the percentile lies, ends included.

    Twice the sketch's error is left on either side, and the whole group where that is under four ranks.
    """
    near = 2.0 / ACCURACY
    sketch = F.percentile_approx(F.col(value), F.array(F.lit(max(0.0, q - near)), F.lit(min(1.0, q + near))), F.lit(ACCURACY))
    return F.when(F.count(value) * F.lit(near) < 4, F.array(F.min(value), F.max(value))).otherwise(sketch)


def percentile_within(
    df: DataFrame, brackets: DataFrame, keys: Sequence[str], value: str, q: float, name: str, n: str = "_n", bracket: str = "_bracket"
) -> DataFrame:
    """Exact interpolated percentile per group from a second pass over the rows.

    ``brackets`` has for each group its number of values and what ``percentile_bracket``
    found. Values below a bracket are only counted and those above left out, both before any shuffle; the
    few values inside, each with its count, are put in order. So a group of any size comes down to
    a small part of its rows.
    """
    sides = brackets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(n).alias("_n"), F.col(bracket).alias("_b"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    met = df.where(F.col(value).isNotNull()).select(*keys, value).join(sides, on).where(F.col(value) <= F.col("_b")[1])
    inside = F.when(F.col(value) >= F.col("_b")[0], F.col(value))
    counts = met.groupBy(*keys, inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    along = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    position = (F.col("_n") - 1) * F.lit(q)
    ranked = counts.withColumn("_upto", F.sum("_c").over(along)).withColumn("_pos", position)

    def at(rank: Column) -> Column:
        return F.min(F.when((F.col("_upto") >= rank) & F.col("_v").isNotNull(), F.col("_v")))

    share = F.max(F.col("_pos") - F.floor("_pos"))
    found = ranked.groupBy(*keys).agg(
        at(F.floor("_pos") + 1).alias("_low"), at(F.ceil("_pos") + 1).alias("_high"), share.alias("_share"),
        F.max(F.when(F.col("_v").isNull(), F.col("_c"))).alias("_below"), F.max("_pos").alias("_p"),
    )
    # a bracket that the sketch had placed wrong would show here
    right = (F.coalesce("_below", F.lit(0)) <= F.floor("_p")) & F.col("_high").isNotNull()
    middle = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * (1 - F.col("_share")) + F.col("_high") * F.col("_share"))
    return found.select(*keys, F.when(right, middle).otherwise(F.raise_error(F.lit("percentile outside its bracket"))).alias(name))


def group_percentile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Exact interpolated percentile per group in two passes.

    Spark's own ``percentile`` keeps every distinct value of a group in memory; here a
    mergeable sketch bounds where the percentile is, and only values between the bounds are ordered.
    """
    known = df.where(F.col(value).isNotNull())
    brackets = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), percentile_bracket(value, q).alias("_bracket"))
    return percentile_within(known, brackets, keys, value, q, name)


def newest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence) -> DataFrame:
    """The first row of each group in the given order.

    Spark limits every map task to one candidate row per key before the shuffle
    (WindowGroupLimit), so a large group arrives as one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")
