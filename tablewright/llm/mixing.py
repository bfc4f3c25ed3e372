"""Mixing sources to target weights by subset-sum budget fitting.

Per source a histogram of exact token lengths is all the fitting needs. A
source with a target beyond its size takes every document once and fits the
rest of the budget with second copies. Most of a budget is taken evenly over
the lengths; the remaining budget is fitted by a bounded-knapsack dynamic
programme over the lengths that still have documents. The documents of a length
are then chosen by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tablewright.llm.common import NO_ID, table, word_count, written

SHARE = 1.5  # all targets together, as a multiple of all sizes
MOST = 2.0  # no target above this multiple of its source, no document taken more often
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 7
REST = 1 << 16  # tokens that the dynamic programme fits
NEAR = 0.01  # a source that misses its target by more is fitted again over all numbers of copies
PIECE = 100_000  # documents of one source and length ranked in one task


def shares(sizes: dict, weights: dict, total: float, most: float = MOST) -> dict:
    """Targets in proportion to weights; the excess over ``most`` times a size is shared out again."""
    out, open_, left = {}, set(sizes), total
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight if weight else 0.0 for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            out |= share
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def rotating(sources: list) -> dict:
    """5, 2, 1, 5, … over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
    return {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(ordered)}


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, rest: int = REST) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to ``budget`` as found, from below.

    Even shares of every length first, then the longest that still fit, down to
    a remainder of at most ``rest`` tokens, which the dynamic programme fits as
    well as the lengths allow.
    """
    order = np.argsort(lengths, kind="stable")
    length, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((length * count).sum())
    if budget >= total:
        take = count.copy()
    else:
        part = max(0.0, budget / total)
        take = np.minimum(count, np.floor(count * part).astype(np.int64))
        left = budget - int((length * take).sum())
        for i in range(len(length) - 1, -1, -1):
            if length[i] and left > rest:
                more = min(int(count[i] - take[i]), (left - rest) // int(length[i]))
                take[i] += more
                left -= more * int(length[i])
        while left > rest:  # what is left of some length fits, but would go below ``rest``
            fits = np.flatnonzero((count > take) & (length > 0) & (length <= left))
            if not len(fits):
                break
            take[fits[-1]] += 1
            left -= int(length[fits[-1]])
        take += _knapsack(length, count - take, min(left, rest))
    out = np.empty_like(take)
    out[order] = take
    return out


def nearest_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, rest: int = REST) -> np.ndarray:
    """As ``fit_counts``, or what stays when the excess is fitted instead, if that comes nearer to ``budget`` from above."""
    below = fit_counts(lengths, counts, budget, rest)
    total = int((lengths * counts).sum())
    if budget >= total:
        return below
    above = counts - fit_counts(lengths, counts, total - budget, rest)
    over, under = int((lengths * above).sum()) - budget, budget - int((lengths * below).sum())
    return above if over < under else below


def _knapsack(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: reachable sums are bits of a whole number; multiples go in powers of two."""
    take = np.zeros(len(length), np.int64)
    items = []
    for i in range(len(length)):
        some, size = min(int(count[i]), budget // int(length[i]) if length[i] else 0), 1
        while some:
            n = min(size, some)
            items.append((i, n, n * int(length[i])))
            some -= n
            size *= 2
    mask, reach, steps = (1 << budget + 1) - 1, 1, []
    for item in items:
        more = (reach | reach << item[2]) & mask
        steps.append((item, reach))
        if more >> budget & 1:
            reach = more
            break
        reach = more
    at = reach.bit_length() - 1
    for (i, n, size), before in reversed(steps):
        if not before >> at & 1:  # the sum needs this item
            take[i] += n
            at -= size
    return take


def _fit(rest: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        size, n = rows["size"].to_numpy(), rows["n"].to_numpy()
        target, own = float(rows["target"].iloc[0]), int((size * n).sum())
        whole = min(1, int(target // own)) if own else 1
        copies = np.minimum(nearest_counts(size, n, int(round(target)) - whole * own, rest), n)
        taken = whole * n + copies
        missed = abs(int((size * taken).sum()) - target)
        if missed > NEAR * target:  # few or very unequal documents: let any be taken up to ``MOST`` times
            wide = nearest_counts(size, int(MOST) * n, int(round(target)), rest)
            if abs(int((size * wide).sum()) - target) < missed:
                taken = wide
        return pd.DataFrame({"sid": rows["sid"], "size": size, "copies": taken // n, "more": taken % n})

    return run


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), "text", "source")


def mix(
    docs: DataFrame, size: Column | None = None, weights: Callable[[list], dict] = rotating, share: float = SHARE,
    seed: int = SEED, rest: int = REST, piece: int = PIECE,
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` in columns of those names.

    ``docs`` needs doc_id, text and source; other columns are not returned. The
    choice depends on doc_id, text length and ``seed`` only, so reruns agree;
    rows that are equal in all of them are alike, and which of them is taken
    cannot be told. A null source is a source, after all others. A null or empty
    text has size 0 and is taken as 0 words. Sources are collected to the driver,
    one row each; per source one task holds its different lengths, never its
    documents. An empty table gives no row.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", size.cast("bigint").alias("size"),
        _draw(seed).alias("draw"),
    )
    rows = written(rows, "sizes")
    histogram = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = {r["source"]: r["s"] for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    targets = shares(sizes, weights(list(sizes)), share * sum(sizes.values()))
    listed = sorted(sizes, key=lambda s: (s is None, s or ""))
    known = docs.sparkSession.createDataFrame(
        [(i, s, float(targets[s]), int(sizes[s])) for i, s in enumerate(listed)],
        f"sid int, source {rows.schema['source'].dataType.simpleString()}, target double, source_size bigint",
    )
    same = rows["source"].eqNullSafe(known["source"])
    to_fit = histogram.join(known, histogram["source"].eqNullSafe(known["source"])).select("sid", "size", "n", "target")
    fitted = to_fit.groupBy("sid").applyInPandas(_fit(rest), "sid int, size bigint, copies bigint, more bigint")
    fitted = fitted.join(to_fit.select("sid", "size", "n"), ["sid", "size"])

    # the ``more`` smallest draws of a source and length: its draws are cut into even pieces, so that no
    # task ranks more than about ``piece`` rows, and only the piece at the border is taken in part
    marked = rows.join(known, same).select("doc_id", "size", "draw", "sid", "target", "source_size")
    marked = marked.join(fitted, ["sid", "size"])
    even = F.pmod(F.shiftright("draw", 16), F.lit(1 << 30)) / F.lit(float(1 << 30))
    marked = marked.withColumn("piece", F.floor(even * F.ceil(F.col("n") / piece)).cast("int"))
    per_piece = marked.where("more > 0 AND more < n AND n > %d" % piece).groupBy("sid", "size", "piece").agg(F.count("*").alias("here"))
    upto = Window.partitionBy("sid", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    per_piece = per_piece.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
    marked = marked.join(per_piece.drop("here"), ["sid", "size", "piece"], "left")
    ranks = Window.partitionBy("sid", "size", "piece").orderBy("draw", "doc_id")
    rank = F.row_number().over(ranks) + F.coalesce("before", F.lit(0))
    times = F.col("copies") + F.when(rank <= F.col("more"), F.lit(1)).otherwise(F.lit(0))
    return marked.withColumn("times", times).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", "draw"
    )


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it: not at all, once or twice.

    Rows equal in id, text and source share what is taken of them; the first of
    them, by a hash of all their columns but maps, get the larger number.
    """
    mixed = mix(docs, **options)
    times = mixed.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("draw").alias("__draw")).agg(
        F.min("times").alias("__least"), F.count("*").alias("__rows"), F.sum("times").alias("__sum")
    )
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("__id"),
        _draw(options.get("seed", SEED)).alias("__draw"), F.struct(*own).alias("__row"),
    ).join(times, ["__id", "__draw"])
    plain = [F.col(f"__row.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    nth = F.row_number().over(Window.partitionBy("__id", "__draw").orderBy(F.xxhash64(*plain), F.xxhash64(F.lit(7), *plain)))
    # of equal rows all are taken ``least`` times and some once more
    more = nth <= F.col("__sum") - F.col("__rows") * F.col("__least")
    rows = rows.withColumn("__times", F.col("__least") + F.when(more, F.lit(1)).otherwise(F.lit(0))).where("__times > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__copy")).select("__row.*")


def op7(spark, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
