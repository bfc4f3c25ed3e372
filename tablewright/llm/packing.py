"""Conflict-constrained best-fit packing of documents into token bins.

A bin holds no two pieces of one source and no two of one duplicate cluster. It
carries both sets as bitmaps. Bins stand in order of their residual; for a
piece the search starts at the smallest residual that holds it and goes to its
successor until a bin without a conflict is found, which is the tightest one.

Pieces are dealt evenly to groups by a hash and every group is packed by one
task, largest pieces first. A group has a bounded number of pieces, so a source
or a cluster with a third of all rows is spread like any other. Rows come and go
as a stream of columns without texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import run_bounds, table, text_key, whole_runs, word_count, written

CAPACITY = 2048
GROUP = 8192  # pieces packed by one task at a time, on average


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every piece, taken in the given order. A source or cluster of -1 conflicts with nothing."""
    by_residual: dict[int, list[int]] = {}
    residuals: list[int] = []  # those that some bin has, in order
    holds_source: list[int] = []
    holds_cluster: list[int] = []
    used: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        chosen = -1
        at = bisect_left(residuals, size)
        while at < len(residuals) and chosen < 0:
            for b in by_residual[residuals[at]]:
                if not (holds_source[b] & source_bit or holds_cluster[b] & cluster_bit):
                    chosen = b
                    break
            else:
                at += 1
        if chosen < 0:
            chosen = len(used)
            used.append(0)
            holds_source.append(0)
            holds_cluster.append(0)
        else:
            residual = residuals[at]
            by_residual[residual].remove(chosen)
            if not by_residual[residual]:
                del by_residual[residual], residuals[at]
        bins.append(chosen)
        offsets.append(used[chosen])
        used[chosen] += size
        holds_source[chosen] |= source_bit
        holds_cluster[chosen] |= cluster_bit
        left = capacity - used[chosen]
        if left:
            if left not in by_residual:
                by_residual[left] = []
                insort(residuals, left)
            by_residual[left].append(chosen)
    return bins, offsets


def _dense(values: np.ndarray, shared_only: bool = False) -> list[int]:
    """Small numbers for values, so that they can be bits; 0 stays "nothing", as -1."""
    _, back, count = np.unique(values, return_inverse=True, return_counts=True)
    out = back.astype(np.int64)
    if shared_only:  # a cluster with one piece here cannot conflict and needs no bit
        kept = np.flatnonzero(count > 1)
        number = np.full(len(count), -1, np.int64)
        number[kept] = np.arange(len(kept))
        out = number[out]
    out[values == 0] = -1
    return out.tolist()


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for rows in whole_runs(batches, ["pack"]):
            bounds = run_bounds(rows, ["pack"])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = {n: c[a:b] for n, c in rows.items()}
                bins, offsets = best_fit(own["n_tokens"].tolist(), _dense(own["source_key"]), _dense(own["cluster_key"], True), capacity)
                yield pa.record_batch({
                    "row": pa.array(own["row"]), "piece": pa.array(own["piece"]), "n_tokens": pa.array(own["n_tokens"]),
                    "pack": pa.array(own["pack"]), "bin": pa.array(bins, pa.int64()), "bin_offset": pa.array(offsets, pa.int64()),
                })

    return run


def pack(
    docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, size: Column | None = None, cluster: Column | None = None
) -> DataFrame:
    """``(doc_id, piece, n_tokens, pack, bin, bin_offset)``: where every token of ``docs`` goes.

    ``size`` counts tokens (words unless given); ``cluster`` names the duplicate
    cluster (equal texts unless given; null: in none). A document longer than
    ``capacity`` is cut into full pieces and a rest, all in different bins as
    they are of one source and cluster. A document without tokens has one row
    with a null pack, bin and offset. A null source conflicts with nothing.
    (pack, bin) names a bin. Repeated rows are packed each by itself. An empty table
    gives no row; columns but doc_id, text and source are not read unless ``size`` or
    ``cluster`` does.
    """
    size = word_count(F.col("text")) if size is None else size
    cluster = F.when(F.col("text").isNotNull(), text_key(F.col("text"))[1]) if cluster is None else F.xxhash64(cluster)
    source = F.when(F.col("source").isNotNull(), F.xxhash64("source"))
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), size.cast("bigint").alias("size"),
        F.coalesce(source, F.lit(0)).alias("source_key"), F.coalesce(cluster, F.lit(0)).alias("cluster_key"),
    )
    whole = written(whole.withColumn("row", F.monotonically_increasing_id()), "sizes")
    full = F.floor((F.col("size") + capacity - 1) / capacity).cast("int")
    pieces = whole.where("size > 0").select(
        "row", "source_key", "cluster_key", "size", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece")
    ).withColumn("n_tokens", F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece").cast("bigint") * capacity))
    count = pieces.count()
    packs = max(1, -(-count // group))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("row", "piece"), F.lit(packs)))
    placed = dealt.repartition("pack").sortWithinPartitions("pack", F.desc("n_tokens"), "row", "piece")
    packed = placed.select("row", "piece", "n_tokens", "pack", "source_key", "cluster_key").mapInArrow(
        _pack(capacity), "row bigint, piece int, n_tokens bigint, pack bigint, bin bigint, bin_offset bigint"
    )
    out = whole.select("row", "doc_id").join(packed, "row", "left")
    return out.select("doc_id", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "pack", "bin", "bin_offset")


def op9(spark, folder: str) -> DataFrame:
    """Bin and offset of every document or piece of one.

    A duplicate cluster is the documents of equal text; near copies from
    different sources may share a bin.
    """
    return pack(table(spark, folder, "documents"))
