"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Differencing keeps partial partitions (``k`` sums with their members), takes the
two with the largest spread and adds them with opposite order, until one is
left. It runs on levels, because no task may hold all groups: every chunk
of groups is differenced into bundles of even bytes, again with the bundles while they are too many, then the bundles and the
groups larger than a bundle, a bounded number, are differenced into the shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import table, text_bytes, text_key, written

SHARDS = 40
OVERHEAD = 16
FINE = 50  # bundles in a shard
CHUNK = 20_000  # groups differenced in one task, about
PIECE = 100_000  # rows numbered in one task


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """Part 0 to k-1 of every size, by Karmarkar-Karp. Ties go by position, so the result is fixed."""
    if k == 1 or not len(sizes):
        return np.zeros(len(sizes), np.int64)
    left: list[int] = []  # of a joined node
    right: list[int] = []
    n = len(sizes)
    # a partial partition: (-spread, order, [(sum, node)] with the largest first, at most k of them, the rest empty)
    heap = [(-int(s), i, [(int(s), i)]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = k - len(a)
        if len(b) <= spare:
            joined = a + b
        else:
            joined = a[: k - len(b)] + b[:spare]
            # the smallest of a meet the largest of b
            for (x, i), (y, j) in zip(a[k - len(b) :], b[spare:][::-1], strict=True):
                joined.append((x + y, n + len(left)))
                left.append(i)
                right.append(j)
        joined.sort(key=lambda part: (-part[0], part[1]))
        low = joined[-1][0] if len(joined) == k else 0
        heapq.heappush(heap, (low - joined[0][0], order, joined))
        order += 1
    part = np.full(n + len(left), -1, np.int64)
    for number, (_, node) in enumerate(heap[0][2]):
        part[node] = number
    for j in range(len(left) - 1, -1, -1):
        part[left[j]] = part[right[j]] = part[n + j]
    return part[:n]


def _bundles(target: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "h1", "h2"], ascending=[False, True, True], kind="stable")
        sizes = rows["bytes"].to_numpy()
        k = max(1, int(-(-int(sizes.sum()) // target)))
        part = differenced(sizes, min(k, len(sizes)))
        return pd.DataFrame({"h1": rows["h1"], "h2": rows["h2"], "bytes": sizes, "chunk": rows["chunk"], "bundle": part})

    return run


def _bundled(groups: DataFrame, n: int, target: int, chunk: int) -> DataFrame:
    """``(h1, h2, bytes, chunk, bundle)``: groups dealt to chunks of about ``chunk``, each differenced into bundles."""
    dealt = groups.withColumn("chunk", F.pmod("h2", F.lit(max(1, -(-n // chunk)))))
    return dealt.groupBy("chunk").applyInPandas(_bundles(target), "h1 bigint, h2 bigint, bytes bigint, chunk bigint, bundle bigint")


def assign_shards(groups: DataFrame, shards: int = SHARDS, chunk: int = CHUNK, fine: int = FINE) -> DataFrame:
    """``(h1, h2, bytes)`` groups to ``(h1, h2, shard)``.

    A chunk gives a bundle at least, so very many chunks give more bundles than
    one task should difference; these are bundled again as groups of their own until
    a chunk would hold them all.
    """
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    target = max(1, int(total) // (shards * fine))
    # a group beyond the bundle size is an item of its own on the last level: fewer than shards * fine of them
    items = written(_bundled(groups.where(F.col("bytes") <= target), n, target, chunk), "bundles")
    levels = [items]
    while True:
        sums = items.groupBy("chunk", "bundle").agg(F.sum("bytes").alias("bytes"))
        left = sums.count()
        if left <= max(chunk, 2 * shards * fine):
            break
        named = sums.select(F.col("chunk").alias("h1"), F.xxhash64("chunk", "bundle").alias("h2"), F.col("bundle").alias("old"), "bytes")
        again = _bundled(named.select("h1", "h2", "bytes"), left, target, chunk)
        items = written(again.join(named.select("h1", "h2", "old"), ["h1", "h2"]), "bundles")
        levels.append(items)
    large = groups.where(F.col("bytes") > target).select("bytes", F.col("h1").alias("chunk"), F.col("h2").alias("bundle"))
    last = sums.withColumn("single", F.lit(False)).unionByName(large.withColumn("single", F.lit(True)))
    second = written(last.repartition(1).mapInPandas(_second_level(shards), "single boolean, chunk bigint, bundle bigint, shard int"), "parts")
    shard_of = second.where("NOT single").drop("single")
    for level in reversed(levels[1:]):
        shard_of = level.join(shard_of, ["chunk", "bundle"]).select(F.col("h1").alias("chunk"), F.col("old").alias("bundle"), "shard")
    small = levels[0].join(shard_of, ["chunk", "bundle"]).select("h1", "h2", "shard")
    return small.unionByName(second.where("single").select(F.col("chunk").alias("h1"), F.col("bundle").alias("h2"), "shard"))


def _second_level(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        rows = pd.concat(frames).sort_values(["bytes", "single", "chunk", "bundle"], ascending=[False, True, True, True], kind="stable")
        part = differenced(rows["bytes"].to_numpy(), k)
        yield pd.DataFrame({"single": rows["single"], "chunk": rows["chunk"], "bundle": rows["bundle"], "shard": part.astype(np.int32)})

    return run


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """Every row of ``docs`` with size, text_crc32, shard and its slot in the shard.

    Size is the text's UTF-8 bytes plus ``overhead``; a null text has no bytes,
    a crc32 of 0, and all null texts are one group. Rows of equal texts are a
    group and stay together, whatever their ids; so a group larger than an even
    share has a shard to itself and the rest balance among the others. Slots
    run from 0 without gaps. Rows equal in id and text get neighbouring slots. An empty
    table gives no row; columns but doc_id and text are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (text_bytes(F.col("text")) + overhead).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"), *text_key(F.col("text")),
    )
    rows = written(rows, "sizes")
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    placed = written(rows.join(assign_shards(groups, shards, chunk), ["h1", "h2"]), "placed")
    # slots: pieces of a shard by hash of the row, numbered inside, after the rows of earlier pieces
    per_shard = placed.groupBy("shard").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    cut = F.pmod(F.xxhash64(F.lit(3), "doc_id", "h1"), F.col("pieces")).cast("int")
    placed = placed.join(per_shard, "shard").withColumn("piece", cut)
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "piece").agg(F.count("*").alias("here"))
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "h1", "h2")
    placed = placed.join(offsets, ["shard", "piece"])
    slot = F.col("offset") + F.row_number().over(inside) - 1
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.cast("bigint").alias("slot"))


def op6(spark, folder: str) -> DataFrame:
    """Shard and slot of every document under the ``bytes`` law."""
    out = shard(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
