"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path

NO_ID = 2**63 - 1  # stands for a null doc_id where an order of documents is needed: it comes last
# fixed values: what counts as white space between words and around lines
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 3


def held_out(doc_id: Column) -> Column:
    """Fold 1 is never learned from. A null id is in no fold: not held out, not learned from either."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text; a null text has its own name, unlike the empty one's."""
    empty = F.when(text.isNull(), F.lit(1)).otherwise(F.lit(0))
    return [F.xxhash64(text, empty).alias("h1"), F.xxhash64(F.lit(7), empty, text).alias("h2")]


def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Pieces of a partition sorted by ``keys``; rows of equal keys are never parted.

    Memory: one Arrow batch and the longest run, so callers bound their runs beforehand.
    """
    held: list[dict[str, np.ndarray]] = []

    def joined(parts):
        return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        starts = np.ones(batch.num_rows, bool)
        starts[1:] = np.logical_or.reduce([now[k][1:] != now[k][:-1] for k in keys])
        if held:
            starts[0] = any(now[k][0] != held[-1][k][-1] for k in keys)
        where = np.flatnonzero(starts)
        if not len(where):
            held.append(now)
            continue
        last = where[-1]
        if last:
            held.append({n: c[:last] for n, c in now.items()})
        if held:
            yield joined(held)
        held = [{n: c[last:] for n, c in now.items()}]
    if held:
        yield joined(held)


def run_bounds(piece: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Start of every run of equal keys, and the end of the last."""
    n = len(piece[keys[0]])
    change = np.logical_or.reduce([piece[k][1:] != piece[k][:-1] for k in keys]) if n else np.zeros(0, bool)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of ``a[i]`` and ``b[i]`` for all i, in place; a label is the smallest index of its set."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
