"""Blocks of vectors that meet streams of vectors, for the two vector searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import columns


def finite(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrix(blobs, width: int) -> np.ndarray:
    """Rows of float64 from binary values; short ones are filled with zeros."""
    blobs = list(blobs)
    if not blobs:
        return np.zeros((0, width))
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), width)
    out = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        own = np.frombuffer(b, np.float64)
        out[i, : len(own)] = own
    return out


def packed(df: DataFrame, vector: str, name: str = "vec") -> DataFrame:
    """``df`` with the array of numbers in ``vector`` as float64 bytes in ``name``."""
    others = [c for c in df.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = b.column(b.schema.names.index(vector)).cast(pa.list_(pa.float64()))
            values, offsets = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            blobs = [values[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([*(b.column(b.schema.names.index(c)) for c in others), pa.array(blobs, pa.binary())], names=[*others, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != vector)
    return df.mapInArrow(run, f"{schema}, {name} binary")


def meetings(batches: Iterator[pa.RecordBatch], keys: list[str], chunk: int, alone: bool = False) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """A partition sorted by ``keys`` and ``role`` as ("block", all rows of role 0) and then ("stream", rows of role 1) pieces.

    Only the rows of role 0 of a key are held together; their number is bounded by the caller.
    A block that nothing streams past is yielded only if ``alone`` is set.
    """
    block: list[dict] = []
    current = None
    stream: list[dict] = []
    waiting = 0

    def joined(parts):
        return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}

    for batch in batches:
        rows = columns(batch)
        n = batch.num_rows
        if not n:
            continue
        change = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in [*keys, "role"]])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            part = {c: v[a:z] for c, v in rows.items()}
            key = tuple(part[k][0] for k in keys)
            if key != current:
                if block and alone:
                    yield "block", joined(block)
                if waiting:
                    yield "stream", joined(stream)
                if current is not None:
                    yield "end", {}
                block, stream, waiting, current = [], [], 0, key
            if part["role"][0] == 0:
                block.append(part)
                continue
            if block:
                yield "block", joined(block)
                block = []
            stream.append(part)
            waiting += z - a
            if waiting >= chunk:
                yield "stream", joined(stream)
                stream, waiting = [], 0
    if block and alone:
        yield "block", joined(block)
    if waiting:
        yield "stream", joined(stream)
    if current is not None:
        yield "end", {}


