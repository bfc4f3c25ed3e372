"""SimHash near-dedup with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree on enough pieces of
the word that they meet in a bucket of one of a few masks (pigeonhole). A
bucket with more than ``BUCKET`` different fingerprints is parted again by
masks over its free bits, which keeps every pair within the radius together in
some part and ends by itself: few free bits leave few different fingerprints.
Inside a bucket the fingerprints stand as 64 bit planes. A query is compared
with 64 of them per word operation; a carry-save counter of two bits adds up
the differing planes, and words whose lanes all exceed the radius are dropped
while planes remain. Buckets give spanning edges only, never all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tablewright.llm.common import merge_labels, run_bounds, table, text_key, whole_runs, written
from tablewright.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
BUCKET = 2048
SLICE = 1 << 16  # shingles, lanes or items worked on at once
ALL = np.uint64(2**64 - 1)


class _Majority:
    """Bit votes of many documents, added up a slice at a time."""

    def __init__(self, n: int):
        self.votes = np.zeros((n, 64), np.int64)
        self.total = np.zeros(n, np.int64)
        self.hashes: list[int] = []
        self.parts: list[tuple[int, int]] = []

    def add(self, doc: int, hashes: list[int]) -> None:
        self.parts.append((doc, len(self.hashes)))
        self.hashes += hashes
        self.total[doc] += len(hashes)
        if len(self.hashes) >= SLICE:
            self.flush()

    def flush(self) -> None:
        if not self.hashes:
            return
        as_bytes = np.array(self.hashes, "<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
        ends = [start for _, start in self.parts[1:]] + [len(bits)]
        for (doc, start), end in zip(self.parts, ends, strict=True):
            self.votes[doc] += bits[start:end].sum(axis=0, dtype=np.int32)
        self.hashes, self.parts = [], []

    def words(self) -> np.ndarray:
        self.flush()
        over = self.votes * 2 > self.total[:, None]
        return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """uint64 per text; null, empty and blank texts have none of the bits."""
    votes, digest = _Majority(len(texts)), xxhash.xxh64_intdigest
    for doc, text in enumerate(texts):
        words = (text or b"").lower().split()  # for bytes: A-Z only, and exactly the six ASCII spaces
        if not words:
            continue
        if len(words) <= shingle:
            votes.add(doc, [digest(b" ".join(words), SEED)])
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
        for at in range(0, len(starts), SLICE):
            spans = zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)
            votes.add(doc, [digest(line[a:b], SEED) for a, b in spans])
    return votes.words()


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words = fingerprints(batch.column(1).to_pylist(), shingle)
            yield pa.record_batch([batch.column(0), *batch.columns[2:], pa.array(words.view(np.int64))], names=["doc_id", "h1", "h2", "fp"])

    return run


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, h1, h2, fp)``: the text's name and its fingerprint as a signed 64-bit number."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), *text_key(F.col("text")))
    return texts.mapInArrow(_fingerprint_batches(shingle), "doc_id bigint, h1 bigint, h2 bigint, fp bigint")


def _pieces(free: list[int], n: int) -> list[int]:
    """``n`` masks that part the bits in ``free``."""
    cuts = [len(free) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(n)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def first_masks(radius: int) -> list[int]:
    """Masks of two pieces out of ``radius + 2``: a pair within the radius agrees on all bits of one of them."""
    return [a | b for a, b in combinations(_pieces(list(range(64)), radius + 2), 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """``mask`` with one piece more out of ``radius + 1`` of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | p for p in _pieces(free, radius + 1)]


def bucketed(fps: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """``(mask, part, fp)`` for different fingerprints ``fp``: pairs within the radius share a bucket of bounded size.

    Only the rows of buckets beyond ``limit`` go through another round, with the
    finer masks of those masks that have such a bucket. The driver sees masks,
    whose number depends on the radius and the round, never on the data.
    """
    spark = fps.sparkSession
    masks = F.array(*[F.lit(_signed(m)) for m in first_masks(radius)])
    rows = fps.select("fp", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    settled = []
    while True:
        large = rows.groupBy("mask", "part").count().where(F.col("count") > limit).select("mask", "part")
        large = written(large, "large")
        wide = [r["mask"] for r in large.select("mask").distinct().collect()]
        if not wide:
            return reduce(DataFrame.unionByName, [*settled, rows])
        settled.append(rows.join(large, ["mask", "part"], "left_anti"))
        finer = [(m, [_signed(f) for f in finer_masks(m % 2**64, radius)]) for m in wide]
        finer = spark.createDataFrame(finer, "mask bigint, finer array<bigint>")
        opened = rows.join(large, ["mask", "part"]).join(F.broadcast(finer), "mask")
        opened = opened.select("fp", F.explode("finer").alias("mask"))
        rows = written(opened.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))).distinct(), "buckets")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of the fingerprints; bit i of word w in a plane is lane ``64 * w + i``."""
    words = -(-len(fps) // 64)
    lanes = np.zeros(words * 64, "<u8")
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int):
    """Lanes of ``word[i]`` in ``valid[i]`` that differ from ``fps[query[i]]`` in at most ``radius`` bits.

    Returns (query lane, other lane) arrays. ``radius`` is at most 2: the
    counter has two bits and an overflow mark.
    """
    out_a, out_b = [], []
    for at in range(0, len(query), SLICE):
        q, w, open_ = query[at : at + SLICE], word[at : at + SLICE], valid[at : at + SLICE]
        value = fps[q]
        ones, twos, over = (np.zeros(len(q), np.uint64) for _ in range(3))
        for plane in range(64):
            spread = np.uint64(0) - (value >> np.uint64(plane) & np.uint64(1))
            differs = planes[plane, w] ^ spread
            carry = ones & differs
            ones ^= differs
            over |= twos & carry
            twos ^= carry
            if plane % 8 == 7:
                beyond = (over | twos & ones) if radius == 2 else (over | twos) if radius == 1 else (over | twos | ones)
                open_ = open_ & ~beyond
                live = open_ != 0
                if not live.all():  # whole words beyond the radius are given up
                    q, w, open_, value, ones, twos, over = (x[live] for x in (q, w, open_, value, ones, twos, over))
                    if not len(q):
                        break
        if len(q):
            bits = np.unpackbits(open_.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            item, lane = np.nonzero(bits)
            out_a.append(q[item])
            out_b.append(w[item] * 64 + lane)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _span(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Words with the bits from ``lo`` to before ``hi`` set (0 to 64)."""
    lo, hi = lo.astype(np.uint64), hi.astype(np.uint64)
    upto = np.where(hi >= 64, ALL, (np.uint64(1) << np.minimum(hi, np.uint64(63))) - np.uint64(1))
    below = np.where(lo >= 64, ALL, (np.uint64(1) << np.minimum(lo, np.uint64(63))) - np.uint64(1))
    return upto & ~below


def _bucket_edges(radius: int):
    keys = ["mask", "part"]

    def run(batches: Iterator[pa.RecordBatch]):
        for piece in whole_runs(batches, keys):
            bounds = run_bounds(piece, keys)
            sizes = np.diff(bounds)
            shared = np.repeat(sizes > 1, sizes)
            fps = np.ascontiguousarray(piece["fp"][shared]).view(np.uint64)
            if not len(fps):
                continue
            ends = np.cumsum(sizes[sizes > 1])
            end = np.repeat(ends, sizes[sizes > 1])  # of the lane's bucket
            lane = np.arange(len(fps))
            labels, planes = lane.copy(), bit_planes(fps)
            # an item is a lane and a word that holds later lanes of its bucket
            first, last = (lane + 1) // 64, (end - 1) // 64
            n = np.where(lane + 1 < end, last - first + 1, 0)
            for at in range(0, len(lane), SLICE // 32):
                some = slice(at, at + SLICE // 32)
                query = np.repeat(lane[some], n[some])
                word = np.arange(len(query)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + first[query]
                valid = _span(np.clip(query + 1 - word * 64, 0, 64), np.clip(end[query] - word * 64, 0, 64))
                merge_labels(labels, *within(planes, fps, query, word, valid, radius))
            joined = labels != lane
            a, b = fps[joined].view(np.int64), fps[labels[joined]].view(np.int64)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of "differ in at most ``radius`` bits"."""
    if not 0 <= radius <= 2:
        raise ValueError("the carry-save counter holds distances up to 2")
    if limit < 2 ** radius:
        raise ValueError("a bucket must hold all values of as many free bits as the radius")
    rows = bucketed(fps.select("fp").distinct(), radius, limit)
    placed = rows.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
    return placed.mapInArrow(_bucket_edges(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """``(doc_id, h1, h2, fp, component_id, root)`` for every row of ``docs``.

    Rows with equal fingerprints are linked, and fingerprints that differ in at
    most ``radius`` bits. ``component_id`` is the smallest doc_id reachable, the
    row's own included; it is null only if no row of the component has an id.
    ``root`` names the component whatever its ids. Texts without words share the
    fingerprint zero and are linked like any other. Repeated rows each give a
    row. An empty table gives none.
    """
    fps = written(fingerprint_table(docs, shingle), "fingerprints")
    heads = fps.groupBy("fp").agg(F.min("doc_id").alias("head"))
    roots = components(links(heads, radius, limit))
    known = heads.join(roots, heads["fp"] == roots["node"], "left")
    known = written(known.select("fp", "head", F.coalesce("root", "fp").alias("root")), "roots")
    ids = known.groupBy("root").agg(F.min("head").alias("component_id"))
    of_fp = known.join(ids, "root").select("fp", "root", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "h1", "h2", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, one without an id only if no row has one.

    A row is named by its id and text, so an id that stands on texts of several
    components is kept in each where it is the smallest. Of rows that share it
    in one component, the first by a hash of text and row stays.
    """
    found = near_duplicates(docs, shingle, radius).where("doc_id = component_id OR component_id IS NULL")
    heads = found.groupBy("root").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("key"))
    heads = heads.select(F.col("key.doc_id").alias("head"), F.col("key.h1").alias("head1"), F.col("key.h2").alias("head2"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    h1, h2 = text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("__id"), h1.alias("__h1"), h2.alias("__h2"), F.struct(*own).alias("__row"))
    plain = [F.col(f"__row.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    first = Window.partitionBy("__id", "__h1", "__h2").orderBy(F.xxhash64(*plain))
    single = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    same = F.col("__id").eqNullSafe(F.col("head")) & (F.col("__h1") == F.col("head1")) & (F.col("__h2") == F.col("head2"))
    return single.join(heads, same, "left_semi").select("__row.*")


def op2(spark, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
