"""Hard negatives by Kronecker-packed products.

Candidates stand in shards of a bounded size, ordered by label, and anchors stream
past them. In a shard the components of several candidates are shifted to be no
less than zero and put side by side into fields of one wide whole number. A field
is as wide as the largest sum of products that can gather in it, so one
multiplication for each component of an anchor and one addition give the sums of
all fields at once without a carry from one into the next; the scores are read off
exactly. Wide numbers are held in double precision, below 2**53, where at least one
field fits, and otherwise in Python's whole numbers.

There are two passes: first every anchor's best rows of its own label, in the
shards that hold the label; then, with the scores of these positives known, the
rows of other labels inside each positive's window of scores. Shards give a few
rows for each anchor and positive, which are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import table, written
from tablewright.llm.vectors import finite, matrix, meetings, packed
from tablewright.operators.ordered import with_rank_and_size

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
LEAST, MOST = 80, 100  # a negative's score in hundredths of its positive's
SHARD = 16_384  # candidates in a shard
ANCHORS = 256  # anchors scored at a time
DOUBLE = 53  # bits of a whole number that double precision holds
WIDE_FIELDS = 8  # candidates in a Python number
TEXT = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score string, vec_id bigint, score string"


class Packed:
    """Candidates of a shard in fields of wide numbers; ``peak`` bounds what an anchor's component adds to its shift."""

    def __init__(self, weights: np.ndarray, peak: float):
        self.n, width = weights.shape
        self.shift = int(max(0.0, -weights.min(initial=0)))
        self.lift = int(peak)  # anchors are shifted by it
        top = int(weights.max(initial=0)) + self.shift
        self.bits = max(1, (width * top * 2 * self.lift).bit_length())
        self.fields = DOUBLE // self.bits
        self.exact = self.fields == 0
        if self.exact:
            self.fields, shifted = WIDE_FIELDS, _whole(weights) + self.shift
        else:
            shifted = weights + self.shift
        self.sums = _whole(shifted.sum(1)) if self.exact else shifted.sum(1).astype(np.int64)
        columns = -(-self.n // self.fields)
        self.wide = np.zeros((width, columns), shifted.dtype)
        for i in range(self.fields):
            part = shifted[i::self.fields].T
            self.wide[:, : part.shape[1]] += part * (2 ** (self.bits * i) if self.exact else 2.0 ** (self.bits * i))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, anchors by candidates: 64-bit whole numbers, or Python's where no field fits a double."""
        own = _whole(anchors) if self.exact else anchors
        products = (own + self.lift) @ self.wide
        if not self.exact:
            products = products.astype(np.int64)
        mask = (1 << self.bits) - 1
        out = np.empty((len(anchors), self.wide.shape[1] * self.fields), products.dtype)
        for i in range(self.fields):
            out[:, i::self.fields] = (products >> (self.bits * i)) & mask
        sums = own.sum(1) if self.exact else own.sum(1).astype(np.int64)
        return out[:, : self.n] - self.shift * sums[:, None] - self.lift * self.sums[None, :]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x).astype(object)


def best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the columns ``at`` with the highest scores, ties to the earlier column."""
    if len(at) > k:
        own = scores[at]
        floor = np.sort(own)[-k] if own.dtype == object else np.partition(own, -k)[-k]
        at = at[own >= floor]
    order = sorted(range(len(at)), key=lambda i: -scores[at[i]])  # stable
    return at[order][:k]


def _search(width: int, k: int, least: int, most: int, mine: bool):
    """``mine``: rows of the anchor's label; else rows of others inside the windows of its positives."""

    def run(batches: Iterator[pa.RecordBatch]):
        shard = packed_shard = None
        for kind, rows in meetings(batches, ["shard"], ANCHORS):
            if kind == "block":
                shard = (rows["vec_id"].astype(np.int64), rows["label"].astype(np.int64), matrix(rows["vec"], width))
                packed_shard = None
            elif kind == "end":
                shard = packed_shard = None
            elif shard is not None:
                ids, labels, weights = shard
                anchors = matrix(rows["vec"], width)
                peak = max(1.0, float(np.abs(anchors).max(initial=0)))
                if packed_shard is None or packed_shard.lift < peak:
                    packed_shard = Packed(weights, peak)
                found = []
                for i, scores in enumerate(packed_shard.scores(anchors)):
                    head = (int(rows["anchor"][i]), int(rows["vec_id"][i]))
                    if mine:
                        at = np.flatnonzero((labels == rows["label"][i]) & (ids != rows["vec_id"][i]))
                        found += [(*head, None, None, None, int(ids[j]), str(scores[j])) for j in best(scores, at, k)]
                        continue
                    other = labels != rows["label"][i]
                    for p in rows["positives"][i]:
                        top = int(p["score"])
                        low = -(-least * top // 100)
                        if low > most * top // 100:
                            continue
                        at = np.flatnonzero(other & (scores >= low) & (scores <= most * top // 100))
                        found += [(*head, p["number"], p["vec_id"], p["score"], int(ids[j]), str(scores[j])) for j in best(scores, at, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], pa.string() if i in (4, 6) else pa.int64()) for i in range(7)],
                    names=["anchor", "anchor_id", "positive", "positive_id", "positive_score", "vec_id", "score"],
                )

    return run


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST, scale: int = SCALE, shard: int = SHARD,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of every anchor.

    ``vectors`` has vec_id, embedding and label. A component is floor(scale * x); a
    score is the inner product with the anchor. Anchors are the rows whose id
    ``every`` divides. An anchor's positives are its ``positives`` best rows of its
    label; for each of them the ``negatives`` best rows of another label whose
    score is from ``least`` to ``most`` hundredths of the positive's are returned.
    Ties go to the smaller id. Rows without an id or a label, and vectors that are
    null or hold null or non-finite components, take no part; a vector shorter than
    others ends in zeros and an empty one is all zeros. Another row is a row with another id;
    rows equal in id, label and vector are one anchor, but each counts as a
    candidate. Where a label holds fewer rows, or a window fewer, all are returned.
    Empty tables give no row. Extra columns are ignored. Refused: components beyond double
    precision after scaling, and a score to be returned that a long cannot hold.
    """
    x = F.col("embedding")
    large = F.lit(2.0**52)

    def weight(v):
        scaled = v.cast("double") * scale
        return F.when(F.abs(scaled) < large, F.floor(scaled).cast("double")).otherwise(scaled)  # beyond it there are no fractions

    valid = vectors.where(finite(x) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = valid.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform(x, weight).alias("w"))
    rows = written(packed(rows, "w").withColumn("number", F.monotonically_increasing_id()), "weights")
    bytes_, peak = valid.agg(F.max(F.size(x)) * 8, F.max(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))))).first()
    width = (bytes_ or 0) // 8
    if (peak or 0.0) * scale == float("inf"):
        raise ValueError("components beyond double precision")
    ranked = with_rank_and_size(rows, [], ["label", "vec_id", "number"])
    placed = ranked.withColumn("shard", F.floor((F.col("_rank") - 1) / shard).cast("bigint")).drop("_rank", "_size")
    placed = written(placed, "placed")
    directory = placed.groupBy("label", "shard").agg(F.count("*").alias("n")).drop("n")
    same = ["vec_id", "label", "vec"]
    anchors = placed.where(F.col("vec_id") % every == 0).groupBy(*same).agg(F.min("number").alias("anchor"))
    block = placed.withColumn("role", F.lit(0)).withColumn("anchor", F.lit(0).cast("bigint"))

    def met(visitors: DataFrame, mine: bool, k: int) -> DataFrame:
        both = block.unionByName(visitors.withColumn("role", F.lit(1)), allowMissingColumns=True)
        both = both.repartition("shard").sortWithinPartitions("shard", "role", "vec_id", "number")
        return both.mapInArrow(_search(width, k, least, most, mine), TEXT)

    whole = F.col("score").cast("decimal(38,0)")
    own = Window.partitionBy("anchor").orderBy(whole.desc(), "vec_id")
    near = met(anchors.join(directory, "label"), True, positives)
    near = near.withColumn("number", F.row_number().over(own)).where(F.col("number") <= positives)
    near = near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("number").cast("bigint").alias("number"), "vec_id", "score")).alias("positives"))
    ready = written(anchors.join(near, "anchor"), "positives")
    last = max(0, -(-rows.count() // shard) - 1)
    visitors = ready.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    window = Window.partitionBy("anchor", "positive").orderBy(whole.desc(), "vec_id")
    found = met(visitors, False, negatives).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        F.col("positive_score").cast("bigint").alias("positive_score"), F.col("score").cast("bigint").alias("negative_score"),
    )


def noisy(vectors: DataFrame) -> DataFrame:
    """``vectors`` where every seventh row has the next of ten labels."""
    label = F.col("label").cast("bigint")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op13(spark, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return hard_negatives(noisy(table(spark, folder, "embeddings")))


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w, row_number() OVER () AS row
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS mine, list_dot_product(a.w, c.w)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM s WHERE mine) WHERE k <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.mine AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
) WHERE rank <= 5
"""
