"""Exact top-k by inner product with MaxScore.

A vector is a document whose terms are its components. Candidates are clustered by
a codebook, so that those of a shard are alike; a shard holds postings by component
in small blocks, with the extreme weights of each component and the norms that are
left after the first so many components. For a query that gives two bounds on what
any tail of components can add: the sum of the largest products, and the product of
the norms of both tails. The non-essential components are the longest tail that can
add at most a part of the k-th score so far. The essential ones are traversed for
the whole block; a candidate is probed in the others only while it is competitive,
and where most are, one product serves all. A block whose bound is below the k-th
score is not looked at.

Every query first searches the shard it lies in itself, which gives a k-th score to
start from. It then goes only to the shards whose bound reaches that score. What all
shards give is ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import table, written
from tablewright.llm.neardup import centroids, distances
from tablewright.llm.vectors import finite, matrix, meetings, packed

SCALE = 64
TOP = 20
EVERY = 20
SHARD = 8192  # candidates in a shard, on average at most
BLOCK = 1024
QUERIES = 256
EXACT = 2.0**52  # whole numbers below this are exact in double precision
LONG = 2**63
SAMPLE = 20_000  # vectors that the codebook is fitted on, about; it decides the speed alone
CELL = 2048  # vectors in a cluster, on average
MOST_CELLS = 1024
BOXES = 4096  # shards whose bounds a query is held against at a time
PARTS = 64  # parts of the queries that meet a set of bounds at the same time
CUTS = 8  # lengths of tail that a block has norms for
TAIL = 0.5  # part of the k-th score that non-essential components may add
DENSE = 0.05  # share of competitive candidates above which a whole block is probed by one product
SLACK = 1e-9  # for rounding in bounds


class Shard:
    """Candidates in blocks, large vectors first, so that the k-th score rises early.

    ``seen`` counts pairs of a query and a block, blocks looked at, pairs of a query and
    a candidate there, and those of them probed beyond the essential components.
    """

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        with np.errstate(over="ignore"):
            order = np.lexsort((ids, -np.linalg.norm(weights, axis=1)))
        self.peak = np.abs(weights).max(0, initial=0)
        self.blocks = []
        self.seen = {"blocks": 0, "live": 0, "pairs": 0, "probed": 0}
        width = weights.shape[1]
        self.cuts = np.unique(np.linspace(0, width, CUTS + 1).astype(int)[1:])  # the last cut leaves no tail
        for at in range(0, len(order), BLOCK):
            some = order[at : at + BLOCK]
            own = weights[some]
            first = np.argsort(-np.abs(own).mean(0), kind="stable")
            with np.errstate(over="ignore"):
                squares = own[:, first] ** 2
            norms = np.array([np.sqrt(squares[:, c:].sum(1).max(initial=0)) for c in self.cuts])
            whole = float(np.sqrt(squares.sum(1).max(initial=0)))
            self.blocks.append((ids[some], np.ascontiguousarray(own[:, first].T), first, own.min(0)[first], own.max(0)[first], norms, whole))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best candidates of every query with at least its floor; -inf where there are fewer."""
        n = len(queries)
        best = np.full((n, k), -np.inf)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        kth = floors.copy()
        for ids, postings, first, low, high, norms, whole in self.blocks:
            ordered = queries[:, first]
            most = np.maximum(ordered * low, ordered * high)
            size = np.sqrt((ordered**2).sum(1))
            live = _above(np.minimum(most.sum(1), size * whole)) >= kth
            self.seen["blocks"] += n
            at = np.flatnonzero(live)
            if not len(at):
                continue
            self.seen["live"] += len(at)
            self.seen["pairs"] += len(at) * len(ids)
            scores = self._scores(ordered[at], most[at], kth[at], postings, norms)
            scores[query_ids[at][:, None] == ids[None, :]] = -np.inf
            floor = kth[at]
            row, col = np.nonzero(scores >= np.where(floor == -np.inf, -np.finfo(float).max, floor)[:, None])
            if len(row) > 4 * k * len(at) and len(ids) > k:
                floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
                row, col = np.nonzero(scores >= np.where(floor == -np.inf, -np.finfo(float).max, floor)[:, None])
            touched = np.unique(row)
            if not len(touched):
                continue
            rows = np.concatenate([np.repeat(at[touched], k), at[row]])
            values = np.concatenate([best[at[touched]].ravel(), scores[row, col]])
            names = np.concatenate([best_id[at[touched]].ravel(), ids[col]])
            order = np.lexsort((names, -values, rows))
            starts = np.searchsorted(rows[order], at[touched])
            pick = order[starts[:, None] + np.arange(k)]
            best[at[touched]], best_id[at[touched]] = values[pick], names[pick]
            kth = np.maximum(floors, best[:, -1])
        return best, best_id

    def _scores(self, queries: np.ndarray, most: np.ndarray, kth: np.ndarray, postings: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Scores with a block; -inf for candidates that are not competitive."""
        n, width = queries.shape
        sums = np.concatenate([np.cumsum(most[:, ::-1], 1)[:, ::-1], np.zeros((n, 1))], 1)[:, self.cuts]
        squares = np.concatenate([np.cumsum((queries**2)[:, ::-1], 1)[:, ::-1], np.zeros((n, 1))], 1)[:, self.cuts]
        spare = _above(np.minimum(sums, np.sqrt(np.maximum(squares, 0)) * norms[None, :]))
        enough = spare <= TAIL * np.maximum(kth, 0)[:, None]
        enough[:, -1] = True
        cut = enough.argmax(1)
        out = np.empty((n, postings.shape[1]))
        for c in np.unique(cut):
            at, m = np.flatnonzero(cut == c), self.cuts[c]
            seen = queries[at, :m] @ postings[:m]
            if m < width:
                competitive = seen + spare[at, c][:, None] >= kth[at][:, None]
                share = competitive.mean()
                if share > DENSE:
                    seen += queries[at, m:] @ postings[m:]
                    self.seen["probed"] += competitive.size
                else:
                    row, col = np.nonzero(competitive)
                    self.seen["probed"] += len(row)
                    left = np.full(seen.shape, -np.inf)
                    for i in range(0, len(row), 1 << 16):
                        r, k = row[i : i + (1 << 16)], col[i : i + (1 << 16)]
                        left[r, k] = seen[r, k] + np.einsum("ij,ji->i", queries[at[r], m:], postings[m:, k])
                    seen = left
            out[at] = seen
        return out

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """What no sum of products of a query can pass."""
        with np.errstate(over="ignore"):
            return (np.abs(queries) * self.peak).sum(1)

    def box(self) -> np.ndarray:
        """Least and greatest weight of each component, mean weights, and how far a candidate is from the mean."""
        width = len(self.peak)
        whole = np.zeros((sum(len(b[0]) for b in self.blocks), width))
        at = 0
        for ids, postings, first, *_ in self.blocks:
            whole[at : at + len(ids), first] = postings.T
            at += len(ids)
        with np.errstate(over="ignore", invalid="ignore"):
            mean = whole.mean(0)
            far = np.sqrt(((whole - mean) ** 2).sum(1).max(initial=0))
        return np.concatenate([whole.min(0), whole.max(0), mean, [far]])

    def exact(self, query_id: int, query: np.ndarray, bound: float, k: int) -> list[tuple[int, int]]:
        """Scores and ids of the k best candidates of one query, in 64-bit whole numbers, or in Python's if they may not do."""
        used = (query != 0) & (self.peak != 0)
        whole = (lambda x: x.astype(np.int64)) if bound < LONG / 2 else np.frompyfunc(int, 1, 1)
        best: list[tuple[int, int]] = []
        for ids, postings, first, *_ in self.blocks:
            own = np.flatnonzero(used[first])
            scores = (whole(query[first[own]])[:, None] * whole(postings[own])).sum(0) if len(own) else np.zeros(len(ids), np.int64)
            found = [(-int(v), int(i)) for v, i in zip(scores, ids, strict=True) if i != query_id]
            best = sorted(best + found)[:k]
        return [(-v, i) for v, i in best]


def _above(bound: np.ndarray) -> np.ndarray:
    """No less than the exact bound, whatever was rounded on the way."""
    return bound + np.abs(bound) * SLACK + SLACK


FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint, over boolean, shard bigint, box binary"


def _search(width: int, k: int, home: bool):
    """``home``: the queries of the shard itself, and its box; else queries that come with a floor."""

    def run(batches: Iterator[pa.RecordBatch]):
        shard = None
        for kind, rows in meetings(batches, ["shard"], QUERIES, alone=home):
            if kind == "block":
                shard = Shard(rows["vec_id"].astype(np.int64), matrix(rows["vec"], width))
                if home:
                    yield _rows([], [], [], [], int(rows["shard"][0]), shard.box())
            elif kind == "end":
                shard = None
            elif shard is not None:
                for at in range(0, len(rows["vec_id"]), QUERIES):
                    ids = rows["vec_id"][at : at + QUERIES].astype(np.int64)
                    names, queries = rows["row"][at : at + QUERIES].astype(np.int64), matrix(rows["vec"][at : at + QUERIES], width)
                    floors = rows["floor"][at : at + QUERIES].astype(float)
                    bound = shard.bound(queries)
                    fine = bound < EXACT
                    score, found = shard.search(ids[fine], queries[fine], floors[fine], k)
                    row, col = np.nonzero(np.isfinite(score))
                    yield _rows(names[fine][row], ids[fine][row], found[row, col], score[row, col].astype(np.int64).tolist())
                    for j in np.flatnonzero(~fine):
                        best = shard.exact(int(ids[j]), queries[j], float(bound[j]), k)
                        yield _rows(np.full(len(best), names[j]), np.full(len(best), ids[j]), [i for _, i in best], [v for v, _ in best])

    return run


def _rows(query_row, query_id, vec_id, scores: list[int], shard: int | None = None, box: np.ndarray | None = None) -> pa.RecordBatch:
    """Scores, or the box of a shard. A score that no long holds is null, and ``over`` if it is above."""
    if box is not None:
        query_row, query_id, vec_id, scores = [None], [None], [None], [None]
    held = [v if v is not None and -LONG <= v < LONG else None for v in scores]
    return pa.record_batch({
        "query_row": pa.array(query_row, pa.int64()), "query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()),
        "score": pa.array(held, pa.int64()), "over": pa.array([v is not None and v >= LONG for v in scores], pa.bool_()),
        "shard": pa.array([shard] * len(scores), pa.int64()), "box": pa.array([box.tobytes() if box is not None else None] * len(scores), pa.binary()),
    })


def _route(width: int):
    """Queries to the shards, other than their own, whose bound reaches their floor."""

    def run(batches: Iterator[pa.RecordBatch]):
        shards = None
        for kind, rows in meetings(batches, ["chunk", "part"], QUERIES):
            if kind == "block":
                shards = rows["shard"].astype(np.int64)
                boxes = matrix(rows["vec"], 3 * width + 1)
                low, high, mean, far = boxes[:, :width], boxes[:, width : 2 * width], boxes[:, 2 * width : 3 * width], boxes[:, -1]
                peak = np.maximum(np.abs(low), np.abs(high))
            elif kind == "stream":
                queries, floors = matrix(rows["vec"], width), rows["floor"].astype(float)
                with np.errstate(over="ignore", invalid="ignore"):
                    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
                    bound = plus @ high.T + minus @ low.T
                    ball = queries @ mean.T + np.sqrt((queries**2).sum(1))[:, None] * far[None, :]
                    size = np.abs(queries) @ peak.T
                    reach = np.minimum(bound, np.where(np.isnan(ball), np.inf, ball))
                    reaches = (reach + np.abs(size) * SLACK + SLACK >= floors[:, None]) | ~(size < EXACT)
                reaches &= rows["shard"].astype(np.int64)[:, None] != shards[None, :]
                row, col = np.nonzero(reaches)
                yield pa.record_batch({
                    "row": pa.array(rows["row"][row].astype(np.int64)), "vec_id": pa.array(rows["vec_id"][row].astype(np.int64)),
                    "vec": pa.array([rows["vec"][r] for r in row], pa.binary()), "floor": pa.array(floors[row]), "shard": pa.array(shards[col]),
                })

    return run


def _clustered(rows: DataFrame, width: int, n: int, peak: float, shard: int, cell: int) -> DataFrame:
    """``rows`` with the number of a shard of at most about ``shard`` vectors that are near each other."""
    spark = rows.sparkSession
    sample = rows.where(F.pmod(F.xxhash64(F.lit(11), "number"), F.lit(max(1, n // SAMPLE))) == 0).select("vec").collect()
    points = matrix([r["vec"] for r in sample], width) / max(peak, 1.0)
    book = centroids(points, min(MOST_CELLS, max(1, n // cell)), 5) if len(points) else np.zeros((1, width))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            own = matrix(batch.column(batch.schema.names.index("vec")).to_pylist(), width) / max(peak, 1.0)
            yield batch.append_column("cell", pa.array(distances(own, book).argmin(1).astype(np.int32)) if len(own) else pa.array([], pa.int32()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int"
    celled = written(rows.mapInArrow(run, schema), "cells")
    # as many rows as the codebook has cells
    counts = [(r["cell"], -(-r["count"] // shard)) for r in celled.groupBy("cell").count().orderBy("cell").collect()]
    pieces = spark.createDataFrame([(c, p, sum(x for _, x in counts[:i])) for i, (c, p) in enumerate(counts)], "cell int, pieces int, first int")
    number = F.col("first") + F.pmod(F.xxhash64(F.lit(5), "number"), F.col("pieces"))
    return celled.join(F.broadcast(pieces), "cell").withColumn("shard", number.cast("bigint")).drop("cell", "pieces", "first")


def top_inner_products(
    vectors: DataFrame, every: int = EVERY, k: int = TOP, scale: int = SCALE, shard: int = SHARD, cell: int = CELL
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of every row whose id is divisible by ``every``.

    ``vectors`` has vec_id and embedding. A weight is floor(scale * x); vectors
    of different length are compared as if the shorter ended in zeros. Rows
    without an id, and vectors that are null or hold null or non-finite
    components, take no part. A candidate is every row with another id than the
    query; repeated candidate rows each count, rows equal in id and vector are
    one query. Ties go to the smaller id. An empty table gives no row; other columns
    are ignored. Where a score could pass 2**52, a query
    and a shard are scored in whole numbers and the query goes to that shard whatever its bound; only a score among the ``k`` best
    that a long cannot hold, or a weight beyond double precision, is refused. The
    stated queries meet every shard of candidates that their bound does not rule out;
    a shard is bounded, and queries stream past it.
    """
    x = F.col("embedding")

    def weight(v):
        scaled = v.cast("double") * scale
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # beyond it there are no fractions

    weights = F.transform(x, weight)
    valid = vectors.where(finite(x) & F.col("vec_id").isNotNull())
    rows = packed(valid.select(F.col("vec_id").cast("bigint").alias("vec_id"), weights.alias("w")), "w")
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()), "weights")
    n, bytes_ = rows.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    width = (bytes_ or 0) // 8
    largest = valid.agg(F.max(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))))).first()[0] or 0.0
    peak = largest * scale + 1
    if peak == float("inf"):
        raise ValueError("weights beyond double precision")
    placed = written(_clustered(rows, width, n, peak, shard, cell), "shards")
    candidates = placed.select("shard", "vec_id", "vec", F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("row"), F.lit(0.0).alias("floor"))
    own = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id", "vec").agg(F.min_by(F.struct("number", "shard"), "number").alias("x"))
    own = own.select(F.col("x.shard").alias("shard"), "vec_id", "vec", F.lit(1).alias("role"), F.col("x.number").alias("row"), F.lit(float("-inf")).alias("floor"))
    own = written(own, "queries")

    def met(queries: DataFrame, home: bool) -> DataFrame:
        both = candidates.unionByName(queries.select(*candidates.columns)).repartition("shard").sortWithinPartitions("shard", "role", "vec_id")
        return both.mapInArrow(_search(width, k, home), FOUND)

    near = written(met(own, True), "near")
    first = near.where(F.col("box").isNull()).drop("box", "shard")
    # the k-th score of a query whose own shard had as many
    floors = first.groupBy("query_row").agg(F.min("score").alias("least"), F.count("score").alias("held"))
    floored = own.drop("floor").join(floors, F.col("row") == F.col("query_row"), "left").drop("query_row")
    floored = floored.withColumn("floor", F.when((F.col("held") >= k) & (F.abs("least") < EXACT), F.col("least").cast("double")).otherwise(F.lit(float("-inf"))))
    boxes = near.where(F.col("box").isNotNull()).select((F.col("shard") / BOXES).cast("bigint").alias("chunk"), "shard", F.col("box").alias("vec"))
    chunks = boxes.agg(F.max("chunk")).first()[0] or 0
    boxes = boxes.select("chunk", F.lit(0).alias("role"), "shard", F.lit(0).cast("bigint").alias("vec_id"), "vec", F.lit(0).cast("bigint").alias("row"), F.lit(0.0).alias("floor"))
    asked = floored.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks).cast("bigint"))))
    asked = asked.select("chunk", "role", "shard", "vec_id", "vec", "row", "floor", F.pmod(F.xxhash64("row"), F.lit(PARTS)).alias("part"))
    boxes = boxes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    routed = boxes.unionByName(asked).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "role", "shard")
    routed = routed.mapInArrow(_route(width), "row bigint, vec_id bigint, vec binary, floor double, shard bigint").withColumn("role", F.lit(1))
    found = first.unionByName(met(routed, False).drop("box", "shard"))
    large = peak >= (EXACT / max(width, 1)) ** 0.5
    if large:
        found = written(found, "found")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if large and (not found.where("over").isEmpty() or not ranked.where("score IS NULL").isEmpty()):
        raise ValueError("a score among the best does not fit a long")
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8(spark, folder: str) -> DataFrame:
    """Twenty best inner products of every twentieth vector."""
    return top_inner_products(table(spark, folder, "embeddings"))


SQL = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
) WHERE rank <= 20
"""
