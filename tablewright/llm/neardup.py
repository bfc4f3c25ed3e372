"""Embedding near-dedup with an inverted multi-index.

Vectors of unit length are halved, and each half has a codebook of its own: a
cell of the product grid is a pair of nearest centroids. A vector visits cells
by the multi-sequence order, in which the sum of the two centroid distances
grows, as many as the target recall took on a sample of linked vectors; there it
meets the vectors with larger ids and links those whose cosine, in double
precision, passes. So a pair is found once, by its smaller id.

The sample is drawn in rounds until it holds ``LINKED`` vectors with a link, no
two of which are near copies of each other. Where links are too rare for that,
cells are larger and a vector visits all that its cosine bound allows: a link
moves a vector by at most sqrt(2 - 2 cosine), and to be in another cell it has
to cross the planes half way to that cell's centroids. No link is lost then.

Equal vectors are one point with a count. Cells stand under their label. A cell
with more than ``BLOCK`` points is parted into blocks that its visitors all
meet; visitors stream past a block, which returns counts and spanning edges, not
pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import merge_labels, table, written
from tablewright.llm.components import components
from tablewright.llm.vectors import finite, matrix, meetings, packed

COSINE = 0.93
RECALL = 0.98  # aimed at on the sample; at least 0.9 is asked for
SAMPLE = 20_000  # points that the codebooks are fitted on
QUERIES = 400  # points in the first round of the fit; each round draws four times as many as are drawn
MOST_QUERIES = 25_600  # points drawn in all rounds
LINKED = 100  # linked points, of different groups, that the number of visits is fitted on
WIDE = 4  # blocks in a cell, on average, where all cells that the bound allows are visited
SLACK = 1e-6  # for rounding in the bound
CELL = 16  # points in a cell, on average
MOST_CENTROIDS = 1024
BLOCK = 2048
STREAM = 1024
LARGE_CELLS = 50_000  # large cells that may be broadcast
SEED = 5


def centroids(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's codebook of at most ``k`` rows."""
    draw = np.random.default_rng(SEED)
    points = points[draw.permutation(len(points))]
    out = points[:k].copy()
    for _ in range(rounds):
        near = distances(points, out).argmin(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, points)
        count = np.bincount(near, minlength=len(out))
        out = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], out)
    return out


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ to.T + (to**2).sum(1), 0)


class MultiIndex:
    def __init__(self, points: np.ndarray, k: int):
        self.half = points.shape[1] // 2
        self.books = [centroids(points[:, : self.half], k), centroids(points[:, self.half :], k)]

    def split(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        return distances(unit[:, : self.half], self.books[0]), distances(unit[:, self.half :], self.books[1])

    def cells(self, points: np.ndarray) -> np.ndarray:
        first, second = self.split(points)
        return first.argmin(1) * len(self.books[1]) + second.argmin(1)

    def visits(self, first: np.ndarray, second: np.ndarray, n: int) -> list[int]:
        """The ``n`` nearest cells of one vector, from the distances of its halves (multi-sequence traversal)."""
        a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
        x, y = first[a].tolist(), second[b].tolist()
        heap, out, wide = [(x[0] + y[0], 0, 0)], [], len(self.books[1])
        while heap and len(out) < n:
            _, i, j = heapq.heappop(heap)
            out.append(a[i] * wide + b[j])
            if j + 1 < len(y):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return out

    def allowed(self, first: np.ndarray, second: np.ndarray, least: float) -> list[np.ndarray]:
        """All cells that may hold a vector with a cosine of ``least``, for each vector."""
        a, b = _crossings(first, self.books[0]), _crossings(second, self.books[1])
        wide = len(self.books[1])
        near = [np.nonzero(x[:, None] + y[None, :] <= 2 - 2 * least + SLACK) for x, y in zip(a, b, strict=True)]
        return [i * wide + j for i, j in near]

    def rank(self, first: np.ndarray, second: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells one vector visits until it has seen each of ``cells``."""
        wide = len(self.books[1])
        reach = first[cells // wide] + second[cells % wide]
        ordered = np.sort((first[:, None] + second[None, :]).reshape(-1))
        return np.searchsorted(ordered, reach, side="right")


def _crossings(reach: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance from a half to the plane between its own centroid and each other, from its squared distances to them."""
    gap = np.linalg.norm(book[:, None] - book[None, :], axis=2)[reach.argmin(1)]
    return ((reach - reach.min(1, keepdims=True)) / np.where(gap > 0, 2 * gap, np.inf)) ** 2


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def _spread(labels: np.ndarray, vectors: np.ndarray, taken: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """Which points are no near copy of a ``taken`` one or of an earlier one here."""
    alone = np.ones(len(labels), bool)
    for at in range(0, len(labels), 1024):
        own, rows = labels[at : at + 1024], vectors[at : at + 1024]
        for i in range(0, len(taken[0]), 4096):
            near = (cosines(rows, taken[1][i : i + 4096]) >= least) & (own[:, None] == taken[0][None, i : i + 4096])
            alone[at : at + 1024] &= ~near.any(1)
        for i in range(0, at + len(own), 1024):
            near = (cosines(rows, vectors[i : i + 1024]) >= least) & (own[:, None] == labels[None, i : i + 1024])
            if i == at:
                near = np.tril(near, -1)
            alone[at : at + 1024] &= ~near.any(1)
    return alone


def _share(ranks: np.ndarray, weights: np.ndarray, recall: float) -> int:
    """Visits that find ``recall`` of the weight."""
    order = np.argsort(ranks, kind="stable")
    sofar = np.cumsum(weights[order])
    return int(ranks[order][min(np.searchsorted(sofar, recall * sofar[-1] * (1 - 1e-12)), len(order) - 1)])


def _visits_needed(points: DataFrame, index: MultiIndex, width: int, least: float, recall: float) -> int | None:
    """Visits that find ``recall`` of the links of a bounded sample, measured against all points; None if it has too few.

    They find that share of all its links, and also of the links of a vector on
    average, so that a large group does not outweigh the pairs.
    """
    spark = points.sparkSession
    draw = points.orderBy(F.xxhash64(F.lit(SEED), "vec"), "label").select("id", "label", "vec")
    taken = np.zeros(0, np.int64), np.zeros((0, width))
    seen: list[tuple[int, int, int]] = []  # (linked point, visits, links)
    drawn, upto, linked = 0, QUERIES, 0
    while drawn < MOST_QUERIES and linked < LINKED:
        some = draw.limit(min(upto, MOST_QUERIES)).collect()[drawn:]
        if not some:
            break
        ids, labels = np.array([r["id"] for r in some]), np.array([r["label"] for r in some])
        vectors = matrix([r["vec"] for r in some], width)
        drawn, upto = drawn + len(some), 4 * upto
        alone = _spread(labels, vectors, taken, least)
        ids, labels, vectors = ids[alone], labels[alone], vectors[alone]
        given = spark.sparkContext.broadcast((index, ids, labels, vectors))
        ranks = points.select("id", "label", "vec").mapInArrow(_ranks(given, width, least), "query int, visits bigint, links bigint")
        found = ranks.groupBy("query", "visits").agg(F.sum("links").alias("links")).collect()
        hit = np.unique(np.array([r["query"] for r in found], np.int64))
        seen += [(linked + int(np.searchsorted(hit, r["query"])), r["visits"], r["links"]) for r in found]
        taken = np.concatenate([taken[0], labels[hit]]), np.concatenate([taken[1], vectors[hit]])
        linked += len(hit)
    if linked < LINKED:
        return None
    query, visits, links = np.array(seen, np.int64).T
    alike = links / np.bincount(query, links)[query]
    return max(_share(visits, links.astype(float), recall), _share(visits, alike, recall))


def _ranks(given, width: int, least: float):
    """Rows (query, visits, links): how many links of a query lie in the cell of that visit."""

    def run(batches: Iterator[pa.RecordBatch]):
        own, ids, labels, queries = given.value
        found: dict[tuple[int, int], int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                rows = matrix(part.column(2).to_pylist(), width)
                row_ids, row_labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                for i in range(0, len(ids), 512):
                    some = slice(i, i + 512)
                    hit = cosines(queries[some], rows) >= least
                    hit &= (labels[some, None] == row_labels[None, :]) & (ids[some, None] != row_ids[None, :])
                    for q in np.flatnonzero(hit.any(1)):
                        first, second = own.split(queries[i + q : i + q + 1])
                        rank = own.rank(first[0], second[0], own.cells(rows[hit[q]]))
                        for r, n in zip(*np.unique(rank, return_counts=True), strict=True):
                            found[int(i + q), int(r)] = found.get((int(i + q), int(r)), 0) + int(n)
        yield pa.record_batch({
            "query": pa.array([k[0] for k in found], pa.int32()), "visits": pa.array([k[1] for k in found], pa.int64()),
            "links": pa.array(list(found.values()), pa.int64()),
        })

    return run


def _place(index, width: int, visits: int | None, least: float):
    given = index

    def run(batches: Iterator[pa.RecordBatch]):
        own = given.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                rows = matrix(part.column(2).to_pylist(), width)
                first, second = own.split(rows)
                cells = (first.argmin(1) * len(own.books[1]) + second.argmin(1)).astype(np.int64)
                if visits is None:
                    seen = [c.tolist() for c in own.allowed(first, second, least)]
                else:
                    seen = [own.visits(f, s, visits) for f, s in zip(first, second, strict=True)]
                yield pa.record_batch([*part.columns, pa.array(cells), pa.array(seen, pa.list_(pa.int64()))], names=[*part.schema.names, "cell", "visits"])

    return run


def _verify(width: int, least: float):
    """Rows (kind, a, b): kind 0 an edge, kind 1 ``b`` more links of point ``a``."""

    def run(batches: Iterator[pa.RecordBatch]):
        rows: dict[str, np.ndarray] | None = None
        for kind, part in meetings(batches, ["label", "cell", "block"], STREAM):
            if kind == "block":
                rows, block = part, matrix(part["vec"], width)
                ids, count = rows["id"].astype(np.int64), rows["n"].astype(np.int64)
                labels, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            elif kind == "stream" and rows is not None:
                other, others = part["id"].astype(np.int64), part["n"].astype(np.int64)
                hit = (cosines(matrix(part["vec"], width), block) >= least) & (other[:, None] < ids[None, :])
                q, r = np.nonzero(hit)
                if not len(q):
                    continue
                links += np.bincount(r, others[q], len(ids)).astype(np.int64)
                more = np.bincount(q, count[r], len(other)).astype(np.int64)
                first = np.full(len(other), -1)
                first[q[::-1]] = r[::-1]  # the first point that a visitor links
                merge_labels(labels, first[q], r)
                seen = np.flatnonzero(first >= 0)
                yield _rows(np.zeros(len(seen)), other[seen], ids[first[seen]])
                yield _rows(np.ones(len(seen)), other[seen], more[seen])
            elif kind == "end" and rows is not None:
                joined, linked = np.flatnonzero(labels != np.arange(len(ids))), np.flatnonzero(links)
                yield _rows(np.zeros(len(joined)), ids[joined], ids[labels[joined]])
                yield _rows(np.ones(len(linked)), ids[linked], links[linked])
                rows = None

    return run


def _rows(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array(kind.astype(np.int32)), "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})


def near_duplicates(vectors: DataFrame, least: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (vec_id, embedding, label).

    Rows are compared if their labels are equal and not null. A vector that is
    null, empty, zero, or holds null or non-finite components links with nothing,
    nor does a row without an id (its component is null, and it is kept). Vectors of
    different length are compared as if the shorter ended in zeros. Equal rows
    are links of each other; rows that share an id are one vertex. Of the links of
    ``LINKED`` or more sampled vectors the index misses at most ``1 - recall``, counted
    by link and by vector; where fewer are found it misses none, at a cost that grows
    with the square of the largest label. No link has a smaller cosine.
    """
    x = F.col("embedding")
    length = F.aggregate(F.transform(x, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v * v)
    valid = finite(x) & (length > 0) & (length < float("inf")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    base = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.xxhash64("label").alias("label"),
        F.when(valid, F.transform(x, lambda v: v.cast("double"))).alias("x"), F.coalesce(valid, F.lit(False)).alias("valid"),
    )
    rows = written(packed(base.withColumn("x", F.coalesce("x", F.array().cast("array<double>"))), "x"), "vectors")
    alone = rows.where(~F.col("valid")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    points = rows.where("valid").groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    points = written(points, "points")
    n, bytes_ = points.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    if not n:
        return alone
    width = max(2, bytes_ // 8)
    sample = matrix((r["vec"] for r in points.orderBy(F.xxhash64("vec")).limit(SAMPLE).select("vec").collect()), width)
    k = int(min(MOST_CENTROIDS, max(1, round((n / CELL) ** 0.5))))
    index = MultiIndex(sample / np.linalg.norm(sample, axis=1, keepdims=True), k)
    visits = _visits_needed(points, index, width, least, recall)
    if visits is None:
        block *= WIDE
        largest = points.groupBy("label").count().agg(F.max("count")).first()[0]
        k = int(min(MOST_CENTROIDS, max(1, round((largest / block) ** 0.5))))
        index = MultiIndex(sample / np.linalg.norm(sample, axis=1, keepdims=True), k)

    shared = points.sparkSession.sparkContext.broadcast(index)
    placed = points.select("id", "label", "vec", "n").mapInArrow(
        _place(shared, width, visits, least), "id bigint, label bigint, vec binary, n bigint, cell bigint, visits array<bigint>"
    )
    placed = written(placed, "placed")
    large = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    large = written(large, "large")
    small = large.count() <= LARGE_CELLS

    def with_blocks(df: DataFrame) -> DataFrame:
        out = df.join(F.broadcast(large) if small else large, ["label", "cell"], "left")
        return out.withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    homes = with_blocks(placed.drop("visits")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    guests = with_blocks(placed.drop("cell").withColumn("cell", F.explode("visits")).drop("visits"))
    guests = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["label", "cell", "block", "id", "n", "vec"]
    both = homes.select(F.lit(0).alias("role"), *names).unionByName(guests.select(F.lit(1).alias("role"), *names))
    keys = ["label", "cell", "block"]
    met = both.repartition(*keys).sortWithinPartitions(*keys, "role", "id").mapInArrow(_verify(width, least), "kind int, a bigint, b bigint")
    met = written(met, "met")
    roots = components(met.where("kind = 0").select("a", "b"))
    links = met.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    known = points.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("label", "vec", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"), "n")
    found = rows.where("valid").join(known, ["label", "vec"])
    found = found.select(
        "vec_id", (F.col("links") + F.col("n") - 1).cast("bigint").alias("n_links"), F.col("root").alias("component_id"),
        (F.col("vec_id") == F.col("root")).alias("kept"),
    )
    return found.unionByName(alone)


def op5(spark, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return near_duplicates(table(spark, folder, "embeddings"))
