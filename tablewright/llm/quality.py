"""Quality scores: random-indexing vectors, pooled, and a two-layer network.

A token has two names: its lower-case word, and its form (letters as a or A,
digits as 0, runs shortened, a mark if it repeats the token before). Names hash
into a fixed number of rows. Random indexing gives every row a sparse random
index vector, and a row's word vector is the sum of the index vectors around its
occurrences. A document is the mean of its tokens' vectors. A network with one
hidden layer, written in numpy, scores it, and a temperature fitted on rows the
network has not seen makes the score a probability.

The fit reads at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id. Scoring sees every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tablewright.llm.common import fold, held_out, table, written

SAMPLE = 6000  # labelled rows that the fit may read
ROWS = 1 << 13  # vectors for words, and as many for forms
WIDTH = 32
REACH = 2  # tokens on both sides that make a context
HIDDEN = 24
SLICE = 1 << 17  # tokens pooled at once
SEED = 11
REPEAT = b"="
_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0")]


def form(token: bytes) -> bytes:
    for pattern, short in _RUNS:
        token = pattern.sub(short, token)
    return token[:12]


class Names(dict):
    """Token to its word row, form row, and form row when repeated, 13 bits each; forgotten when large."""

    def __missing__(self, token: bytes):
        if len(self) > 400_000:
            self.clear()
        shape = form(token)
        rows = [zlib.crc32(name) % ROWS for name in (token.lower(), shape, REPEAT + shape)]
        self[token] = packed = rows[0] | rows[1] << 13 | rows[2] << 26
        return packed


def token_rows(text: bytes | None, names: Names) -> np.ndarray:
    """(2, tokens) row numbers of a text's words and forms."""
    tokens = (text or b"").split()
    packed = np.fromiter(map(names.__getitem__, tokens), np.int64, len(tokens))
    again = np.zeros(len(tokens), bool)
    again[1:] = packed[1:] == packed[:-1]
    return np.stack([packed & ROWS - 1, ROWS + (np.where(again, packed >> 26, packed >> 13) & ROWS - 1)])


def index_vectors() -> np.ndarray:
    """Four random +1 and -1 in every row."""
    draw = np.random.default_rng(SEED)
    out = np.zeros((2 * ROWS, WIDTH), np.float32)
    for _ in range(4):
        out[np.arange(2 * ROWS), draw.integers(0, WIDTH, 2 * ROWS)] += draw.choice([-1.0, 1.0], 2 * ROWS)
    return out


def contexts(texts: list[bytes | None]) -> np.ndarray:
    """Sum of the index vectors around every row's occurrences, those of the token itself included."""
    names, index = Names(), index_vectors()
    out = np.zeros((2 * ROWS, WIDTH), np.float64)
    for text in texts:
        rows = token_rows(text, names)
        for kind in (0, 1):
            own = rows[kind]
            near = index[own].copy()
            for step in range(1, REACH + 1):
                near[step:] += index[own[:-step]]
                near[:-step] += index[own[step:]]
            np.add.at(out, own, near)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context sums as unit vectors; rows never seen keep their index vector."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    out = np.where(norm > 0, sums / np.maximum(norm, 1e-12), index_vectors() / 2)
    return out.astype(np.float32)


def pooled(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean form vector of every text, zero without tokens."""
    names = Names()
    sums = np.zeros((len(texts), 2 * WIDTH))
    total = np.zeros(len(texts))
    held, owners, size = [], [], 0

    def flush():
        rows, cuts = np.concatenate(held, axis=1), np.cumsum([0] + [h.shape[1] for h in held[:-1]])
        for kind in (0, 1):
            part = np.add.reduceat(vectors[rows[kind]], cuts, axis=0)
            np.add.at(sums[:, kind * WIDTH : (kind + 1) * WIDTH], owners, part)

    for i, text in enumerate(texts):
        rows = token_rows(text, names)
        total[i] = rows.shape[1]
        for at in range(0, rows.shape[1], SLICE):
            held.append(rows[:, at : at + SLICE])
            owners.append(i)
            size += held[-1].shape[1]
            if size >= SLICE:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return sums / np.maximum(total, 1)[:, None]


@dataclass
class Network:
    """Hidden tanh layer, one logit, a temperature. Weights are plain arrays."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 300, rate: float = 0.02, decay: float = 1e-4) -> Network:
    """Full-batch Adam on the cross-entropy, classes weighted evenly."""
    draw = np.random.default_rng(SEED)
    scale = x.std(0) + 1e-3
    net = Network(x.mean(0), scale, draw.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.2, HIDDEN), 0.0)
    z = (x - net.mean) / scale
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else np.ones(len(y))
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        hidden = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -50, 50)))
        slope = weight * (p - y) / len(y)
        back = np.outer(slope, params[2]) * (1 - hidden**2)
        grads = [z.T @ back + decay * params[0], back.sum(0), hidden.T @ slope + decay * params[2], np.array([slope.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature with the smallest cross-entropy on rows that the network has not seen."""
    logits = net.logits(x)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 61):
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -50, 50))), 1e-9, 1 - 1e-9)
        best = min(best, (float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), float(t)))
    net.temperature = best[1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network | float]:
    """Word vectors and network, or the only score if there are no two classes to learn from.

    Learns from labels of rows outside fold 1 that have an id, a label of 0 or
    1, and a document. An id with several labels counts with the smallest.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 1))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    # both classes: half of the sample for the rarer one, as far as it goes
    draw = F.xxhash64(F.lit(SEED), "id")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(draw, "id").limit(sample // 2)
        picked = part if picked is None else picked.unionByName(part)
    wanted = [(r["id"], r["y"]) for r in picked.collect()]  # at most ``sample`` ids
    spark = docs.sparkSession
    small = spark.createDataFrame(wanted, "id bigint, y int")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(small), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = written(rows.repartition(8, "id"), "sample")

    def sums(batches: Iterator[pa.RecordBatch]):
        found = [t for b in batches for t in b.column(0).to_pylist()]
        if found:
            yield pa.record_batch([pa.array([contexts(found).tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((2 * ROWS, WIDTH))
    for row in rows.select("text").mapInArrow(sums, "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"]).reshape(total.shape)
    vectors = word_vectors(total)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = pooled(b.column(2).to_pylist(), shared.value)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "y", "x"])

    got = sorted(rows.select("id", "y", "text").mapInArrow(features, "id bigint, y int, x binary").collect())
    if not got:
        return vectors, 0.5
    x, y = np.stack([np.frombuffer(r["x"]) for r in got]), np.array([r["y"] for r in got], float)
    if y.min() == y.max():
        return vectors, float(y[0])
    last = np.random.default_rng(SEED).permutation(len(y)) % 5 == 0
    if not 0 < y[~last].mean() < 1 or not last.any():
        return vectors, train(x, y)
    net = train(x[~last], y[~last])
    calibrate(net, x[last], y[last])
    return vectors, net


def with_scores(docs: DataFrame, vectors: np.ndarray, net: Network | float) -> DataFrame:
    """``docs`` with a column ``__score``, by the text alone. Null, empty and blank texts share a score.

    All columns stay, whatever their names but ``__score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]):
        words, model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                x = pooled(b.column("text").cast(pa.binary()).to_pylist(), words)
                score = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
                yield pa.record_batch([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "__score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__score", DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, repeated rows and null ids included.

    A null text scores like an empty one, a text of any length is read whole. An empty
    table gives no row; without labels of both classes all scores are one number.
    """
    out = with_scores(docs.select("doc_id", "text"), *fit(docs, labels, sample))
    score = F.col("__score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_poor(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without rows that score under ``least``; a score of just ``least`` stays.

    All columns stay, repeated rows too. Null and empty texts go or stay together.
    An empty table stays empty.
    """
    scored = with_scores(docs, *fit(docs, labels, sample))
    return scored.where(F.col("__score") >= least).drop("__score")


def op4(spark, folder: str) -> DataFrame:
    """Quality score of every document."""
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
