"""Hard negatives against plain products, and the packing."""

from collections import Counter

import numpy as np
import pytest

from tablewright.llm import negatives
from tests.llm import brute

SCHEMA = "vec_id bigint, embedding array<double>, label int, shard int, role int, number string"


def frame(spark, rows):
    return spark.createDataFrame([(v, x, label, 9, 9, "n") for v, x, label in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("size", "fields"), [(3, 3), (160, 2), (30_000, 1), (2**40, 8)])
def test_packed_products_are_exact(size, fields):
    draw = np.random.default_rng(size)
    weights, anchors = draw.integers(-size, size + 1, (37, 16)).astype(float), draw.integers(-size, size + 1, (5, 16)).astype(float)
    packed = negatives.Packed(weights, float(np.abs(anchors).max()))
    assert packed.exact == (size == 2**40) and packed.fields >= fields
    plain = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in weights] for x in anchors]
    assert packed.scores(anchors).tolist() == plain


def some(n, seed=0, labels=4):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = draw.normal(size=8) * 0.3 + (i % 3) * 0.2
        rows.append((i, [float(v) for v in np.round(x, 1 if i % 2 else 3)], 0 if i % 3 == 0 else i % labels))
    return rows


@pytest.mark.parametrize("shard", [7, 64, 16_384])
def test_against_plain_products(spark, shard):
    rows = some(230)
    found = negatives.hard_negatives(frame(spark, rows), every=10, shard=shard)
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute.hard_negatives(rows, every=10))


def test_edges(spark):
    rows = some(40)
    bad = [(0, None, 1), (10, [1.0, None], 1), (20, [float("nan")] * 8, 1), (30, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (50, [1.0] * 8, None)]
    odd = [(60, [1.0, 0.5], 1), (70, [], 1), (80, [0.0] * 8, 2), (90, [-0.7] * 8, 3)]
    found = negatives.hard_negatives(frame(spark, rows + bad + odd), every=10, shard=16)
    padded = [(v, x + [0.0] * (8 - len(x)), label) for v, x, label in rows + odd]
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute.hard_negatives(padded, every=10))
    assert negatives.hard_negatives(frame(spark, [])).collect() == []
    assert negatives.hard_negatives(frame(spark, bad)).collect() == []


def test_large_components(spark):
    rows = [(v, [x * 5e8 for x in vec], label) for v, vec, label in some(60)]
    with_small = rows + [(v + 100, vec, label) for v, vec, label in some(60, 1)]
    found = negatives.hard_negatives(frame(spark, with_small), every=10, scale=1, shard=32)
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute.hard_negatives(with_small, every=10, scale=1))


def test_repeated_rows_count_as_candidates(spark):
    rows = some(30)
    twice = rows + rows[3:6] + rows[10:11]
    found = [tuple(r) for r in negatives.hard_negatives(frame(spark, twice), every=10).collect()]
    plain = brute.hard_negatives(rows + rows[3:6], every=10)  # row 10 is one anchor, twice a candidate
    assert {r for r in found if r[0] in (0, 20)} <= {r for r in brute.hard_negatives(twice, every=10)}
    assert Counter(r[0] for r in found)[10] == Counter(r[0] for r in plain)[10]


def test_labels_that_turn(spark):
    rows = [(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None), (-7, [1.0], 3)]
    found = {r["vec_id"]: r["label"] for r in negatives.noisy(frame(spark, rows)).collect()}
    assert found == {7: 0, 8: 9, 14: None, -7: 4}
