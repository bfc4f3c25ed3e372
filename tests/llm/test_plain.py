"""Whole results of the packing and sharding queries against plain versions of their rules."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tablewright.llm import packing, queries, sharding
from tests.llm import brute
from tests.llm.test_queries import FOLDER


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"SELECT doc_id, text, source FROM '{FOLDER}/documents.parquet'").fetchall()


def test_packing(spark, docs):
    """One group holds all pieces here, so the plain rule over all bins gives every bin and offset."""
    pieces = []
    for row, (d, text, source) in enumerate(docs):
        size = len(brute.WORDS.findall(text or ""))
        for p in range(-(-size // packing.CAPACITY)):
            pieces.append((-min(packing.CAPACITY, size - p * packing.CAPACITY), row, p, d, source, text))
    assert len(pieces) <= packing.GROUP
    want = brute.pack([(d, p, -size, source, text) for size, _, p, d, source, text in sorted(pieces, key=lambda x: x[:3])], packing.CAPACITY)
    rows = queries.QUERIES["op9_best_fit_packing"](spark, FOLDER).collect()
    assert {(r["doc_id"], r["piece"]): (r["n_tokens"], r["bin"], r["bin_offset"]) for r in rows if r["n_tokens"]} == want
    assert len(rows) == len(want) + sum(not brute.WORDS.findall(t or "") for _, t, _ in docs)


@pytest.mark.parametrize(("n", "k"), [(1, 3), (7, 3), (60, 2), (120, 5), (40, 40)])
def test_differencing(n, k):
    sizes = np.sort(np.random.default_rng(n).integers(1, 50, n))[::-1]
    want = brute.differenced(sizes.tolist(), k)
    assert [want[i] for i in range(n)] == sharding.differenced(sizes, k).tolist()


def test_sharding(spark, docs):
    """Shards of the whole query: bundles of small groups, then bundles and large groups, by plain differencing."""
    rows = queries.QUERIES["op6_sharding"](spark, FOLDER).collect()
    sizes, total = defaultdict(int), Counter()
    for _, text, _ in docs:
        sizes[text] += len((text or "").encode()) + sharding.OVERHEAD
    target = max(1, sum(sizes.values()) // (sharding.SHARDS * sharding.FINE))
    small, large = sorted((s for s in sizes.values() if s <= target), reverse=True), [s for s in sizes.values() if s > target]
    k = min(max(1, -(-sum(small) // target)), len(small))
    bundle = brute.differenced(small, k)
    sums = Counter()
    for i, part in bundle.items():
        sums[part] += small[i]
    items = sorted([*sums.values(), *large], reverse=True)
    plain = Counter()
    for i, part in brute.differenced(items, sharding.SHARDS).items():
        plain[part] += items[i]
    for r in rows:
        total[r["shard"]] += r["size"]
    assert sorted(total.values()) == sorted(plain.values())


def test_many_bundles_are_bundled_again(spark):
    """Chunks of three groups: every group has one shard, and the shards stay even."""
    draw = np.random.default_rng(8)
    rows = [(i, int(draw.integers(0, 2**60)), int(b)) for i, b in enumerate([*draw.integers(1, 40, 600), 3000])]
    groups = spark.createDataFrame(rows, "h1 bigint, h2 bigint, bytes bigint")
    found = {(r["h1"], r["h2"]): r["shard"] for r in sharding.assign_shards(groups, shards=4, chunk=3, fine=8).collect()}
    assert set(found) == {(a, b) for a, b, _ in rows}
    sums = Counter()
    for a, b, size in rows:
        sums[found[a, b]] += size
    total = sum(size for *_, size in rows)
    assert len(sums) == 4 and max(sums.values()) - min(sums.values()) <= total // (4 * 8)
