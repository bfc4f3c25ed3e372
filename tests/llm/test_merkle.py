"""The manifest against plain trees, and its layout."""

from collections import Counter

import numpy as np
import pytest

from tablewright.llm import merkle
from tests.llm import brute

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, leaf string, role int"


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 8, 11])
def test_layout(levels):
    """Every node has an address of its own, and aligned subtrees of half the height lie together."""
    at = [merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range((1 << levels) - 1))
    top = levels // 2
    for i in range(1 << top if levels > 1 else 0):
        inside = np.concatenate([at[d][i << (d - top) : (i + 1) << (d - top)] for d in range(top, levels)])
        assert inside.max() - inside.min() == len(inside) - 1


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8])
def test_block(count):
    leaves = [merkle.digest(str(i)) for i in range(count)]
    block = merkle.Block.built(3, leaves)
    again = merkle.Block(3, count, block.nodes.tobytes())
    root = block.nodes[0].tobytes().hex()
    paths = again.paths(np.arange(count))
    assert all(merkle.folded(x, p) == root and merkle.steps("".join(p)) == p for x, p in zip(leaves, paths, strict=True))
    assert merkle.folded(merkle.digest("other"), paths[0]) != root


def rows_of(n):
    langs = ["en"] * 5 + ["de", "fr", None, "ü"]
    out = [(i, f"s{i % 3}", langs[i % len(langs)], i, f"text {i} é") for i in range(n)]
    return [*out, (None, None, None, None, None), (2**62 + 1, "s", "en", 2**62, "big"), (7, "s", "alone", None, "")]


@pytest.mark.parametrize(("n", "most"), [(0, 10), (1, 2), (60, 1), (137, 2), (137, 10)])
def test_manifest(spark, n, most):
    rows = rows_of(n)
    rows += rows[:40] * 2  # repeated rows
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    out = merkle.manifest(spark, merkle.document_leaves(df), most)
    found = Counter(tuple(r)[:-1] for r in out.collect())
    assert found == Counter(brute.merkle(rows))


def test_paths_prove(spark):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows_of(40)], SCHEMA)
    for r in merkle.manifest(spark, merkle.document_leaves(df, 10**9), 2, keep_path=True).collect():
        assert r["verified"] and merkle.folded(r["leaf"], merkle.steps(r["path"])) == r["root"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(spark, merkle.document_leaves(df)).collect() == []
