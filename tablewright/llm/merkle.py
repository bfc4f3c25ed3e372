"""Merkle manifest of a dataset in van Emde Boas blocks.

Leaves stand in groups, one tree for each group; the roots of the groups are the
leaves of one more tree, whose root names the dataset. A tree is cut into aligned
blocks of ``HEIGHT`` levels. A block is one row: its nodes lie in a van Emde Boas
layout, in which a tree is split at half its height and the upper part is stored
before the lower ones, each again in the same way, so that a path from leaf to
root touches few stretches of memory whatever their length. Addresses follow from
depth and index alone, both when a block is filled and when siblings are read.

The roots of blocks are the leaves of the next round, until one block is left in
each group. Proofs go down the same rounds: a block gets the path above its root
and hands it on, lengthened by the siblings inside, to the nodes that it stands
for. No task holds more than a block and no tree is ever in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table, whole_runs, written
from tablewright.llm.vectors import meetings
from tablewright.operators.ordered import with_rank_and_size

HEIGHT = 10  # levels of edges in a block: 1024 leaves, 64 KB of nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7
STREAM = 4096
ALL = "all"  # the group of the tree over group roots
NONE, LEFT, RIGHT = "-", "<", ">"  # in a path: no sibling, a sibling on the left, on the right
NODES = "grp string, block bigint, size bigint, root string, nodes binary"


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a ``depth`` lie in the layout of a complete tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    bottom, below = levels - top, depth - top
    inside = address(bottom, below, index & ((1 << below) - 1))
    return (1 << top) - 1 + (index >> below) * ((1 << bottom) - 1) + inside


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(size: int, most: int) -> int:
    """Levels of edges in a block of a tree of ``size`` leaves; ``most`` where the tree has several blocks."""
    return min(most, max(0, int(size - 1).bit_length()))


class Block:
    """A complete tree of ``height`` levels of edges, of whose leaves the first ``count`` are there."""

    def __init__(self, height: int, count: int, nodes: bytes = b""):
        self.height, self.count = height, count
        size = (2 << height) - 1
        self.nodes = np.frombuffer(nodes, np.uint8).reshape(size, 32) if nodes else np.zeros((size, 32), np.uint8)

    @classmethod
    def built(cls, height: int, leaves: list[str]) -> Block:
        block, row = cls(height, len(leaves)), leaves
        for depth in range(height, -1, -1):
            at = address(height + 1, depth, np.arange(len(row)))
            block.nodes[at] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
            if depth:
                row = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)]
        return block

    def present(self, depth: int) -> int:
        return -(-self.count >> (self.height - depth)) if self.count else 0

    def paths(self, slots: np.ndarray) -> list[list[str]]:
        """For each leaf, what meets it on its way up: a side and the sibling's digest, or that there is none."""
        out: list[list[str]] = [[] for _ in slots]
        for depth in range(self.height, 0, -1):
            here = slots >> (self.height - depth)
            other = here ^ 1
            there = other < self.present(depth)
            found = self.nodes[address(self.height + 1, depth, np.where(there, other, 0))].tobytes().hex()
            for i, (has, left) in enumerate(zip(there.tolist(), (other < here).tolist(), strict=True)):
                out[i].append(((LEFT if left else RIGHT) + found[64 * i : 64 * i + 64]) if has else NONE)
        return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for step in path:
        leaf = digest(step[1:], leaf) if step[0] == LEFT else digest(leaf, step[1:])
    return leaf


def steps(path: str) -> list[str]:
    """A path as one text, cut into its steps."""
    out, at = [], 0
    while at < len(path):
        end = at + (1 if path[at] == NONE else 65)
        out.append(path[at:end])
        at = end
    return out


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values as text, each with its length in bytes before it; a null is ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _build(most: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for piece in whole_runs(batches, ["grp", "block"]):
            grp, block = piece["grp"], piece["block"]
            cuts = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (block[1:] != block[:-1]), [True]]))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                size = int(piece["size"][a])
                own = Block.built(height_of(size, most), piece["digest"][a:z].tolist())
                yield pa.record_batch({
                    "grp": pa.array([grp[a]], pa.string()), "block": pa.array([block[a]], pa.int64()), "size": pa.array([size], pa.int64()),
                    "root": pa.array([own.nodes[0].tobytes().hex()], pa.string()), "nodes": pa.array([own.nodes.tobytes()], pa.binary()),
                })

    return run


def _blocked(items: DataFrame, most: int) -> DataFrame:
    return items.withColumn("block", F.shiftright("pos", most))


def forest(items: DataFrame, most: int, largest: int) -> list[tuple[DataFrame, DataFrame]]:
    """Rounds of (nodes to hash, their blocks); ``items`` has grp, pos, size of the group and digest.

    A group whose nodes fit one block ends in that round: the block's root is the group's.
    """
    rounds = []
    while True:
        items = _blocked(items, most)
        blocks = items.select("grp", "block", "pos", "size", "digest").repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
        blocks = written(blocks.mapInArrow(_build(most), NODES), "merkle")
        rounds.append((items, blocks))
        if largest <= 1 << most:
            return rounds
        largest = -(-largest >> most)
        items = blocks.where(F.col("size") > 1 << most).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("size") / (1 << most)).cast("bigint").alias("size"), F.col("root").alias("digest")
        )


def roots(rounds: list[tuple[DataFrame, DataFrame]], most: int) -> DataFrame:
    """``(grp, root)`` of every group."""
    out = None
    for _, blocks in rounds:
        done = blocks.where(F.col("size") <= 1 << most).select("grp", "root")
        out = done if out is None else out.unionByName(done)
    return out


def _climb(most: int, last: bool, keep_path: bool):
    """Nodes that meet their block; ``last`` in the round of the leaves, which are proved."""

    def run(batches: Iterator[pa.RecordBatch]):
        block, above, subroot = None, [], None
        for kind, rows in meetings(batches, ["grp", "block"], STREAM):
            if kind == "block":
                own = int(np.flatnonzero([n is not None for n in rows["nodes"]])[0])
                over = int(np.flatnonzero([u is not None for u in rows["above"]])[0])
                size, number = int(rows["size"][own]), int(rows["block"][own])
                count = min(size - (number << most), 1 << most)
                block = Block(height_of(size, most), count, rows["nodes"][own])
                above, subroot = steps(rows["above"][over]), rows["subroot"][over]
            elif kind == "stream":
                slots = rows["pos"].astype(np.int64) & ((1 << most) - 1)
                paths = [own + above for own in block.paths(slots)]
                if not last:
                    yield pa.record_batch({
                        "grp": pa.array(rows["grp"], pa.string()), "block": pa.array(rows["pos"].astype(np.int64)),
                        "above": pa.array(["".join(p) for p in paths], pa.string()), "subroot": pa.array([subroot] * len(paths), pa.string()),
                    })
                    continue
                yield pa.record_batch({
                    "subroot": pa.array([subroot] * len(paths), pa.string()),
                    "proof_sha256": pa.array([digest(*(s[1:] for s in p)) for p in paths], pa.string()),
                    "folded_root": pa.array([folded(x, p) for x, p in zip(rows["claim"], paths, strict=True)], pa.string()),
                    "doc_id": pa.array(rows["doc_id"], pa.string()), "leaf": pa.array(rows["digest"], pa.string()),
                    "path": pa.array(["".join(p) for p in paths] if keep_path else [None] * len(paths), pa.string()),
                })

    return run


def _descend(rounds, tops: DataFrame, most: int, keep_path: bool = False) -> DataFrame:
    """Paths of the nodes of the first round; ``tops`` has grp, above and subroot of every group."""
    for level in range(len(rounds) - 1, -1, -1):
        items, blocks = rounds[level]
        first = blocks.where(F.col("size") <= 1 << most).select("grp", "block").join(tops, "grp")
        above = first if level == len(rounds) - 1 else first.unionByName(passed)
        last = level == 0 and "claim" in items.columns
        parts = [
            blocks.select("grp", "block", "size", "nodes").withColumn("role", F.lit(0)),
            above.select("grp", "block", "above", "subroot").withColumn("role", F.lit(0)),
            items.select("grp", "block", "pos", *(["digest", "claim", F.col("doc_id").cast("string").alias("doc_id")] if last else [])).withColumn("role", F.lit(1)),
        ]
        met = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        schema = "subroot string, proof_sha256 string, folded_root string, doc_id string, leaf string, path string" if last else "grp string, block bigint, above string, subroot string"
        met = met.repartition("grp", "block").sortWithinPartitions("grp", "block", "role", "pos")
        passed = met.mapInArrow(_climb(most, last, keep_path), schema)
        if not last:
            passed = written(passed, "above")
    return passed


def _placed(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``pos`` from 0 in the group and its ``size``; a large group spreads over many tasks."""
    ranked = with_rank_and_size(leaves, [group], order)
    return ranked.withColumn("pos", F.col("_rank").cast("bigint") - 1).withColumn("size", F.col("_size").cast("bigint")).drop("_rank", "_size")


def manifest(spark: SparkSession, leaves: DataFrame, most: int = HEIGHT, keep_path: bool = False) -> DataFrame:
    """Roots and proofs of ``leaves``: grp, doc_id, digest and claim (what is folded along the leaf's path).

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and
    path, which is null unless asked for. In a group leaves ascend by doc_id, null
    first, rows of one id by digest; rows equal in both keep any order, which
    changes no root but gives each its own proof. Groups ascend bytewise, a null
    one first. A node without a sibling is hashed alone. A group of one leaf has
    that leaf as its subroot; a single group's subroot is the root. Empty
    input gives no row.
    """
    named = leaves.select(
        F.coalesce(F.concat(F.lit("x"), F.col("grp")), F.lit("")).alias("grp"), "doc_id", "digest", "claim", F.monotonically_increasing_id().alias("row")
    )
    placed = written(_placed(written(named, "leaves"), "grp", ["doc_id", "digest", "row"]), "placed")
    largest = placed.agg(F.max("size")).first()[0]
    if largest is None:
        schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path string"
        return spark.createDataFrame([], schema)
    rounds = forest(placed, most, largest)
    subroots = written(roots(rounds, most), "subroots")
    groups = subroots.select(F.lit(ALL).alias("tree"), "grp", F.col("root").alias("digest"))
    tops = written(_placed(groups, "tree", ["grp"]), "groups")
    nodes = tops.select(F.col("tree").alias("grp"), "pos", "size", "digest")
    over = forest(nodes, most, tops.agg(F.max("size")).first()[0])
    root = roots(over, most).first()["root"]
    start = spark.createDataFrame([(ALL, "", "")], "grp string, above string, subroot string")
    ways = _descend(over, start, most).select(F.col("block").alias("pos"), "above")
    known = written(tops.join(ways, "pos").select("grp", "above", F.col("digest").alias("subroot")), "ways")
    proved = _descend(rounds, known, most, keep_path)
    return proved.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"), "path",
    )


def document_leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """A leaf for each document in the group of its language.

    ``claim`` is the leaf itself, or where ``tampered`` divides the crc32 of the id
    the leaf that the document would have with one more in n_chars; a null id is
    never tampered with and a null n_chars stays null.
    """
    own = [F.col(f) for f in FIELDS]
    more = [F.col("n_chars").cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string")) % tampered == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest(own).alias("digest"), F.when(hit, leaf_digest(more)).alias("claim"))
    return leaves.withColumn("claim", F.coalesce("claim", "digest"))


def op12(spark, folder: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document."""
    return manifest(spark, document_leaves(table(spark, folder, "documents"))).drop("path")


SQL = """
WITH RECURSIVE crc AS (
  SELECT list(t ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
    FROM range(256) r(i))
), d AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit
  FROM documents, crc
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n,
         row_number() OVER () AS row
  FROM (
    SELECT doc_id, coalesce('x' || lang, '') AS grp, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
      sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || tail) AS claim
    FROM (SELECT * REPLACE (coalesce(hit, false) AS hit) FROM d))
), tree AS (
  SELECT 0 AS level, grp, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, grp, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, grp, pos // 2, n
), node AS MATERIALIZED (SELECT * FROM tree), sub AS MATERIALIZED (
  SELECT grp, h AS subroot, level AS levels, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), over AS MATERIALIZED (SELECT * FROM top), root AS (SELECT h AS root FROM over WHERE n = 1), way AS MATERIALIZED (
  SELECT l.row, x.level, (l.pos >> x.level) % 2 AS odd, s.h FROM leaves l JOIN node x ON x.grp = l.grp AND x.pos = l.pos >> x.level AND x.n > 1
  LEFT JOIN node s ON s.grp = l.grp AND s.level = x.level AND s.pos = xor(l.pos >> x.level, 1)
  UNION ALL
  SELECT l.row, b.levels + x.level, (b.pos >> x.level) % 2, s.h FROM leaves l JOIN sub b ON b.grp = l.grp
  JOIN over x ON x.pos = b.pos >> x.level AND x.n > 1 LEFT JOIN over s ON s.level = x.level AND s.pos = xor(b.pos >> x.level, 1)
), fold AS (
  SELECT row, 0 AS level, claim AS h FROM leaves
  UNION ALL
  SELECT f.row, f.level + 1, sha256(CASE WHEN w.h IS NULL THEN f.h WHEN w.odd = 1 THEN w.h || f.h ELSE f.h || w.h END)
  FROM fold f JOIN way w ON w.row = f.row AND w.level = f.level
), ends AS (SELECT row, arg_max(h, level) AS folded_root FROM fold GROUP BY row)
, proofs AS (SELECT row, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof FROM way GROUP BY row)
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM leaves l JOIN sub s USING (grp) JOIN ends e USING (row) LEFT JOIN proofs p USING (row), root r
"""
