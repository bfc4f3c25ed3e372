"""The registered queries on a small folder, against SQL or a plain version."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import common, mixing, queries
from tests.llm import brute

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER)


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_sql(spark, con, name):
    found = run(spark, name)
    cursor = con.execute(queries.CHECKS[name])
    names = [c[0] for c in cursor.description]
    assert names == found.columns
    assert Counter(tuple(r) for r in found.collect()) == Counter(cursor.fetchall())


def test_language(spark, con):
    found = run(spark, "op1_language_id").where("held_out").join(
        common.table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id"
    )
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.97


def test_simhash(spark, docs):
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op2_simhash_near_dedup").collect()}
    assert found == brute.simhash_components(docs)


def test_line_dedup(spark, docs):
    found = {r["doc_id"]: tuple(r)[1:] for r in run(spark, "op3_line_dedup").collect()}
    assert found == brute.line_dedup(docs)


def test_quality(spark, con):
    quality = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = [r for r in run(spark, "op4_quality_classifier").collect() if r["held_out"] and r["doc_id"] in quality]
    assert len(rows) > 20
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_embeddings(spark, con):
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    links = brute.cosine_links(rows)
    found = run(spark, "op5_embedding_near_dedup").collect()
    assert sum(r["n_links"] for r in found) / 2 >= 0.98 * len(links)
    degree = Counter(v for pair in links for v in pair)
    assert all(r["n_links"] <= degree[r["vec_id"]] for r in found)
    whole = brute.groups_of(links, [v for v, _, _ in rows])
    assert sum(r["component_id"] == whole[r["vec_id"]] for r in found) >= 0.95 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_sharding(spark, docs):
    found = run(spark, "op6_sharding").collect()
    assert sorted(r["doc_id"] for r in found) == sorted(d for d, _ in docs)
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    text = dict(docs)
    for r in found:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[text[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values())
    group = Counter()
    for t in text.values():
        group[t] += len(t.encode()) + 16
    assert max(sizes.values()) <= max(1.02 * sum(sizes.values()) / 40, max(group.values()))


def test_mixing(spark, con):
    found = run(spark, "op7_source_mixing").collect()
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    size = Counter()
    for r in found:
        size[source[r["doc_id"]]] += r["size"]
    target = mixing.shares(size, mixing.rotating(list(size)), 1.5 * sum(size.values()))
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in size)


def test_top_k(spark, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert {tuple(r) for r in run(spark, "op8_exact_top_k").collect()} == brute.top_products(rows)


def check_packing(rows, capacity, source, cluster):
    """Bins within capacity, gapless, without two pieces of a source or cluster."""
    bins = defaultdict(list)
    for r in rows:
        if r["bin"] is not None:
            bins[r["pack"], r["bin"]].append(r)
    for some in bins.values():
        some.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in some:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert at <= capacity
        for key in (source, cluster):
            known = [key[r["doc_id"]] for r in some if key[r["doc_id"]] is not None]
            assert len(known) == len(set(known))


def test_packing(spark, con, docs):
    found = run(spark, "op9_best_fit_packing").collect()
    words = {d: len(brute.WORDS.findall(t or "")) for d, t in docs}
    total = Counter()
    for r in found:
        total[r["doc_id"]] += r["n_tokens"]
    assert total == Counter(words)
    check_packing(found, 2048, dict(con.execute("SELECT doc_id, source FROM documents").fetchall()), dict(docs))


def test_suffix(spark, docs):
    found = {r["doc_id"]: tuple(r)[1:] for r in run(spark, "op10_suffix_dedup").collect()}
    assert found == brute.byte_dedup(docs)


def test_pipeline(spark, con):
    """Each stage against the plain version of its rule, on what the one before left."""
    columns = common.table(spark, FOLDER, "documents").columns
    docs = common.table(spark, FOLDER, "documents")
    left = [docs]
    for name, stage in corpus_pipeline.STAGES:
        left.append(common.written(stage(spark, left[-1], FOLDER), name))
    assert all(df.columns == columns for df in left[:-1])
    raw, good, lines, single, mixed, packed = [df.collect() for df in left]
    quality = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    kept = {r["doc_id"] for r in good}
    judged = [quality[r["doc_id"]] == (r["doc_id"] in kept) for r in raw if r["doc_id"] in quality]
    assert sum(judged) > 0.95 * len(judged)
    plain = brute.line_dedup([(r["doc_id"], r["text"]) for r in good])
    assert {r["doc_id"]: plain[r["doc_id"]][0] - plain[r["doc_id"]][1] for r in good if plain[r["doc_id"]][1] < plain[r["doc_id"]][0]} == {
        r["doc_id"]: len(r["text"].split("\n")) for r in lines if plain[r["doc_id"]][1] < plain[r["doc_id"]][0]
    }
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    of = brute.simhash_components([(r["doc_id"], r["text"]) for r in lines])
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c in of.values()})
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in single} and max(times.values()) <= 2
    size = {r["doc_id"]: len(brute.WORDS.findall(r["text"])) for r in single}
    by_source = Counter()
    for r in single:
        by_source[r["source"]] += size[r["doc_id"]]
    target = mixing.shares(by_source, mixing.rotating(list(by_source)), 1.5 * sum(by_source.values()))
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += size[r["doc_id"]]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 1 for s in by_source)
    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["n_tokens"]
    assert total == Counter({d: n * size[d] for d, n in times.items()})
    check_packing(packed, 2048, {r["doc_id"]: r["source"] for r in mixed}, {r["doc_id"]: r["text"] for r in mixed})
