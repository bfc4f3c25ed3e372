"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import common, components, langid, linededup, mixing, neardup, packing, quality, sharding, simhash, suffix, topk
from tests.llm import brute
from tests.llm.test_queries import check_packing

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog.\nshared line of text here\nshort", "en", "a"),
    (2, "Le renard brun saute par dessus le chien.\n  SHARED line of text here \nshort", "fr", "b"),
    (3, "", "en", "a"),
    (4, None, None, None),
    (5, " \t\n ", "fr", "b"),
    (6, LONG, "en", "a"),
    (7, LONG, None, "a"),
    (8, "été ½ 中文 слово\x0b\x0cword \U0001f600", "fr", None),
    (None, "The quick brown fox jumps over the lazy dog.\nshared line of text here\nshort", "en", None),
    (None, None, "en", "b"),
    (9, "123 456 !!! ___", "en", "b"),
    (2, "Le renard brun saute par dessus le chien.\n  SHARED line of text here \nshort", "fr", "b"),
    (10, "a\n\n\n" + "same line again and again\n" * 3, "en", "a"),
    (11, "same line again and again", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
LABELS = "doc_id bigint, quality int, toxic int"
CLASH = ["part", "doc", "row", "keep", "fp", "size", "n", "h1", "pos", "piece", "bin", "score", "root", "role", "label2", "times", "draw"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH}).withColumn("tags", F.create_map(F.lit("k"), F.array(F.lit(1.5))))


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 0), (None, 1, 0), (6, 1, 1), (8, 0, 0), (8, 1, 0)], LABELS)


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def test_language(docs, none):
    model = langid.fit(docs)
    assert langid.fit(none) is None
    found = by_id(langid.with_language(docs, model).collect())
    assert sum(map(len, found.values())) == len(DOCS)
    for d in (3, 4, 5, 9):
        assert [(r["lang_pred"], r["score"], r["spans"]) for r in found[d]] == [("und", 0.0, [])]
    assert all(r["lang_pred"] in ("en", "fr") and 0 < r["score"] <= 1 for d in (1, 2, 6, 8) for r in found[d])
    assert [r["lang_pred"] for r in langid.with_language(docs, None).collect()] == ["und"] * len(DOCS)
    assert langid.with_language(none, model).count() == 0


def test_language_spans(spark):
    """A text in two scripts and a text in two languages come apart at the border."""
    rows = [(i, t, g) for i, (t, g) in enumerate([
        ("the house and the garden with the flowers", "en"), ("this is the thing that they want", "en"),
        ("la maison et le jardin avec les fleurs", "fr"), ("ce sont les choses que nous voulons", "fr"),
        ("дом и сад и цветы", "ru"), ("это то что мы хотим", "ru"),
    ] * 6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    text = "the house and the garden le jardin et la maison avec дом и сад"
    lang, score, spans = langid.label([text, text, ""], model, switch=2.0)[1]
    assert [s[0] for s in spans] == ["en", "fr", "ru"] and [s[2] for s in spans] == [5, 6, 3]
    assert lang in ("en", "fr") and 0.3 < score < 0.6


def test_language_of_texts_that_open_in_another_script(spark):
    """The fit learns from whole texts: what stands behind a long opening counts as well."""
    opening = "this page is shown with all rights reserved by the owner of the house " * 80
    rows = [(i, opening + "это то что мы хотим дом и сад и цветы в городе " * 60, "ru") for i in range(30)]
    rows += [(100 + i, "the house and the garden with the flowers are what they want " * 20, "en") for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.scripts["cyrillic"].tolist() == [False, True]
    assert [r[0] for r in langid.label(["мы хотим сад и дом", "the garden and the house"], model)] == ["ru", "en"]


def test_words_are_cut_where_the_script_changes(spark):
    assert langid.words("Nike公司 été WiFi网络 слово中x") == ["nike", "公", "司", "été", "wifi", "网", "络", "слово", "中", "x"]
    assert langid.words("日本語のテスト ½中 Ünïcode") == [*"日本語のテスト", "中", "ünïcode"]
    rows = [(i, t, g) for i, (t, g) in enumerate([
        ("the house and the garden with the flowers", "en"), ("我们想要的房子和花园里的花", "zh"), ("这是我们公司的产品", "zh"),
    ] * 8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    lang, _, spans = langid.label(["Nike我们公司的产品和花园里的花"], model)[0]
    assert lang == "zh" and spans[-1][0] == "zh"


def test_slices_end_between_words():
    text = "the house and the garden 中文中文 " * 50 + "w" * 300 + " end"
    parts = list(langid.slices(text, 64))
    assert "".join(parts) == text and len(parts) > 10
    assert [w for p in parts for w in langid.words(p)] == langid.words(text)


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1, 5])
    scores = draw.normal(0, 2, (lengths.sum(), 3)).astype(np.float32)
    path = langid.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        own, best = scores[at : at + n], -np.inf
        for p in np.ndindex(*[3] * n):
            best = max(best, sum(own[i, s] for i, s in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        p = path[at : at + n]
        mine = sum(own[i, s] for i, s in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert n == 0 or mine == pytest.approx(best, abs=1e-4)
        at += n


def test_words_keep_their_marks():
    assert langid.words("हिन्दी में, e\u0301te\u0301 Ça") == ["हिन्दी", "में", "e\u0301te\u0301", "ça"]
    assert langid.words("abc1def_gh") == ["abc", "def", "gh"]


def test_language_sample_is_bounded(spark):
    """One language with a repeated id: the fit reads a text for an id, and no more ids than the sample has."""
    rows = [(7, f"words of number {i}", "en") for i in range(300)] + [(100 + i, f"other words {i} here", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    written = langid.written
    langid.written = lambda df, label: (seen.append(df.count()), written(df, label))[1]
    try:
        model = langid.fit(docs, sample=20)
    finally:
        langid.written = written
    assert seen == [20] or seen[0] <= 20
    assert model.languages == ["en"]


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    found = by_id(rows)
    assert len(rows) == len(DOCS)
    assert {r["component_id"] for d in (3, 4, 5) for r in found[d]} == {3} and found[3][0]["fp"] == 0
    assert found[None][0]["component_id"] in (1, 3) and found[7][0]["component_id"] == 6
    assert [r["component_id"] for r in found[2]] == [2, 2]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert not ids[None] and ids[2] == 1 and ids[1] == 1 and not ids[7] and not ids[4]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one_of_every_component(spark):
    """An id on texts of two components, and copies without ids: they stay only where no row has one."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "green", "blue"))
    rows = [(5, a), (1, a), (5, b), (5, b), (7, b), (8, c), (8, a)] + [(None, c)] * 4 + [(None, "black " + a)] * 3
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(1, a), (5, b), (8, c), (None, "black " + a)])


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_simhash_links_in_parted_buckets(spark, radius):
    """Few free bits in a bucket force finer masks; components stay those of all pairs."""
    draw = np.random.default_rng(radius)
    base = draw.integers(0, 2**63, 6)
    values = {int(b) ^ sum(1 << int(i) for i in draw.choice(64, draw.integers(0, 4), replace=False)) for b in np.repeat(base, 60)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & 2**64 - 1).bit_count() <= radius]
    want = brute.groups_of(pairs, signed)
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(fps, radius, limit=8)).collect()}
    assert {v: roots.get(v, v) for v in signed} == want


def test_line_dedup(docs, none):
    rows = linededup.kept_lines(docs, linededup.keep_bitmaps(docs))
    found = by_id(rows.collect())
    assert [r["__dropped"] for r in found[1]] == [0] and [r["__dropped"] for r in found[2]] == [1, 1]
    assert found[None][0]["__dropped"] + found[None][1]["__dropped"] == 2  # the null id comes last
    assert found[4][0]["__lines"] == 1 and found[4][0]["__kept"] == ""
    assert found[10][0]["__dropped"] == 0 and found[11][0]["__kept"] == "" and found[7][0]["__dropped"] == 1
    out = linededup.drop_shared_lines(docs)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    assert Counter(r["text"] for r in out.collect())[None] == 2
    assert linededup.drop_shared_lines(none).count() == 0


def test_line_dedup_past_a_word_of_the_bitmap(spark):
    text = "\n".join(f"line number {i:06d}" for i in range(300))
    some = "\n".join(f"line number {i:06d}" if i % 3 else f"other line {i:06d}" for i in range(300))
    rows = [(1, text), (2, some), (3, some)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["__lines"], r["__dropped"]) for r in linededup.kept_lines(df, linededup.keep_bitmaps(df)).collect()}
    assert found == {d: v[:2] for d, v in brute.line_dedup(rows).items()}


def test_common_line_takes_the_other_way(spark):
    rows = [(i, f"a line in every document\nown line {i:05d}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["__lines"], r["__dropped"]) for r in linededup.kept_lines(df, linededup.keep_bitmaps(df)).collect()}
    assert found == {i: (2, int(i > 0)) for i in range(500)}


def test_quality(spark, docs, none, labels):
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 for r in rows)
    found = by_id(rows)
    assert len({r["score"] for d in (3, 4, 5) for r in found[d]}) == 1
    assert not any(r["held_out"] for r in found[None])
    assert quality.score_documents(none, labels).count() == 0
    assert {r["score"] for r in quality.score_documents(docs, labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in quality.score_documents(docs, labels.where("quality = 1 AND doc_id IN (1, 6, 2, 8)")).collect()} <= {0.5, 1.0}
    out = quality.reject_poor(docs, labels, least=0.0)
    assert out.columns == docs.columns and out.count() == len(DOCS)


def test_network_learns_and_calibrates():
    draw = np.random.default_rng(1)
    x = draw.normal(0, 1, (1500, 5))
    y = (draw.random(1500) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    net = quality.train(x[:1000], y[:1000])
    before = net.logits(x[1000:])
    quality.calibrate(net, x[1000:], y[1000:])
    p = net.scores(x[1000:])

    def loss(q):
        return -(y[1000:] * np.log(q) + (1 - y[1000:]) * np.log(1 - q)).mean()

    assert loss(np.clip(p, 1e-9, 1 - 1e-9)) <= loss(np.clip(1 / (1 + np.exp(-before)), 1e-9, 1 - 1e-9)) + 1e-9
    assert ((p > 0.5) == (y[1000:] > 0.5)).mean() > 0.75


VECTORS = [
    (1, [1.0, 0.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0, 0.0], 1), (3, [1.0, 0.1, 0.0, 0.0], 1), (3, [1.0, 0.1, 0.0, 0.0], 1),
    (4, [1.0, 0.0, 0.0, 0.0], 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0, 0.0], 1), (8, [float("nan"), 1.0, 0.0, 0.0], 1),
    (9, [None, 1.0, 0.0, 0.0], 1), (10, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1), (11, [float("inf"), 0.0, 0.0, 0.0], 1),
    (12, [1.0], 1), (20, [0.0, 0.0, 0.0, 1.0], 1), (40, [0.0, 0.0, 0.5, 1.0], 1), (40, [0.0, 0.0, 0.5, 1.0], 1),
]


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<double>, label int").repartition(3)
    return df.withColumns({c: F.lit(0) for c in ("id", "vec", "cell", "row", "role", "shard", "score", "block", "kind")})


def test_embeddings(vectors):
    rows = neardup.near_duplicates(vectors).collect()
    assert len(rows) == len(VECTORS)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert found[1] == (4, 1, True) and found[2] == (4, 1, False) and found[3] == (4, 1, False) and found[12] == (4, 1, False)
    assert found[40] == (1, 40, True) and found[20] == (0, 20, True)
    assert all(found[v] == (0, v, True) for v in (4, 5, 6, 7, 8, 9, 10, 11)) and found[None] == (0, None, True)
    assert neardup.near_duplicates(vectors.where("false")).count() == 0
    assert neardup.near_duplicates(vectors.where("vec_id = 5")).count() == 1


def test_embeddings_in_blocks(spark):
    """A cell of many near copies is parted; counts and components stay whole."""
    draw = np.random.default_rng(3)
    center = draw.normal(0, 1, (4, 16))
    x = np.concatenate([center[i] + draw.normal(0, 0.1, (150, 16)) for i in range(4)])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    links = brute.cosine_links(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = neardup.near_duplicates(df, recall=1.0, block=32).collect()
    degree = Counter(v for p in links for v in p)
    assert sum(r["n_links"] for r in found) >= 0.97 * 2 * len(links) and all(r["n_links"] <= degree[r["vec_id"]] for r in found)
    want = brute.groups_of(links, range(len(rows)))
    assert sum(r["component_id"] == want[r["vec_id"]] for r in found) >= 0.97 * len(rows)


def test_embeddings_with_sparse_links(spark):
    """Few pairs close to the least cosine among many vectors; the parameters are those of the query."""
    draw = np.random.default_rng(11)
    x = draw.normal(0, 1, (6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = draw.normal(0, 1, (12, 64))
    off -= (off * x[:12]).sum(1, keepdims=True) * x[:12]
    x[6000 - 12 :] = 0.935 * x[:12] + (1 - 0.935**2) ** 0.5 * off / np.linalg.norm(off, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    links = brute.cosine_links(rows)
    assert len(links) == 12
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert sum(r["n_links"] for r in found.values()) == 2 * len(links)
    assert all(found[b]["component_id"] == a and not found[b]["kept"] for a, b in links)


def test_cells_within_the_bound_hold_all_links():
    draw = np.random.default_rng(12)
    x = draw.normal(0, 1, (400, 16)) * np.linspace(2, 0.2, 16)
    x = np.concatenate([x, x + draw.normal(0, 0.07, x.shape) * np.linalg.norm(x, axis=1, keepdims=True)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = neardup.MultiIndex(unit, 7)
    cells, allowed = index.cells(x), index.allowed(*index.split(x), 0.93)
    a, b = np.nonzero(unit @ unit.T >= 0.93)
    assert len(a) > 800 and all(cells[j] in allowed[i] for i, j in zip(a, b, strict=True))
    assert np.mean([len(c) for c in allowed]) < 49


def test_multi_sequence_order():
    draw = np.random.default_rng(4)
    index = neardup.MultiIndex(draw.normal(0, 1, (200, 10)), 6)
    first, second = index.split(draw.normal(0, 1, (3, 10)))
    for f, s in zip(first, second, strict=True):
        seen = index.visits(f, s, 36)
        sums = [f[c // 6] + s[c % 6] for c in seen]
        assert sorted(seen) == list(range(36)) and sums == sorted(sums)
        assert (index.rank(f, s, np.array(seen)) >= np.arange(1, 37)).all()


def test_top_k(spark, vectors):
    found = {tuple(r) for r in topk.top_inner_products(vectors).collect()}
    clean = {(v, tuple(x + [0.0] * (4 - len(x)))) for v, x, _ in VECTORS if v is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    scores = {(q, v, s) for q, _, v, s in found}
    want = {(q, v, int(np.floor(64 * np.array(x)) @ np.floor(64 * np.array(y)))) for q, x in clean for v, y in clean if q % 20 == 0 and v != q}
    assert scores == want
    assert topk.top_inner_products(vectors.where("false")).count() == 0
    with pytest.raises(ValueError):
        topk.top_inner_products(spark.createDataFrame([(20, [1e300]), (1, [1e300])], "vec_id bigint, embedding array<double>"))


def test_top_k_of_large_weights(spark):
    """Scores past 2**52 are exact; a score that no long holds counts only among the best."""
    rows = [(20, [3.0, 1e6]), (1, [0.5, 1e6]), (2, [0.515625, 1e6]), (3, [1.0, -2e6]), (40, [1.0, 0.0]), (4, [2.0**60, 2.0])]
    schema = "vec_id bigint, embedding array<double>"
    whole = {v: [int(np.floor(64 * c)) for c in x] for v, x in rows}
    scores = {q: sorted((-sum(a * b for a, b in zip(whole[q], x, strict=True)), v) for v, x in whole.items() if v != q) for q in (20, 40)}
    assert max(-s for some in scores.values() for s, _ in some) >= 2**63
    with pytest.raises(ValueError):
        topk.top_inner_products(spark.createDataFrame(rows, schema), k=3)
    rows, whole = rows[:-1], {v: x for v, x in whole.items() if v != 4}
    scores = {(q, v): sum(a * b for a, b in zip(whole[q], x, strict=True)) for q in (20, 40) for v, x in whole.items() if v != q}
    found = topk.top_inner_products(spark.createDataFrame(rows, schema), k=3).collect()
    assert len(found) == 6 and all(r["score"] == scores[r["query_id"], r["vec_id"]] for r in found)
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 20] == [2, 1, 40]
    low = spark.createDataFrame([*rows, (5, [-(2.0**60), 0.0])], schema)
    assert topk.top_inner_products(low, k=3).count() == 6


def test_top_k_many_shards(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(0, 0.2, 12).round(1).tolist()) for i in range(700)]  # coarse, so that scores tie
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in topk.top_inner_products(df, shard=64).collect()} == brute.top_products(rows)


def test_top_k_live_and_dead_shards(spark):
    """Groups far apart: most queries reach few shards, and the result is that of all pairs."""
    draw = np.random.default_rng(6)
    centres = draw.normal(0, 2, (12, 10))
    rows = [(i, (centres[i % 12] * (1 if i % 5 else 0.2) + draw.normal(0, 0.1, 10)).round(2).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = topk.top_inner_products(df, shard=40, cell=40)
    assert {tuple(r) for r in found.collect()} == brute.top_products(rows)


def shares(shard, queries, floors, k=20):
    shard.search(np.full(len(queries), -1), queries, floors, k)
    s = shard.seen
    print(f"live blocks {s['live'] / s['blocks']:.3f}, probed candidates {s['probed'] / max(s['pairs'], 1):.3f}")
    return s["live"] / s["blocks"], s["probed"] / max(s["pairs"], 1)


def test_top_k_prunes():
    """Vectors whose weight lies in few components: blocks die and few candidates are probed."""
    draw = np.random.default_rng(7)
    scale = np.concatenate([np.full(16, 60.0), np.full(48, 2.0)])
    weights = np.floor(draw.normal(0, 1, (8000, 64)) * scale * draw.lognormal(0, 1, 8000)[:, None])
    queries = weights[::100]
    exact = np.sort(queries @ weights.T, axis=1)[:, -20:]
    shard = topk.Shard(np.arange(8000), weights)
    live, probed = shares(shard, queries, np.full(len(queries), -np.inf))
    assert probed < 0.2
    again = topk.Shard(np.arange(8000), weights)
    live, probed = shares(again, queries, exact[:, 0])
    assert live < 0.5 and probed < 0.05
    score, _ = again.search(np.full(len(queries), -1), queries, exact[:, 0], 20)
    assert (np.sort(score, axis=1) == exact).all()


def test_top_k_routes_by_bound():
    """Boxes of three shards: a query goes to those whose bound reaches its floor, not to its own."""
    import pyarrow as pa

    shards = [topk.Shard(np.arange(5), np.full((5, 2), v)) for v in (1.0, 10.0, 100.0)]
    def batch(role, shard, vec, row, floor):
        return {"chunk": 0, "part": 0, "role": role, "shard": shard, "vec_id": row, "vec": np.array(vec, float).tobytes(), "row": row, "floor": floor}
    rows = [batch(0, i, s.box(), 0, 0.0) for i, s in enumerate(shards)] + [
        batch(1, 2, [1, 1], 1, 20.0), batch(1, 0, [1, 1], 2, 21.0), batch(1, 0, [1, 1], 3, float("-inf")), batch(1, 0, [-1, -1], 4, 0.0)]
    out = list(topk._route(2)(iter([pa.RecordBatch.from_pylist(rows)])))
    assert sorted((r["row"], r["shard"]) for b in out for r in b.to_pylist()) == [(1, 1), (2, 2), (3, 1), (3, 2)]


def test_texts_without_an_id_and_of_one_crc32(spark):
    """Two of them are two documents: neither loses what it alone holds, and both are searched."""
    draw, seen = np.random.default_rng(3), {}
    while True:
        text = "".join(map(chr, draw.integers(97, 123, 160)))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    shared = "".join(map(chr, draw.integers(97, 123, 120)))
    rows = [(None, text, "x"), (None, other, "y"), (1, shared + "1", "z"), (None, shared + "2", "z"), (None, shared + "2", "z")]
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, tag string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in found) == [(121, 0), (121, 120), (121, 120), (160, 0), (160, 0)]


def test_equal_rows_but_for_other_columns_are_taken_alike(spark):
    """Of rows equal in id, text and source the same ones are taken in every run, however they lie."""
    rows = [(i % 2, "one two three", "a", f"note {i}") for i in range(9)] + [(5, "four " * 40, "b", "n")]
    taken = []
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, note string").repartition(parts, "note")
        taken.append(Counter(tuple(r) for r in mixing.repeat_rows(df, share=0.6).collect()))
    assert taken[0] == taken[1] and sum(taken[0].values())


def test_sharding(docs, none):
    rows = sharding.shard(docs, shards=3, piece=2).collect()
    assert len(rows) == len(DOCS)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    found = by_id(rows)
    assert found[4][0]["size"] == 16 and found[4][0]["text_crc32"] == 0 and found[3][0]["size"] == 16
    assert found[6][0]["shard"] == found[7][0]["shard"]  # equal texts
    assert len({r["shard"] for d in (1, None) for r in found[d] if r["size"] > 16}) == 1
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("k", [2, 5, 8])
def test_differencing_is_tight(k):
    draw = np.random.default_rng(k)
    sizes = np.sort(draw.integers(1, 10_000, 400))[::-1]
    part = sharding.differenced(sizes, k)
    sums = np.bincount(part, sizes, k)
    greedy = np.zeros(k)
    for s in sizes:
        greedy[greedy.argmin()] += s
    assert np.ptp(sums) <= max(20, np.ptp(greedy))


def test_differencing_by_hand():
    # 8 7 6 5 4: 8-7=1, 6-5=1, 4-1=3, 3-1=2, so the sums are 14 and 16
    part = sharding.differenced(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(part, [8, 7, 6, 5, 4])) == [14, 16]
    giant = sharding.differenced(np.array([100, 10, 10, 10, 10]), 3)
    assert sorted(np.bincount(giant, [100, 10, 10, 10, 10], 3)) == [20, 20, 100]


def test_mixing(docs, none):
    rows = mixing.mix(docs, piece=2).collect()
    assert len(rows) == len(DOCS)
    found = by_id(rows)
    assert found[4][0]["size"] == 0 and found[4][0]["taken"] == 0 and found[3][0]["taken"] == 0
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    again = mixing.mix(docs.repartition(5), piece=2).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r: n for r, n in _times(rows).items() if n})
    assert mixing.mix(none).count() == 0 and mixing.repeat_rows(none).count() == 0


def _times(rows):
    out = Counter()
    for r in rows:
        out[r["doc_id"]] += r["times"]
    return out


def test_shares_by_hand():
    sizes = {"a": 10, "b": 100, None: 100}
    weights = mixing.rotating(list(sizes))
    assert weights == {"a": 5.0, "b": 2.0, None: 1.0}
    assert mixing.shares(sizes, weights, 315) == {"a": 20.0, "b": pytest.approx(295 * 2 / 3), None: pytest.approx(295 / 3)}


@pytest.mark.parametrize("budget", [0, 1, 37, 500, 1234, 99999])
def test_budget_fit(budget):
    draw = np.random.default_rng(budget)
    lengths = np.unique(draw.integers(0, 60, 20))
    counts = draw.integers(1, 9, len(lengths))
    take = mixing.fit_counts(lengths, counts, budget, rest=64)
    assert (take >= 0).all() and (take <= counts).all()
    reach = {0}
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        reach = {r + n * i for r in reach for i in range(c + 1)}
    got = int((lengths * take).sum())
    assert got <= max(budget, 0) or budget >= (lengths * counts).sum()
    assert max(r for r in reach if r <= budget) - got <= (0 if budget <= 64 else int(lengths.max()))


def test_knapsack_is_exact():
    for budget in range(40):
        take = mixing._knapsack(np.array([3, 7, 11]), np.array([2, 1, 3]), budget)
        best = max(s for s in (3 * a + 7 * b + 11 * c for a in range(3) for b in range(2) for c in range(4)) if s <= budget)
        assert (take @ [3, 7, 11]) == best and (take <= [2, 1, 3]).all()


def test_packing(docs, none):
    rows = packing.pack(docs, capacity=500, group=40).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for d, t, _, _ in DOCS:
        want[d] += len(brute.WORDS.findall(t or ""))
    assert total == want
    assert all(r["bin"] is None and r["n_tokens"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    source = {d: s for d, _, _, s in DOCS if d is not None} | {None: None}
    check_packing(rows, 500, source, {d: t for d, t, _, _ in DOCS if d is not None} | {None: None})
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_bin_without_conflict():
    bins, offsets = packing.best_fit([6, 5, 4, 4, 2], [0, 1, 0, 2, 1], [-1, -1, -1, -1, -1], 10)
    # 4 of source 0 may not join the 6 of source 0; the next 4 fills it; 2 of source 1 may not join the 5 + 4 bin
    assert bins == [0, 1, 1, 0, 2] and offsets == [0, 0, 5, 6, 0]


def test_suffix(docs, none):
    rows = suffix.remove_repeats(docs, part_bytes=100_000).collect()
    assert len(rows) == len(DOCS)
    found = by_id(rows)
    assert found[4][0]["n_bytes"] == 0 and found[4][0]["kept"] == b"" and found[9][0]["n_removed"] == 0
    assert found[7][0]["n_removed"] == found[7][0]["n_bytes"] and found[7][0]["n_spans"] == 1 and found[7][0]["kept"] == b""
    assert [r["n_removed"] for r in found[2]] == [0, 0]  # rows that repeat id and text are one document
    plain = brute.byte_dedup([(d, t) for d, t, _, _ in DOCS if d in (6, 10, 11)])
    assert (found[6][0]["n_bytes"], found[6][0]["n_removed"], found[6][0]["n_spans"]) == plain[6][:3]
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_on_repetitive_texts(spark, monkeypatch):
    """Runs of one byte, periods, passages at document ends, pieces of a long text: all against the plain version."""
    draw = np.random.default_rng(6)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 3, n)) for n in draw.integers(1, 9, 30)]
    prose = [" ".join(draw.choice(words, n)) for n in (40, 90, 200, 700)]
    texts = ["a" * 350, "a" * 99, "a" * 100, "ab" * 130, prose[3], prose[0] + prose[2][:150], prose[3][300:900] + "x" + prose[3][200:420],
             prose[2][50:300] + prose[2][50:300], "é" * 120, prose[1], prose[1][:100], prose[1][:99], prose[3][:333]]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:4] for r in suffix.remove_repeats(df, part_bytes=1500).collect()}
    assert found == {d: v[:3] for d, v in brute.byte_dedup(rows).items()}


def test_suffix_levels_and_slices(monkeypatch):
    """Small slices and batches give the same strings as one large one."""
    draw = np.random.default_rng(7)
    text = bytes(draw.integers(97, 100, 3000).tolist())
    text = text[:900] + text[400:800] + text[900:] + text[100:1500]
    whole = suffix.records([text], 100, 36)
    monkeypatch.setattr(suffix, "SLICE", 500)
    monkeypatch.setattr(suffix, "BATCH", 7)
    cut = suffix.records([text], 100, 36)
    assert whole["n"].sum() == cut["n"].sum() == len(text) - 99
    found = suffix._as(cut, suffix.NAMED)
    pieces = [text[r["start"] : r["start"] + r["n"] + 99] for r in found]
    hits = suffix.repeats(found, pieces, 100)
    gone = {int(found["start"][r]) + i for r, a, b in hits for i in range(a, b)}
    first, want = {}, set()
    for i in range(len(text) - 99):
        if first.setdefault(text[i : i + 100], i) != i:
            want.add(i)
    assert gone == want


def test_equal_keys_of_different_strings(monkeypatch):
    """Keys of two bits: only equal bytes make a repeat, in a batch and across levels."""
    plain = suffix.window_hashes
    monkeypatch.setattr(suffix, "BATCH", 2)
    monkeypatch.setattr(suffix, "COMPARED", 5)
    monkeypatch.setattr(suffix, "window_hashes", lambda data, width: plain(data, width) & np.uint64(3))
    draw = np.random.default_rng(1)
    texts = [bytes(draw.integers(97, 99, 14).tolist()) for _ in range(9)]
    found = np.zeros(len(texts), suffix.NAMED)
    found["n"], found["doc"] = 9, np.arange(len(texts))
    got = {(r, i) for r, a, b in suffix.repeats(found, texts, 6) for i in range(a, b)}
    seen, want = set(), set()
    for r, text in enumerate(texts):
        for i in range(9):
            if text[i : i + 6] in seen:
                want.add((r, i))
            seen.add(text[i : i + 6])
    assert got == want and want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (249, 99)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[200 + i] == 99 for i in range(50)) and found[100] == 99
    assert components.components(df.where("false")).count() == 0


def test_whole_runs(spark):
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4]
    batches = [pa.record_batch({"k": pa.array(keys[a:b], pa.int64())}) for a, b in ((0, 1), (1, 3), (3, 4), (4, 7), (7, 8))]
    pieces = [p["k"].tolist() for p in common.whole_runs(iter(batches), ["k"])]
    assert [k for p in pieces for k in p] == keys
    assert all(not set(a) & set(b) for i, a in enumerate(pieces) for b in pieces[i + 1 :])
