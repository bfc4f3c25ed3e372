import pytest

from tablewright.operators import explore as e


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, None if i == 0 else f"n{i % 3}", i / 2) for i in range(10)], "id int, name string, v double")


@pytest.mark.parametrize("sql", ["INSERT INTO t VALUES (1)", "drop table t", "WITH x AS (SELECT 1) SELECT * FROM x", "-- only\n", ""])
def test_other_verbs_are_refused(spark, items, sql):
    with pytest.raises(ValueError, match="Only SELECT"):
        e.explore(spark, sql, {"t": items})


def test_limit(spark, items):
    assert e.explore(spark, "-- note\n  -- more\nselect * from t;", {"t": items}, limit=4).count() == 4
    for limit in (0, 10_001):
        with pytest.raises(ValueError, match="limit"):
            e.explore(spark, "SELECT 1", {}, limit)


def test_describe_show_and_alias(spark, items, rows):
    assert rows(e.explore(spark, "DESCRIBE t", {"t": items})) == [("id", "INTEGER"), ("name", "VARCHAR"), ("v", "DOUBLE")]
    assert rows(e.explore(spark, "SHOW TABLES", {"b": items, "a.x": items})) == [("a.x",), ("b",)]
    assert e.explorer_alias("My-Task/1") == "my_task_1"


def test_summarize(spark, items):
    got = {r["column_name"]: r for r in e.explore(spark, "SUMMARIZE SELECT * FROM t", {"t": items}).collect()}
    assert len(got["id"]) == 12
    assert (got["id"]["min"], got["id"]["max"], got["id"]["approx_unique"], got["id"]["avg"]) == ("0", "9", 10, "4.5")
    assert (got["v"]["q25"], got["v"]["q50"], got["v"]["q75"]) == ("1.0", "2.0", "3.5")
    assert (got["name"]["avg"], got["name"]["count"], float(got["name"]["null_percentage"])) == (None, 10, 10.0)


def test_small_questions(items, rows):
    assert e.preview(items, 3).count() == 3
    assert tuple(e.null_check(items, "name").first()) == (1, 10)
    assert [tuple(r) for r in e.distinct_values(items, "name", 2).collect()] == [("n0", 3), ("n1", 3)]


def test_summarize_dates(spark):
    """Against exact quantiles: quartiles within one percent of the rows, means to the microsecond."""
    import datetime

    import duckdb

    path = "/root/testdata/sf0.01/orders.parquet"
    orders = spark.read.parquet(path).selectExpr("o_orderdate", "CAST(o_orderdate AS DATE) AS day", "o_totalprice", "CAST(NULL AS DATE) AS none")
    got = {r["column_name"]: r for r in e.summarize(orders).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW o AS SELECT o_orderdate, o_orderdate::DATE AS day, o_totalprice, NULL::DATE AS none FROM '{path}'")
    want = {r[0]: r for r in con.execute("SELECT column_name, avg, q50 FROM (SUMMARIZE o)").fetchall()}
    for name in ("o_orderdate", "day", "o_totalprice"):
        for q in ("q25", "q50", "q75"):
            kind = {"day": "DATE", "o_orderdate": "TIMESTAMP"}.get(name, "DOUBLE")
            below = con.execute(f"SELECT avg(CASE WHEN {name} <= ?::{kind} THEN 1.0 ELSE 0 END) FROM o", [got[name][q]]).fetchone()[0]
            assert abs(below - int(q[1:]) / 100) < 0.01
    for name in ("o_orderdate", "day"):
        have, exact = (datetime.datetime.fromisoformat(x) for x in (got[name]["avg"], want[name][1]))
        assert abs(have - exact) < datetime.timedelta(milliseconds=1) and got[name]["std"] is None
    assert abs(float(got["o_totalprice"]["avg"]) - float(want["o_totalprice"][1])) < 1e-6
    assert (got["none"]["avg"], got["none"]["q50"]) == (None, None)
