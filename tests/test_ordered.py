"""The sliced paths must equal a plain window, also when one group is most of the data."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    keys = ["hot"] * 600 + [None] * 100 + [f"k{rng.randrange(60)}" for _ in range(300)]
    data = [(k, "t", rng.randrange(50), i, rng.choice([None, rng.random()])) for i, k in enumerate(keys)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, u string, at int, id int, v double").repartition(5)


def test_previous(skewed, rows):
    got = ordered.with_previous(skewed, ["k", "u"], ["at", "id"], ["v", "id"])
    window = Window.partitionBy("k", "u").orderBy("at", "id")
    expected = skewed.withColumn("prev_v", F.lag("v").over(window)).withColumn("prev_id", F.lag("id").over(window))
    assert rows(got) == rows(expected)


def test_rank_and_size(skewed, rows):
    got = ordered.with_rank_and_size(skewed, ["k"], ["at", "id"])
    expected = skewed.withColumn("_rank", F.row_number().over(Window.partitionBy("k").orderBy("at", "id"))).withColumn(
        "_size", F.count(F.lit(1)).over(Window.partitionBy("k")))
    assert rows(got.select("id", "_rank", "_size")) == rows(expected.select("id", "_rank", "_size"))


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentile(skewed, rows, q):
    small = skewed.where("v is not null").groupBy("k").agg(F.percentile("v", q).alias("p"))
    sliced = ordered.group_percentile(skewed, ["k"], "v", q, "p")
    rounded = F.round("p", 9)
    assert rows(sliced.select("k", rounded)) == rows(small.select("k", rounded))


def test_percentile_of_a_large_group(spark):
    """Far more rows than the sketch is exact for, half of them of one value."""
    df = spark.range(60_000, numPartitions=6).selectExpr("CAST(id % 2 AS INT) AS k", "CASE WHEN id % 4 = 0 THEN 5.0D ELSE CAST(hash(id) AS DOUBLE) / 7 END AS v")
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        exact = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", q).alias("p")).collect()}
        assert {r["k"]: r["p"] for r in ordered.group_percentile(df, ["k"], "v", q, "p").collect()} == pytest.approx(exact)


def test_newest_per_key_limits_rows_before_the_shuffle(skewed, rows, capsys):
    newest = ordered.newest_per_key(skewed, ["k"], [F.desc("at"), F.desc("id")])
    assert newest.count() == skewed.select("k").distinct().count()
    newest.explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2


@pytest.mark.parametrize(("column", "tiles"), [("id", 7), ("at", 4), ("v", 5), ("k", 6), ("u", 3), ("id", 5000)])
def test_tile_borders_equal_ntile(skewed, column, tiles):
    known = skewed.where(F.col(column).isNotNull()).withColumn("tile", F.ntile(tiles).over(Window.orderBy(column)))
    expected = [r[1] for r in known.groupBy("tile").agg(F.min(column)).orderBy("tile").collect()]
    assert ordered.tile_borders(skewed, column, tiles) == expected
    assert ordered.tile_borders(skewed.where("id < 0"), column, tiles) == []
