import datetime
import decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablewright.functions.sqltext import render, run_sql, to_spark_sql
from tablewright.functions.types import sql_type_name
from tablewright.operators.transform import routine, transform
from tablewright.sources import files, jdbc, messages, windows


@pytest.mark.parametrize(("kind", "url", "driver"), [
    ("mssql", "jdbc:sqlserver://h:1433;databaseName=master", "SQLServerDriver"),
    ("sqlserver", "jdbc:sqlserver://h:1433;databaseName=master", "SQLServerDriver"),
    ("oracle", "jdbc:oracle:thin:@//h:1521/", "OracleDriver"),
    ("postgres", "jdbc:postgresql://h:5432/postgres", "postgresql"),
    ("PostgreSQL", "jdbc:postgresql://h:5432/postgres", "postgresql"),
    ("mysql", "jdbc:mysql://h:3306/", "mysql"),
])
def test_dialects(kind, url, driver):
    options = jdbc.connection_options({"type": kind, "host": "h", "login": "u", "password": "p"})
    assert options["url"].startswith(url)
    assert driver in options["driver"]
    assert (options["user"], options["password"]) == ("u", "p")


def test_unsupported_dialect():
    with pytest.raises(ValueError, match="Unsupported conn_type"):
        jdbc.connection_options({"type": "db9"})


def test_extract_options():
    conn = {"type": "mssql", "host": "h", "port": 99, "database": "d"}
    got = jdbc.extract_options(conn, {"query": "SELECT * FROM o WHERE d >= '{{ ds }}'", "batch_size": 10}, ds="2026-05-04")
    assert (got["query"], got["fetchsize"]) == ("SELECT * FROM o WHERE d >= '2026-05-04'", "10")
    assert "h:99;databaseName=d" in got["url"]
    assert jdbc.extract_options(conn, {"table": "dbo.o"})["dbtable"] == "dbo.o"
    with pytest.raises(ValueError, match="required"):
        jdbc.extract_options(conn, {})


@pytest.mark.parametrize(("low", "high", "n"), [(0, 99, 4), (-7, 12, 3), (5, 5, 4), (0, 2, 10), (0, 10**12, 7)])
def test_chunks_cover_every_row_once(spark, low, high, n):
    predicates = jdbc.chunk_predicates("k", low, high, n)
    values = sorted({low, high, low - 1, high + 1, (low + high) // 2, low + 1, high - 1})
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "k bigint")
    hits = df.select(sum((F.expr(p).cast("int").alias("x") if len(predicates) == 1 else F.coalesce(F.expr(f"cast(({p}) as int)"), F.lit(0))
                          for p in predicates), F.lit(0)).alias("n"))
    assert {r["n"] for r in hits.collect()} == {1}


def hits(df, predicates):
    """How many ranges each row falls into."""
    one = [F.coalesce(F.expr(f"cast(({p}) as int)"), F.lit(0)) for p in predicates]
    return {r["n"] for r in df.select(sum(one, F.lit(0)).alias("n")).collect()}


D, T = datetime.date(2026, 2, 27), datetime.datetime(2026, 2, 27, 23, 59, 59, 999999)


@pytest.mark.parametrize(("kind", "values", "how", "least"), [
    ("bigint", [-7, 0, 3, 12, 10**12], None, 3), ("bigint", [5], None, 1), ("decimal(10,2)", [decimal.Decimal("-1.50"), decimal.Decimal("99.99")], None, 4),
    ("double", [0.25, 0.5, 7.75], None, 4), ("date", [D + datetime.timedelta(days=i) for i in (0, 1, 2, 400)], None, 4),
    ("timestamp_ntz", [T, T + datetime.timedelta(microseconds=2), T + datetime.timedelta(days=9)], None, 4),
    ("string", ["a'b", "a\\b", "é", "zz", "zz", "", "M"], None, 4), ("bigint", [1] * 50 + [2, 3, 9] * 30, "quantile", 3),
])
def test_ranges_of_any_key_cover_every_row_once(spark, kind, values, how, least):
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"k {kind}")
    source = {"partition_column": "k", "num_partitions": 4, **({"partition_by": how} if how else {})}
    predicates = jdbc.partition_predicates(source, "SELECT * FROM t", lambda q: run_sql(spark, q, {"t": df}).collect(), "spark")
    assert len(predicates) >= least and hits(df, predicates) == {1}
    assert sorted(map(str, jdbc.by_predicates(df, predicates).collect())) == sorted(map(str, df.collect()))


def test_ranges_edges(spark):
    none = spark.createDataFrame([(None,)], "k bigint")
    assert jdbc.partition_predicates({"partition_column": "k", "num_partitions": 3}, "t", lambda q: run_sql(spark, q, {"t": none}).collect(), "spark") == ["1 = 1"]
    assert jdbc.partition_predicates({"query": "x"}, "t", None, "spark") is None
    for bad in ({"partition_column": "k; DROP", "num_partitions": 3}, {"partition_column": "k", "num_partitions": 0}):
        with pytest.raises(ValueError, match="partition"):
            jdbc.partition_predicates(bad, "t", None, "spark")
    assert jdbc.by_predicates(none, ["1 = 1", "k IS NULL"]).count() == 2


def test_literals_of_dialects():
    noon = datetime.datetime(2026, 5, 4, 12)
    assert [jdbc.literal("o'b\\", d) for d in ("mssql", "oracle", "mysql")] == ["N'o''b\\'", "'o''b\\'", "'o\\'b\\\\'"]
    assert [jdbc.literal(noon, d) for d in ("mssql", "oracle")] == ["'2026-05-04T12:00:00'", "TIMESTAMP '2026-05-04 12:00:00'"]
    assert [jdbc.literal(noon.date(), d) for d in ("mssql", "postgresql")] == ["'20260504'", "DATE '2026-05-04'"]


class FakeReader:
    """What Spark's reader is asked for; queries for bounds get rows, reads of data are kept."""

    def __init__(self, answers):
        self.answers, self.asked, self.read = list(answers), [], None
        self.spark = type("S", (), {"read": self})()

    def format(self, _):
        return self

    def options(self, **options):
        self.asked.append(options["query"])
        return self

    def load(self):
        return self

    def collect(self):
        return self.answers.pop(0)

    def jdbc(self, url, table, predicates, properties):
        self.read = (url, table, predicates, properties)
        return self


def test_config_extract_is_partitioned():
    fake = FakeReader([[(0, 99)]])
    source = {"query": "SELECT * FROM o WHERE d = '{{ ds }}'", "partition_column": "id", "num_partitions": 4, "batch_size": 10}
    jdbc.extract_source(fake.spark, {"type": "postgresql", "host": "h", "database": "d"}, source, ds="2026-05-04")
    assert fake.asked == ["SELECT MIN(id) AS low, MAX(id) AS high FROM (SELECT * FROM o WHERE d = '2026-05-04') q"]
    url, table, predicates, properties = fake.read
    assert (url, table) == ("jdbc:postgresql://h:5432/d", "(SELECT * FROM o WHERE d = '2026-05-04') q")
    assert predicates == ["id < 25 OR id IS NULL", "id >= 25 AND id < 50", "id >= 50 AND id < 75", "id >= 75"]
    assert properties["fetchsize"] == "10"
    fake = FakeReader([[("a", "z")], [(1, "a"), (2, "k"), (3, "t")]])
    jdbc.extract_source(fake.spark, {"type": "oracle", "host": "h"}, {"table": "app.o", "partition_column": "name", "num_partitions": 3})
    assert "NTILE(3) OVER (ORDER BY name)" in fake.asked[1] and "FROM app.o WHERE" in fake.asked[1]
    assert fake.read[2] == ["name < 'k' OR name IS NULL", "name >= 'k' AND name < 't'", "name >= 't'"]


def test_render_and_adapt():
    assert render("{{ ds }}{{ds}}-{{ run_id }}{{run_id}} {{ other }}", "D", "R") == "DD-RR {{ other }}"
    assert to_spark_sql("DATEDIFF('day', a, b)") == "DATEDIFF(DAY, DATE_TRUNC('DAY', a), DATE_TRUNC('DAY', b))"
    assert to_spark_sql("CAST(x AS VARCHAR), y::varchar, CAST(z AS VARCHAR(3)), 'as varchar'") == "CAST(x AS STRING), y::STRING, CAST(z AS VARCHAR(3)), 'as varchar'"
    assert to_spark_sql("regexp_matches(x, 'a')") == "regexp_like(x, 'a')"


@pytest.mark.parametrize(("text", "want"), [
    ("SELECT a FROM t ORDER BY a", [(1,), (2,), (None,)]), ("SELECT a FROM t ORDER BY a DESC", [(2,), (1,), (None,)]),
    ("SELECT a FROM t ORDER BY a DESC NULLS FIRST, b", [(None,), (2,), (1,)]), ("SELECT a FROM (SELECT a FROM t ORDER BY a LIMIT 1)", [(1,)]),
    ("SELECT a, row_number() OVER (PARTITION BY 1 ORDER BY a DESC) AS n FROM t ORDER BY n", [(2, 1), (1, 2), (None, 3)]),
    ("WITH c AS (SELECT * FROM t ORDER BY a LIMIT 2) SELECT sum(a) FROM c", [(3,)]),
    ("SELECT 1/0, -1.5/0, 7/2, 7 / 2 / 2, NULL/0, 12 / (8 / 2), '1/0'", [(float("inf"), float("-inf"), 3.5, 1.75, None, 3.0, "1/0")]),
    ("SELECT sum(a) / count(*) FROM t", [(1.0,)]), ("SELECT a / 2, count(*) FROM t GROUP BY a / 2 ORDER BY a / 2", [(0.5, 1), (1.0, 1), (None, 1)]),
    ("SELECT 'é' AS x, 3 / 2 -- 1/0 ORDER BY\n", [("é", 1.5)]), ("SELECT CASE WHEN a IN (SELECT 4 / 2) THEN 'y' END FROM t ORDER BY 1", [("y",), (None,), (None,)]),
    ("SELECT try_cast('1.5' AS BIGINT), try_cast('2.5' AS INT), try_cast('-2.5' AS bigint), try_cast('x' AS int), try_cast(' 7 ' AS int), try_cast('99999999999' AS int)",
     [(2, 3, -3, None, 7, None)]),
    ("SELECT CAST(2.5D AS BIGINT), CAST(3.5D AS BIGINT), CAST(-1.5D AS BIGINT), CAST(2.5 AS BIGINT), 1.7D::int, CAST(true AS INT), TRY_CAST(1e300 AS BIGINT)",
     [(2, 4, -2, 3, 2, 1, None)]),
])
def test_user_sql_keeps_its_results(spark, text, want):
    t = spark.createDataFrame([(2, 1), (None, 2), (1, 3)], "a int, b int")
    assert [tuple(r) for r in run_sql(spark, text, {"t": t}).collect()] == want


def test_user_sql_keeps_names_and_errors(spark):
    t = spark.createDataFrame([(2, 1)], "a int, b int")
    assert run_sql(spark, "SELECT a / b, a / b AS x, a + 1, count(*) FROM t GROUP BY ALL", {"t": t}).columns == ["(a / b)", "x", "(a + 1)", "count(1)"]
    with pytest.raises(PySparkException, match="PARSE_SYNTAX_ERROR"):
        run_sql(spark, "SELECT FROM WHERE / ", {"t": t})
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        run_sql(spark, "SELECT CAST('x' AS BIGINT)", {}).collect()


def test_transform_two_inputs(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, val string")
    right = spark.createDataFrame([(2, "z")], "id int, other string")
    got = transform(
        spark, "SELECT l.id, l.val, ext.r.other FROM up_1.l l LEFT JOIN ext.r ON l.id = ext.r.id WHERE 'up_1.l' <> val",
        {"up-1": {"l": left}, "ext": {"r": right}})
    assert rows(got) == [(1, "a", None), (2, "b", "z")]


def test_explicit_input_and_bad_sql(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert transform(spark, "SELECT id + 1 AS n FROM _explicit.result", {}, {"result": df}).first()["n"] == 2
    with pytest.raises(PySparkException):
        transform(spark, "SELECT * FROM nowhere.table_x", {})


def test_views_are_dropped(spark):
    run_sql(spark, "SELECT * FROM a.b", {"a.b": spark.range(1), "plain": spark.range(1)})
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("a__b", "plain"))]


def test_routine_out_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, v double")
    result, seen = routine(spark, "SELECT * FROM t WHERE id >= :low", {"t": df}, {"low": 2}, {"n": F.count(F.lit(1)), "s": F.sum("v")})
    assert result.columns == ["id", "v"]
    assert result.collect() and seen.get == {"n": 1, "s": 3.0}


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_options(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id|name|x\n1|Alice|NA\n2|Bob|3\n")
    source = {"path": path, "delimiter": "|", "read_options": {"usecols": ["id", "x"], "na_values": "NA", "dtype": {"id": "string"}}}
    assert [tuple(r) for r in files.ingest(spark, source).collect()] == [("1", None), ("2", 3)]
    assert files.ingest(spark, {"path": path, "delimiter": "|", "read_options": {"nrows": 1}}).count() == 1
    named = files.ingest(spark, {"path": path, "delimiter": "|", "read_options": {"names": ["a", "b", "c"]}})
    assert (named.columns, named.count()) == (["a", "b", "c"], 3)
    with pytest.raises(ValueError, match="skipfooter"):
        files.ingest(spark, {"path": path, "read_options": {"skipfooter": 1}})


def test_other_formats(spark, tmp_path):
    tsv = write(tmp_path / "a.tsv", "id\tname\n1\tAl\n2\tBo\n")
    assert files.ingest(spark, {"s3_path": tsv, "format": "TSV", "delimiter": ","}).columns == ["id", "name"]
    jsonl = write(tmp_path / "a.jsonl", '{"id":1,"name":"Alice"}\n{"id":2}\n')
    for kind in ("json", "jsonl", "ndjson"):
        assert files.ingest(spark, {"path": jsonl, "format": kind}).count() == 2
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert files.ingest(spark, {"path": str(tmp_path / "p*"), "format": "parquet"}).count() == 3
    with pytest.raises(ValueError, match="Unsupported file format: xyz"):
        files.ingest(spark, {"path": "x", "format": "xyz"})


def test_messages(spark, rows):
    df = spark.createDataFrame([('{"id":1,"event":"click"}',), ('{"id":2,"event":"view","n":{"x":1.5}}',)], "value string")
    got = messages.decode_json(df)
    assert sorted(got.columns) == ["event", "id", "n"]
    assert rows(got.select("id", "event")) == [(1, "click"), (2, "view")]
    bad = df.unionByName(spark.createDataFrame([("not json",)], "value string"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        messages.decode_json(bad).collect()
    raw = messages.decode_json_or_raw(bad)
    assert rows(raw.select("id", "raw")) == [(1, None), (2, None), (None, "not json")]


def test_no_messages(spark):
    empty = spark.createDataFrame([], "value string")
    assert messages.decode_json(empty).schema.simpleString() == "struct<message:string>"
    assert messages.decode_json_or_raw(empty).columns == ["raw"]


def test_message_limit(spark, rows):
    df = spark.createDataFrame([(i, str(i)) for i in (3, 1, 2)], "offset int, value string")
    assert rows(messages.first_messages(df, ["offset"], 2).select("offset")) == [(1,), (2,)]
    assert messages.first_messages(df, ["offset"], None).count() == 3
    texts = df.selectExpr("offset", "concat('{\"v\":', value, '}') AS value")
    assert rows(messages.consume(texts, ["offset"], max_messages=2)) == [(1,), (2,)]
    assert rows(messages.consume(df.selectExpr("offset", "'x' AS value"), ["offset"], "v INT", 1, keep_raw=True)) == [(None, "x")]
    assert messages.kafka_options("b:1", "t", "latest")["startingOffsets"] == "latest"


def test_increment(spark, tmp_path):
    step = windows.Increment(spark, str(tmp_path / "mark"), "k")
    counts = []
    for upper in (3, 3, 5):
        got = step.rows(spark.range(upper).withColumnRenamed("id", "k"))
        counts.append(got.count())
        step.commit()
    assert (counts, step.last()) == ([3, 0, 2], 4)


def test_cdc_apply(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    changes = spark.createDataFrame(
        [(1, 1, 4, "a2"), (1, 2, 3, "old"), (1, 3, 4, "a3"), (2, 1, 4, "x"), (2, 2, 1, None), (4, 1, 2, "d"), (5, 1, 2, "e"), (5, 2, 1, None)],
        "id int, lsn int, operation int, v string")
    assert rows(windows.cdc_apply(base, changes, ["id"], ["lsn"])) == [(1, "a3"), (3, "c"), (4, "d")]
    extracted = windows.cdc_extract(changes.drop("v"), base, "id")
    assert rows(extracted.select("id", "lsn")) == [(1, 1), (1, 3), (2, 1)]


def test_day_window_is_half_open(spark, rows):
    days = [(datetime.date(2026, 5, d),) for d in (2, 3, 4)]
    assert rows(windows.day_window(spark.createDataFrame(days, "d date"), "d", "2026-05-04")) == [(days[1][0],)]


def test_type_names(spark):
    df = spark.sql("SELECT 1 i, 1L b, 1.50 d, array('a') l, named_struct('x', 1) s, map('k', 1) m, date'2020-01-01' t, "
                   "timestamp_ntz'2020-01-01' n, true f, X'00' z")
    assert [sql_type_name(f.dataType) for f in df.schema.fields] == [
        "INTEGER", "BIGINT", "DECIMAL(3,2)", "VARCHAR[]", "STRUCT(x INTEGER)", "MAP(VARCHAR, INTEGER)", "DATE", "TIMESTAMP",
        "BOOLEAN", "BLOB"]


def test_user_views_and_literals_survive(spark, rows):
    spark.createDataFrame([(9,)], "id int").createOrReplaceTempView("orders")
    own = spark.createDataFrame([(1, "2026-01-01 23:00:00", "2026-01-02 01:00:00")], "id int, a string, b string")
    got = run_sql(spark, "SELECT id, 'see x.orders now' AS note FROM x.orders -- x.orders\n", {"x.orders": own})
    assert rows(got) == [(1, "see x.orders now")]
    assert rows(run_sql(spark, "WITH orders AS (SELECT id + 1 AS id FROM orders) SELECT id FROM orders;", {"orders": own})) == [(2,)]
    assert rows(spark.table("orders")) == [(9,)]
    days = "SELECT DATEDIFF('day', CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP)) AS d FROM orders"
    assert rows(run_sql(spark, days, {"orders": own})) == [(1,)]
    spark.catalog.dropTempView("orders")


def test_changes_are_dealt_before_they_are_ranked(spark):
    """A sort below the shuffle holds a whole partition of the scan."""
    changes = spark.createDataFrame([], "id int, v string, operation int, lsn int")
    plan = windows._latest_changes(changes, ["id"], ["lsn"], "operation")._jdf.queryExecution().executedPlan().toString()
    under = plan.partition("Exchange hashpartitioning")[2]
    assert under and "Sort" not in under and plan.count("Exchange") == 1
