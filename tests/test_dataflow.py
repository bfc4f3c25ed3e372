import pytest
from pyspark.sql import functions as F

from tablewright.operators import runlog as r
from tablewright.plans import dataflow
from tablewright.plans.dataflow import producer_of, resolve_config, run_pipeline, task_order
from tablewright.sinks.store import TableStore
from tablewright.sources.artifacts import Artifacts


def config(*tasks):
    return {"pipeline_id": "p", "tasks": list(tasks)}


EXTRACT = {"task_id": "ext", "type": "sql_extract", "source": {"connection": "db", "query": "SELECT * FROM t WHERE id < 3"}}
CHECK = {"task_id": "dq", "type": "data_quality", "depends_on": ["ext"], "checks": [{"type": "not_null", "column": "id"}]}
TRANSFORM = {"task_id": "tr", "type": "sql_transform", "depends_on": ["dq"], "output": {"table": "out"},
             "sql": "SELECT id * 10 AS x, '{{ ds }}' AS ds, '{{run_id}}' AS run FROM ext.raw_data"}
LOAD = {"task_id": "load", "type": "load_target", "depends_on": ["tr"],
        "target": {"type": "table", "table": "T", "write_mode": "replace"}}


def run(spark, tmp_path, cfg, **kwargs):
    db = {"db": {"t": spark.createDataFrame([(1,), (2,), (3,)], "id int")}}
    store = TableStore(spark, str(tmp_path / "store"))
    return run_pipeline(spark, cfg, Artifacts(spark, str(tmp_path / "a")), store, db, ds="2026-05-04", run_id="run_001", **kwargs), store


def test_chain(spark, tmp_path, rows):
    done, store = run(spark, tmp_path, config(EXTRACT, CHECK, TRANSFORM, LOAD, {"task_id": "say", "type": "notification"}))
    assert rows(store.read("T")) == [(10, "2026-05-04", "run_001"), (20, "2026-05-04", "run_001")]
    log = {row["task_id"]: row for row in done.log().collect()}
    assert log["ext"]["output_row_count"] == 2 and log["ext"]["output_schema"] == '{"id": "INTEGER"}'
    assert log["dq"]["qc_passed"] and log["say"]["status"] == "skipped"
    assert log["load"]["message"] == "Loaded 2 rows to table:T"


def test_failed_check_stops(spark, tmp_path):
    bad = {**CHECK, "checks": [{"type": "row_count_min", "value": 100}]}
    with pytest.raises(ValueError, match="Data quality failed") as caught:
        run(spark, tmp_path, config(EXTRACT, bad, TRANSFORM))
    assert [x["status"] for x in caught.value.run_log] == ["success", "failed"]
    done, _ = run(spark, tmp_path, config(EXTRACT, {**bad, "fail_pipeline_on_error": False}, TRANSFORM))
    assert done.output("tr").count() == 2


def test_schema_check_stops(spark, tmp_path):
    shape = {"task_id": "s", "type": "schema_validate", "depends_on": ["ext"], "expected_schema": {"nope": "INT"}}
    with pytest.raises(ValueError, match="Schema validation failed"):
        run(spark, tmp_path, config(EXTRACT, shape))


def test_other_task_types(spark, tmp_path, rows):
    (tmp_path / "f.csv").write_text("id,day\n1,2026-05-04\n")
    message = spark.createDataFrame([(7,)], "id int")
    done, _ = run(
        spark, tmp_path, config(
            {"task_id": "f", "type": "file_ingest", "source": {"path": str(tmp_path / "f.csv")}},
            {"task_id": "m", "type": "kafka_consume", "topic": "clicks"},
            {"task_id": "proc", "type": "stored_proc", "depends_on": ["f"], "sql": "SELECT * FROM f.file_data WHERE id >= :low",
             "parameters": [{"name": "low", "value": "0"}, {"name": "RowsInserted", "value": None, "direction": "out"}],
             "output": {"table": "summary"}},
            {"task_id": "both", "type": "duckdb_query", "depends_on": ["m", "proc"],
             "sql": "SELECT id FROM m.kafka_messages UNION ALL SELECT id FROM proc.summary"}),
        topics={"clicks": lambda: message})
    assert rows(done.output("both")) == [(1,), (7,)]
    log = {row["task_id"]: row["message"] for row in done.log().collect()}
    assert log["proc"] == '{"RowsInserted": 1}'


def test_order_errors():
    with pytest.raises(ValueError, match="unknown upstream tasks: x"):
        task_order(config({"task_id": "a", "type": "sql_extract", "depends_on": ["x"]}))
    a, b = {"task_id": "a", "depends_on": ["b"]}, {"task_id": "b", "depends_on": ["a"]}
    with pytest.raises(ValueError, match="depend on each other"):
        task_order(config(a, b))


def test_producer_walk():
    tasks = {t["task_id"]: t for t in (EXTRACT, CHECK, {"task_id": "dq2", "type": "schema_validate", "depends_on": ["dq"]})}
    assert producer_of(tasks, "dq2") == "ext"
    loop = {"a": {"type": "data_quality", "depends_on": ["b"]}, "b": {"type": "data_quality", "depends_on": ["a"]}}
    assert producer_of(loop, "a") is None


ENV = {"s3_buckets": {"b": "bucket"}, "container_registries": {"t": "${b}"}, "secrets": {"s": 5},
       "connections": {"src": {"type": "mssql", "host": "h"}}}
TEXT = "${b}/${registry.t}/${secret.s}/${none}/${/$b}${"


def test_resolve_config():
    got = resolve_config({"tasks": [{"source": {"connection": "src", "path": TEXT, "n": [1, "${b}"]}}]}, ENV)
    assert got["tasks"][0]["source"] == {"type": "mssql", "host": "h", "connection": "src", "n": [1, "bucket"],
                                         "path": "bucket/${b}/5/${none}/${/$b}${"}


def test_resolve_column_equals_resolve_config(spark):
    df = spark.createDataFrame([(TEXT,), ("plain",), ("${b}",), ("x${b",), (None,)], "c string")
    got = [row[0] for row in df.select(r.resolve_placeholders(F.col("c"), r.substitutions(ENV))).collect()]
    assert got == ["bucket/${b}/5/${none}/${/$b}${", "plain", "bucket", "x${b", None]


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    from tablewright import session

    monkeypatch.setattr(session, "_SCRATCH", {})
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    paths = [session.scratch_path(spark, "step") for _ in range(3)]
    for path in paths[:2]:
        spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) == 2 and session.clear_scratch(spark) == 0
    assert not any((tmp_path / p.rsplit("/", 1)[1]).exists() for p in paths)


# ---- topics ------------------------------------------------------------------

TAKE = {"task_id": "m", "type": "kafka_consume", "topic": "clicks", "schema": "id INT"}


def topic(spark, *texts, partitions=2):
    """Messages dealt out in turn; offsets of a partition have a gap."""
    rows = [(t, i % partitions, 5 + 2 * (i // partitions)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "value string, partition int, offset bigint")


def consume(spark, tmp_path, messages, run_id, **task):
    store = TableStore(spark, str(tmp_path / "store"))
    cfg = config({**TAKE, **task})
    done = run_pipeline(spark, cfg, Artifacts(spark, str(tmp_path / "a")), store, topics={"clicks": messages}, run_id=run_id)
    return sorted(r[0] for r in done.output("m").collect())


def ids(n, start=0):
    return [f'{{"id":{i}}}' for i in range(start, n)]


def test_every_message_is_read_once(spark, tmp_path):
    assert consume(spark, tmp_path, topic(spark, *ids(5)), "r1", max_messages=3) == [0, 1, 2]
    assert consume(spark, tmp_path, topic(spark, *ids(9)), "r2", max_messages=3) == [3, 4, 6]
    assert consume(spark, tmp_path, topic(spark, *ids(9)), "r2", max_messages=3) == [3, 4, 6]  # the same run again
    assert consume(spark, tmp_path, topic(spark, *ids(9)), "r3") == [5, 7, 8]
    assert consume(spark, tmp_path, topic(spark, *ids(9)), "r4") == []
    assert consume(spark, tmp_path, topic(spark, *ids(9)), "r1") == [0, 1, 2]
    assert consume(spark, tmp_path, topic(spark, *ids(9)), "r5", group_id="other") == list(range(9))


def test_messages_that_are_not_json_fail_and_come_again(spark, tmp_path):
    bad = topic(spark, *ids(2), "not json", *ids(4, 3))
    for run_id in ("r1", "r2"):
        with pytest.raises(Exception, match="MALFORMED|malformed"):
            consume(spark, tmp_path, bad, run_id)
    raw = {"task_id": "m", "type": "pubsub_consume", "subscription": "clicks", "schema": "id INT"}
    store = TableStore(spark, str(tmp_path / "store"))
    done = run_pipeline(spark, config(raw), Artifacts(spark, str(tmp_path / "a")), store, topics={"clicks": bad}, run_id="r3")
    assert sorted(map(str, (tuple(r) for r in done.output("m").collect()))) == ["(0, None)", "(1, None)", "(3, None)", "(None, 'not json')"]


def test_failed_run_repeats_its_messages(spark, tmp_path, monkeypatch):
    from tablewright.sources.messages import Offsets

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(Offsets, "commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            consume(spark, tmp_path, topic(spark, *ids(3)), "r1")
    assert consume(spark, tmp_path, topic(spark, *ids(4)), "r2") == [0, 1, 2, 3]


def test_latest_starts_at_the_end(spark, tmp_path):
    assert consume(spark, tmp_path, topic(spark, *ids(4)), "r1", auto_offset_reset="latest") == []
    assert consume(spark, tmp_path, topic(spark, *ids(7)), "r2", auto_offset_reset="latest") == [4, 5, 6]
    with pytest.raises(ValueError, match="auto_offset_reset"):
        consume(spark, tmp_path, topic(spark, *ids(4)), "r3", auto_offset_reset="never", group_id="g")
    with pytest.raises(ValueError, match="no source"):
        run_pipeline(spark, config(TAKE), Artifacts(spark, str(tmp_path / "a")), TableStore(spark, str(tmp_path / "s")), run_id="r")


def test_empty_and_new_partitions(spark, tmp_path):
    assert consume(spark, tmp_path, topic(spark), "r0") == []
    assert consume(spark, tmp_path, topic(spark, *ids(2)), "r1") == [0, 1]
    assert consume(spark, tmp_path, topic(spark, *ids(3), partitions=3), "r2") == [2]


def test_kafka_options_from_offsets():
    from tablewright.sources.messages import kafka_options

    assert kafka_options("h:1", "t")["startingOffsets"] == "earliest"
    assert kafka_options("h:1", "t", starts={1: 7, 0: 3})["startingOffsets"] == '{"t": {"0": 3, "1": 7}}'


def test_ranges_of_a_frame_ask_for_no_order_over_all_rows(spark, tmp_path, monkeypatch):
    """NTILE without a partition is one task."""
    asked, run_sql = [], dataflow.run_sql
    monkeypatch.setattr(dataflow, "run_sql", lambda spark, sql, frames: asked.append(sql) or run_sql(spark, sql, frames))
    source = {"connection": "c", "query": "SELECT * FROM t", "partition_column": "k", "partition_by": "quantile", "num_partitions": 3}
    ranges = config({"task_id": "e", "type": "sql_extract", "source": source})
    run = run_pipeline(spark, ranges, Artifacts(spark, str(tmp_path / "a")), TableStore(spark, str(tmp_path / "s")),
                                {"c": {"t": spark.range(100).selectExpr("id % 9 AS k", "id")}}, run_id="r")
    assert run.output("e").count() == 100 and asked and not any("OVER" in sql for sql in asked)
