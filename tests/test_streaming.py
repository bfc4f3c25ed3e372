import datetime

from tablewright.sinks import store as store_module
from tablewright.sinks.store import TableStore
from tablewright.streaming import streams

T0 = datetime.datetime(2026, 5, 4, 12)


def test_consume_continues_from_its_checkpoint(spark, tmp_path, rows):
    feed, out, mark = (str(tmp_path / n) for n in ("feed", "out", "mark"))
    for batch in (['{"id":1}', "junk"], ['{"id":2}'], []):
        if batch:
            spark.createDataFrame([(v,) for v in batch], "value string").coalesce(1).write.mode("append").parquet(feed)
        streams.consume(streams.file_stream(spark, feed, "value string", 1), "id INT", out, mark)
    assert rows(spark.read.parquet(out).select("id", "raw")) == [(1, None), (2, None), (None, "junk")]


def test_throughput_corrects_an_hour_for_late_rows(spark, tmp_path, rows):
    feed, store = str(tmp_path / "feed"), TableStore(spark, str(tmp_path / "store"))
    schema = "start_time timestamp, status string, total_rows_processed bigint"
    for data in ([(T0, "success", 5), (T0 + datetime.timedelta(hours=1), "failed", 1)], [(T0, "failed", None)]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(feed)
        streams.throughput(streams.file_stream(spark, feed, schema), store, "hours", str(tmp_path / "mark"))
    assert rows(store.read("hours")) == [(T0, 2, 1, 5), (T0 + datetime.timedelta(hours=1), 1, 0, 1)]


def test_quality_per_batch(spark, tmp_path, rows):
    feed, store = str(tmp_path / "feed"), TableStore(spark, str(tmp_path / "store"))
    for data in ([(1,), (None,)], [(2,)]):
        spark.createDataFrame(data, "id int").coalesce(1).write.mode("append").parquet(feed)
        streams.quality(streams.file_stream(spark, feed, "id int"), [{"type": "not_null", "column": "id"}], store, "q", str(tmp_path / "mark"), "feed")
    assert rows(store.read("q").select("batch_id", "passed", "count")) == [(0, False, 1), (1, True, 0)]


EVENTS = ("task_run_id string, run_id string, pipeline_id string, task_id string, seq int, status string, "
          "start_time timestamp_ntz, end_time timestamp_ntz, output_row_count bigint, output_path string, error_message string")


def task_batches(spark, tmp_path, batches, marks):
    store, feed = TableStore(spark, str(tmp_path / "store")), str(tmp_path / "feed")
    for batch, mark in zip(batches, marks, strict=True):
        if batch:
            spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(feed)
        streams.task_upsert(streams.file_stream(spark, feed, EVENTS, 1), store, "state", str(tmp_path / mark))
    return store


def test_replayed_batch_counts_once(spark, tmp_path):
    """A lost checkpoint delivers all batches again."""
    start = [("a", "r", "p", "t", 1, "RUNNING", T0, None, None, "x", None)]
    end = [("a", "r", "p", "t", 2, "SUCCESS", None, T0, 5, None, None)]
    store = task_batches(spark, tmp_path, [start, end, None], ["m1", "m1", "m2"])
    assert store.read("state").count() == 1
    row = streams.task_state(store, "state").first()
    assert (row["status"], row["start_time"], row["output_row_count"], row["output_path"]) == ("success", T0, 5, "x")


def test_late_event_does_not_undo_a_later_one(spark, tmp_path):
    end = [("a", None, None, "t", 2, "FAILED", None, T0, None, None, "boom")]
    start = [("a", "r", "p", "t", 1, "RUNNING", T0, None, 4, "x", None)]
    row = streams.task_state(task_batches(spark, tmp_path, [end, start], ["m", "m"]), "state").first()
    assert (row["status"], row["end_time"], row["error_message"], row["run_id"], row["output_row_count"]) == ("failed", T0, "boom", "r", 4)


def test_state_is_read_without_a_fold_and_written_by_bucket(spark, tmp_path):
    many = [(f"a{i}", "r", "p", "t", 1, "RUNNING", T0, None, None, None, None) for i in range(50)]
    store = task_batches(spark, tmp_path, [many], ["m"])
    before = store.buckets("state")
    one = [("a3", "r", "p", "t", 2, "SUCCESS", T0, T0, None, None, None)]
    store = task_batches(spark, tmp_path, [one], ["m"])
    after = store.buckets("state")
    assert sum(before[b] != after[b] for b in before) == 1
    state = streams.task_state(store, "state")
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert state.where("status = 'success'").count() == 1 and state.count() == 50


def test_quality_results_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT_EVERY", 2)
    feed, store = str(tmp_path / "feed"), TableStore(spark, str(tmp_path / "store"))
    for i in range(5):
        spark.createDataFrame([(i,)], "id int").coalesce(1).write.mode("append").parquet(feed)
        streams.quality(streams.file_stream(spark, feed, "id int"), [{"type": "not_null", "column": "id"}], store, "q", str(tmp_path / "mark"), "feed")
    assert store.read("q").count() == 5 and len(store._current("q").parts) == 3


def test_a_batch_of_task_events_is_shuffled_once(spark, tmp_path, monkeypatch):
    """One shuffle folds events and stored rows, and each of its partitions lies in one bucket."""
    plans, write = [], store_module.write_counted
    monkeypatch.setattr(store_module, "write_counted", lambda df, *a, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a, **b))
    many = [(f"a{i}", "r", "p", "t", n, "RUNNING", T0, None, None, None, None) for i in range(200) for n in (1, 2)]
    store = task_batches(spark, tmp_path, [many, many], ["m", "m"])
    assert store.read("state").count() == 200
    assert [plan.count("Exchange") for plan in plans] == [1, 1]
    assert len(store.read("state").inputFiles()) == len(store.buckets("state")) == 8
