import datetime
import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import runlog as r

T0 = datetime.datetime(2026, 5, 4, 12)
MINUTE = datetime.timedelta(minutes=1)
RUN = "run_id string, pipeline_id string, status string, start_time timestamp_ntz, created_at timestamp_ntz, duration_seconds double, total_rows_processed bigint"


def test_dashboard_with_no_rows(spark):
    runs = spark.createDataFrame([], RUN)
    alerts = spark.createDataFrame([], "is_resolved boolean")
    tasks = spark.createDataFrame([], "created_at timestamp_ntz, status string")
    got = r.kpi_dashboard(runs, alerts, tasks, str(T0)).first().asDict()
    assert set(got.values()) == {0} and len(got) == 9
    assert r.panel_success_rate(runs, str(T0)).first()["value"] is None
    assert {row["success_rate"] for row in r.kpi_windowed(runs, str(T0), fallback_rate=42.0).collect()} == {42.0}


def test_rates(spark):
    data = [(f"r{i}", "p", s, T0 - i * MINUTE, T0 - i * MINUTE, 10.0, 5) for i, s in enumerate(["success", "success", "failed", "running"])]
    runs = spark.createDataFrame(data, RUN)
    assert r.panel_success_rate(runs, str(T0)).first()["value"] == 50.0
    by_window = {row["time_window"]: row for row in r.kpi_windowed(runs, str(T0)).collect()}
    assert len(by_window) == 8 and by_window["15m"]["success_rate"] == 67.0
    assert tuple(r.status_counts(runs).first()) == (1, 1, 2)


@pytest.mark.parametrize(("states", "expected"), [
    (["running", "failed"], "running"), (["failed", "success"], "failed"), (["success", "success"], "success"),
    (["success", "pending"], "pending")])
def test_rollup_state(spark, states, expected):
    tasks = spark.createDataFrame([("r", "p", s, T0, None, None) for s in states],
                                  "run_id string, pipeline_id string, status string, start_time timestamp_ntz, end_time timestamp_ntz, output_row_count bigint")
    row = r.run_rollup(tasks).first()
    assert (row["status"], row["total_rows"]) == (expected, 0)


EVENT = ("task_run_id string, run_id string, pipeline_id string, task_id string, seq int, status string, start_time timestamp_ntz, "
         "end_time timestamp_ntz, output_row_count bigint, output_path string, error_message string")


def declared(spark, **totals):
    return spark.createDataFrame(list(totals.items()), "pipeline_id string, total_tasks bigint")


def test_replayed_events_count_once(spark):
    ends = [("a", "r", "p", "t1", 2, "SUCCESS", T0, T0 + MINUTE, 3, None, None), ("b", "r", "p", "t2", 1, "RUNNING", T0, None, None, None, None)]
    events = spark.createDataFrame(ends + ends[:1] * 2, EVENT)
    counters = r.run_counters(events, declared(spark, p=2))
    row = counters.first()
    assert (row["completed_tasks"], row["total_rows_processed"], row["total_tasks"]) == (1, 3, 2)
    assert r.run_finalize(counters).first()["status"] == "running"


def test_runs_end_with_their_own_number_of_tasks(spark, rows):
    events = spark.createDataFrame([
        (f"{run}{i}", run, p, f"t{i}", 1, "FAILED" if i == 3 else "SUCCESS", T0, T0 + MINUTE * i, 1, None, None)
        for run, p in (("r", "p"), ("s", "q"), ("u", "p"), ("x", "none")) for i in (1, 2, 3)], EVENT)
    stored = spark.createDataFrame([("u", 4), ("r", 1)], "run_id string, total_tasks bigint")
    got = r.run_finalize(r.run_counters(events, declared(spark, p=2, q=3), stored))
    found = {row["run_id"]: (row["status"], row["end_time"], row["total_tasks"], row["failed_tasks"]) for row in got.collect()}
    assert found == {"r": ("success", T0 + MINUTE * 2, 2, 1), "s": ("failed", T0 + MINUTE * 3, 3, 1), "u": ("running", None, 4, 1), "x": ("running", None, 0, 1)}


def test_declared_tasks(spark, rows):
    configs = spark.createDataFrame([("p", True, '{"tasks":[{"task_id":"a"},{"task_id":"b"}]}'), ("p", False, '{"tasks":[{}]}'), ("q", True, "{}"), ("z", True, None)],
                                    "pipeline_id string, is_active boolean, config string")
    assert rows(r.declared_tasks(configs)) == [("p", 2), ("q", 0), ("z", 0)]


def test_marks_fold_in_any_order(spark, rows):
    schema = EVENT + ", metrics string, output_table string, worker_host string"
    events = [("a", "r", "p", "t", 1, "RUNNING", T0, None, 5, "x", None, "m", "tbl", "h1"), ("a", None, None, None, 2, "FAILED", None, T0, None, None, "e", None, None, "h2"),
              ("a", "r", "p", "t", 3, "SUCCESS", T0 + MINUTE, T0, None, "y", None, "m3", None, "h3")]
    whole = rows(r.task_run_upsert(spark.createDataFrame(events, schema)))
    marks = [r.task_marks(spark.createDataFrame([e], schema)) for e in events]
    for order in ((2, 0, 1), (0, 2, 2, 1, 0)):
        folded = marks[order[0]]
        for i in order[1:]:
            folded = r.merge_marks(folded, marks[i])
        assert rows(r.marked_state(folded)) == whole
    row = r.marked_state(marks[0]).first()
    assert (row["status"], row["worker_host"], row["output_table"]) == ("running", "h1", "tbl")


def test_task_fold_keeps_outputs(spark):
    events = spark.createDataFrame([
        ("a", "r", "p", "t", 1, "RUNNING", T0, None, None, "x", None),
        ("a", "r", "p", "t", 2, "FAILED", T0 + MINUTE, T0 + MINUTE, 7, None, "boom"),
        ("a", "r", "p", "t", 3, "SUCCESS", T0 + MINUTE, None, None, None, None)], EVENT)
    row = r.task_run_upsert(events).first()
    assert (row["status"], row["start_time"], row["output_row_count"], row["output_path"]) == ("success", T0, 7, "x")
    assert (row["end_time"], row["error_message"]) == (None, None)


@pytest.mark.parametrize(("states", "total", "status"), [
    (["success", "success"], 2, "success"), (["success", "failed"], 2, "failed"), (["success"], 2, "running")])
def test_finalize(spark, states, total, status):
    events = spark.createDataFrame(
        [(f"a{i}", "r", "p", f"t{i}", 1, s, T0, T0 + MINUTE, 3, None, None) for i, s in enumerate(states)], EVENT)
    row = r.run_finalize(r.run_counters(events, declared(spark, p=total))).first()
    assert row["status"] == status
    assert row["duration_seconds"] == (None if status == "running" else 60.0)


def test_mark_failed_once(spark, rows):
    tasks = spark.createDataFrame([("a", "running", None), ("b", "failed", "first"), ("c", "success", None)],
                                  "task_run_id string, status string, error_message string").withColumn("end_time", F.lit(None).cast("timestamp_ntz"))
    reports = spark.createDataFrame([("a", "x" * 3000, T0), ("b", "again", T0), ("d", "lost", T0)],
                                    "task_run_id string, error_message string, end_time timestamp_ntz")
    got = {row["task_run_id"]: row for row in r.mark_failed_once(tasks, reports).collect()}
    assert {k: v["newly_failed"] for k, v in got.items()} == {"a": True, "b": False, "c": False, "d": True}
    assert (len(got["a"]["error_message"]), got["b"]["error_message"], got["c"]["status"]) == (2000, "first", "success")
    again = r.mark_failed_once(r.mark_failed_once(tasks, reports).drop("newly_failed"), reports)
    assert again.where("newly_failed").count() == 0


def test_downstream(spark):
    text = '{"tasks":[{"task_id":"d","depends_on":["c"]},{"task_id":"a"},{"task_id":"b","depends_on":["a"]},{"task_id":"c","depends_on":["b"]},{"task_id":"e","depends_on":["x"]}]}'
    df = spark.createDataFrame([(text,)], "config string")
    reach = lambda task: sorted(df.select(r.downstream(F.col("config"), F.lit(task))).first()[0])
    assert (reach("b"), reach("a"), reach("e")) == (["b", "c", "d"], ["a", "b", "c", "d"], ["e"])


def edges_of(spark, *graphs):
    rows = [(str(i), "1", json.dumps({"tasks": [{"task_id": c, "depends_on": p} for c, p in g]})) for i, g in enumerate(graphs)]
    return spark.createDataFrame(rows, "pipeline_id string, version string, config string")


def test_downstream_of_long_chains_and_circles(spark):
    chain = [(f"t{i + 1}", [f"t{i}"]) for i in range(1000)]
    circle = [("a", ["t7", "c"]), ("b", ["a"]), ("c", ["b"]), ("z", ["y"])]
    wide = [(f"w{i}", ["t7"]) for i in range(30)] + [("end", [f"w{i}" for i in range(30)])]
    found = r.downstream_tasks(edges_of(spark, chain, circle, wide, []), "t7").groupBy("pipeline_id").agg(F.collect_set("task_id").alias("s"))
    got = {row["pipeline_id"]: set(row["s"]) for row in found.collect()}
    assert got == {"0": {f"t{i}" for i in range(7, 1001)}, "1": {"t7", "a", "b", "c"}, "2": {"t7", "end", *(f"w{i}" for i in range(30))}, "3": {"t7"}}


def test_downstream_equals_the_closure_in_a_row(spark, rows):
    text = [("b", ["a"]), ("c", ["b", "x"]), ("d", ["c", "a"]), ("e", ["q"]), ("a", [])]
    df = edges_of(spark, text)
    both = df.select(F.explode(r.downstream(F.col("config"), F.lit("a"))).alias("task_id"))
    assert rows(both) == rows(r.downstream_tasks(df, "a").select("task_id"))


def test_rules_for_all_do_not_gather_findings(spark, rows, capsys):
    """One pipeline with most findings: each is there once, and the list for all stands under every slice."""
    tasks = spark.createDataFrame(
        [(f"t{i}", f"r{i}", "hot" if i % 10 else f"p{i}", "x", "failed", T0, None) for i in range(200)],
        "task_run_id string, run_id string, pipeline_id string, task_id string, status string, created_at timestamp_ntz, output_row_count bigint")
    runs = spark.createDataFrame([], "run_id string, pipeline_id string, status string, start_time timestamp_ntz, duration_seconds double, total_rows_processed bigint")
    pipelines = spark.createDataFrame([("hot", 5)], "pipeline_id string, sla_minutes int")
    rules = spark.createDataFrame([("all", None, "task_failed", 1.0, "e", True), ("own", "hot", "task_failed", 1.0, "w", True), ("off", None, "task_failed", 1.0, "e", False),
                                   ("drop", None, "row_count_drop", 1.0, "e", True)],
                                  "rule_name string, pipeline_id string, rule_condition string, drop_pct double, severity string, is_active boolean")
    got = r.alert_rules_eval(rules, tasks, runs, pipelines)
    assert [tuple(x) for x in got.groupBy("rule_name").count().orderBy("rule_name").collect()] == [("all", 200), ("own", 180)]
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got.explain("formatted")
        text = capsys.readouterr().out
        met = r.alert_rules_eval(rules, tasks, runs, pipelines)
        assert met.count() == 380
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "'*'" not in text and slices > 1
    assert text.split("\n(1)")[0].count("SortMergeJoin LeftOuter") == 2  # the rules of the pipeline, and those for all


def test_daily_metrics_read_runs_twice(spark):
    from tablewright.plans import registry

    t = registry.Tables(spark, "/root/testdata/sf0.001")
    plan = r.daily_metrics(t.pipeline_runs, t.pipelines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_id") and plan.count("Relation") <= 4  # runs and pipelines, each for the counts and for the percentile


def test_config_position(spark, rows):
    configs = spark.createDataFrame(
        [("p", "1", True, 1, '{"tasks":[{"task_id":"x"}]}'), ("p", "2", True, 2, '{"tasks":[{"task_id":"b"},{"task_id":"a"},{"task_id":"b"}]}'),
         ("p", "3", False, 3, '{"tasks":[]}')], "pipeline_id string, version string, is_active boolean, created_at int, config string")
    tasks = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "z"), ("q", "a")], "pipeline_id string, task_id string")
    assert rows(r.with_config_position(tasks, configs).select("pipeline_id", "task_id", "config_position")) == [
        ("p", "a", 1), ("p", "b", 2), ("p", "z", 3), ("q", "a", 0)]


def test_failure_alert_text(spark):
    tasks = spark.createDataFrame([("failed", "p", "r", "t", "t1", "e" * 900)],
                                  "status string, pipeline_id string, run_id string, task_id string, task_run_id string, error_message string")
    row = r.failure_alerts(tasks).first()
    assert row["message"] == "Pipeline `p` task `t` failed: " + "e" * 500
    assert (row["title"], row["alert_type"], row["severity"]) == ("Task Failed: t", "TASK_FAILURE", "error")


def test_search_matches_any_case(spark, rows):
    df = spark.createDataFrame([("abc_sales", "Daily", "active", "file"), ("x", "ABC stock", "paused", "file")],
                               "pipeline_id string, name string, status string, source_type string")
    assert r.search_pipelines(df, search="AbC").count() == 2
    assert rows(r.search_pipelines(df, status="paused", search="abc").select("pipeline_id")) == [("x",)]


def test_repeated_updates_give_one_row_per_key(spark, rows):
    runs = spark.createDataFrame([("a", "p", "running", None)], "run_id string, pipeline_id string, status string, end_time timestamp_ntz")
    failed = spark.createDataFrame(
        [("t1", "x"), ("t1", "y"), ("t2", "z"), ("t2", "z"), (None, "n")], "task_run_id string, error_message string"
    ).withColumn("end_time", F.lit("2026-01-01").cast("timestamp_ntz"))
    tasks = spark.createDataFrame([("t1", "running")], "task_run_id string, status string").selectExpr(
        "*", "cast(null as timestamp_ntz) as end_time", "cast(null as string) as error_message")
    found = r.mark_failed_once(tasks, failed).select("task_run_id", "status", "error_message", "newly_failed")
    assert rows(found) == [("t1", "failed", "x", True), ("t2", "failed", "z", True)]
    seen = spark.createDataFrame(
        [("a", "p", "success", "manual"), ("a", "p", "failed", "manual"), ("b", "p", "odd", "x"), ("b", "p", "odd", "x")],
        "run_id string, pipeline_id string, state string, run_type string",
    ).selectExpr("*", "cast(null as timestamp_ntz) as start_time", "cast(null as timestamp_ntz) as end_time")
    taken = r.run_backfill(runs.selectExpr("*", "'manual' as trigger_type", "end_time as start_time"), seen)
    assert rows(taken.select("run_id", "status")) == [("a", "failed"), ("b", "success")]


def test_activation_of_several_versions(spark, rows):
    stored = spark.createDataFrame([("p", "1", "{}", True, True)], "pipeline_id string, version string, config string, is_active boolean, is_valid boolean")
    asked = spark.createDataFrame([("p", "2", "{}"), ("p", "3", "{}"), ("p", "3", "{}")], "pipeline_id string, version string, config string")
    got = r.config_activate(stored, asked).select("version", "is_active")
    assert rows(got) == [("1", False), ("2", False), ("3", True)]


def test_events_without_pipeline_stay_one_attempt(spark, rows):
    events = spark.createDataFrame(
        [("a", "r", "p", "t", 1, "RUNNING"), ("a", "r", None, None, 2, "SUCCESS")],
        "task_run_id string, run_id string, pipeline_id string, task_id string, seq int, status string",
    ).selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in {
        "start_time": "timestamp_ntz", "end_time": "timestamp_ntz", "output_row_count": "bigint", "output_path": "string",
        "error_message": "string"}.items()])
    assert rows(r.task_run_upsert(events).select("task_run_id", "pipeline_id", "task_id", "status")) == [("a", "p", "t", "success")]
    assert rows(r.run_counters(events, declared(spark, p=1)).select("run_id", "pipeline_id", "completed_tasks")) == [("r", "p", 1)]


def test_placeholders_are_escaped_for_json(spark):
    df = spark.createDataFrame([('{"a": "${k}"}',)], "c string")
    assert df.select(r.resolve_placeholders(F.col("c"), {"k": 'x"\\y'})).first()[0] == '{"a": "x\\"\\\\y"}'


def below_exchange(df):
    """The part of a plan under its first shuffle."""
    return df._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning")[2]


def test_task_events_are_dealt_before_they_are_sorted(spark):
    """A sort below the shuffle holds a whole partition of the scan."""
    under = below_exchange(r.task_run_upsert(spark.createDataFrame([], EVENT)))
    assert under and "Sort" not in under


def test_downstream_of_short_configs_needs_no_rounds(spark, rows, monkeypatch):
    few = edges_of(spark, [("c", ["b"]), ("b", ["a", None]), ("d", []), ("a", ["c"])], [("z", ["a"])] * 3)
    odd = spark.createDataFrame([(None, "1", '{"tasks":[{"task_id":"b","depends_on":["a"]}]}')] * 2 + [("n", "1", None)], few.schema)
    expected = [("0", "a"), ("0", "b"), ("0", "c"), ("1", "a"), ("1", "z"), ("n", "a"), (None, "a")]
    monkeypatch.setattr(r, "_fixpoint", None)
    assert rows(r.downstream_tasks(few.unionByName(odd), "a").select("pipeline_id", "task_id")) == expected


def test_downstream_of_configs_with_equal_keys_is_one_graph(spark, rows):
    one, other = ([{"task_id": c, "depends_on": [p]}] for c, p in (("b", "a"), ("c", "b")))
    df = spark.createDataFrame([("p", "1", json.dumps({"tasks": t})) for t in (one, other, one)], "pipeline_id string, version string, config string")
    assert rows(r.downstream_tasks(df, "a").select("task_id")) == [("a",), ("b",), ("c",)]
