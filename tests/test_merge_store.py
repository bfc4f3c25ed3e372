import pytest

from tablewright.operators.merge import insert_if_absent, merge, upsert
from tablewright.sinks import store as stores
from tablewright.sinks import targets
from tablewright.sinks.store import TableStore, _write_new, fit_columns
from tablewright.sources import windows
from tablewright.sources.artifacts import Artifacts


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def frame(spark, data, schema="id bigint, name string, extra int"):
    return spark.createDataFrame(data, schema)


def test_merge_updates_inserts_and_keeps_unstaged_columns(spark, rows):
    target = frame(spark, [(1, "a", 10), (2, "b", 20), (None, "n", 30)])
    staged = frame(spark, [(2, "B"), (3, "C"), (None, "N")], "id bigint, name string")
    assert rows(merge(target, staged, ["id"])) == [(1, "a", 10), (2, "B", 20), (3, "C", None), (None, "N", None), (None, "n", 30)]


def test_merge_can_set_null(spark, rows):
    got = merge(frame(spark, [(1, "a", 10)]), frame(spark, [(1, None)], "id bigint, name string"), ["id"])
    assert rows(got) == [(1, None, 10)]


def test_merge_keys_only_inserts(spark, rows):
    target = frame(spark, [(1, "a"), (2, "b")], "id bigint, name string")
    staged = frame(spark, [(2, "b"), (3, "c")], "id bigint, name string")
    assert rows(merge(target, staged, ["id", "name"])) == [(1, "a"), (2, "b"), (3, "c")]


def test_merge_errors(spark):
    target = frame(spark, [(1, "a", 10)])
    with pytest.raises(ValueError, match="keys is required"):
        merge(target, target, [])
    with pytest.raises(ValueError, match="repeat key"):
        merge(target, frame(spark, [(1, "x", 1), (1, "y", 1)]), ["id"])
    # NULL keys match nothing, so they may repeat
    assert merge(target, frame(spark, [(None, "x", 1), (None, "y", 1)]), ["id"]).count() == 3


def test_insert_if_absent(spark, rows):
    got = insert_if_absent(frame(spark, [(1, "a", 1)]), frame(spark, [(1, "z", 9), (2, "b", 2)]), ["id"])
    assert rows(got) == [(1, "a", 1), (2, "b", 2)]


def test_append_same_run_counts_once(spark, store, rows):
    first, second = frame(spark, [(1, "a", 1)]), frame(spark, [(2, "b", 2)])
    store.append("t", first, "2026-05-04", "load")
    for _ in range(2):
        stats = store.append("t", second, "2026-05-05", "load")
    assert rows(store.read("t")) == [(1, "a", 1), (2, "b", 2)]
    assert (stats.rows, stats.schema["id"]) == (1, "BIGINT")


def test_appends_of_one_run_stay_apart(spark, store, rows):
    one, two = frame(spark, [(1, "a", 1)]), frame(spark, [(2, "b", 2)])
    store.append("t", one, "r1", "first")
    store.append("t", two, "r1", "second")
    store.append("t", two, "r1", "second", 1)
    assert rows(store.read("t")) == [(1, "a", 1), (2, "b", 2), (2, "b", 2)]
    with pytest.raises(ValueError, match="run id"):
        targets.load_target(one, {"type": "table", "table": "t"}, store)


def test_append_reading_its_own_table(spark, store, rows):
    store.append("t", frame(spark, [(1, "a", 1), (2, "b", 2)]), "r1", "load")
    store.append("t", store.read("t").where("id = 2"), "r1", "load")
    assert rows(store.read("t")) == [(2, "b", 2)]


def test_append_after_merge_keeps_merged_rows(spark, store, rows):
    store.append("t", frame(spark, [(1, "a", 1)]), "r1", "load")
    store.merge("t", frame(spark, [(1, "A", 1), (2, "b", 2)]), ["id"])
    store.append("t", frame(spark, [(3, "c", 3)]), "r1", "load")
    assert rows(store.read("t")) == [(1, "A", 1), (2, "b", 2), (3, "c", 3)]


def test_failed_append_leaves_the_table(spark, store, rows):
    store.append("t", frame(spark, [(1, "a", 1)]), "r1", "load")
    with pytest.raises(Exception, match="no"):
        store.append("t", frame(spark, [(1, "a", 1)]).selectExpr("id", "raise_error('no') as name", "extra"), "r1", "load")
    assert rows(store.read("t")) == [(1, "a", 1)]


def test_second_writer_fails(spark, store):
    store.overwrite("t", frame(spark, [(1, "a", 1)]))
    with pytest.raises(RuntimeError, match="another writer"):
        _write_new(spark, store._manifest("t", 0), "[]")
    assert store.read("t").count() == 1


def test_overwrite_keeps_definition_and_may_read_itself(spark, store, rows):
    store.overwrite("t", frame(spark, [(1, "a", 1), (2, "b", 2)]))
    store.overwrite("t", store.read("t").where("id = 2"))
    store.overwrite("t", store.read("t").selectExpr("cast(id as string) as ID", "name", "1 as other"))
    assert store.read("t").schema.simpleString() == "struct<id:bigint,name:string,extra:int>"
    assert rows(store.read("t")) == [(2, "b", None)]


def test_interleaved_append_keeps_both(spark, store, rows, monkeypatch):
    """Another append that publishes while this one writes is kept; this one publishes after it."""
    store.append("t", frame(spark, [(0, "z", 0)]), "r0", "load")
    other, write = TableStore(spark, store.root), store._write

    def slow(*args):
        out = write(*args)
        other.append("t", frame(spark, [(1, "a", 1)]), "r1", "load")
        monkeypatch.undo()
        return out

    monkeypatch.setattr(store, "_write", slow)
    store.append("t", frame(spark, [(2, "b", 2)]), "r2", "load")
    assert [r[0] for r in rows(store.read("t"))] == [0, 1, 2]


@pytest.mark.parametrize("write", [lambda s, df: s.overwrite("t", df), lambda s, df: s.merge("t", df, ["id"])])
def test_interleaved_write_fails_and_loses_nothing(spark, store, rows, monkeypatch, write):
    store.append("t", frame(spark, [(0, "z", 0)]), "r0", "load")
    other, publish = TableStore(spark, store.root), store._publish

    def late(*args):
        other.append("t", frame(spark, [(1, "a", 1)]), "r1", "load")
        return publish(*args)

    monkeypatch.setattr(store, "_publish", late)
    with pytest.raises(RuntimeError, match="another writer"):
        write(store, frame(spark, [(2, "b", 2)]))
    assert [r[0] for r in rows(store.read("t"))] == [0, 1]


def test_merge_reads_and_rewrites_its_buckets_only(spark, store, rows):
    store.merge("t", frame(spark, [(i, "a", i) for i in range(200)]), ["id"])
    before = store.buckets("t")
    assert len(before) == 8
    seen = []

    def combine(target, staged):
        seen.extend(target.inputFiles())
        return merge(target, staged, ["id"])

    store.rewrite("t", frame(spark, [(3, "B", 0)]), ["id"], combine)
    after = store.buckets("t")
    moved = {b for b in before if before[b] != after[b]}
    assert len(moved) == 1 and set(before) == set(after)
    assert seen and all(f"_bucket={next(iter(moved))}/" in f for f in seen)
    assert rows(store.read("t").where("name = 'B'")) == [(3, "B", 0)] and store.read("t").count() == 200


def test_merge_takes_in_appended_rows_and_other_keys(spark, store, rows):
    store.merge("t", frame(spark, [(1, "a", 1), (2, "b", 2), (None, "n", 3)]), ["id"])
    store.append("t", frame(spark, [(1, "again", 4), (9, "z", 9)]), "r1", "load")
    store.merge("t", frame(spark, [(1, "A", 1)]), ["id"])
    assert rows(store.read("t")) == [(1, "A", 1), (1, "A", 1), (2, "b", 2), (9, "z", 9), (None, "n", 3)]
    store.merge("t", frame(spark, [(7, "b", 0), (8, "new", 0)]), ["name"])
    assert rows(store.read("t")) == [(1, "A", 1), (1, "A", 1), (7, "b", 0), (8, "new", 0), (9, "z", 9), (None, "n", 3)]


def test_key_of_another_type_finds_its_bucket(spark, store, rows):
    store.merge("t", frame(spark, [(i, "a", i) for i in range(20)]), ["id"])
    store.merge("t", frame(spark, [("3", "B")], "id string, name string"), ["id"])
    assert store.read("t").count() == 20 and rows(store.read("t").where("id = 3")) == [(3, "B", 3)]


def test_grown_table_gets_more_buckets(spark, tmp_path, rows):
    store = TableStore(spark, str(tmp_path / "store"), bucket_bytes=200)
    store.merge("t", frame(spark, [(1, "a", 1)]), ["id"])
    store.merge("t", frame(spark, [(i, "a" * i, i) for i in range(2, 400)]), ["id"])
    store.merge("t", frame(spark, [(i, "b", i) for i in range(400, 420)]), ["id"])
    assert len(store.buckets("t")) > 8 and store.read("t").count() == 419


def test_emptied_buckets_and_tables(spark, store):
    store.merge("t", frame(spark, [(i, "a", i) for i in range(20)]), ["id"])
    store.rewrite("t", store.read("t").where("id < 5"), ["id"], lambda target, staged: target.join(staged, "id", "left_anti"))
    assert store.read("t").count() == 15
    store.rewrite("t", store.read("t"), ["id"], lambda target, staged: target.where("false"))
    assert store.read("t").collect() == [] and store.read("t").columns == ["id", "name", "extra"]
    store.merge("t", frame(spark, [(1, "a", 1)]), ["id"])
    assert store.read("t").count() == 1


def test_compacted_batches_are_closed(spark, store, rows):
    for batch in range(4):
        store.append("t", frame(spark, [(batch, "a", 1)]), "s", "task", batch)
    store.append("t", frame(spark, [(9, "other", 1)]), "s2", "task", 0)
    assert store.compact("t", "s", "task", 2) == 3 and store.compact("t", "s", "task", 2) == 0
    assert [r[0] for r in rows(store.read("t"))] == [0, 1, 2, 3, 9]
    store.append("t", frame(spark, [(33, "a", 1)]), "s", "task", 3)
    with pytest.raises(ValueError, match="closed"):
        store.append("t", frame(spark, [(1, "a", 1)]), "s", "task", 1)
    assert store.compact("t", "s", "task", 3) == 2
    assert [r[0] for r in rows(store.read("t"))] == [0, 1, 2, 33, 9]


def test_store_merge(spark, store, rows):
    store.merge("t", frame(spark, [(1, "a", 1)]), ["id"])
    store.merge("t", frame(spark, [(1, "A", 2), (5, "e", 5)]), ["id"])
    assert rows(store.read("t")) == [(1, "A", 2), (5, "e", 5)]
    assert store.vacuum("t") == 0  # too young
    store.merge("t", frame(spark, [(1, "A", 2), (5, "e", 5)]), ["id"])
    assert store.vacuum("t", older_than=0) == 2
    assert rows(store.read("t")) == [(1, "A", 2), (5, "e", 5)]
    with pytest.raises(ValueError, match="repeat key"):
        store.merge("t", frame(spark, [(7, "x", 1), (7, "y", 1)]), ["id"])
    assert store.read("t").count() == 2
    with pytest.raises(ValueError, match="keys is required"):
        store.merge("t", frame(spark, [(1, "a", 1)]), [])
    with pytest.raises(ValueError, match="no table"):
        store.read("missing")


def test_fit_columns(spark):
    target = frame(spark, [], "Id int, Name string, made bigint, note string")
    got = fit_columns(frame(spark, [(1, "a", 3)]), target, generated=["made"])
    assert got.schema.simpleString() == "struct<Id:int,Name:string,note:string>"
    assert tuple(got.first()) == (1, "a", None)


@pytest.mark.parametrize(("mode", "expected"), [("append", 4), ("overwrite", 2), ("replace", 2), ("merge", 2), ("upsert", 2)])
def test_load_target_modes(spark, store, mode, expected):
    df = frame(spark, [(1, "Alice", 0), (2, "Bob", 0)])
    target = {"type": "table", "table": "Out", "mode": mode, "keys": ["id"]}
    targets.load_target(df, target, store, run_id="a")
    report = targets.load_target(df, target, store, run_id="b")
    assert store.read("Out").count() == expected
    assert str(report) == "Loaded 2 rows to table:Out"


def test_unknown_mode(spark, store):
    with pytest.raises(ValueError, match="unknown write mode"):
        targets.load_target(frame(spark, [(1, "a", 1)]), {"type": "table", "mode": "shred"}, store)


def test_audit_column_is_left_out(spark, store):
    df = frame(spark, [(1, "a", 1)]).selectExpr("*", "current_timestamp() as etl_loaded_at")
    targets.load_target(df, {"type": "table", "table": "Out"}, store, run_id="r1")
    assert "etl_loaded_at" not in store.read("Out").columns


def test_files_and_default_path(spark, store, tmp_path):
    df = frame(spark, [(1, "a|b", 1)])
    report = targets.load_target(df, {"type": "s3"}, store, "sales")
    assert report.where.endswith("output/sales/output.parquet")
    assert spark.read.parquet(report.where).count() == 1
    targets.load_target(df, {"type": "unheard", "path": str(tmp_path / "p")}, store)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    targets.load_target(df, {"type": "csv", "path": str(tmp_path / "c")}, store)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["name"] == "a|b"


def test_messages_keep_null_fields(spark):
    value = targets.to_messages(frame(spark, [(1, None, 2)])).first()["value"]
    assert value == '{"id":1,"name":null,"extra":2}'


def test_merge_statements():
    ms = targets.merge_statement("mssql", "dbo", "T", "S", ["k", "v"], ["k"])
    assert ms == ("MERGE INTO [dbo].[T] AS t USING [dbo].[S] AS s ON (t.[k] = s.[k]) WHEN MATCHED THEN UPDATE SET t.[v] = s.[v] "
                  "WHEN NOT MATCHED THEN INSERT ([k], [v]) VALUES (s.[k], s.[v]);")
    ora = targets.merge_statement("oracle", "app", "T", "S", ["k"], ["k"])
    assert ora == 'MERGE INTO app.T t USING app.S s ON (t.k = s."k") WHEN NOT MATCHED THEN INSERT (k) VALUES (s."k")'
    pg = targets.merge_statement("postgresql", "public", "T", "S", ["k", "v"], ["k"])
    assert pg == ('INSERT INTO "public"."T" ("k", "v") SELECT "k", "v" FROM "public"."S" '
                  'ON CONFLICT ("k") DO UPDATE SET "v" = EXCLUDED."v"')
    assert targets.merge_statement("postgresql", "public", "T", "S", ["k"], ["k"]).endswith('("k") DO NOTHING')
    with pytest.raises(ValueError, match="not supported"):
        targets.merge_statement("mysql", "", "T", "S", ["k"], ["k"])
    with pytest.raises(ValueError, match="keys is required"):
        targets.merge_statement("mssql", "dbo", "T", "S", ["k"], [])


class Database:
    """Stands for a frame whose writer keeps what it is asked for."""

    def __init__(self, columns):
        self.columns, self.tables, self.write, self.sparkSession = columns, [], self, None

    def drop(self, *names):
        return self

    def format(self, _):
        return self

    def options(self, **_):
        return self

    def option(self, key, value):
        if key == "dbtable":
            self.tables.append(value)
        return self

    def mode(self, _):
        return self

    def save(self):
        return None


@pytest.mark.parametrize("kind", ["mssql", "postgresql", "oracle"])
def test_stage_is_written_and_merged_under_one_name(monkeypatch, kind):
    ran = []
    monkeypatch.setattr(targets, "drop_audit_column", lambda df: df)
    monkeypatch.setattr(targets, "run_statement", lambda spark, options, text: ran.append(text))
    df = Database(["Id", "v"])
    targets.write_database(df, {"type": kind, "host": "h", "schema": "app", "table": "Out", "mode": "merge", "keys": ["Id"]})
    (stage,) = df.tables
    assert f" {stage} " in ran[0] + " " and ran[1] == f"DROP TABLE {stage}"


def test_cdc_apply_to_a_table(spark, store, rows):
    """Changes in two batches, deletes included, rewrite their buckets only and equal one application to the frame."""
    base = spark.createDataFrame([(i, f"n{i}", i) for i in range(100)], "id bigint, name string, extra int")
    schema = "id bigint, operation int, at int, name string"
    first = spark.createDataFrame([(1, 4, 1, "x"), (2, 1, 2, None), (200, 2, 3, "new"), (1, 3, 4, "before")], schema)
    second = spark.createDataFrame([(1, 1, 5, None), (200, 4, 6, "newer"), (300, 1, 7, None)], schema)
    store.merge("t", base, ["id"])
    before = store.buckets("t")
    for changes in (first, second):
        windows.cdc_apply_to(store, "t", changes, ["id"], ["at"])
    after = store.buckets("t")
    assert 0 < sum(before[b] != after.get(b) for b in before) < len(before)
    assert rows(store.read("t")) == rows(windows.cdc_apply(base, first.unionByName(second), ["id"], ["at"]))
    assert store.read("t").count() == 99


def test_changes_that_compress_well_are_not_broadcast(spark, store, rows, monkeypatch):
    """Their files are far below Spark's threshold, what they take in memory is not."""
    plans = []

    def seen(*args, **options):
        out = upsert(*args, **options)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(windows, "upsert", seen)
    store.merge("t", spark.range(0, 300_000, 2).selectExpr("id", "0L AS v", "'x' AS note"), ["id"])
    many = spark.range(400_000).selectExpr("id", "1 AS lsn", "IF(id % 4 = 0, 1, 4) AS operation", "7L AS v")
    windows.cdc_apply_to(store, "t", many, ["id"], ["lsn"])
    windows.cdc_apply_to(store, "t", many.where("id < 10"), ["id"], ["lsn"])
    assert "Broadcast" not in plans[0] and "Broadcast" in plans[1]
    got = store.read("t").groupBy("v", "note").count()
    assert rows(got) == [(7, "x", 75_000), (7, None, 225_000)]


@pytest.mark.parametrize("limit", [0, 10**9])
def test_dealt_and_broadcast_merges_agree(spark, store, rows, monkeypatch, limit):
    """NULL keys, deletes and a key that many stored rows share come out the same."""
    monkeypatch.setattr(stores, "BROADCAST_BYTES", limit)
    store.merge("t", frame(spark, [(1, "a", 1), (2, "b", 2), (None, "n", 3)]), ["id"])
    store.append("t", frame(spark, [(1, "again", 4), (None, "m", 9)]), "r1", "load")
    store.merge("t", frame(spark, [(1, "A", None), (None, "N", 5), (7, "g", 7)]), ["id"])
    changes = spark.createDataFrame([(2, 1, 1, None), (7, 4, 2, "G"), (None, 2, 3, "c"), (8, 1, 4, "d")], "id bigint, operation int, at int, name string")
    windows.cdc_apply_to(store, "t", changes, ["id"], ["at"])
    assert rows(store.read("t")) == [
        (1, "A", None), (1, "A", None), (7, "G", 7), (None, "N", 5), (None, "c", None), (None, "m", 9), (None, "n", 3)]


def test_memory_of_rows(spark):
    df = spark.createDataFrame([(1, "four", b"ab", [10, 20]), (2, None, None, None)], "id int, s string, b binary, l array<int>")
    assert [r[0] for r in df.select(stores._memory(df.schema)).collect()] == [32 + 4 + 2 + len("[10, 20]"), 32]


def test_artifacts(spark, tmp_path):
    store = Artifacts(spark, str(tmp_path / "a"))
    stats = store.write(frame(spark, [(1, "a", 1), (2, "b", 2)]), "p", "r", "my-task", "tbl")
    assert (stats.rows, stats.schema) == (2, {"id": "BIGINT", "name": "VARCHAR", "extra": "INTEGER"})
    assert stats.size_bytes > 0
    assert store.scan("p", "r", "my-task", "tbl").count() == 2
    with pytest.raises(ValueError, match="no output"):
        store.scan("p", "r", "other", "tbl")


def test_published_view(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS my_task LOCATION '{tmp_path}/db'")
    store = Artifacts(spark, str(tmp_path / "a"))
    store.write(frame(spark, [(1, "a", 1)]), "p", "r", "my-task", "tbl")
    assert store.publish("p", "r", "my-task", "tbl") == "my_task.tbl"
    assert spark.sql("SELECT name FROM my_task.tbl").first()["name"] == "a"
    spark.sql("DROP DATABASE my_task CASCADE")
