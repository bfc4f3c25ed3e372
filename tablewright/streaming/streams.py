"""Message and event streams, each run over everything available and then stopped.

Every sink is safe to repeat: file sinks commit with the stream's checkpoint, and
``foreachBatch`` sinks write under the batch id, so a batch replayed after a lost
executor replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.quality import RESULT_SCHEMA, run_suite
from tablewright.operators.runlog import event_marks, marked_state, merge_marks
from tablewright.sinks.store import TableStore
from tablewright.sources.messages import decode_json_or_raw

COMPACT_EVERY = 100  # batches whose results become one part


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def topic_stream(spark: SparkSession, servers: str, topic: str, max_messages: int = 10_000) -> DataFrame:
    """Message values of a topic; the checkpoint keeps the offsets between runs."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_messages).load()
    )
    return raw.select(F.col("value").cast("string").alias("value"), "timestamp")


def _finish(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _each_batch(stream: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    _finish(stream.writeStream.outputMode(mode).foreachBatch(fn), checkpoint)


def consume(stream: DataFrame, schema: str, out: str, checkpoint: str, value: str = "value") -> None:
    """Decode JSON messages to Parquet; texts that are not JSON are kept whole in ``raw``."""
    rows = decode_json_or_raw(stream, schema, value)
    _finish(rows.writeStream.format("parquet").option("path", out), checkpoint)


def throughput(stream: DataFrame, store: TableStore, table: str, checkpoint: str, late: str = "2 hours") -> None:
    """Runs, successes and rows per hour of start time.

    Changed hours are merged into the table as they change, so late rows inside the
    watermark correct earlier results and the open hours are there as well. A merge
    rewrites the buckets of these hours only. State is one row per hour inside the
    watermark.
    """
    hourly = (
        stream.withWatermark("start_time", late).groupBy(F.window("start_time", "1 hour").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("run_count"), F.count_if(F.col("status") == "success").alias("success"),
            F.coalesce(F.sum("total_rows_processed"), F.lit(0)).alias("rows_processed"),
        )
        .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "run_count", "success", "rows_processed")
    )
    _each_batch(
        hourly, checkpoint, lambda batch, no: store.merge(table, batch, ["hour"]) and None, "update"
    )


def quality(
    stream: DataFrame, checks: Sequence[Mapping], store: TableStore, table: str, checkpoint: str, stream_id: str,
    as_of: Column | None = None,
) -> None:
    """Check every micro-batch; results are appended under ``stream_id`` and the batch id.

    Streams that write to one table need different ids.
    """

    def check(batch: DataFrame, no: int) -> None:
        found = run_suite(batch, checks, as_of=as_of, fail_pipeline_on_error=False).results
        rows = [tuple(r[f.name] for f in RESULT_SCHEMA) for r in found]
        results = batch.sparkSession.createDataFrame(rows, RESULT_SCHEMA).withColumn("batch_id", F.lit(no).cast("bigint"))
        store.append(table, results, stream_id, "quality", no)
        if no % COMPACT_EVERY == COMPACT_EVERY - 1:
            store.compact(table, stream_id, "quality", no - 1)

    _each_batch(stream, checkpoint, check)


def task_upsert(stream: DataFrame, store: TableStore, table: str, checkpoint: str, order: Sequence[str] = ("seq",)) -> None:
    """Fold task events into a table with one row per attempt.

    A micro-batch rewrites only the hash buckets of its own attempts, whatever the
    length of the log; its events and the rows there are folded in one shuffle. The row keeps the order of the events that wrote
    its values, so a replayed batch changes nothing and a late event fills only what
    no later one has written.
    """

    def fold(batch: DataFrame, no: int) -> None:
        store.fold(table, event_marks(batch, order), ["task_run_id"], merge_marks)

    _each_batch(stream, checkpoint, fold)


def task_state(store: TableStore, table: str) -> DataFrame:
    """Latest state of every attempt, read as it is."""
    return marked_state(store.read(table))
