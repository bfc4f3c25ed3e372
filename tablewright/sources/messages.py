"""Message batches: JSON texts in, typed rows out, and how far each consumer has read."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path
from tablewright.sinks.store import TableStore

EMPTY = "message string"
_BAD = "_unparsed"


def kafka_options(servers: str, topic: str, auto_offset_reset: str = "earliest", starts: Mapping[int, int] | None = None) -> dict[str, str]:
    """Reader options of a bounded topic read; it ends at the newest offset when the read starts.

    ``starts`` has the first offset of every partition of the topic; without it the read starts where ``auto_offset_reset`` says.
    """
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": json.dumps({topic: {str(p): o for p, o in sorted(starts.items())}}) if starts else auto_offset_reset,
        "endingOffsets": "latest",
    }


def read_topic(
    spark: SparkSession, servers: str, topic: str, auto_offset_reset: str = "earliest", starts: Mapping[int, int] | None = None
) -> DataFrame:
    """Message values of a topic as text; needs the Kafka connector on the class path."""
    options = kafka_options(servers, topic, auto_offset_reset, starts)
    raw = spark.read.format("kafka").options(**options).load()
    return raw.select(F.col("value").cast("string").alias("value"), "partition", "offset", "timestamp")


class Offsets:
    """How far each consumer group has read each partition of a topic, as a table of the store.

    A row is the range of offsets that one task of one run took from a partition. The
    next run starts behind the furthest range; a run that is repeated takes its own
    ranges again. Ranges are written after the output they stand for, so a run that
    fails before is no gap: the next one reads the same messages.
    """

    SCHEMA = "consumer string, topic string, partition int, run_id string, task_id string, start_offset bigint, end_offset bigint"

    def __init__(self, store: TableStore, table: str = "topic_offsets"):
        self.store, self.table = store, table

    def _ranges(self, consumer: str, topic: str) -> DataFrame:
        if not self.store.exists(self.table):
            return self.store.spark.createDataFrame([], self.SCHEMA)
        return self.store.read(self.table).where((F.col("consumer") == consumer) & (F.col("topic") == topic))

    def starts(self, consumer: str, topic: str) -> dict[int, int]:
        """The next offset of every partition read before; one row per partition of the topic."""
        found = self._ranges(consumer, topic).groupBy("partition").agg(F.max("end_offset"))
        return {r[0]: r[1] for r in found.collect()}

    def of_run(self, consumer: str, topic: str, run_id: str, task_id: str) -> dict[int, tuple[int, int]]:
        """The ranges a run has taken; empty if it has not."""
        own = self._ranges(consumer, topic).where((F.col("run_id") == run_id) & (F.col("task_id") == task_id))
        return {r["partition"]: (r["start_offset"], r["end_offset"]) for r in own.collect()}

    def commit(self, consumer: str, topic: str, run_id: str, task_id: str, ranges: Mapping[int, tuple[int, int]]) -> None:
        rows = [(consumer, topic, p, run_id, task_id, a, z) for p, (a, z) in sorted(ranges.items())]
        if rows:
            self.store.append(self.table, self.store.spark.createDataFrame(rows, self.SCHEMA).coalesce(1), run_id, task_id)


def _within(spark: SparkSession, df: DataFrame, ranges: Mapping[int, tuple[int, int | None]]) -> DataFrame:
    """Messages inside the range of their partition; a partition without one is read whole."""
    if not ranges:
        return df
    known = spark.createDataFrame([(p, a, z) for p, (a, z) in ranges.items()], "partition int, _start bigint, _end bigint")
    own = df.join(F.broadcast(known), "partition", "left")  # a row per partition of the topic
    first = F.col("_start").isNull() | (F.col("offset") >= F.col("_start"))
    return own.where(first & (F.col("_end").isNull() | (F.col("offset") < F.col("_end")))).drop("_start", "_end")


def next_batch(
    messages: DataFrame, offsets: Offsets, consumer: str, topic: str, run_id: str, task_id: str,
    max_messages: int | None = None, auto_offset_reset: str = "earliest",
) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The messages (value, partition, offset) that a run takes, written once, and their ranges for ``commit``.

    ``max_messages`` takes the same number from every partition as far as there are
    so many, always the oldest. ``latest`` takes nothing at the first read of a
    partition and marks its end. A repeated run takes what it took before.
    """
    spark = messages.sparkSession
    taken = offsets.of_run(consumer, topic, run_id, task_id)
    if taken:
        return _within(spark, messages, taken).join(
            F.broadcast(spark.createDataFrame([(p,) for p in taken], "partition int")), "partition", "left_semi"
        ), taken
    starts = offsets.starts(consumer, topic)
    if auto_offset_reset == "latest":
        ends = messages.groupBy("partition").agg((F.max("offset") + 1).alias("end")).collect()
        starts = {**{r["partition"]: r["end"] for r in ends}, **starts}
    elif auto_offset_reset != "earliest":
        raise ValueError(f"unknown auto_offset_reset: {auto_offset_reset!r}")
    rest = _within(spark, messages, {p: (a, None) for p, a in starts.items()})
    if max_messages is not None:
        first = rest.groupBy("partition").agg(F.min("offset").alias("_first"))
        rest = rest.join(F.broadcast(first), "partition").orderBy(F.col("offset") - F.col("_first"), "partition").limit(max_messages).drop("_first")
    path = scratch_path(spark, "messages")
    rest.write.parquet(path)
    batch = spark.read.schema(rest.schema).parquet(path)
    found = batch.groupBy("partition").agg(F.min("offset").alias("a"), (F.max("offset") + 1).alias("z")).collect()
    ranges = {p: (a, a) for p, a in starts.items()}
    ranges |= {r["partition"]: (starts.get(r["partition"], r["a"]), r["z"]) for r in found}
    return batch, ranges


def infer_schema(df: DataFrame, value: str = "value") -> str | None:
    """Column types found over all messages, merged in one distributed aggregate.

    None when no message is a JSON object.
    """
    parsed = F.try_parse_json(F.col(value))
    found = df.agg(F.schema_of_variant_agg(parsed).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return None
    return re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", found))


def _struct(schema: str, *extra: str) -> str:
    """``a INT, b …`` or ``STRUCT<…>`` as one struct type, with extra fields."""
    inner = schema.strip()
    if inner.upper().startswith("STRUCT<"):
        inner = inner[len("STRUCT<"):-1]
    return f"STRUCT<{', '.join([inner, *extra])}>"


def first_messages(df: DataFrame, order: list[str], max_messages: int | None) -> DataFrame:
    """The first ``max_messages`` in arrival order; None takes all."""
    return df if max_messages is None else df.orderBy(*order).limit(max_messages)


def decode_json(df: DataFrame, schema: str | None = None, value: str = "value") -> DataFrame:
    """One column per message field. A message that is not JSON fails the read.

    With no schema it is inferred; an empty batch gives the empty ``message`` table.
    """
    schema = schema or infer_schema(df, value)
    if schema is None:
        return df.sparkSession.createDataFrame([], EMPTY)
    return df.select(F.from_json(value, _struct(schema), {"mode": "FAILFAST"}).alias("m")).select("m.*")


def decode_json_or_raw(df: DataFrame, schema: str | None = None, value: str = "value") -> DataFrame:
    """As ``decode_json``, but a message that is not JSON is kept whole in column ``raw``."""
    schema = schema or infer_schema(df, value)
    if schema is None:
        return df.select(F.col(value).alias("raw"))
    parsed = F.from_json(
        value, _struct(schema, f"{_BAD}: STRING"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    )
    return df.select(parsed.alias("m")).select("m.*").withColumnRenamed(_BAD, "raw")


def consume(
    df: DataFrame, order: list[str], schema: str | None = None, max_messages: int | None = None,
    keep_raw: bool = False, value: str = "value",
) -> DataFrame:
    """A batch decoded; ``keep_raw`` keeps texts that are not JSON.

    ``max_messages`` takes only the first in arrival order: the caller then stores
    the end it reached, or the rest is never read.
    """
    batch = first_messages(df, order, max_messages)
    return decode_json_or_raw(batch, schema, value) if keep_raw else decode_json(batch, schema, value)
