"""Parquet tables on shared storage with append, overwrite and merge.

A table is a set of Parquet parts and a log of manifests. A manifest lists the
parts of one version and what each stands for; the highest number is the one
readers use. A write adds a part in a new folder and then publishes the manifest
that follows the one it read, so it never touches what is being read, may read its
own table, and leaves the table as it was when it fails.

An append names its unit of re-run: run, task and batch. The same unit again
replaces its own part. Overwrite and merge leave parts without a unit, which no
append can replace.

A table that is merged by key lies in hash buckets of that key, one folder each. A
merge reads and rewrites the buckets that its staged rows fall into and leaves the
others where they are; the manifest says which folder holds each bucket.

Two writers of one version: the second publish fails, and nothing is lost. An
append then publishes again on top of the newer version; overwrite and merge raise,
as their result rests on what they have read. Publishing is a rename onto a new
name, so the store needs a file system where that is atomic, as Spark's own
streaming checkpoints do.
"""

from __future__ import annotations

import json
import uuid
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType, StructType, VariantType

from tablewright.functions.types import schema_names
from tablewright.operators.merge import merge, require_unique_keys

BUCKET = "_bucket"
BUCKET_BYTES = 128 * 2**20  # what a bucket is meant to hold; past four times that the table is dealt out anew
BUCKETS = 8, 8192  # fewest and most of a table
COMPRESSION = "zstd"  # of stages and buckets, which are written again and again
BROADCAST_BYTES = 10 * 2**20  # of staged rows outside their files; past it a merge never broadcasts them
SLICE_BYTES = 16 * 2**20  # of stored and staged rows that one task of a fold or a merge takes
SLICE_ROWS = 500_000  # rows of both sides that one task of a merge takes
RETRIES = 20  # times an append publishes again after another writer
DAY = 86_400


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


@dataclass
class WriteStats:
    """What a finished write reports: rows are counted while writing, not by a second scan."""

    path: str
    rows: int
    schema: dict[str, str]
    size_bytes: int


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _path(spark, path)
    return fs.exists(hadoop)


def size_of(spark: SparkSession, path: str) -> int:
    fs, hadoop = _path(spark, path)
    return fs.getContentSummary(hadoop).getLength()


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(_opened(spark, path), "UTF-8")


def _opened(spark: SparkSession, path: str):
    fs, hadoop = _path(spark, path)
    return fs.open(hadoop)


def _write_new(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all: written beside its place, then renamed to a name nobody has."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, draft = _path(spark, f"{path}.{uuid.uuid4().hex[:12]}.tmp")
    final = _path(spark, path)[1]
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:  # this rename never replaces a file
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(final):
            raise Conflict(f"another writer published {path}") from error
        raise


def write_counted(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> WriteStats:
    """Write Parquet and report rows, schema and bytes of the folder."""
    seen = Observation()
    partition_by = options.pop("partition_by", None)
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    spark = df.sparkSession
    return WriteStats(path, seen.get["rows"], schema_names(df), size_of(spark, path))


def _memory(schema: StructType) -> Column:
    """Bytes of a row outside a file, about: eight for each column, and the length of what is no number or instant as text."""
    def length(column: str) -> Column:
        return F.coalesce(F.octet_length(F.col(f"`{column}`").cast("string")), F.lit(0))

    free = [f.name for f in schema.fields if not isinstance(f.dataType, AtomicType) or isinstance(f.dataType, StringType | BinaryType | VariantType)]
    return reduce(lambda a, b: a + b, map(length, free), F.lit(8 * len(schema.fields)).cast("bigint"))


def _remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _path(spark, path)
    fs.delete(hadoop, True)


@dataclass
class Version:
    """What a manifest says: parts as ``{"folder", "unit", "schema", "bytes"}``; a part in buckets also has the
    ``buckets`` that are current in it, and ``of``, how many it was written with. ``layout`` is [keys, number of buckets]."""

    number: int
    parts: list[dict]
    layout: list | None = None
    closed: dict[str, int] | None = None

    def text(self) -> str:
        return json.dumps({"parts": self.parts, "layout": self.layout, "closed": self.closed or {}})

    def schema(self) -> StructType:
        return StructType.fromJson(self.parts[-1]["schema"])


class TableStore:
    def __init__(self, spark: SparkSession, root: str, bucket_bytes: int = BUCKET_BYTES):
        self.spark = spark
        self.root = root.rstrip("/")
        self.bucket_bytes = bucket_bytes

    def _folder(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _versions(self, table: str) -> list[int]:
        fs, folder = _path(self.spark, f"{self._folder(table)}/_log")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _current(self, table: str) -> Version:
        """The version readers use; without a table one before the first."""
        versions = self._versions(table)
        if not versions:
            return Version(-1, [])
        return Version(versions[-1], **json.loads(_read_text(self.spark, self._manifest(table, versions[-1]))))

    def _manifest(self, table: str, version: int) -> str:
        return f"{self._folder(table)}/_log/{version:012d}.json"

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def _paths(self, table: str, parts: Sequence[dict], only: Sequence[int] | None = None) -> list[str]:
        out = []
        for p in parts:
            folder = f"{self._folder(table)}/{p['folder']}"
            if "buckets" not in p:
                out.append(folder)
            else:
                out += [f"{folder}/{BUCKET}={b}" for b in p["buckets"] if only is None or b in only]
        return out

    def _rows(self, paths: Sequence[str], schema: StructType) -> DataFrame:
        """Without paths no rows, in a form that lets Spark leave out the joins with them."""
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema).limit(0)

    def _frame(self, table: str, now: Version) -> DataFrame:
        if not now.parts:
            raise ValueError(f"no table {table} in {self.root}")
        return self._rows(self._paths(table, now.parts), now.schema())

    def read(self, table: str) -> DataFrame:
        return self._frame(table, self._current(table))

    def buckets(self, table: str) -> dict[int, str]:
        """The folder that holds each bucket of a table merged by key; an empty bucket has none."""
        return {b: p["folder"] for p in self._current(table).parts for b in p.get("buckets", [])}

    def _publish(self, table: str, before: Version, parts: Sequence[dict], layout: list | None, closed: dict | None = None) -> None:
        """The version after ``before``; fails if somebody else has published it."""
        after = Version(before.number + 1, list(parts), layout, before.closed if closed is None else closed)
        _write_new(self.spark, self._manifest(table, after.number), after.text())

    def _write(self, table: str, df: DataFrame, unit: list[str] | None = None) -> tuple[WriteStats, dict]:
        folder = f"part-{uuid.uuid4().hex[:12]}"
        stats = write_counted(df, f"{self._folder(table)}/{folder}", "errorifexists")
        return stats, {"folder": folder, "unit": unit, "schema": df.schema.jsonValue(), "bytes": stats.size_bytes}

    def overwrite(self, table: str, df: DataFrame) -> WriteStats:
        """Replace all rows; an existing table keeps its column definitions."""
        now = self._current(table)
        if now.parts:
            df = fit_columns(df, self._frame(table, now))
        stats, part = self._write(table, df)
        self._publish(table, now, [part], None, {})
        return stats

    def append(self, table: str, df: DataFrame, run_id: str, task_id: str, batch: int = 0) -> WriteStats:
        """Add the rows of one unit (run, task, batch); the same unit again replaces its own rows.

        Rows that an overwrite or a merge has taken in since are no unit's any more and
        stay. A unit that ``compact`` has closed cannot be written again.
        """
        if not run_id:
            raise ValueError(f"an append needs a run id (task {task_id} loading into {table})")
        unit, now = [run_id, task_id, str(batch)], self._current(table)
        if batch <= (now.closed or {}).get(f"{run_id}/{task_id}", -1):
            raise ValueError(f"unit {unit} of {table} is closed")
        if now.parts:
            df = fit_columns(df, self._frame(table, now))
        stats, part = self._write(table, df, unit)
        for attempt in range(RETRIES + 1):
            try:
                self._publish(table, now, [*(p for p in now.parts if p["unit"] != unit), part], now.layout)
                return stats
            except Conflict:
                schema, now = now.parts and now.schema(), self._current(table)
                if attempt == RETRIES or (schema or StructType.fromJson(part["schema"])).simpleString() != now.schema().simpleString():
                    raise
        raise AssertionError

    def compact(self, table: str, run_id: str, task_id: str, up_to: int) -> int:
        """One part for the batches of a run and task up to ``up_to``, which are closed by it; returns the parts taken in.

        A stream calls it now and then, so that neither the manifest nor a read grows
        with the number of its batches.
        """
        now, name = self._current(table), f"{run_id}/{task_id}"

        def old(p: dict) -> bool:
            return p["unit"] == ["closed", name] or bool(p["unit"]) and p["unit"][:2] == [run_id, task_id] and int(p["unit"][2]) <= up_to

        taken = [p for p in now.parts if old(p)]
        if len(taken) < 2:
            return 0
        _, part = self._write(table, self._rows(self._paths(table, taken), now.schema()), ["closed", name])
        closed = {**(now.closed or {}), name: max(up_to, (now.closed or {}).get(name, -1))}
        self._publish(table, now, [part, *(p for p in now.parts if not old(p))], now.layout, closed)
        return len(taken)

    def merge(self, table: str, df: DataFrame, keys: Sequence[str]) -> WriteStats:
        """Update matched rows and add the rest; only the buckets of the staged keys are read and rewritten."""
        if not keys:
            raise ValueError(f"target.keys is required when mode='merge' (task loading into {table})")

        def combine(target: DataFrame, staged: DataFrame) -> DataFrame:
            return merge(target, staged, keys, check=False)

        return self.rewrite(table, df, keys, combine, unique=True)

    def fold(self, table: str, df: DataFrame, keys: Sequence[str], combine: Callable[[DataFrame, DataFrame, int], DataFrame]) -> WriteStats:
        """``rewrite`` by a ``combine`` that shuffles its rows by the keys, once, into as many partitions as its third argument says.

        The number is a multiple of the number of buckets, so a partition lies in one
        bucket and is written as it is, without a second shuffle.
        """
        return self.rewrite(table, df, keys, combine, folds=True)

    def rewrite(
        self, table: str, df: DataFrame, keys: Sequence[str], combine: Callable[..., DataFrame], unique: bool = False, folds: bool = False
    ) -> WriteStats:
        """Replace the buckets of the staged keys by ``combine(their rows, staged rows)``.

        ``combine`` must keep rows in the bucket of their key, so it must not change
        keys. The input is staged first, so it is computed once however often the plan
        reads it, and its real size decides whether Spark broadcasts it. The first
        rewrite deals the whole table into buckets of ``keys``, and so does one by other keys or
        of a table grown past four times the size its buckets are meant for. Rows
        appended since the last rewrite are dealt out by the next one. A table that
        does not exist starts as ``combine`` of no rows. Rows with a NULL key have a
        bucket like others.

        Spark would broadcast staged rows by the bytes of their files, which may be a small part of
        what they take in memory. That is counted while they are staged; past ``BROADCAST_BYTES`` both sides are dealt
        by the keys into slices of a bounded number of rows and joined by merging, so the driver holds none of them.
        """
        stage, seen = f"{self._folder(table)}/stage-{uuid.uuid4().hex[:12]}", Observation()
        if not folds:
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_memory(df.schema)).alias("bytes"))
        df.write.parquet(stage, compression=COMPRESSION)
        try:
            staged, now = self.spark.read.schema(df.schema).parquet(stage), self._current(table)
            if unique:
                require_unique_keys(staged, keys)
            held = sum(p["bytes"] * len(p.get("buckets", [0])) // p.get("of", 1) for p in now.parts) + size_of(self.spark, stage)
            layout = now.layout
            if not layout or layout[0] != list(keys) or held > 4 * layout[1] * self.bucket_bytes and layout[1] < BUCKETS[1]:
                layout = [list(keys), min(max(BUCKETS[0], -(-held // self.bucket_bytes)), BUCKETS[1])]
            n = layout[1]
            number = F.pmod(F.hash(*[F.col(k) for k in keys]), F.lit(n))
            same = layout == now.layout
            kept, loose = ([p for p in now.parts if "buckets" in p], [p for p in now.parts if "buckets" not in p]) if same else ([], now.parts)
            schema = now.schema() if now.parts else staged.schema
            if now.parts:  # a key of another type would fall into another bucket
                types = {f.name.lower(): f.dataType for f in schema.fields}
                staged = staged.select(*[F.col(f"`{c}`").cast(types[c.lower()]).alias(c) if c in keys else F.col(f"`{c}`") for c in staged.columns])
            added = self._rows(self._paths(table, loose), schema)
            touched = None
            if same:
                hit = staged.select(number.alias("b")).union(added.select(number.alias("b"))).distinct()
                touched = {r["b"] for r in hit.collect()}  # at most the number of buckets
            target = self._rows(self._paths(table, kept, touched), schema).unionByName(added)
            slices = n * max(1, -(-held // (n * SLICE_BYTES)))
            if not folds and (seen.get["bytes"] or 0) > BROADCAST_BYTES:
                reached = held if touched is None else held * len(touched) // n
                many = -(-(seen.get["rows"] + target.count()) // SLICE_ROWS), -(-reached // SLICE_BYTES)
                dealt = max(self.spark.sparkContext.defaultParallelism, *many)
                target, staged = target.repartition(dealt, *keys), staged.repartition(dealt, *keys).hint("merge")
            out = (combine(target, staged, slices) if folds else combine(target, staged)).withColumn(BUCKET, number)
            stats, part = self._write_buckets(table, out if folds else out.hint("rebalance", BUCKET))
            left = [{**p, "buckets": [b for b in p["buckets"] if b not in touched]} for p in kept]
            self._publish(table, now, [*(p for p in left if p["buckets"]), part], layout, None if same else {})
            return stats
        finally:
            _remove(self.spark, stage)

    def _write_buckets(self, table: str, df: DataFrame) -> tuple[WriteStats, dict]:
        """A part with a folder for each bucket that has rows; rebalanced, Spark splits a bucket that is much larger than others."""
        folder = f"part-{uuid.uuid4().hex[:12]}"
        path = f"{self._folder(table)}/{folder}"
        rows = df.drop(BUCKET)
        stats = write_counted(df, path, "errorifexists", partition_by=BUCKET, compression=COMPRESSION)
        stats.schema = schema_names(rows)
        fs, hadoop = _path(self.spark, path)
        names = [f.getPath().getName() for f in fs.listStatus(hadoop)]
        there = sorted(int(x.removeprefix(f"{BUCKET}=")) for x in names if x.startswith(f"{BUCKET}="))
        return stats, {"folder": folder, "unit": None, "schema": rows.schema.jsonValue(), "bytes": stats.size_bytes, "buckets": there, "of": max(1, len(there))}

    def vacuum(self, table: str, older_than: float = DAY) -> int:
        """Remove parts, stages and manifests no longer current and unchanged for ``older_than`` seconds; returns the parts.

        Younger ones may belong to a write that has not published yet or to a reader.
        """
        fs, folder = _path(self.spark, self._folder(table))
        before = (time.time() - older_than) * 1000
        now = self._current(table)
        current = {p["folder"] for p in now.parts}
        old = []
        for f in fs.listStatus(folder):
            name = f.getPath().getName()
            if name.startswith(("part-", "stage-")) and name not in current and _last_change(fs, f) <= before:
                old.append(f.getPath())
        for path in old:
            fs.delete(path, True)
        for version in self._versions(table):
            at, path = _path(self.spark, self._manifest(table, version))
            if version < now.number and at.getFileStatus(path).getModificationTime() <= before:
                at.delete(path, False)
        return sum(p.getName().startswith("part-") for p in old)


def _last_change(fs, status) -> int:
    """Of a folder and what it holds: a long write touches its files, not its folder."""
    times = [status.getModificationTime()]
    if status.isDirectory():
        times += [_last_change(fs, f) for f in fs.listStatus(status.getPath())]
    return max(times)


def fit_columns(df: DataFrame, target: DataFrame, generated: Sequence[str] = ()) -> DataFrame:
    """Only the columns the target has and does not generate itself, in its types and order.

    Target columns the frame lacks are filled with NULL.
    """
    have = {c.lower(): c for c in df.columns}
    skip = {g.lower() for g in generated}
    out = []
    for field in target.schema.fields:
        if field.name.lower() in skip:
            continue
        source = have.get(field.name.lower())
        column = F.col(f"`{source}`") if source else F.lit(None)
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)
