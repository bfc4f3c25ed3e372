"""Extract shapes: day and rolling windows, current versions, increments and change rows.

All are filters and joins that Spark pushes into the scan; nothing here reads more
columns or row groups than the result needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tablewright.operators.merge import new, upsert
from tablewright.operators.ordered import newest_per_key
from tablewright.session import shared_root
from tablewright.sinks.store import SLICE_ROWS, TableStore, WriteStats, path_exists

OPEN_END = "9999-12-31 23:59:59.9999999"
DELETE, INSERT, BEFORE_UPDATE, AFTER_UPDATE = 1, 2, 3, 4


def day_window(df: DataFrame, column: str, ds: str) -> DataFrame:
    """Rows of the day before ``ds``: ``[ds - 1, ds)``."""
    day = F.to_date(F.lit(ds))
    return df.where((F.col(column) >= F.date_sub(day, 1)) & (F.col(column) < day))


def child_by_parent_window(child: DataFrame, parent: DataFrame, key: str, column: str, ds: str) -> DataFrame:
    """Child rows whose parent falls in the day window.

    Only the parent keys of one day meet the child table, so Spark broadcasts
    them when they are few and prunes the child scan with them.
    """
    return child.join(day_window(parent, column, ds).select(key), key).select(*child.columns)


def rolling_window(df: DataFrame, column: str, as_of: Column, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``, and anything after it."""
    return df.where(F.col(column) >= as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def current_version(df: DataFrame, valid_to: str = "ValidTo") -> DataFrame:
    """Open rows of a history table."""
    return df.where(F.col(valid_to) == OPEN_END)


def flagged_projection(df: DataFrame, flag: str, columns: Mapping[str, str], valid_to: str = "ValidTo") -> DataFrame:
    """Open rows with a flag set; ``columns`` maps output names to source columns."""
    return current_version(df, valid_to).where(F.col(flag)).select(*[F.col(c).alias(n) for n, c in columns.items()])


def full_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


class Increment:
    """Rows past a stored high-water mark. Declared extract mode; each batch appends its mark as one Parquet row.

    The new mark is observed while the batch is written, so finding it costs no
    second scan. It is stored only after the batch is safe: a run that dies before
    ``commit`` is simply repeated. Rows that arrive after a batch with the very value of
    its mark are not read by the next one: use a column that only grows, or a CDC
    extract, where that can happen.
    """

    def __init__(self, spark: SparkSession, state_path: str, column: str):
        self.spark, self.state_path, self.column = spark, state_path, column
        self._seen: Observation | None = None

    def last(self):
        if not path_exists(self.spark, self.state_path):
            return None
        return self.spark.read.parquet(self.state_path).agg(F.max("mark").alias("mark")).first()["mark"]

    def _literal(self, mark) -> Column:
        """A mark without a zone goes back as text, or the driver's own zone would shift it."""
        return F.lit(str(mark)).cast(self._type) if isinstance(self._type, TimestampNTZType) else F.lit(mark)

    def rows(self, df: DataFrame) -> DataFrame:
        last = self.last()
        self._type = df.select(self.column).schema[0].dataType
        fresh = df if last is None else df.where(F.col(self.column) > self._literal(last))
        self._seen = Observation()
        return fresh.observe(self._seen, F.max(self.column).alias("mark"))

    def commit(self) -> None:
        """Store the mark of the batch that was written; an empty batch keeps the old one."""
        mark = self._seen.get["mark"]
        if mark is not None:
            one = self.spark.range(1).select(self._literal(mark).alias("mark"))
            one.coalesce(1).write.mode("append").parquet(self.state_path)


def cdc_extract(changes: DataFrame, base: DataFrame, key: str, operation: str = "operation") -> DataFrame:
    """Inserted and after-update change rows joined to their base rows."""
    return changes.where(F.col(operation).isin(INSERT, AFTER_UPDATE)).join(base, key)


def _latest_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str], operation: str, slices: int | None = None) -> DataFrame:
    """The newest change of each key.

    Changes are dealt by key before they are put in order: the partition of a scan can be of any
    size, and ranking there would sort all of it in one task.
    """
    dealt = changes.where(F.col(operation) != BEFORE_UPDATE).repartition(*([slices] if slices else []), *keys)
    return newest_per_key(dealt, keys, [F.desc(c) for c in order])


def cdc_apply_to(
    store: TableStore, table: str, changes: DataFrame, keys: Sequence[str], order: Sequence[str], operation: str = "operation"
) -> WriteStats:
    """Apply changes to a table of the store, deletes included; only the hash buckets of their keys are read and rewritten.

    Batches of changes must come in their order.
    """
    def combine(target: DataFrame, staged: DataFrame) -> DataFrame:
        taken = {c: new(c) for c in staged.columns if c in target.columns and c not in keys}
        return upsert(target, staged, keys, taken, remove=new(operation) == DELETE)

    return store.rewrite(table, _latest_changes(changes, keys, order, operation), keys, combine)


def cdc_apply(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], operation: str = "operation"
) -> DataFrame:
    """Base after the newest change of each key: deletes removed, the rest merged in.

    The newest changes are checkpointed, as the merge reads them more than once. They
    and the base are dealt into slices of a bounded number of rows, which the joins keep: Spark
    would go by compressed bytes, of which short keys have very few.
    """
    shared_root(base.sparkSession)
    slices = max(base.sparkSession.sparkContext.defaultParallelism, -(-(changes.count() + base.count()) // SLICE_ROWS))
    latest = _latest_changes(changes, keys, order, operation, slices).checkpoint()
    taken = {c: new(c) for c in changes.columns if c in base.columns and c not in keys}
    base, latest = (df.repartition(slices, *keys) for df in (base, latest))
    return upsert(base, latest, keys, taken, remove=new(operation) == DELETE)
