"""Database extracts over Spark's JDBC source."""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.sqltext import render

FETCH_ROWS = 50_000

# Connection type -> dialect, default port, default database, URL, driver class.
DIALECTS = {
    "mssql": (1433, "master", "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true;trustServerCertificate=true",
              "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": (1521, "", "jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver"),
    "postgresql": (5432, "postgres", "jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "mysql": (3306, "", "jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
}
SAME_AS = {"sqlserver": "mssql", "postgres": "postgresql"}


def dialect_of(connection_type: str) -> str:
    name = connection_type.lower()
    name = SAME_AS.get(name, name)
    if name not in DIALECTS:
        raise ValueError(f"Unsupported conn_type: {connection_type!r}")
    return name


def connection_options(connection: Mapping) -> dict[str, str]:
    """URL, driver and login for a connection of any supported type."""
    port, database, url, driver = DIALECTS[dialect_of(connection.get("type", "mssql"))]
    login = connection.get("login", connection.get("username", ""))
    return {
        "url": url.format(
            host=connection.get("host", "localhost"),
            port=int(connection.get("port") or port),
            database=connection.get("database") or database,
        ),
        "driver": driver,
        "user": login,
        "password": connection.get("password", ""),
    }


def extract_options(connection: Mapping, source: Mapping, ds: str = "", run_id: str = "") -> dict[str, str]:
    """Reader options of one extract: a query, or a whole table when no query is given."""
    options = connection_options(connection)
    options["fetchsize"] = str(source.get("batch_size", FETCH_ROWS))
    if source.get("query"):
        options["query"] = render(source["query"], ds, run_id)
    elif source.get("table"):
        options["dbtable"] = source["table"]
    else:
        raise ValueError("source.query or source.table is required for extract")
    return options


def chunk_predicates(column: str, low: int, high: int, chunks: int) -> list[str]:
    """Ranges that cover every row once: the ends are open and NULL joins the first."""
    if chunks <= 1 or low >= high:
        return ["1 = 1"]
    step = max(1, -(-(high - low + 1) // chunks))
    bounds = [low + step * i for i in range(1, chunks) if low + step * i <= high]
    first = f"{column} < {bounds[0]} OR {column} IS NULL"
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [first, *middle, f"{column} >= {bounds[-1]}"]


def chunk_bounds(df: DataFrame, column: str) -> tuple[int, int]:
    """Smallest and largest key, one row to the driver."""
    row = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    return (row["low"] or 0, row["high"] or 0)


def literal(value: object, dialect: str) -> str:
    """A split point as text of a database's SQL; ``spark`` is Spark's own."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"no split point: {value!r}")
    if isinstance(value, datetime.datetime):
        text = value.replace(tzinfo=None).isoformat(" ", "microseconds" if value.microsecond else "seconds")
        return {"mssql": f"'{text.replace(' ', 'T')}'", "spark": f"TIMESTAMP_NTZ '{text}'"}.get(dialect, f"TIMESTAMP '{text}'")
    if isinstance(value, datetime.date):
        return f"'{value:%Y%m%d}'" if dialect == "mssql" else f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        if dialect in ("spark", "mysql"):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return ("N" if dialect == "mssql" else "") + "'" + value.replace("'", "''") + "'"
    return str(value)


def range_predicates(column: str, points: Sequence[object], dialect: str) -> list[str]:
    """Ranges between ascending split points that hold every row once: the ends are open and NULL joins the first."""
    marks = [literal(p, dialect) for p in dict.fromkeys(points)]
    if not marks:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(marks, marks[1:], strict=False)]
    return [f"{column} < {marks[0]} OR {column} IS NULL", *middle, f"{column} >= {marks[-1]}"]


def even_points(low: object, high: object, chunks: int) -> list[object]:
    """``chunks - 1`` points that part numbers, dates or instants from ``low`` to ``high`` evenly."""
    if isinstance(low, (int, decimal.Decimal)) and isinstance(high, (int, decimal.Decimal)):
        low, high = int(low // 1), int(high // 1)
        found = [low + (high - low + 1) * i // chunks for i in range(1, chunks)]
    elif isinstance(low, datetime.datetime):
        span = (high - low) // datetime.timedelta(microseconds=1) + 1
        found = [low + datetime.timedelta(microseconds=span * i // chunks) for i in range(1, chunks)]
    elif isinstance(low, datetime.date):
        found = [low + datetime.timedelta(days=((high - low).days + 1) * i // chunks) for i in range(1, chunks)]
    else:
        found = [low + (high - low) * i / chunks for i in range(1, chunks)]
    return [p for p in dict.fromkeys(found) if p > low]


def partition_predicates(
    source: Mapping, base: str, ask: Callable[[str], Sequence[Row]], dialect: str, borders: Callable[[str, int], Sequence] | None = None
) -> list[str] | None:
    """Ranges of ``partition_column`` for ``num_partitions`` readers; None where the source names no column.

    ``base`` is the query or table, ``ask`` runs a query in the source and returns its few
    rows. Numbers and times are parted evenly between their smallest and largest
    value, which the source answers from an index; text, and any column with
    ``partition_by: quantile``, at the borders of equally large tiles, for which the
    source sorts the column once. A source without rows, or with one value, is one range.
    ``borders(column, tiles)`` finds the smallest value of each tile where the source is
    Spark itself, whose NTILE over all rows is one task.
    """
    column, chunks = source.get("partition_column"), int(source.get("num_partitions", 1))
    if not column:
        return None
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", column):
        raise ValueError(f"partition_column must be a plain column name: {column!r}")
    if chunks < 1:
        raise ValueError(f"num_partitions must be at least 1: {chunks}")
    rows = base if re.fullmatch(r"[\w.$\[\]\"`]+", base.strip()) else f"({base}) q"
    low, high = ask(f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {rows}")[0]
    if low is None or chunks == 1:
        return ["1 = 1"]
    how = source.get("partition_by") or ("quantile" if isinstance(low, str) else "range")
    if how == "range" and not isinstance(low, str):
        return range_predicates(column, even_points(low, high, chunks), dialect)
    if how not in ("quantile", "range"):
        raise ValueError(f"unknown partition_by: {how!r}")
    if borders:
        return range_predicates(column, [value for value in borders(column, chunks) if value != low], dialect)
    tiles = ask(
        f"SELECT tile, MIN({column}) AS low FROM (SELECT {column}, NTILE({chunks}) OVER (ORDER BY {column}) AS tile "
        f"FROM {rows} WHERE {column} IS NOT NULL) t GROUP BY tile ORDER BY tile"
    )
    return range_predicates(column, [r[1] for r in tiles if r[1] != low], dialect)


def by_predicates(df: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """What readers with these predicates read of a frame together, in one pass; a row that two of them match comes twice."""
    hits = F.filter(F.array(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(predicates)]), lambda x: x.isNotNull())
    return df.withColumn("_reader", F.explode(hits)).drop("_reader")


def extract_source(spark: SparkSession, connection: Mapping, source: Mapping, ds: str = "", run_id: str = "") -> DataFrame:
    """One extract of a config; with ``partition_column`` in as many partitions as ``num_partitions`` says."""

    def ask(query: str) -> list[Row]:
        return extract(spark, connection, {"query": query}).collect()

    base = render(source["query"], ds, run_id) if source.get("query") else source.get("table", "")
    predicates = partition_predicates(source, base, ask, dialect_of(connection.get("type", "mssql")))
    return extract(spark, connection, source, predicates, ds, run_id)


def extract(
    spark: SparkSession,
    connection: Mapping,
    source: Mapping,
    predicates: Sequence[str] | None = None,
    ds: str = "",
    run_id: str = "",
) -> DataFrame:
    """Read a query or table; with predicates, one partition per range and ``fetchsize`` rows at a time."""
    options = extract_options(connection, source, ds, run_id)
    if not predicates:
        return spark.read.format("jdbc").options(**options).load()
    url = options.pop("url")
    query = options.pop("query", None)
    table = options.pop("dbtable", None) or f"({query}) q"
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=options)
