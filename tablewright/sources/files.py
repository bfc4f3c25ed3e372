"""File ingest: CSV, TSV, Parquet and JSON lines from a path or glob."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# read option -> CSV reader option of the same meaning
_CSV_OPTIONS = {
    "quotechar": "quote",
    "escapechar": "escape",
    "encoding": "encoding",
    "comment": "comment",
    "na_values": "nullValue",
}


def _read_csv(spark: SparkSession, path: str, sep: str, options: Mapping, schema: str | None) -> DataFrame:
    """CSV with the read options users pass: header, names, usecols, dtype, nrows and the text options.

    Types are inferred unless a schema is given; give one for large inputs, as
    inference reads the data an extra time.
    """
    known = {"header", "names", "usecols", "dtype", "nrows", "sep", "delimiter", *_CSV_OPTIONS}
    unknown = sorted(set(options) - known)
    if unknown:
        raise ValueError(f"Unsupported read options: {', '.join(unknown)}")
    header = options.get("header", 0 if "names" not in options else None)
    reader = spark.read.option("sep", options.get("sep", options.get("delimiter", sep)))
    reader = reader.option("header", header is not None)
    for name, option in _CSV_OPTIONS.items():
        if options.get(name) is not None:
            reader = reader.option(option, options[name])
    if schema:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", options.get("dtype") is not str).csv(path)
    if options.get("names"):
        df = df.toDF(*options["names"])
    if isinstance(options.get("dtype"), Mapping):
        df = df.withColumns({c: F.col(c).cast(kind) for c, kind in options["dtype"].items()})
    if options.get("usecols"):
        df = df.select(*options["usecols"])
    if options.get("nrows") is not None:
        df = df.limit(int(options["nrows"]))
    return df


def ingest(spark: SparkSession, source: Mapping) -> DataFrame:
    """Read ``source.path`` (or ``source.s3_path``) in ``source.format``, CSV by default."""
    path = source.get("path") or source.get("s3_path")
    kind = source.get("format", "csv").lower()
    schema = source.get("schema")
    if kind in ("csv", "tsv"):
        sep = "\t" if kind == "tsv" else source.get("delimiter", ",")
        return _read_csv(spark, path, sep, source.get("read_options", {}), schema)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl", "ndjson"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.json(path)
    raise ValueError(f"Unsupported file format: {kind}")
