"""Type names users write in expected schemas, and their Spark types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The type names that schema checks compare against.
TYPE_NAMES = {
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.BooleanType: "BOOLEAN",
    T.StringType: "VARCHAR",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.BinaryType: "BLOB",
    T.NullType: "INTEGER",
}


def sql_type_name(dtype: T.DataType) -> str:
    """``BIGINT``, ``DECIMAL(18,2)``, ``VARCHAR[]`` … for a Spark type."""
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return f"{sql_type_name(dtype.elementType)}[]"
    if isinstance(dtype, T.StructType):
        inner = ", ".join(f"{f.name} {sql_type_name(f.dataType)}" for f in dtype.fields)
        return f"STRUCT({inner})"
    if isinstance(dtype, T.MapType):
        return f"MAP({sql_type_name(dtype.keyType)}, {sql_type_name(dtype.valueType)})"
    return TYPE_NAMES.get(type(dtype), dtype.simpleString().upper())


def schema_names(df: DataFrame) -> dict[str, str]:
    """``{column: type name}`` in column order, the form recorded for every output."""
    return {f.name: sql_type_name(f.dataType) for f in df.schema.fields}
