"""Strict comparison of a Spark result with its check SQL run in DuckDB."""

from __future__ import annotations

import datetime
import math

# pyspark type -> (DuckDB type prefix) that the two sides must share
_KINDS = {
    "bigint": ("BIGINT",),
    "double": ("DOUBLE",),
    "string": ("VARCHAR",),
    "boolean": ("BOOLEAN",),
    "date": ("DATE",),
    "timestamp_ntz": ("TIMESTAMP",),
}


def _cell(value):
    if isinstance(value, float) and not math.isnan(value):
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _sort_key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def compare(con, df, sql: str | None) -> str:
    """``ok …`` or a description of the first difference."""
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"ok rows={len(rows)} (no SQL check)"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    left = [df.columns.index(n) for n in order]
    right = [names.index(n) for n in order]
    for field in df.schema.fields:
        want = _KINDS.get(field.dataType.simpleString())
        have = kinds[field.name]
        if want is None or have not in want:
            return f"type of {field.name}: {field.dataType.simpleString()} vs {have}"
    got = sorted((tuple(_cell(r[i]) for i in left) for r in rows), key=_sort_key)
    exp = sorted((tuple(_cell(r[i]) for i in right) for r in expected), key=_sort_key)
    if len(got) != len(exp):
        return f"rows differ: {len(got)} vs {len(exp)}"
    for a, b in zip(got, exp, strict=True):
        if a != b:
            diff = [(n, x, y) for n, x, y in zip(order, a, b, strict=True) if x != y]
            return f"values differ: {diff[:4]} in {a}"
    return f"ok rows={len(got)}"
