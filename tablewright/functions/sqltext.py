"""Small text steps applied to user SQL before Spark sees it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tablewright.functions.statement import as_written

_PLACEHOLDER = re.compile(r"\{\{ ?(ds|run_id) ?\}\}")
# strings, quoted names and comments: no rewriting inside these
_OPAQUE = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/"""
_CALLS = re.compile(
    rf"(?P<opaque>{_OPAQUE})|\b(?P<diff>DATEDIFF|DATE_DIFF)\s*\(\s*'(?P<unit>\w+)'\s*,"
    r"|\b(?P<add>DATEADD)\s*\(\s*'(?P<step>\w+)'\s*,|\b(?P<regex>regexp_matches)\s*\("
    r"|(?P<before>\bAS\s+|::\s*)(?P<type>VARCHAR|HUGEINT)\b(?!\s*\()", re.IGNORECASE | re.DOTALL)
# Names of types that Spark has under another one.
TYPES = {"VARCHAR": "STRING", "HUGEINT": "DECIMAL(38,0)"}
_MARKS = re.compile(rf"(?P<opaque>{_OPAQUE})|[(),]", re.DOTALL)
_QUERY = re.compile(rf"(?:\s|{_OPAQUE})*(?:SELECT|WITH|VALUES|FROM|TABLE|\()", re.IGNORECASE | re.DOTALL)


def render(text: str, ds: str = "", run_id: str = "") -> str:
    """Fill ``{{ ds }}`` and ``{{ run_id }}``, with or without the inner spaces."""
    values = {"ds": ds, "run_id": run_id}
    return _PLACEHOLDER.sub(lambda m: values[m.group(1)], text)


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments from ``at`` to the closing bracket of the call, and the place after it."""
    depth, start, found = 0, at, []
    for mark in _MARKS.finditer(text, at):
        if mark["opaque"]:
            continue
        depth += {"(": 1, ")": -1, ",": 0}[mark[0]]
        if depth < 0 or mark[0] == "," and depth == 0:
            found.append(text[start : mark.start()])
            start = mark.end()
        if depth < 0:
            return found, start
    raise ValueError(f"unclosed bracket in: {text[at:]}")


def to_spark_sql(text: str) -> str:
    """Bare date units, differences that count unit borders, and Spark's names for substring regex search and types.

    ``DATEDIFF('day', a, b)`` counts midnights between ``a`` and ``b``; Spark's own
    counts whole days, so both ends are cut to the unit first.
    """
    out, at = [], 0
    while call := _CALLS.search(text, at):
        out.append(text[at : call.start()])
        at = call.end()
        if call["opaque"]:
            out.append(call[0])
        elif call["diff"]:
            arguments, at = _arguments(text, at)
            unit = call["unit"].upper()
            ends = [f"DATE_TRUNC('{unit}', {to_spark_sql(a.strip())})" for a in arguments]
            out.append(f"DATEDIFF({unit}, {', '.join(ends)})")
        elif call["add"]:
            out.append(f"{call['add']}({call['step'].upper()},")
        elif call["type"]:
            out.append(call["before"] + TYPES[call["type"].upper()])
        else:
            out.append("regexp_like(")
    return "".join([*out, text[at:]])


def safe_alias(task_id: str) -> str:
    """Task id as a SQL qualifier."""
    return task_id.replace("-", "_").replace("/", "_")


def run_sql(
    spark: SparkSession,
    text: str,
    inputs: Mapping[str, DataFrame],
    args: Mapping[str, object] | None = None,
) -> DataFrame:
    """Run SQL over named DataFrames.

    A name is ``table`` or ``alias.table``. Every frame is a temporary view under a
    name of its own, so views of the session are never touched. A qualified name is
    swapped for that view in the text; a plain name is a common table expression
    around the text, which the text's own ones may shadow. Views are dropped once
    the plan is analysed; the result stays lazy. NULL order, division and rounding
    casts are those of ``statement.as_written``.
    """
    text = as_written(spark, to_spark_sql(text).strip().rstrip(";"))
    tag = uuid.uuid4().hex
    views, plain = [], []
    try:
        for no, name in enumerate(sorted(inputs, key=len, reverse=True)):
            alias, _, table = name.rpartition(".")
            view = f"{table}__{no}__{tag}"
            if alias:
                call = rf"(?P<opaque>{_OPAQUE})|(?<![\w.]){re.escape(alias)}\s*\.\s*{re.escape(table)}(?![\w(])"
                swapped = re.sub(call, lambda m, v=view: m["opaque"] or f"`{v}`", text, flags=re.IGNORECASE | re.DOTALL)
                used, text = swapped != text, swapped
            else:
                used = re.search(rf"\b{re.escape(name)}\b", text, re.IGNORECASE)
                plain += [f"`{name}` AS (SELECT * FROM `{view}`)"] if used else []
            if used:
                inputs[name].createOrReplaceTempView(f"`{view}`")
                views.append(view)
        if plain and _QUERY.match(text):
            text = f"WITH {', '.join(plain)} (\n{text}\n)"
        return spark.sql(text, args=dict(args)) if args else spark.sql(text)
    finally:
        for view in views:
            spark.catalog.dropTempView(view)
