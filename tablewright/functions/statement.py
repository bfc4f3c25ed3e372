"""User SQL with the results it had on the engine it was written for, where Spark's differ.

Spark's own parser says which part of a text is a sort key, a division or a cast;
only these parts are written anew, and the rest of the text stays as it is:

* a sort key without ``NULLS FIRST`` or ``NULLS LAST`` sorts NULLs last,
* a division is one of DOUBLEs: by zero it gives an infinity, or NaN for zero by zero
  (the sign of a negative zero does not count),
* a cast to a whole number rounds: text and DECIMAL half away from zero, DOUBLE half to even.

A text that Spark cannot parse is left alone, for Spark to refuse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

_TREE = "org.apache.spark.sql.catalyst.trees.TreeNode"
_WORTH = re.compile(r"/|\bORDER\s+BY\b|CAST\s*\(|::", re.IGNORECASE)
_PLACED = re.compile(r"\bNULLS\s+(FIRST|LAST)\s*\Z", re.IGNORECASE)
_CAST = re.compile(r"\A(TRY_)?CAST\s*\(|::", re.IGNORECASE)
_NUMBER = re.compile(r"\d*\.?\d+([eE][+-]?\d+)?\Z")
WHOLE = ("TINYINT", "SMALLINT", "INT", "BIGINT")


@dataclass
class Part:
    """A stretch of the text, ends included, with what stands in it."""

    kind: str
    start: int
    stop: int
    inner: tuple[tuple[int, int], ...] = ()
    word: str = ""


def _range(node) -> tuple[int, int] | None:
    origin = node.origin()
    if origin.startIndex().isEmpty() or origin.stopIndex().isEmpty():
        return None
    return origin.startIndex().get(), origin.stopIndex().get()


def _nodes(gateway, value) -> Iterator:
    """All tree nodes below a value of a parsed plan, outer ones first, also those in lists, options and pairs."""
    if is_instance_of(gateway, value, _TREE):
        yield value
    if is_instance_of(gateway, value, "scala.collection.Iterable") or is_instance_of(gateway, value, "scala.Option"):
        below = value.iterator()
    elif is_instance_of(gateway, value, _TREE) or value.getClass().getName().startswith("scala.Tuple"):
        below = value.productIterator()
    else:
        return
    while below.hasNext():
        item = below.next()
        if hasattr(item, "getClass"):
            yield from _nodes(gateway, item)


def _part(node, text: str) -> Part | None:
    kind, at = node.getClass().getSimpleName(), _range(node)
    if at is None:
        return None
    if kind == "SortOrder":
        return None if _PLACED.search(text[at[0] : at[1] + 1]) else Part("sort", *at)
    if kind == "Divide":
        inner = (_range(node.left()), _range(node.right()))
    elif kind == "Cast" and node.dataType().sql() in WHOLE and _CAST.search(text[at[0] : at[1] + 1]):
        inner = (_range(node.child()),)
    elif kind == "UnresolvedAlias":
        own = _range(node.child())
        named = own and node.child().getClass().getSimpleName() not in ("UnresolvedAttribute", "UnresolvedStar")
        return Part("name", *own, word=node.child().sql()) if named else None
    else:
        return None
    if any(i is None or i[0] < at[0] or i[1] > at[1] for i in inner):
        return None
    word = ("TRY_CAST " if str(node.evalMode()) == "TRY" else "CAST ") + node.dataType().sql() if kind == "Cast" else ""
    return Part({"Divide": "divide", "Cast": "cast"}[kind], *at, inner, word)


class _Rewrite:
    def __init__(self, text: str, parts: list[Part]):
        self.text = text
        changed = [p for p in parts if p.kind != "name"]
        # a select item gets its old name back only where something in it changes
        named = [p for p in parts if p.kind == "name" and any(p.start <= c.start and c.stop <= p.stop for c in changed)]
        found = {(p.start, p.stop, p.kind): p for p in [*named, *changed]}
        self.parts = sorted(found.values(), key=lambda p: (p.start, -p.stop, p.kind != "name"))

    def between(self, start: int, stop: int, after: int = -1) -> str:
        """The text of a stretch; ``after`` is the number of the part that asks for what is inside itself."""
        out, at = [], start
        for no, part in enumerate(self.parts):
            if no <= after or part.start < at or part.stop > stop:
                continue
            out += [self.text[at : part.start], self.written(no)]
            at = part.stop + 1
        return "".join([*out, self.text[at : stop + 1]])

    def written(self, no: int) -> str:
        part = self.parts[no]
        if part.kind == "sort":
            return f"{self.between(part.start, part.stop, no)} NULLS LAST"
        if part.kind == "name":
            return f"{self.between(part.start, part.stop, no)} AS `{part.word.replace('`', '``')}`"
        inner = [self.between(*at, no) for at in part.inner]
        if part.kind == "divide":
            left, right = (f"CAST(({x}) AS DOUBLE)" for x in inner)
            if _NUMBER.match(inner[1].strip()) and float(inner[1]):
                return f"({left} / {right})"
            return f"(({left} * CASE WHEN {right} = 0 THEN DOUBLE('Infinity') ELSE 1D END) / CASE WHEN {right} = 0 THEN 1D ELSE {right} END)"
        cast, kind = part.word.split()
        exact = f"{cast}(({inner[0]}) AS DECIMAL(38,18))"
        return (
            f"CASE WHEN typeof({inner[0]}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN {cast}(({inner[0]}) AS {kind}) "
            f"WHEN typeof({inner[0]}) IN ('double', 'float') THEN {cast}(BROUND({exact}) AS {kind}) ELSE {cast}(ROUND({exact}) AS {kind}) END"
        )


def as_written(spark: SparkSession, text: str) -> str:
    """``text`` with its sort keys, divisions and casts to whole numbers put so that Spark gives the results described above."""
    if not _WORTH.search(text):
        return text
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException:
        return text
    parts = [_part(node, text) for node in _nodes(spark.sparkContext._gateway, plan)]
    rewrite = _Rewrite(text, [p for p in parts if p])
    return rewrite.between(0, len(text) - 1)
