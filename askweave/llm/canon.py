"""The sense in which two queries are the same (problems 1 and 2)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quoted text stays one piece while the select list is taken apart.
_PIECE = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`|\w+|[^\w\s]")
#: What counts in the end: words and signs other than commas, semicolons and quote marks.
_COUNTS = re.compile(r"\w+|[^\w\s,;'\"`‘’‚‛“”„´]")


_SELECT = re.compile(r"\s*select\b\s*(distinct\b|all\b)?")
_FROM = re.compile(r"\bfrom\b")
#: What keeps a select list from being cut at its commas: quotes, brackets that hold a comma or a bracket, and unmatched ones.
_INVOLVED = re.compile(r"['\"`]|\([^)]*[,(]|(?:\A|\))[^(]*\)")


def _text(pieces: list[str]) -> str:
    return " ".join(_COUNTS.findall(" ".join(pieces)))


def canonical_query(sql: str) -> str:
    """A query without letter case, spacing, quote marks, commas and semicolons, its select list in sorted order.

    The select list runs from the first SELECT (and a DISTINCT or ALL after it) to the FROM at the same depth of
    brackets; its items are cut at commas of that depth. Text in quotes is never taken for structure.
    """
    sql = sql.lower()
    head, end = _SELECT.match(sql), _FROM.search(sql)
    if head and end and head.end() <= end.start():
        items = sql[head.end() : end.start()]
        if items.count("(") == items.count(")") and not _INVOLVED.search(items):
            parts = sorted([" ".join(_COUNTS.findall(x)) for x in items.split(",")])
            return " ".join([x for x in ("select", head.group(1), *parts, "from", *_COUNTS.findall(sql, end.end())) if x])
    return _by_structure(sql)


def _by_structure(sql: str) -> str:
    """:func:`canonical_query` of a lower-cased query of any form."""
    pieces = _PIECE.findall(sql)
    if "select" not in pieces:
        return _text(pieces)
    begin = pieces.index("select") + 1
    if begin < len(pieces) and pieces[begin] in ("distinct", "all"):
        begin += 1
    depth, end, items, item = 0, begin, [], []
    while end < len(pieces):
        piece = pieces[end]
        depth += (piece == "(") - (piece == ")")
        if depth < 0 or depth == 0 and piece == "from":
            break
        if depth == 0 and piece == ",":
            items.append(_text(item))
            item = []
        else:
            item.append(piece)
        end += 1
    items.append(_text(item))
    return " ".join(x for x in (_text(pieces[:begin]), *sorted(items), _text(pieces[end:])) if x)


@F.arrow_udf(T.StringType())
def query_key(values: pa.Array) -> pa.Array:
    """:func:`canonical_query` over Arrow batches; null stays null. The same in JVM expressions takes twice the time."""
    return pa.array([None if s is None else canonical_query(s) for s in values.to_pylist()], pa.string())
