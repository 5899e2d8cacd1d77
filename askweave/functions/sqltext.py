"""Query texts as data: normal form, skeleton and labels.

The lexer and the alias table need a state, so they run over Arrow batches; masking and collapsing are JVM expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEX = re.compile(r"""'(?:[^']|'')*'|@\.@|<=|>=|!=|<>|-?\d+\.\d+|(?<![\w)]\s)(?<![\w)])-\d+|[^\W\d]\w*(?:\.(?:\w+|\*))?|\d+\w*|\S""")
_JOINERS = {"select", "from", "where", "group", "having", "order", "limit", "join", "on", "union", "intersect", "except", "and", "or"}
COMPARISONS = ("=", "!=", ">", ">=", "<", "<=")


def sql_tokens(sql: str) -> list[str]:
    """Tokens with quoted text whole; dotted names are one token."""
    return _LEX.findall(sql)


def normal_form(sql: str) -> str:
    """One form per query: no trailing semicolon, single quotes, lower case outside them, single blanks, ``asc`` written out, no aliases.

    Aliases are those bound by AS after a table; they are replaced as whole names only. ``asc`` is added to each ordering key
    without a direction. A query that cannot be read keeps its tokens.
    """
    tokens = [t if t[0] == "'" else t.lower() for t in sql_tokens(sql.strip().removesuffix(";").replace('"', "'"))]
    aliases = {tokens[i + 1]: tokens[i - 1] for i in range(1, len(tokens) - 1) if tokens[i] == "as" and re.fullmatch(r"\w+", tokens[i - 1]) and re.fullmatch(r"\w+", tokens[i + 1])}
    out: list[str] = []
    ordering, depth, key = False, 0, False

    def close() -> None:
        if ordering and key:
            out.append("asc")

    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t == "as" and i + 1 < len(tokens) and tokens[i + 1] in aliases:
            i += 2
            continue
        if "." in t and t[0] != "'" and t.partition(".")[0] in aliases:
            t = f"{aliases[t.partition('.')[0]]}.{t.partition('.')[2]}"
        elif t in aliases:
            t = aliases[t]
        if t == "order" and i + 1 < len(tokens) and tokens[i + 1] == "by":
            close()
            out += ["order", "by"]
            ordering, depth, key = True, 0, False
            i += 2
            continue
        if ordering:
            depth += (t == "(") - (t == ")")
            if depth < 0 or depth == 0 and t in _JOINERS:
                close()
                ordering = False
            elif t in ("asc", "desc"):
                key = False
            elif t == "," and depth == 0:
                close()
                key = False
            else:
                key = True
        out.append(t)
        i += 1
    close()
    return " ".join(out)


@F.arrow_udf(T.StringType())
def normalized(values: pa.Array) -> pa.Array:
    """:func:`normal_form` over Arrow batches; null stays null."""
    return pa.array([None if s is None else normal_form(s) for s in values.to_pylist()], pa.string())


_LITERAL = re.compile(r"'.*'|-?\d+(\.\d+)?", re.S)


def _mask(sql: str | None, names: list[str] | None) -> str | None:
    """Tokens of the normal form joined by blanks, with names, literals and stars as ``_``; a row's names are a set made once."""
    known = set(names or ())
    return None if sql is None else " ".join("_" if t in known or t == "*" or t.endswith(".*") or _LITERAL.fullmatch(t) else t for t in sql_tokens(normal_form(sql)))


@F.arrow_udf(T.StringType())
def _masked(queries: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array([_mask(s, ns) for s, ns in zip(queries.to_pylist(), names.to_pylist())], pa.string())


def _masked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_mask(s, ns) for s, ns in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["_id", "_masked"])


def _folded(masked: Column) -> Column:
    out = F.concat(F.lit(" "), masked, F.lit(" "))
    for pattern, to in (
        (r" on _ = _(?: (?:and|or) _ = _)*(?= )", ""),
        (r" _(?: join _)+(?= )", " _"),
        (r" _(?: , _)+(?= )", " _"),
        *((rf" _ {re.escape(op)} _(?= )", " _") for op in COMPARISONS),
        (r" where _(?: (?:and|or) _)+(?= )", " where _"),
        (r" +", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def skeleton(sql: Column, names: Column) -> Column:
    """The shape of a query in normal form: ``names`` (array of tables, columns and table.column), literals and stars become ``_``.

    Join conditions go, chains of joined tables, lists and simple comparisons become one ``_`` each. ``names`` must be a column as it stands: an
    expression with lambda functions is no argument for Python.
    """
    return _folded(_masked(sql, names))


def skeletons(df: DataFrame, id_col: str, sql: Column, names: Column) -> DataFrame:
    """``id_col`` and ``skeleton`` of each query, whatever its form; ``names`` may be any expression."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), sql.alias("_sql"), names.alias("_names")).mapInArrow(_masked_rows, f"_id {kind}, _masked string")
    return rows.select(F.col("_id").alias(id_col), _folded(F.col("_masked")).alias("skeleton"))


def schema_names(db_schema: Column) -> Column:
    """Tables, columns and table.column of a nested schema, lower-cased, without nulls."""
    tables = F.transform(db_schema, lambda t: F.lower(t["table_name_original"]))
    columns = F.flatten(F.transform(db_schema, lambda t: F.coalesce(t["column_names_original"], F.array().cast("array<string>"))))
    dotted = F.flatten(F.transform(db_schema, lambda t: F.coalesce(F.transform(t["column_names_original"], lambda c: F.concat(t["table_name_original"], F.lit("."), c)), F.array().cast("array<string>"))))
    return F.coalesce(F.array_compact(F.array_distinct(F.concat(tables, F.transform(columns, F.lower), F.transform(dotted, F.lower)))), F.array().cast("array<string>"))
