"""Questions annotated against their databases' catalogs: tokens, mentions, parts and what the parts say.

One stage over Arrow batches: catalogs and the values that questions mention are joined to the questions by database and question, catalogs are
taken apart once per worker and delivery, and every question gives one nested row. Nothing is moved after the joins. Questions of a database come to few tasks, so that its catalog is taken apart there only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askweave.functions.patterns import Annotated, directed
from askweave.functions.reading import read
from askweave.functions.schema_words import TIERS, SchemaWords
from askweave.functions.segments import correct_values, homes, numbered, parts_and_actions, rewritten
from askweave.functions.tokens import Tokens
from askweave.functions.words import stem
from askweave.operators.skew import join_small, spread
from askweave.sources.catalog import Catalog

KIND = (
    "q_id {id}, tokens array<struct<text:string,lemma:string,stem:string,tag:string,way:string,classes:string>>, "
    "mentions array<struct<start:int,stop:int,table_name:string,column_name:string,tier:string>>, "
    "parts array<struct<number:int,kind:string,link:string,action:string,text:string,filters:boolean,orders:boolean,descending:boolean,kept:int>>, "
    "selected array<struct<agg:string,table_name:string,column_name:string>>, conditions array<struct<table_name:string,column_name:string>>, "
    "grouped array<struct<table_name:string,column_name:string>>, ordered array<struct<table_name:string,column_name:string>>"
)


#: What of a reading each column needs; tokens and mentions need none.
_NEEDS = {"parts": {"flags"}, "selected": {"select", "group"}, "conditions": {"where"}, "grouped": {"group"}, "ordered": {"order"}}


def annotate(question: str, words: SchemaWords, values: dict[str, list[tuple[str, str]]]) -> tuple[Annotated, dict[int, list[tuple[str, str]]]]:
    """A question in canonical wording, its misspelt schema words and values mended, with its mentions; and the columns of its values."""
    tokens = words.spelling.of(Tokens.read(rewritten(question)))
    tokens, at = correct_values(tokens, values)
    return Annotated(tokens, tuple(words.mentions(tokens)), values=frozenset(at)), homes(at, values)


def _entries(question: str, words: SchemaWords, values: dict[str, list[tuple[str, str]]], fields: dict[str, tuple[str, ...]]) -> dict[str, list[tuple]]:
    """The columns of an annotated question in ``fields``, each entry as a tuple of the fields wished of it."""
    a, stored = annotate(question, words, values)
    said = frozenset().union(*(_NEEDS.get(c, ()) for c in fields if c != "parts" or not {"filters", "orders", "descending", "kept"}.isdisjoint(fields[c])))
    parts, found = read(a, words, stored, said) if fields.keys() & _NEEDS.keys() else ([], None)
    ways = directed(a) if "way" in fields.get("tokens", ()) else None
    flags = found.flags if found and found.flags else ()
    whole = {
        "text": lambda i, t: t.text, "lemma": lambda i, t: t.lemma, "stem": lambda i, t: stem(t.text), "tag": lambda i, t: t.tag, "way": lambda i, t: ways[i], "classes": lambda i, t: " ".join(sorted(a.classes(i))),
    }
    mention = {"start": 0, "stop": 1, "table_name": 2, "column_name": 3}
    actions = parts_and_actions(a)[1] if "action" in fields.get("parts", ()) else []
    number, texts = numbered(parts), [t.text for t in a.tokens]
    part = {
        "number": lambda n, p: number[n], "kind": lambda n, p: p.kind, "link": lambda n, p: p.link, "action": lambda n, p: actions[n], "text": lambda n, p: " ".join(texts[p.start : p.end]),
        "filters": lambda n, p: flags[n].where, "orders": lambda n, p: flags[n].order, "descending": lambda n, p: flags[n].descending, "kept": lambda n, p: flags[n].limit,
    }
    out = {}
    for column, own in fields.items():
        if column in ("tokens", "parts"):
            of, rows = (whole, a.tokens) if column == "tokens" else (part, parts)
            get = [of[f] for f in own]
            out[column] = [tuple([g(i, x) for g in get]) for i, x in enumerate(rows)]
        elif column == "mentions":
            out[column] = [tuple([TIERS[m.tier] if f == "tier" else m[mention[f]] for f in own]) for m in a.mentions]
        elif column == "selected":
            out[column] = [tuple([{"agg": s.agg, "table_name": s.table, "column_name": s.column}[f] for f in own]) for s in found.select]
        else:
            out[column] = [tuple([c[("table_name", "column_name").index(f)] for f in own]) for c in {"conditions": found.where, "grouped": found.group, "ordered": found.order}[column]]
    return out


#: All columns, each with the fields of its entries.
FIELDS = {c: tuple(x.split(":")[0] for x in own.split(",")) for c, own in re.findall(r"(\w+) array<struct<([^>]*)>>", KIND)}


def record(question: str, words: SchemaWords, values: dict[str, list[tuple[str, str]]]) -> dict:
    """The annotated question as a nested row."""
    return {c: [dict(zip(FIELDS[c], x)) for x in xs] for c, xs in _entries(question, words, values, FIELDS).items()}


def _column(rows: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, field by field."""
    ends = [0]
    for xs in rows:
        ends.append(ends[-1] + len(xs))
    own = list(zip(*(x for xs in rows for x in xs))) or [()] * kind.value_type.num_fields
    entries = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(own, kind.value_type)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries).cast(kind)


#: More catalogs than a task of usual size has, so that none is taken apart for each batch anew.
@lru_cache(1024)
def _schema(text: str) -> SchemaWords:
    return SchemaWords(Catalog.of_row(json.loads(text)))


def annotated(questions: DataFrame, catalogs: DataFrame, links: DataFrame, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Every question of a known database as :func:`record` has it; null questions have none. With ``fields``, only those of its columns, and of their entries only those fields, are made.

    ``catalogs`` has ``db`` and ``catalog`` (:func:`askweave.plans.generation.catalog_texts`); ``links`` has ``q_id``, ``table_name``, ``column_name`` and ``cell_value``,
    the values that may be meant in each question. ``questions`` has ``q_id``, ``db`` and ``question``; ``db`` is kept.
    """
    fields = FIELDS if fields is None else fields
    whole = T.StructType.fromDDL(KIND.format(id=questions.schema["q_id"].dataType.simpleString()))
    nested = [T.StructField(c, T.ArrayType(T.StructType([whole[c].dataType.elementType[f] for f in own]))) for c, own in fields.items()]
    schema = T.StructType([whole["q_id"], T.StructField("db", T.StringType()), *nested])
    held = links.groupBy("q_id").agg(F.collect_set(F.struct("cell_value", "table_name", "column_name")).alias("links"))
    own = questions.filter("question is not null").select("q_id", "db", "question").join(held, "q_id", "left")
    rows = join_small(spread(own, questions, by=("db", "q_id")), catalogs, "db").select("q_id", "db", "question", "catalog", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            catalog = b.column(3).dictionary_encode()
            texts, codes = catalog.dictionary.to_pylist(), catalog.indices.to_pylist()
            asked, linked = b.column(2).to_pylist(), b.column(4).to_pylist()
            out: list[dict] = [{}] * b.num_rows
            for i in sorted(range(b.num_rows), key=codes.__getitem__):  # all questions of a catalog one after the other
                words, values = _schema(texts[codes[i]]), {}
                for x in sorted(linked[i] or (), key=lambda x: (x["cell_value"], x["table_name"], x["column_name"])):
                    if x["column_name"] in words.catalog.tables.get(x["table_name"], {}):  # values of columns that the catalog has lost are none
                        values.setdefault(x["cell_value"], []).append((x["table_name"], x["column_name"]))
                out[i] = _entries(asked[i], words, values, fields)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(_column([r[f.name] for r in out], f.type) for f in list(arrow)[2:])], schema=arrow)

    return rows.mapInArrow(run, schema)
