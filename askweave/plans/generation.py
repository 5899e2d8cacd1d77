"""Queries generated for questions over their databases' catalogs.

A generator is a function of a question and a catalog that gives candidates from best to worst. The default one reads the
question by rules; a model that runs on the executors can take its place. Catalogs are joined to the questions by database and
parsed once per worker and delivery; questions move, never the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askweave.functions.text import db_key
from askweave.operators.linking import exact_matches
from askweave.operators.ranking import current_catalog
from askweave.operators.skew import join_small, spread
from askweave.plans.asking import known_values, shorthand_of, tokenize
from askweave.plans.emit import query_sql
from askweave.plans.inference import expand
from askweave.plans.selection import PLACEHOLDER, compiled
from askweave.sources.catalog import Catalog

CATALOG_FIELDS = ("table_names_original", "column_names", "column_names_original", "column_types", "primary_keys", "foreign_keys")


def by_rules(question: str, catalog: Catalog, links: Iterable[tuple[str, str, str]] = ()) -> list[str]:
    """One candidate, or none where the rules find no way. ``links``: values in the question, as value, table and column."""
    try:
        known = known_values(x for x in links if x[2] in catalog.tables.get(x[1], {}))
        text, options = shorthand_of(catalog, question, lambda value: known.get(" ".join(tokenize(value)), ("", []))[1], known)
        return [query_sql(expand(text, catalog, options))]
    except Exception:  # noqa: BLE001  a question that cannot be read has no candidate
        return []


def catalog_texts(catalog: DataFrame) -> DataFrame:
    """``db`` and ``catalog``, the current delivery of each database as one text."""
    return current_catalog(catalog).select("db", F.to_json(F.struct(*CATALOG_FIELDS), {"ignoreNullFields": "false"}).alias("catalog"))


@lru_cache(256)
def parsed(text: str) -> Catalog:
    return Catalog.of_row(json.loads(text))


def decoded(candidates: DataFrame, catalog: DataFrame, shorthand: bool = False) -> DataFrame:
    """Of the candidates (``q_id``, ``db``, ``place``, ``text``) of each question, the first that can be read after repair, as ``place`` and ``sql``.

    Repair and compilation run on the executors, once a candidate; names that the question's catalog lacks become known ones. A question
    none of whose candidates can be read has place -1 and the placeholder. Null texts and unknown databases are no candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [compiled(t, parsed(c), shorthand) for t, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["q_id", "place", "sql"])

    kind = candidates.schema["q_id"].dataType.simpleString()
    own = join_small(spread(candidates.filter("text is not null and place is not null"), candidates), catalog_texts(catalog), "db").select("q_id", F.col("place").cast("int").alias("place"), "text", "catalog")
    read = own.mapInArrow(run, f"q_id {kind}, place int, sql string")
    first = read.groupBy("q_id").agg(F.min(F.when(F.col("sql").isNotNull(), F.struct("place", "sql"))).alias("x"))
    return first.select("q_id", F.coalesce("x.place", F.lit(-1)).alias("place"), F.coalesce("x.sql", F.lit(PLACEHOLDER)).alias("sql"))


def generated(questions: DataFrame, catalog: DataFrame, generator: Callable[..., list[str]] = by_rules, index: DataFrame | None = None) -> DataFrame:
    """``q_id`` and ``sql``, the generator's first candidate or the placeholder, for every question of a current database.

    Null questions and unknown databases have none. Repeated questions are answered each. With a value ``index`` the generator also gets
    the values of the database whose words stand in the question, quoted or not, with their columns.
    """

    linked = index is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = [([tuple(x.values()) for x in xs or ()],) for xs in b.column(3).to_pylist()] if linked else [()] * b.num_rows
            found = [(generator(q, parsed(c), *x) or [PLACEHOLDER])[0] for q, c, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), links)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["q_id", "sql"])

    own = questions.filter("question is not null").select("q_id", db_key(F.col("db_id")).alias("db"), "question")
    columns = ["q_id", "question", "catalog"]
    if linked:  # before the catalogs, whose texts are longer than the questions
        links = exact_matches(questions, index).groupBy("q_id").agg(F.collect_set(F.struct("cell_value", "table_name", "column_name")).alias("links"))
        own, columns = own.join(links, "q_id", "left"), [*columns, "links"]
    own = join_small(spread(own, questions), catalog_texts(catalog), "db")
    kind = questions.schema["q_id"].dataType.simpleString()
    return own.select(*columns).mapInArrow(run, f"q_id {kind}, sql string")
