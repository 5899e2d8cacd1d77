"""Questions annotated against their catalogs: over all training questions, and over written-down questions with what must come out."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.functions.question import repaired_questions
from askweave.functions.text import db_key
from askweave.functions.words import lemma, stem
from askweave.operators import records
from askweave.operators.annotation import FIELDS, annotated
from askweave.operators.skew import join_small
from askweave.plans.generation import catalog_texts
from askweave.plans.pipeline_queries import _ITEMS, value_match_exact
from askweave.sources.catalog import Catalog
from askweave.sources.tables import table


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "train_spider").filter("question is not null").select("q_id", db_key(F.col("db_id")).alias("db"), "question")


def _annotated(spark: SparkSession, sf_dir: str, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    return annotated(_questions(spark, sf_dir), catalog_texts(table(spark, sf_dir, "spider_tables")), value_match_exact(spark, sf_dir), fields)


def _each(df: DataFrame, column: str) -> DataFrame:
    return df.select("q_id", F.posexplode(column).alias("pos", "x")).select("q_id", "pos", "x.*")


def question_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with base form, stem, tag, direction and classes."""
    return _each(_annotated(spark, sf_dir, {"tokens": FIELDS["tokens"]}), "tokens")


def question_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns that questions speak of, where, and the tier that found them."""
    return _each(_annotated(spark, sf_dir, {"mentions": FIELDS["mentions"]}), "mentions")


def question_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of questions with number, kind, action and flags."""
    return _each(_annotated(spark, sf_dir, {"parts": FIELDS["parts"]}), "parts")


def question_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions ask for, by what it is filtered, grouped and ordered, as texts."""
    full = lambda c: F.concat_ws(".", c["table_name"], F.nullif(c["column_name"], F.lit("")))
    item = lambda c: F.when(c["agg"] != "", F.concat(c["agg"], F.lit("("), full(c), F.lit(")"))).otherwise(full(c))
    text = lambda name, of=full: F.array_join(F.transform(name, of), " ")
    return _annotated(spark, sf_dir, {c: FIELDS[c] for c in ("selected", "conditions", "grouped", "ordered")}).select("q_id", text("selected", item).alias("selected"), text("conditions").alias("conditions"), text("grouped").alias("grouped"), text("ordered").alias("ordered"))


def question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the annotations: questions; parts that are not all their tokens in order; mentions beyond them; names that the catalog lacks; first parts that are conditions."""
    own = _annotated(spark, sf_dir, {"tokens": ("text",), "mentions": ("start", "stop", "table_name", "column_name"), "parts": ("kind", "text"), "conditions": FIELDS["conditions"]})
    both = join_small(own, records.schemas(table(spark, sf_dir, "spider_tables")).select("db", "names"), "db")
    told = F.filter(F.array_distinct(F.concat(F.transform("mentions", lambda m: F.concat_ws(".", m["table_name"], F.nullif(m["column_name"], F.lit("")))), F.transform("conditions", lambda c: F.concat_ws(".", c["table_name"], F.nullif(c["column_name"], F.lit("")))))), lambda x: x != "")
    count = lambda cond: F.count(F.when(cond, 1))
    return both.agg(
        F.count(F.lit(1)).alias("questions"), count(F.array_join(F.transform("tokens", lambda t: t["text"]), " ") != F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("uncovered"),
        count(F.exists("mentions", lambda m: (m["start"] >= m["stop"]) | (m["stop"] > F.size("tokens")))).alias("outside"), count(F.size(F.array_except(told, "names")) > 0).alias("unknown"),
        count(F.get(F.transform("parts", lambda p: p["kind"]), 0) == "condition").alias("led_by_condition"),
    )


def question_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training questions with plain quotes and schema words spelt as the catalog has them."""
    names = records.schemas(table(spark, sf_dir, "spider_tables")).select("db", F.flatten(F.transform("db_schema", lambda t: F.concat(F.array(F.coalesce(t["table_name"], t["table_name_original"])), F.coalesce(t["column_names"], F.array().cast("array<string>"))))).alias("names"))
    return join_small(_questions(spark, sf_dir), names, "db").select("q_id", repaired_questions("question", "names").alias("repaired"))


def repair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of :func:`question_repair`: questions; typographic quotes left; questions whose number of words changed other than by folding."""
    both = question_repair(spark, sf_dir).join(_questions(spark, sf_dir), "q_id")
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1))
    folded = 2 * F.regexp_count(F.lower("question"), F.lit(r"\bat least one\b"))
    return both.agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("repaired").rlike("[‘’“”]"), 1)).alias("quotes_left"), F.count(F.when(words("repaired") != words("question") - folded, 1)).alias("words_changed"))


# -- written-down questions --------------------------------------------------------------------------------------

#: Number, question, and what must come out: parts (kind: text), selected, conditions, grouped, ordered.
FIXTURE = (
    (1, "What are the names and retail prices of parts with size over 10?", "select: What are the names and retail prices of parts | condition: with size over 10 ?", "part.p_name part.p_retailprice", "part.p_size", "", ""),
    (2, "List the name of suppliers in the nation 'X' with the highest account balance.", "select: List the name of suppliers in the nation 'X' | condition: with the highest account balance .", "supplier.s_name", "", "", "supplier.s_acctbal"),
    (3, "How many orders does each customer have?", "select: number of orders does | group: each customer have ?", "customer.c_name count(orders)", "", "customer.c_name", ""),
    (4, "Which parts have no supplier named 'Y'?", "select: Which parts | condition: have no supplier named 'Y' ?", "part.p_name", "supplier.s_name", "", ""),
    (5, "Show the highest and lowest account balance of customers for each nation.", "select: Show the highest and lowest account balance of customers | group: for each nation .", "nation.n_name max(customer.c_acctbal) min(customer.c_acctbal)", "", "nation.n_name", ""),
    (6, "List the names of the 5 suppliers with the lowest account balance, sorted by name.", "select: List the names of the 5 suppliers | condition: with the lowest account balance | order: , sorted by name .", "supplier.s_name", "", "", "supplier.s_acctbal supplier.s_name"),
    (7, "What is the average quantity of line items whose discount is at least 0.1 and tax is between 0.01 and 0.05?", "select: What is the average quantity of line items | condition: whose discount is at least 0.1 | condition: and tax is between 0.01 and 0.05 ?", "avg(lineitem.l_quantity)", "lineitem.l_discount lineitem.l_tax", "", ""),
    (8, "Give the total price of the oldest order.", "select: Give the total price of the oldest order .", "orders.o_totalprice", "", "", ""),
    (9, "How many customrs are there?", "select: number of customers are there ?", "count(customer)", "", "", ""),
)
#: Words of columns of the star schema in plain language.
PLAIN = {"acctbal": "account balance", "totalprice": "total price", "retailprice": "retail price", "extendedprice": "extended price", "orderdate": "order date", "mktsegment": "market segment", "orderpriority": "order priority", "orderstatus": "order status"}
#: Word, base form, stem.
WORDS = (("cities", "city", "city"), ("boxes", "box", "box"), ("oldest", "old", "old"), ("hotter", "hot", "hot"), ("happiness", "happiness", "happy"), ("presumably", "presumably", "presum"), ("provision", "provision", "provid"), ("saying", "saying", "say"), ("maximum", "maximum", "maxim"), ("january", "january", "january"), ("people", "person", "peopl"), ("statuses", "status", "status"), ("cement", "cement", "cem"), ("string", "string", "string"))


def star_catalog_text(catalog: Catalog) -> str:
    """A catalog as one delivery's text; the columns of the star schema in plain words."""
    names, columns = list(catalog.tables), [{"table_idx": -1, "name": "*"}]
    columns += [{"table_idx": i, "name": c} for i, t in enumerate(names) for c in catalog.tables[t]]
    place = {(names[c["table_idx"]], c["name"]): i for i, c in enumerate(columns) if i}
    bare = [re.sub(r"^[a-z]+_", "", c["name"]) for c in columns]
    kinds = ["text", *({"string": "text"}.get(k, "time" if k.startswith(("timestamp", "date")) else "number") for t in names for k in catalog.tables[t].values())]
    row = {
        "table_names_original": names, "column_names": [{**c, "name": PLAIN.get(b, b)} for c, b in zip(columns, bare)], "column_names_original": columns, "column_types": kinds,
        "primary_keys": [place[t, c] for t, c in catalog.primary.items()], "foreign_keys": [{"src": place[f[:2]], "dst": place[f[2:]]} for f in catalog.foreign],
    }
    return json.dumps(row)


def fixture_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and readings of the written-down questions over the star schema."""
    questions = spark.createDataFrame([(f[0], "star", f[1]) for f in FIXTURE], "q_id int, db string, question string")
    catalogs = spark.createDataFrame([("star", star_catalog_text(Catalog.star(spark, sf_dir)))], "db string, catalog string")
    links = spark.createDataFrame([], "q_id int, table_name string, column_name string, cell_value string")
    full = lambda c: F.concat_ws(".", c["table_name"], F.nullif(c["column_name"], F.lit("")))
    item = lambda c: F.when(c["agg"] != "", F.concat(c["agg"], F.lit("("), full(c), F.lit(")"))).otherwise(full(c))
    text = lambda name, of=full: F.array_join(F.transform(name, of), " ")
    parts = F.array_join(F.transform("parts", lambda p: F.concat(p["kind"], F.lit(": "), p["text"])), " | ")
    return annotated(questions, catalogs, links).select("q_id", parts.alias("parts"), text("selected", item).alias("selected"), text("conditions").alias("conditions"), text("grouped").alias("grouped"), text("ordered").alias("ordered"))


def fixture_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(w, lemma(w), stem(w)) for w, _, _ in WORDS], "word string, lemma string, stem string")


QUERIES = {f.__name__: f for f in (question_annotations, question_mentions, question_sections, question_readings, question_checks, question_repair, repair_checks, fixture_readings, fixture_words)}


def _values(rows: tuple) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_CURRENT = "FROM train_spider WHERE question IS NOT NULL AND lower(trim(db_id)) IN (SELECT db FROM cur)"
ORACLES = {
    "question_checks": _ITEMS + f" SELECT count(*) AS questions, 0 AS uncovered, 0 AS outside, 0 AS unknown, 0 AS led_by_condition {_CURRENT}",
    "repair_checks": _ITEMS + f" SELECT count(*) AS questions, 0 AS quotes_left, 0 AS words_changed {_CURRENT}",
    "fixture_readings": f"SELECT q_id, parts, selected, conditions, grouped, ordered FROM (VALUES {_values(FIXTURE)}) t(q_id, question, parts, selected, conditions, grouped, ordered)",
    "fixture_words": f"SELECT * FROM (VALUES {_values(WORDS)}) t(word, lemma, stem)",
}
