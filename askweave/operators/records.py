"""Whole records of the question pipeline: preprocessed from questions and catalog, and ranked for training or evaluation.

Catalogs meet the questions once, by database. Everything else is a row's own: schemas, labels, rankings and texts are array
expressions over the record, so no stage after the join moves a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askweave.functions.sqltext import normalized, schema_names, skeleton
from askweave.functions.text import db_key, words
from askweave.operators.ranking import TOP_COLUMNS, TOP_TABLES, current_catalog, name_words, shared_words, stems
from askweave.operators.skew import join_small

_TEXTS = "array<string>"


def _texts(a: Column) -> Column:
    return F.coalesce(a, F.array().cast(_TEXTS))


def _entries(a: Column) -> Column:
    """No entries where there is no array."""
    return F.coalesce(a, F.filter(F.array(F.get(a, 0)), lambda x: F.lit(False)))


# -- preprocessing -----------------------------------------------------------------------------------------------


def schemas(catalog: DataFrame) -> DataFrame:
    """``db``, ``db_schema``, ``pk``, ``fk`` and ``names`` (of tables, columns, and both) of each current catalog delivery; names in lower case, columns and keys that lead nowhere left out."""
    named = lambda i: F.get("table_names_original", i)
    column = lambda c, pos: F.struct(
        pos.alias("pos"), c["table_idx"].alias("table_idx"), F.lower(named(c["table_idx"])).alias("table"), F.lower(c["name"]).alias("name"), F.get("column_names", pos)["name"].alias("shown"), F.get("column_types", pos).alias("kind")
    )
    real = lambda c: (c["pos"] > 0) & c["name"].isNotNull() & (c["table_idx"] >= 0) & c["table"].isNotNull()
    own = current_catalog(catalog).withColumn("_c", F.filter(F.transform("column_names_original", column), real))
    of = lambda i, field: F.transform(F.filter("_c", lambda c: c["table_idx"] == i), lambda c: c[field])
    tables = F.transform(
        "table_names_original",
        lambda t, i: F.struct(F.lower(t).alias("table_name_original"), F.get("table_names", i).alias("table_name"), of(i, "shown").alias("column_names"), of(i, "name").alias("column_names_original"), of(i, "kind").alias("column_types")),
    )
    at = lambda i: F.get(F.filter("_c", lambda c: c["pos"] == i), 0)
    pk = F.filter(F.transform("primary_keys", lambda i: F.struct(at(i)["table"].alias("table_name_original"), at(i)["name"].alias("column_name_original"))), lambda k: k["column_name_original"].isNotNull())
    pair = lambda p: F.struct(
        at(p["src"])["table"].alias("source_table_name_original"), at(p["src"])["name"].alias("source_column_name_original"), at(p["dst"])["table"].alias("target_table_name_original"), at(p["dst"])["name"].alias("target_column_name_original")
    )
    fk = F.filter(F.transform("foreign_keys", pair), lambda k: k["source_column_name_original"].isNotNull() & k["target_column_name_original"].isNotNull())
    return own.select("db", tables.alias("db_schema"), _entries(pk).alias("pk"), _entries(fk).alias("fk")).withColumn("names", schema_names(F.col("db_schema")))


def query_names(query: Column) -> Column:
    """Names in a query, quoted text aside, in lower case; those led by an alias are led by its table instead."""
    bare = F.lower(F.regexp_replace(query, r"'[^']*'|\"[^\"]*\"", " "))
    names, bound = F.regexp_extract_all(bare, F.lit(r"(\w+(?:\.\w+)?)"), 1), r"(\w+)\s+as\s+(\w+)"
    tables, aliases = F.regexp_extract_all(bare, F.lit(bound), 1), F.regexp_extract_all(bare, F.lit(bound), 2)

    def whole(n: Column) -> Column:
        place = F.array_position(aliases, F.substring_index(n, ".", 1))
        return F.when(n.contains(".") & (place > 0), F.concat_ws(".", F.get(tables, (place - 1).cast("int")), F.substring_index(n, ".", -1))).otherwise(n)

    return F.transform(names, whole)


def preprocessed(questions: DataFrame, catalog: DataFrame, contents: DataFrame) -> DataFrame:
    """The enriched record of every question of a current database: texts, schema with the values it mentions, keys and labels.

    ``contents`` has ``q_id``, ``table_name``, ``column_name`` and ``cell_value``. ``table_labels`` and ``column_labels`` say which items the query names, bare
    or with their table. Typographic quotes of questions are made plain. Null questions and unknown databases have no record.
    """
    q = questions.filter("question is not null").select("q_id", F.translate("question", "‘’“”", "''\"\"").alias("question"), "db_id", F.col("query").alias("sql"), db_key(F.col("db_id")).alias("db"))
    values = contents.groupBy("q_id", F.lower(F.concat_ws(".", "table_name", "column_name")).alias("column")).agg(F.array_sort(F.collect_set("cell_value")).alias("values"))
    values = values.groupBy("q_id").agg(F.collect_list(F.struct("column", "values")).alias("_v"))
    rows = join_small(q, schemas(catalog), "db").join(values, "q_id", "left")
    said = lambda t, c: _texts(F.get(F.filter("_v", lambda v: v["column"] == F.concat_ws(".", t, c)), 0)["values"])
    with_contents = F.transform("db_schema", lambda t: t.withField("db_contents", F.transform(t["column_names_original"], lambda c: said(t["table_name_original"], c))))
    rows = rows.withColumn("_names", F.coalesce(query_names(F.col("sql")), F.array().cast(_TEXTS)))
    names = lambda x: F.array_contains("_names", x).cast("int")
    table_labels = F.transform("db_schema", lambda t: names(t["table_name_original"]))
    column_labels = F.transform("db_schema", lambda t: F.transform(t["column_names_original"], lambda c: F.greatest(names(c), names(F.concat_ws(".", t["table_name_original"], c)))))
    return rows.select(
        "q_id", "question", "db_id", "sql", normalized("sql").alias("norm_sql"), skeleton(F.col("sql"), F.col("names")).alias("sql_skeleton"), with_contents.alias("db_schema"), "pk", "fk", table_labels.alias("table_labels"), column_labels.alias("column_labels"),
    )


# -- ranked records ----------------------------------------------------------------------------------------------


def _items(record: Column, question: Column, seed: Column, scorer=shared_words) -> Column:
    """Tables of a nested schema with score, label and draw, each with its columns likewise; entries without a name left out.

    ``record`` is a struct of ``db_schema``, ``table_labels`` and ``column_labels``; ``seed`` makes the draws.
    """

    def facts(name: Column, own: Column, pos: Column, label: Column, path: Column) -> list[Column]:
        return [pos.alias("pos"), F.round(scorer(question, stems(name_words(own))), 4).alias("prob"), (F.coalesce(label, F.lit(0)) == 1).alias("used"), F.md5(F.concat_ws("|", seed, path)).alias("draw"), F.lower(name).alias("name")]

    def table(t: Column, i: Column) -> Column:
        def column(c: Column, j: Column) -> Column:
            values = F.filter(_texts(F.get(t["db_contents"], j)), lambda v: v.isNotNull() & (F.trim(v) != ""))
            label = F.get(F.get(record["column_labels"], i), j)
            return F.when(c.isNotNull(), F.struct(*facts(c, c, j, label, F.lower(F.concat_ws(".", t["table_name_original"], c))), values.alias("values")))

        columns = F.array_compact(F.transform(_texts(t["column_names_original"]), column))
        own = F.struct(*facts(t["table_name_original"], t["table_name_original"], i, F.get(record["table_labels"], i), F.lower(t["table_name_original"])), columns.alias("columns"))
        return F.when(t["table_name_original"].isNotNull(), own)

    return F.array_compact(F.transform(record["db_schema"], table))


def _ordered(items: Column, *keys) -> Column:
    """The items by keys (functions of an item), then by place."""
    tagged = F.transform(items, lambda x: F.struct(*(k(x).alias(f"k{n}") for n, k in enumerate(keys)), x["pos"].alias("p"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda y: y["x"])


def _best(items: Column, k: int, digits: int) -> Column:
    return F.slice(_ordered(items, lambda x: -F.round(x["prob"], digits)), 1, k)


def _drawn(items: Column, k: int, noise: Column) -> Column:
    """Used items, then others as drawn until there are ``k``; in the order of the draw where ``noise`` says so."""
    padded = _ordered(items, lambda x: (~x["used"]).cast("int"), lambda x: F.when(x["used"], F.lit("")).otherwise(x["draw"]))
    kept = F.filter(F.transform(padded, lambda x, n: F.struct(n.alias("n"), x.alias("x"))), lambda y: (y["n"] < k) | y["x"]["used"])
    kept = F.transform(kept, lambda y: y["x"])
    return F.when(noise, _ordered(kept, lambda x: F.reverse(x["draw"]))).otherwise(kept)


def _chance(path: Column, share: float) -> Column:
    return F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("bigint") < int(share * 2**32)


def _written(tables: Column, question: Column, fk: Column) -> tuple[Column, Column]:
    """The input sequence and its ``table.column`` names: question | table : table.column ( values ) , ... | source = target."""

    def column(t: Column):
        def one(c: Column) -> Column:
            full = F.concat_ws(".", t["name"], c["name"])
            return F.when(F.size(c["values"]) > 0, F.concat(full, F.lit(" ( "), F.array_join(c["values"], " , "), F.lit(" )"))).otherwise(full)

        return one

    texts = F.transform(tables, lambda t: F.concat(t["name"], F.lit(" : "), F.array_join(F.transform(t["columns"], column(t)), " , ")))
    there = F.transform(tables, lambda t: t["name"])
    source, target = (lambda f: F.lower(f["source_table_name_original"])), (lambda f: F.lower(f["target_table_name_original"]))
    kept = F.filter(fk, lambda f: F.array_contains(there, source(f)) & F.array_contains(there, target(f)) & f["source_column_name_original"].isNotNull() & f["target_column_name_original"].isNotNull())
    keys = F.transform(kept, lambda f: F.concat(source(f), F.lit("."), F.lower(f["source_column_name_original"]), F.lit(" = "), target(f), F.lit("."), F.lower(f["target_column_name_original"])))
    names = F.flatten(F.transform(tables, lambda t: F.transform(t["columns"], lambda c: F.concat_ws(".", t["name"], c["name"]))))
    return F.array_join(F.concat(F.array(question), texts, _texts(keys)), " | "), names


def _ranked(records: DataFrame, choose, keep: list[str]) -> DataFrame:
    question = F.coalesce("question", F.lit(""))
    empty = F.array().cast(records.schema["db_schema"].dataType)
    record = F.struct(F.coalesce("db_schema", empty).alias("db_schema"), "table_labels", "column_labels")
    items = records.withColumn("_items", _items(record, stems(words(question)), F.col("rec_id").cast("string")))
    # Each step is a column of its own, so that it is made once.
    out = items.withColumn("_chosen", choose(F.col("_items")))
    text, names = _written(F.col("_chosen"), F.trim(F.regexp_replace(question, r"\s+", " ")), F.col("fk"))
    return out.select("rec_id", *keep, F.regexp_replace(text, " +", " ").alias("input_sequence"), F.concat_ws(" | ", "sql_skeleton", "norm_sql").alias("output_sequence"), F.array_join(names, " ").alias("tc_original"), "_items", "_chosen")


def ranked_for_evaluation(records: DataFrame, tables: int = TOP_TABLES, columns: int = TOP_COLUMNS) -> DataFrame:
    """The best ``tables`` of each record and the best ``columns`` of each, by score rounded to four and two digits, ties in schema order.

    ``rec_id``, ``input_sequence``, ``output_sequence`` (skeleton | query), ``tc_original``; foreign keys stay where both tables do. ``tables_covered`` and
    ``columns_covered``: whether all used items are among the chosen; null where none is used.
    """

    def choose(items: Column) -> Column:
        return F.transform(_best(items, tables, 4), lambda t: t.withField("columns", _best(t["columns"], columns, 2)))

    out = _ranked(records, choose, [])
    used = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x["used"].cast("int"))
    used_columns = lambda xs: F.aggregate(xs, F.lit(0), lambda n, t: n + used(t["columns"]))
    covered = lambda f: F.when(f(F.col("_items")) > 0, f(F.col("_chosen")) == f(F.col("_items")))
    return out.select("rec_id", "input_sequence", "output_sequence", "tc_original", covered(used).alias("tables_covered"), covered(used_columns).alias("columns_covered"))


def ranked_for_training(records: DataFrame, tables: int = TOP_TABLES, columns: int = TOP_COLUMNS, noise: float = 0.08) -> DataFrame:
    """All used tables and columns, others drawn until there are ``tables`` and ``columns``; a share ``noise`` of the lists in drawn order.

    Columns are put in drawn order only in used tables. Draws come from a hash of record and name, so every run gives the same.
    """

    def choose(items: Column) -> Column:
        seed = F.col("rec_id").cast("string")
        own = _drawn(items, tables, _chance(F.concat_ws("|", F.lit("tables"), seed), noise))
        return F.transform(own, lambda t: t.withField("columns", _drawn(t["columns"], columns, t["used"] & _chance(F.concat_ws("|", F.lit("columns"), seed, t["name"]), noise))))

    return _ranked(records, choose, []).select("rec_id", "input_sequence", "output_sequence", "tc_original")


def coverage(ranked: DataFrame) -> DataFrame:
    """The share of records whose used tables, and used columns, are all chosen."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return ranked.agg(F.count("tables_covered").alias("records"), share("tables_covered"), share("columns_covered"))
