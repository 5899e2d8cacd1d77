"""Schema items ranked for a question, cut to the best, measured and serialised.

A scorer gives every table and column of a question's database a probability; the default compares words. Scorers are functions
of two word-array columns (question, item), so any model that runs over Arrow batches can take its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askweave.functions.text import db_key, words
from askweave.operators.skew import join_many

TOP_TABLES, TOP_COLUMNS = 4, 5


def stems(word_list: Column) -> Column:
    """Distinct words, plural endings aside."""
    return F.array_distinct(F.transform(word_list, lambda w: F.regexp_replace(w, "s$", "")))


def shared_words(question: Column, item: Column) -> Column:
    """The share of the item's stems that the question has; both are arrays of :func:`stems`."""
    return F.coalesce(F.size(F.array_intersect(question, item)) / F.nullif(F.size(item), F.lit(0)), F.lit(0.0))


def current_catalog(catalog: DataFrame) -> DataFrame:
    """The latest delivery of each database that has not been withdrawn; of equal times the one with the larger id."""
    newest = F.row_number().over(Window.partitionBy("db").orderBy(F.desc("loaded_at"), F.desc("catalog_id")))
    return catalog.filter("deleted_at is null and db_id is not null").withColumn("db", db_key(F.col("db_id"))).withColumn("_n", newest).filter("_n = 1").drop("_n")


def schema_items(catalog: DataFrame) -> DataFrame:
    """``db``, ``table_pos``, ``table_name``, ``column_pos`` and ``column_name`` of the current catalog; columns that exist only."""
    columns = current_catalog(catalog).select("db", "table_names_original", F.posexplode("column_names_original").alias("column_pos", "c")).filter("column_pos > 0 and c.name is not null and c.table_idx >= 0 and c.table_idx < size(table_names_original)")
    return columns.select("db", F.col("c.table_idx").alias("table_pos"), F.get("table_names_original", F.col("c.table_idx")).alias("table_name"), "column_pos", F.col("c.name").alias("column_name"))


def name_words(name: Column) -> Column:
    """Words of an identifier: cut at underscores and before capitals."""
    return words(F.regexp_replace(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", " "), "_", " "))


def scored(questions: DataFrame, catalog: DataFrame, scorer: Callable[[Column, Column], Column] = shared_words) -> tuple[DataFrame, DataFrame]:
    """Scores of the tables (``q_id``, ``table_pos``, ``table_name``, ``prob``) and of the columns (with ``column_pos``, ``column_name``)."""
    # Stems are made before the joins, once a question and once an item, not once a pair.
    items = schema_items(catalog)
    q = questions.filter("question is not null").select("q_id", db_key(F.col("db_id")).alias("db"), stems(words(F.col("question"))).alias("_q"))
    tables = items.select("db", "table_pos", "table_name").distinct().withColumn("_i", stems(name_words(F.col("table_name"))))
    columns = items.withColumn("_i", stems(name_words(F.col("column_name"))))
    t = join_many(q, tables, "db").select("q_id", "table_pos", "table_name", F.round(scorer(F.col("_q"), F.col("_i")), 4).alias("prob"))
    c = join_many(q, columns, "db").select("q_id", "table_pos", "table_name", "column_pos", "column_name", F.round(scorer(F.col("_q"), F.col("_i")), 4).alias("prob"))
    return t, c


def top_k(scores: DataFrame, group: list[str], ordinal: str, k: int, digits: int) -> DataFrame:
    """The best ``k`` of each group by probability rounded to ``digits``; of equal ones those that come first."""
    best = Window.partitionBy(*group).orderBy(F.desc(F.round("prob", digits)), ordinal)
    return scores.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def coverage(labelled: DataFrame, group: list[str]) -> DataFrame:
    """The share of groups all of whose used items were kept; groups without used items do not count. Columns ``used``, ``kept``."""
    per = labelled.groupBy(*group).agg(F.sum(F.col("used").cast("int")).alias("_u"), F.sum((F.col("used") & F.col("kept")).cast("int")).alias("_k")).filter("_u > 0")
    return per.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg((F.col("_u") == F.col("_k")).cast("double")), 6).alias("coverage"))


def auc(scores: DataFrame, prob: str = "prob", label: str = "label", ranges: int = 1000) -> DataFrame:
    """Area under the ROC curve; equal scores share their rank, however close others are. Null without both classes.

    Rows are summed per score. The scores are cut at ``ranges`` quantiles; what lies below a score is what lies in the ranges below its own (as
    many rows as there are ranges) and below it within the range, so no task orders all scores.
    """
    per = scores.filter(F.col(prob).isNotNull()).groupBy(F.col(prob).alias("p")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    cuts = per.agg(F.array_distinct(F.percentile_approx("p", [i / ranges for i in range(1, ranges)], 10 * ranges)).alias("cuts"))
    per = per.withColumn("one", F.lit(1)).join(F.broadcast(cuts.withColumn("one", F.lit(1))), "one")  # one row
    per = per.select("p", "pos", "neg", F.size(F.filter("cuts", lambda c: c <= F.col("p"))).alias("range"))
    below = per.groupBy("range").agg(F.sum("neg").alias("n"))  # ``ranges`` rows at most
    below = below.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    within = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = per.withColumn("_w", within).join(F.broadcast(below), "range").select("pos", "neg", (F.col("pos") * (F.col("before") + F.col("_w") + F.col("neg") / 2)).alias("a"))
    return area.agg(F.round(F.sum("a") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auc"))


def focal_loss(scores: DataFrame, prob: str = "prob", label: str = "label", gamma: float = 2.0, alpha: float = 0.75) -> DataFrame:
    """Mean of (1 - p)^gamma * -ln(p + 1e-8), weighted alpha for used and 1 - alpha for unused items; p is that of the true class."""
    p = F.when(F.col(label) == 1, F.col(prob)).otherwise(1 - F.col(prob))
    weight = F.when(F.col(label) == 1, alpha).otherwise(1 - alpha)
    loss = F.pow(1 - p, F.lit(gamma)) * -F.log(p + 1e-8) * weight
    return scores.agg(F.round(F.sum(loss) / F.sum(weight), 6).alias("loss"))


def training_items(labelled: DataFrame, group: list[str], name: str, k: int, seed: str = "7") -> DataFrame:
    """Used items always, others in a seeded order until there are ``k``; ``place`` is the item's place in that order."""
    own = F.md5(F.concat_ws("|", F.lit(seed), *group, name))
    order = Window.partitionBy(*group).orderBy(F.desc("used"), own, name)
    return labelled.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= k) | F.col("used"))


def serialised(preprocessed: DataFrame) -> DataFrame:
    """``rec_id`` and ``input_sequence``: question | table : table.column ( values ) , ... | source = target foreign keys.

    Null parts are left out, as are values of a column without a name.
    """
    texts = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))

    def column(t: Column):
        def one(c: Column, i: Column) -> Column:
            values = texts(F.get(t["db_contents"], i))
            name = F.concat(F.lower(t["table_name_original"]), F.lit("."), F.lower(c))
            return F.when(F.size(values) > 0, F.concat(name, F.lit(" ( "), F.array_join(values, " , "), F.lit(" )"))).otherwise(name)

        return one

    def one_table(t: Column) -> Column:
        columns = F.array_compact(F.transform(F.coalesce(t["column_names_original"], F.array().cast("array<string>")), column(t)))
        return F.concat(F.lower(t["table_name_original"]), F.lit(" : "), F.array_join(columns, " , "))

    tables = F.array_compact(F.transform(F.coalesce("db_schema", F.expr("cast(array() as array<struct<table_name_original:string,table_name:string,column_names:array<string>,column_names_original:array<string>,column_types:array<string>,db_contents:array<array<string>>>>)")), one_table))
    keys = F.array_compact(F.transform("fk", lambda f: F.lower(F.concat(f["source_table_name_original"], F.lit("."), f["source_column_name_original"], F.lit(" = "), f["target_table_name_original"], F.lit("."), f["target_column_name_original"]))))
    parts = F.concat(F.array(F.coalesce("question", F.lit(""))), tables, F.coalesce(keys, F.array().cast("array<string>")))
    return preprocessed.select("rec_id", F.array_join(parts, " | ").alias("input_sequence"))


def labels(preprocessed: DataFrame) -> DataFrame:
    """``rec_id``, ``table_pos``, ``column_pos``, ``table_label``, ``column_label``: which items the normalised query names."""
    toks = F.split(F.lower("norm_sql"), " ")
    t = preprocessed.select("rec_id", toks.alias("_toks"), F.posexplode("db_schema").alias("table_pos", "t")).filter("t.table_name_original is not null")
    c = t.select("rec_id", "_toks", "table_pos", F.lower("t.table_name_original").alias("tn"), F.posexplode("t.column_names_original").alias("column_pos", "cn")).filter("cn is not null")
    bare = F.transform("_toks", lambda x: F.regexp_replace(x, r"^\w+\.", ""))
    return c.select("rec_id", "table_pos", "column_pos", F.coalesce(F.array_contains("_toks", F.col("tn")), F.lit(False)).cast("int").alias("table_label"), F.coalesce(F.array_contains(bare, F.lower("cn")), F.lit(False)).cast("int").alias("column_label"))


def report(scores: DataFrame, prob: str = "prob", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of the items at or above a threshold; null where nothing is predicted, or nothing used."""
    hit, used = F.col(prob) >= threshold, F.col(label) == 1
    n = scores.agg(F.count(F.when(hit & used, 1)).alias("tp"), F.count(F.when(hit & ~used, 1)).alias("fp"), F.count(F.when(~hit & used, 1)).alias("fn"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return n.select("tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def windows(sizes: Column, first: Column, limit: int = 512) -> Column:
    """The window of each item of an array of sizes: items in order, each window taking ``first`` (the question) and as many as fit ``limit``.

    An item too large for any window has one of its own. Every item is in exactly one window, so all are scored in one pass.
    """
    start = F.struct(F.lit(0).alias("w"), first.cast("int").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["used"] + x <= limit) | (s["used"] == first.cast("int"))
        w = F.when(fits, s["w"]).otherwise(s["w"] + 1)
        return F.struct(w.alias("w"), F.when(fits, s["used"] + x).otherwise(first.cast("int") + x).alias("used"), F.concat(s["out"], F.array(w)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def input_windows(preprocessed: DataFrame, limit: int = 512) -> DataFrame:
    """``rec_id``, ``table_pos``, ``window`` and ``size`` (words and signs) of each table's text when a record is scored in windows of ``limit``."""
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), 1))
    texts = F.transform("db_schema", lambda t: F.concat_ws(" ", t["table_name_original"], t["column_names_original"], F.flatten(F.filter(t["db_contents"], lambda v: v.isNotNull()))))
    own = preprocessed.select("rec_id", F.transform(texts, count).alias("_s"), count(F.coalesce("question", F.lit(""))).alias("_q")).filter("_s is not null")
    own = own.withColumn("_w", windows(F.col("_s"), F.col("_q"), limit))
    return own.select("rec_id", F.posexplode(F.arrays_zip("_w", "_s")).alias("table_pos", "x")).select("rec_id", "table_pos", F.col("x._w").alias("window"), F.col("x._s").alias("size"))
