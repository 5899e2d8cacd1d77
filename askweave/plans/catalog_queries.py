"""Queries over catalogs: relations, ways to join, types, names and keys; and over both kinds of labelled items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.functions.text import db_key, words
from askweave.operators import linking, profiling, ranking
from askweave.plans.joins import many_to_many, variants
from askweave.plans.pipeline_queries import _ITEMS, _LABELLED, _NORM_INDEX, _labelled, _plain, _score, value_index
from askweave.sources.catalog import STAR_FOREIGN, Catalog
from askweave.sources.tables import table


def column_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of columns of the star schema that hold the same things."""
    star = Catalog.star(spark, sf_dir)
    every = [(t, c) for t, cs in star.tables.items() for c in cs]
    return spark.createDataFrame([(*a, *b) for a in every for b in every if star.related(a, b)], "table_a string, column_a string, table_b string, column_b string")


def join_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to join up to five tables of the star schema."""
    ways = [(len(t), ",".join(sorted(t)), ",".join(sorted(f"{f[1]}={f[3]}" for f in keys))) for t, keys in variants(Catalog.star(spark, sf_dir))]
    return spark.createDataFrame(ways, "size int, tables string, keys string")


def many_to_many_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(many_to_many(Catalog.star(spark, sf_dir)), "table_a string, table_b string, bridge string")


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current catalog columns with their words and declared types."""
    own = ranking.current_catalog(table(spark, sf_dir, "spider_tables"))
    kinds = own.select("db", F.posexplode("column_names_original").alias("column_pos", "_c"), "column_types", "column_names").select("db", "column_pos", F.get("column_types", F.col("column_pos")).alias("declared"), F.get("column_names", F.col("column_pos"))["name"].alias("shown"))
    items = ranking.schema_items(table(spark, sf_dir, "spider_tables")).join(kinds, ["db", "column_pos"])
    return items.select("db", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"), "column_pos", "shown", "declared", ranking.name_words(F.col("column_name")).alias("words"), ranking.name_words(F.col("table_name")).alias("table_words"))


def checked_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.checked_types(_columns(spark, sf_dir), value_index(spark, sf_dir))


def same_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.same_named(_columns(spark, sf_dir))


def compound_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of tables and columns written together, by the words of the names and questions of their database."""
    columns = _columns(spark, sf_dir)
    own = columns.select("db", "words").unionByName(columns.select("db", F.col("table_words").alias("words"))).filter(F.size("words") > 0)
    said = table(spark, sf_dir, "train_spider").filter("question is not null").select(db_key(F.col("db_id")).alias("db"), F.explode(words(F.col("question"))).alias("word"))
    dictionary = said.unionByName(own.select("db", F.explode("words").alias("word"))).filter("db is not null").distinct()
    return profiling.compound_names(own.filter(F.size("words") == 1).select("db", F.get("words", F.lit(0)).alias("name")).distinct(), dictionary)


def single_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary keys of current catalogs; tables with a key of several columns have none of them."""
    own = ranking.current_catalog(table(spark, sf_dir, "spider_tables")).select("db", F.explode("primary_keys").alias("column_pos"))
    keys = _columns(spark, sf_dir).join(own, ["db", "column_pos"]).select("db", "table_name", "column_name").distinct()
    return keys.groupBy("db", "table_name").agg(F.min("column_name").alias("column_name"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def cell_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.cell_spans(table(spark, sf_dir, "train_spider"), value_index(spark, sf_dir))


def starting_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts one of whose texts begins with "blue", a few at most."""
    return linking.starting_with(table(spark, sf_dir, "part"), "Blue a", 1_000_000).select("p_partkey", "p_name")


def _labelled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each question with score and whether the query names them."""
    train = table(spark, sf_dir, "train_spider")
    _, c = ranking.scored(train, table(spark, sf_dir, "spider_tables"))
    used = train.select("q_id", F.regexp_extract_all(F.lower("query"), F.lit(r"(\w+)"), 1).alias("_w"))
    return c.join(used, "q_id").withColumn("label", F.array_contains("_w", F.lower("column_name")).cast("int")).drop("_w")


def classifier_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focal losses of tables and of columns, and their sum."""
    t, c = (ranking.focal_loss(x).withColumn("one", F.lit(1)) for x in (_labelled(spark, sf_dir), _labelled_columns(spark, sf_dir)))
    both = t.withColumnRenamed("loss", "table_loss").join(c.withColumnRenamed("loss", "column_loss"), "one")  # one row each
    return both.select("table_loss", "column_loss", F.round(F.col("table_loss") + F.col("column_loss"), 6).alias("loss"))


def column_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.auc(_labelled_columns(spark, sf_dir))


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of four thresholds of the table scorer, as checkpoints are chosen: by precision, by recall, by their sum."""
    from askweave.plans.selection import best_checkpoints

    rows = None
    for name in ("0.25", "0.50", "0.75", "1.00"):
        one = ranking.report(_labelled(spark, sf_dir), threshold=float(name)).select(F.lit(name).alias("ckpt"), F.col("precision").alias("em"), F.col("recall").alias("ex"))
        rows = one if rows is None else rows.unionByName(one)
    return best_checkpoints(rows)


QUERIES = {f.__name__: f for f in (column_relations, join_variants, many_to_many_tables, checked_types, same_named, compound_names, single_keys, cell_spans, starting_with, classifier_loss, column_auc, best_threshold)}

_KEYS = ", ".join(f"('{a}', '{ac}', '{b}', '{bc}')" for a, ac, b, bc in STAR_FOREIGN)
_COLUMNS = _ITEMS + """,
    kinds AS (SELECT db, unnest(column_types) AS declared, generate_subscripts(column_types, 1) - 1 AS column_pos FROM cur),
    shown AS (SELECT db, unnest(column_names) AS c, generate_subscripts(column_names, 1) - 1 AS column_pos FROM cur),
    cols2 AS (SELECT i.db, lower(table_name) AS table_name, lower(column_name) AS column_name, column_pos, s.c.name AS shown, declared, table_name AS tn, column_name AS cn FROM items i LEFT JOIN kinds USING (db, column_pos) LEFT JOIN shown s USING (db, column_pos))"""
_LABELLED_COLUMNS = _LABELLED + f""",
    clab AS (SELECT q_id, {_score('column_name')} AS prob, CASE WHEN list_contains(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lower(column_name)) THEN 1 ELSE 0 END AS label FROM q JOIN items USING (db))"""


def _focal(rows: str, name: str) -> str:
    return f"(SELECT round(sum(pow(1 - p, 2) * -ln(p + 1e-8) * w) / sum(w), 6) AS {name} FROM (SELECT CASE WHEN label = 1 THEN prob ELSE 1 - prob END AS p, CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END AS w FROM {rows}))"


ORACLES = {
    "column_relations": f"""
        WITH k(a, ac, b, bc) AS (VALUES {_KEYS})
        SELECT a AS table_a, ac AS column_a, b AS table_b, bc AS column_b FROM k UNION SELECT b, bc, a, ac FROM k""",
    "join_variants": f"""
        WITH RECURSIVE k(a, ac, b, bc) AS (VALUES {_KEYS}), e AS (SELECT a, b, ac || '=' || bc AS k FROM k),
        v(ts, ks) AS (SELECT [t], CAST([] AS VARCHAR[]) FROM (SELECT a AS t FROM e UNION SELECT b FROM e)
          UNION SELECT list_sort(list_append(ts, CASE WHEN list_contains(ts, a) THEN b ELSE a END)), list_sort(list_append(ks, k)) FROM v, e WHERE len(ts) < 5 AND list_contains(ts, a) <> list_contains(ts, b))
        SELECT CAST(len(ts) AS INTEGER) AS size, array_to_string(ts, ',') AS tables, array_to_string(ks, ',') AS keys FROM v""",
    "many_to_many_tables": f"WITH k(a, ac, b, bc) AS (VALUES {_KEYS}) SELECT DISTINCT x.b AS table_a, y.b AS table_b, x.a AS bridge FROM k x JOIN k y ON x.a = y.a AND x.b < y.b",
    "checked_types": _COLUMNS + _NORM_INDEX.replace("WITH t AS", ", nt AS").replace("FROM t)", "FROM nt)").replace(" c AS (SELECT db, lower(t.table_name_original)", " nc AS (SELECT db, lower(t.table_name_original)").replace("AS cell_value FROM c)", "AS cell_value FROM nc)") + f""",
        v AS (SELECT db, table_name, column_name, cell_value, lower(trim(cell_value)) AS v FROM ix),
        s AS (SELECT db, table_name, column_name, count(*) AS n, min(v) AS low, max(v) AS high, count(*) FILTER (regexp_matches(v, '^\\p{{L}}')) AS letters, count(*) FILTER (regexp_matches(v, '^-?\\d+(\\.\\d+)?([eE]-?\\d+)?$')) AS numbers,
          count(*) FILTER (regexp_matches(v, '^\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}([ t].*)?$|^\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?$')) AS dates, count(*) FILTER (regexp_matches(v, '^[12]\\d{{3}}$')) AS years FROM v GROUP BY ALL),
        k AS (SELECT *, CASE WHEN n > 7 THEN 1 ELSE 0 END AS spare, CASE WHEN column_name LIKE '%date' OR column_name LIKE '%time' THEN 'time' WHEN column_name LIKE '%year' THEN 'year' ELSE 'unknown' END AS by_name FROM s),
        f AS (SELECT db, table_name, column_name, CASE WHEN n = 2 AND low || '/' || high IN ({', '.join(f"'{a}/{b}'" for a, b in profiling.BOOLEAN_PAIRS)}) THEN 'boolean' WHEN letters > spare THEN 'text' WHEN n = 1 THEN by_name WHEN dates >= n - spare THEN 'time'
          WHEN years >= n - spare AND column_name LIKE '%year%' THEN 'year' WHEN numbers >= n - spare THEN 'number' ELSE 'text' END AS kind FROM k)
        SELECT db, table_name, column_name, declared, CASE WHEN contains(lower(shown), ' or ') AND declared = 'text' THEN 'boolean' ELSE coalesce(kind, declared) END AS kind FROM cols2 LEFT JOIN (SELECT * FROM f WHERE kind <> 'unknown') USING (db, table_name, column_name)""",
    "same_named": _COLUMNS + f""",
        w AS (SELECT db, table_name, column_name, declared, list_transform({_plain('cn')}, lambda x: regexp_replace(x, 's$', '')) AS w, list_transform({_plain('tn')}, lambda x: regexp_replace(x, 's$', '')) AS t FROM cols2),
        w2 AS (SELECT * FROM w WHERE len(w) > 1)
        SELECT a.db, a.table_name AS table_a, a.column_name AS column_a, b.table_name AS table_b, b.column_name AS column_b, len(list_intersect(a.w, a.t)) > 0 OR len(list_intersect(a.w, b.t)) > 0 AS shares_table
        FROM w2 a JOIN w2 b ON a.db = b.db AND a.w = b.w AND a.declared = b.declared AND (a.table_name < b.table_name OR a.table_name = b.table_name AND a.column_name < b.column_name)""",
    "compound_names": _COLUMNS + f""",
        n AS (SELECT db, {_plain('cn')} AS ws FROM cols2 UNION ALL SELECT db, {_plain('tn')} FROM cols2),
        d AS (SELECT DISTINCT db, unnest(ws) AS word FROM n UNION SELECT lower(trim(db_id)), unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) FROM train_spider WHERE question IS NOT NULL),
        o AS (SELECT DISTINCT db, ws[1] AS name FROM n WHERE len(ws) = 1 AND length(ws[1]) >= 6),
        h AS (SELECT db, name, name[1:k] AS first, name[k + 1:] AS second FROM (SELECT db, name, unnest(range(3, length(name) - 2)) AS k FROM o))
        SELECT DISTINCT h.db, name, first, second FROM h JOIN d a ON a.db = h.db AND a.word = first JOIN d b ON b.db = h.db AND b.word = second""",
    "single_keys": _COLUMNS + """,
        k AS (SELECT DISTINCT c.db, table_name, column_name FROM (SELECT db, unnest(primary_keys) AS column_pos FROM cur) p JOIN cols2 c USING (db, column_pos))
        SELECT db, table_name, min(column_name) AS column_name FROM k GROUP BY db, table_name HAVING count(*) = 1""",
    "cell_spans": _NORM_INDEX + """,
        v AS (SELECT DISTINCT db, table_name, column_name, list_transform(w, lambda x: regexp_replace(x, 's$', ''))[1:6] AS v, len(w) = 1 AS whole FROM (SELECT db, table_name, column_name, regexp_extract_all(lower(cell_value), '[\\p{L}\\p{N}]+') AS w FROM ix) WHERE len(w) > 0),
        q AS (SELECT DISTINCT q_id, lower(trim(db_id)) AS db, regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+') AS w FROM train_spider WHERE question IS NOT NULL),
        p AS (SELECT q_id, db, w[k] AS said, k - 1 AS pos, list_transform(w[k:k + 5], lambda x: regexp_replace(x, 's$', '')) AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM q)),
        m AS (SELECT q_id, pos, table_name, column_name, said, whole, len(list_filter(range(1, 7), lambda n: n <= len(v) AND n <= len(rest) AND v[1:n] = rest[1:n])) AS span FROM p JOIN v ON p.db = v.db AND v.v[1] = rest[1] WHERE said NOT IN (""" + ", ".join("'" + w + "'" for w in sorted(linking.STOP_WORDS)) + """)),
        k AS (SELECT DISTINCT q_id, pos, span, table_name, column_name FROM m WHERE span > 1 OR whole OR NOT regexp_matches(said, '^(\\d+|.{1,2})$'))
        SELECT q_id, CAST(pos AS INTEGER) AS pos, CAST(span AS INTEGER) AS span, table_name, column_name FROM (SELECT *, max(span) OVER (PARTITION BY q_id, pos) AS most FROM k) WHERE span = most""",
    "starting_with": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'blue a%' OR p_brand ILIKE 'blue a%' OR p_type ILIKE 'blue a%'",
    "classifier_loss": _LABELLED_COLUMNS + f" SELECT table_loss, column_loss, round(table_loss + column_loss, 6) AS loss FROM {_focal('lab', 'table_loss')}, {_focal('clab', 'column_loss')}",
    "column_auc": _LABELLED_COLUMNS + """,
        p AS (SELECT prob, sum(label) AS pos, sum(1 - label) AS neg FROM clab GROUP BY prob),
        a AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS a FROM p)
        SELECT round(sum(a) / (sum(pos) * sum(neg)), 6) AS auc FROM a""",
    "best_threshold": _LABELLED + """,
        c AS (SELECT ckpt, round(count(*) FILTER (prob >= th AND label = 1) / nullif(count(*) FILTER (prob >= th), 0), 6) AS em, round(count(*) FILTER (prob >= th AND label = 1) / nullif(count(*) FILTER (label = 1), 0), 6) AS ex
          FROM lab, (VALUES ('0.25', 0.25), ('0.50', 0.5), ('0.75', 0.75), ('1.00', 1.0)) t(ckpt, th) GROUP BY ckpt)
        (SELECT 'em' AS goal, * FROM c ORDER BY em DESC, ex DESC, ckpt LIMIT 1) UNION ALL (SELECT 'ex', * FROM c ORDER BY ex DESC, em DESC, ckpt LIMIT 1) UNION ALL (SELECT 'sum', * FROM c ORDER BY em + ex DESC, ckpt LIMIT 1)""",
}
