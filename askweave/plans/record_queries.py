"""Queries that make whole records: preprocessed questions, ranked records, and repaired, run and compared predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.functions.sqltext import normalized
from askweave.functions.text import db_key
from askweave.operators import records
from askweave.operators.skew import join_small
from askweave.plans.engine import Engine
from askweave.plans.generation import decoded
from askweave.plans.pipeline_queries import _ITEMS, _NORM_INDEX, value_match_exact
from askweave.plans.selection import exact_matches, same_results
from askweave.plans.star_queries import SHORTHANDS
from askweave.sources.tables import table


def _preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.preprocessed(table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "spider_tables"), value_match_exact(spark, sf_dir))


def preprocess_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched records of all training questions, their nested parts written as texts."""
    t, join = "db_schema", lambda c, sep=" ": F.array_join(c, sep)
    names = F.flatten(F.transform(t, lambda x: F.transform(x["column_names_original"], lambda c: F.concat_ws(".", x["table_name_original"], c))))
    said = F.flatten(F.transform(t, lambda x: F.transform(x["db_contents"], lambda v, i: F.when(F.size(v) > 0, F.concat(x["table_name_original"], F.lit("."), F.get(x["column_names_original"], i), F.lit("="), F.array_join(v, "|"))))))
    dotted = lambda k, a, b: F.concat_ws(".", k[a], k[b])
    pk = F.transform("pk", lambda k: dotted(k, "table_name_original", "column_name_original"))
    fk = F.transform("fk", lambda k: F.concat(dotted(k, "source_table_name_original", "source_column_name_original"), F.lit("="), dotted(k, "target_table_name_original", "target_column_name_original")))
    return _preprocessed(spark, sf_dir).select(
        "q_id", "question", "sql", join(F.transform(t, lambda x: x["table_name_original"])).alias("tables"), join(names).alias("columns"), join(F.array_compact(said), " ; ").alias("contents"), join(pk).alias("pk"), join(fk).alias("fk"),
        join(F.transform("table_labels", lambda x: x.cast("string"))).alias("table_labels"), join(F.transform(F.flatten("column_labels"), lambda x: x.cast("string"))).alias("column_labels"),
    )


def preprocess_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form and skeleton of the training queries, as the enriched records have them."""
    return _preprocessed(spark, sf_dir).select("q_id", "norm_sql", "sql_skeleton")


def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "preprocessed_dataset").select("rec_id", normalized("sql").alias("norm"))


def ranked_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ranked_for_evaluation(table(spark, sf_dir, "preprocessed_dataset"))


def ranked_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.coverage(ranked_eval(spark, sf_dir))


def ranked_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ranked_for_training(table(spark, sf_dir, "preprocessed_dataset"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each training query: a text that is no query, the query with every long name a letter short, and the query itself."""
    q = table(spark, sf_dir, "train_spider").filter("question is not null and query <> ''").select("q_id", db_key(F.col("db_id")).alias("db"), "query").distinct()
    short = F.regexp_replace("query", r"(?<!['\"\w])(?i)(?!select\b|except\b|having\b)([a-z_]{5,})[a-z_](?![\w'\"])", "$1")
    texts = F.array(F.lit("select ( _"), F.concat(F.lit("select _ from _ | "), short), F.col("query"))
    return q.select("q_id", "db", F.posexplode(texts).alias("place", "text"))


def decode_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first readable candidate of each training question, repaired and compiled on the executors."""
    return decoded(_candidates(spark, sf_dir), table(spark, sf_dir, "spider_tables"))


def decode_shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorthands of the preprocessed records with every name a letter short, repaired, compiled, and compared with the record's query."""
    own = table(spark, sf_dir, "preprocessed_dataset").filter("norm_natsql is not null and norm_sql is not null").select("rec_id", db_key(F.col("db_id")).alias("db"), "norm_natsql", "norm_sql")
    short = F.regexp_replace("norm_natsql", r"(\w+\.[a-z_]{4,})[a-z_](?!\w)", "$1")
    out = decoded(own.select(F.col("rec_id").alias("q_id"), "db", F.lit(0).alias("place"), short.alias("text")), table(spark, sf_dir, "spider_tables"), shorthand=True)
    return out.join(own, F.col("q_id") == F.col("rec_id")).select("rec_id", "place", "sql", exact_matches("sql", "norm_sql").alias("matches"))


def decode_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of :func:`decode_batch`: questions answered; texts chosen that are no query; names left that no catalog of the database has."""
    chosen = decode_batch(spark, sf_dir).join(table(spark, sf_dir, "train_spider").select("q_id", db_key(F.col("db_id")).alias("db")).distinct(), "q_id")
    both = join_small(chosen, records.schemas(table(spark, sf_dir, "spider_tables")), "db")
    dotted = F.filter(records.query_names(F.col("sql")), lambda n: n.rlike(r"^[a-z_]\w*\."))
    return both.agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("place") == 0, 1)).alias("unread_chosen"), F.count(F.when(F.size(F.array_except(dotted, "names")) > 0, 1)).alias("unknown_names"))


def emitted_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shorthand query of the star schema: whether its plan gives the rows that the SQL written out for it gives."""
    engine = Engine(spark, sf_dir)
    pairs = [(lambda t=t, o=o: engine.shorthand(t, options=o), lambda t=t, o=o: engine.sql(engine.explain(t, o))) for t, o in SHORTHANDS.values()]
    return spark.createDataFrame(list(zip(SHORTHANDS, same_results(pairs))), "name string, matches boolean")


QUERIES = {f.__name__: f for f in (preprocess_records, preprocess_texts, normalize_records, ranked_eval, ranked_coverage, ranked_train, decode_batch, decode_shorthand, decode_checks, emitted_sql)}


def _score(name: str) -> str:
    own = f"list_distinct(list_transform(regexp_extract_all(lower(regexp_replace(regexp_replace({name}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '_', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_replace(w, 's$', '')))"
    return f"round(coalesce(len(list_intersect(qw, {own})) / nullif(len({own}), 0), 0.0), 4)"


_RANKED = f"""
    WITH r AS (SELECT *, list_distinct(list_transform(regexp_extract_all(lower(coalesce(question, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_replace(w, 's$', ''))) AS qw FROM preprocessed_dataset),
    t0 AS (SELECT rec_id, qw, unnest(db_schema) AS t, generate_subscripts(db_schema, 1) - 1 AS tp, table_labels, column_labels FROM r),
    t1 AS (SELECT rec_id, qw, t, tp, lower(t.table_name_original) AS tn, {_score('t.table_name_original')} AS prob, coalesce(table_labels[tp + 1], 0) = 1 AS used, column_labels[tp + 1] AS cl FROM t0 WHERE t.table_name_original IS NOT NULL),
    c0 AS (SELECT rec_id, qw, tp, tn, used AS t_used, cl, t.db_contents AS dc, unnest(t.column_names_original) AS cn, generate_subscripts(t.column_names_original, 1) - 1 AS cp FROM t1),
    c1 AS (SELECT rec_id, tp, tn, t_used, cp, tn || '.' || lower(cn) AS full_name, {_score('cn')} AS prob, coalesce(cl[cp + 1], 0) = 1 AS used,
      list_filter(coalesce(dc[cp + 1], []), lambda v: v IS NOT NULL AND trim(v) <> '') AS vs FROM c0 WHERE cn IS NOT NULL)"""
_TEXT = """,
    cs AS (SELECT rec_id, tp, string_agg(full_name || CASE WHEN len(vs) > 0 THEN ' ( ' || array_to_string(vs, ' , ') || ' )' ELSE '' END, ' , ' ORDER BY place) AS cols, string_agg(full_name, ' ' ORDER BY place) AS names FROM c2 GROUP BY ALL),
    ts AS (SELECT rec_id, string_agg(tn || ' : ' || coalesce(cols, ''), ' | ' ORDER BY place) AS texts, string_agg(names, ' ' ORDER BY place) AS names, list(tn) AS tns FROM t2 LEFT JOIN cs USING (rec_id, tp) GROUP BY rec_id),
    f0 AS (SELECT rec_id, unnest(fk) AS f, generate_subscripts(fk, 1) AS fp FROM r),
    fs AS (SELECT rec_id, string_agg(lower(f.source_table_name_original) || '.' || lower(f.source_column_name_original) || ' = ' || lower(f.target_table_name_original) || '.' || lower(f.target_column_name_original), ' | ' ORDER BY fp) AS keys
      FROM f0 JOIN ts USING (rec_id) WHERE list_contains(tns, lower(f.source_table_name_original)) AND list_contains(tns, lower(f.target_table_name_original)) AND f.source_column_name_original IS NOT NULL AND f.target_column_name_original IS NOT NULL GROUP BY rec_id),
    o AS (SELECT r.rec_id, regexp_replace(concat_ws(' | ', trim(regexp_replace(coalesce(question, ''), '\\s+', ' ', 'g')), texts, keys), ' +', ' ', 'g') AS input_sequence, concat_ws(' | ', sql_skeleton, norm_sql) AS output_sequence, coalesce(names, '') AS tc_original
      FROM r LEFT JOIN ts USING (rec_id) LEFT JOIN fs USING (rec_id))"""
_EVAL = _RANKED + """,
    t2 AS (SELECT * FROM (SELECT rec_id, tp, tn, used, row_number() OVER (PARTITION BY rec_id ORDER BY round(prob, 4) DESC, tp) AS place FROM t1) WHERE place <= 4),
    c2 AS (SELECT * FROM (SELECT c1.*, row_number() OVER (PARTITION BY rec_id, tp ORDER BY round(prob, 2) DESC, cp) AS place FROM c1) WHERE place <= 5)""" + _TEXT + """,
    tu AS (SELECT rec_id, sum(CAST(used AS INTEGER)) AS every FROM t1 GROUP BY 1), tk AS (SELECT rec_id, sum(CAST(used AS INTEGER)) AS kept FROM t2 GROUP BY 1),
    cu AS (SELECT rec_id, sum(CAST(used AS INTEGER)) AS c_every FROM c1 GROUP BY 1), ck AS (SELECT rec_id, sum(CAST(c2.used AS INTEGER)) AS c_kept FROM c2 JOIN t2 USING (rec_id, tp) GROUP BY 1),
    e AS (SELECT o.*, CASE WHEN every > 0 THEN every = kept END AS tables_covered, CASE WHEN c_every > 0 THEN c_every = coalesce(c_kept, 0) END AS columns_covered FROM o LEFT JOIN tu USING (rec_id) LEFT JOIN tk USING (rec_id) LEFT JOIN cu USING (rec_id) LEFT JOIN ck USING (rec_id))"""
_CHANCE = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) < 343597383"

ORACLES = {
    "preprocess_records": _ITEMS + _NORM_INDEX.replace("WITH t AS", ", nt AS").replace("FROM t)", "FROM nt)").replace("c AS (SELECT db, lower(t.table_name_original) AS table_name", "nc AS (SELECT db, lower(t.table_name_original) AS table_name").replace("AS i, t FROM nt)", "AS i, t FROM nt)").replace("AS cell_value FROM c)", "AS cell_value FROM nc)") + """,
        tq AS (SELECT q_id, lower(trim(db_id)) AS db, translate(question, '‘’“”', '''''""') AS question, ' ' || array_to_string(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS said, query,
          regexp_replace(lower(query), '''[^'']*''|"[^"]*"', ' ', 'g') AS bare FROM train_spider WHERE question IS NOT NULL),
        al AS (SELECT *, regexp_extract_all(bare, '(\\w+)\\s+as\\s+(\\w+)', 1) AS ats, regexp_extract_all(bare, '(\\w+)\\s+as\\s+(\\w+)', 2) AS aas FROM tq),
        nm AS (SELECT *, list_transform(coalesce(regexp_extract_all(bare, '\\w+(?:\\.\\w+)?'), []), lambda n: CASE WHEN contains(n, '.') AND list_contains(aas, split_part(n, '.', 1)) THEN ats[list_position(aas, split_part(n, '.', 1))] || '.' || split_part(n, '.', 2) ELSE n END) AS names FROM al JOIN cur USING (db)),
        it AS (SELECT db, table_pos, column_pos, lower(table_name) AS tn, lower(column_name) AS cn FROM items),
        lb AS (SELECT q_id, string_agg(tn || '.' || cn, ' ' ORDER BY table_pos, column_pos) AS columns, string_agg(CASE WHEN list_contains(names, cn) OR list_contains(names, tn || '.' || cn) THEN '1' ELSE '0' END, ' ' ORDER BY table_pos, column_pos) AS column_labels FROM nm JOIN it USING (db) GROUP BY q_id),
        vs AS (SELECT q_id, table_name AS tn, column_name AS cn, string_agg(cell_value, '|' ORDER BY cell_value) AS v FROM (SELECT DISTINCT q_id, table_name, column_name, cell_value FROM tq JOIN ix USING (db) WHERE len(regexp_extract_all(lower(cell_value), '[\\p{L}\\p{N}]+')) > 0
          AND contains(said, ' ' || array_to_string(regexp_extract_all(lower(cell_value), '[\\p{L}\\p{N}]+'), ' ') || ' ')) GROUP BY ALL),
        cv AS (SELECT q_id, string_agg(tn || '.' || cn || '=' || v, ' ; ' ORDER BY table_pos, column_pos) AS contents FROM nm JOIN it USING (db) JOIN vs USING (q_id, tn, cn) GROUP BY q_id),
        pk AS (SELECT db, string_agg(tn || '.' || cn, ' ' ORDER BY o) AS pk FROM (SELECT db, unnest(primary_keys) AS column_pos, generate_subscripts(primary_keys, 1) AS o FROM cur) JOIN it USING (db, column_pos) GROUP BY db),
        fk AS (SELECT x.db, string_agg(a.tn || '.' || a.cn || '=' || b.tn || '.' || b.cn, ' ' ORDER BY o) AS fk FROM (SELECT db, unnest(foreign_keys) AS p, generate_subscripts(foreign_keys, 1) AS o FROM cur) x JOIN it a ON a.db = x.db AND a.column_pos = p.src JOIN it b ON b.db = x.db AND b.column_pos = p.dst GROUP BY x.db)
        SELECT q_id, question, query AS sql, array_to_string(list_transform(table_names_original, lambda t: lower(t)), ' ') AS tables, coalesce(columns, '') AS columns, coalesce(contents, '') AS contents, coalesce(pk, '') AS pk, coalesce(fk, '') AS fk,
          array_to_string(list_transform(table_names_original, lambda t: CASE WHEN list_contains(names, lower(t)) THEN '1' ELSE '0' END), ' ') AS table_labels, coalesce(column_labels, '') AS column_labels
        FROM nm LEFT JOIN lb USING (q_id) LEFT JOIN cv USING (q_id) LEFT JOIN pk USING (db) LEFT JOIN fk USING (db)""",
    # The given normal forms keep aliases; here they go, two of them at most as in all rows.
    "normalize_records": """
        WITH a AS (SELECT rec_id, norm_sql AS s, regexp_extract(norm_sql, '(\\w+) as t1\\b', 1) AS x, regexp_extract(norm_sql, '(\\w+) as t2\\b', 1) AS y FROM preprocessed_dataset)
        SELECT rec_id, regexp_replace(regexp_replace(replace(replace(s, ' as t1', ''), ' as t2', ''), '\\bt1\\.', x || '.', 'g'), '\\bt2\\.', y || '.', 'g') AS norm FROM a""",
    "decode_checks": """
        SELECT count(*) AS questions, 0 AS unread_chosen, 0 AS unknown_names FROM (SELECT DISTINCT q_id, lower(trim(db_id)) AS db FROM train_spider WHERE question IS NOT NULL AND query <> '')
        WHERE db IN (SELECT lower(trim(db_id)) FROM spider_tables WHERE deleted_at IS NULL AND db_id IS NOT NULL)""",
    "emitted_sql": "SELECT name, true AS matches FROM (VALUES " + ", ".join(f"('{n}')" for n in SHORTHANDS) + ") t(name)",
    "ranked_eval": _EVAL + " SELECT * FROM e",
    "ranked_coverage": _EVAL + " SELECT count(tables_covered) AS records, round(avg(CAST(tables_covered AS INTEGER)), 6) AS tables_covered, round(avg(CAST(columns_covered AS INTEGER)), 6) AS columns_covered FROM e",
    "ranked_train": _RANKED + f""",
        t2 AS (SELECT rec_id, tp, tn, used, CASE WHEN {_CHANCE.format("'tables|' || rec_id")} THEN row_number() OVER (PARTITION BY rec_id ORDER BY reverse(md5(rec_id || '|' || tn)), tp) ELSE n END AS place
          FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY used DESC, CASE WHEN used THEN '' ELSE md5(rec_id || '|' || tn) END, tp) AS n FROM t1) WHERE n <= 4 OR used),
        c2 AS (SELECT rec_id, tp, full_name, vs, used, CASE WHEN t_used AND {_CHANCE.format("'columns|' || rec_id || '|' || tn")} THEN row_number() OVER (PARTITION BY rec_id, tp ORDER BY reverse(md5(rec_id || '|' || full_name)), cp) ELSE n END AS place
          FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, tp ORDER BY used DESC, CASE WHEN used THEN '' ELSE md5(rec_id || '|' || full_name) END, cp) AS n FROM c1) WHERE n <= 5 OR used)""" + _TEXT + " SELECT * FROM o",
}
