"""Queries of the question pipeline: query texts, profiles, value links, ranking, selection and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.functions import question
from askweave.functions.question import filled_values, pattern_counts, question_segments, question_tags, stripped_values
from askweave.functions.sqltext import normalized, schema_names, skeletons
from askweave.functions.text import db_key
from askweave.operators import linking, profiling, ranking
from askweave.plans.engine import Engine
from askweave.plans.generation import generated
from askweave.plans.joins import all_paths, bridges, closure
from askweave.plans.selection import PLACEHOLDER, best_checkpoints, choose, exact_matches, repair, same_result
from askweave.sources.catalog import STAR_FOREIGN, STAR_PRIMARY, Catalog, catalog_frames
from askweave.sources.files import star_columns
from askweave.sources.tables import table

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


# -- query texts -------------------------------------------------------------------------------------------------


def normalize_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "train_spider").select("q_id", normalized("query").alias("norm"))


def sql_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the records' queries, by the names of their own schema and of all deliveries of their database's catalog."""
    named = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    names = F.concat(named(F.col("table_names_original")), named(F.transform("column_names_original", lambda c: c["name"])))
    every = table(spark, sf_dir, "spider_tables").filter("db_id is not null").select(db_key(F.col("db_id")).alias("db"), F.explode(names).alias("n")).groupBy("db").agg(F.collect_set("n").alias("names"))
    own = table(spark, sf_dir, "preprocessed_dataset").select("rec_id", "sql", "db_schema", db_key(F.col("db_id")).alias("db")).join(every, "db", "left")
    return skeletons(own, "rec_id", F.col("sql"), F.concat(schema_names(F.col("db_schema")), F.coalesce("names", F.array().cast("array<string>"))))


def schema_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.labels(table(spark, sf_dir, "preprocessed_dataset"))


# -- questions ---------------------------------------------------------------------------------------------------


def question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every training question with its tag."""
    return table(spark, sf_dir, "train_spider").filter("question is not null").select("q_id", F.posexplode(question_tags("question")).alias("pos", "t")).select("q_id", "pos", "t.text", "t.tag")


def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "train_spider").filter("question is not null").select("q_id", F.posexplode(question_segments("question")).alias("pos", "s")).select("q_id", "pos", "s.kind", "s.text")


#: Patterns that tell the kind of a condition.
PATTERNS = {"comparison": "$GR $SM _ than NUM", "over": "GR NUM", "under": "SM NUM", "between": "between NUM and NUM", "top": "top NUM", "superlative": "the JJS"}


def question_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training questions in which each pattern stands, and how often."""
    counts = pattern_counts(list(PATTERNS.values()))(F.col("question"))
    each = table(spark, sf_dir, "train_spider").filter("question is not null").select(F.posexplode(counts).alias("p", "n"))
    each = each.select(F.get(F.array(*map(F.lit, PATTERNS)), F.col("p")).alias("pattern"), "n")
    return each.groupBy("pattern").agg(F.count(F.when(F.col("n") > 0, 1)).alias("questions"), F.sum("n").alias("places"))


def fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training queries stripped of their literals, and filled again from their questions."""
    bare = table(spark, sf_dir, "train_spider").filter("question is not null").select("q_id", "question", "query", stripped_values("query").alias("stripped"))
    filled = bare.withColumn("filled", filled_values("stripped", "question"))
    return filled.select("q_id", "stripped", "filled", (F.lower(normalized("filled")) == F.lower(normalized("query"))).alias("restored"))


# -- profiles and catalog ------------------------------------------------------------------------------------------


def _values(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = STAR) -> DataFrame:
    return profiling.distinct_values({n: table(spark, sf_dir, n) for n in names})


def profile_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.uniqueness(_values(spark, sf_dir))


def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = profiling.distinct_values({n: df.select(*[c for c, t in df.dtypes if t == "string"]) for n in STAR if (df := table(spark, sf_dir, n))})
    return profiling.samples(texts)


def profile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.types(_values(spark, sf_dir))


def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {n: table(spark, sf_dir, n).select(*cols) for n, cols in {"nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "orders": ["o_orderkey", "o_custkey"]}.items()}
    return profiling.same_content(profiling.distinct_values(keys))


def same_content_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`profiling.same_content` over all plain columns of all catalog tables, keys or not."""
    return profiling.same_content(_values(spark, sf_dir, tuple(Catalog.star(spark, sf_dir).tables)))


def fk_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(closure(Catalog.star(spark, sf_dir).foreign)), "src_table string, src_column string, dst_table string, dst_column string")


def join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = all_paths(Catalog.star(spark, sf_dir))
    return spark.createDataFrame([(i, len(p), ",".join(sorted(p))) for i, p in enumerate(paths)], "path int, size int, tables string")


def bridge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in bridges(Catalog.star(spark, sf_dir))], "table_name string")


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_frames(spark, Catalog.star(spark, sf_dir))["cat_columns"]


def star_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_columns(table(spark, sf_dir, "spider_tables"))


# -- value links ---------------------------------------------------------------------------------------------------


def value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.value_index(table(spark, sf_dir, "preprocessed_dataset"))


def value_match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.exact_matches(table(spark, sf_dir, "train_spider"), value_index(spark, sf_dir))


def value_match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.fuzzy_matches(table(spark, sf_dir, "train_spider"), value_index(spark, sf_dir))


# -- ranking -------------------------------------------------------------------------------------------------------


def topk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = ranking.scored(table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "spider_tables"))
    return ranking.top_k(t, ["q_id"], "table_pos", ranking.TOP_TABLES, 4)


def topk_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = ranking.scored(table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "spider_tables"))
    return ranking.top_k(c, ["q_id", "table_pos"], "column_pos", ranking.TOP_COLUMNS, 2)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each question with score and whether the query names them."""
    train = table(spark, sf_dir, "train_spider")
    t, _ = ranking.scored(train, table(spark, sf_dir, "spider_tables"))
    used = train.select("q_id", F.regexp_extract_all(F.lower("query"), F.lit(r"(\w+)"), 1).alias("_w"))
    return t.join(used, "q_id").withColumn("label", F.array_contains("_w", F.lower("table_name")).cast("int")).drop("_w")


def table_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    ranked = ranking.top_k(labelled, ["q_id"], "table_pos", 1_000_000, 4).withColumn("kept", F.col("place") <= 2).withColumn("used", F.col("label") == 1)
    return ranking.coverage(ranked, ["q_id"])


def table_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.auc(_labelled(spark, sf_dir))


def table_focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.focal_loss(_labelled(spark, sf_dir))


def training_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir).select("q_id", "table_name", (F.col("label") == 1).alias("used"))
    return ranking.training_items(labelled, ["q_id"], "table_name", 2)


def serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.serialised(table(spark, sf_dir, "preprocessed_dataset"))


def table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.report(_labelled(spark, sf_dir))


def input_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.input_windows(table(spark, sf_dir, "preprocessed_dataset"), 128)


def schema_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ranking.schema_items(table(spark, sf_dir, "spider_tables"))
    columns = items.select("db", "table_name", "column_name", ranking.name_words(F.col("column_name")).alias("item_words"))
    tables = items.select("db", "table_name", F.lit(None).cast("string").alias("column_name"), ranking.name_words(F.col("table_name")).alias("item_words")).distinct()
    return linking.schema_links(table(spark, sf_dir, "train_spider"), columns.unionByName(tables))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names in words, without their table's name in front where something is left."""
    items = ranking.schema_items(table(spark, sf_dir, "spider_tables"))
    full, own = F.array_join(ranking.name_words(F.col("column_name")), " "), F.regexp_replace(F.array_join(ranking.name_words(F.col("table_name")), " "), "s$", "")
    return items.select("db", "table_pos", "column_pos", F.when(full.startswith(F.concat(own, F.lit(" "))), F.substring(full, F.length(own) + 2, F.length(full))).otherwise(full).alias("display_name"))


def unique_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys that are in fact unique: one child at most for each parent."""
    catalog = Catalog.star(spark, sf_dir)
    keys = spark.createDataFrame(list(catalog.foreign), "table_name string, column_name string, dst_table string, dst_column string")
    children = {t: table(spark, sf_dir, t).select(*{f[1] for f in catalog.foreign if f[0] == t}) for t in {f[0] for f in catalog.foreign}}
    return profiling.uniqueness(profiling.distinct_values(children)).join(F.broadcast(keys), ["table_name", "column_name"]).select("table_name", "column_name", "dst_table", "is_unique")


# -- selection and evaluation --------------------------------------------------------------------------------------

#: Question number, and candidates from best to worst.
CANDIDATES = {
    1: ["select nation.n_nam from nation where nation.n_nationkey = 3"],
    2: ["select _ from _ | select customer.n_name , count ( customer.* ) from nation group by nation.n_name"],
    3: ["select nonsense (", "select region.r_name from region"],
    4: ["select", "drop table nation"],
}


def repair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog.star(spark, sf_dir)
    texts = ["select nation.n_nam from nation", "select customer.n_name from customers", "select orders.o_totalprice from order", "select suplier.s_acctball from supplier where supplier.s_name = 'x.y'"]
    return spark.createDataFrame([(i, repair(t, catalog)) for i, t in enumerate(texts)], "id int, repaired string")


def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir)
    return spark.createDataFrame([(q, *choose(engine, cs)) for q, cs in CANDIDATES.items()], "q_id int, chosen int, text string")


def generate_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "spider_tables"), index=value_index(spark, sf_dir))


def generate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many generated queries have the clauses of the training query, per source."""
    train = table(spark, sf_dir, "train_spider").select("q_id", "source", normalized("query").alias("gold"))
    both = generate_sql(spark, sf_dir).join(train, "q_id").withColumn("_m", exact_matches(F.col("sql"), F.col("gold")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("sql") != PLACEHOLDER, 1)).alias("answered"), F.count(F.when(F.col("_m"), 1)).alias("matches"))


def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocessed queries against the training queries they were made from."""
    p = table(spark, sf_dir, "preprocessed_dataset").select("rec_id", "q_id", "norm_sql")
    return p.join(table(spark, sf_dir, "train_spider").select("q_id", "query"), "q_id").select("rec_id", exact_matches(F.col("norm_sql"), normalized("query")).alias("matches"))


def exec_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir)
    pairs = [
        ("select c_name from customer where c_acctbal > 9000", "select c_name from customer where not c_acctbal <= 9000"),
        ("select count(*) from orders", "select count(o_orderkey) from orders"),
        ("select distinct n_regionkey from nation", "select n_regionkey from nation"),
    ]
    return spark.createDataFrame([(i, same_result(engine.sql(a), engine.sql(b))) for i, (a, b) in enumerate(pairs)], "id int, matches boolean")


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("c1", 0.70, 0.75), ("c2", 0.72, 0.74), ("c3", 0.72, 0.76), ("c4", 0.69, 0.80)]
    return best_checkpoints(spark.createDataFrame(rows, "ckpt string, em double, ex double"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_sql, sql_skeletons, schema_labels, question_tokens, question_parts, question_patterns, fill_values, profile_unique, profile_samples, profile_types, same_content, same_content_all, fk_closure, join_paths, bridge_tables, catalog_columns, star_catalog,
        value_index, value_match_exact, value_match_fuzzy, topk_tables, topk_columns, table_coverage, table_auc, table_focal_loss, training_tables, serialize, table_report, input_windows, schema_links, display_names, unique_foreign_keys,
        repair_names, select_candidate, generate_sql, generate_match, exact_match, exec_match, best_checkpoint,
    )
}


def _unpivot(cast: str = "VARCHAR") -> str:
    cols = {
        "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey",
        "part": "p_partkey p_name p_brand p_type p_size", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus",
    }
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS {cast}) AS value FROM {t}" for t, cs in cols.items() for c in cs.split())


_DOUBLES = "c_acctbal s_acctbal p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax".split()
_OWNER = {"c": "customer", "s": "supplier", "p": "part", "o": "orders", "l": "lineitem"}
_REST = " UNION ALL ".join(f"SELECT '{_OWNER[c[0]]}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {_OWNER[c[0]]}" for c in [*_DOUBLES, "o_orderdate", "l_shipdate"])
_EVENTS = " UNION ALL ".join(f"SELECT 'events' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM events" for c in "event_id ts user_id event_type value props".split())
_NORM_INDEX = """
    WITH t AS (SELECT lower(trim(db_id)) AS db, unnest(db_schema) AS t FROM preprocessed_dataset WHERE db_id IS NOT NULL),
    c AS (SELECT db, lower(t.table_name_original) AS table_name, unnest(t.column_names_original) AS cn, generate_subscripts(t.column_names_original, 1) AS i, t FROM t),
    ix AS (SELECT DISTINCT db, table_name, lower(cn) AS column_name, cell_value FROM (SELECT db, table_name, cn, unnest(t.db_contents[i]) AS cell_value FROM c)
      WHERE trim(cell_value) <> '' AND cn IS NOT NULL AND table_name IS NOT NULL)"""
_ITEMS = """
    WITH cur AS (SELECT * FROM (SELECT *, lower(trim(db_id)) AS db, row_number() OVER (PARTITION BY lower(trim(db_id)) ORDER BY loaded_at DESC, catalog_id DESC) AS rn FROM spider_tables WHERE deleted_at IS NULL AND db_id IS NOT NULL) WHERE rn = 1),
    cols AS (SELECT db, table_names_original AS tn, unnest(column_names_original) AS c, generate_subscripts(column_names_original, 1) - 1 AS column_pos FROM cur),
    items AS (SELECT db, c.table_idx AS table_pos, tn[c.table_idx + 1] AS table_name, column_pos, c.name AS column_name FROM cols WHERE column_pos > 0 AND c.name IS NOT NULL AND c.table_idx >= 0 AND c.table_idx < len(tn)),
    q AS (SELECT q_id, lower(trim(db_id)) AS db, list_distinct(list_transform(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'), lambda w: regexp_replace(w, 's$', ''))) AS qw, query FROM train_spider WHERE question IS NOT NULL),
    tabs AS (SELECT DISTINCT db, table_pos, table_name FROM items)"""


def _plain(name: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(regexp_replace({name}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '_', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"


def _words(name: str) -> str:
    return f"list_transform({_plain(name)}, lambda w: regexp_replace(w, 's$', ''))"


def _score(name: str) -> str:
    own = f"list_distinct(list_transform(regexp_extract_all(lower(regexp_replace(regexp_replace({name}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '_', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_replace(w, 's$', '')))"
    return f"round(coalesce(len(list_intersect(qw, {own})) / nullif(len({own}), 0), 0.0), 4)"


_LABELLED = _ITEMS + f""",
    lab AS (SELECT q_id, table_pos, table_name, {_score('table_name')} AS prob, CASE WHEN list_contains(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lower(table_name)) THEN 1 ELSE 0 END AS label FROM q JOIN tabs USING (db))"""

_TOKENS = r"""''[^'']*''|‘[^’]*’|"[^"]*"|“[^”]*”|`[^`]*`|\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|-?\d[\d,]*(?:\.\d+)?%?|n''t|\p{L}+(?:''s)?|[^\s\p{Z}]"""


def _list(words: object) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


ORACLES = {
    "schema_labels": """
        WITH t AS (SELECT rec_id, string_split(lower(norm_sql), ' ') AS toks, unnest(db_schema) AS t, generate_subscripts(db_schema, 1) - 1 AS table_pos FROM preprocessed_dataset),
        c AS (SELECT rec_id, toks, table_pos, lower(t.table_name_original) AS tn, unnest(t.column_names_original) AS cn, generate_subscripts(t.column_names_original, 1) - 1 AS column_pos FROM t WHERE t.table_name_original IS NOT NULL)
        SELECT rec_id, CAST(table_pos AS INTEGER) AS table_pos, CAST(column_pos AS INTEGER) AS column_pos, CAST(coalesce(list_contains(toks, tn), false) AS INTEGER) AS table_label,
          CAST(coalesce(list_contains(list_transform(toks, lambda x: regexp_replace(x, '^\\w+\\.', '')), lower(cn)), false) AS INTEGER) AS column_label FROM c WHERE cn IS NOT NULL""",
    "profile_unique": f"SELECT table_name, column_name, count(DISTINCT value) AS distinct_values, count(value) AS filled, count(DISTINCT value) = count(value) AS is_unique FROM ({_unpivot()} UNION ALL {_REST}) GROUP BY ALL",
    "profile_types": f"""
        WITH v AS (SELECT DISTINCT table_name, column_name, lower(trim(value)) AS v FROM ({_unpivot()} UNION ALL {_REST}) WHERE trim(value) <> ''),
        s AS (SELECT table_name, column_name, count(*) AS n, min(v) AS low, max(v) AS high, count(*) FILTER (regexp_matches(v, '^\\p{{L}}')) AS letters, count(*) FILTER (regexp_matches(v, '^-?\\d+(\\.\\d+)?(e-?\\d+)?$')) AS numbers,
          count(*) FILTER (regexp_matches(v, '^\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}([ t].*)?$')) AS dates FROM v GROUP BY ALL)
        SELECT table_name, column_name, CASE WHEN n = 2 AND low || '/' || high IN ({', '.join(f"'{a}/{b}'" for a, b in profiling.BOOLEAN_PAIRS)}) THEN 'boolean' WHEN letters > CASE WHEN n > 7 THEN 1 ELSE 0 END THEN 'text'
          WHEN n = 1 THEN CASE WHEN column_name LIKE '%date' OR column_name LIKE '%time' THEN 'time' ELSE 'unknown' END WHEN dates >= n - CASE WHEN n > 7 THEN 1 ELSE 0 END THEN 'time' WHEN numbers >= n - CASE WHEN n > 7 THEN 1 ELSE 0 END THEN 'number' ELSE 'text' END AS kind FROM s""",
    "profile_samples": f"""
        SELECT table_name, column_name, value, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS place FROM (
          SELECT DISTINCT * FROM ({_unpivot()}) WHERE value <> '' AND column_name IN ('r_name', 'n_name', 'c_name', 'c_mktsegment', 's_name', 'p_name', 'p_brand', 'p_type', 'o_orderstatus', 'o_orderpriority', 'l_returnflag', 'l_linestatus'))) WHERE place <= 5""",
    "fk_closure": """
        WITH RECURSIVE e(a, ac, b, bc) AS (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('supplier', 's_nationkey', 'nation', 'n_nationkey'), ('orders', 'o_custkey', 'customer', 'c_custkey'),
          ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('lineitem', 'l_partkey', 'part', 'p_partkey'), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey'), ('events', 'user_id', 'customer', 'c_custkey')),
        r AS (SELECT * FROM e UNION SELECT r.a, r.ac, e.b, e.bc FROM r JOIN e ON r.b = e.a AND r.bc = e.ac)
        SELECT a AS src_table, ac AS src_column, b AS dst_table, bc AS dst_column FROM r""",
    "star_catalog": """
        WITH t AS (SELECT catalog_id, generate_subscripts(table_names_original, 1) - 1 AS table_idx FROM spider_tables),
        c AS (SELECT catalog_id, unnest(column_names_original) AS c, generate_subscripts(column_names_original, 1) - 1 AS old_pos FROM spider_tables),
        u AS (SELECT catalog_id, table_idx, '*' AS column_name, NULL AS old_pos FROM t UNION ALL SELECT catalog_id, c.table_idx, c.name, old_pos FROM c JOIN t USING (catalog_id) WHERE old_pos > 0 AND c.table_idx = t.table_idx)
        SELECT catalog_id, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY table_idx, old_pos NULLS FIRST) - 1 AS INTEGER) AS new_pos, CAST(table_idx AS INTEGER) AS table_idx, column_name, CAST(old_pos AS INTEGER) AS old_pos FROM u""",
    "join_paths": """
        WITH RECURSIVE k(a, b) AS (VALUES """ + ", ".join(f"('{f[0]}', '{f[2]}')" for f in STAR_FOREIGN) + """), e AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
        v(ts) AS (SELECT [a] FROM e UNION SELECT list_sort(list_append(ts, b)) FROM v JOIN e ON list_contains(ts, a) AND NOT list_contains(ts, b) WHERE len(ts) < 5)
        SELECT CAST(row_number() OVER (ORDER BY len(ts), ts) - 1 AS INTEGER) AS path, CAST(len(ts) AS INTEGER) AS size, array_to_string(ts, ',') AS tables FROM v""",
    "catalog_columns": """
        SELECT table_name, column_name, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' END AS spark_type,
          CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'number' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'time' END AS catalog_type,
          coalesce(k.c IS NOT NULL, false) AS is_primary, CAST(row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) - 1 AS INTEGER) AS ordinal
        FROM information_schema.columns LEFT JOIN (VALUES """ + ", ".join(f"('{t}', '{c}')" for t, c in STAR_PRIMARY.items()) + """) k(t, c) ON k.t = table_name AND k.c = column_name
        WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')""",
    # The given skeletons keep every list, alias, condition and star; here they are folded up, each sign with blanks of its own.
    "sql_skeletons": r"""
        WITH a AS (SELECT rec_id, '  ' || replace(replace(replace(sql_skeleton, ' as _', ''), '( * )', '( _ )'), ' ', '  ') || '  ' AS s FROM preprocessed_dataset),
        b AS (SELECT rec_id, regexp_replace(s, ' on  _  =  _ (?: (?:and|or)  _  =  _ )*', '', 'g') AS s FROM a),
        c AS (SELECT rec_id, regexp_replace(s, ' _ (?: join  _ )+', ' _ ', 'g') AS s FROM b),
        d AS (SELECT rec_id, regexp_replace(s, ' _ (?: ,  _ )+', ' _ ', 'g') AS s FROM c),
        e AS (SELECT rec_id, regexp_replace(regexp_replace(s, ' _  (?:=|!=|>|>=|<|<=)  _ ', ' _ ', 'g'), ' where  _ (?: (?:and|or)  _ )+', ' where  _ ', 'g') AS s FROM d)
        SELECT rec_id, trim(regexp_replace(s, ' +', ' ', 'g')) AS skeleton FROM e""",
    "exact_match": "SELECT rec_id, true AS matches FROM preprocessed_dataset p JOIN train_spider t USING (q_id)",
    "question_tokens": rf"""
        WITH w AS (SELECT q_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT q_id, regexp_extract_all(question, '{_TOKENS}') AS ws FROM train_spider WHERE question IS NOT NULL)),
        l AS (SELECT *, lower(text) AS low, coalesce(lag(lower(text)) OVER (PARTITION BY q_id ORDER BY pos), '') AS before FROM (SELECT DISTINCT * FROM w))
        SELECT q_id, CAST(pos AS INTEGER) AS pos, text, CASE
          WHEN length(text) > 1 AND contains(chr(39) || '‘"“`', text[1]) AND contains(chr(39) || '’"”`', text[-1]) THEN 'DB'
          WHEN regexp_full_match(text, '\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|\d{{1,2}}:\d{{2}}(:\d{{2}})?') THEN 'DATE'
          WHEN regexp_full_match(text, '[12]\d{{3}}') AND before IN ('in', 'year', 'since', 'after', 'before', 'from', 'of', {_list(question.MONTHS)}) THEN 'YEAR'
          WHEN (regexp_full_match(text, '-?(\d+|\d{{1,3}}(,\d{{3}})+)(\.\d+)?%?') OR low IN ({_list(question.NUMBER_WORDS)})) AND NOT (low = 'one' AND before IN ('the', 'this', 'that', 'which', 'does')) THEN 'NUM'
          WHEN low IN ({_list(question.NEGATIVE)}) THEN 'NOT' WHEN low IN ({_list(question.AGGREGATES)}) THEN 'AGG' WHEN low IN ('least', 'most') AND before = 'at' THEN CASE low WHEN 'least' THEN 'GR' ELSE 'SM' END
          WHEN low IN ({_list(question.SUPERLATIVE)}) THEN 'JJS' WHEN low IN ({_list(question.GREATER)}) THEN 'GR' WHEN low IN ({_list(question.SMALLER)}) THEN 'SM' WHEN low IN ({_list(question.GROUPING)}) THEN 'GROUP'
          WHEN low IN ({_list(question.STOP_WORDS)}) THEN 'STOP' WHEN NOT regexp_matches(text, '[\p{{L}}\p{{N}}_]') THEN 'PUNCT' ELSE '' END AS tag FROM l""",
    "input_windows": r"""
        WITH RECURSIVE s AS (SELECT rec_id, len(regexp_extract_all(coalesce(question, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS q, list_transform(db_schema, lambda t: len(regexp_extract_all(concat_ws(' ', t.table_name_original,
            nullif(array_to_string(t.column_names_original, ' '), ''), nullif(array_to_string(flatten(list_filter(t.db_contents, lambda v: v IS NOT NULL)), ' '), '')), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))) AS sizes FROM preprocessed_dataset WHERE db_schema IS NOT NULL),
        w(rec_id, q, sizes, pos, win, used) AS (SELECT rec_id, q, sizes, 1, 0, q + sizes[1] FROM s WHERE len(sizes) > 0
          UNION ALL SELECT rec_id, q, sizes, pos + 1, CASE WHEN used + sizes[pos + 1] <= 128 OR used = q THEN win ELSE win + 1 END, CASE WHEN used + sizes[pos + 1] <= 128 OR used = q THEN used + sizes[pos + 1] ELSE q + sizes[pos + 1] END FROM w WHERE pos < len(sizes))
        SELECT rec_id, CAST(pos - 1 AS INTEGER) AS table_pos, CAST(win AS INTEGER) AS window, CAST(sizes[pos] AS INTEGER) AS size FROM w""",
    "bridge_tables": "SELECT a AS table_name FROM (VALUES " + ", ".join(f"('{a}', '{ac}', '{b}', '{bc}')" for a, ac, b, bc in STAR_FOREIGN) + ") k(a, ac, b, bc) GROUP BY a HAVING count(DISTINCT b) > 1",
    "same_content": f"""
        WITH v AS (SELECT DISTINCT table_name || '.' || column_name AS c, value FROM ({_unpivot()}) WHERE column_name IN ('n_nationkey', 'n_regionkey', 'r_regionkey', 'c_custkey', 'c_nationkey', 's_suppkey', 's_nationkey', 'o_orderkey', 'o_custkey') AND value IS NOT NULL),
        s AS (SELECT c, count(*) AS size FROM v GROUP BY c), p AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM v a JOIN v b ON a.value = b.value AND a.c <> b.c GROUP BY ALL)
        SELECT a AS column_a, b AS column_b, shared, size AS values_a FROM p JOIN s ON s.c = p.a WHERE size > 1 AND shared >= size - 1""",
    "same_content_all": f"""
        WITH v AS (SELECT DISTINCT table_name || '.' || column_name AS c, value FROM ({_unpivot()} UNION ALL {_REST} UNION ALL {_EVENTS}) WHERE value IS NOT NULL AND value <> ''),
        s AS (SELECT c, count(*) AS size FROM v GROUP BY c), p AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM v a JOIN v b ON a.value = b.value AND a.c <> b.c GROUP BY ALL)
        SELECT a AS column_a, b AS column_b, shared, size AS values_a FROM p JOIN s ON s.c = p.a WHERE size > 1 AND shared >= size - 1""",
    "value_index": _NORM_INDEX + " SELECT * FROM ix",
    "value_match_exact": _NORM_INDEX + """,
        q AS (SELECT q_id, lower(trim(db_id)) AS db, ' ' || array_to_string(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS said FROM train_spider WHERE question IS NOT NULL)
        SELECT q_id, table_name, column_name, cell_value FROM q JOIN ix USING (db) WHERE len(regexp_extract_all(lower(cell_value), '[\\p{L}\\p{N}]+')) > 0
          AND contains(said, ' ' || array_to_string(regexp_extract_all(lower(cell_value), '[\\p{L}\\p{N}]+'), ' ') || ' ')""",
    "topk_tables": _ITEMS + f""",
        s AS (SELECT q_id, table_pos, table_name, {_score('table_name')} AS prob FROM q JOIN tabs USING (db))
        SELECT q_id, table_pos, table_name, prob, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY prob DESC, table_pos) AS place FROM s) WHERE place <= 4""",
    "topk_columns": _ITEMS + f""",
        s AS (SELECT q_id, table_pos, table_name, CAST(column_pos AS INTEGER) AS column_pos, column_name, {_score('column_name')} AS prob FROM q JOIN items USING (db))
        SELECT q_id, table_pos, table_name, column_pos, column_name, prob, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id, table_pos ORDER BY round(prob, 2) DESC, column_pos) AS place FROM s) WHERE place <= 5""",
    "table_coverage": _LABELLED + """,
        r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY prob DESC, table_pos) AS place FROM lab),
        g AS (SELECT q_id, sum(label) AS u, sum(CASE WHEN place <= 2 THEN label ELSE 0 END) AS k FROM r GROUP BY q_id HAVING sum(label) > 0)
        SELECT count(*) AS groups, round(avg(CASE WHEN u = k THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM g""",
    "table_auc": _LABELLED + """,
        p AS (SELECT prob, sum(label) AS pos, sum(1 - label) AS neg FROM lab GROUP BY prob),
        a AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS a FROM p)
        SELECT round(sum(a) / (sum(pos) * sum(neg)), 6) AS auc FROM a""",
    "table_focal_loss": _LABELLED + """,
        l AS (SELECT CASE WHEN label = 1 THEN prob ELSE 1 - prob END AS p, CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END AS w FROM lab)
        SELECT round(sum(pow(1 - p, 2) * -ln(p + 1e-8) * w) / sum(w), 6) AS loss FROM l""",
    "training_tables": _LABELLED + """
        SELECT q_id, table_name, label = 1 AS used, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY label DESC, md5('7|' || q_id || '|' || table_name), table_name) AS place FROM lab) WHERE place <= 2 OR label = 1""",
    "serialize": """
        SELECT rec_id, array_to_string(list_concat([coalesce(question, '')],
          list_filter(list_transform(coalesce(db_schema, []), lambda t: lower(t.table_name_original) || ' : ' || array_to_string(list_filter(list_transform(coalesce(t.column_names_original, []), lambda c, i:
            lower(t.table_name_original) || '.' || lower(c) || CASE WHEN len(list_filter(coalesce(t.db_contents[i], []), lambda v: v IS NOT NULL AND trim(v) <> '')) > 0
              THEN ' ( ' || array_to_string(list_filter(t.db_contents[i], lambda v: v IS NOT NULL AND trim(v) <> ''), ' , ') || ' )' ELSE '' END), lambda x: x IS NOT NULL), ' , ')), lambda x: x IS NOT NULL),
          list_filter(list_transform(coalesce(fk, []), lambda f: lower(f.source_table_name_original || '.' || f.source_column_name_original || ' = ' || f.target_table_name_original || '.' || f.target_column_name_original)), lambda x: x IS NOT NULL)), ' | ') AS input_sequence
        FROM preprocessed_dataset""",
    "table_report": _LABELLED + """,
        n AS (SELECT count(*) FILTER (prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (prob >= 0.5 AND label = 0) AS fp, count(*) FILTER (prob < 0.5 AND label = 1) AS fn FROM lab)
        SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM n""",
    "schema_links": _ITEMS + f""",
        al AS (SELECT db, table_name, column_name, {_words('column_name')} AS iw FROM items UNION ALL SELECT DISTINCT db, table_name, NULL, {_words('table_name')} FROM items),
        q2 AS (SELECT q_id, lower(trim(db_id)) AS db, list_transform(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_replace(w, 's$', '')) AS qs FROM train_spider WHERE question IS NOT NULL),
        j AS (SELECT DISTINCT q_id, table_name, column_name, qs, iw FROM q2 JOIN al USING (db) WHERE len(list_intersect(qs, iw)) > 0),
        t AS (SELECT q_id, table_name, column_name, CASE WHEN contains(' ' || array_to_string(qs, ' ') || ' ', ' ' || array_to_string(iw, ' ') || ' ') THEN 3 WHEN list_has_all(qs, iw) THEN 2
          WHEN list_max(list_transform(list_intersect(qs, iw), lambda w: length(w))) >= 4 THEN 1 END AS tier FROM j)
        SELECT * FROM t WHERE tier IS NOT NULL""",
    "display_names": _ITEMS + f""",
        d AS (SELECT db, table_pos, column_pos, array_to_string({_plain('column_name')}, ' ') AS f, regexp_replace(array_to_string({_plain('table_name')}, ' '), 's$', '') AS o FROM items)
        SELECT db, table_pos, CAST(column_pos AS INTEGER) AS column_pos, CASE WHEN starts_with(f, o || ' ') THEN substring(f, length(o) + 2) ELSE f END AS display_name FROM d""",
    "unique_foreign_keys": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{p}' AS dst_table, count(DISTINCT {c}) = count({c}) AS is_unique FROM {t}" for t, c, p, _ in STAR_FOREIGN),
    "repair_names": "SELECT * FROM (VALUES (0, 'select nation.n_name from nation'), (1, 'select nation.n_name from customer'), (2, 'select orders.o_totalprice from orders'), (3, 'select supplier.s_acctbal from supplier where supplier.s_name = ''x.y''')) t(id, repaired)",
    "exec_match": "SELECT * FROM (VALUES (0, true), (1, true), (2, false)) t(id, matches)",
    "best_checkpoint": "SELECT * FROM (VALUES ('em', 'c3', 0.72, 0.76), ('ex', 'c4', 0.69, 0.80), ('sum', 'c4', 0.69, 0.80)) t(goal, ckpt, em, ex)",
}
