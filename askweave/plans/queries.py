"""Queries of the core operators, by name, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.operators.references import catalog_deltas, counts, current_orphans, current_report, orphan_references, orphan_report, reference_deltas, train_deltas
from askweave.operators.shredding import flat_table, schema_leaves
from askweave.sources.tables import table
from askweave.storage import SharedTables
from askweave.streaming.ledger import LedgerStream


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "spider_tables")).drop("period")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "spider_tables"))


def p3_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_orphans(reference_deltas(table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "spider_tables")))


def p3_current_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current orphans per table, field and month; keys count once each."""
    return current_report(counts(reference_deltas(table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "spider_tables"))))


def p3_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`p3_current_report` from a ledger that streams of both tables keep up."""
    root = SharedTables(spark, "ledger").path()
    ledger = LedgerStream(spark, f"{root}/state")
    stream = lambda name: spark.readStream.schema(table(spark, sf_dir, name).schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")
    deltas = train_deltas(stream("train_spider")).unionByName(catalog_deltas(stream("spider_tables")))
    ledger.run(deltas, f"{root}/progress").awaitTermination()
    return ledger.report()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_leaves(table(spark, sf_dir, "preprocessed_dataset"), "rec_id", "db_schema")


def p5_schema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"table_name_original": "[].table_name_original", "table_name": "[].table_name"}
    return flat_table(table(spark, sf_dir, "preprocessed_dataset"), "rec_id", "db_schema", fields, ["table_pos"])


def p5_schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"column_name_original": "[].column_names_original[]", "column_name": "[].column_names[]", "column_type": "[].column_types[]"}
    return flat_table(table(spark, sf_dir, "preprocessed_dataset"), "rec_id", "db_schema", fields, ["table_pos", "column_pos"])


def p5_cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(table(spark, sf_dir, "preprocessed_dataset"), "rec_id", "db_schema", {"cell_value": "[].db_contents[][]"}, ["table_pos", "column_pos", "value_pos"])


def _catalog_part(spark: SparkSession, sf_dir: str, columns: list[str], fields: dict[str, str], position: str, types: dict[str, str]) -> DataFrame:
    """Parallel arrays of the catalog side by side."""
    rows = table(spark, sf_dir, "spider_tables").select("catalog_id", F.struct(*columns).alias("nested"))
    return flat_table(rows, "catalog_id", "nested", fields, [position], types)


def p5_catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog_part(spark, sf_dir, ["table_names_original", "table_names"], {"table_name_original": ".table_names_original[]", "table_name": ".table_names[]"}, "table_pos", {})


def p5_catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"table_idx": ".column_names_original[].table_idx", "column_name_original": ".column_names_original[].name", "column_name": ".column_names[].name", "column_type": ".column_types[]"}
    return _catalog_part(spark, sf_dir, ["column_names_original", "column_names", "column_types"], fields, "column_pos", {"table_idx": "int"})


def p5_catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"primary_idx": ".primary_keys[]", "src_idx": ".foreign_keys[].src", "dst_idx": ".foreign_keys[].dst"}
    return _catalog_part(spark, sf_dir, ["primary_keys", "foreign_keys"], fields, "key_pos", dict.fromkeys(fields, "int"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_current, p3_current_report, p3_streamed, p5_found, p5_schema_tables, p5_schema_columns, p5_cell_values, p5_catalog_tables, p5_catalog_columns, p5_catalog_keys)}

_P3 = """
    WITH cols AS (SELECT catalog_id, loaded_at, len(table_names_original) AS n, unnest(column_names_original) AS c, generate_subscripts(column_names_original, 1) - 1 AS pos FROM spider_tables),
    good AS (SELECT catalog_id, pos FROM cols WHERE pos > 0 AND c.name IS NOT NULL AND c.table_idx >= 0 AND c.table_idx < n),
    pk AS (SELECT catalog_id, loaded_at, unnest(primary_keys) AS i, generate_subscripts(primary_keys, 1) - 1 AS pos FROM spider_tables),
    fk AS (SELECT catalog_id, loaded_at, unnest(foreign_keys) AS p, generate_subscripts(foreign_keys, 1) - 1 AS pos FROM spider_tables),
    cat AS (SELECT lower(trim(db_id)) AS db, loaded_at, deleted_at FROM spider_tables),
    orphans AS (
      SELECT 'train_spider' AS src_table, q_id AS src_id, 'db_id' AS src_field, 0 AS pos, created_at AS stamp FROM train_spider t WHERE db_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM cat WHERE cat.db = lower(trim(t.db_id)) AND cat.loaded_at <= t.created_at AND (cat.deleted_at IS NULL OR cat.deleted_at > t.created_at))
      UNION SELECT 'spider_tables', catalog_id, 'column_names_original', pos, loaded_at FROM cols WHERE pos > 0 AND NOT coalesce(c.table_idx >= 0 AND c.table_idx < coalesce(n, 0), false)
      UNION SELECT 'spider_tables', catalog_id, 'primary_keys', pos, loaded_at FROM pk WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.catalog_id = pk.catalog_id AND g.pos = pk.i)
      UNION SELECT 'spider_tables', catalog_id, 'foreign_keys', pos, loaded_at FROM fk WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.catalog_id = fk.catalog_id AND g.pos = fk.p.src)
        OR NOT EXISTS (SELECT 1 FROM good g WHERE g.catalog_id = fk.catalog_id AND g.pos = fk.p.dst))
"""  # fmt: skip

# What refers and what is there now: withdrawn deliveries are gone with all they held and referred to.
_P3_NOW = """
    WITH now AS (SELECT *, date_trunc('month', loaded_at) AS period FROM spider_tables WHERE deleted_at IS NULL),
    live AS (SELECT 'db:' || lower(trim(db_id)) AS key FROM now WHERE db_id IS NOT NULL AND loaded_at IS NOT NULL
      UNION SELECT 't:' || catalog_id || ':' || i FROM (SELECT catalog_id, unnest(range(len(table_names_original))) AS i FROM now)
      UNION SELECT 'c:' || catalog_id || ':' || i FROM (SELECT catalog_id, len(table_names_original) AS n, unnest(range(1, len(column_names_original))) AS i, column_names_original AS cs FROM now)
        WHERE cs[i + 1].name IS NOT NULL AND cs[i + 1].table_idx BETWEEN 0 AND n - 1),
    refs AS (SELECT 'train_spider' AS src_table, 'db_id' AS src_field, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS period, 'db:' || lower(trim(db_id)) AS key FROM train_spider WHERE db_id IS NOT NULL
      UNION ALL SELECT 'spider_tables', 'column_names_original', CAST(period AS TIMESTAMP), 't:' || catalog_id || ':' || coalesce(CAST(c.table_idx AS VARCHAR), 'none') FROM (SELECT catalog_id, period, unnest(column_names_original[2:]) AS c FROM now)
      UNION ALL SELECT 'spider_tables', 'primary_keys', CAST(period AS TIMESTAMP), 'c:' || catalog_id || ':' || coalesce(CAST(i AS VARCHAR), 'none') FROM (SELECT catalog_id, period, unnest(primary_keys) AS i FROM now)
      UNION ALL SELECT 'spider_tables', 'foreign_keys', CAST(period AS TIMESTAMP), 'c:' || catalog_id || ':' || coalesce(CAST(unnest([p.src, p.dst]) AS VARCHAR), 'none') FROM (SELECT catalog_id, period, unnest(foreign_keys) AS p FROM now))
"""  # fmt: skip

_P5 = """
    WITH t AS (SELECT rec_id, unnest(db_schema) AS t, generate_subscripts(db_schema, 1) - 1 AS table_pos FROM preprocessed_dataset)
"""

ORACLES = {
    "p3_found": _P3 + "SELECT src_table, src_id, src_field, CAST(pos AS INTEGER) AS pos FROM orphans",
    "p3_report": _P3 + "SELECT src_table, src_field, CAST(date_trunc('month', stamp) AS TIMESTAMP) AS period, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p3_current": _P3_NOW + "SELECT key, count(*) AS refs FROM refs WHERE key NOT IN (SELECT key FROM live) GROUP BY key",
    "p3_current_report": _P3_NOW + "SELECT src_table, src_field, period, count(*) AS orphans, count(DISTINCT key) AS keys FROM refs WHERE key NOT IN (SELECT key FROM live) GROUP BY ALL",
    "p3_streamed": _P3_NOW + "SELECT src_table, src_field, period, count(*) AS orphans, count(DISTINCT key) AS keys FROM refs WHERE key NOT IN (SELECT key FROM live) GROUP BY ALL",
    "p5_found": _P5 + """,
        c AS (SELECT rec_id, table_pos, generate_subscripts(t.column_names_original, 1) - 1 AS column_pos, t FROM t),
        v AS (SELECT rec_id, table_pos, column_pos, unnest(t.db_contents[column_pos + 1]) AS v, generate_subscripts(t.db_contents[column_pos + 1], 1) - 1 AS value_pos FROM c),
        a AS (SELECT rec_id, table_pos, column_pos, value_pos FROM v WHERE v IS NOT NULL),
        b AS (SELECT * FROM a UNION ALL SELECT rec_id, table_pos, column_pos, -1 FROM c ANTI JOIN a USING (rec_id, table_pos, column_pos)
          UNION ALL SELECT rec_id, table_pos, -1, -1 FROM t ANTI JOIN c USING (rec_id, table_pos)
          UNION ALL SELECT rec_id, -1, -1, -1 FROM preprocessed_dataset p ANTI JOIN t USING (rec_id))
        SELECT rec_id, CAST(table_pos AS INTEGER) AS table_pos, CAST(column_pos AS INTEGER) AS column_pos, CAST(value_pos AS INTEGER) AS value_pos FROM b""",
    "p5_schema_tables": _P5 + "SELECT rec_id, CAST(table_pos AS INTEGER) AS table_pos, t.table_name_original AS table_name_original, t.table_name AS table_name FROM t",
    "p5_schema_columns": _P5 + """,
        n AS (SELECT *, greatest(coalesce(len(t.column_names_original), 0), coalesce(len(t.column_names), 0), coalesce(len(t.column_types), 0)) AS n FROM t),
        c AS (SELECT rec_id, table_pos, t, unnest(range(n)) AS column_pos FROM n)
        SELECT rec_id, CAST(table_pos AS INTEGER) AS table_pos, CAST(column_pos AS INTEGER) AS column_pos, t.column_names_original[column_pos + 1] AS column_name_original,
          t.column_names[column_pos + 1] AS column_name, t.column_types[column_pos + 1] AS column_type FROM c""",
    "p5_cell_values": _P5 + """,
        c AS (SELECT rec_id, table_pos, unnest(t.db_contents) AS c, generate_subscripts(t.db_contents, 1) - 1 AS column_pos FROM t)
        SELECT rec_id, CAST(table_pos AS INTEGER) AS table_pos, CAST(column_pos AS INTEGER) AS column_pos, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS value_pos, unnest(c) AS cell_value FROM c""",
    "p5_catalog_tables": """
        WITH t AS (SELECT *, unnest(range(greatest(coalesce(len(table_names_original), 0), coalesce(len(table_names), 0)))) AS p FROM spider_tables)
        SELECT catalog_id, CAST(p AS INTEGER) AS table_pos, table_names_original[p + 1] AS table_name_original, table_names[p + 1] AS table_name FROM t""",
    "p5_catalog_columns": """
        WITH c AS (SELECT *, unnest(range(greatest(coalesce(len(column_names_original), 0), coalesce(len(column_names), 0), coalesce(len(column_types), 0)))) AS p FROM spider_tables)
        SELECT catalog_id, CAST(p AS INTEGER) AS column_pos, column_names_original[p + 1].table_idx AS table_idx, column_names_original[p + 1].name AS column_name_original,
          column_names[p + 1].name AS column_name, column_types[p + 1] AS column_type FROM c""",
    "p5_catalog_keys": """
        WITH k AS (SELECT *, unnest(range(greatest(coalesce(len(primary_keys), 0), coalesce(len(foreign_keys), 0)))) AS p FROM spider_tables)
        SELECT catalog_id, CAST(p AS INTEGER) AS key_pos, primary_keys[p + 1] AS primary_idx, foreign_keys[p + 1].src AS src_idx, foreign_keys[p + 1].dst AS dst_idx FROM k""",
}
