"""Question and catalog files as they are exchanged, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "db_id string, question string, query string, query_toks array<string>, query_toks_no_value array<string>, question_toks array<string>"
#: Pairs stand in these files as lists of two: [table index, name] and [source, target].
CATALOG = "db_id string, table_names array<string>, table_names_original array<string>, column_names array<array<string>>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>"


def read_questions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Questions from JSON: one list in a file (``multi_line``) or one record a line. Typographic quotes become plain ones."""
    plain = F.translate(F.regexp_replace("question", "[“”]", '"'), "‘’", "''")
    return spark.read.schema(QUESTIONS).json(path, multiLine=multi_line).withColumn("question", plain)


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The catalog with its pairs as structs. A pair that is null or has no index keeps its place, with nulls in it."""
    pair = lambda p: F.struct(F.get(p, 0).try_cast("int").alias("table_idx"), F.get(p, 1).alias("name"))
    key = lambda p: F.struct(F.get(p, 0).alias("src"), F.get(p, 1).alias("dst"))
    raw = spark.read.schema(CATALOG).json(path, multiLine=multi_line)
    return raw.withColumns({"column_names": F.transform("column_names", pair), "column_names_original": F.transform("column_names_original", pair), "foreign_keys": F.transform("foreign_keys", key)})


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON, one a line, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_predictions(df: DataFrame, path: str, id_col: str, sql_col: str, placeholder: str = "sql placeholder") -> None:
    """One query a line in the order of ``id_col``; what has no query gets the placeholder, line breaks become blanks."""
    line = F.regexp_replace(F.coalesce(F.col(sql_col), F.lit(placeholder)), r"[\r\n]+", " ")
    df.orderBy(id_col).select(line.alias("value")).write.mode("overwrite").text(path)


def star_columns(catalog: DataFrame) -> DataFrame:
    """``catalog_id``, ``new_pos``, ``table_idx``, ``column_name``, ``old_pos``: each table's ``*`` and then its columns, numbered through.

    Columns of tables that do not exist are left out. ``old_pos`` links back to the catalog's own numbers; a ``*`` has none. Made
    within each row, without a shuffle.
    """
    indexed = F.transform("column_names_original", lambda c, i: F.struct(c["table_idx"].alias("table_idx"), c["name"].alias("column_name"), i.alias("old_pos")))
    none = F.lit(None).cast("int")

    def one_table(t):
        star = F.array(F.struct(t.alias("table_idx"), F.lit("*").alias("column_name"), none.alias("old_pos")))
        return F.concat(star, F.filter(F.col("_c"), lambda c: (c["table_idx"] == t) & (c["old_pos"] > 0)))

    tables = F.when(F.size("table_names_original") > 0, F.sequence(F.lit(0), F.size("table_names_original") - 1))
    rows = catalog.select("catalog_id", "table_names_original", F.coalesce(indexed, F.array().cast("array<struct<table_idx:int,column_name:string,old_pos:int>>")).alias("_c"))
    return rows.select("catalog_id", F.posexplode(F.flatten(F.transform(tables, one_table))).alias("new_pos", "c")).select("catalog_id", "new_pos", "c.*")
