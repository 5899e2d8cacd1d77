"""One object that answers SQL and shorthand texts over a catalog of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askweave.plans.emit import query_sql
from askweave.plans.inference import Options, expand
from askweave.plans.lowering import lower
from askweave.plans.parser import parse_sql
from askweave.sources.catalog import Catalog
from askweave.sources.tables import table


class Engine:
    def __init__(self, spark: SparkSession, sf_dir: str, catalog: Catalog | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.catalog = catalog or Catalog.star(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, names: list[str] | None = None) -> DataFrame:
        """The result of a statement of the SQL subset."""
        return lower(parse_sql(text), self.table, names)

    def shorthand(self, text: str, names: list[str] | None = None, options: Options = Options()) -> DataFrame:
        """The result of a shorthand, whose joins, grouping and nesting are inferred."""
        return lower(expand(text, self.catalog, options), self.table, names)

    def explain(self, text: str, options: Options = Options()) -> str:
        """The full SQL that a shorthand stands for."""
        return query_sql(expand(text, self.catalog, options))
