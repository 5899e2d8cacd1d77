"""Columns with the same content, over the whole catalog."""

from askweave.plans.pipeline_queries import QUERIES
from askweave.sources.catalog import STAR_FOREIGN, Catalog
from askweave.sources.tables import table


def test_every_foreign_key_is_contained(spark):
    sf_dir = "/root/testdata/sf0.01"
    pairs = {(r["column_a"], r["column_b"]): r["values_a"] - r["shared"] for r in QUERIES["same_content_all"](spark, sf_dir).collect()}
    for child, c, parent, p in STAR_FOREIGN:
        assert pairs[f"{child}.{c}", f"{parent}.{p}"] == 0


def test_sql_names_every_column(spark):
    from askweave.plans import pipeline_queries as pipeline

    sf_dir = "/root/testdata/sf0.001"
    catalog = Catalog.star(spark, sf_dir)
    assert all(f"'{t}' AS table_name, '{c}' AS column_name" in pipeline.ORACLES["same_content_all"] for t in catalog.tables for c in table(spark, sf_dir, t).columns)
