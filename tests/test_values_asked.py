"""Values in questions, with and without quotes."""

from askweave.plans.asking import ask
from askweave.plans.engine import Engine
from askweave.plans.generation import by_rules, generated
from askweave.sources.catalog import Catalog

CATALOG = Catalog({"singer": {"singer_id": "double", "name": "string", "city": "string"}}, {"singer": "singer_id"})


def test_rules_know_values_without_quotes():
    links = [("New York", "singer", "city"), ("12", "singer", "name"), ("the", "singer", "name")]
    want = ["select singer.name from singer where singer.city = 'New York'"]
    assert by_rules("Show the name of singers in new york", CATALOG, links) == want
    assert by_rules("Which singers are in 'New York'?", CATALOG, links) == want
    assert by_rules("Show the name of singers in new york", CATALOG, [("New York", "gone", "city")]) == ["select singer.name from singer"]
    assert by_rules("Show the name of singers", CATALOG, links) == ["select singer.name from singer"]


def test_ask_without_quotes(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    quoted, bare = (ask(engine, f"How many customers are in {x}?").collect() for x in ("'ASIA'", "asia"))
    assert quoted == bare != ask(engine, "How many customers are there?").collect()


def test_generated_uses_the_index(spark):
    names = "c array<struct<table_idx:int,name:string>>"
    catalog = spark.createDataFrame(
        [(1, "d", ["singer"], [(-1, "*"), (0, "id"), (0, "name"), (0, "city")], [(-1, "*"), (0, "id"), (0, "name"), (0, "city")], ["text", "number", "text", "text"], [1], [], None, None)],
        f"catalog_id long, db_id string, table_names_original array<string>, column_names {names[2:]}, column_names_original {names[2:]}, column_types array<string>, primary_keys array<int>, foreign_keys array<struct<src:int,dst:int>>, deleted_at timestamp, loaded_at timestamp",
    )
    questions = spark.createDataFrame([(1, "d", "Show the name of singers in Oslo"), (2, "d", "Which singers are in 'Oslo'?"), (3, "d", "Show the name of singers")], "q_id long, db_id string, question string")
    index = spark.createDataFrame([("d", "singer", "city", "Oslo")], "db string, table_name string, column_name string, cell_value string")
    got = {r["q_id"]: r["sql"] for r in generated(questions, catalog, index=index).collect()}
    where = "select singer.name from singer where singer.city = 'Oslo'"
    assert got == {1: where, 2: where, 3: "select singer.name from singer"}
