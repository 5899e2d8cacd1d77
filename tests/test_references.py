from datetime import datetime as dt

from askweave.operators.references import CAME, DATED, LEFT, current_orphans, orphan_references, orphans_in_time

TRAIN = "q_id long, db_id string, created_at timestamp_ntz, key string, at int, what string"
CATALOG = "catalog_id long, db_id string, table_names_original array<string>, column_names_original array<struct<table_idx:int,name:string>>, primary_keys array<int>, foreign_keys array<struct<src:int,dst:int>>, loaded_at timestamp_ntz, deleted_at timestamp_ntz, salt int, delta int"


def test_databases_in_time_and_columns(spark):
    train = [(1, " A ", dt(2024, 2, 1)), (2, "a", dt(2024, 1, 1)), (3, "A", dt(2024, 3, 1)), (4, "b", dt(2024, 2, 1)), (5, None, dt(2024, 2, 1)), (6, "a", None), (7, "a", dt(2024, 1, 15)), (7, "a", dt(2024, 1, 15))]
    cols = [(-1, "*"), (0, "x"), (0, None), (7, "y"), (None, "z"), None]
    catalog = [
        (1, "a", ["t"], cols, [1, 2, None, 0], [(1, 1), (1, 9), None], dt(2024, 1, 15), dt(2024, 3, 1), 0, 0),
        (2, "b", None, None, None, None, dt(2024, 2, 1), dt(2024, 1, 1), 0, 0),
        (3, "b", [], [(-1, "*")], [], [], None, None, 0, 0),
    ]
    got = {tuple(r)[:4] for r in orphan_references(spark.createDataFrame([(*t, "k", 0, "w") for t in train], TRAIN), spark.createDataFrame(catalog, CATALOG)).collect()}
    assert got == {
        ("train_spider", 2, "db_id", 0), ("train_spider", 3, "db_id", 0), ("train_spider", 4, "db_id", 0), ("train_spider", 6, "db_id", 0),
        *(("spider_tables", 1, "column_names_original", p) for p in (3, 4, 5)), *(("spider_tables", 1, "primary_keys", p) for p in (1, 2, 3)), *(("spider_tables", 1, "foreign_keys", p) for p in (1, 2)),
    }


def test_empty_tables(spark):
    assert orphan_references(spark.createDataFrame([], TRAIN), spark.createDataFrame([], CATALOG)).count() == 0
    assert orphan_references(spark.createDataFrame([(1, "a", dt(2024, 1, 1), "", 0, "")], TRAIN), spark.createDataFrame([], CATALOG)).count() == 1


def test_hot_key_in_chunks_equals_brute_force(spark):
    refs = [("k" if i % 3 else f"x{i % 7}", i % 50, i) for i in range(900)]
    deltas = [("k", 10, 1), ("k", 20, -1), ("k", 20, 1), ("k", 30, -1), ("x1", 0, 1), ("x2", 5, 1), ("x2", 5, -1)]
    want = sorted(w for k, at, w in refs if sum(d for dk, dat, d in deltas if dk == k and dat <= at) <= 0)
    rows = [(k, at, CAME, 1, 0, w) for k, at, w in refs] + [(k, at, DATED, 0, d, None) for k, at, d in deltas]
    schema = "key string, at int, step int, refs int, there int, what long"
    df = spark.createDataFrame(rows, schema)
    assert sorted(x["what"] for x in orphans_in_time(df, chunk=50).collect()) == want
    none = {k: n for k in {x for x, _, _ in refs} if sum(d for dk, _, d in deltas if dk == k) <= 0 and (n := sum(x == k for x, _, _ in refs))}
    assert {x["key"]: x["refs"] for x in current_orphans(df).collect()} == none
    # Withdrawn references stay orphans of their time, and are none now.
    back = df.unionByName(spark.createDataFrame([(k, 99, LEFT, -1, 0, w) for k, _, w in refs if k != "x3"], schema))
    assert sorted(x["what"] for x in orphans_in_time(back, chunk=50).collect()) == want
    assert {x["key"]: x["refs"] for x in current_orphans(back).collect()} == {"x3": none["x3"]}
