import json
from datetime import datetime as dt

from askweave.operators.references import WHAT, counts, current_orphans, current_report
from askweave.sources.files import read_catalog, read_questions, star_columns, write_predictions, write_records
from askweave.streaming.ledger import LedgerStream


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"db_id": "a", "question": "What’s “x”?", "query": "SELECT 1", "query_toks": ["SELECT", "1"]}, {"db_id": None}]))
    rows = read_questions(spark, str(tmp_path / "q.json")).collect()
    assert (rows[0]["question"], rows[0]["query_toks"], rows[1]["question"]) == ("What's \"x\"?", ["SELECT", "1"], None)
    (tmp_path / "t.json").write_text(json.dumps([{"db_id": "a", "table_names_original": ["t"], "column_names_original": [[-1, "*"], [0, "x"], [0, None], None], "primary_keys": [1], "foreign_keys": [[1, 2]]}]))
    row = read_catalog(spark, str(tmp_path / "t.json")).collect()[0]
    assert [tuple(c) for c in row["column_names_original"]] == [(-1, "*"), (0, "x"), (0, None), (None, None)] and tuple(row["foreign_keys"][0]) == (1, 2)
    write_records(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).collect()[0]["a"] == 1
    write_predictions(spark.createDataFrame([(2, "b\nc"), (1, "a"), (3, None)], "id int, q string"), str(tmp_path / "p"), "id", "q")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "p")).collect()) == ["a", "b c", "sql placeholder"]


def test_star_columns(spark):
    schema = "catalog_id long, table_names_original array<string>, column_names_original array<struct<table_idx:int,name:string>>"
    df = spark.createDataFrame([(1, ["a", "b"], [(-1, "*"), (1, "y"), (0, "x"), (9, "z")]), (2, None, None), (3, [], [(-1, "*")])], schema)
    assert [tuple(r) for r in star_columns(df).orderBy("catalog_id", "new_pos").collect()] == [(1, 0, 0, "*", None), (1, 1, 0, "x", 2), (1, 2, 1, "*", None), (1, 3, 1, "y", 1)]


DELTAS = f"key string, at timestamp_ntz, step int, refs int, there int, what {WHAT}"
MAY, JUNE = dt(2024, 5, 1), dt(2024, 6, 1)


def _delta(key, refs, there, period=None):
    return (key, MAY, 1, refs, there, ("s", 1, "f", 0, period) if period else None)


def test_ledger_stream_equals_batch(spark, tmp_path):
    parts = [
        [_delta("a", 1, 0, MAY), _delta("b", 1, 0, MAY), _delta(None, 1, 0, MAY)], [_delta("a", 0, 1), _delta("c", 0, 1), _delta("b", 1, 0, JUNE)],
        [_delta("a", 0, -1), _delta("c", 1, 0, JUNE), _delta("b", -1, 0, MAY)], [_delta("d", 1, 0, JUNE)], [_delta("d", -1, 0, JUNE), _delta("a", 1, 0, JUNE)],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, DELTAS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    every = spark.createDataFrame([r for rows in parts for r in rows], DELTAS)
    want, report = sorted(map(tuple, current_orphans(every).collect())), sorted(map(str, current_report(counts(every)).collect()))
    assert want == [("a", 2), ("b", 1)] and len(report) == 2
    for merge_every in (2, 16):
        ledger = LedgerStream(spark, f"{tmp_path}/state{merge_every}", merge_every)
        stream = spark.readStream.schema(DELTAS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        ledger.run(stream, f"{tmp_path}/checkpoint{merge_every}").awaitTermination(120)
        assert sorted(map(tuple, ledger.orphans().collect())) == want and sorted(map(str, ledger.report().collect())) == report
        assert len(ledger.parts()) == (1 if merge_every == 2 else 5)


def test_ledger_batch_run_again(spark, tmp_path):
    frames = [spark.createDataFrame(rows, DELTAS) for rows in ([_delta("a", 1, 0, MAY)], [_delta("a", 1, 0, MAY), _delta("b", 0, 1)])]
    for merge_every in (1, 9):
        ledger = LedgerStream(spark, f"{tmp_path}/state{merge_every}", merge_every)
        for i in (0, 1, 1, 0):
            ledger.add(frames[i], i)
        assert {(r["key"], r["refs"], r["there"]) for r in ledger.counts().collect()} == {("a", 2, 0), ("b", 0, 1)}
    assert LedgerStream(spark, f"{tmp_path}/none").orphans().count() == 0
