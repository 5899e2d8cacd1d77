import random

import pyarrow as pa

from askweave.operators.shredding import flat_table, schema_leaves, shred

ENTRY = "struct<table_name_original:string,column_names:array<string>,column_names_original:array<string>,db_contents:array<array<string>>>"


def _random_schema(r):
    lists = lambda f: None if r.random() < 0.15 else [f() for _ in range(r.randint(0, 3))]
    text = lambda: None if r.random() < 0.2 else r.choice("abc")

    def entry():
        return None if r.random() < 0.1 else (text(), lists(text), lists(text), lists(lambda: lists(text)))

    return lists(entry)


def _leaves(rec, schema):
    if not schema:
        yield rec, -1, -1, -1
    for t, e in enumerate(schema or []):
        names = e[2] if e else None
        if not names:
            yield rec, t, -1, -1
        for c in range(len(names or [])):
            own = [v for v, x in enumerate((e[3][c] if e[3] and c < len(e[3]) else None) or []) if x is not None]
            yield from ((rec, t, c, v) for v in own or [-1])


def test_levels_by_hand():
    leaf = shred(pa.array([[["a", None], []], None, [], [None, ["b"]]], pa.list_(pa.list_(pa.string()))))["[][]"]
    assert leaf.rep.tolist() == [0, 2, 1, 0, 0, 0, 1]
    assert leaf.definition.tolist() == [5, 4, 3, 0, 1, 2, 5]
    assert leaf.positions(1).tolist() == [0, 0, 1, 0, 0, 0, 1] and leaf.positions(2).tolist() == [0, 1, 0, 0, 0, 0, 0]


def test_leaves_and_tables_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(i if i % 50 else None, _random_schema(r), i, "x") for i in range(400)]
    df = spark.createDataFrame(rows, f"rec long, nested array<{ENTRY}>, _id int, table_pos string").repartition(3)
    assert sorted(map(str, (tuple(x) for x in schema_leaves(df, "rec", "nested").collect()))) == sorted(str(x) for rec, s, *_ in rows for x in _leaves(rec, s))
    got = flat_table(df, "rec", "nested", {"a": "[].column_names_original[]", "b": "[].column_names[]"}, ["t", "c"]).collect()
    want = []
    for rec, s, *_ in rows:
        for t, e in enumerate(s or []):
            a, b = (e[2] or [], e[1] or []) if e else ([], [])
            want += [(rec, t, c, a[c] if c < len(a) else None, b[c] if c < len(b) else None) for c in range(max(len(a), len(b)))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    tables = flat_table(df, "rec", "nested", {"name": "[].table_name_original"}, ["t"]).collect()
    assert sorted(map(str, map(tuple, tables))) == sorted(str((rec, t, e[0] if e else None)) for rec, s, *_ in rows for t, e in enumerate(s or []))


def test_empty_table(spark):
    df = spark.createDataFrame([], f"rec long, nested array<{ENTRY}>")
    assert schema_leaves(df, "rec", "nested").count() == 0
    assert flat_table(df, "rec", "nested", {"name": "[].table_name_original"}, ["t"]).count() == 0


def test_slices_cover_all_rows():
    from askweave.functions.arrow import row_slices, text_slices

    texts = pa.array(["a" * n for n in (0, 5, 50, 3, 0, 200, 1)] + [None], pa.string())
    for values in (texts, texts.slice(2), texts.cast(pa.large_string())):
        for limit in (1, 10, 60, 10_000):
            runs = list(text_slices(values, limit))
            assert [a for a, _ in runs] == [sum(n for _, n in runs[:k]) for k in range(len(runs))] and sum(n for _, n in runs) == len(values)
            assert all(n == 1 or sum(len(x or "") for x in values.slice(a, n).to_pylist()) <= limit for a, n in runs)
    assert list(text_slices(texts.slice(0, 0))) == []
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    assert sum(x.num_rows for x in row_slices(batch, 20)) == len(texts)
