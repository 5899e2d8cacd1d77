import random

from pyspark.sql import functions as F

from askweave.llm import components as module
from askweave.llm.components import RelatedSplits, components


def _sets(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[root(a)] = root(b)
    out = {}
    for x in list(parent):
        out.setdefault(root(x), set()).add(x)
    return {frozenset(s) for s in out.values()}


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["label"], set()).add(r["node"])
    return {frozenset(s) for s in out.values()}


def test_components_equal_union_find(spark, monkeypatch):
    r = random.Random(6)
    edges = [(f"n{r.randint(0, 300)}", f"n{r.randint(0, 300)}") for _ in range(170)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(25)] + [("hub", f"h{i}") for i in range(200)] + [("l", "l"), (None, "x"), ("x", None)] + edges[:20]
    df = spark.createDataFrame(edges, "a string, b string")
    assert _found(components(df, hub=20)) == _sets(edges)
    monkeypatch.setattr(module, "SMALL", 3)  # contract the graph of labels by searches as well
    assert _found(components(df)) == _sets(edges)
    assert components(df.limit(0)).count() == 0


def test_related_splits(spark):
    r = random.Random(7)
    rows = [(i, r.choice(["big"] * 3 + [f"d{r.randint(0, 400)}" for _ in range(6)] + [None]), r.choice([None, None, f"a{r.randint(0, 900)}"])) for i in range(3000)]
    rows += [(5000, None, None), (5001, None, None), rows[3]]
    df = spark.createDataFrame([(*x, "n") for x in rows], "id long, db string, author string, node string")
    splits = RelatedSplits(df, "id", {"db": F.col("db"), "author": F.col("author")})
    got = {x["id"]: (x["component"], x["split"]) for x in splits.assigned({"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert set(got) == {x[0] for x in rows}
    for at in (1, 2):
        home = {}
        for x in rows:
            if x[at] is not None:
                assert home.setdefault(x[at], got[x[0]]) == got[x[0]]
    share = {s: sum(v[1] == s for v in got.values()) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    sets = _sets([(f"db:{d}", f"author:{a}") for _, d, a in rows if d is not None and a is not None])
    want = {(a, b) for s in sets for a in (x[3:] for x in s if x.startswith("db:")) for b in (x[3:] for x in s if x.startswith("db:")) if a < b}
    assert {tuple(x) for x in splits.linked("db").collect()} == want
    empty = RelatedSplits(df.limit(0), "id", {"db": F.col("db"), "author": F.col("author")})
    assert empty.assigned({"train": 0.5, "test": 0.5}).count() == 0 and empty.linked("db").count() == 0
