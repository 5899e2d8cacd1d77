import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askweave.functions.text import compact, db_key
from askweave.llm.canon import _by_structure, canonical_query, query_key
from askweave.llm.copies import HASHES, Copies, _merge, _places, _seen, _segments, _short


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("SELECT a , b FROM t WHERE c = 'X y'", 'select  b,a from T where C="x  Y";', True),
        ("SELECT count(*) , a FROM t", "select a, COUNT ( * ) from t", True),
        ("SELECT DISTINCT a, b FROM t", "SELECT DISTINCT b, a FROM t", True),
        ("SELECT a FROM t WHERE b >= 3", "SELECT a FROM t WHERE b > 3", False),
        ("SELECT a FROM t WHERE b = 1 AND c = 2", "SELECT a FROM t WHERE c = 2 AND b = 1", False),
        ("SELECT a FROM t WHERE b IN (SELECT c , d FROM u)", "SELECT a FROM t WHERE b IN (SELECT d , c FROM u)", False),
        ("SELECT (SELECT x FROM u) , a FROM t", "SELECT a , (SELECT x FROM u) FROM t", True),
        ("SELECT a FROM t WHERE b = 1.5", "SELECT a FROM t WHERE b = 15", False),
        ("SELECT 'x, from y' , a FROM t", "SELECT a , 'x, from y' FROM t", True),
        ("", " ; ", True),
    ],
)
def test_canonical_query(a, b, same):
    assert (canonical_query(a) == canonical_query(b)) == same


@settings(max_examples=2000, deadline=None)
@example(["a", ")", ",", "(", "b", "from", "t"], [" "] * 14)
@example(["(", "a", ")", ")", "(", "b", ",", "c", "from"], [""] * 14)
@given(st.lists(st.sampled_from("select distinct all from a b_c t1.x , , ( ) count(*) max( ) 'v' 'x,y' \"from\" ` ; > >= = 1.5 from_x".split(" ")), max_size=14), st.lists(st.sampled_from(["", " ", "\n"]), min_size=14, max_size=14))
def test_simple_queries_take_the_short_way(pieces, gaps):
    sql = "select " + "".join(p + g for p, g in zip(pieces, gaps))
    assert canonical_query(sql) == _by_structure(sql.lower())


def test_compact_question(spark):
    df = spark.createDataFrame([("What is 3.5 , then?",), ("WHAT IS 3.5 THEN",), ("what is 35 then",), ("a.b",), ("`a` > $5!",), ("",), (None,)], "q string")
    assert [r[0] for r in df.select(compact(F.col("q"))).collect()] == ["whatis3.5then", "whatis3.5then", "whatis35then", "ab", "a>$5", "", None]


def _rows():
    r = random.Random(4)
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            rows.append((i, " HOT ", r.choice(["Same?", "same", " SAME !"]), "SELECT a, b FROM t"))
        else:
            rows.append((i, r.choice(["x", "X ", None]), r.choice([None, "", f"q {r.randint(0, 400)}"]), r.choice(["select 1", "SELECT  1;", None, ""])))
    rows += [rows[5], rows[6], (None, "x", "q 1", "select 1"), (9_000, "x", "long " * 50_000, "select 1"), (9_001, "X", "LONG " * 50_000, "select 1;")]
    return rows


@pytest.mark.parametrize("options", [{}, {"max_filter_bytes": 2000, "fetch": True}, {"max_filter_bytes": 200}])
def test_equal_to_brute_force(spark, options):
    rows = _rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "q_id long, db string, question string, query string, _id string, _digest int").repartition(5)
    copies = Copies(df, "q_id", [db_key(F.col("db")), compact(F.col("question")), query_key(F.col("query"))], required=F.col("question"), **options)
    groups = defaultdict(list)
    for i, db, q, s in rows:
        if q is not None:
            groups[(None if db is None else db.strip().lower(), "".join(c for c in q.lower() if c.isalnum()), None if s is None else canonical_query(s))].append(i)
    want = set()
    for ids in groups.values():
        first = min((i for i in ids if i is not None), default=None)
        want |= {(first, i) for i in ids if i is not None and i != first}
    assert {tuple(r) for r in copies.members(hot=100).collect()} == want
    got = copies.collapsed()
    assert got.agg(F.sum("copies")).first()[0] == len(rows)
    assert sorted(r["copies"] for r in got.filter("copies > 1").collect()) == sorted(len(g) for g in groups.values() if len(g) > 1)


def test_empty(spark):
    copies = Copies(spark.createDataFrame([], "q_id long, q string"), "q_id", [F.col("q")])
    assert copies.members().count() == 0 and copies.collapsed().count() == 0


@pytest.mark.parametrize("options", [{}, {"max_filter_bytes": 1500}])  # one pass, and twenty
def test_filter_clears_most_singletons(spark, options):
    df = spark.range(20_000).select("id", F.concat(F.lit("t"), (F.col("id") % 19_000).cast("string")).alias("t"))
    maybe = Copies(df, "id", [F.col("t")], **options).maybe.count()
    assert 2000 <= maybe < 3000


@pytest.mark.parametrize("n", [50, 5000])
def test_filter_as_hashes_and_as_bit_maps(n):
    r = np.random.default_rng(1)
    parts = [r.integers(-(2**63), 2**63, n) for _ in range(3)]
    parts[1][:5], parts[2][:3] = parts[0][:5], parts[2][5:8]
    shares = [b for p in parts for b in _seen(3, 12)(iter([pa.record_batch([pa.array(p)], ["h"])]))]
    assert {x for b in shares for x in b.column("maps").to_pylist()} == {n == 5000}
    table = pa.Table.from_batches(shares)
    merged = {s: np.unpackbits(np.frombuffer(_merge(12)(table.filter(pc.equal(table["segment"], s)))["bits"][0].as_buffer(), np.uint8)) for s in range(3)}
    every = np.concatenate(parts)
    for s in range(3):
        own = every[_segments(every, 3) == s]
        kinds, times = np.unique(own, return_counts=True)
        places = [set(p) for p in _places(_short(kinds, 3), 12).T.tolist()]
        want = {x for p, t in zip(places, times) for x in p if t > 1} | {x for x, c in Counter(x for p in _places(_short(kinds, 3), 12).T.tolist() for x in p).items() if c > 1}
        assert set(np.flatnonzero(merged[s])) == want


def test_places_are_spread():
    p = _places(np.arange(10_000, dtype=np.int64), 16)
    assert p.shape == (HASHES, 10_000) and len(np.unique(p[0])) > 8_500
