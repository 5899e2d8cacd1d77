"""Parser, inference and emission on hand-written pairs; lowering against the emitted text."""

import pytest

from askweave.plans.emit import query_sql
from askweave.plans.engine import Engine
from askweave.plans.inference import Options, expand, strip_values
from askweave.plans.joins import all_paths, closure, covering
from askweave.plans.parser import QueryError, parse_shorthand, parse_sql
from askweave.sources.catalog import STAR_FOREIGN, STAR_PRIMARY, Catalog

TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_size p_retailprice", "orders": "o_orderkey o_custkey o_totalprice", "lineitem": "l_orderkey l_partkey l_suppkey l_quantity", "events": "event_id user_id",
}
STAR = Catalog({t: {c: "string" if c.endswith("name") or c.endswith("segment") else "double" if "price" in c or "bal" in c else "bigint" for c in cs.split()} for t, cs in TABLES.items()}, STAR_PRIMARY, tuple(STAR_FOREIGN))


@pytest.mark.parametrize(
    "short, full",
    [
        ("select nation.n_name , region.r_name from nation", "select nation.n_name, region.r_name from nation join region on nation.n_regionkey = region.r_regionkey"),
        (
            "select nation.n_name , count ( orders.* ) from nation group by nation.n_name order by count ( orders.* ) desc limit 5",
            "select nation.n_name, count(*) from nation join customer on customer.c_nationkey = nation.n_nationkey join orders on orders.o_custkey = customer.c_custkey group by nation.n_name order by count(*) desc limit 5",
        ),
        ("select customer.c_name from customer where count ( orders.* ) > 3", "select min(customer.c_name) from customer join orders on orders.o_custkey = customer.c_custkey group by customer.c_custkey having count(*) > 3"),
        ("select part.p_name from part where part.p_size = max ( part.p_size )", "select part.p_name from part order by part.p_size desc limit 1"),
        ("select customer.c_name from customer where @.@ not in orders.*", "select customer.c_name from customer where customer.c_custkey not in (select orders.o_custkey from orders)"),
        ("select part.p_name from part where part.p_retailprice > avg ( part.p_retailprice )", "select part.p_name from part where part.p_retailprice > (select avg(part.p_retailprice) from part)"),
        (
            "select nation.n_name from nation where customer.c_mktsegment = 'A' and customer.c_mktsegment = 'B'",
            "select nation.n_name from nation join customer on customer.c_nationkey = nation.n_nationkey where customer.c_mktsegment = 'A' intersect select nation.n_name from nation join customer on customer.c_nationkey = nation.n_nationkey where customer.c_mktsegment = 'B'",
        ),
    ],
)
def test_expand(short, full):
    assert query_sql(expand(short, STAR)) == full


def test_switches():
    text = "select nation.n_name from nation where customer.c_mktsegment = 'A' and customer.c_mktsegment = 'B'"
    assert "intersect" not in query_sql(expand(text, STAR, Options(intersect=False)))
    assert "union" in query_sql(expand("select nation.n_name from nation where customer.c_acctbal > 1 or supplier.s_acctbal > 1", STAR, Options(union=True)))


def test_and_binds_more_tightly_than_or():
    assert query_sql(expand("select part.p_name from part where part.p_size = 1 or part.p_size = 2 and part.p_name = 'x'", STAR)) == "select part.p_name from part where part.p_size = 1 or part.p_size = 2 and part.p_name = 'x'"
    text = "select p_name from part where (p_size = 1 or p_size = 2) and p_name = 'x'"
    assert query_sql(parse_sql(text)) == text


def test_each_order_key_has_its_direction():
    assert query_sql(parse_sql("select a from t order by a desc, b, c asc")) == "select a from t order by a desc, b asc, c asc"


@pytest.mark.parametrize("text", ["select", "select a from", "drop table t", "select a from t where", "select a from t limit x", "select a from t )", "select a from t where b ~ 1"])
def test_unreadable(text):
    with pytest.raises(QueryError):
        parse_sql(text)


def test_values_are_stripped():
    q = strip_values(parse_sql("select a from t where b = 'x' and c > 3 limit 7"))
    assert query_sql(q) == "select a from t where b = 'terminal' and c > 'terminal' limit 1"


def test_quotes_round_trip():
    assert query_sql(parse_sql("select a from t where b = 'it''s'")) == "select a from t where b = 'it''s'"
    assert query_sql(parse_shorthand('select t.a from t where t.b = "x"').__class__(**{**parse_sql("select a from t").__dict__})) == "select a from t"


def test_paths():
    assert covering(STAR, ["nation", "orders"]) == ["nation", "customer", "orders"]
    assert covering(Catalog({"a": {"x": "int"}, "b": {"y": "int"}}), ["a", "b"]) is None
    assert len(all_paths(STAR, 1)) == len(TABLES)
    assert closure((("a", "x", "b", "y"), ("b", "y", "c", "z"))) == {("a", "x", "b", "y"), ("b", "y", "c", "z"), ("a", "x", "c", "z")}


def test_lowering_equals_emitted_text(spark):
    """Portable texts: what DataFrames give is what Spark's own parser gives for the emitted SQL."""
    sf_dir = "/root/testdata/sf0.001"
    engine = Engine(spark, sf_dir)
    for t in engine.catalog.tables:
        engine.table(t).createOrReplaceTempView(t)
    texts = [
        "select region.r_name , count ( orders.* ) from region group by region.r_name",
        "select customer.c_name from customer where @.@ not in orders.*",
        "select nation.n_name from nation where customer.c_mktsegment = 'BUILDING' and customer.c_mktsegment = 'MACHINERY'",
        "select part.p_name from part where part.p_retailprice > avg ( part.p_retailprice ) and part.p_size = 10",
        "select nation.n_name from nation where count ( supplier.* ) >= 1",
    ]
    for text in texts:
        a, b = engine.shorthand(text), spark.sql(engine.explain(text)).toDF(*engine.shorthand(text).columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), text


def test_null_semantics(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k int, s string").write.parquet(f"{tmp_path}/l.parquet")
    spark.createDataFrame([(1,), (None,)], "k int").write.parquet(f"{tmp_path}/r.parquet")
    spark.createDataFrame([], "k int").write.parquet(f"{tmp_path}/e.parquet")
    engine = Engine(spark, str(tmp_path), Catalog({"l": {"k": "int", "s": "string"}, "r": {"k": "int"}, "e": {"k": "int"}}))
    assert engine.sql("select k from l where k not in (select k from r)").collect() == []
    assert engine.sql("select k from l where k not in (select k from e)").count() == 3
    assert [r[0] for r in engine.sql("select k from l where k not in (select k from r where k is not null)").collect()] == [2]
    assert [r[0] for r in engine.sql("select k from l order by k").collect()] == [None, 1, 2]
    assert [r[0] for r in engine.sql("select k from l where s is null").collect()] == [2]
    assert engine.sql("select k / 0 from l where k = 1").collect()[0][0] is None
    assert [r[0] for r in engine.sql("select k from l where s like 'A'").collect()] == [1]
    assert engine.sql("select k from l where s > 1").collect() == []


def test_in_below_or_and_not(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (99,), (None,)], "a int").write.parquet(f"{tmp_path}/t.parquet")
    spark.createDataFrame([(1,), (None,)], "b int").write.parquet(f"{tmp_path}/u.parquet")
    spark.createDataFrame([("1",), ("x",)], "s string").write.parquet(f"{tmp_path}/w.parquet")
    spark.createDataFrame([], "b int").write.parquet(f"{tmp_path}/e.parquet")
    engine = Engine(spark, str(tmp_path), Catalog({"t": {"a": "int"}, "u": {"b": "int"}, "e": {"b": "int"}, "w": {"s": "string"}}))
    rows = lambda where: {r[0] for r in engine.sql(f"select a from t where {where}").collect()}
    assert rows("a = 99 or a not in (select b from u)") == {99}
    assert rows("not a in (select b from u)") == set()
    assert rows("a = 2 or a in (select b from u)") == {1, 2}
    assert rows("a = 2 or a not in (select b from e)") == {1, 2, 99, None}
    assert rows("a = 2 or a not in (select b from u where b is not null)") == {2, 99}
    assert rows("a = 2 or a in (select s from w)") == {1, 2}
    assert {r[0] for r in engine.sql("select s from w where s = 'x' or s in (select b from u)").collect()} == {"1", "x"}


def test_distinct_with_another_order(spark, tmp_path):
    spark.createDataFrame([("a", 3), ("b", 2), ("a", 1), ("c", 0)], "k string, v int").write.parquet(f"{tmp_path}/t.parquet")
    engine = Engine(spark, str(tmp_path), Catalog({"t": {"k": "string", "v": "int"}}))
    assert [r[0] for r in engine.sql("select distinct k from t order by v").collect()] == ["c", "a", "b"]
    assert [r[0] for r in engine.sql("select distinct k from t order by v desc limit 2").collect()] == ["a", "b"]


def chain(n):
    names = [f"t{i}" for i in range(n)]
    return Catalog({t: {"id": "int", "up": "int"} for t in names}, {t: "id" for t in names}, tuple((names[i], "up", names[i - 1], "id") for i in range(1, n)))


def test_paths_of_any_length_and_no_silent_product():
    long = chain(30)
    assert covering(long, ["t0", "t29"]) == list(long.tables)
    assert covering(long, [f"t{i}" for i in range(0, 30, 2)]) == [f"t{i}" for i in range(29)]
    apart = Catalog({"a": {"x": "int"}, "b": {"y": "string"}})
    with pytest.raises(QueryError):
        expand("select a.x , b.y from a", apart)
    assert query_sql(expand("select a.x , b.y from a", apart, Options(cross=True))) == "select a.x, b.y from a cross join b"
    ring = Catalog({t: {"id": "int", "k": "int"} for t in "abcd"}, {t: "id" for t in "abcd"}, (("b", "k", "a", "id"), ("c", "k", "a", "id"), ("d", "k", "b", "id"), ("d", "id", "c", "id")))
    assert covering(ring, ["a", "d"], frozenset("c")) == ["a", "c", "d"] and covering(ring, ["a", "d"]) == ["a", "b", "d"]
