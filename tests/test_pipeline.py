"""Query texts, links, ranking, repair and evaluation on small fixtures."""

import pytest
from pyspark.sql import functions as F

from askweave.functions.sqltext import normal_form, schema_names, skeletons
from askweave.operators import linking, profiling, ranking
from askweave.plans.asking import shorthand_of
from askweave.plans.engine import Engine
from askweave.plans.generation import by_rules
from askweave.plans.selection import PLACEHOLDER, choose, closest, exact_match, repair, run_within, same_result
from askweave.sources.catalog import Catalog


@pytest.mark.parametrize(
    "sql, norm",
    [
        ('SELECT  A FROM T WHERE B = "X y";', "select a from t where b = 'X y'"),
        ("SELECT T1.a FROM tab AS T1 JOIN other AS T10 ON T1.i = T10.i", "select tab.a from tab join other on tab.i = other.i"),
        ("SELECT a FROM t ORDER BY count(*) , b DESC LIMIT 3", "select a from t order by count ( * ) asc , b desc limit 3"),
        ("SELECT description FROM t ORDER BY description", "select description from t order by description asc"),
        ("SELECT a FROM (SELECT b FROM t ORDER BY b) WHERE a=1", "select a from ( select b from t order by b asc ) where a = 1"),
        ("", ""),
    ],
)
def test_normal_form(sql, norm):
    assert normal_form(sql) == norm


def test_skeleton(spark):
    df = spark.createDataFrame(
        [("SELECT T1.a , T1.b FROM t AS T1 JOIN u AS T2 ON T1.i = T2.i WHERE T2.c = 'x' AND T1.b > 3 ORDER BY T1.a DESC LIMIT 2",), ("SELECT count(*) FROM t WHERE a IN (SELECT c FROM u) GROUP BY b",), (None,)], "q string"
    )
    names = F.array(*map(F.lit, "t u a b c i t.a t.b t.i u.i u.c".split()))
    got = [r["skeleton"] for r in skeletons(df.withColumn("i", F.monotonically_increasing_id()), "i", F.col("q"), names).orderBy("i").collect()]
    assert got == ["select _ from _ where _ order by _ desc limit _", "select count ( _ ) from _ where _ in ( select _ from _ ) group by _", None]
    schema = "s array<struct<table_name_original:string,column_names_original:array<string>>>"
    rows = spark.createDataFrame([([("T", ["A", None]), (None, None), None],), (None,), ([],)], schema).select(schema_names(F.col("s"))).collect()
    assert [sorted(r[0]) for r in rows] == [["a", "t", "t.a"], [], []]


@pytest.mark.parametrize(
    "question, value, score",
    [
        ("Which singers are from New York?", "New York", 1.0),
        ("Which singers are from the USA?", "usa", 1.0),
        ("How many?", "12", 0.0),
        ("Show the bird's nest", "bird", 1.0),
        ("Show all of the records", "the", 0.0),
        ("", "x", 0.0),
        ("x", "", 0.0),
    ],
)
def test_match_score(question, value, score):
    assert linking.match_score(question, value) == pytest.approx(score)


def test_similarity():
    assert linking.similarity("abcd", "abxd") == pytest.approx(0.75)
    assert linking.similarity("", "") == 1 and linking.similarity("a", "") == 0


def test_profile_types(spark):
    df = spark.createDataFrame([("0", "2001-02-03", "1999", "12", "abc", "x", None), ("1", "2002-03-04", "2001", "3.5", "1d", "x", None)], "flag string, day string, made_year string, n string, s string, one string, start_date string")
    kinds = {r["column_name"]: r["kind"] for r in profiling.types(profiling.distinct_values({"t": df})).collect()}
    assert kinds == {"flag": "boolean", "day": "time", "made_year": "year", "n": "number", "s": "text", "one": "text", "start_date": "time"}
    assert {tuple(r)[2:] for r in profiling.uniqueness(profiling.distinct_values({"t": df})).filter("column_name = 'one'").collect()} == {(1, 2, False)}


def test_auc_by_hand(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (0.3, 0)]
    pairs = [(p, n) for p, a in rows if a for n, b in rows if not b]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert ranking.auc(spark.createDataFrame(rows, "prob double, label int")).collect()[0][0] == pytest.approx(want)
    assert ranking.auc(spark.createDataFrame([], "prob double, label int")).collect()[0][0] is None


def test_top_k_is_stable(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(6)] + [(1, 6, 0.9)], "g int, pos int, prob double")
    assert [r["pos"] for r in ranking.top_k(df, ["g"], "pos", 3, 2).orderBy("place").collect()] == [6, 0, 1]


def test_repair_and_choice(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    assert closest("name", ["nam", "names"]) == "names" and closest("x", []) == ""
    assert repair("select nation.n_nam from nation where nation.n_name = 'nation.n_nam'", engine.catalog) == "select nation.n_name from nation where nation.n_name = 'nation.n_nam'"
    assert choose(engine, ["select", "select x | select nation.n_nam from nation"])[0] == 1
    assert choose(engine, ["nothing", ""]) == (-1, PLACEHOLDER)


def test_timeout(spark):
    slow = spark.range(1, 20_000_000_000, numPartitions=2).selectExpr("sum(sqrt(id) * sin(id) * cos(id)) as s")
    assert run_within(spark, slow, 0.5) is None
    assert run_within(spark, spark.range(3), 60) is not None


def test_exact_match():
    assert exact_match("select a, b from t where c = 1 and d = 2", "select b, a from t where d = 5 and c = 7")
    assert not exact_match("select a from t where c = 1", "select a from t where c = 2 or d = 1")
    assert not exact_match("select a from t where c = 1", "select a from t where c = 2", values=True)
    assert exact_match("select t1.a from t as t1", "select t.a from t", values=True)
    assert not exact_match("select a from t limit 1", "select a from t limit 2", values=True)
    assert not exact_match("not sql", "select a from t")


def test_same_result(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert same_result(a, a.toDF("y")) and not same_result(a, a.distinct()) and not same_result(a, a.selectExpr("x", "x as z"))


def test_questions(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    assert shorthand_of(engine.catalog, "How many customers are there?")[0] == "select count ( customer.* ) from customer"
    assert shorthand_of(engine.catalog, "Show the name of the 3 parts with the lowest retail price")[0] == "select part.p_name from part order by part.p_retailprice asc limit 3"
    catalog = Catalog({"singer": {"singer_id": "double", "name": "string", "age": "double", "city": "string"}, "song": {"song_id": "double", "singer_id": "double", "year": "double"}}, {"singer": "singer_id"}, (("song", "singer_id", "singer", "singer_id"),))
    for question, sql in {
        "What is the name of singers with age over 30 but not with city 'Rome'?": "select singer.name from singer where singer.age > 30 except select singer.name from singer where singer.city = 'Rome'",
        "Find the lowest and the average age of singers with city 'Oslo'": "select min(singer.age), avg(singer.age) from singer where singer.city = 'Oslo'",
        "List the name of singers that have no song with year 1999": "select singer.name from singer where singer.singer_id not in (select song.singer_id from song where song.year = 1999)",
        "Show every city shared by at least 3 singers, and the count": "select singer.city, count(*) from singer group by singer.city having count(*) >= 3",
        "Show the name and age of the top 4 singers by age": "select singer.name, singer.age from singer order by singer.age desc limit 4",
        "Show the name of singers with 'an' in the city": "select singer.name from singer where singer.city like '%an%'",
        "Show the different city values of all singers with city other than 'Rome'": "select distinct singer.city from singer where singer.city != 'Rome'",
    }.items():
        assert by_rules(question, catalog)[:1] == [sql], question
    assert by_rules("", catalog) == [] and by_rules("nothing of this", catalog) == []
    with pytest.raises(ValueError):
        shorthand_of(engine.catalog, "What time is it?")


def test_catalog_row():
    row = {"table_names_original": ["A", "B"], "column_names_original": [{"table_idx": -1, "name": "*"}, {"table_idx": 0, "name": "Id"}, {"table_idx": 1, "name": None}, {"table_idx": 9, "name": "x"}, {"table_idx": 1, "name": "a_id"}], "column_types": ["text", "number"], "primary_keys": [1, 3], "foreign_keys": [{"src": 4, "dst": 1}, {"src": 2, "dst": 1}, None]}
    c = Catalog.of_row(row)
    assert c.tables == {"a": {"id": "double"}, "b": {"a_id": "string"}} and c.primary == {"a": "id"} and c.foreign == (("b", "a_id", "a", "id"),)


def test_windows_and_report(spark):
    df = spark.createDataFrame([([100, 300, 200, 600, 50], 50), ([], 5), (None, 5)], "s array<int>, q int")
    assert [r[0] for r in df.select(ranking.windows(F.col("s"), F.col("q"), 512)).collect()] == [[0, 0, 1, 2, 3], [], None]
    scores = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.2, 1), (0.1, 0)], "prob double, label int")
    assert tuple(ranking.report(scores).collect()[0]) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(ranking.report(scores.limit(0)).collect()[0])[3:] == (None, None, None)
