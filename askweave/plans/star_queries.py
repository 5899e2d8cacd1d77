"""The query language over the star schema: one query per operator, each with hand-written SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askweave.plans.asking import ask
from askweave.plans.engine import Engine
from askweave.plans.inference import Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The shorthand texts by query, with their options.
SHORTHANDS: dict[str, tuple[str, Options]] = {}


def _add(name: str, kind: str, text: str, names: str, oracle: str, **options: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, out = Engine(spark, sf_dir), names.split()
        return engine.sql(text, out) if kind == "sql" else engine.shorthand(text, out, Options(**options))

    QUERIES[name], ORACLES[name] = run, oracle
    if kind == "short":
        SHORTHANDS[name] = (text, Options(**options))


# Projections, filters, predicates
_add("scan_project", "sql", "select n_name, n_regionkey from nation", "n_name n_regionkey", "SELECT n_name, n_regionkey FROM nation")
_add("scan_star", "sql", "select * from region", "r_regionkey r_name", "SELECT r_regionkey, r_name FROM region")
_add("select_distinct", "sql", "select distinct c_mktsegment, c_nationkey from customer", "segment nation", "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer")
_add("arith_projection", "sql", "select l_orderkey, l_extendedprice * l_discount from lineitem where l_quantity + l_linenumber > 50", "orderkey cut", "SELECT l_orderkey AS orderkey, l_extendedprice * l_discount AS cut FROM lineitem WHERE l_quantity + l_linenumber > 50")
_add("int_division", "sql", "select p_partkey, p_partkey / p_size from part", "partkey ratio", "SELECT p_partkey AS partkey, p_partkey // p_size AS ratio FROM part")
_add("filter_cmp", "sql", "select o_orderkey, o_totalprice from orders where o_totalprice >= 200000 and o_orderstatus != 'F'", "orderkey price", "SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F'")
_add("filter_text_number", "sql", "select p_partkey from part where p_size > '45'", "partkey", "SELECT p_partkey AS partkey FROM part WHERE p_size > 45")
_add("filter_between", "sql", "select p_partkey, p_size from part where p_size between 10 and 15", "partkey size", "SELECT p_partkey AS partkey, p_size AS size FROM part WHERE p_size BETWEEN 10 AND 15")
_add("filter_and_or", "sql", "select s_suppkey from supplier where s_nationkey = 3 or s_acctbal > 5000 and s_nationkey > 12", "suppkey", "SELECT s_suppkey AS suppkey FROM supplier WHERE s_nationkey = 3 OR (s_acctbal > 5000 AND s_nationkey > 12)")
_add("filter_not", "sql", "select s_suppkey from supplier where not (s_nationkey = 3 or s_acctbal > 5000)", "suppkey", "SELECT s_suppkey AS suppkey FROM supplier WHERE NOT (s_nationkey = 3 OR s_acctbal > 5000)")
_add("filter_like", "sql", "select p_partkey, p_name from part where p_name like '%BLUE%'", "partkey name", "SELECT p_partkey AS partkey, p_name AS name FROM part WHERE p_name ILIKE '%BLUE%'")
_add("filter_not_like", "sql", "select p_partkey from part where p_name not like 'b%'", "partkey", "SELECT p_partkey AS partkey FROM part WHERE p_name NOT ILIKE 'b%'")
_add("filter_in_list", "sql", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("filter_in_subquery", "sql", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_add("filter_not_in_subquery", "sql", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_add("filter_in_or", "sql", "select c_custkey from customer where c_acctbal > 9000 or c_custkey in (select o_custkey from orders where o_totalprice > 400000)", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_add(
    "not_in_or_nulls", "sql", "select doc_id from documents where doc_id = 3 or lang not in (select lang from documents where doc_id < 400)", "doc_id",
    "SELECT doc_id FROM documents WHERE doc_id = 3 OR lang NOT IN (SELECT lang FROM documents WHERE doc_id < 400)",
)
_add(
    "not_in_or_full", "sql", "select doc_id from documents where doc_id = 3 or lang not in (select lang from documents where lang = 'en' or lang = 'de')", "doc_id",
    "SELECT doc_id FROM documents WHERE doc_id = 3 OR lang NOT IN (SELECT lang FROM documents WHERE lang IN ('en', 'de'))",
)
_add(
    "not_of_in", "sql", "select s_suppkey from supplier where not (s_nationkey in (select c_nationkey from customer where c_acctbal > 9000) or s_acctbal > 5000)", "suppkey",
    "SELECT s_suppkey AS suppkey FROM supplier WHERE NOT (s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) OR s_acctbal > 5000)",
)
_add(
    "in_or_mixed_types", "sql", "select p_partkey from part where p_size = 7 or p_name in (select s_suppkey from supplier) or p_partkey in (select r_name from region)", "partkey",
    "SELECT p_partkey AS partkey FROM part WHERE p_size = 7 OR TRY_CAST(p_name AS DOUBLE) IN (SELECT s_suppkey FROM supplier) OR p_partkey IN (SELECT TRY_CAST(r_name AS DOUBLE) FROM region WHERE TRY_CAST(r_name AS DOUBLE) IS NOT NULL)",
)
_add(
    "distinct_order_other", "sql", "select distinct c_nationkey from customer order by c_acctbal desc limit 9", "nation",
    "SELECT c_nationkey AS nation FROM customer GROUP BY 1 ORDER BY max(c_acctbal) DESC LIMIT 9",
)
_add("filter_exists", "sql", "select r_name from region where exists (select n_name from nation where n_nationkey > 20)", "name", "SELECT r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)")
_add("filter_is_null", "sql", "select count(*) from documents where lang is null", "n", "SELECT count(*) AS n FROM documents WHERE lang IS NULL")
_add("filter_is_not_null", "sql", "select count(*) from documents where title is not null", "n", "SELECT count(*) AS n FROM documents WHERE title IS NOT NULL")
_add("col_col_compare", "sql", "select l_orderkey, l_linenumber from lineitem where l_linenumber > l_quantity", "orderkey line", "SELECT l_orderkey AS orderkey, l_linenumber AS line FROM lineitem WHERE l_linenumber > l_quantity")
_add("scalar_subquery_avg", "sql", "select p_partkey from part where p_retailprice > (select avg(p_retailprice) from part)", "partkey", "SELECT p_partkey AS partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
_add("scalar_first_row", "sql", "select c_custkey from customer where c_nationkey = (select n_nationkey from nation order by n_nationkey desc limit 1)", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_nationkey = (SELECT max(n_nationkey) FROM nation)")

# Joins
_add("join_explicit", "sql", "select t1.n_name, t2.r_name from nation as t1 join region as t2 on t1.n_regionkey = t2.r_regionkey", "nation region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("join_inferred_2", "short", "select nation.n_name , region.r_name from nation", "nation region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("join_inferred_4", "short", "select region.r_name , count ( orders.* ) from region group by region.r_name", "region n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
_add("join_bridge_choice", "short", "select part.p_brand , count ( lineitem.* ) from part where supplier.s_nationkey = 7 group by part.p_brand", "brand n", "SELECT p_brand AS brand, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 7 GROUP BY p_brand")
_add("join_forced", "short", "select nation.n_name , count ( lineitem.* ) from nation where @.@ join supplier.* group by nation.n_name", "nation n", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY n_name")
_add(
    "join_long_chain", "short", "select region.r_name , count ( lineitem.* ) from region where part.p_size = 5 and customer.c_mktsegment = 'BUILDING' and orders.o_totalprice > 1000 group by region.r_name", "region n",
    """SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
       JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = 5 AND c_mktsegment = 'BUILDING' AND o_totalprice > 1000 GROUP BY 1""",
)
_add("join_any_table", "short", "select count ( distinct customer.c_custkey ) from customer where @.@ = orders.*", "n", "SELECT count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey")
_add("self_join", "sql", "select a.n_name, b.n_name from nation as a join nation as b on a.n_regionkey = b.n_regionkey where a.n_nationkey < b.n_nationkey", "first second", "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
_add("cross_join", "sql", "select r_name, n_name from region join nation", "region nation", "SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
_add("derived_table", "sql", "select t.c_nationkey, avg(t.c_acctbal) from (select c_nationkey, c_acctbal from customer where c_acctbal > 0) as t group by t.c_nationkey", "nation mean", "SELECT c_nationkey AS nation, avg(c_acctbal) AS mean FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
_add("theta_join", "sql", "select r.r_name, count(*) from region as r join nation as n on r.r_regionkey < n.n_regionkey group by r.r_name", "region n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON r_regionkey < n_regionkey GROUP BY r_name")
_add("semi_inferred", "short", "select customer.c_name from customer where customer.c_custkey in orders.o_custkey and orders.o_totalprice > 400000", "name", "SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_add("anti_inferred", "short", "select customer.c_name from customer where @.@ not in orders.*", "name", "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_add("anti_twin", "short", "select part.p_name from part where part.p_partkey not in part.p_partkey and lineitem.l_quantity > 49", "name", "SELECT p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
_add("nested_twice", "short", "select region.r_name from region where region.r_regionkey in nation.n_regionkey and nation.n_nationkey in customer.c_nationkey sub customer.c_acctbal > 9900", "name", "SELECT r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900))")

# Aggregation
_add("agg_global", "sql", "select count(*), min(o_totalprice), max(o_totalprice), sum(o_totalprice), avg(o_totalprice) from orders", "n low high total mean", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders")
_add("agg_group", "sql", "select l_returnflag, l_linestatus, sum(l_quantity), avg(l_discount), count(*) from lineitem group by l_returnflag, l_linestatus", "flag status qty discount n", "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, avg(l_discount) AS discount, count(*) AS n FROM lineitem GROUP BY ALL")
_add("agg_distinct", "sql", "select o_orderstatus, count(distinct o_custkey) from orders group by o_orderstatus", "status n", "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
_add("agg_having", "sql", "select o_custkey, count(*) from orders group by o_custkey having count(*) > 15 and max(o_totalprice) > 100000", "custkey n", "SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 100000")
_add("agg_expr", "sql", "select l_returnflag, sum(l_extendedprice * l_discount) from lineitem group by l_returnflag", "flag cut", "SELECT l_returnflag AS flag, sum(l_extendedprice * l_discount) AS cut FROM lineitem GROUP BY l_returnflag")
_add("having_inferred", "short", "select customer.c_name from customer where count ( orders.* ) > 15", "name", "SELECT min(c_name) AS name FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) > 15")
_add("group_inferred", "short", "select nation.n_name from nation where count ( supplier.* ) >= 5", "name", "SELECT min(n_name) AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(*) >= 5")
_add("group_by_projection", "short", "select orders.o_orderpriority , count ( orders.* ) from orders", "priority n", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1", group_always=True)
_add("group_to_in", "short", "select customer.c_name from customer where count ( orders.* ) > 15", "name", "SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 15)", group_to_in=True)
_add("bare_column_least", "short", "select nation.n_name , max ( customer.c_acctbal ) from nation", "name most", "SELECT min(n_name) AS name, max(c_acctbal) AS most FROM nation JOIN customer ON c_nationkey = n_nationkey")
_add("fan_out_to_in", "short", "select sum ( orders.o_totalprice ) from orders where lineitem.l_quantity > 45", "total", "SELECT sum(o_totalprice) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", fan_out_to_in=True)

# Order, limit, superlatives
_add("order_single", "sql", "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey asc limit 10", "suppkey balance", "SELECT s_suppkey AS suppkey, s_acctbal AS balance FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
_add("order_nulls_first", "sql", "select doc_id, lang from documents order by lang asc, doc_id asc limit 20", "doc_id lang", "SELECT doc_id, lang FROM documents ORDER BY lang ASC NULLS FIRST, doc_id LIMIT 20")
_add("order_by_agg", "short", "select nation.n_name , count ( orders.* ) from nation group by nation.n_name order by count ( orders.* ) desc , nation.n_name limit 5", "nation n", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name ORDER BY n DESC, nation LIMIT 5")
_add("order_group_inferred", "short", "select customer.c_name from customer order by sum ( orders.o_totalprice ) desc limit 3", "name", "SELECT min(c_name) AS name FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY sum(o_totalprice) DESC LIMIT 3")
_add("topk", "sql", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 7", "orderkey", "SELECT o_orderkey AS orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
_add("superlative_max", "short", "select part.p_name , part.p_retailprice from part where part.p_size = 10 and part.p_retailprice = max ( part.p_retailprice )", "name price", "SELECT p_name AS name, p_retailprice AS price FROM part WHERE p_size = 10 ORDER BY p_retailprice DESC LIMIT 1")
_add("superlative_min", "short", "select supplier.s_name from supplier where supplier.s_acctbal = min ( supplier.s_acctbal )", "name", "SELECT s_name AS name FROM supplier ORDER BY s_acctbal LIMIT 1")
_add("superlative_agg", "short", "select nation.n_name from nation where sum ( supplier.s_acctbal ) = max ( supplier.s_acctbal )", "name", "SELECT min(n_name) AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey ORDER BY sum(s_acctbal) DESC LIMIT 1")
_add("nested_order_limit", "short", "select nation.n_name from nation where nation.n_nationkey in customer.c_nationkey order by customer.c_acctbal desc limit 1", "name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer ORDER BY c_acctbal DESC LIMIT 1)")
_add("scalar_inferred", "short", "select part.p_name from part where part.p_retailprice > avg ( part.p_retailprice ) and part.p_size = 10", "name", "SELECT p_name AS name FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part WHERE p_size = 10)")

# Set operations
_add("set_intersect", "sql", "select c_nationkey from customer where c_mktsegment = 'BUILDING' intersect select s_nationkey from supplier", "nation", "SELECT c_nationkey AS nation FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey FROM supplier")
_add("set_union", "sql", "select c_nationkey from customer where c_acctbal > 9500 union select s_nationkey from supplier order by c_nationkey", "nation", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9500 UNION SELECT s_nationkey FROM supplier")
_add("set_except", "sql", "select n_nationkey from nation except select s_nationkey from supplier where s_acctbal > 3000", "nation", "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
_add("set_chain", "sql", "select n_nationkey from nation union select s_suppkey from supplier intersect select p_size from part", "k", "(SELECT n_nationkey AS k FROM nation UNION SELECT s_suppkey FROM supplier) INTERSECT SELECT p_size FROM part")
_add("intersect_inferred", "short", "select nation.n_name from nation where customer.c_mktsegment = 'BUILDING' and customer.c_mktsegment = 'MACHINERY'", "name", "SELECT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'")
_add("union_inferred", "short", "select nation.n_name from nation where customer.c_acctbal > 9900 or supplier.s_acctbal > 9900", "name", "SELECT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9900 UNION SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9900", union=True)
_add("except_inferred", "short", "select nation.n_name from nation where customer.c_mktsegment != 'BUILDING'", "name", "SELECT n_name AS name FROM nation EXCEPT SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'", except_=True)
_add("except_branch", "short", "select nation.n_name from nation where nation.n_nationkey >= 0 except_ supplier.s_acctbal > 9000", "name", "SELECT n_name AS name FROM nation EXCEPT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000")
_add("union_other_table", "short", "select customer.c_nationkey from customer where customer.c_acctbal > 9500 union_ @.@ is supplier.* and supplier.s_acctbal > 9000", "nation", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9500 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
_add("set_to_in", "short", "select count ( nation.* ) from nation where customer.c_mktsegment = 'BUILDING' intersect_ customer.c_mktsegment = 'MACHINERY'", "n", "SELECT count(*) AS n FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT n_nationkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY')")

_add(
    "union_to_where", "short", "select part.p_brand from part where part.p_size = 7 union_ part.p_retailprice > 1500", "brand",
    "SELECT DISTINCT p_brand AS brand FROM part WHERE p_size = 7 OR p_retailprice > 1500", sets_to_where=True,
)
_add(
    "intersect_to_where", "short", "select supplier.s_suppkey from supplier where supplier.s_acctbal > 0 intersect_ supplier.s_nationkey > 12", "suppkey",
    "SELECT s_suppkey AS suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey > 12", sets_to_where=True,
)
_add(
    "intersect_of_bounds", "short", "select nation.n_name from nation where supplier.s_acctbal > 5000 and supplier.s_acctbal < 1000", "name",
    """SELECT n_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 INTERSECT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 1000""",
)


# Questions in words
def _ask(name: str, question: str, names: str, oracle: str) -> None:
    QUERIES[name], ORACLES[name] = (lambda spark, sf_dir: ask(Engine(spark, sf_dir), question, names.split())), oracle


_ask("ask_count", "How many customers are there?", "n", "SELECT count(*) AS n FROM customer")
_ask("ask_list", "List the name of all regions.", "name", "SELECT r_name AS name FROM region")
_ask("ask_count_per_column", "How many orders are there for each order status?", "status n", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
_ask("ask_count_per_table", "How many customers does each nation have?", "nation n", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
_ask("ask_average", "What is the average account balance of suppliers?", "mean", "SELECT avg(s_acctbal) AS mean FROM supplier")
_ask("ask_above", "Show the name of suppliers with account balance over 9000.", "name", "SELECT s_name AS name FROM supplier WHERE s_acctbal > 9000")
_ask("ask_between", "Which parts have a size between 10 and 12? Show their name.", "name", "SELECT p_name AS name FROM part WHERE p_size BETWEEN 10 AND 12")
_ask("ask_without", "List the name of customers without orders.", "name", "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_ask("ask_top", "List the name of the 5 suppliers with the highest account balance.", "name", "SELECT s_name AS name FROM supplier ORDER BY s_acctbal DESC LIMIT 5")
_ask("ask_value", "Give the average total price of orders of customers in the segment 'BUILDING'.", "mean", "SELECT avg(o_totalprice) AS mean FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_ask("ask_value_home", "How many customers are in 'ASIA'?", "n", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_ask("ask_having", "Which nations have more than 5 suppliers? Show the name.", "name", "SELECT min(n_name) AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(*) > 5")
_ask("ask_group_agg", "Show the average retail price per brand of parts.", "brand mean", "SELECT p_brand AS brand, avg(p_retailprice) AS mean FROM part GROUP BY 1")
