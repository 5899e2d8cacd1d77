"""Every core query against its SQL, and the queries without SQL for rows."""

import pytest

from askweave.plans import catalog_queries, pipeline_queries, queries, question_queries, record_queries, star_queries

CORE = star_queries.QUERIES | pipeline_queries.QUERIES | record_queries.QUERIES | catalog_queries.QUERIES | question_queries.QUERIES | queries.QUERIES
ORACLES = star_queries.ORACLES | pipeline_queries.ORACLES | record_queries.ORACLES | catalog_queries.ORACLES | question_queries.ORACLES | queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(name)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(ORACLES)))
def test_has_rows(name, spark):
    assert CORE[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [tuple(r) for r in rows] == [("NATION_19", 126), ("NATION_11", 118), ("NATION_17", 97), ("NATION_10", 91), ("NATION_13", 83)]
