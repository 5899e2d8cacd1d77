import pytest

from askweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))
