import glob
import math
import os
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("askweave-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.8g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query of the entry module with its SQL on the smallest tables."""
    import __spark_entry__ as entry

    sf_dir = f"{DATA}/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def compare(name: str) -> None:
        df = entry.queries()[name](spark, sf_dir)
        rel = con.execute(entry.oracle_sql()[name])
        theirs = [c[0] for c in rel.description]
        assert sorted(df.columns) == sorted(theirs)
        ours = Counter(tuple(map(str, (_plain(r[c]) for c in theirs))) for r in df.collect())
        assert ours == Counter(tuple(map(str, map(_plain, r))) for r in rel.fetchall())

    return compare
