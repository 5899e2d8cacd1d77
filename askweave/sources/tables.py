"""Parquet tables by name."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Schemas read so far, per session, by path and time of change: a table's footer is read once, not once a query.
_SCHEMAS: WeakKeyDictionary[SparkSession, dict[tuple[str, int], StructType]] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder; columns and filters reach the scan through Catalyst."""
    path = f"{sf_dir}/{name}.parquet"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    changed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getModificationTime()
    known = _SCHEMAS.setdefault(spark, {})
    if (path, changed) not in known:
        known[path, changed] = spark.read.parquet(path).schema
    return spark.read.schema(known[path, changed]).parquet(path)
