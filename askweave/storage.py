"""Shared-folder tables: how long lineages are cut so that a lost executor costs nothing but a re-read."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests) one of our own is set."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="askweave-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(fs, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already; the cluster clears its folder then
        fs.delete(path, True)


class SharedTables:
    """Written tables of one run, so that superseded ones can be dropped as the run goes on."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/askweave/{name}-{uuid.uuid4().hex}"
        self.count = 0
        # Results may be read until the driver ends; then the tables go.
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        atexit.register(_delete, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target)

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a table in the shared folder and read it back, free of its lineage."""
        path = self.path()
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._askweave_path = path
        return out

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/t{self.count:04d}"

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table made by :meth:`write`; nothing that still reads it may run afterwards."""
        path = getattr(df, "_askweave_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
