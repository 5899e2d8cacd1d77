"""The reference ledger kept up by a stream of deltas: references and records may come late and in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askweave.operators.references import counts, current_report, summed

SCHEMA = "key string, src_table string, src_field string, period timestamp_ntz, refs long, there long"


class LedgerStream:
    """Signed counts per key, and of references per table, field and period, in tables under ``path``.

    A batch of deltas is summed and written as a table of its own, so its cost is that of its own rows, whatever the ledger holds. After
    ``merge_every`` batches all tables become one. Readers add up the tables that are there. A batch that is run again after a failure
    overwrites its own table, and a merged table replaces its parts only once it is whole, so nothing counts twice.
    """

    def __init__(self, spark: SparkSession, path: str, merge_every: int = 16):
        self.spark, self.path, self.merge_every = spark, path.rstrip("/"), merge_every

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _whole(self, kind: str) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[0] == kind and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1]))

    def parts(self) -> list[str]:
        """The tables that make up the ledger: the newest merged one and the batches after it."""
        merged = self._whole("m")[-1:]
        return [f"m{i:012d}" for i in merged] + [f"b{i:012d}" for i in self._whole("b") if not merged or i > merged[0]]

    def counts(self) -> DataFrame:
        own = [f"{self.path}/{n}" for n in self.parts()]
        return summed(self.spark.read.schema(SCHEMA).parquet(*own)) if own else self.spark.createDataFrame([], SCHEMA)

    def add(self, deltas: DataFrame, batch: int) -> None:
        """Take in a batch of :func:`askweave.operators.references.delta` entries."""
        if batch in self._whole("m") or any(batch <= m for m in self._whole("m")):
            return  # run again after it was merged
        counts(deltas).write.mode("overwrite").parquet(f"{self.path}/b{batch:012d}")
        if len(self.parts()) > self.merge_every:
            self.counts().write.mode("overwrite").parquet(f"{self.path}/m{batch:012d}")
            for kind in "bm":
                for old in self._whole(kind):
                    if old < batch or kind == "b" and old == batch:
                        fs, p = self._fs(f"{self.path}/{kind}{old:012d}")
                        fs.delete(p, True)

    def orphans(self) -> DataFrame:
        """Keys with references above zero and no existence."""
        return self.counts().groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("there").alias("there")).filter("refs > 0 and there <= 0").select("key", "refs")

    def report(self) -> DataFrame:
        """Current orphans per table, field and month."""
        return current_report(self.counts())

    def run(self, deltas: DataFrame, checkpoint: str) -> StreamingQuery:
        """Feed a streaming DataFrame of deltas; what is there is taken in batches, then the query ends."""
        return deltas.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
