"""Joins in which one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count_col: str, total: int, hot: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has each ``key`` once and, in ``count_col``, how many rows have it.

    Keys of ``hot`` rows and more are at most 1,000, for ``hot`` is raised to ``total`` / 1,000: they go by a broadcast, so
    that their rows stay where they are. The other keys go by a shuffled join whose largest key has fewer rows than that.
    """
    hot = max(hot, total // 1000)
    large = keyed.filter(F.col(count_col) >= hot).drop(count_col)
    small = keyed.filter(F.col(count_col) < hot).drop(count_col)
    if large.isEmpty():
        return rows.join(small, key)
    mark = F.broadcast(large.select(F.col(key), F.lit(True).alias("_hot")))
    tagged = rows.join(mark, key, "left")
    return tagged.filter("_hot").drop("_hot").join(F.broadcast(large), key).unionByName(tagged.filter("_hot is null").drop("_hot").join(small, key))


def join_salted(rows: DataFrame, keyed: DataFrame, key: str, total: int, hot: int = 100_000) -> DataFrame:
    """Inner join in which a key may have many rows on the left, and any number on the right.

    Keys of more than ``hot`` rows (at most 1,000, for ``hot`` is raised to ``total`` / 1,000) are dealt to salts of about ``hot``
    rows each, and their rows on the right are repeated for each salt. Where ``total`` is below ``hot`` nothing needs counting.
    """
    hot = max(hot, total // 1000)
    if total <= hot:
        return rows.join(keyed, key)
    many = rows.groupBy(key).count().filter(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).cast("int").alias("_salts"))
    if many.isEmpty():
        return rows.join(keyed, key)
    many = F.broadcast(many)
    others = [c for c in rows.columns if c != key]
    left = rows.join(many, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*others), F.col("_salts"))).cast("int")).drop("_salts")
    right = keyed.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


#: Size, as text, of a side that goes to all tasks at most.
SMALL_BYTES = 32 << 20


def join_small(rows: DataFrame, keyed: DataFrame, key: str, limit: int = 100_000, hot: int = 100_000) -> DataFrame:
    """Inner join with a side that is a row a key, such as catalogs: by a broadcast up to ``limit`` rows and ``SMALL_BYTES`` of it, which are measured, else salted."""
    measured = keyed.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    if measured[0] <= limit and (measured[1] or 0) <= SMALL_BYTES:
        return rows.join(F.broadcast(keyed), key)
    return join_salted(rows, keyed, key, rows.count(), hot)


def join_many(rows: DataFrame, keyed: DataFrame, key: str, limit: int = 100_000, hot: int = 100_000) -> DataFrame:
    """Inner join with a side that has several rows a key, such as the columns of catalogs: by a broadcast up to ``limit`` rows of it, which are counted, else salted."""
    return join_small(rows, keyed, key, limit, hot)


#: Bytes of input to a task of work that is heavy by the row.
HEAVY_BYTES = 4 << 20


def spread(df: DataFrame, source: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows dealt out anew, over all cores at least, for work that is heavy by the row: scans of few files and joins of small rows come as few tasks.

    With ``by``, rows go by ranges of these columns, which are sampled: equal ones together, and tasks as even as the columns tell rows apart. The number of tasks follows the size of ``source`` (the rows themselves by default) as the optimizer knows it; nothing runs for it.
    """
    size = int(str((df if source is None else source)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores, usual = df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Of rows that come from no file the optimizer knows no size.
    tasks = max(cores, usual) if size >= 1 << 60 else max(cores, min(100_000, size // HEAVY_BYTES))
    return df.repartitionByRange(tasks, *by) if by else df.repartition(tasks)
