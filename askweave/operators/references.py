"""References to records that do not exist (problem 3).

A ledger of signed deltas per key: a reference that appears adds 1 to its key's references and one that is withdrawn takes 1 away; a
record that appears adds 1 to its key's existence and one that goes takes 1 away. Summed over all time, keys with references
above zero and existence of zero are the current orphans. Running over a key's deltas in time gives both counts at every
moment: a reference that appears while its key has references and no existence is an orphan of that time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askweave.functions.text import db_key
from askweave.storage import SharedTables

_ALWAYS = "timestamp_ntz'0001-01-02 00:00:00'"
WHAT = "struct<src_table:string,src_id:bigint,src_field:string,pos:int,period:timestamp_ntz>"
#: Steps of one moment: records come and go before references that look for them; what is withdrawn as a whole goes after them.
DATED, CAME, LEFT, CLOSED = 0, 1, 2, 3


def delta(key: Column, at: Column, step: int, refs: int, there: int, what: Column | None = None, kind: str = WHAT) -> Column:
    """One entry of the ledger; ``what`` names the reference, null for existence."""
    what = F.lit(None).cast(kind) if what is None else what.cast(kind)
    return F.struct(key.alias("key"), at.alias("at"), F.lit(step).alias("step"), F.lit(refs).alias("refs"), F.lit(there).alias("there"), what.alias("what"))


def dated_existence(key: Column, start: Column, end: Column) -> Column:
    """The entries of a record that is there from ``start`` until before ``end`` (null: still); none if it never is."""
    alive = start.isNotNull() & key.isNotNull() & (end.isNull() | (end > start))
    came, went = delta(key, start, DATED, 0, 1), delta(key, end, DATED, 0, -1)
    return F.when(alive & end.isNotNull(), F.array(came, went)).when(alive, F.array(came)).otherwise(F.array().cast(f"array<struct<key:string,at:timestamp_ntz,step:int,refs:int,there:int,what:{WHAT}>>"))


def orphans_in_time(deltas: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """``key``, ``at`` and ``what`` of the references whose key does not exist at their time.

    ``deltas`` has ``key``, ``at``, ``step``, ``refs``, ``there`` and ``what`` as of :func:`delta`; it is read twice: give it a written table.
    References with a null key or time are orphans. The references of a key are dealt to groups of about ``chunk``, a withdrawal to that of
    its reference, and the key's existence goes to each of them, so that a hot key is spread. Repeated references come out each.
    """
    is_ref = F.col("what").isNotNull()
    total = deltas.count()
    chunk = max(chunk, math.ceil(total / 1000))  # so that there are 1,000 hot keys at most
    ledger = deltas.filter("key is not null and at is not null").select("key", F.lit(0).alias("salt"), "at", "step", "refs", "there", "what")
    if total > chunk:  # else no key can be hot
        hot = deltas.filter(is_ref & F.col("key").isNotNull()).groupBy("key").count().filter(F.col("count") > chunk)
        hot = F.broadcast(hot.select("key", F.ceil(F.col("count") / chunk).cast("int").alias("groups")))
        groups = F.coalesce("groups", F.lit(1))
        own = F.when(is_ref, F.array(F.pmod(F.xxhash64("what"), groups).cast("int"))).otherwise(F.sequence(F.lit(0), groups - 1))
        ledger = ledger.drop("salt").join(hot, "key", "left").select("key", F.explode(own).alias("salt"), "at", "step", "refs", "there", "what")
    run = Window.partitionBy("key", "salt").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ledger = ledger.withColumns({"_refs": F.sum("refs").over(run), "_there": F.sum("there").over(run)})
    found = ledger.filter(is_ref & (F.col("refs") > 0) & (F.col("_refs") > 0) & (F.col("_there") <= 0)).select("key", "at", "what")
    # Null keys exist nowhere: they need no group.
    return found.unionByName(deltas.filter(is_ref & (F.col("refs") > 0) & (F.col("key").isNull() | F.col("at").isNull())).select("key", "at", "what"))


def current_orphans(deltas: DataFrame) -> DataFrame:
    """``key`` and ``refs`` of all keys with references above zero and no existence once all deltas are counted."""
    summed = deltas.filter("key is not null").groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("there").alias("there"))
    return summed.filter("refs > 0 and there <= 0").select("key", "refs")


def counts(deltas: DataFrame) -> DataFrame:
    """Signed counts by key and, of references, by table, field and period: what a ledger keeps of its deltas."""
    of = lambda name: F.col(f"what.{name}").alias(name)
    return summed(deltas.filter("key is not null").select("key", of("src_table"), of("src_field"), of("period"), F.col("refs").cast("long").alias("refs"), F.col("there").cast("long").alias("there")))


def summed(counted: DataFrame) -> DataFrame:
    """Counts of :func:`counts` added up; what has come to nothing goes."""
    out = counted.groupBy("key", "src_table", "src_field", "period").agg(F.sum("refs").alias("refs"), F.sum("there").alias("there"))
    return out.filter("refs <> 0 or there <> 0")


def current_report(counted: DataFrame) -> DataFrame:
    """Current orphan references (``orphans``) and their keys (``keys``) per table, field and month, from :func:`counts`."""
    there = F.sum("there").over(Window.partitionBy("key"))
    lost = counted.withColumn("_there", there).filter("_there <= 0 and refs > 0")
    return lost.groupBy("src_table", "src_field", "period").agg(F.sum("refs").alias("orphans"), F.count(F.lit(1)).alias("keys"))


def train_deltas(train: DataFrame, name: str = "train_spider") -> DataFrame:
    """The ledger entries of training records: each refers to its database from its creation on. A null database refers to nothing."""
    at = F.col("created_at").cast("timestamp_ntz")
    what = F.struct(F.lit(name), F.col("q_id").cast("long"), F.lit("db_id"), F.lit(0), F.date_trunc("month", at))
    entry = delta(F.concat(F.lit("db:"), db_key(F.col("db_id"))), at, CAME, 1, 0, what)
    return train.filter("db_id is not null").select(F.inline(F.array(entry)))


def catalog_deltas(catalog: DataFrame, name: str = "spider_tables") -> DataFrame:
    """The ledger entries of catalog deliveries: databases in time, and tables, columns and keys within each delivery.

    What a delivery holds and refers to comes with it and is withdrawn with it. Null arrays refer to nothing and hold nothing; null entries
    are references that lead nowhere. Every array entry is taken, and each delivery is read once.
    """
    loaded, deleted = F.col("loaded_at").cast("timestamp_ntz"), F.col("deleted_at").cast("timestamp_ntz")
    id_ = F.coalesce(F.col("catalog_id").cast("string"), F.lit("null"))
    came = F.coalesce(loaded, F.expr(_ALWAYS))
    left = F.greatest(deleted, came)
    key = lambda kind, place: F.concat_ws(":", F.lit(kind), id_, F.coalesce(place.cast("string"), F.lit("none")))
    what = lambda field, pos: F.struct(F.lit(name), F.col("catalog_id").cast("long"), F.lit(field), pos.cast("int"), F.date_trunc("month", loaded))
    columns, n = F.col("column_names_original"), F.size("table_names_original")

    def entries(at: Column, sign: int) -> list[Column]:
        ref, there = (CAME, DATED) if sign > 0 else (LEFT, CLOSED)
        refers = lambda place, field, pos, kind: delta(key(kind, place), at, ref, sign, 0, what(field, pos))
        real = lambda c, pos: (pos > 0) & c["name"].isNotNull() & (c["table_idx"] >= 0) & (c["table_idx"] < n)
        # Entries that are no reference or hold nothing become null and go.
        return [
            F.transform("table_names_original", lambda t, pos: delta(key("t", pos), at, there, 0, sign)),
            F.transform(columns, lambda c, pos: F.when(real(c, pos), delta(key("c", pos), at, there, 0, sign))),
            F.transform(columns, lambda c, pos: F.when(pos > 0, refers(c["table_idx"], "column_names_original", pos, "t"))),
            F.transform("primary_keys", lambda i, pos: refers(i, "primary_keys", pos, "c")),
            F.transform("foreign_keys", lambda p, pos: refers(p["src"], "foreign_keys", pos, "c")),
            F.transform("foreign_keys", lambda p, pos: refers(p["dst"], "foreign_keys", pos, "c")),
        ]

    none = F.array().cast(f"array<struct<key:string,at:timestamp_ntz,step:int,refs:int,there:int,what:{WHAT}>>")
    whole = [F.coalesce(F.array_compact(x), none) for x in entries(came, 1)]
    gone = [F.when(deleted.isNotNull(), F.coalesce(F.array_compact(x), none)).otherwise(none) for x in entries(left, -1)]
    dated = dated_existence(F.concat(F.lit("db:"), db_key(F.col("db_id"))), loaded, deleted)
    return catalog.select(F.inline(F.concat(*whole, *gone, dated)))


def reference_deltas(train: DataFrame, catalog: DataFrame) -> DataFrame:
    return train_deltas(train).unionByName(catalog_deltas(catalog))


def orphan_references(train: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct ``src_table``, ``src_id``, ``src_field``, ``pos`` and ``period`` (month) of all orphan references; both tables are read once."""
    deltas = SharedTables(train.sparkSession, "references").write(reference_deltas(train, catalog))
    return orphans_in_time(deltas).select("what.*").distinct()


def orphan_report(train: DataFrame, catalog: DataFrame) -> DataFrame:
    """Orphans per table, field and month."""
    return orphan_references(train, catalog).groupBy("src_table", "src_field", "period").agg(F.count(F.lit(1)).alias("orphans"))
