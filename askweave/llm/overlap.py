"""Evaluation records that also stand in the training split, exactly or almost (problem 1).

Records are first collapsed to classes of equal key and equal word list, so that exact copies are compared once. The word
bigrams of the evaluation classes, hashed together with the record's key, are partitioned by hash; those of the training
classes are scanned for hits. An evaluation record with n words can lose at most two bigrams for each changed word, so (for a quarter) its
rarest ``2 * (n // 3) + 1`` bigrams suffice to meet every partner within the limit. For each pair met, the containment of the
evaluation record (its bigrams that the training record has) must reach what the limit leaves; the exact word distance decides.

The limit: two lists differ by at most one word in ``share`` of the longer list (a quarter by default). With one key for all records,
texts alone decide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from askweave.operators.skew import join_salted
from askweave.storage import SharedTables

SHARE = 4  # a quarter


def word_distance(a: list[str], b: list[str]) -> int:
    """Inserted, dropped or replaced words between two lists: bit-parallel over one big integer per word."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, score = full, 0, len(b)
    for w in a:
        eq = places.get(w, 0)
        cross = eq | down
        level = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(level | up) & full, up & level
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(cross | plus) & full, plus & cross
    return score


@F.arrow_udf(T.IntegerType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((word_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())), np.int32, len(a)))


def _with_class(df: DataFrame) -> DataFrame:
    """Complete rows with ``_class``, a digest of key and word list: members are found without a join."""
    whole = df.filter("_id is not null and _key is not null and _words is not null")
    return whole.withColumn("_class", F.unhex(F.sha2(F.concat_ws("\x1f", F.hex("_key"), F.concat_ws("\x1f", "_words")), 256)))


def _classes(df: DataFrame) -> DataFrame:
    """One row per class; hot classes are pre-aggregated before the shuffle."""
    return df.groupBy("_class").agg(F.any_value("_key").alias("_key"), F.any_value("_words").alias("_words"))


def _grams(words: Column, key: Column) -> Column:
    """Distinct bigrams, hashed with the key; a list of one word or none has one gram of its own."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.xxhash64(key, F.get(words, i), F.lit("\x1f"), F.coalesce(F.get(words, i + 1), F.lit("\x1e"))))
    return F.array_distinct(F.when(n > 0, pairs).otherwise(F.array(F.xxhash64(key, F.lit("\x1d")))))


def near_pairs(train: DataFrame, evaluation: DataFrame, words: Callable[[Column], Column] = lambda w: w, broadcast_keys: int = 1_000_000, hot: int = 100_000, share: int = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of classes within the limit, and the members of the training and the evaluation classes.

    Both inputs have ``_id``, ``_key`` (a binary digest of what must be equal) and ``_words``, of which ``words`` makes an array of strings.
    Rows with a null in any of them have no partner. Training rows whose key no evaluation row has are dropped before their
    words are made: by a broadcast of key hashes where there are ``broadcast_keys`` at most, else by a shuffled semi join, whose hot keys
    adaptive execution splits. Grams, classes and pairs of more than ``hot`` rows to a key are salted.
    Returns (``_t``, ``_e``, ``containment``, ``distance``), then twice (``_class``, ``_id``). Repeated rows give one pair.
    """
    tables = SharedTables(train.sparkSession, "overlap")
    e = tables.write(_with_class(evaluation.select("_id", "_key", words(F.col("_words")).alias("_words"))))
    keys = tables.write(e.select(F.xxhash64("_key").alias("_hash")).distinct())
    near = F.broadcast(keys) if keys.count() <= broadcast_keys else keys
    t = train.select("_id", "_key", "_words").filter("_key is not null").withColumn("_hash", F.xxhash64("_key")).join(near, "_hash", "left_semi")
    t = tables.write(_with_class(t.select("_id", "_key", words(F.col("_words")).alias("_words"))))
    e_classes, t_classes = tables.write(_classes(e)), tables.write(_classes(t))
    lost = (2 * F.floor(F.size("_words") / (share - 1))).cast("int")
    e_grams = e_classes.select(F.col("_class").alias("_e"), lost.alias("_lost"), F.explode(_grams(F.col("_words"), F.col("_key"))).alias("_g"))
    t_grams = tables.write(t_classes.select(F.col("_class").alias("_t"), F.explode(_grams(F.col("_words"), F.col("_key"))).alias("_g")))
    often = t_grams.groupBy("_g").count()
    rarest = Window.partitionBy("_e").orderBy("count", "_g")
    # Grams that no training record has come first: they use up the changes, then the rarest of the rest.
    probes = e_grams.join(often, "_g", "left").fillna(0, ["count"]).withColumn("_place", F.row_number().over(rarest)).filter("_place <= _lost + 1 and count > 0")
    met = tables.write(join_salted(t_grams, probes.select("_e", "_g"), "_g", t_grams.count(), hot).select("_t", "_e").distinct())
    ew = e_classes.select(F.col("_class").alias("_e"), F.col("_words").alias("_ew"), F.col("_key").alias("_ek"))
    tw = t_classes.select(F.col("_class").alias("_t"), F.col("_words").alias("_tw"))
    many = met.count()
    pairs = join_salted(join_salted(met, tw, "_t", many, hot), ew, "_e", many, hot)
    longer = F.greatest(F.size("_ew"), F.size("_tw"))
    own, other = _grams(F.col("_ew"), F.col("_ek")), _grams(F.col("_tw"), F.col("_ek"))
    shared = F.size(F.array_intersect(own, other))
    pairs = pairs.withColumns({"_n": F.size(own), "_shared": shared, "_most": F.floor(longer / share).cast("int")})
    pairs = pairs.filter((F.abs(F.size("_ew") - F.size("_tw")) <= F.col("_most")) & (F.col("_shared") >= F.greatest(F.lit(1), F.col("_n") - 2 * F.col("_most"))))
    pairs = pairs.withColumn("distance", _distance("_ew", "_tw")).filter("distance <= _most")
    pairs = pairs.select("_t", "_e", (F.col("_shared") / F.col("_n")).alias("containment"), "distance")
    return tables.write(pairs), t.select("_class", "_id").distinct(), e.select("_class", "_id").distinct()


def overlaps(train: DataFrame, evaluation: DataFrame, words: Callable[[Column], Column] = lambda w: w, broadcast_keys: int = 1_000_000, hot: int = 100_000, share: int = SHARE) -> DataFrame:
    """All record pairs (``_t``, ``_e``) of :func:`near_pairs`, with containment and distance; classes above ``hot`` records are salted."""
    pairs, t, e = near_pairs(train, evaluation, words, broadcast_keys, hot, share)
    t = t.select(F.col("_class").alias("_t"), F.col("_id").alias("_tid"))
    e = e.select(F.col("_class").alias("_e"), F.col("_id").alias("_eid"))
    out = join_salted(e, pairs, "_e", e.count(), hot)
    return join_salted(t, out, "_t", t.count(), hot).select(F.col("_tid").alias("_t"), F.col("_eid").alias("_e"), "containment", "distance")
