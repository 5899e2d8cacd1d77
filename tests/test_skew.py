from collections import Counter

from pyspark.sql import functions as F

from askweave.operators.skew import join_counted, join_salted


def test_joins_equal_plain_ones(spark):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(900)] + [(None, 1), ("none", 2)], "k string, v int")
    keyed = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k1", 3), (None, 9), ("extra", 4)], "k string, w int")
    want = Counter(map(tuple, rows.join(keyed, "k").select("k", "v", "w").collect()))
    for hot in (10, 100, 100_000):
        assert Counter(map(tuple, join_salted(rows, keyed, "k", rows.count(), hot).select("k", "v", "w").collect())) == want
    once = rows.groupBy("k").count().withColumn("w", F.length("k"))
    want = Counter(map(tuple, rows.join(once.select("k", "w"), "k").select("k", "v", "w").collect()))
    for hot in (10, 100_000):
        assert Counter(map(tuple, join_counted(rows, once, "k", "count", rows.count(), hot).select("k", "v", "w").collect())) == want
