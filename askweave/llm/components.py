"""Splits that keep related records together (problem 4).

Connected components by frontier breadth-first search from many seeds at once. Seeds are the nodes whose hash is below
those of all their neighbours, so every component has one. Adjacency is written once, bucketed by node (hubs by node and a
salt), and each round joins only the frontier to it. A node reached by several labels takes the smallest. Labels that met on an
edge are the links of a small graph, which is contracted in the same way until it fits one task.
Components are then laid out in the order of their hashes and cut at the proportions of the splits.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askweave.operators.skew import join_counted, join_salted
from askweave.storage import SharedTables

#: Links of labels that one task merges at most; beyond it the graph of labels is contracted by another search.
SMALL = 200_000
#: Entries of the adjacency to a bucket.
BUCKET_ROWS = 100_000


def _rank(node):
    """Order of nodes: by hash, then by name."""
    return F.struct(F.xxhash64(node).alias("h"), node.alias("n"))


def _merge_small(parts):
    """Union-find over at most ``SMALL`` links; every label with the smallest label of its set."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in parts:
        for a, b in zip(pdf["a"], pdf["b"]):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pd.DataFrame({"node": list(parent), "label": [root(x) for x in parent]})


def _bucketed(edges: DataFrame, tables: SharedTables, hub: int) -> tuple[str, DataFrame]:
    """The adjacency as a bucketed table of (node, salt, to), and the hubs with their number of salts."""
    spark = edges.sparkSession
    many = edges.count()
    hub = max(hub, many // 10_000)  # so that there are 10,000 hubs at most
    hubs = tables.write(edges.groupBy("a").count().filter(F.col("count") > hub).select("a", F.ceil(F.col("count") / hub).cast("int").alias("salts")))
    salted = edges.join(F.broadcast(hubs), "a", "left").select(F.col("a").alias("node"), F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("salts"))).otherwise(F.lit(0)).cast("int").alias("salt"), F.col("b").alias("to"))
    buckets = max(1, math.ceil(many / BUCKET_ROWS))
    name = f"askweave_adjacency_{uuid.uuid4().hex}"
    salted.repartition(buckets, "node", "salt").write.bucketBy(buckets, "node", "salt").option("path", tables.path()).format("parquet").saveAsTable(name)
    return name, hubs


def components(edges: DataFrame, tables: SharedTables | None = None, hub: int = 100_000) -> DataFrame:
    """``node`` and ``label`` for every node of the undirected ``edges`` (``a``, ``b`` strings); equal labels are connected.

    Null ends link nothing, loops and repeated edges are harmless, an empty table has no nodes. The label is a node of the component.
    """
    spark = edges.sparkSession
    tables = tables or SharedTables(spark, "components")
    edges = tables.write(edges.select("a", "b").filter("a is not null and b is not null").distinct())
    apart = edges.filter("a <> b")
    both = tables.write(apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    name, hubs = _bucketed(both, tables, hub)
    adjacency = spark.table(name)
    hubs = None if hubs.isEmpty() else F.broadcast(hubs.withColumnRenamed("a", "node"))
    nodes = both.groupBy("a").agg(F.min(_rank(F.col("b"))).alias("least"))
    frontier = tables.write(nodes.filter(_rank(F.col("a")) < F.col("least")).select(F.col("a").alias("node"), F.col("a").alias("label")))
    levels, before = [frontier], frontier.limit(0)
    while not frontier.isEmpty():
        if hubs is None:
            ahead = frontier.withColumn("salt", F.lit(0))
        else:
            ahead = frontier.join(hubs, "node", "left").select("node", "label", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)).alias("salt"))
        reached = adjacency.join(ahead, ["node", "salt"]).groupBy(F.col("to").alias("node")).agg(F.min("label").alias("label"))
        # A neighbour of a node k steps from the seeds is k - 1, k or k + 1 steps from them: older levels need no look.
        frontier, before = tables.write(reached.join(frontier.select("node").unionByName(before.select("node")), "node", "left_anti")), frontier
        levels.append(frontier)
    visited = tables.write(reduce(DataFrame.unionByName, levels))
    for level in levels:
        tables.drop(level)
    # Where two labels met: every edge once, with the labels of its ends.
    ends = visited.select(F.col("node").alias("a"), F.col("label").alias("x")), visited.select(F.col("node").alias("b"), F.col("label").alias("y"))
    many = both.count() // 2
    met = join_salted(join_salted(apart, ends[0], "a", many, hub), ends[1], "b", many, hub).filter("x <> y")
    links = tables.write(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    count = links.count()
    out = visited
    if count:
        merged = tables.write(links.coalesce(1).mapInPandas(_merge_small, "node string, label string") if count <= SMALL else components(links, tables, hub))
        out = visited.join(merged.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay until the shared folder is cleared
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    return tables.write(out.unionByName(loops.join(out.select("node"), "node", "left_anti")))


class RelatedSplits:
    """Records that share a value of any of ``keys`` (columns of comparable text; null links nothing), by chain.

    A record without any key is a component of its own. Repeated ids keep one split. An empty table gives no rows.
    """

    def __init__(self, df: DataFrame, id_col: str, keys: dict[str, Column]):
        self.id_col = id_col
        self.tables = SharedTables(df.sparkSession, "splits")
        named = [F.concat(F.lit(f"{tag}:"), k) for tag, k in keys.items()]
        own = F.coalesce(*named, F.concat(F.lit("-:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
        self.records = df.select(F.col(id_col).alias("_id"), own.alias("node"))
        # The first key that is there with each later one: enough to chain all keys of a record. A lone key is a node as well.
        chained = [F.struct(F.coalesce(*named[: i + 1]).alias("a"), x.alias("b")) for i, x in enumerate(named)]
        edges = df.select(F.inline(F.array(*chained))).filter("b is not null").distinct()
        self.labels = components(edges, self.tables)

    def linked(self, tag: str) -> DataFrame:
        """Pairs ``a`` < ``b`` of values of the key ``tag`` that share a component."""
        own = self.members(tag)
        return join_salted(own.select("label", F.col("v").alias("a")), own.select("label", F.col("v").alias("b")), "label", own.count()).filter("a < b").select("a", "b")

    def members(self, tag: str) -> DataFrame:
        """``label`` and ``v``, every value of the key ``tag`` with its component: what all pairs are made of."""
        return self.labels.filter(F.col("node").startswith(f"{tag}:")).select("label", F.expr(f"substring(node, {len(tag) + 2})").alias("v"))

    def assigned(self, proportions: dict[str, float], buckets: int = 4096) -> DataFrame:
        """``id``, ``component`` and ``split`` of each record.

        Components larger than the smallest split's share come first, largest first (there are few); the others follow by hash. Each
        goes to the split in whose stretch its middle lies. Running sums are made per hash bucket, so no task orders all components.
        """
        sizes = self.records.groupBy("node").count()
        sizes = self.tables.write(sizes.join(self.labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"), "count"))
        parts = sizes.groupBy("component").agg(F.sum("count").alias("size"))
        total = sizes.agg(F.sum("count")).first()[0] or 0
        h = F.xxhash64("component")
        big = F.col("size") > min(proportions.values()) * total
        parts = parts.select("component", "size", F.when(big, F.lit(-1)).otherwise(F.pmod(h, F.lit(buckets))).alias("bucket"), F.when(big, -F.col("size")).otherwise(h).alias("place"))
        parts = self.tables.write(parts)
        before = parts.groupBy("bucket").agg(F.sum("size").alias("s"))  # buckets + 1 rows at most
        before = before.withColumn("start", F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).drop("s")
        run = F.sum("size").over(Window.partitionBy("bucket").orderBy("place", "component").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        parts = parts.join(F.broadcast(before), "bucket").withColumn("middle", (F.col("start") + run - F.col("size") / 2) / F.lit(max(total, 1)))
        names, limit, split = list(proportions), 0.0, None
        for name in names[:-1]:
            limit += proportions[name]
            split = F.when(F.col("middle") < limit, name) if split is None else split.when(F.col("middle") < limit, name)
        split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
        keyed = self.tables.write(sizes.join(parts.select("component", split.alias("split")), "component"))
        out = join_counted(self.records, keyed, "node", "count", total)
        return out.select(F.col("_id").alias(self.id_col), "component", "split").distinct()
