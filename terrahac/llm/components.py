"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahac.llm.common import drop_table, table

#: Nodes whose minima all tasks get (16 bytes each); beyond, rows meet them in a shuffle, which Spark splits by size.
SEND_NODES = 1_000_000


def _stars(edges: DataFrame) -> bool:
    """Whether each a has one b, and no b is an a."""
    seen = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    seen = seen.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node that has an edge, with the smallest node it is connected to.

    edges: a, b (longs). Each round joins every node with its smallest neighbour; the
    minimum is taken before rows meet. Up to SEND_NODES, minima are sent to all tasks, so that a
    node with very many edges is in no task of its own; beyond, it is the many-rows side of a
    join, which Spark splits. Each round is written to the shared folder.
    """
    now = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _stars(now):
        few = 2 * now.count() <= SEND_NODES  # a count of rows in files, which bounds the nodes
        sent = F.broadcast if few else lambda x: x
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: the larger neighbours of u go to the smallest of all.
        large = both.filter("b > a").join(sent(low), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # Small star: u and its smaller neighbours go to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(least.withColumnRenamed("a", "u")), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = table(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        drop_table(now)
        now = new
    hubs = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(hubs.select("node", F.col("node").alias("label")))
