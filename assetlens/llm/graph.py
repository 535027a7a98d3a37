"""Connected components of an edge table by large-star and small-star rounds; nothing is brought to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm.runtime import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its least node.

    Each round points neighbours at the least node seen, first those above a node, then those below, until no edge
    changes; a chain of n nodes takes about log n rounds. The minimum of a node is aggregated before it is joined
    back, so a node with any number of neighbours is no single task's burden. Self-loops keep lone nodes.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        least = large.filter("a >= b").groupBy("a").agg(F.min("b").alias("m"))
        small = large.filter("a > b").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, materialize(small, "edges")
        release(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        seen = now
