"""Entity resolution: star edges on equal keys, banded Hamming pairs, components, primary pick."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def star_edges(rows: DataFrame, node: str, key: str) -> DataFrame:
    """An edge from every member of a key's bucket to its least member: linear in the bucket, never all pairs."""
    hubs = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("b"))
    return rows.join(hubs, key).filter(F.col(node) != F.col("b")).select(F.col(node).alias("a"), "b")


def hamming_pairs(hashes: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b, distance) of 64-bit hashes (id, high, low: 32 bits each) at most ``limit`` bits apart.

    By the pigeonhole principle two such hashes agree on one of limit + 1 bands, so the join is an equi-join on
    (band, value). A pair that meets in several bands is kept in the first band in which it agrees.
    """
    bands = limit + 1
    cuts = [round(i * 64 / bands) for i in range(bands + 1)]
    word = "(shiftleft(high, 32) | low)"
    values = F.array(*[F.struct(F.lit(i).alias("band"), F.expr(f"shiftrightunsigned({word}, {a}) & {(1 << (b - a)) - 1 if b - a < 64 else -1}").alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    rows = hashes.select("id", "high", "low", values.alias("values")).select("id", "high", "low", "values", F.explode("values").alias("k"))
    a, b = rows.alias("a"), rows.alias("b")
    distance = F.expr("bit_count(a.high ^ b.high) + bit_count(a.low ^ b.low)")
    first = F.expr("NOT exists(sequence(0, a.k.band), i -> i < a.k.band AND a.values[i].value = b.values[i].value)")
    meet = (F.col("a.k.band") == F.col("b.k.band")) & (F.col("a.k.value") == F.col("b.k.value")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, meet & (distance <= limit) & first).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.cast("int").alias("distance"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` worked out once, without its lineage: checkpoint() where the session names a folder, else on local disk.

    The rows go into a frame of their own, as a checkpoint keeps its lineage's estimated size: a join multiplies sizes, so
    in a loop their digits double with each round until they fill the driver.
    """
    session = df.sparkSession
    kept = df.checkpoint() if session.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    return DataFrame(session._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), session)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of each row of ``nodes``: the least node that it reaches by ``edges`` (a, b) between nodes.

    Large-star and small-star rounds: neighbours are pointed at the least node seen, first those above a node, then those
    below, until every node has one edge, to a least one. A chain of n nodes takes about log n rounds.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        down = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        ends = links.select("a", F.lit(1).alias("up"), F.lit(0).alias("hub")).union(down.select("a", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("hub").alias("hub")).filter("up + hub > 1").isEmpty():
            return nodes.join(links, nodes["node"] == links["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
        least = links.union(down).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("m < a")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        links = cut(large.join(least, "a").filter("m < b").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct())
    raise RuntimeError("components did not settle")


def separate(clusters: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, component) after lists of nodes that must not share a cluster: (list_no, pos, node), in order of list_no.

    Of a list's nodes that are still together in a cluster, the first stays and each other one becomes a cluster of its
    own, which later lists no longer touch. Nodes without a cluster are ignored. What is gathered for a cluster is what
    its lists name. A cluster's label is the least of its remaining nodes.
    """
    named = clusters.select("node", "component").join(lists.select("list_no", "pos", "node"), "node")
    of_list = named.groupBy("component", "list_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes")).filter(F.size("nodes") > 1)
    of_cluster = of_list.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("list_no", "nodes"))).alias("lists"))
    none = F.slice(F.element_at("lists", 1)["nodes"], 1, 0)
    gone = F.aggregate("lists", none, lambda out, x: F.array_union(out, F.slice(F.array_except(x["nodes"], out), 2, 1 << 30)))
    moved = of_cluster.select(F.explode(gone).alias("node"), F.lit(True).alias("moved"))
    marked = clusters.select("node", "component").join(moved, "node", "left")
    labels = marked.filter("moved IS NULL").groupBy("component").agg(F.min("node").alias("label"))
    return marked.join(labels, "component").select("node", F.when(F.col("moved"), F.col("node")).otherwise(F.col("label")).alias("component"))


def primary_pick(rows: DataFrame, key: str, scores: list[str], order: str) -> DataFrame:
    """The row of greatest score tuple in each key, the first in order of ties: one partial aggregation, no window."""
    best = F.max(F.struct(*scores, (-F.col(order)).alias("_order"))).alias("best")
    return rows.groupBy(key).agg(best, F.count("*").alias("n")).select(key, (-F.col("best._order")).alias(order), "n", *[F.col(f"best.{s}").alias(s) for s in scores])


def near_duplicate_groups(rows: DataFrame, node: str, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n_members"), F.min(node).alias("first_member")).filter("n_members >= 2")
    return rows.join(counts, key).select(node, "n_members", "first_member")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
