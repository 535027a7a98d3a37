"""Choosing elements for people to look at: blind annotation queues and diverse subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.operators import link


def annotation_queue(rows: DataFrame, key: str, identifiers: list[str], excluded: Column, seed: int, limit: int) -> DataFrame:
    """One element of each group of elements that share any identifier, also by way of others, in a seeded order.

    A group with an excluded member is left out whole. Null identifiers link nothing. ``limit`` is the queue's length.
    ``rows`` are read once: a dozen scans and joins go over their keys, which would each hold whole texts again.
    """
    named = link.cut(rows.select(F.col(key).alias("node"), *identifiers, F.coalesce(excluded, F.lit(False)).alias("excluded")))
    edges = link.union_all([link.star_edges(named.select("node", i), "node", i) for i in identifiers])
    groups = link.components(named.select("node").distinct(), edges).join(named.select("node", "excluded"), "node").groupBy("component").agg(
        F.min("node").alias(key), F.count("*").alias("n_members"), F.bool_or("excluded").alias("excluded"),
    )
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string"))), F.col("component")]
    queue = groups.filter("NOT excluded").orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return queue.select(key, F.substring(F.sha2(F.col("component").cast("string"), 256), 1, 16).alias("group_id"), "n_members", "rank")


def diverse_subset(rows: DataFrame, key: str, features: Column, preferences: list[Column], limit: int) -> DataFrame:
    """Greedy cover: each pick brings most unseen features; ties go to the greatest preferences, then to the greatest key.

    A set of features can bring anything new only once, so the rounds run over the best row of each distinct set, one
    aggregate row to the driver a round, and end when nothing unseen is left. All later picks follow preferences alone.
    """
    named = rows.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(features)).alias("features"), *[p.alias(f"p{i}") for i, p in enumerate(preferences)])
    order = [*[f"p{i}" for i in range(len(preferences))], "key"]
    sets = named.groupBy("features").agg(F.max(F.struct(*order)).alias("best")).persist()
    picked, seen = [], []
    while len(picked) < limit:
        fresh = F.size(F.array_except("features", F.array(*map(F.lit, seen)).cast("array<string>")))
        top = sets.select(F.max(F.struct(fresh.alias("fresh"), "best", "features")).alias("top")).first()["top"]
        if top is None or not top["fresh"]:
            break
        picked.append((top["best"]["key"], len(picked) + 1, top["fresh"]))
        seen = sorted({*seen, *top["features"]})
    sets.unpersist()
    spark = rows.sparkSession
    kind = named.schema["key"].dataType.simpleString()
    head = spark.createDataFrame(picked, f"key {kind}, rank int, n_new int")
    down = [F.desc(c) for c in order]
    tail = named.join(F.broadcast(head.select("key")), "key", "left_anti").orderBy(*down).limit(limit - len(picked))  # at most limit rows
    tail = tail.select("key", (F.row_number().over(Window.orderBy(*down)) + len(picked)).cast("int").alias("rank"), F.lit(0).alias("n_new"))
    return head.unionByName(tail).withColumnRenamed("key", key)
