"""The catalog as a mutable table: snapshots, upserts, pruning, merges, reuse, staleness, equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """Latest version of each key; kept rows keep their order number, new ones follow in order of key."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("*"), version).alias("row")).select("row.*").drop(order)
    old = current.select(key, F.col(order))
    top = current.agg(F.coalesce(F.max(order), F.lit(-1)).alias("top"))
    known = last.join(old, key)
    fresh = last.join(old, key, "left_anti").withColumn("_n", F.row_number().over(Window.orderBy(key))).crossJoin(F.broadcast(top)).withColumn(order, F.col("top") + F.col("_n")).drop("_n", "top")  # top is one row
    return current.join(last, key, "left_anti").unionByName(known).unionByName(fresh)


def full_save(current: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """What a save of the whole state does to each key: kept, added or deleted."""
    a, b = current.select(key, F.lit(1).alias("old")), wanted.select(key, F.lit(1).alias("new"))
    return a.join(b, key, "full").select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("kept").alias("action"))


def merge(target: DataFrame, source: DataFrame, key: str, print_: str, position: str) -> DataFrame:
    """Rows of source that a merge adds: their key and fingerprint are not in target, and no earlier source row has the fingerprint."""
    fresh = source.join(target.select(key), key, "left_anti").join(target.select(print_).filter(F.col(print_).isNotNull()).distinct(), print_, "left_anti")
    first = fresh.groupBy(print_).agg(F.min(position).alias(position))
    return fresh.join(first, [print_, position], "left_semi").unionByName(fresh.filter(F.col(print_).isNull()))


def reuse(targets: DataFrame, sources: DataFrame, key: str, print_: str) -> DataFrame:
    """Targets with exactly one distinct source by fingerprint; others with several are ambiguous."""
    pairs = targets.select(F.col(key).alias("target"), print_).join(sources.select(F.col(key).alias("source"), print_), print_)
    return pairs.groupBy("target").agg(F.countDistinct("source").alias("n_sources"), F.min("source").alias("source")).withColumn("state", F.when(F.col("n_sources") == 1, "reused").otherwise("ambiguous"))


def signature(*columns: Column) -> Column:
    """SHA-256 of values in a fixed order."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_snapshot(df: DataFrame, root: str) -> int:
    """Write the next numbered snapshot and then publish its number; readers see whole snapshots only."""
    spark = df.sparkSession
    number = latest_snapshot(spark, root) + 1
    df.write.mode("errorifexists").parquet(f"{root}/snapshot={number}")
    spark.range(1).select(F.lit(number).alias("revision")).write.mode("append").parquet(f"{root}/_revisions_")
    return number


def latest_snapshot(spark: SparkSession, root: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_revisions_")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return -1
    return spark.read.schema("revision int").option("ignoreMissingFiles", "true").parquet(f"{root}/_revisions_").agg(F.max("revision")).first()[0]


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot={latest_snapshot(spark, root) if number is None else number}")
