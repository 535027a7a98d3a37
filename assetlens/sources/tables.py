"""Scans: Parquet tables, file listings, sidecar groups, point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that a walk leaves out.
EXCLUDED = [".git", "__pycache__", ".venv", ".uv"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root by path, size and time; contents are pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    hidden = "|".join(n.replace(".", "\\.") for n in EXCLUDED)
    return files.filter(~F.col("path").rlike(f"/(?:{hidden})/")).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", "length", "modificationTime")


def sidecar_groups(spark: SparkSession, paths: list[str], files: DataFrame) -> DataFrame:
    """(group, path) of the members that exist, of groups that keep two members at least; bad JSON gives no rows."""
    raw = spark.read.schema("version int, groups array<struct<id:string,members:array<string>>>, separate array<array<string>>").option("multiLine", "true").json(paths)
    members = raw.select(F.explode("groups").alias("g")).select(F.col("g.id").alias("group"), F.explode("g.members").alias("path"))
    there = members.join(files.select("path"), "path", "left_semi").distinct()
    enough = there.groupBy("group").count().filter("count >= 2").select("group")
    return there.join(enough, "group", "left_semi")


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """A filter that Parquet's statistics can answer."""
    return df.filter(F.col(key) == value)
