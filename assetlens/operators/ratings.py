"""Votes: latest wins by (element, rater), summaries with histogram and Bayesian quality, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.media import bayesian_quality


def latest_votes(votes: DataFrame) -> DataFrame:
    """One row for each (element, rater): the last by (ts, vote_id). Struct maximum, so partial aggregation does the work."""
    last = F.max(F.struct("ts", "vote_id", "stars")).alias("last")
    return votes.filter(F.col("stars").between(1, 5)).groupBy("element", "rater").agg(last).select("element", "rater", "last.stars")


def rating_summary(votes: DataFrame) -> DataFrame:
    mean = F.avg("stars")
    stars = [F.sum((F.col("stars") == k).cast("long")).alias(f"stars_{k}") for k in range(1, 6)]
    return latest_votes(votes).groupBy("element").agg(
        F.count("*").alias("n_votes"), F.round(mean, 2).alias("average"), *stars, bayesian_quality(mean, F.count("*")).alias("quality"),
    )


def quality_ranks(summary: DataFrame, k: int) -> DataFrame:
    """Top k by quality, count, average; a limit before the rank, so no global sort of all elements."""
    order = [F.desc("quality"), F.desc("n_votes"), F.desc("average"), F.asc("element")]
    return summary.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank(hits: DataFrame, summary: DataFrame) -> DataFrame:
    """Blend of score and quality over the hits of a query; summary is joined to these few rows."""
    joined = hits.join(summary.select("element", "quality"), hits["element_id"] == summary["element"], "left").drop("element")
    blended = F.round(0.94 * F.col("score") + 0.06 * F.coalesce("quality", F.lit(0.0)) / 5, 6)
    return joined.withColumn("blended", blended).withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("blended"), F.asc("rank"))))
