"""Time series of clips: short gaps filled, islands, ranges, profile statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(samples: DataFrame, keys: list[str], order: str, flag: Column, gap: int = 1) -> DataFrame:
    """Maximal true runs after interior false runs of at most ``gap`` samples are filled.

    A true sample starts a new run where more than ``gap`` false samples precede it, so filling needs no second pass.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    indexed = samples.withColumn("_i", F.row_number().over(w)).filter(flag)
    fresh = (F.coalesce(F.col("_i") - F.lag("_i").over(w), F.lit(gap + 2)) > gap + 1).cast("int")
    runs = indexed.withColumn("_run", F.sum(fresh).over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("_i").alias("first_index"), F.max("_i").alias("last_index"), F.min(order).alias("start"), F.max(order).alias("end"), F.max("value").alias("peak")).withColumnRenamed("_run", "segment")


def action_pattern(segments: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """multiple_events, continuous, burst or sustained, from the segments' count and coverage."""
    by = segments.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.sum(F.col("last_index") - F.col("first_index") + 1).alias("active"))
    coverage = F.col("active") / F.col("n_samples")
    pattern = F.when(F.col("n_segments") > 1, "multiple_events").when(coverage >= 0.75, "continuous").when(coverage <= 0.35, "burst").otherwise("sustained")
    return by.join(totals, keys).select(*keys, "n_segments", F.round(coverage, 6).alias("coverage"), pattern.alias("pattern"))


def profile(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, peak, exact percentiles, spread and activity threshold of each clip's signal."""
    first = samples.groupBy(key).agg(
        F.count(value).alias("n_samples"), F.avg(value).alias("mean"), F.max(value).alias("peak"),
        F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9)))).alias("p"),
    )
    second = samples.join(first.select(key, "p"), key).groupBy(key).agg(F.percentile(F.abs(F.col(value) - F.col("p")[1]), 0.5).alias("mad"))
    both = first.join(second, key).withColumn("threshold", F.greatest(F.lit(0.0015), F.col("p")[1] + F.greatest(F.lit(0.0015), 3 * F.col("mad")), F.col("p")[2] + 1.5 * (F.col("p")[2] - F.col("p")[0])))
    ratio = F.col("peak") / F.greatest("mean", F.lit(0.002))
    return both.select(
        key, "n_samples", F.round("mean", 6).alias("mean"), "peak", F.round(F.col("p")[1], 6).alias("median"), F.round(F.col("p")[3], 6).alias("p90"), F.round("mad", 6).alias("mad"),
        F.round("threshold", 6).alias("threshold"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio - 1.4) / 4)), 6).alias("transient"),
    )


def smoothed(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds ``smooth``: the mean over a radius of round(0.12 / mean interval) samples, 1 to 6, cut at a series' ends.

    ``order`` is a number of seconds. The radius differs between series, so a row sees its six neighbours on either side
    and takes those within its own radius.
    """
    at = Window.partitionBy(*keys).orderBy(order)
    whole = samples.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    interval = F.greatest(F.lit(1e-3), (F.col("_high") - F.col("_low")) / F.greatest(F.lit(1), F.col("_n") - 1))
    radius = F.greatest(F.lit(1), F.least(F.lit(6), F.bround(0.12 / interval).cast("int")))
    rows = samples.join(whole.select(*keys, radius.alias("radius")), keys)
    before = F.collect_list(value).over(at.rowsBetween(-6, -1))
    behind = F.collect_list(value).over(at.rowsBetween(1, 6))
    near = rows.withColumn("_b", before).withColumn("_a", behind)
    kept = F.concat(F.slice("_b", F.greatest(F.lit(1), F.size("_b") - F.col("radius") + 1), F.col("radius")), F.array(F.col(value)), F.slice("_a", F.lit(1), F.col("radius")))
    return near.withColumn("smooth", F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)).drop("_a", "_b")


def change_signal(samples: DataFrame, keys: list[str], order: str, change: str) -> DataFrame:
    """Adds ``signal`` to the samples: the mean of the changes before and behind one, at the ends the only one.

    ``change`` holds the change from the sample before and is null for a series' first.
    """
    behind = F.lead(change).over(Window.partitionBy(*keys).orderBy(order))
    return samples.withColumn("signal", F.when(F.col(change).isNotNull() & behind.isNotNull(), (F.col(change) + behind) / 2).otherwise(F.coalesce(F.col(change), behind)))
