"""Facets read from names, durations and flow measurements, and captions made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The first of these words in a name tells its direction.
DIRECTIONS = {"left": "left", "right": "right", "upward": "up", "up": "up", "downward": "down", "down": "down", "radial": "radial", "expand": "expanding"}


def name_speed(name: Column, seconds: Column) -> Column:
    """Words of the name first, then the duration: 5 s and more are slow, up to 1.5 s fast; unknown or zero is medium."""
    return (
        F.when(name.contains("slow"), "slow").when(name.contains("fast") | name.contains("quick"), "fast")
        .when(seconds >= 5, "slow").when((seconds > 0) & (seconds <= 1.5), "fast").otherwise("medium")
    )


def name_direction(name: Column) -> Column:
    return F.coalesce(*[F.when(name.contains(word), label) for word, label in DIRECTIONS.items()], F.lit("no_dominant"))


def keyword_facet(name: Column, values: dict[str, list[str]]) -> Column:
    """(value, confidence): the first value one of whose words the name holds."""
    value = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: name.contains(w)), v) for v, words in values.items()], F.lit("unknown"))
    return F.struct(value.alias("value"), F.when(value == "unknown", 0.1).otherwise(0.25).alias("confidence"))


def fallback_caption(category: Column, root: Column, width: Column, height: Column, seconds: Column, soft_alpha: Column, motion: Column) -> Column:
    """A sentence from technical facts alone; ``motion`` is a map of facet names to values."""
    size = F.when((width > 0) & (height > 0), F.concat_ws("x", width.cast("string"), height.cast("string"))).otherwise("unknown resolution")
    length = F.when(seconds > 0, F.format_string("%.2fs", seconds)).otherwise("unknown duration")
    read = F.array_join(F.transform(F.filter(F.map_entries(motion), lambda e: e["value"] != ""), lambda e: F.concat_ws(" ", e["key"], e["value"])), ", ")
    return F.concat(
        F.translate(F.when(category == "unknown", "element").otherwise(category), "_", " "), F.lit(" element inferred from '"), root, F.lit("', "), size, F.lit(", "), length, F.lit(", "),
        F.when(soft_alpha, "soft-alpha plate-ready").otherwise("no verified alpha"), F.lit(". Fallback motion read: "), F.coalesce(F.nullif(read, F.lit("")), F.lit("motion not yet analysed")), F.lit("."),
    )


def flow_summary(frames: DataFrame, clip: str, order: list[str], magnitude: str, luminance: str) -> DataFrame:
    """Medians, spread, ends and typical step of each clip's flow and luminance. The window holds one clip's frames."""
    at = F.struct(*order)
    steps = frames.withColumn("_step", F.col(magnitude) - F.lag(magnitude).over(Window.partitionBy(clip).orderBy(*order)))
    return steps.groupBy(clip).agg(
        F.count(magnitude).alias("pairs"), F.percentile(magnitude, F.lit(0.5)).alias("magnitude"), F.var_pop(magnitude).alias("variance"), F.percentile("_step", F.lit(0.5)).alias("step"),
        F.min_by(luminance, at).alias("start"), F.max_by(luminance, at).alias("end"),
    )


def flow_confidence(magnitude: Column, pairs: Column, global_ratio: Column) -> Column:
    raw = 0.25 + F.least(F.lit(0.5), magnitude / 3) + F.least(F.lit(0.15), pairs / 160)
    return F.greatest(F.lit(0.25), F.least(F.lit(0.9), F.when(global_ratio > 0.8, raw * 0.8).otherwise(raw)))


def brightness_arc(start: Column, end: Column) -> Column:
    """Missing ends are steady."""
    return F.when(end - start > 4, "building").when(end - start < -4, "dissipating").when(start.isNull() | end.isNull(), "steady").otherwise("sustained")


def evolution(expansion: Column) -> Column:
    return F.when(expansion > 1.15, "building").when(expansion < 0.85, "dissipating").otherwise("sustained")


def loopability(distance: Column) -> Column:
    return F.when(distance < 0.04, "looped").when(distance > 0.16, "one_shot").otherwise("ambiguous")
