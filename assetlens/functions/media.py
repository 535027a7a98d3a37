"""Scalar rules of media facts: tiers, sampling plans, key screens, motion speed, frame ranges, Bayesian quality, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolution_tier(width: Column, height: Column) -> Column:
    edge = F.greatest(width, height)
    known = (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)
    return F.when(~known, "unknown").when(edge >= 6000, "6k_plus").when(edge >= 3840, "4k").when(edge >= 2048, "2k").when(edge >= 1280, "hd").otherwise("sd")


def motion_speed(magnitude: Column) -> Column:
    return F.when(magnitude < 0.05, "still").when(magnitude < 0.35, "slow").when(magnitude < 1.5, "medium").otherwise("fast")


def frame_range(start: Column, end: Column, fps: float, last: Column) -> tuple[Column, Column]:
    """Zero-based inclusive frames of a range of seconds."""
    clip = lambda c: F.greatest(F.lit(0), F.least(c, last)).cast("long")
    return clip(F.floor(start * fps + 1e-8)), clip(F.ceil(end * fps - 1e-8) - 1)


def bayesian_quality(average: Column, count: Column, prior: float = 3.0, weight: int = 5) -> Column:
    return F.when(count > 0, F.round((average * count + prior * weight) / (count + weight), 3)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of vectors taken as normalised; 0 where the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(0.0)


# Frame rates that have a tier of their own.
RATES = [24, 25, 30, 48, 50, 60, 120]


def frame_rate_tier(fps: Column) -> Column:
    """The first of the nearest common rates if it is at most 0.75 away, else variable."""
    near = F.array_min(F.transform(F.array(*map(F.lit, RATES)), lambda r: F.struct(F.abs(r - fps).alias("off"), r.alias("rate"))))
    label = F.when(near["rate"] == 120, "120_plus").otherwise(near["rate"].cast("string"))
    return F.when(F.coalesce(fps, F.lit(0)) == 0, "variable").when(near["off"] <= 0.75, label).otherwise("variable")


def color_space(value: Column) -> Column:
    low = F.lower(value)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "unknown").when(low.contains("bt709") | low.contains("rec709"), "rec709").when(low.contains("2020"), "rec2020")
        .when(low.contains("srgb"), "srgb").when(low.contains("linear"), "linear").otherwise(low)
    )


def sampling_plan(seconds: Column) -> dict[str, tuple[Column, Column]]:
    """(frames a second, most frames) of the base, dense and ultra plans for a clip's duration."""
    some = F.coalesce(seconds, F.lit(0.0))
    fps = F.when((some > 0) & (some <= 5), 8.0).when((some > 0) & (some <= 15), 4.0).otherwise(2.0)
    most = F.when((some > 0) & (some <= 5), 48).when((some > 0) & (some <= 15), 64).otherwise(96)
    dense = F.least(F.lit(12.0), F.greatest(F.lit(4.0), fps * 2)), F.least(F.lit(160), F.greatest(most + 24, most * 2))
    ultra = F.least(F.lit(24.0), F.greatest(F.lit(8.0), dense[0] * 2)), F.least(F.lit(256), F.greatest(dense[1] + 48, F.floor(dense[1] * 1.5).cast("int")))
    return {"base": (fps, most), "dense": dense, "ultra": ultra}


def key_screen(green: Column, blue: Column, green_border: Column, blue_border: Column) -> Column:
    """green_screen or blue_screen where a colour is broad or rules the border and leads the other by a fifth, else null."""
    convincing = lambda share, border: (share >= 0.12) & ((share >= 0.35) | (border >= 0.60))
    return F.when(convincing(green, green_border) & (green >= blue * 1.2), "green_screen").when(convincing(blue, blue_border) & (blue >= green * 1.2), "blue_screen")


def nearest_frame(seconds: Column, fps: Column, last: Column) -> Column:
    """Index of the frame next to a time, halves to even, within the clip."""
    return F.greatest(F.lit(0), F.least(F.bround(seconds * fps), last)).cast("long")
