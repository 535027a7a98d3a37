"""Listings to sequences: numbered frames grouped by key, gaps found, paths taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = r"^(?:(.*?)([._-]))?([0-9]{2,8})((?:\.[^.]+)+)$"


def parse_frames(listing: DataFrame) -> DataFrame:
    """dir, name, prefix, separator, frame, width, suffix; null frame where the name is no frame."""
    part = lambda i: F.regexp_extract("name", FRAME, i)
    digits = F.nullif(part(3), F.lit(""))
    return listing.select("dir", "name", part(1).alias("prefix"), part(2).alias("separator"), digits.cast("long").alias("frame"), F.length(digits).alias("width"), part(4).alias("suffix"))


def collapse_sequences(frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Groups of two frames or more with their range and missing frames.

    Gaps come from neighbouring frames, so what is built for a sequence is as long as its frames and its missing list.
    """
    gaps = F.zip_with(F.slice("seen", 1, F.size("seen") - 1), F.slice("seen", 2, F.size("seen")), lambda a, b: F.when(b - a > 1, F.sequence(a + 1, b - 1)))
    return frames.groupBy(*keys).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.array_sort(F.collect_set(frame)).alias("seen")).filter(F.size("seen") >= 2).withColumn(
        "missing", F.flatten(F.array_compact(gaps))
    ).select(*keys, "first_frame", "last_frame", F.size("seen").cast("long").alias("n_frames"), F.size("missing").cast("long").alias("n_missing"), F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


def stills(frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    return frames.groupBy(*keys).agg(F.countDistinct(frame).alias("n")).filter("n = 1").drop("n")
