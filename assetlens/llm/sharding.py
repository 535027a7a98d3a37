"""Minimax contiguous sharding (law ``bytes``), native DataFrame operations only.

Equal texts form an atomic group. Groups are ordered by the MD5 of their text and the order is divided into
``2**16`` hash units; a unit is a union of whole groups, so a group never straddles a cut. The unit sizes (at most
65,536 numbers whatever the input) come to the driver, which binary-searches the smallest capacity for which a
greedy left-to-right fill needs at most ``n_shards`` shards. Every cut is then placed inside the interval that keeps
this capacity feasible, as near to an even split as the interval allows.

Edge cases: null text counts no bytes and joins the group of the empty text; null ids are ordinary values; repeated
rows each get a slot; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm.runtime import id_and_text, materialize

ROW_OVERHEAD = 16
UNIT_HEX = 4  # hexadecimal digits of the digest that name a unit
SLOT_BLOCKS = 1024  # a unit with more than this share of all rows is salted when slots are numbered


def feasible_cuts(prefix: list[int], capacity: int, n: int) -> list[int] | None:
    """Greedy check: the furthest cut of each shard under ``capacity``, or None where ``n`` shards don't suffice."""
    cuts, at, last = [], 0, len(prefix) - 1
    for _ in range(n):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        cuts.append(at)
    return cuts if at == last else None


def minimax_cuts(sizes: list[int], n: int) -> tuple[list[int], int]:
    """End index of each of ``n`` contiguous shards over ``sizes``, and the smallest capacity that suffices."""
    prefix = [0, *accumulate(sizes)]
    if not sizes:
        return [0] * n, 0
    low, high = max(max(sizes), -(-prefix[-1] // n)), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible_cuts(prefix, mid, n) else (mid + 1, high)
    last = len(sizes)
    earliest = [last] * n  # the least end of shard i from which the rest still fits
    for i in range(n - 2, -1, -1):
        earliest[i] = bisect_left(prefix, prefix[earliest[i + 1]] - low)
    mean = prefix[-1] / n
    heavy = [0, *accumulate(int(s > mean) for s in sizes)]
    heavy_bytes = [0, *accumulate(s if s > mean else 0 for s in sizes)]
    cuts, at = [], 0
    for i in range(n - 1):
        latest = bisect_right(prefix, prefix[at] + low) - 1
        light_shards = max(1, (n - i) - (heavy[-1] - heavy[at]))
        light_bytes = (prefix[-1] - prefix[at]) - (heavy_bytes[-1] - heavy_bytes[at])
        goal = prefix[at] + light_bytes / light_shards
        end = bisect_left(prefix, goal)
        if end > at and goal - prefix[end - 1] < prefix[min(end, last)] - goal:
            end -= 1
        if at < last:  # a unit over the mean stands alone, and no shard stays empty while units are left
            end = at + 1 if sizes[at] > mean else min(max(end, at + 1), bisect_left(heavy, heavy[at] + 1) - 1 if heavy[-1] > heavy[at] else last)
        at = max(min(max(end, earliest[i]), latest), at)
        cuts.append(at)
    return [*cuts, last], low


def assign_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    text = F.col("text")
    narrow = materialize(
        id_and_text(docs).select(
            "doc_id",
            (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("digest"),
        ).withColumn("unit", F.conv(F.substring("digest", 1, UNIT_HEX), 16, 10).cast("int")),
        "shard-rows",
    )
    units = sorted((r["unit"], r["bytes"], r["n"]) for r in narrow.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    ends, _ = minimax_cuts([u[1] for u in units], n_shards)
    # Shard i starts at the first unit at or after the end of shard i - 1; at most n_shards literals.
    starts = [units[e][0] if e < len(units) else 1 << (4 * UNIT_HEX) for e in ends[:-1]]
    shard = sum((F.when(F.col("unit") >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int")
    block = 1 + sum(u[2] for u in units) // SLOT_BLOCKS
    salts = [x for u, _, n in units if n > block for x in (F.lit(u), F.lit(-(-n // block)))]  # at most SLOT_BLOCKS units
    ways = F.coalesce(F.element_at(F.create_map(*salts), F.col("unit")), F.lit(1)) if salts else F.lit(1)
    rows = narrow.withColumn("shard", shard).withColumn("salt", F.pmod(F.xxhash64("doc_id"), ways).cast("int"))
    blocks = rows.groupBy("shard", "unit", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("unit", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("unit", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("unit", "salt").orderBy("digest", "doc_id")
    # offsets: at most 2**16 units plus 2 * SLOT_BLOCKS salted blocks, so its size is bounded by constants
    return rows.withColumn("row", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["unit", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
