"""Review of records: provisional families, confidence of links, review values, history, version tokens, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.text import snake, stem

# Cues in a file name, in the order in which they are tried, and the family that each stands for.
CUES = [
    ("snow", "snow"), ("steam|vapour|vapor", "smoke"), ("smoke|smoky", "smoke"), ("dust|sand", "dust"), ("lightning|electric|arc", "electricity"),
    ("explosion|fireball|blast", "explosion"), ("fire|flame|burning", "fire"), ("debris|shrapnel", "debris"), ("rain", "rain"), ("water|splash|droplet", "water"),
    ("cloud", "cloud"), ("bird", "bird"),
]


def facet_value(facet: Column) -> Column:
    """The value of a facet given as JSON: that of its ``value`` if it is an object, else the text itself."""
    return F.coalesce(F.get_json_object(facet, "$.value"), F.when(~F.coalesce(facet, F.lit("")).rlike(r"^\s*\{"), facet))


def display_family(family: Column, path: Column, category: Column) -> Column:
    """A known family, else the first cue in the file name, else the category, else unknown."""
    name, out = F.lower(stem(path)), F.when(F.coalesce(family, F.lit("")).isin("", "unknown"), F.lit(None)).otherwise(family)
    return F.coalesce(out, *[F.when(name.rlike(cue), F.lit(found)) for cue, found in CUES], F.nullif(category, F.lit("")), F.lit("unknown"))


def link_confidence(by_content: Column, by_name: Column, by_look: Column, members: Column) -> Column:
    """1 for a record alone, else the sum of what its links are worth, 0.25 at least."""
    worth = lambda flag, points: F.when(flag, points).otherwise(0.0)
    return F.when(members <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.25), worth(by_content, 0.45) + worth(by_name, 0.30) + worth(by_look, 0.25))))


def compatible(a: str, b: str) -> Column:
    """Whether two records (seconds, width, height under the aliases) may show the same; what is unknown forbids nothing."""
    near = f"abs({a}.seconds - {b}.seconds) <= greatest(0.25, 0.03 * greatest({a}.seconds, {b}.seconds))"
    aspect = f"abs({a}.width / {a}.height - {b}.width / {b}.height) <= greatest(0.02, 0.02 * {a}.width / {a}.height)"
    known = " AND ".join(f"coalesce({x}.{c}, 0) > 0" for x in (a, b) for c in ("width", "height"))
    return F.expr(f"(coalesce({a}.seconds, 0) <= 0 OR coalesce({b}.seconds, 0) <= 0 OR {near}) AND (NOT ({known}) OR coalesce({aspect}, true))")


def name_links(records: DataFrame) -> DataFrame:
    """(a, b) of records (id, root, seconds, width, height) of one root that are compatible, up to what follows from others.

    Records of a root that agree in all three facts are one class, linked to its least id; classes are compared, each pair
    from the one with the lesser id. So a root with many equal records makes no pairs within them.
    """
    facts = ["root", "seconds", "width", "height"]
    same = [F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}")) for f in facts]
    classes = records.groupBy(*facts).agg(F.min("id").alias("first"))
    members = records.alias("r").join(classes.alias("c"), same[0] & same[1] & same[2] & same[3]).filter("r.id <> c.first").select(F.col("c.first").alias("a"), F.col("r.id").alias("b"))
    x, y = classes.alias("x"), classes.alias("y")
    across = x.join(y, (F.col("x.root") == F.col("y.root")) & (F.col("x.first") < F.col("y.first")) & compatible("x", "y")).select(F.col("x.first").alias("a"), F.col("y.first").alias("b"))
    return members.unionByName(across)


def review_list(value: Column) -> Column:
    """Tokens of a comma list in order, each once; ``none`` where nothing is left."""
    tokens = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), snake), lambda t: t != ""))
    return F.when(F.size(tokens) == 0, F.array(F.lit("none"))).otherwise(tokens)


def secondary_families(families: Column, added: Column, primary: Column) -> Column:
    """Families in order with those added, each once and never the primary."""
    return F.array_remove(F.array_union(families, added), primary)


def with_history(history: Column, entry: Column) -> Column:
    return F.array_append(F.coalesce(history, F.expr("array()").cast("array<string>")), entry)


def version_token(*columns: str) -> Column:
    """SHA-256 of the row as JSON, by which a writer learns that it was changed meanwhile."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: all rows, and those that meet each condition."""
    return rows.agg(F.count("*").alias("total"), *[F.count(F.when(c, 1)).alias(name) for name, c in conditions.items()])


def unknown_ids(selected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Selected ids that do not exist; empty where a selection is valid."""
    return selected.select(key).distinct().join(known.select(key), key, "left_anti")


def page(ranked: DataFrame, rank: str, number: int, size: int = 120) -> DataFrame:
    """The rows of a page, from 0, by ranks that start at 1."""
    return ranked.filter((F.col(rank) > number * size) & (F.col(rank) <= (number + 1) * size))


def set_changes(claimed: Column, measured: Column) -> tuple[Column, Column]:
    """(claimed only, measured only)."""
    return F.array_except(claimed, measured), F.array_except(measured, claimed)
