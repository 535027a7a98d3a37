"""Ranked concept search: buckets, coverage, gate, ranks, explanation, diversification."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.text import STOPWORDS

# Weights of the concept buckets.
WEIGHTS = {"identity": 1.0, "summary": 0.92, "composition": 0.90, "motion": 0.90, "appearance": 0.86, "facets": 0.82, "filename": 0.74, "caption": 0.70, "usability": 0.62}
# Concepts that name a family.
FAMILIES = ["bird", "bluescreen", "cloud", "debris", "dust", "electricity", "energy", "explosion", "fire", "fluid", "fog", "greenscreen", "particle", "plate", "projectile", "rain", "smoke", "snow", "spark", "steam", "water"]


def query_concepts(query: str, aliases: dict[str, str] | None = None) -> list[str]:
    words = "".join(c if c.isascii() and (c.isalnum()) else " " for c in query.lower()).split()
    kept = [w for w in words if len(w) >= 2 and not w.isdigit() and w not in STOPWORDS]
    return sorted({(aliases or {}).get(w, w) for w in kept})


def minimum_matches(n: int) -> int:
    return n if n < 3 else max(2, ceil(0.6 * n))


def passes(filters: dict[str, str], families: dict[str, Column], facets: Column, semantic: Column) -> Column:
    """Rows that meet every filter: category, primary_family, secondary_family, semantic.<path>, or a facet by its name.

    ``families`` has the columns category, primary_family and secondary_families; ``facets`` is a map of values, ``semantic``
    a JSON text. A filter with no value asks nothing.
    """
    met = F.lit(True)
    for key, value in filters.items():
        if not value:
            continue
        if key == "category":
            own = (families["primary_family"] == value) | (families["category"] == value)
        elif key == "primary_family":
            own = families["primary_family"] == value
        elif key == "secondary_family":
            own = F.array_contains(families["secondary_families"], value)
        elif key.startswith("semantic."):
            found = F.get_json_object(semantic, "$." + key.removeprefix("semantic."))
            own = F.coalesce(F.array_contains(F.from_json(found, "array<string>"), value), F.lit(False)) | (found == value)
        else:
            own = F.element_at(facets, key) == value
        met = met & F.coalesce(own, F.lit(False))
    return met


def score(elements: DataFrame, query: str, buckets: dict[str, Column], families: Column, aliases: dict[str, str] | None = None, family_concepts: list[str] = FAMILIES, affirmed: Column | None = None) -> DataFrame:
    """element_id, n_matched, coverage, weighted, relevance of every eligible element.

    Eligible elements hold the least number of concepts and, among ``families`` or the families that their texts affirm,
    every family that the query names; the family term is the share of these that ``families`` has, 0 where the query names
    none. One projection: the query's
    concepts are literals, so scoring needs no shuffle at all, and each text is bound once before it is searched.
    """
    wanted = query_concepts(query, aliases)
    if not wanted:
        return elements.select("element_id", "sort_order", F.lit(0).cast("long").alias("n_matched"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("weighted"), F.lit(0.0).alias("score"), F.lit("").alias("matched"))
    # A concept is held where one of the tokens that stand for it is.
    stand = {w: [t for t, c in (aliases or {}).items() if c == w] + ([w] if w not in (aliases or {}) else []) for w in wanted}
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    found_in = lambda t: F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(t, F.lit(f" {s} ")) for s in stand[w]], F.lit(False)), F.lit(w)) for w in wanted]))
    required, families = [w for w in wanted if w in family_concepts], families.cast("array<string>")
    have = lambda own: F.size(F.array_intersect(own, F.array(*map(F.lit, required)).cast("array<string>")))
    fit = elements.filter(have(families if affirmed is None else F.array_union(families, affirmed)) == len(required)) if required else elements
    family = have(families) / len(required) if required else F.lit(0.0)
    held = fit.select("element_id", "sort_order", family.alias("family"), *[F.transform(F.array(plain(c)), found_in)[0].alias(b) for b, c in buckets.items()])
    best = [F.greatest(F.lit(0.0), *[F.when(F.array_contains(b, w), WEIGHTS[b]).otherwise(0.0) for b in buckets]) for w in wanted]
    matched = F.array_sort(F.array_distinct(F.flatten(F.array(*buckets))))
    n = len(wanted)
    out = held.select("element_id", "sort_order", "family", matched.alias("found"), (sum(best[1:], best[0]) / n).alias("weighted"))
    out = out.withColumn("n_matched", F.size("found").cast("long")).filter(F.col("n_matched") >= minimum_matches(n)).withColumn("coverage", F.col("n_matched") / n)
    relevance = F.least(F.lit(1.0), 0.58 * F.col("coverage") + 0.32 * F.col("weighted") + 0.10 * F.col("family"))
    return out.select("element_id", "sort_order", "n_matched", F.round("coverage", 6).alias("coverage"), F.round("weighted", 6).alias("weighted"), F.round(relevance, 6).alias("score"), F.array_join("found", ",").alias("matched"))


def top(scored: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc("sort_order")]
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def diversify(ranked: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """The first of each group keeps its place, later members go behind all others; over the hits of one query."""
    seen = F.row_number().over(Window.partitionBy(group).orderBy(rank))
    tail = (F.col(group).isNotNull() & (F.col("_seen") > 1)).cast("int")
    return ranked.withColumn("_seen", seen).withColumn("_tail", tail).withColumn("final_rank", F.row_number().over(Window.orderBy("_tail", rank))).drop("_seen", "_tail")
