"""Quality gate: rules as data, assessment, agreement of candidates, best candidate, review overlay."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assess(rows: DataFrame, rules: list[tuple[str, bool, Column]], confidence: Column, completeness: Column) -> DataFrame:
    """Adds issues (array), accepted (no critical issue) and score = clamp(.5 conf + .5 compl - min(.30, .035 issues))."""
    issues = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, _, cond in rules]))
    critical = F.array(*[F.lit(name) for name, bad, _ in rules if bad]).cast("array<string>")
    out = rows.withColumn("issues", issues)
    points = 0.5 * confidence + 0.5 * completeness - F.least(F.lit(0.30), 0.035 * F.size("issues"))
    return out.withColumn("accepted", ~F.arrays_overlap("issues", critical)).withColumn("gate_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points)), 4))


def agreement(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that two candidates of a key both know (neither null, empty nor unknown) and state differently."""
    x, y = a.alias("x"), b.alias("y")
    known = lambda c: c.isNotNull() & ~c.isin("", "unknown")
    clash = F.array_compact(F.array(*[F.when(known(F.col(f"x.{f}")) & known(F.col(f"y.{f}")) & (F.col(f"x.{f}") != F.col(f"y.{f}")), F.lit(f)) for f in fields]))
    return x.join(y, key).select(key, F.array_join(clash, ",").alias("clashes"), (F.size(clash) == 0).alias("agree"))


def overlay(base: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Human values win over base values field by field."""
    o = overrides.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return base.join(o, key, "left").select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields], reduce(or_, [F.col(f"_{f}").isNotNull() for f in fields]).alias("overridden"))


def checks(constraints: DataFrame) -> DataFrame:
    """Totals of passed checks overall and by field, by grouping sets."""
    return constraints.rollup("field").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count("*").alias("total")).select(F.coalesce("field", F.lit("(all)")).alias("field"), "passed", "total", F.round(F.col("passed") / F.col("total"), 6).alias("share"))
