"""Staged analysis: reasons to look closer, analyzers tried in turn on what is undecided, best candidate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def sampling_reasons(duration: Column, coverage: Column, optimal: Column, n_events: Column, fps: Column) -> Column:
    """Why a clip needs denser samples; a coverage or optimal length of zero counts as not known."""
    covered = F.coalesce(F.nullif(coverage, F.lit(0.0)), F.lit(1.0))
    focus = F.coalesce(F.nullif(optimal, F.lit(0.0)), duration)
    return _reasons({
        "activity_focus:narrow_action_window": (duration >= 12) & (covered <= 0.08) & (focus <= F.greatest(F.lit(1.5), duration * 0.12)),
        "activity_focus:multiple_brief_events": (duration >= 12) & (n_events >= 3) & (fps <= 2),
    })


def ultra_reasons(parsed: Column, confidence: Column, completeness: Column, lacks_evidence: Column, duration: Column, coverage: Column, threshold: float) -> Column:
    """Why a dense result is not enough; a result that could not be parsed has that one reason."""
    covered = F.coalesce(F.nullif(coverage, F.lit(0.0)), F.lit(1.0))
    rest = _reasons({
        "ultra_sampling:very_low_dense_confidence": confidence < max(0.5, threshold - 0.25),
        "ultra_sampling:very_low_dense_completeness": completeness < 0.6,
        "ultra_sampling:short_action_missing_temporal_evidence": lacks_evidence & (duration >= 12) & (covered <= 0.1),
    })
    return F.when(parsed, rest).otherwise(F.array(F.lit("ultra_sampling:unparseable_dense_result")))


def best_candidate(candidates: DataFrame, key: str, attempt: str) -> DataFrame:
    """The accepted candidate of greatest score, or where none is accepted the one of greatest score; ties: first attempt."""
    best = F.max(F.struct(F.coalesce("accepted", F.lit(False)).alias("accepted"), "score", (-F.col(attempt)).alias("_back"))).alias("best")
    return candidates.groupBy(key).agg(best, F.count("*").alias("n_candidates")).select(key, (-F.col("best._back")).alias(attempt), "best.accepted", "best.score", "n_candidates")


def run_stages(pending: DataFrame, key: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Candidates of every stage: (key, stage, attempt, accepted, score). A stage gets the rows that no earlier one decided.

    An analyzer maps rows to (key, accepted, score). Its output is kept before it is read twice, by checkpoint() where
    the session names a folder, so that a costly model runs once a row.
    """
    spark = pending.sparkSession
    keep = (lambda df: df.checkpoint()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda df: df.persist())
    made = []
    for attempt, (name, analyze) in enumerate(stages):
        found = keep(analyze(pending).select(key, F.lit(name).alias("stage"), F.lit(attempt).alias("attempt"), F.coalesce("accepted", F.lit(False)).alias("accepted"), F.col("score").cast("double").alias("score")))
        made.append(found)
        pending = pending.join(found.filter("accepted").select(key), key, "left_anti")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out
