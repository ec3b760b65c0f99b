"""Comparison of scores by model and scorer.

Scores come long: ``(model, scorer, item, score, ...)``; a score below zero
marks a failed call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED = -1.0


def valid(score: Column) -> Column:
    """The score, NULL for a failed call."""
    return F.when(score >= 0, score)


def side_by_side(scores: DataFrame, scorers: list[str], measures: list[str]) -> DataFrame:
    """One row per model and item, one column per scorer and measure."""
    wide = [
        F.max(F.when(F.col("scorer") == s, F.col(m))).alias(f"{s}_{m}")
        for s in scorers
        for m in measures
    ]
    return scores.groupBy("model", "item").agg(*wide)


def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean valid score per model and scorer."""
    return scores.groupBy("model", "scorer").agg(
        F.avg(valid(F.col("score"))).alias("mean_score"),
        F.count(valid(F.col("score"))).alias("scored"),
        F.count_if(F.col("score") < 0).alias("failed"),
    )


def is_divergent(a: Column, b: Column, gap: float = 0.1) -> Column:
    """Both scores valid and further apart than ``gap``."""
    apart = (a >= 0) & (b >= 0) & (F.abs(a - b) > gap)
    return F.coalesce(apart, F.lit(False))


def divergence(scores: DataFrame, first: str, second: str, gap: float = 0.1) -> DataFrame:
    """Divergent items and all items per model."""
    wide = side_by_side(scores, [first, second], ["score"])
    apart = is_divergent(F.col(f"{first}_score"), F.col(f"{second}_score"), gap)
    return wide.groupBy("model").agg(
        F.count_if(apart).alias("divergent_items"), F.count(F.lit(1)).alias("items")
    )


def matrix(scores: DataFrame, models: list[str], scorers: list[str]) -> DataFrame:
    """One row per item, one column per model and scorer."""
    cells = [
        F.max(F.when((F.col("model") == m) & (F.col("scorer") == s), F.col("score"))).alias(
            f"{m}_{s}"
        )
        for m in models
        for s in scorers
    ]
    return scores.groupBy("item").agg(*cells)


def pass_counts(scores: DataFrame, gates: list[str]) -> DataFrame:
    """How many items passed each gate, and the share that did."""
    counts = [F.count_if(F.col(g)).alias(f"{g}_count") for g in gates]
    shares = [
        (F.count_if(F.col(g)).cast("double") / F.count(F.lit(1))).alias(f"{g}_share")
        for g in gates
    ]
    return scores.groupBy("model", "scorer").agg(F.count(F.lit(1)).alias("items"), *counts, *shares)


def relative_delta(means: DataFrame, base: str, other: str, digits: int = 6) -> DataFrame:
    """Mean of two models per scorer and the change relative to ``base``."""
    wide = means.groupBy("scorer").agg(
        F.max(F.when(F.col("model") == base, F.col("mean_score"))).alias("base_mean"),
        F.max(F.when(F.col("model") == other, F.col("mean_score"))).alias("other_mean"),
    )
    delta = (F.col("other_mean") - F.col("base_mean")) / F.nullif(F.col("base_mean"), F.lit(0.0))
    return wide.withColumn("relative_delta", F.round(delta, digits))
