"""Fusion of rankings (run, qid, id, rank, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.lexical import top


def minmax(ranking: DataFrame) -> DataFrame:
    """Adds ``norm``: the score between its query's least and greatest in the run; 0.5 where they are less than 1e-9 apart."""
    w = Window.partitionBy("run", "qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranking.withColumn("norm", F.when(high - low < 1e-9, F.lit(0.5)).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))))


def weighted(rows: DataFrame, weights: dict[str, float] | None) -> Column:
    """The run's weight as a column; runs without one weigh 1."""
    w = F.lit(1.0)
    for run, value in (weights or {}).items():
        w = F.when(F.col("run") == run, F.lit(float(value))).otherwise(w)
    return w


def rrf(ranking: DataFrame, k: int = 60, weights: dict[str, float] | None = None, depth: int = 10) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank); an id that a list repeats counts each time."""
    term = weighted(ranking, weights) / (F.lit(k) + F.col("rank"))
    return top(ranking.groupBy("qid", "id").agg(F.round(F.sum(term), 9).alias("score")), depth)


def weighted_fusion(ranking: DataFrame, weights: dict[str, float] | None = None, depth: int = 10) -> DataFrame:
    """The sum of weight * min-max score; a run that lacks an id adds nothing."""
    scored = minmax(ranking)
    return top(scored.groupBy("qid", "id").agg(F.round(F.sum(weighted(scored, weights) * F.col("norm")), 6).alias("score")), depth)


def additive(ranking: DataFrame, weight: float, k: int = 60, original: str = "original", depth: int = 10) -> DataFrame:
    """RRF with the original list at ``1 - weight`` and its query's rewrites sharing ``weight``."""
    rewrites = ranking.where(F.col("run") != original).groupBy("qid").agg(F.countDistinct("run").alias("m"))
    rows = ranking.join(rewrites, "qid", "left")
    w = F.when(F.col("run") == original, F.when(F.col("m").isNull(), F.lit(1.0)).otherwise(F.lit(1.0 - weight))).otherwise(F.lit(float(weight)) / F.col("m"))
    return top(rows.groupBy("qid", "id").agg(F.round(F.sum(w / (F.lit(k) + F.col("rank"))), 9).alias("score")), depth)
