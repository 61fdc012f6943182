"""Retrieval metrics over rankings (qid, id, rank) and judgements (qid, id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ideal(qrels: DataFrame, k: int) -> DataFrame:
    """qid, ideal: the best discounted gain of the judged grades within ``k``."""
    order = Window.partitionBy("qid").orderBy(F.desc("grade"), "id")
    ranked = qrels.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return ranked.groupBy("qid").agg(F.sum(F.col("grade") / F.log2(F.col("r") + 1)).alias("ideal"))


def per_query(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), ndcg_ks: tuple[int, ...] = (10,), by_membership: bool = False) -> DataFrame:
    """qid, recall_k for each k, mrr (cut at the largest k), ndcg_k. Every query of ``queries`` has a row; without a hit it scores 0.

    A document is relevant with a grade over 0, or, ``by_membership``, with any judgement.
    """
    deepest = max(*ks, *ndcg_ks)
    relevant = F.col("grade").isNotNull() if by_membership else F.coalesce(F.col("grade"), F.lit(0)) > 0
    judged = ranking.where(F.col("rank") <= deepest).join(qrels, ["qid", "id"], "left")
    counts = qrels.where("true" if by_membership else "grade > 0").groupBy("qid").agg(F.count("*").alias("n_rel"))
    found = judged.groupBy("qid").agg(
        *[F.count(F.when(relevant & (F.col("rank") <= k), 1)).alias(f"hit_{k}") for k in ks],
        F.min(F.when(relevant, F.col("rank"))).alias("first"),
        *[F.sum(F.when(F.col("rank") <= k, F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}") for k in ndcg_ks],
    )
    rows = queries.select("qid").join(found, "qid", "left").join(counts, "qid", "left")
    for k in ndcg_ks:
        rows = rows.join(_ideal(qrels, k).withColumnRenamed("ideal", f"ideal_{k}"), "qid", "left")

    def safe(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)

    return rows.select(
        "qid",
        *[safe(F.coalesce(f"hit_{k}", F.lit(0)).cast("double"), F.col("n_rel").cast("double")).alias(f"recall_{k}") for k in ks],
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        *[safe(F.col(f"dcg_{k}"), F.nullif(F.col(f"ideal_{k}"), F.lit(0.0))).alias(f"ndcg_{k}") for k in ndcg_ks],
    )


def means(scores: DataFrame) -> DataFrame:
    """One row: n and the mean of each metric."""
    return scores.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in scores.columns if c != "qid"])


def complementarity(queries: DataFrame, first: DataFrame, second: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """case (both, first only, second only, neither), n: where each ranking has a relevant document in its best ``k``."""

    def hit(ranking: DataFrame, name: str) -> DataFrame:
        return ranking.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["qid", "id"], "left_semi").select("qid").distinct().withColumn(name, F.lit(True))

    rows = queries.select("qid").join(hit(first, "a"), "qid", "left").join(hit(second, "b"), "qid", "left")
    case = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first only").when(F.col("b"), "second only").otherwise("neither")
    return rows.groupBy(case.alias("case")).agg(F.count("*").alias("n"))
