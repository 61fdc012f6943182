"""Relevance triage and iterative retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.providers import generate
from tessel.sources.io import cut


def triage(queries: DataFrame, grades: DataFrame, good: float = 0.5) -> DataFrame:
    """(qid, kept, total, triage) from (qid, relevant): none kept is incorrect, a share of ``good`` correct, else ambiguous.

    Queries without a graded document are incorrect.
    """
    counts = grades.groupBy("qid").agg(F.count("*").alias("total"), F.count(F.when(F.col("relevant"), 1)).alias("kept"))
    rows = queries.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"))
    return rows.withColumn("triage", F.when(F.col("kept") == 0, "incorrect").when(F.col("kept") >= good * F.col("total"), "correct").otherwise("ambiguous"))


def split_by_success(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, k: int = 5, quota: int | None = None) -> DataFrame:
    """(qid, succeeded): whether a relevant document is in the best ``k``; at most ``quota`` of each kind, by qid."""
    hits = ranking.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["qid", "id"], "left_semi").select("qid").distinct().withColumn("succeeded", F.lit(True))
    rows = queries.select("qid").join(hits, "qid", "left").withColumn("succeeded", F.coalesce("succeeded", F.lit(False)))
    if quota is None:
        return rows
    order = Window.partitionBy("succeeded").orderBy("qid")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= quota).drop("_r")


def conditions(ranking: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """(qid, condition, id, rank): the first relevant document, the best ``k`` others, and nothing (id null)."""
    gold = qrels.where("grade > 0").groupBy("qid").agg(F.min("id").alias("id")).select("qid", F.lit("gold").alias("condition"), "id", F.lit(1).cast("bigint").alias("rank"))
    others = ranking.where(F.col("rank") <= k + 5).join(qrels.where("grade > 0"), ["qid", "id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("rank")
    others = others.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("qid", F.lit("distractor").alias("condition"), "id", F.col("_r").cast("bigint").alias("rank"))
    empty = qrels.select("qid").distinct().select("qid", F.lit("empty").alias("condition"), F.lit(None).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("rank"))
    return gold.unionByName(others).unionByName(empty)


def multi_hop(queries: DataFrame, documents: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], provider, max_hops: int = 3, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(qid, id, hop) gathered and the trace (qid, hop, query, new, stopped), all queries together.

    Each hop searches for the queries still active, keeps unseen documents, and asks the provider whether the evidence is
    enough or what to search next. The loop runs ``max_hops`` times at most, each over frames written to the shared folder.
    """
    active = queries.select("qid", F.col("question").alias("original"), "question")
    gathered = trace = None
    for hop in range(1, max_hops + 1):
        hits = retrieve(active.select("qid", "question"), k).select("qid", "id")
        if gathered is not None:
            hits = hits.join(gathered.select("qid", "id"), ["qid", "id"], "left_anti")
        hits = cut(hits.withColumn("hop", F.lit(hop).cast("bigint")))
        gathered = hits if gathered is None else gathered.unionByName(hits)
        counts = hits.groupBy("qid").agg(F.count("*").alias("new"))
        step = active.join(counts, "qid", "left").select("qid", F.lit(hop).cast("bigint").alias("hop"), F.col("question").alias("query"), F.coalesce("new", F.lit(0)).alias("new"), "original")
        if hop == max_hops:
            step = step.withColumn("stopped", F.lit(False))
        else:
            evidence = gathered.join(documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 400).alias("t")), "id").groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hop", "id", "t"))), lambda x: x["t"]), "\n\n").alias("evidence"))
            asked = generate(step.join(evidence, "qid", "left"), F.concat("original", F.lit("\n"), F.coalesce("evidence", F.lit("(nothing yet)"))), provider)
            read = F.from_json("reply", "have_enough boolean, next_query string")
            step = cut(asked.withColumn("r", read).withColumn("stopped", F.coalesce(F.col("r.have_enough"), F.lit(True)) | (F.trim(F.coalesce("r.next_query", F.lit(""))) == "")).withColumn("next", F.col("r.next_query")).drop("r", "reply", "evidence"))
            active = step.where(~F.col("stopped")).select("qid", "original", F.col("next").alias("question"))
        done = step.select("qid", "hop", "query", "new", "stopped")
        trace = done if trace is None else trace.unionByName(done)
    return gathered, trace
