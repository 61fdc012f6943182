"""Readers, writers and keyed stores of the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.text import with_title


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tessel-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for loops and for frames that are read more than once."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_path(df: DataFrame) -> str:
    """``df`` written to a new folder of the shared one; its path."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """(id, text) of a text file: stripped lines that are not blank, numbered from 0 after that; ``raw`` keeps every line as it is.

    Each part of the file numbers its own lines after those of the parts before it.
    """
    rows = spark.read.text(path)
    if not raw:
        rows = rows.select(F.trim("value").alias("value")).where("value <> ''")
    rows = cut(rows.select("value", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("part", before.alias("first"))  # a row for each part
    own = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    return rows.withColumn("own", own).join(firsts, "part").select((F.col("first") + F.col("own")).cast("string").alias("id"), F.col("value").alias("text"))


def corpus_jsonl(spark: SparkSession, path: str, titles: bool = True) -> DataFrame:
    """(id, text, title, raw_text) from JSON lines ``_id, title, text``; the text begins with its title unless ``titles`` is false."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    title, body = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))
    return rows.select(F.col("_id").alias("id"), (with_title(F.col("title"), F.col("text")) if titles else body).alias("text"), title.alias("title"), body.alias("raw_text"))


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("qid"), F.col("text").alias("question"))


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, id, grade) of the judgements over 0 in a headed, tab-separated file."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(path)
    return rows.where("score > 0").select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("id"), F.col("score").alias("grade"))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with text that have a judgement."""
    return queries.where("question is not null").join(qrels.select("qid").distinct(), "qid", "left_semi")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(qid, variant, question, id, grade) from a JSON object id -> {direct, paraphrased}; empty questions are left out, each fact is its own gold."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,struct<direct:string,paraphrased:string>>")).alias("id", "q"))
    rows = pairs.select("id", F.expr("stack(2, 'direct', q.direct, 'paraphrased', q.paraphrased) as (variant, question)"))
    return rows.where("coalesce(question, '') <> ''").select(F.concat("id", F.lit(":"), "variant").alias("qid"), "variant", "question", "id", F.lit(1).alias("grade"))


class KeyedStore:
    """An append-only Parquet table key -> value, the store behind caches and resumable stages.

    Writes append; the latest entry of a key wins. Only what ``missing`` returns needs work.
    """

    def __init__(self, spark: SparkSession, path: str, value_type: str = "string"):
        self.spark, self.path, self.schema = spark, path, f"key string, value {value_type}, at bigint"

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        stored = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema(self.schema).parquet(self.path) if stored else self.spark.createDataFrame([], self.schema)
        return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))

    def missing(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.read().select("key"), "key", "left_anti")

    def append(self, rows: DataFrame) -> None:
        at = F.unix_micros(F.current_timestamp())
        rows.select("key", "value", at.alias("at")).write.mode("append").parquet(self.path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores by model and stage; only the partitions that ``scores`` has are replaced."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "stage").parquet(path)


def write_results_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report_markdown(comparisons: DataFrame, stage: str) -> str:
    """A Markdown table of one stage's comparisons (config, n, delta, lo, hi, p_holm, verdict)."""
    mark = {"worse": "▼", "better": "▲"}
    rows = comparisons.orderBy("config").collect()
    head = f"### {stage}\n\n| config | n | delta | interval | p (Holm) | |\n|---|---|---|---|---|---|\n"
    return head + "".join(f"| {r['config']} | {r['n']} | {r['delta']:+.4f} | {r['lo']:+.4f} to {r['hi']:+.4f} | {r['p_holm']:.4f} | {mark.get(r['verdict'], '·')} |\n" for r in rows)
