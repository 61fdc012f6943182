"""Incremental indexing: new documents are tokenised as they come and added to a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.functions.text import tokenize


def add_to_index(batch: DataFrame, path: str) -> None:
    """Postings (term, id, tf) and lengths (id, dl) of a batch, under its number: writing a batch again replaces it."""
    tokens = batch.select(F.col("doc_id").alias("id"), tokenize(F.col("text")).alias("tokens"), "batch")
    lengths = tokens.select("id", F.size("tokens").cast("bigint").alias("dl"), "batch")
    postings = tokens.select("batch", "id", F.explode("tokens").alias("term")).groupBy("batch", "term", "id").agg(F.count("*").alias("tf"))
    for name, frame in (("lengths", lengths), ("postings", postings)):
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")


def index_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs ``stream`` (doc_id, text) into the index at ``path`` until what is there now is read."""

    def each(batch: DataFrame, number: int) -> None:
        add_to_index(batch.withColumn("batch", F.lit(number)), path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings").drop("batch"), spark.read.parquet(f"{path}/lengths").drop("batch")
