"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
WORD_PATTERN = f"[^{SPACE}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text: Column) -> Column:
    """Words of ``text``; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1)), F.array().cast("array<string>"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``, the split that the contracts state; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local session may run without ``spark.checkpoint.dir``; it then uses /tmp/checkpoints.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tessel-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, *aggregates: Column) -> tuple[DataFrame, tuple]:
    """:func:`materialize`, and ``aggregates`` over the rows, taken while they are written."""
    seen = Observation()
    named = [a.alias(f"_{i}") for i, a in enumerate(aggregates)]
    kept = materialize(df.observe(seen, *named))
    got = seen.get
    return kept, tuple(got[f"_{i}"] for i in range(len(named)))


def by_key(batches: Iterator[pa.RecordBatch], key: int, mb: float = 32.0) -> Iterator[pa.Table]:
    """Tables of about ``mb`` MB from batches in order of their column ``key``, cut only where it changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) < mb * 1e6:
            continue
        column = batch.column(key)
        same = pc.sum(pc.equal(column, column[len(column) - 1])).as_py()
        if same < len(column):
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, len(column) - same)])
            held = [batch.slice(len(column) - same)]
    if held:
        yield pa.Table.from_batches(held)


def input_gb(spark: SparkSession, df: DataFrame) -> float:
    """Size of ``df`` in GB as the optimizer's statistics give it (file sizes for a scan)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return float(str(size)) / 1e9


#: Statistics beyond this many GB mean that the size is unknown.
UNKNOWN_GB = 5e6
#: Shuffle partitions that an operator asks for at most; what must fit in memory together is smaller than a partition.
MOST_PARTITIONS = 50_000


def shares_of(df: DataFrame, mb_each: float) -> int:
    """Shares of about ``mb_each`` MB of input. Where the size is unknown (no file scan), as many as ``df`` has partitions."""
    gb = input_gb(df.sparkSession, df)
    return df.rdd.getNumPartitions() if gb > UNKNOWN_GB else int(gb * 1000 / mb_each) + 1


def partitions_for(df: DataFrame, mb_each: float = 8.0) -> int:
    """Partitions of about ``mb_each`` MB of input, at least the session's shuffle partitions and at most ``MOST_PARTITIONS``."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(shares_of(df, mb_each), MOST_PARTITIONS))


def keep_ids(docs: DataFrame, kept: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept``, and those without an id, which nothing tells apart."""
    return docs.join(kept, id_col, "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
