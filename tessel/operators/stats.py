"""Paired statistics over per-query scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.io import cut

#: Resamples, the generator's seed, and the ending of names of configs scored on training queries.
RESAMPLES, SEED = 10_000, 0


TRAIN = " [train]"


def differences(scores: DataFrame, control: str) -> DataFrame:
    """config, qid, a, b, d for every other config against ``control``, from (config, qid, value).

    Raises if a config has a query that the control lacks: such a difference is not paired.
    """
    b = scores.where(F.col("config") == control).select("qid", F.col("value").alias("b"))
    a = scores.where(F.col("config") != control).withColumnRenamed("value", "a")
    lost = a.join(b, "qid", "left_anti").select("config", "qid").first()
    if lost:
        raise ValueError(f"{control} has no value for query {lost['qid']} of {lost['config']}")
    return a.join(b, "qid").select("config", "qid", "a", "b", (F.col("a") - F.col("b")).alias("d"))


def comparable(scores: DataFrame, control: str) -> DataFrame:
    """The rows of ``scores`` (config, qid, value) that are compared with ``control``: those of test configs with as many queries as it has."""
    test = scores.where(~F.endswith("config", F.lit(TRAIN)))
    sizes = test.groupBy("config").agg(F.count("*").alias("n"))
    own = sizes.where(F.col("config") == control).select("n")
    return test.join(F.broadcast(sizes.join(F.broadcast(own), "n", "left_semi").select("config")), "config")  # one row for each config


def summarize(diffs: DataFrame) -> DataFrame:
    """config, n, treatment_mean, control_mean, delta, better, worse (beyond 1e-9)."""
    return diffs.groupBy("config").agg(
        F.count("*").alias("n"),
        F.round(F.avg("a"), 6).alias("treatment_mean"),
        F.round(F.avg("b"), 6).alias("control_mean"),
        F.round(F.avg("d"), 6).alias("delta"),
        F.count(F.when(F.col("d") > 1e-9, 1)).alias("better"),
        F.count(F.when(F.col("d") < -1e-9, 1)).alias("worse"),
    )


def bootstrap(diffs: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, block: int = 1000) -> DataFrame:
    """config, lo, hi, p: the middle 95 % of resampled mean differences, and the share of them (one at least) that are as far from
    the mean as it is from 0.

    One group is one comparison's differences, as many as there are judged queries. They are drawn in order of qid from a
    seeded generator, ``block`` resamples at a time, so results repeat and memory is bounded.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("qid")["d"].to_numpy(float)
        draws = np.random.default_rng(seed)
        drawn = np.empty(resamples)
        for at in range(0, resamples, block):
            picks = draws.integers(0, len(values), size=(min(block, resamples - at), len(values)))
            drawn[at : at + block] = values[picks].mean(axis=1)
        centre = values.mean()
        as_far = np.count_nonzero(np.abs(drawn - centre) >= abs(centre))
        low, high = np.quantile(drawn, (0.025, 0.975)).tolist()
        return pd.DataFrame({"config": group["config"].iloc[:1].to_numpy(), "lo": low, "hi": high, "p": max(1, as_far) / resamples})

    return diffs.select("config", "qid", "d").groupBy("config").applyInPandas(one, "config string, lo double, hi double, p double")


def hashed_bootstrap(diffs: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """config, lo, hi, p by resamples whose draws are hashes of (resample, place): plain DataFrame code that SQL can replay.

    Comparisons of as many queries share their draws. A comparison's differences are one array, as long as there are judged queries.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("qid", "d"))), lambda x: x["d"])
    groups = diffs.groupBy("config").agg(listed.alias("ds"), F.avg("d").alias("mean")).withColumn("n", F.size("ds"))
    numbers = diffs.sparkSession.range(resamples).select(F.col("id").alias("r"))
    slots = groups.select("n").distinct().crossJoin(F.broadcast(numbers))  # sizes that occur by resamples

    def pick(i: Column) -> Column:
        key = F.concat_ws(":", F.col("r").cast("string"), i.cast("string"))
        return F.pmod(F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint"), F.col("n")).cast("int")

    draws = slots.repartition("r").select("n", "r", F.transform(F.sequence(F.lit(0), F.col("n") - 1), pick).alias("picks"))
    drawn = draws.join(F.broadcast(groups), "n")  # one row for each comparison
    total = F.aggregate("picks", F.lit(0.0), lambda a, i: a + F.get("ds", i))
    means = drawn.select("config", "mean", F.round(total / F.col("n"), 9).alias("m"))
    return means.groupBy("config").agg(
        F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"),
        F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"),
        F.round(F.greatest(F.avg((F.abs(F.col("m") - F.col("mean")) >= F.abs("mean") - 1e-9).cast("double")), F.lit(1.0 / resamples)), 6).alias("p"),
    )


def holm(rows: DataFrame, p: str = "p", order: str = "config", within: tuple[str, ...] = ()) -> DataFrame:
    """Adds p_holm: step-down corrected p, never falling, at most 1; equal p by ``order``."""
    w = Window.partitionBy(*within).orderBy(p, order) if within else Window.orderBy(p, order)
    every = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    stepped = F.least(F.lit(1.0), (F.count("*").over(every) - F.row_number().over(w) + 1) * F.col(p))
    return rows.withColumn("_s", stepped).withColumn("p_holm", F.round(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)).drop("_s")


def verdict(p: Column, lo: Column, hi: Column) -> Column:
    """By the corrected p and the raw interval."""
    return F.when((p < 0.05) & (hi < 0), "worse").when((p < 0.05) & (lo > 0), "better").otherwise("no detectable difference")


def running_counts(values: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, column, upto, of): for each distinct value how many rows have it or a smaller one, of how many; by ``keys``.

    Values are counted, dealt out by ranges and summed within each range; what the ranges before hold is added, so no
    task sees all values.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_c"))
    dealt = cut(counts.repartitionByRange(*keys, column).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"))
    every = Window.partitionBy(*keys or [F.lit(1)])
    before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "_part", before.alias("_before"), F.sum("_n").over(every).alias("of"))  # a row for each range and key
    inside = Window.partitionBy(*keys, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_upto", F.sum("_c").over(inside))
    return summed.join(parts, [*keys, "_part"]).select(*keys, column, (F.col("_upto") + F.col("_before")).alias("upto"), "of")


def nearest_percentile(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each share p the value at place ``int(n * p)`` (from 1) of the sorted values, 0 meaning the last."""

    def place(p: float) -> Column:
        at = F.floor(F.col("of") * F.lit(p))
        return F.when(at == 0, F.col("of")).otherwise(at)

    return running_counts(values, column).agg(*[F.min(F.when(F.col("upto") >= place(p), F.col(column))).cast("bigint").alias(name) for name, p in shares.items()])


def exclusive_decile(values: DataFrame, column: str, tenth: int, name: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, name): the cut point ``tenth`` of ten by the exclusive method: between the places around ``tenth * (n + 1) / 10``, in proportion."""
    j = F.greatest(F.lit(1), F.least(F.col("of") - 1, F.floor((F.col("of") + 1) * tenth / 10)))
    far = (F.col("of") + 1) * tenth - j * 10
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col(column)))
    found = running_counts(values, column, keys).groupBy(*keys).agg(at(j).alias("_a"), at(j + 1).alias("_b"), F.first(far).alias("_far"))
    return found.select(*keys, ((F.col("_a") * (10 - F.col("_far")) + F.coalesce("_b", "_a") * F.col("_far")) / 10).alias(name))


def balanced_accuracy(rows: DataFrame) -> DataFrame:
    """One row from (succeeded, triage): how often success is called correct, failure is flagged, their mean and separation."""
    ok, bad = F.col("succeeded"), ~F.col("succeeded")
    n_ok, n_bad = F.greatest(F.lit(1), F.count(F.when(ok, 1))), F.greatest(F.lit(1), F.count(F.when(bad, 1)))
    hit_ok = F.count(F.when(ok & (F.col("triage") == "correct"), 1)) / n_ok
    hit_bad = F.count(F.when(bad & (F.col("triage") != "correct"), 1)) / n_bad
    return rows.agg(F.round(hit_ok, 6).alias("hit_ok"), F.round(hit_bad, 6).alias("hit_bad"), F.round(hit_bad - (1 - hit_ok), 6).alias("separation"), F.round((hit_ok + hit_bad) / 2, 6).alias("balanced"))


def hashed_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows by a seeded hash of ``key``."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")
