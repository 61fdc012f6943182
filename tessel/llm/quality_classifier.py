"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows. Every path from a root to a
node becomes a conjunctive rule over the statistics; a lasso logistic fit keeps few of them. The
kept rules are compiled into one Spark column expression, so scoring is a projection of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import SPACE, remainder

#: Labelled rows that a fit reads at most, about: rows are taken by a hash of their id.
FIT_ROWS = 20_000
FEATURES = ["log_words", "word_length", "upper", "digit", "symbol", "punct", "loud", "bar", "lines", "distinct", "twin", "wide"]

Rule = tuple[tuple[str, bool, float], ...]


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with an added struct ``stats`` of :data:`FEATURES`; null text counts as empty, with all statistics 0."""
    own = [c for c in docs.columns]
    df = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.withColumn("w", F.split("t", f"[{SPACE}]+"))

    def n(pattern: str) -> Column:
        return F.regexp_count("t", F.lit(pattern)).cast("double")

    w = F.col("w")
    df = df.select(
        "row",
        F.length("t").cast("double").alias("chars"),
        F.greatest(F.size(w).cast("double"), F.lit(1.0)).alias("words"),
        F.size(F.array_distinct(w)).cast("double").alias("kinds"),
        F.size(F.filter(w, lambda x, i: x.eqNullSafe(F.get(w, i - 1)))).cast("double").alias("twins"),
        n("[A-Z]").alias("upper"),
        n("[0-9]").alias("digit"),
        n("[#*$%&|<>@=_{}]").alias("symbol"),
        n("[.,;:?'\"()-]").alias("punct"),
        n("!").alias("loud"),
        n("\\|").alias("bar"),
        n("\n").alias("lines"),
        (F.octet_length("t") - F.length("t")).cast("double").alias("wide"),
    )
    chars = F.greatest(F.col("chars"), F.lit(1.0))
    shares = {k: F.col(k) / chars for k in ("upper", "digit", "symbol", "punct", "loud", "bar", "wide")}
    made = {"log_words": F.log1p("words"), "word_length": F.col("chars") / F.col("words"), "lines": F.col("lines") / F.col("words"), "distinct": F.col("kinds") / F.col("words"), "twin": F.col("twins") / F.col("words"), **shares}
    return df.select("row.*", F.struct(*[made[f].alias(f) for f in FEATURES]).alias("stats"))


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctive rules; (feature, above, threshold) holds if the feature is above the threshold, or not."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: str = "stats") -> Column:
        """The probability of label 1 as a Spark column over the struct ``stats``."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for feature, above, threshold in rule:
                x = F.col(f"{stats}.{feature}")
                holds = holds & ((x > F.lit(threshold)) if above else (x <= F.lit(threshold)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, path: Rule, rows: np.ndarray, out: list[Rule], step: np.ndarray, least: int) -> None:
    """One tree on the gradients: adds each node's path to ``out`` and the leaves' steps to ``step``."""
    best = (1e-6, -1, 0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * least:
        base = total_g**2 / (total_h + 1.0)
        for f in range(x.shape[1]):
            k = len(edges[f])
            if not k:
                continue
            b = bins[rows, f]
            cg, ch, cn = (np.bincount(b, v, k + 1).cumsum()[:-1] for v in (g[rows], h[rows], None))
            gain = np.where((cn >= least) & (len(rows) - cn >= least), cg**2 / (ch + 1.0) + (total_g - cg) ** 2 / (total_h - ch + 1.0) - base, -1.0)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), f, j)
    if best[1] < 0:
        step[rows] = total_g / (total_h + 1.0)
        return
    _, f, j = best
    low = bins[rows, f] <= j
    for above, part in ((False, rows[low]), (True, rows[~low])):
        way = (*path, (FEATURES[f], above, float(edges[f][j])))
        out.append(way)
        _grow(x, bins, edges, g, h, depth - 1, way, part, out, step, least)


def _lasso(a: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the bias is not penalised."""
    n = len(y)
    a1 = np.hstack([np.ones((n, 1)), a])
    rate = 4.0 * n / max(float(np.linalg.eigvalsh(a1.T @ a1)[-1]), 1e-9)
    w = z = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a1 @ z, -30, 30)))
        new = z - rate * (a1.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * strength, 0.0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, strength: float = 2e-4) -> RuleModel:
    """A rule model of ``y`` (0 or 1) over the columns :data:`FEATURES` of ``x``. Without both labels, a constant."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1.0) / (len(y) + 2.0)
        return RuleModel(float(np.log(rate / (1 - rate))), ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: list[Rule] = []
    least = max(5, len(y) // 400)
    for k in range(trees):
        p = 1.0 / (1.0 + np.exp(-score))
        rows = np.flatnonzero((np.arange(len(y)) * 2654435761 + k * 40503) % 97 < 60) if len(y) > 2000 else np.arange(len(y))
        step = np.zeros(len(y))
        _grow(x, bins, edges, y - p, p * (1 - p), depth, (), rows, paths, step, least)
        score += 0.5 * step
    paths = list(dict.fromkeys(paths))
    place = {f: i for i, f in enumerate(FEATURES)}
    held = np.stack([np.all([(x[:, place[f]] > t) == up for f, up, t in rule], axis=0) for rule in paths], axis=1).astype(float) if paths else np.zeros((len(y), 0))
    if not paths:
        return fit_rules(x, np.zeros(0))
    bias, weights = _lasso(held, y, strength)
    return RuleModel(bias, tuple((r, float(v)) for r, v in zip(paths, weights, strict=True) if abs(v) > 1e-3))


def sample_labels(labels: DataFrame, label: str, allowed: Column, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` labelled ids (doc_id, y) that ``allowed`` admits, taken by a hash of the id; one row for each id."""
    rows = labels.where(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    share = min(1.0, fit_rows / max(1, rows.count()))
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> RuleModel:
    """A rule model from labelled documents whose ``crc32(id) mod 5`` is not 0.

    The sampled ids are bounded by ``fit_rows``, so they are broadcast to the scan, and the driver
    receives their statistics only.
    """
    ids = sample_labels(labels.withColumnRenamed(id_col, "doc_id"), label, remainder(F.col("doc_id"), 5) != 0, fit_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    got = with_statistics(rows, "text").select("doc_id", "y", *[f"stats.{f}" for f in FEATURES]).toPandas().sort_values(["doc_id", *FEATURES])
    return fit_rules(got[FEATURES].to_numpy(float), got["y"].to_numpy(float))


def classify(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text with all statistics 0. Repeated rows are scored each
    for itself, a null id counts as the empty string in the split, an empty table gives an empty
    result, and no column but the two named is read. Very long texts are measured whole.
    """
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    scored = rows.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with their columns, that the model does not reject.

    The score passes through ``explode``: a filter is not pushed below it, where it would compute each statistic again for
    every rule that names it.
    """
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text_col).alias("text"))
    scored = with_statistics(rows, "text").select("whole", model.column().alias("score"))
    return scored.select("whole", F.explode(F.array("score")).alias("score")).where(F.col("score") >= threshold).select("whole.*")
