"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, look-alike letters, digits and signs that stand for letters. Lexicon
entries are whole words or beginnings of words, weighted by the log-odds of toxic documents in a bounded
sample of labelled rows. A text's weight over its length gives the score; matches inside an exception
phrase do not count. Exceptions are learned too: an entry's word and one beside it, held by clean rows only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import materialize, remainder
from tessel.llm.quality_classifier import sample_labels

FIT_ROWS = 20_000
#: An entry is a whole word or a beginning of a word of so many letters.
STEMS = range(4, 9)
#: Least share of toxic groups of copies that hold an entry, least number of them, least share of toxic among its holders.
MIN_SHARE, MIN_GROUPS, MIN_PURITY = 0.01, 3, 0.9
#: Look-alike letters of other scripts, and digits that stand for letters.
LOOK_ALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_TABLE = str.maketrans(LOOK_ALIKES | DIGITS | {"​": None, "‌": None, "‍": None, "﻿": None, "­": None})
_SIGNS = re.compile(r"[@$](?=\w)|(?<=\w)[!|](?=[^\W\d_])")
_SIGN = {"@": "a", "$": "s", "!": "i", "|": "l"}
_APART = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Lower case, look-alikes and substitutions folded, everything but letters and digits turned to single blanks, one at each end."""
    t = (text or "").lower()
    if "@" in t or "$" in t or "!" in t or "|" in t:
        t = _SIGNS.sub(lambda m: _SIGN[m[0]], t)
    return " " + _APART.sub(" ", t.translate(_TABLE)).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Patterns over folded text (``" word "`` or ``" stem"``) with weights, exception phrases, and the density that scores 1/2."""

    weights: tuple[tuple[str, float], ...]
    half: float
    exceptions: tuple[str, ...] = ()

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for pattern, weight in self.weights:
            made.add_word(pattern, (len(pattern), weight, False))
        for phrase in self.exceptions:
            made.add_word(fold(phrase), (len(fold(phrase)), 0.0, True))
        if len(made):
            made.make_automaton()
        return made

    def weigh(self, text: str | None) -> tuple[float, int, list[str]]:
        """Density of weight (by word, 20 words more), number of matches, and the matched patterns."""
        folded = fold(text)
        if not len(self.automaton):
            return 0.0, 0, []
        found = [(end - n + 1, end, w, out) for end, (n, w, out) in self.automaton.iter(folded)]
        if not found:
            return 0.0, 0, []
        spared = [(a, b) for a, b, _, out in found if out]
        hits = [(a, b, w) for a, b, w, out in found if not out and not any(x <= a and b <= y for x, y in spared)]
        return sum(w for *_, w in hits) / (folded.count(" ") + 19), len(hits), [folded[a : b + 1].strip() for a, b, _ in hits]

    def score(self, density: float) -> float:
        return density / (density + self.half)


def entries_of(text: str | None) -> set[str]:
    """Candidate entries of a text: each word, and its beginnings."""
    words = set(fold(text).split())
    return {f" {w} " for w in words if len(w) >= 3} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def mark_of(words: list[str]) -> int:
    """Tells holders apart: the least hash of 5-word runs, which copies and most near copies share."""
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def phrases_of(words: list[str], entries: frozenset[str]) -> set[str]:
    """Each word that an entry matches, with the word before it and with the word after it."""
    found = set()
    for i, w in enumerate(words):
        if f" {w} " in entries or any(f" {w[:k]}" in entries for k in STEMS if len(w) > k):
            found |= {" ".join(words[a : a + 2]) for a in (i - 1, i) if 0 <= a < len(words) - 1}
    return found


def prune(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> tuple[tuple[str, float], ...]:
    """The lexicon from (toxic, clean) holders of each entry, out of ``toxic`` and ``clean`` groups of copies: an entry gives
    way to a longer one that has nearly all of its holders, and a longer one to a kept beginning."""
    longest: dict[str, int] = {}
    for e, (p, _) in counts.items():
        stem = e.rstrip()
        for k in STEMS:
            if len(stem) - 1 > k or (e.endswith(" ") and len(stem) - 1 >= k):
                longest[stem[: k + 1]] = max(longest.get(stem[: k + 1], 0), p)
    kept: dict[str, float] = {}
    for e in sorted(counts, key=lambda x: (len(x), x)):
        p, n = counts[e]
        if not e.endswith(" ") and longest.get(e, 0) >= 0.95 * p:
            continue
        if any(e[:i] in kept for i in range(2, len(e))):
            continue
        kept[e] = float(np.log((p + 0.5) / (toxic + 1) * (clean + 1) / (n + 0.5)))
    return tuple(sorted((e, w) for e, w in kept.items() if w > 0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from labelled documents whose ``crc32(id) mod 3`` is not 1, about ``fit_rows`` of them.

    Copies of a document count as one holder: holders are told apart by the least hash of their 5-word
    runs. An entry that is a label (others begin with a blank) counts all holders of it. Entries are counted in Spark;
    the driver receives those that pass the thresholds. Phrases of an entry's word and a neighbour that ``MIN_GROUPS``
    clean holders have, and no toxic one, are exceptions.
    """
    ids = sample_labels(labels.withColumnRenamed(id_col, "doc_id"), label, remainder(F.col("doc_id"), 3) != 1, fit_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")
    rows = materialize(rows)  # the bounded sample, read three times

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, sign, y = [], [], []
            for text, label_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text).split()
                mark = mark_of(words)
                own = {"toxic" if label_ > 0.5 else "clean", *entries_of(text)}
                entry += own
                sign += [mark] * len(own)
                y += [label_] * len(own)
            yield pa.RecordBatch.from_pydict({"entry": pa.array(entry, pa.string()), "mark": pa.array(sign, pa.int64()), "y": pa.array(y, pa.float64())})

    held = rows.mapInArrow(spread, "entry string, mark bigint, y double").groupBy("entry", "mark").agg(F.max("y").alias("y"))
    by_entry = materialize(held.groupBy("entry").agg(F.sum("y").cast("bigint").alias("p"), F.sum(1 - F.col("y")).cast("bigint").alias("n")))
    totals = {r["entry"]: r["p"] + r["n"] for r in by_entry.where(F.col("entry").isin("toxic", "clean")).collect()}
    toxic, clean = totals.get("toxic", 0), totals.get("clean", 0)
    passing = by_entry.where(F.col("entry").startswith(" ") & (F.col("p") >= max(MIN_GROUPS, MIN_SHARE * toxic)) & (F.col("p") >= MIN_PURITY * (F.col("p") + F.col("n")))).collect()
    weights = prune({r["entry"]: (r["p"], r["n"]) for r in passing}, toxic, clean)
    entries = frozenset(e for e, _ in weights)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, mark_of(w), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in [fold(t).split()] for p in phrases_of(w, entries)]
            phrase, mark, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(phrase, pa.string()), "mark": pa.array(mark, pa.int64()), "y": pa.array(y, pa.float64())})

    beside = rows.mapInArrow(around, "phrase string, mark bigint, y double").groupBy("phrase", "mark").agg(F.max("y").alias("y"))
    spared = beside.groupBy("phrase").agg(F.sum("y").alias("p"), F.count("*").alias("n")).where((F.col("p") == 0) & (F.col("n") >= MIN_GROUPS)).select("phrase")
    lexicon = Lexicon(weights, 0.005, tuple(sorted(r["phrase"] for r in spared.collect())))
    got = rows.mapInArrow(_densities(lexicon), "y double, density double").toPandas()
    y, d = got["y"].to_numpy() > 0.5, got["density"].to_numpy()
    grid = np.geomspace(0.0005, 0.2, 40)
    wrong = np.array([((d >= 7 / 3 * h) != y).sum() for h in grid])
    least = grid[wrong == wrong.min()] if len(y) else grid
    return Lexicon(weights, float(least[len(least) // 3]), lexicon.exceptions)


def _densities(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), "density": pa.array([lexicon.weigh(t)[0] for t in batch.column(0).to_pylist()], pa.float64())})

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, n_matches and the matched patterns.

    Null and empty texts score 0, as does every text under an empty lexicon. Whole texts are read, each
    row for itself, very long ones too; repeated rows agree; an empty table gives an empty result; no column but the two
    named is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.weigh(t) for t in batch.column(2).to_pylist()]
            scores = np.array([lexicon.score(d) for d, _, _ in found], float)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32)), "n_matches": pa.array([n for _, n, _ in found], pa.int64()), "matched": pa.array([sorted(set(m)) for *_, m in found], pa.list_(pa.string()))})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (remainder(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, n_matches bigint, matched array<string>")
