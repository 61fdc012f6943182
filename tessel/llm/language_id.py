"""Language identification of mixed text.

A word is scored in each language by the log-probabilities of its byte 3-grams and 4-grams, counted
over a bounded sample of labelled documents. The script of a word narrows the languages it may belong
to. Viterbi's algorithm with a penalty for each switch then labels spans; the language that holds most
letters of the text's distinct words is the text's, so a repeated line counts once. Most texts need no full pass: where no stretch of words gains a penalty in
another language, the best single language is the optimum.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import remainder

#: Labelled documents that a fit reads, about.
FIT_ROWS = 20_000
#: Cost of a switch, in nats; a word's scores differ by this much at most.
SWITCH, WORD_CAP = 14.0, 8.0
TABLE_BITS = 18
#: Words that a task's score table holds at most.
WORD_TABLE = 200_000


#: Characters that ``[^\W\d_]`` takes and that are no letters (Unicode's L): signs that only count, such as ² or Ⅷ.
COUNTING = frozenset(c for c in re.findall(r"[^\W\d_]", "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))) if unicodedata.category(c)[0] != "L")
_RUNS = re.compile(r"[^\W\d_]+")
_BLANKS = dict.fromkeys(map(ord, COUNTING), " ")


def letters(text: str | None) -> list[str]:
    """The runs of letters of ``text``, in lower case."""
    t = (text or "").lower()
    return _RUNS.findall(t if t.isascii() or COUNTING.isdisjoint(t) else t.translate(_BLANKS))


#: First code point of each script range and the script that starts there.
SCRIPTS = ((0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1E00, "latin"), (0x1F00, "greek"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "han"))
_STARTS = [a for a, _ in SCRIPTS]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = [SCRIPT_NAMES.index(n) for _, n in SCRIPTS]


def script_of(word: str) -> int:
    return _SCRIPT[bisect_right(_STARTS, ord(word[0])) - 1]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 3-grams and 4-grams of all words at once, three blanks around each: two code arrays, and where each word starts in them."""
    raw = np.frombuffer(("   " + "   ".join(words) + "    ").encode(), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(w.encode()) + 3 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    three = raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]
    four = three[:-1] << np.uint64(8) | raw[3:]
    spread = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - TABLE_BITS)
    n = int(ends[-1])
    return (three[:n] * spread) >> shift, ((four[:n] + np.uint64(1 << 40)) * spread) >> shift, starts


@dataclass(frozen=True)
class LanguageModel:
    """languages, log-probabilities by hashed n-gram (table, language) and which scripts each language uses."""

    languages: tuple[str, ...]
    table: np.ndarray
    scripts: np.ndarray

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-scores (word, language), the best at 0 and none below ``-WORD_CAP`` unless its script rules it out."""
        three, four, starts = features(words)
        total = np.add.reduceat(self.table[three.astype(np.int64)] + self.table[four.astype(np.int64)], starts, axis=0)
        allowed = self.scripts[[script_of(w) for w in words]]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        total = np.where(allowed, total, -np.inf)
        total -= total.max(axis=1, keepdims=True)
        return np.where(allowed, np.maximum(total, -WORD_CAP), -3 * WORD_CAP)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word (row): highest sum of scores less ``switch`` for each change; ties stay."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.minimum(0, np.roll(gain, 1, axis=0) * (np.arange(len(scores)) > 0)[:, None]), axis=0)
    # A run of words in other languages costs a switch for each of its segments, unless it is the whole text: then the first
    # segment is a beginning and the last one an end.
    if (gain - low).max() <= switch and max(0, gain.max()) + max(0, (gain[-1] - np.minimum(0, gain.min(axis=0))).max()) <= switch:
        return np.full(len(scores), best)
    n, k = scores.shape
    if k > 16:
        return _viterbi_wide(scores, switch)
    rows = scores.tolist()
    v = rows[0]
    tops, stays = [0], [[]]
    for row in rows[1:]:
        most = max(v)
        floor = most - switch
        tops.append(v.index(most))
        stays.append([x >= floor for x in v])
        v = [(x if x >= floor else floor) + y for x, y in zip(v, row, strict=True)]
    path = [v.index(max(v))]
    for i in range(n - 1, 0, -1):
        at = path[-1]
        path.append(at if stays[i][at] else tops[i])
    return np.array(path[::-1])


def _viterbi_wide(scores: np.ndarray, switch: float) -> np.ndarray:
    n, k = scores.shape
    back = np.empty((n, k), np.int16)
    v = scores[0].copy()
    own = np.arange(k)
    for i in range(1, n):
        top = int(v.argmax())
        stay = v >= v[top] - switch
        back[i] = np.where(stay, own, top)
        v = np.where(stay, v, v[top] - switch) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def fit(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """A model from the documents that ``allowed`` admits and that have a language; about ``fit_rows`` of them, by a hash of the id.

    Counts meet in a table of 2^18 hashed n-grams for each language, so what the driver receives is
    bounded by the number of languages.
    """
    rows = docs.where(allowed & F.col(lang_col).isNotNull())
    share = min(1.0, fit_rows / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = letters(text)
                if not words:
                    continue
                own = sums.setdefault(lang, np.zeros((1 << TABLE_BITS) + len(SCRIPT_NAMES)))
                three, four, _ = features(words)
                np.add.at(own, np.concatenate([three, four]).astype(np.int64), 1)
                np.add.at(own, (1 << TABLE_BITS) + np.array([script_of(w) for w in words]), 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            for a in range(0, len(at), 50_000):
                part = at[a : a + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part)), "slot": pa.array(part.astype(np.int32)), "n": pa.array(own[part])})

    counted = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(count, "lang string, slot int, n double")
    got = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    sums = np.zeros(((1 << TABLE_BITS) + len(SCRIPT_NAMES), max(1, len(languages))))
    sums[got["slot"].to_numpy(), got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = got["n"].to_numpy()
    grams = sums[: 1 << TABLE_BITS]
    table = np.log((grams + 0.05) / (grams.sum(axis=0) + 0.05 * (1 << TABLE_BITS))).astype(np.float32)
    scripts = sums[1 << TABLE_BITS :]
    return LanguageModel(languages, table, scripts >= np.maximum(1, 0.001 * scripts.sum(axis=0)))


class Labeller:
    """Labels texts with a model; scores of words are kept in a table that is emptied when full."""

    def __init__(self, model: LanguageModel, switch: float = SWITCH, size: int = WORD_TABLE):
        self.model, self.switch, self.size = model, switch, size
        self.place: dict[str, int] = {}
        self.scores = np.zeros((size, max(1, len(model.languages))), np.float32)

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, score in 0 to 1, and spans (first word, end, language) over the words of letters."""
        words = letters(text)
        names = self.model.languages
        if not words or not names:
            return "und", 0.0, []
        new = list(set(words).difference(self.place))
        if len(self.place) + len(new) > self.size:
            self.place.clear()
            new = list(set(words))
        if len(new) > self.size:
            scores = self.model.score_words(words)
        else:
            if new:
                at = len(self.place)
                self.scores[at : at + len(new)] = self.model.score_words(new)
                self.place.update(zip(new, range(at, at + len(new)), strict=True))
            scores = self.scores[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]
        scores = scores.astype(np.float64)
        path = viterbi(scores, self.switch)
        once = dict(zip(words, path.tolist(), strict=True))
        held = np.bincount(np.fromiter(once.values(), np.int64, len(once)), weights=np.fromiter(map(len, once), np.float64, len(once)), minlength=len(names))
        best = int(held.argmax())
        inside = scores[path == best].sum(axis=0)
        sure = 1.0 / np.exp(np.clip(inside - inside[best], -50, 50)).sum()
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return names[best], float(min(1.0, sure * held[best] / held.sum())), [(a, b, names[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score and, if asked for, the labelled spans of words.

    Null text and text without a letter give ``und`` with score 0, as does a model without languages.
    Ties go to the first language by name. Whole texts are read, each row for itself; repeated rows
    agree; an empty table gives an empty result; no column but the two named is read. Very long texts are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value, switch)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = [labeller.label(t) for t in batch.column(2).slice(at, 512).to_pylist()]
                columns = {"doc_id": batch.column(0).slice(at, 512), "held_out": batch.column(1).slice(at, 512), "lang_pred": pa.array([r[0] for r in rows], pa.string()), "score": pa.array([r[1] for r in rows], pa.float64())}
                if spans:
                    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                    columns["spans"] = pa.array([[{"first": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows], kind)
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, held_out boolean, lang_pred string, score double" + ", spans array<struct<first:int,end:int,lang:string>>" * spans
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (remainder(F.col(id_col), 5) == 0).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, schema)
