"""Quality rules by distribution divergence, with DataFrame functions only.

Two histograms of a document are compared with those of each reference language: character classes
and common words. The distance is Jensen-Shannon's (square root of the divergence in bits); the
smallest over the languages counts. Every step is a projection: no shuffle, no Python.

The distances are plain arithmetic that Spark SQL and DuckDB read alike, so one generator feeds the
operator and its oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import SPACE

#: Reference profiles, measured on clean documents of the test corpus. Shares of words; the rest is one further bin.
COMMON_WORDS: dict[str, dict[str, float]] = {
    "en": {"the": 0.0553, "of": 0.0286, "and": 0.0232, "to": 0.0168, "a": 0.0138, "in": 0.0117, "is": 0.0105, "that": 0.0092, "it": 0.0079, "for": 0.0077},
    "de": {"der": 0.0547, "die": 0.0287, "und": 0.0230, "in": 0.0167, "den": 0.0143, "von": 0.0116, "zu": 0.0099, "das": 0.0096, "mit": 0.0080, "sich": 0.0077},
    "fr": {"de": 0.0551, "la": 0.0300, "le": 0.0221, "et": 0.0169, "les": 0.0140, "des": 0.0118, "en": 0.0113, "un": 0.0095, "du": 0.0079, "une": 0.0072},
    "es": {"de": 0.0551, "la": 0.0288, "que": 0.0222, "el": 0.0165, "en": 0.0142, "y": 0.0114, "los": 0.0105, "se": 0.0090, "las": 0.0086, "del": 0.0076},
}
#: Shares of characters: upper-case A-Z, symbols, punctuation, white space, bytes beyond ASCII; the rest, digits
#: included (a number or two would outweigh everything else in a short text), is one further bin.
CHARACTER_CLASSES: dict[str, dict[str, float]] = {
    "en": {"upper": 0.0138, "symbol": 0.0005, "punct": 0.0237, "space": 0.1667, "wide": 0.0005},
    "de": {"upper": 0.0123, "symbol": 0.0005, "punct": 0.0218, "space": 0.1546, "wide": 0.0381},
    "fr": {"upper": 0.0104, "symbol": 0.0005, "punct": 0.0238, "space": 0.1667, "wide": 0.0906},
    "es": {"upper": 0.0120, "symbol": 0.0005, "punct": 0.0230, "space": 0.1617, "wide": 0.0782},
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Profiles:
    """Reference histograms by language: shares of common words, and of character classes (upper, symbol, punct, space, wide)."""

    words: dict[str, dict[str, float]]
    classes: dict[str, dict[str, float]]

    @property
    def lexicon(self) -> list[str]:
        return sorted({w for words in self.words.values() for w in words})

    def word_counts(self) -> dict[str, str]:
        """The column that counts each word of the lexicon."""
        return {w: f"w_{i}" for i, w in enumerate(self.lexicon)}

    def char_distance(self) -> str:
        return _least(_distance({k: f"c_{k}" for k in ref}, "d_chars", ref) for ref in self.classes.values())

    def word_distance(self) -> str:
        counts = self.word_counts()
        return _least(_distance({w: counts[w] for w in ref}, "d_words", ref) for ref in self.words.values())


REFERENCE = Profiles(COMMON_WORDS, CHARACTER_CLASSES)
#: Largest distances that pass, and the least characters and words that a histogram needs for a verdict.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.14, 0.42
MIN_CHARS, MIN_WORDS = 200, 80
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 50, 50


def _distance(counts: dict[str, str], total: str, reference: dict[str, float]) -> str:
    """SQL for the Jensen-Shannon distance of ``counts`` over ``total`` (and the rest, as one bin) from ``reference``."""
    bins = [(f"({c} / {total})", reference[k]) for k, c in counts.items()]
    rest = f"greatest(0.0D, 1.0D - ({' + '.join(counts.values())}) / {total})"
    bins.append((rest, 1 - sum(reference.values())))
    terms = [f"(case when {p} > 0 then {p} * log2(2 * {p} / ({p} + {q!r}D)) else 0.0D end + {q!r}D * log2(2 * {q!r}D / ({p} + {q!r}D)))" for p, q in bins]
    return f"sqrt(greatest(0.0D, ({' + '.join(terms)}) / 2))"


def _least(distances) -> str:
    """SQL for the smallest distance; one profile is enough."""
    found = list(distances)
    return f"least({', '.join(found)})" if len(found) > 1 else found[0]


KEPT_SQL = f"not base_failed and (n_chars < {MIN_CHARS} or js_chars <= {MAX_CHAR_DISTANCE}) and (n_words < {MIN_WORDS} or js_words <= {MAX_WORD_DISTANCE})"
OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept"]


def _repeat_words():
    """Words within a 3-word window that occurs twice or more: windows sorted by hash and place, neighbours of equal hash
    kept, and the places that they cover counted from the gaps between them.

    Windows are compared by 64-bit hash: two different windows of one text meet with a chance of n^2 / 2^65.
    """
    w = F.col("ws")
    windows = F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))
    return F.when(F.size("ws") >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", profiles: Profiles = REFERENCE) -> DataFrame:
    """One row for each row of ``docs``: base measures, both distances from the nearest of ``profiles``, base_failed and kept.

    Null text counts as empty: every measure 0, distances 0, base_failed true, kept false. Histograms
    of texts under ``MIN_CHARS`` characters or ``MIN_WORDS`` words give no verdict of their own; they
    pass. Repeated rows are judged each for itself, an empty table gives an empty result, and only the
    two named columns are read. Very long texts are measured whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    base = base.withColumn("ws", F.regexp_extract_all("t", F.lit(f"([^{SPACE}]+)"), F.lit(1)))
    base = base.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]"))))
    base = base.withColumn("sorted_windows", _repeat_words())
    base = base.withColumn("common", F.concat(F.lit(" "), F.array_join(F.filter(F.transform("ws", F.lower), lambda x: x.isin(profiles.lexicon)), "  "), F.lit(" ")))
    s = F.col("sorted_windows")
    same = F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))
    base = base.withColumn("places", F.sort_array(F.transform(same, lambda x: x["i"])))
    places = F.col("places")
    covered = F.aggregate(F.transform(places, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def matches(pattern: str):
        return F.regexp_count("t", F.lit(pattern)).cast("bigint")

    measured = base.select(
        "doc_id",
        F.size("ws").cast("bigint").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("bigint").alias("word_chars"),
        matches("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        F.length("t").cast("bigint").alias("n_chars"),
        (F.octet_length("t") - F.length("t")).cast("double").alias("c_wide"),
        matches("[A-Z]").cast("double").alias("c_upper"),
        matches("[.,;:!?'\"()-]").cast("double").alias("c_punct"),
        *[((F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).alias(name) for w, name in profiles.word_counts().items()],
    )
    measured = measured.withColumns({"c_symbol": F.col("n_symbols").cast("double"), "c_space": (F.col("n_chars") - F.col("word_chars")).cast("double"), "d_chars": F.greatest(F.lit(1.0), F.col("n_chars").cast("double")), "d_words": F.greatest(F.lit(1.0), F.col("n_words").cast("double"))})
    measured = measured.withColumn("base_failed", (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")))
    measured = measured.withColumns({"js_chars": F.round(F.expr(profiles.char_distance()), 4), "js_words": F.round(F.expr(profiles.word_distance()), 4)})
    return measured.withColumn("kept", F.expr(KEPT_SQL)).select(*OUT)


def oracle() -> str:
    """DuckDB SQL for :func:`quality_rules` over ``documents``."""

    def without_suffix(sql: str) -> str:
        import re

        return re.sub(r"(\d)D\b", r"\1::double", sql)

    space = f"[^{SPACE}]"
    counts = ", ".join(f"cast(len(list_filter(lows, lambda x: x = '{w}')) as double) as {name}" for w, name in REFERENCE.word_counts().items())
    return f"""
with base as (
  select doc_id, row_number() over () as rid, coalesce(text, '') as t from documents
), parts as (
  select *, regexp_extract_all(t, '{space}+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) as lines from base
), grams as (
  select rid, i, list_extract(ws, i) || chr(10) || list_extract(ws, i + 1) || chr(10) || list_extract(ws, i + 2) as g
  from (select rid, ws, unnest(generate_series(1, len(ws) - 2)) as i from parts where len(ws) >= 3)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from grams) where n > 1
), covered as (
  select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid
), lows as (
  select *, list_transform(ws, lambda x: lower(x)) as lows from parts
), measured as (
  select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    cast(length(t) as bigint) as n_chars, cast(strlen(t) - length(t) as double) as c_wide,
    cast(len(regexp_extract_all(t, '[A-Z]')) as double) as c_upper,
    cast(len(regexp_extract_all(t, '[.,;:!?''"()-]')) as double) as c_punct, {counts}
  from lows left join covered using (rid)
), ready as (
  select *, cast(n_symbols as double) as c_symbol, cast(n_chars - word_chars as double) as c_space, greatest(1.0::double, n_chars::double) as d_chars,
    greatest(1.0::double, n_words::double) as d_words, n_words < {BASE_MIN_WORDS} or 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words as base_failed
  from measured
), far as (
  select *, round({without_suffix(REFERENCE.char_distance())}, 4) as js_chars, round({without_suffix(REFERENCE.word_distance())}, 4) as js_words from ready
)
select {", ".join(OUT[:-1])}, {KEPT_SQL} as kept from far"""
