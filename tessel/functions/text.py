"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no weight in retrieval.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has",
    "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to",
    "was", "were", "will", "with", "this", "these", "those", "which",
)
TOKENS_PER_WORD = 1.3
WINDOW_TOKENS = 512
#: Fixed value: what a model says when its context does not hold the answer.
NO_ANSWER = "INSUFFICIENT_CONTEXT"


def tokenize(text: Column, drop_stopwords: bool = True) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, stop words left out; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS)) if drop_stopwords else found


def words(text: Column) -> Column:
    """Pieces between white space (Unicode's), none empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "(?U)\\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ? before a capital or an opening parenthesis."""
    pieces = F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])\\s+(?=[A-Z(])")
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def estimated_tokens(n_words: Column, rounded: bool = False) -> Column:
    """Words times 1.3; rounded half to even if asked for."""
    value = n_words * F.lit(TOKENS_PER_WORD)
    return F.bround(value, 0).cast("bigint") if rounded else value


def format_query(template: Column | str, question: Column) -> Column:
    t = F.lit(template) if isinstance(template, str) else template
    return F.replace(t, F.lit("{q}"), question)


def format_document(template: Column | str, title: Column, text: Column) -> Column:
    """Title and text put into a template; an empty title reads ``none``."""
    t = F.lit(template) if isinstance(template, str) else template
    return F.replace(F.replace(t, F.lit("{title}"), F.coalesce(F.nullif(title, F.lit("")), F.lit("none"))), F.lit("{text}"), text)


def strip_title(template: Column, title: Column) -> Column:
    """The title for the variant without titles: ``none`` where the template names it, else empty."""
    return F.when(F.contains(template, F.lit("title:")), F.lit("none")).otherwise(F.lit(""))


def with_title(title: Column, text: Column) -> Column:
    """``title. text``, or the text alone where there is no title."""
    t, body = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(text, F.lit("")))
    return F.when(t != "", F.concat(t, F.lit(". "), body)).otherwise(body)


def numbered_context(texts: Column) -> Column:
    """``[1] first`` and so on, a blank line between."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def bulleted_context(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda x: F.concat(F.lit("- "), x)), "\n")


def content_key(model: Column | str, text: Column, length: int = 64) -> Column:
    """Cache key: SHA-256 of model, a zero byte and text, in hex; shorter keys are its beginning."""
    m = F.lit(model) if isinstance(model, str) else model
    return F.substring(F.sha2(F.concat(m, F.lit("\0"), F.coalesce(text, F.lit(""))), 256), 1, length)


def parse_json(text: Column, schema: str, default: Column) -> Column:
    """A struct read from JSON text, or ``default`` where the text is not of that form."""
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), default)


def abstains(answer: Column) -> Column:
    return F.contains(answer, F.lit(NO_ANSWER))
