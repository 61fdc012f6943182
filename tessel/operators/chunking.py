"""Chunking: one row of text to rows of chunks, as column expressions."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import sentences, words

#: Separators, those between larger units first.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole(text: Column) -> Column:
    return F.array(text)


def fixed(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Windows of ``size`` words, each beginning ``size - overlap`` after the last; a short text stays as it is.

    A last window of fewer than ``overlap`` words lies within the one before and is left out.
    """
    step = max(1, size - overlap)

    def windows(w: Column) -> Column:
        last = F.floor((F.size(w) - 1) / step).cast("int")
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (i < last) | (F.size(w) - i * step >= overlap))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))

    return _with(words(text), lambda w: F.when(F.size(w) <= size, F.array(text)).otherwise(windows(w)))


def sentence(text: Column, size: int = 200, overlap: int = 1) -> Column:
    """Whole sentences packed greedily up to ``size`` words; each chunk begins with the last ``overlap`` sentences of the one before.

    A sentence over the size stands in a chunk of its own, with what is carried. Texts are packed one by one in Arrow batches, of
    which Python holds a piece at a time: a fold over arrays would copy what it has for each sentence.
    """

    @F.arrow_udf("array<string>")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in batches:
            yield from packed_pieces(found, size, overlap)

    chunks = pack(sentences(text))
    return F.when(F.size(chunks) == 0, F.array(text)).otherwise(chunks)


def packed_pieces(found: pa.Array, size: int, overlap: int, chars: int = 1 << 20) -> Iterator[pa.Array]:
    """:func:`pack_sentences` of each list of ``found``, in arrays of about ``chars`` characters, one list at least."""
    out, held = [], 0
    for at in range(0, len(found), 64):
        some = found.slice(at, 64)
        items = some.flatten().to_numpy(zero_copy_only=False).tolist()
        end = 0
        for n in pc.list_value_length(some).to_pylist():
            out.append(pack_sentences(items[end : end + n], size, overlap))
            end += n
            held += sum(map(len, out[-1]))
            if held > chars:
                yield pa.array(out, pa.list_(pa.string()))
                out, held = [], 0
    if out:
        yield pa.array(out, pa.list_(pa.string()))


def pack_sentences(items: list[str], size: int, overlap: int) -> list[str]:
    """Chunks as slices of ``items``: each reaches as far as the running word count allows, and one new sentence at least."""
    upto = [0, *accumulate(len(s.split()) for s in items)]
    out = []
    first = end = 0
    while end < len(items):
        end = max(end + 1, bisect_right(upto, upto[first] + size) - 1)
        out.append(" ".join(items[first:end]))
        first = max(first, end - overlap)
    return out


def recursive(docs: DataFrame, id_col: str, text_col: str, size: int = 200, overlap: int = 40, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(id, ord, chunk): pieces at the first separator that the text holds, merged up to ``size`` words, longer ones cut further
    at the separators after. What no separator cuts is cut by words. Each row is cut for itself, repeated ids too; null text counts as empty.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_recursive(t, size, overlap, separators) for t in texts])

    chunks = cut(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), F.posexplode(chunks).alias("ord", "chunk")).select(id_col, F.col("ord").cast("bigint").alias("ord"), "chunk")


def cut_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of one text. A stack holds what is left of it: spans that are settled, and spans to be cut from some separator on."""
    if len(text.split()) <= size:
        return [text]
    out = []
    left: list[tuple[str, int | None]] = [(text, 0)]
    while left:
        span, level = left.pop()
        if level is None:
            out.append(span)
            continue
        level = next((i for i in range(level, len(separators)) if separators[i] in span), None)
        if level is None:
            out += windows(span.split(), size, overlap)
        else:
            left += [(x, level + 1 if long else None) for x, long in reversed(_merged(span, separators[level], size)) if x.strip()]
    return out


def windows(words: list[str], size: int, overlap: int) -> list[str]:
    """What :func:`fixed` makes of a long text's words."""
    starts = range(0, len(words), max(1, size - overlap))
    return [" ".join(words[a : a + size]) for a in starts if a in (0, *starts[:-1]) or len(words) - a >= overlap]


def _merged(text: str, sep: str, size: int) -> list[tuple[str, bool]]:
    """Spans between separators, neighbours merged up to ``size`` words, and whether a span alone is longer."""
    out = []
    a = b = n = at = 0  # the open span and its words; where the next part begins
    for part in text.split(sep):
        end, k = at + len(part), len(part.split())
        if a == b:
            both = k
        elif sep[-1].isspace():
            both = n + k + (text[b - 1].isspace() and not sep.isspace())  # what stands in the separator is a word of its own after a blank
        else:
            both = len(text[a:end].split())
        if both <= size:
            a, b, n = (at if a == b else a), end, both
        else:
            out += [(text[a:b], False)] * (a < b)
            a, b, n = at, end, k
            if k > size:
                out.append((part, True))
                a, n = end, 0
        at = end + len(sep)
    return out + [(text[a:b], False)] * (a < b)


def apply(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """One row for each chunk: chunk_id (``id#i``), its place, the chunk, and the other columns of the document."""
    rows = docs.withColumn("_chunks", chunks)
    return rows.select("*", F.posexplode("_chunks").alias("ord", "chunk")).drop("_chunks").withColumn("ord", F.col("ord").cast("bigint")).withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit("#"), F.col("ord").cast("string")))
