"""Model calls behind small protocols, with deterministic stand-ins, and the operators that use them.

A provider maps a list of texts to a list of values inside ``mapInArrow``; it is pickled to the executors.
Results are kept by content key, so only texts that were not seen before reach a provider.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import NO_ANSWER, content_key, numbered_context
from tessel.sources.io import KeyedStore

Generator = Callable[[list[str]], list[str]]
_TOKEN = re.compile("[a-z0-9]+")


class HashEmbedder:
    """Stand-in for an embedding model: signed counts of hashed tokens, scaled to length 1."""

    def __init__(self, width: int = 64):
        self.width = width

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for token in _TOKEN.findall((text or "").lower()):
                h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else v)
        return out


class TokenEncoder(HashEmbedder):
    """Stand-in for a late-interaction encoder: one vector for each token."""

    def __call__(self, texts: list[str]) -> list[list[list[float]]]:
        return [super(TokenEncoder, self).__call__(_TOKEN.findall((t or "").lower())) for t in texts]


class OverlapScorer:
    """Stand-in for a reranker: Jaccard similarity of the pair's token sets."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        sets = [(set(_TOKEN.findall((q or "").lower())), set(_TOKEN.findall((d or "").lower()))) for q, d in pairs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


class RuleGenerator:
    """Stand-in for a chat model: answers each kind of prompt by a fixed rule, as JSON where JSON is asked for."""

    def __init__(self, kind: str):
        self.kind = kind

    def __call__(self, prompts: list[str]) -> list[str]:
        return [getattr(self, f"_{self.kind}")(p or "") for p in prompts]

    def _rewrite(self, p: str) -> str:
        words = p.split()
        half = max(1, len(words) // 2)
        return json.dumps({"queries": [" ".join(words[:half]), " ".join(words[half:])]})

    def _passage(self, p: str) -> str:
        return json.dumps({"queries": [f"{p} {p}"]})

    def _step_back(self, p: str) -> str:
        return json.dumps({"queries": [" ".join(sorted(p.split(), key=lambda w: (-len(w), w))[:5])]})

    def _blurb(self, p: str) -> str:
        return " ".join(p.split()[:8])

    def _answer(self, p: str) -> str:
        return NO_ANSWER if "[1]" not in p else p.split("[1] ", 1)[1].split("\n", 1)[0]

    def _yes_no(self, p: str) -> str:
        question, _, text = p.partition("\n---\n")
        a, b = set(_TOKEN.findall(question.lower())), set(_TOKEN.findall(text.lower()))
        return json.dumps({"yes": len(a & b) * 2 >= len(a) > 0})

    def _claim(self, p: str) -> str:
        share = OverlapScorer()([tuple(p.partition("\n---\n")[::2])])[0]
        verdict = "SUPPORTED" if share > 0.05 else "NOT_ENOUGH" if share < 0.01 else "REFUTED"
        return json.dumps({"verdict": verdict, "citation": "[1]" if verdict == "SUPPORTED" else ""})

    def _route(self, p: str) -> str:
        return json.dumps({"yes": len(p.split()) > 4})

    def _next(self, p: str) -> str:
        words = _TOKEN.findall(p.lower())
        return json.dumps({"have_enough": len(words) > 400, "next_query": " ".join(words[-6:])})

    def _triples(self, p: str) -> str:
        words = [w for w in _TOKEN.findall(p.lower()) if len(w) > 4][:9]
        return json.dumps({"triples": [{"subject": a, "relation": b, "object": c} for a, b, c in zip(words[::3], words[1::3], words[2::3], strict=False)]})


def attempt(provider: Callable, values: list, retries: int) -> tuple[list, list[str | None]]:
    """The provider's results and, where it failed ``retries`` times more, None and the error: for the batch, then for each value alone."""
    for _ in range(retries + 1):
        try:
            found = list(provider(values))
            if len(found) != len(values):
                raise ValueError(f"{len(found)} results for {len(values)} inputs")
            return found, [None] * len(found)
        except Exception as e:
            why = f"{type(e).__name__}: {e}"
    if len(values) == 1:
        return [None], [why]
    each = [attempt(provider, [v], retries) for v in values]
    return [r[0][0] for r in each], [r[1][0] for r in each]


def call(rows: DataFrame, provider: Callable, inputs: list[str], output: str, kind: str, retries: int | None = None, error: str = "_error") -> DataFrame:
    """``rows`` with the column ``output`` of type ``kind``, computed in batches from ``inputs``.

    With ``retries``, a call that fails is tried again, then value by value; rows that still fail have a null ``output`` and say
    why in the added column ``error``. Without, a failure ends the task, which Spark tries again.
    """
    types = {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    at = [rows.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in at]
            asked = columns[0] if len(columns) == 1 else list(zip(*columns, strict=True))
            if retries is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(provider(asked), types[kind])], names=[*batch.schema.names, output])
            elif asked:
                values, errors = attempt(provider, asked, retries)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, types[kind]), pa.array(errors, pa.string())], names=[*batch.schema.names, output, error])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{output}` {kind}" + (f", `{error}` string" if retries is not None else ""))


def _answered(keyed: DataFrame, made: DataFrame, store: KeyedStore | None, output: str) -> DataFrame:
    """``keyed`` (with _key) and what was made for each key, from the store if there is one; what failed is null and is not stored."""
    if store:
        store.append(made.where(F.col("value").isNotNull()))
        made = store.read()
    return keyed.join(made.select(F.col("key").alias("_key"), F.col("value").alias(output)), "_key", "left").drop("_key")


def _todo(keyed: DataFrame, store: KeyedStore | None, *columns: str) -> DataFrame:
    """key and ``columns`` of each distinct key that the store does not have."""
    distinct = keyed.groupBy(F.col("_key").alias("key")).agg(*[F.first(c).alias(c) for c in columns])
    return store.missing(distinct) if store else distinct


def embed(texts: DataFrame, text_col: str, provider: Callable, model: str = "hash", store: KeyedStore | None = None, prefix: str = "", retries: int | None = None) -> DataFrame:
    """``texts`` with a column v. Each distinct text (with its prefix, which is part of the key) is embedded once; known keys come from the store.

    With ``retries``, texts that cannot be embedded have a null v and are asked for again next time.
    """
    keyed = texts.withColumn("_t", F.concat(F.lit(prefix), F.coalesce(F.col(text_col), F.lit("")))).withColumn("_key", content_key(model, F.col("_t")))
    made = call(_todo(keyed, store, "_t"), provider, ["_t"], "value", "array<double>", retries)
    return _answered(keyed.drop("_t"), made.select("key", "value"), store, "v")


def generate(rows: DataFrame, prompt: Column, provider: Generator, output: str = "reply", model: str = "rule", store: KeyedStore | None = None, retries: int | None = None) -> DataFrame:
    """``rows`` with the model's reply to ``prompt``; each distinct prompt is sent once, known ones are read from the store.

    With ``retries``, prompts that get no reply have a null one, which every operator here reads as its default.
    """
    keyed = rows.withColumn("_p", prompt).withColumn("_key", content_key(model, F.col("_p")))
    made = call(_todo(keyed, store, "_p"), provider, ["_p"], "value", "string", retries)
    return _answered(keyed.drop("_p"), made.select("key", "value"), store, output)


def rewrites(queries: DataFrame, provider: Generator, least: int = 1, retries: int | None = None) -> DataFrame:
    """(qid, variant, question): the model's rewrites, blanks left out; a query with fewer than ``least``, or whose call failed, keeps its own text."""
    replied = generate(queries, F.col("question"), provider, retries=retries)
    found = F.filter(F.coalesce(F.from_json("reply", "queries array<string>")["queries"], F.array().cast("array<string>")), lambda q: F.trim(q) != "")
    rows = replied.withColumn("_q", F.when(F.size(found) >= least, found).otherwise(F.array("question")))
    return rows.select("qid", F.posexplode("_q").alias("variant", "question")).withColumn("variant", F.col("variant").cast("bigint"))


def contextualize(chunks: DataFrame, documents: DataFrame, provider: Generator, limit: int = 6000) -> DataFrame:
    """Chunks (doc_id, chunk) with a blurb from their document put before, a blank line between; an empty blurb changes nothing."""
    rows = chunks.join(documents.select("doc_id", F.substring("text", 1, limit).alias("_d")), "doc_id", "left").withColumn("_d", F.coalesce("_d", "chunk"))
    replied = generate(rows, F.concat("_d", F.lit("\n---\n"), "chunk"), provider, "blurb").drop("_d")
    return replied.withColumn("chunk", F.when(F.trim("blurb") == "", F.col("chunk")).otherwise(F.concat("blurb", F.lit("\n\n"), "chunk")))


def answer(questions: DataFrame, contexts: DataFrame, provider: Generator) -> DataFrame:
    """(qid, question, context, answer, abstained) from the ranked texts (qid, rank, text) of each question."""
    grouped = contexts.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("xs"))
    rows = questions.join(grouped, "qid", "left").withColumn("context", F.coalesce(numbered_context(F.col("xs")["text"]), F.lit(""))).drop("xs")
    return generate(rows, F.concat("question", F.lit("\n\n"), "context"), provider, "answer").withColumn("abstained", F.contains("answer", F.lit(NO_ANSWER)))


def judge(rows: DataFrame, question: str, text: str, provider: Generator, limit: int | None = 1500) -> DataFrame:
    """``rows`` with a boolean ``relevant``: the model's yes or no on the pair, of whose text it sees ``limit`` characters or all; no where the reply cannot be read."""
    seen = F.col(text) if limit is None else F.substring(text, 1, limit)
    replied = generate(rows, F.concat(F.col(question), F.lit("\n---\n"), seen), provider)
    return replied.withColumn("relevant", F.coalesce(F.from_json("reply", "yes boolean")["yes"], F.lit(False))).drop("reply")


def verify_claims(rows: DataFrame, provider: Generator) -> DataFrame:
    """(condition, n, supported, refuted, not_enough, cited) from (condition, claim, evidence)."""
    replied = generate(rows, F.concat("claim", F.lit("\n---\n"), "evidence"), provider)
    read = replied.withColumn("r", F.from_json("reply", "verdict string, citation string"))
    verdict = F.coalesce(F.col("r.verdict"), F.lit("NOT_ENOUGH"))
    return read.groupBy("condition").agg(
        F.count("*").alias("n"),
        *[F.count(F.when(verdict == v, 1)).alias(v.lower()) for v in ("SUPPORTED", "REFUTED", "NOT_ENOUGH")],
        F.count(F.when(F.trim(F.coalesce(F.col("r.citation"), F.lit(""))) != "", 1)).alias("cited"),
    )


def rerank(candidates: DataFrame, scorer: Callable, question: str = "question", text: str = "text", store: KeyedStore | None = None) -> DataFrame:
    """Candidates (qid, id, ..) with the scorer's ``score`` of each pair; pairs met before come from the store."""
    keyed = candidates.withColumn("_key", F.substring(F.sha2(F.concat(F.col(question), F.lit("\0"), F.col(text)), 256), 1, 32))
    made = call(_todo(keyed, store, question, text), scorer, [question, text], "value", "double").select("key", "value")
    return _answered(keyed, made, store, "_value").withColumn("score", F.round("_value", 6)).drop("_value")


def yes_probability(no: Column, yes: Column) -> Column:
    """Softmax of two logits, the probability of yes."""
    top = F.greatest(no, yes)
    return F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))
