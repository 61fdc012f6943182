"""BM25 over tokenised documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import STOPWORDS, tokenize
from tessel.sources.io import cut

K1, B = 1.2, 0.75
#: Query terms that are broadcast to the scan of the documents at most; more are joined by shuffle.
BROADCAST_TERMS = 1_000_000
#: Queries, and terms of queries, that one pass over the postings holds; more are taken in blocks.
QUERY_BLOCK, TERM_BLOCK = 4096, 2_000_000
#: Bytes of a-z and 0-9.
_TOKEN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
#: Scores, and matches of terms, that a task holds at once, a single document's aside.
SCORES, MATCHES = 1 << 20, 1 << 21
#: Short phrases that are broadcast at once, bytes of long ones, and of what they are found by.
PHRASE_BLOCK, PHRASE_BYTES, _ANCHOR = 4096, 1 << 26, 8


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf), lengths (id, dl), terms (term, df, idf), corpus (n, avgdl; one row)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("tokens"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The whole index. Documents without tokens count in n and in the mean length."""
    tokens = _tokens(docs, id_col, text_col)
    postings = tokens.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    lengths = tokens.select("id", F.size("tokens").cast("bigint").alias("dl"))
    corpus = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", _idf().alias("idf"))  # one row
    return Index(postings, lengths, terms, corpus)


def _idf():
    n, df = F.col("n").cast("double"), F.col("df").cast("double")
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def matches(queries: DataFrame, docs: DataFrame, qid_col: str = "qid", query_col: str = "question", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """qid, id, tf, times (of the term in the query), dl, df, n, avgdl for each matching query term of each document.

    Only terms of the queries leave the scan. Terms in a query more than once count as often.
    """
    asked = queries.select(F.col(qid_col).alias("qid"), F.explode(tokenize(F.col(query_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    few = wanted.count() <= BROADCAST_TERMS
    if few:
        wanted, asked = F.broadcast(wanted), F.broadcast(asked)
    tokens = _tokens(docs, id_col, text_col).withColumn("dl", F.size("tokens").cast("bigint"))
    corpus = tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = tokens.select("id", "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    tf = found.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(F.broadcast(df) if few else df, "term").join(asked, "term").crossJoin(F.broadcast(corpus))  # one row


def score(matched: DataFrame, k1=K1, b=B) -> DataFrame:
    """qid, id, score (6 places) from :func:`matches`; ``k1`` and ``b`` may be columns."""
    k1, b = (x if hasattr(x, "cast") else F.lit(float(x)) for x in (k1, b))
    norm = F.lit(1.0) - b + b * F.col("dl") / F.col("avgdl")
    gain = F.col("times") * _idf() * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    keys = [c for c in ("param", "qid", "id") if c in matched.columns]
    return matched.groupBy(*keys).agg(F.round(F.sum(gain), 6).alias("score"))


def top(scored: DataFrame, k: int, keys: tuple[str, ...] = ("qid",), id_col: str = "id") -> DataFrame:
    """The best ``k`` rows for each key with rank, equal scores by id. The limit is applied before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def search(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = K1, b: float = B, **columns: str) -> DataFrame:
    """qid, id, score, rank of the best ``k`` documents of each query; documents without a matching term are absent."""
    return search_all(queries, docs, k, [(k1, b)], **columns).drop("setting")


def search_all(queries: DataFrame, docs: DataFrame, k: int, settings: list[tuple[float, float]], qid_col: str = "qid", query_col: str = "question", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """setting (place in ``settings`` of k1 and b), qid, id, score, rank: what :func:`search` finds with each of them.

    The texts are read once, for :func:`_postings`. Whole documents are scored against a block of queries within their task,
    which keeps the best ``k`` for each setting and query, so what is shuffled grows with tasks and queries and never with matches.
    """
    asked = queries.select(F.col(qid_col).alias("qid"), F.explode(tokenize(F.col(query_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    asked = cut(asked)
    pairs, terms, n_queries = asked.agg(F.count("*"), F.countDistinct("term"), F.countDistinct("qid")).first()
    if terms > BROADCAST_TERMS:
        matched = cut(matches(queries, docs, qid_col, query_col, id_col, text_col))
        return _united([top(score(matched, *x), k).select(F.lit(i).cast("bigint").alias("setting"), "qid", "id", "score", "rank") for i, x in enumerate(settings)])
    blocks = max(1, -(-n_queries // QUERY_BLOCK), -(-pairs // TERM_BLOCK))
    names = asked.select("term").distinct().orderBy("term").toArrow().column(0).to_pylist()
    found = _postings(docs, names, id_col, text_col)
    n, mean = found.agg(F.count("*"), F.avg("dl")).first()
    found = _by_document(found)
    held = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(names))
    df[held.column("t").to_numpy()] = held.column("df").to_numpy()
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else asked
        parts.append(_best(found, own, names, idf, mean, k, settings))
    return top(_united(parts), k, ("setting", "qid")).select("setting", "qid", "id", "score", "rank")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _postings(docs: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, dl, terms (places in ``names``), tfs, dls (the length again, for each term): a row for each document, written once."""
    sent = docs.sparkSession.sparkContext.broadcast(pa.array([*STOPWORDS, *names], pa.string()))
    many = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for a, z in pieces(batch.column(1)):
                tokens, row = _runs(batch.column(1).slice(a, z - a))
                place = pc.index_in(tokens, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                weighty = (place < 0) | (place >= len(STOPWORDS))
                lengths = np.bincount(row[weighty], minlength=z - a)
                wanted = place >= len(STOPWORDS)
                key, tfs = np.unique(row[wanted] * many + place[wanted] - len(STOPWORDS), return_counts=True)
                own = key // max(1, many)
                ends = pa.array(np.searchsorted(own, np.arange(z - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % max(1, many), tfs, lengths[own])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(lengths, pa.int64()), *lists], names=["id", "dl", "terms", "tfs", "dls"])

    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return cut(texts.mapInArrow(run, f"id {kind}, dl bigint, terms array<int>, tfs array<int>, dls array<int>"))


def pieces(texts: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Where to cut ``texts`` into slices of about ``size`` bytes, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, z
        a = z


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``texts``, none null, in a row, and where each begins, the end last."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    starts = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[starts[0] : starts[-1]], starts - starts[0]


def _runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of a-z and 0-9 of all ``texts``, and the text of each."""
    data, starts = _bytes(texts)
    held = _TOKEN[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    first = starts[:-1][starts[:-1] < len(data)]
    begins[first] = held[first]
    at = np.flatnonzero(begins[held])
    ends = np.append(at, np.count_nonzero(held)).astype(np.int32)
    row = np.searchsorted(starts, np.flatnonzero(begins), "right") - 1
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data[held])), row


def _by_document(found: DataFrame) -> DataFrame:
    """id, terms, tfs, dls of the documents with a term. Rows of one id are one document; those of one length too count as one text."""
    some = found.where(F.size("terms") > 0).select("id", "dl", "terms", "tfs", "dls")
    again = cut(some.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again")))
    if again.isEmpty():
        return some.drop("dl")
    same = F.col("id").eqNullSafe(F.col("again"))
    each = some.join(again, same, "left_semi").select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    each = each.groupBy("id", "dl", F.col("x.terms").alias("t")).agg(F.sum("x.tfs").cast("int").alias("tf"))
    lists = each.groupBy("id").agg(F.collect_list(F.struct("t", "tf", F.col("dl").cast("int").alias("dl"))).alias("x"))  # an id's terms of queries
    merged = lists.select("id", F.col("x.t").alias("terms"), F.col("x.tf").alias("tfs"), F.col("x.dl").alias("dls"))
    return cut(some.join(again, same, "left_anti").drop("dl").unionByName(merged))


def _best(found: DataFrame, asked: DataFrame, names: list[str], idf: np.ndarray, mean: float, k: int, settings: list[tuple[float, float]]) -> DataFrame:
    """setting, qid, id, score: each task's best ``k`` of ``found`` for each setting and query of ``asked`` (qid, term, times)."""
    spark, rows = found.sparkSession, asked.toArrow()
    coded = pc.dictionary_encode(rows.column("qid").combine_chunks(), null_encoding="encode")
    at = {t: i for i, t in enumerate(names)}
    term = np.array([at[t] for t in rows.column("term").to_pylist()], np.int64)
    order = np.argsort(term, kind="stable")
    fan = np.bincount(term, minlength=len(names))
    first = np.cumsum(fan) - fan
    query, times = coded.indices.to_numpy()[order].astype(np.int64), rows.column("times").to_numpy()[order].astype(float)
    sent = spark.sparkContext.broadcast((coded.dictionary, query, times, fan, first, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, query, times, fan, first, idf = sent.value
        plain = bool((times == 1).all())
        many = len(qids)
        held = [Best(k, many) for _ in settings]
        for batch in batches if many else ():
            flat = [batch.column(i).flatten().to_numpy() for i in (1, 2, 3)]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())])
            work = np.concatenate([[0], np.cumsum(fan[flat[0]])])[ends]
            a = 0
            while a < batch.num_rows:
                z = min(a + max(1, SCORES // many), int(np.searchsorted(work, work[a] + MATCHES, "right")) - 1, batch.num_rows)
                z = max(z, a + 1)
                terms, tf, dl = (x[ends[a] : ends[z]] for x in flat)
                n = fan[terms]
                posting = np.repeat(np.arange(len(terms)), n)
                pair = np.arange(len(posting)) + np.repeat(first[terms] - (np.cumsum(n) - n), n)
                row = np.repeat(np.arange(z - a), np.diff(ends[a : z + 1]))
                key = row[posting] * many + query[pair]
                hit = np.bincount(key, minlength=(z - a) * many) > 0
                for kept, (k1, b) in zip(held, settings, strict=True):
                    gain = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
                    scores = np.bincount(key, gain[posting] if plain else times[pair] * gain[posting], (z - a) * many)
                    kept.add(np.where(hit, np.round(scores, 6), -np.inf).reshape(z - a, many), batch.column(0).slice(a, z - a))
                a = z
        for i, kept in enumerate(held):
            best = kept.rows()
            for piece in best.to_batches(max_chunksize=65536) if best is not None else ():
                own = [pa.array(np.full(piece.num_rows, i)), qids.take(piece.column("q")), piece.column("id"), piece.column("score")]
                yield pa.RecordBatch.from_arrays(own, names=["setting", "qid", "id", "score"])

    qid_kind, id_kind = (x.dataType.simpleString() for x in (asked.schema["qid"], found.schema["id"]))
    return found.select("id", "terms", "tfs", "dls").mapInArrow(run, f"setting bigint, qid {qid_kind}, id {id_kind}, score double")


class Best:
    """The best ``k`` rows of each query so far; equal scores by id."""

    def __init__(self, k: int, many: int):
        self.k, self.many, self.parts, self.size = k, many, [], 0
        self.floor = np.full(many, -np.inf)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores`` of documents by queries; what cannot be among the best is left out, equals of the last stay until they are sorted."""
        least = self.floor
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        i, q = np.nonzero((scores >= least) & np.isfinite(scores))
        if len(i):
            self.parts.append(pa.table({"q": q, "id": ids.take(pa.array(i)), "score": scores[i, q]}))
            self.size += len(i)
        if self.size > 2 * self.k * self.many + SCORES // 4:
            self.rows()

    def rows(self) -> pa.Table | None:
        if not self.parts:
            return None
        every = pa.concat_tables(self.parts).combine_chunks()
        every = every.take(pc.sort_indices(every, [("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        q = every.column("q").to_numpy()
        sizes = np.bincount(q, minlength=self.many)
        place = np.arange(len(q)) - (np.cumsum(sizes) - sizes)[q]
        every = every.filter(pa.array(place < self.k))
        last = pa.array(np.flatnonzero(place[place < self.k] == self.k - 1))
        full = every.take(last)
        self.floor[full.column("q").to_numpy()] = full.column("score").to_numpy()
        self.parts, self.size = [every], every.num_rows
        return every


def containing(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """``phrases`` (qid, phrase, ..) joined with the documents (id, text) whose text contains the phrase.

    Blocks of phrases go to one scan of the texts each. Eight bytes of a phrase, those that repeat a byte least, find its
    places, where the rest is compared. Phrases of fewer bytes are searched for in every text, in blocks that are broadcast.
    Documents without an id are in no result.
    """
    names = [*phrases.columns, *docs.columns]
    docs = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    keyed = cut(phrases.where(F.col("phrase").isNotNull()))
    long = F.octet_length("phrase") >= _ANCHOR
    n, size, n_short = keyed.agg(F.count(F.when(long, 1)), F.sum(F.when(long, F.octet_length("phrase"))), F.count(F.when(~long, 1))).first()
    dealt = F.xxhash64("phrase")
    parts = []
    blocks = max(-(-n // BROADCAST_TERMS), -(-(size or 0) // PHRASE_BYTES))
    for i in range(blocks):
        parts.append(_held_by(docs, keyed.where(long & (F.pmod(dealt, F.lit(blocks)) == i)), names))
    blocks = max(not parts, -(-n_short // PHRASE_BLOCK))
    for i in range(blocks):
        own = keyed.where(~long & (F.pmod(dealt, F.lit(blocks)) == i))
        parts.append(docs.join(F.broadcast(own), F.contains("text", F.col("phrase"))).select(*names))
    return _united(parts)


def _held_by(docs: DataFrame, phrases: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``docs`` with each row of ``phrases`` (of eight bytes or more) whose phrase the text contains, as ``names``."""
    rows = phrases.toArrow().combine_chunks()
    wanted = [x.encode() for x in rows.column("phrase").to_pylist()]
    at = np.array([_anchor(x) for x in wanted], np.int64)
    anchors = np.array([_windows(np.frombuffer(x, np.uint8)[i : i + _ANCHOR])[0] for x, i in zip(wanted, at, strict=True)], np.uint64)
    order = np.argsort(anchors, kind="stable")
    bits = int(min(26, max(16, np.ceil(np.log2(64 * max(1, len(wanted)))))))
    own = docs.select("id", "text", *[c for c in docs.columns if c not in ("id", "text")])
    kinds = {f.name: f.dataType.simpleString() for f in [*docs.schema, *phrases.schema]}
    sent = docs.sparkSession.sparkContext.broadcast((rows, wanted, at, anchors[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, wanted, at, anchors, order = sent.value
        table = np.zeros(1 << bits, bool)
        table[_slot(anchors, bits)] = True
        for batch in batches:
            for a, z in pieces(batch.column(1)):
                data, starts = _bytes(batch.column(1).slice(a, z - a))
                if len(data) < _ANCHOR:
                    continue
                seen = _windows(data)
                place = np.flatnonzero(table[_slot(seen, bits)])
                low, high = (np.searchsorted(anchors, seen[place], side) for side in ("left", "right"))
                row = np.searchsorted(starts, place, "right") - 1
                raw = data.tobytes()
                found = set()
                for i, lo, hi, j in zip(*(x[low < high].tolist() for x in (place, low, high, row)), strict=True):
                    for p in order[lo:hi].tolist():
                        begin = i - int(at[p])
                        if (j, p) not in found and begin >= starts[j] and begin + len(wanted[p]) <= starts[j + 1] and raw.startswith(wanted[p], begin):
                            found.add((j, p))
                pairs = sorted(found)
                for b in range(0, len(pairs), 1024):
                    j, p = (pa.array(x, pa.int64()) for x in zip(*pairs[b : b + 1024], strict=True))
                    made = {c: batch.column(i).slice(a, z - a).take(j) for i, c in enumerate(batch.schema.names)} | {c: rows.column(c).take(p) for c in rows.column_names}
                    yield from pa.table(made).select(names).combine_chunks().to_batches()

    return own.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _windows(data: np.ndarray) -> np.ndarray:
    """Each eight bytes in a row as a number."""
    out = np.zeros(len(data) - _ANCHOR + 1, np.uint64)
    for i in range(_ANCHOR):
        out |= data[i : len(data) - _ANCHOR + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _slot(windows: np.ndarray, bits: int) -> np.ndarray:
    return (windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _anchor(phrase: bytes) -> int:
    """Where the eight bytes of ``phrase`` begin that hold the most distinct ones, the first of equals."""
    return max(range(len(phrase) - _ANCHOR + 1), key=lambda i: len(set(phrase[i : i + _ANCHOR])))
