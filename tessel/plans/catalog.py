"""Registered queries and their DuckDB oracles.

Names are those of the operators. The corpus is ``documents``, the queries are the passages of ``benchmark``, and a
document is relevant to a passage that it holds (grade 2) or whose middle it holds (grade 1). Scores are rounded before
they are ranked or compared, and equal scores rank by id, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import adaptive, chunking, dense, evaluate, fusion, graph, lexical, providers, stats
from tessel.sources import io
from tessel.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The two rankings that fusion, evaluation and statistics work on, by BM25's k1 and b.
RUNS = {"first": (1.2, 0.75), "second": (0.4, 0.1)}
DEPTH = 100
#: Depth of the second reranking and of the rank correlation.
RERANK_DEPTH = 50
RESAMPLES = stats.RESAMPLES


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# -- shared frames and their SQL ---------------------------------------------------------------------------------------


def docs(s: SparkSession, d: str) -> DataFrame:
    return io.table(s, d, "documents")


def asked(s: SparkSession, d: str) -> DataFrame:
    return io.table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def qrels(s: SparkSession, d: str) -> DataFrame:
    """qid, id, grade by containment of the passages, a stated query set, in every document."""
    passages = asked(s, d).select("qid", "question", F.expr("substr(question, 21, 60)").alias("phrase"))
    held = lexical.containing(passages, docs(s, d).select(F.col("doc_id").alias("id"), "text"))
    return held.select("qid", "id", F.when(F.contains("text", F.col("question")), 2).otherwise(1).alias("grade"))


def ranking(s: SparkSession, d: str, run: str = "first", k: int = DEPTH) -> DataFrame:
    k1, b = RUNS[run]
    return lexical.search(asked(s, d), docs(s, d), k, k1, b)


def runs(s: SparkSession, d: str, k: int = DEPTH) -> DataFrame:
    both = lexical.search_all(asked(s, d), docs(s, d), k, list(RUNS.values()))
    name = F.element_at(F.array(*map(F.lit, RUNS)), (F.col("setting") + 1).cast("int"))
    return both.select("qid", "id", "score", "rank", name.alias("run"))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return io.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("bigint").alias("label"))


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches over vectors: every id that 50 divides."""
    return vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "v", "label")


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def sql_tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), lambda t: not list_contains({STOP}, t))"


def sql_words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '\\s+'), lambda w: w <> '')"


BM25_SQL = f"""toks as materialized (select doc_id as id, {sql_tokens("text")} as tokens from documents),
lens as (select id, len(tokens) as dl from toks),
corp as (select count(*)::double as n, avg(dl) as avgdl from lens),
tf as materialized (select id, term, count(*) as tf from (select id, unnest(tokens) as term from toks) group by all),
df as (select term, count(*)::double as df from tf group by term),
ask as (select qid, term, count(*) as times from (select item_id as qid, unnest({sql_tokens("text")}) as term from benchmark) group by all),
hit as materialized (select qid, id, tf, times, dl, df, n, avgdl from ask join tf using (term) join df using (term) join lens using (id), corp)"""


def sql_scores(k1: float | str, b: float | str, source: str = "hit", keys: str = "qid, id") -> str:
    return f"select {keys}, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) as score from {source} group by {keys}"


def sql_top(scored: str, k: int, keys: str = "qid", extra: str = "") -> str:
    return f"select * from (select *{extra}, row_number() over (partition by {keys} order by score desc, id) as rank from ({scored})) where rank <= {k}"


QRELS_SQL = """qrels as materialized (select item_id as qid, doc_id as id, case when contains(d.text, b.text) then 2 else 1 end as grade
  from documents d, benchmark b where contains(d.text, substr(b.text, 21, 60)))"""
RUNS_SQL = BM25_SQL + ",\nruns as materialized (" + " union all ".join(f"select '{r}' as run, qid, id, score, rank from ({sql_top(sql_scores(*RUNS[r]), DEPTH)})" for r in RUNS) + ")"
FIRST_SQL = BM25_SQL + f",\nfirst as materialized ({sql_top(sql_scores(*RUNS['first']), DEPTH)})"


def sql_metrics(source: str, queries_sql: str, keys: str = "qid", membership: bool = False) -> str:
    """CTE body: recall_1, 3, 5, 10, mrr and ndcg_10 for each query and the other ``keys``."""
    rel = "q.grade is not null" if membership else "coalesce(q.grade, 0) > 0"
    cond = "true" if membership else "grade > 0"
    hits = ", ".join(f"count(*) filter (where {rel} and rank <= {k}) as h{k}" for k in (1, 3, 5, 10))
    using = ", ".join(f"a.{x.strip()}" for x in keys.split(","))
    on = " and ".join(f"a.{x.strip()} = f.{x.strip()}" for x in keys.split(","))
    return f"""select {using},
  {", ".join(f"round(coalesce(h{k} / nullif(n_rel, 0)::double, 0), 6) as recall_{k}" for k in (1, 3, 5, 10))},
  round(coalesce(1.0 / first_hit, 0), 6) as mrr, round(coalesce(dcg / nullif(ideal, 0), 0), 6) as ndcg_10
from ({queries_sql}) a
left join (select {", ".join("r." + x.strip() for x in keys.split(","))}, {hits}, min(rank) filter (where {rel}) as first_hit, sum(coalesce(q.grade, 0) / log2(rank + 1)) filter (where rank <= 10) as dcg
  from (select * from {source} where rank <= 10) r left join qrels q on r.qid = q.qid and r.id = q.id group by {", ".join("r." + x.strip() for x in keys.split(","))}) f on {on}
left join (select qid, count(*) as n_rel from qrels where {cond} group by qid) c on a.qid = c.qid
left join (select qid, sum(grade / log2(r + 1)) as ideal from (select qid, grade, row_number() over (partition by qid order by grade desc, id) as r from qrels) where r <= 10 group by qid) i on a.qid = i.qid"""


JUDGED_SQL = "select distinct qid from qrels"
#: Half of the queries are for training, by a hash of their id.
TRAIN_SQL = "md5(qid::varchar) < '8'"


def for_training() -> Column:
    return F.md5(F.col("qid").cast("string")) < "8"


SCORES_SQL = f"with {RUNS_SQL}, {QRELS_SQL}, scores as materialized ({sql_metrics('runs', f'select run, qid from ({JUDGED_SQL}), (select distinct run from runs)', 'run, qid')})"


def judged(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries with a judgement, and the judgements, written once."""
    rel = io.cut(qrels(s, d))
    return asked(s, d).join(rel.select("qid").distinct(), "qid", "left_semi"), rel


def run_scores(s: SparkSession, d: str) -> DataFrame:
    """run, qid and every metric of both runs over the judged queries."""
    queries, rel = judged(s, d)
    every = io.cut(runs(s, d))
    out = None
    for r in RUNS:
        one = evaluate.per_query(queries, every.where(F.col("run") == r), rel).withColumn("run", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


# -- sources and sinks -------------------------------------------------------------------------------------------------


@query("src_corpus_jsonl", "select cast(doc_id as varchar) as id, case when trim(source) <> '' then trim(source) || '. ' else '' end || trim(text) as text, trim(source) as title from documents")
def src_corpus_jsonl(s: SparkSession, d: str) -> DataFrame:
    path = io.scratch_dir(s)
    docs(s, d).select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text").write.json(path)
    return io.corpus_jsonl(s, path).select("id", "text", "title")


@query("src_queries_jsonl", "select cast(item_id as varchar) as qid, text as question from benchmark")
def src_queries_jsonl(s: SparkSession, d: str) -> DataFrame:
    path = io.scratch_dir(s)
    asked(s, d).select(F.col("qid").cast("string").alias("_id"), F.col("question").alias("text")).write.json(path)
    return io.queries_jsonl(s, path)


@query("src_qrels_tsv", f"with {QRELS_SQL} select cast(qid as varchar) as qid, cast(id as varchar) as id, grade - 1 as grade from qrels where grade > 1")
def src_qrels_tsv(s: SparkSession, d: str) -> DataFrame:
    path = io.scratch_dir(s)
    rows = qrels(s, d).select(F.col("qid").alias("query-id"), F.col("id").alias("corpus-id"), (F.col("grade") - 1).alias("score"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return io.qrels_tsv(s, path)


@query("load_queries", f"with {QRELS_SQL} select item_id as qid, text as question from benchmark where item_id in (select qid from qrels)")
def load_queries(s: SparkSession, d: str) -> DataFrame:
    return io.judged_queries(asked(s, d), qrels(s, d))


@query("src_evalset", "select cast(item_id as varchar) || ':' || v as qid, v as variant, case v when 'direct' then text else reverse(text) end as question, cast(item_id as varchar) as id, 1 as grade from benchmark, (select unnest(['direct', 'paraphrased']) as v) where text <> ''")
def src_evalset(s: SparkSession, d: str) -> DataFrame:
    path = io.scratch_dir(s)
    facts = asked(s, d).select(F.col("qid").cast("string").alias("k"), F.struct(F.col("question").alias("direct"), F.reverse("question").alias("paraphrased")).alias("v"))
    facts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v"))))).coalesce(1).write.text(path)  # one small file of questions
    return io.evaluation_set(s, path)


@query("src_lines", "select (row_number() over (order by item_id, i) - 1)::varchar as id, trim(xs[i]) as text from (select item_id, string_split(text, chr(10)) as xs from benchmark), unnest(generate_series(1, len(xs))) as g(i) where trim(xs[i]) <> ''")
def src_lines(s: SparkSession, d: str) -> DataFrame:
    path = io.scratch_dir(s)
    asked(s, d).orderBy("qid").coalesce(1).select(F.col("question")).write.text(path)
    return io.lines(s, path)


@query("src_lines_raw", "select (row_number() over (order by item_id, i) - 1)::varchar as id, xs[i] as text from (select item_id, string_split(text, chr(10)) as xs from benchmark), unnest(generate_series(1, len(xs))) as g(i)")
def src_lines_raw(s: SparkSession, d: str) -> DataFrame:
    path = io.scratch_dir(s)
    asked(s, d).orderBy("qid").coalesce(1).select(F.col("question")).write.text(path)
    return io.lines(s, path, raw=True)


@query("src_parquet", "select source, count(*) as n, sum(n_chars)::bigint as chars from documents group by source")
def src_parquet(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "sink_scores",
    f"{SCORES_SQL}, best as (select run, qid, string_agg(id::varchar, ',' order by rank) as top10 from runs where rank <= 10 group by run, qid) "
    f"select 'm' as model, s.run as stage, 'bm25' || case when {TRAIN_SQL.replace('qid', 's.qid')} then ' [train]' else '' end as config, s.qid, ndcg_10, case when {TRAIN_SQL.replace('qid', 's.qid')} then null else top10 end as top10 from scores s left join best b on s.run = b.run and s.qid = b.qid",
)
def sink_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores by model and stage. Training queries have configs of their own; only test queries keep their best ten."""
    path = io.scratch_dir(s)
    queries, rel = judged(s, d)
    every = io.cut(runs(s, d))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    best = every.where("rank <= 10").groupBy("run", "qid").agg(F.array_join(ranked, ",").alias("top10"))
    parts = [evaluate.per_query(queries, every.where(F.col("run") == r), rel).withColumn("run", F.lit(r)) for r in RUNS]
    rows = parts[0].unionByName(parts[1]).join(best, ["run", "qid"], "left")
    config = F.when(for_training(), F.concat(F.lit("bm25"), F.lit(stats.TRAIN))).otherwise("bm25")
    rows = io.cut(rows.select(F.lit("m").alias("model"), F.col("run").alias("stage"), config.alias("config"), "qid", "ndcg_10", F.when(~for_training(), F.col("top10")).alias("top10")))
    io.write_scores(rows, path)
    io.write_scores(rows.where("stage = 'first'"), path)  # replaces its own partition only
    return s.read.parquet(path).select(F.col("model").cast("string"), F.col("stage").cast("string"), "config", "qid", "ndcg_10", "top10")


@query("sink_results_json", f"{SCORES_SQL} select run, round(avg(ndcg_10), 6) as ndcg_10, round(avg(mrr), 6) as mrr from scores group by run")
def sink_results_json(s: SparkSession, d: str) -> DataFrame:
    path = io.scratch_dir(s)
    io.write_results_json(run_scores(s, d).groupBy("run").agg(F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("mrr"), 6).alias("mrr")), path)
    return s.read.schema("run string, ndcg_10 double, mrr double").json(path)


@query("sink_report_md")
def sink_report_md(s: SparkSession, d: str) -> DataFrame:
    text = io.report_markdown(stage_comparisons(s, d), "lexical")
    return s.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "ord bigint, line string")


@query("model_filter", "select vec_id % 3 as model, count(*) as n from embeddings where vec_id % 3 in (0, 2) group by 1")
def model_filter(s: SparkSession, d: str) -> DataFrame:
    """An index of several models, a folder for each; only the folders asked for are read."""
    path = io.scratch_dir(s)
    vectors(s, d).withColumn("model", F.col("id") % 3).write.partitionBy("model").parquet(path)
    stored = s.read.schema("id bigint, v array<float>, label bigint, model bigint").parquet(path)
    return stored.where(F.col("model").isin(0, 2)).groupBy("model").agg(F.count("*").alias("n"))


@query("cache_npz", "select count(*) as entries, count(distinct text) as texts from (select distinct text from documents)")
def cache_npz(s: SparkSession, d: str) -> DataFrame:
    store = io.KeyedStore(s, io.scratch_dir(s), "array<double>")
    for _ in range(2):  # the second pass finds every key
        providers.embed(docs(s, d), "text", providers.HashEmbedder(8), store=store).count()
    kept = store.read().agg(F.count("*").alias("entries"))
    return kept.crossJoin(docs(s, d).agg(F.countDistinct("text").alias("texts")))  # one row each


@query("checkpoint", "select 'k' || item_id as key, text as value from benchmark")
def checkpoint(s: SparkSession, d: str) -> DataFrame:
    store = io.KeyedStore(s, io.scratch_dir(s))
    work = asked(s, d).select(F.concat(F.lit("k"), F.col("qid").cast("string")).alias("key"), F.col("question").alias("value"))
    store.append(work.where(F.col("value").like("%a%")))
    store.append(store.missing(work))
    return store.read()


@query("graph_persist")
def graph_persist(s: SparkSession, d: str) -> DataFrame:
    """Triples, communities and their summaries, each written and read back."""
    kept = io.cut(triples(s, d))
    members = io.cut(regions(s, d))
    facts = graph.community_facts(kept.withColumn("ord", F.col("doc_id")), members)
    told = io.cut(graph.community_summaries(facts, members, providers.RuleGenerator("blurb")))
    return kept.agg(F.count("*").alias("triples")).crossJoin(members.agg(F.count("*").alias("members"))).crossJoin(told.agg(F.count("*").alias("summaries")))  # one row each


@query("token_index_persist", "select vec_id as id, 8::bigint as tokens, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total from embeddings")
def token_index_persist(s: SparkSession, d: str) -> DataFrame:
    kept = io.cut(vectors(s, d).select("id", dense.token_vectors(F.col("v"), 8).alias("tokens")))
    return kept.select("id", F.size("tokens").cast("bigint").alias("tokens"), F.round(F.aggregate(F.flatten("tokens"), F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


# -- text functions ----------------------------------------------------------------------------------------------------


@query("tokenize", f"select doc_id, len(t)::bigint as n, md5(array_to_string(t, ' ')) as digest from (select doc_id, {sql_tokens('text')} as t from documents)")
def tokenize(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("words", f"select doc_id, len(w)::bigint as n, md5(array_to_string(w, ' ')) as digest from (select doc_id, {sql_words('text')} as w from documents)")
def words(s: SparkSession, d: str) -> DataFrame:
    w = docs(s, d).select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


SENTENCES_SQL = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')"


@query("sentences", f"select doc_id, len(x)::bigint as n, md5(array_to_string(x, '|')) as digest from (select doc_id, {SENTENCES_SQL} as x from documents)")
def sentences(s: SparkSession, d: str) -> DataFrame:
    x = docs(s, d).select("doc_id", T.sentences(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("bigint").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


@query("token_estimate", f"select doc_id, round(len({sql_words('text')}) * 1.3::double, 6) as tokens, len({sql_words('text')}) * 1.3::double > 512 as over from documents")
def token_estimate(s: SparkSession, d: str) -> DataFrame:
    tokens = T.estimated_tokens(F.size(T.words(F.col("text"))))
    return docs(s, d).select("doc_id", F.round(tokens, 6).alias("tokens"), (tokens > T.WINDOW_TOKENS).alias("over"))


@query("query_format", "select item_id as qid, 'Represent this: ' || text as formatted from benchmark")
def query_format(s: SparkSession, d: str) -> DataFrame:
    return asked(s, d).select("qid", T.format_query("Represent this: {q}", F.col("question")).alias("formatted"))


@query("doc_format", "select doc_id, 'title: ' || case when doc_id % 7 = 0 then 'none' else source end || ' text: ' || text as formatted from documents")
def doc_format(s: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("source"))
    return docs(s, d).select("doc_id", T.format_document("title: {title} text: {text}", title, F.col("text")).alias("formatted"))


@query("strip_title", "select doc_id, case when doc_id % 2 = 0 then 'none' else '' end as title from documents")
def strip_title(s: SparkSession, d: str) -> DataFrame:
    template = F.when(F.col("doc_id") % 2 == 0, "title: {title} | {text}").otherwise("{text}")
    return docs(s, d).select("doc_id", T.strip_title(template, F.col("source")).alias("title"))


@query("truncate_chars", "select doc_id, substr(text, 1, 1500) as t1500, substr(text, 1, 400) as t400 from documents")
def truncate_chars(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.substring("text", 1, 1500).alias("t1500"), F.substring("text", 1, 400).alias("t400"))


def contexts(s: SparkSession, d: str, k: int = 3) -> DataFrame:
    """qid, xs: the texts of the best ``k`` documents in order."""
    hits = ranking(s, d, k=k).join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id")
    return hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("xs"))


CONTEXT_SQL = f"with {FIRST_SQL}, ctx as (select qid, list('[' || rank || '] ' || text order by rank) as numbered, list('- ' || text order by rank) as bullets from first join documents on id = doc_id where rank <= 3 group by qid)"


@query("format_context", f"{CONTEXT_SQL} select qid, md5(array_to_string(numbered, chr(10) || chr(10))) as digest from ctx")
def format_context(s: SparkSession, d: str) -> DataFrame:
    return contexts(s, d).select("qid", F.md5(T.numbered_context(F.col("xs")["text"])).alias("digest"))


@query("join_context", f"{CONTEXT_SQL} select qid, md5(array_to_string(bullets, chr(10))) as digest from ctx")
def join_context(s: SparkSession, d: str) -> DataFrame:
    return contexts(s, d).select("qid", F.md5(T.bulleted_context(F.col("xs")["text"])).alias("digest"))


@query("content_key", "select doc_id, sha256('m' || chr(0) || text) as key, substr(sha256('m' || chr(0) || text), 1, 32) as short_key from documents")
def content_key(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", T.content_key("m", F.col("text")).alias("key"), T.content_key("m", F.col("text"), 32).alias("short_key"))


@query("parse_llm_json", "select doc_id, case when doc_id % 3 = 0 then -1 else doc_id end as value from documents")
def parse_llm_json(s: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit("no json here")).otherwise(F.concat(F.lit('{"value": '), F.col("doc_id").cast("string"), F.lit("}")))
    read = T.parse_json(reply, "value bigint", F.struct(F.lit(-1).cast("bigint").alias("value")))
    return docs(s, d).select("doc_id", F.coalesce(read["value"], F.lit(-1)).alias("value"))


@query("contains_abstain", "select doc_id, doc_id % 4 = 0 as abstained from documents")
def contains_abstain(s: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Sorry: "), F.lit(T.NO_ANSWER))).otherwise(F.lit("an answer"))
    return docs(s, d).select("doc_id", T.abstains(reply).alias("abstained"))


@query("citation_present", "select source, count(*) filter (where doc_id % 3 > 0) as cited from documents group by source")
def citation_present(s: SparkSession, d: str) -> DataFrame:
    citation = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.lit("[1]"))
    return docs(s, d).groupBy("source").agg(F.count(F.when(F.trim(citation) != "", 1)).alias("cited"))


# -- chunking ----------------------------------------------------------------------------------------------------------


@query("chunk_whole", "select doc_id, 0::bigint as ord, text as chunk from documents")
def chunk_whole(s: SparkSession, d: str) -> DataFrame:
    return chunking.apply(docs(s, d), chunking.whole(F.col("text"))).select("doc_id", "ord", "chunk")


FIXED_SQL = f"""w as (select doc_id, text, {sql_words("text")} as w from documents),
win as (select doc_id, i, list_slice(w, i * 160 + 1, i * 160 + 200) as x, ceil(len(w) / 160.0)::bigint as many from w, unnest(generate_series(0, (len(w) - 1) // 160)) as g(i) where len(w) > 200),
fixed as (select doc_id, 0::bigint as ord, text as chunk from w where len(w) <= 200
  union all select doc_id, i as ord, array_to_string(x, ' ') as chunk from win where i = 0 or i < many - 1 or len(x) >= 40)"""


@query("chunk_fixed", f"with {FIXED_SQL} select doc_id, ord, md5(chunk) as digest from fixed")
def chunk_fixed(s: SparkSession, d: str) -> DataFrame:
    return chunking.apply(docs(s, d), chunking.fixed(F.col("text"))).select("doc_id", "ord", F.md5("chunk").alias("digest"))


PACKED_SQL = f"""x as (select doc_id, text, s, list_transform(generate_series(1, len(s)), lambda i: list_sum(list_transform(list_slice(s, 1, i), lambda y: len({sql_words("y")})))) as upto
  from (select doc_id, text, {SENTENCES_SQL} as s from documents)),
packed as (select doc_id, 0::bigint as ord, 1::bigint as a, greatest(1, len(list_filter(upto, lambda v: v <= 200)))::bigint as e from x where len(s) > 0
  union all select p.doc_id, ord + 1, e, greatest(e + 1, len(list_filter(upto, lambda v: v <= 200 + case when e > 1 then upto[e - 1] else 0 end)))::bigint from packed p join x on x.doc_id = p.doc_id where e < len(upto)),
chunks as (select doc_id, ord, array_to_string(list_slice(s, a, e), ' ') as chunk from packed join x using (doc_id) union all select doc_id, 0, text from x where len(s) = 0)"""


@query("chunk_sentence", f"with recursive {PACKED_SQL} select * from chunks")
def chunk_sentence(s: SparkSession, d: str) -> DataFrame:
    return chunking.apply(docs(s, d), chunking.sentence(F.col("text"))).select("doc_id", "ord", "chunk")


@query("chunk_recursive")
def chunk_recursive(s: SparkSession, d: str) -> DataFrame:
    return chunking.recursive(docs(s, d), "doc_id", "text")


@query("chunk_apply", f"with {FIXED_SQL} select doc_id || '#' || ord as chunk_id, doc_id, source, length(chunk)::bigint as chars from fixed join documents using (doc_id)")
def chunk_apply(s: SparkSession, d: str) -> DataFrame:
    return chunking.apply(docs(s, d), chunking.fixed(F.col("text"))).select("chunk_id", "doc_id", "source", F.length("chunk").cast("bigint").alias("chars"))


@query("chunk_long_only", f"with recursive {PACKED_SQL} select c.* from chunks c join documents d using (doc_id) where len({sql_words('d.text')}) * 1.3::double > 512")
def chunk_long_only(s: SparkSession, d: str) -> DataFrame:
    long = docs(s, d).where(T.estimated_tokens(F.size(T.words(F.col("text")))) > T.WINDOW_TOKENS)
    return chunking.apply(long, chunking.sentence(F.col("text"))).select("doc_id", "ord", "chunk")


@query("chunk_stats", f"with {FIXED_SQL} select (select count(*) from documents) as docs, count(*) as chunks, round(count(*) / (select count(*) from documents), 6) as expansion from fixed")
def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    n = docs(s, d).select(F.size(chunking.fixed(F.col("text"))).alias("n"))
    return n.agg(F.count("*").alias("docs"), F.sum("n").alias("chunks"), F.round(F.sum("n") / F.count("*"), 6).alias("expansion"))


# -- lexical retrieval -------------------------------------------------------------------------------------------------


@query("bm25_postings", f"with {BM25_SQL} select term, id, tf from tf")
def bm25_postings(s: SparkSession, d: str) -> DataFrame:
    return lexical.build(docs(s, d)).postings


@query("bm25_doc_len", f"with {BM25_SQL} select id, dl::bigint as dl from lens")
def bm25_doc_len(s: SparkSession, d: str) -> DataFrame:
    return lexical.build(docs(s, d)).lengths


@query("bm25_idf", f"with {BM25_SQL} select term, df::bigint as df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df, corp")
def bm25_idf(s: SparkSession, d: str) -> DataFrame:
    return lexical.build(docs(s, d)).terms.withColumn("idf", F.round("idf", 6))


@query("bm25_search", f"with {BM25_SQL} {sql_top(sql_scores(1.2, 0.75), 10)}")
def bm25_search(s: SparkSession, d: str) -> DataFrame:
    return lexical.search(asked(s, d), docs(s, d))


@query("bm25_params", f"with {BM25_SQL} {sql_top(sql_scores(1.2, 0), 10)}")
def bm25_params(s: SparkSession, d: str) -> DataFrame:
    return lexical.search(asked(s, d), docs(s, d), 10, 1.2, 0.0)


GRID = [(k1, b) for k1 in (0.6, 0.9, 1.2, 1.5, 2.0) for b in (0.25, 0.5, 0.75, 1.0)]
GRID_SQL = "grid as (select * from (values " + ", ".join(f"({i}, {k1}::double, {b}::double)" for i, (k1, b) in enumerate(GRID)) + ") as g(param, k1, b))"
GRID_SCORES_SQL = (
    f"with {BM25_SQL}, {QRELS_SQL}, {GRID_SQL}, gr as materialized ({sql_top(sql_scores('k1', 'b', '(select * from hit, grid where qid in (select qid from qrels))', 'param, qid, id'), 10, 'param, qid')}), "
    f"m as ({sql_metrics('gr', f'select param, qid from grid, ({JUDGED_SQL})', 'param, qid')})"
)


def grid_scores(s: SparkSession, d: str) -> DataFrame:
    """param, k1, b, qid, ndcg_10: every setting on every judged query. One search scores all settings."""
    queries, rel = judged(s, d)
    best = lexical.search_all(queries, docs(s, d), 10, GRID).withColumnRenamed("setting", "param")
    grid = s.createDataFrame([(i, k1, b) for i, (k1, b) in enumerate(GRID)], "param bigint, k1 double, b double")
    keyed = best.select(F.concat_ws(":", "param", "qid").alias("qid"), "id", "rank")
    every = grid.crossJoin(F.broadcast(queries.select("qid")))  # settings by judged queries
    names = every.select(F.concat_ws(":", "param", "qid").alias("key"), "param", "k1", "b", "qid")
    rel_keyed = rel.crossJoin(F.broadcast(grid.select("param"))).select(F.concat_ws(":", "param", "qid").alias("qid"), "id", "grade")
    scores = evaluate.per_query(names.select(F.col("key").alias("qid")), keyed, rel_keyed)
    return scores.select(F.col("qid").alias("key"), "ndcg_10").join(names, "key").select("param", "k1", "b", "qid", "ndcg_10")


@query("bm25_grid", f"{GRID_SCORES_SQL} select param::bigint as param, k1, b, round(avg(ndcg_10), 6) as ndcg_10 from m join grid using (param) group by all")
def bm25_grid(s: SparkSession, d: str) -> DataFrame:
    return grid_scores(s, d).groupBy("param", "k1", "b").agg(F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"))


@query("bm25_index_stats", f"with {BM25_SQL} select n::bigint as docs, (select count(*) from df) as terms, round(avgdl, 6) as avgdl from corp")
def bm25_index_stats(s: SparkSession, d: str) -> DataFrame:
    index = lexical.build(docs(s, d))
    return index.corpus.crossJoin(index.terms.agg(F.count("*").alias("terms"))).select(F.col("n").alias("docs"), "terms", F.round("avgdl", 6).alias("avgdl"))  # one row each


# -- dense retrieval ---------------------------------------------------------------------------------------------------

DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2]::double))"


def sql_dense(k: int, skip: bool = False) -> str:
    pairs = f"select a.vec_id as qid, b.vec_id as id, round({DOT}, 6) as score from (select * from embeddings where vec_id % 50 = 0) a, embeddings b" + " where a.vec_id <> b.vec_id" * skip
    return sql_top(pairs, k)


@query("vec_normalize", "select vec_id as id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(embedding[1]::double / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 1e-12), 6) as first from embeddings")
def vec_normalize(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).select("id", F.round(dense.norm(F.col("v")), 6).alias("norm"), F.round(F.get(dense.normalize(F.col("v")), F.lit(0)), 6).alias("first"))


@query("cosine_naive", f"select a.vec_id as id, round({DOT} / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double)))), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_naive(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    after = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return v.join(after, "id").select("id", F.round(dense.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("dense_topk", sql_dense(10))
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return dense.search(vector_queries(s, d), vectors(s, d), 10)


@query("dense_all_scores", f"select a.vec_id as qid, b.vec_id as id, round({DOT}, 6) as score from (select * from embeddings where vec_id % 50 = 0) a, embeddings b")
def dense_all_scores(s: SparkSession, d: str) -> DataFrame:
    return dense.search(vector_queries(s, d), vectors(s, d), None)


@query("dense_batch", sql_dense(100, True))
def dense_batch(s: SparkSession, d: str) -> DataFrame:
    return dense.search(vector_queries(s, d), vectors(s, d), 100, skip_self=True)


@query("embed")
def embed(s: SparkSession, d: str) -> DataFrame:
    return providers.embed(docs(s, d), "text", providers.HashEmbedder()).select("doc_id", "v")


def pooled(s: SparkSession, d: str, how: str, fetched: int, k: int = 10) -> DataFrame:
    """Vectors are chunks here; four with neighbouring ids make a document."""
    hits = dense.search(vector_queries(s, d), vectors(s, d), fetched).withColumn("doc_id", F.floor(F.col("id") / 4))
    return dense.pool(hits.drop("id"), how, k)


def sql_pooled(how: str, fetched: int) -> str:
    return sql_top(f"select qid, id // 4 as id, round({how}(score), 6) as score from ({sql_dense(fetched)}) group by all", 10)


@query("doc_pool", " union all ".join(f"select '{n}' as how, * from ({sql_pooled(f, 50)})" for n, f in (("max", "max"), ("sum", "sum"), ("mean", "avg"))))
def doc_pool(s: SparkSession, d: str) -> DataFrame:
    parts = [pooled(s, d, how, 50).withColumn("how", F.lit(how)) for how in ("max", "sum", "mean")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("doc_pool_fixed50", sql_pooled("max", 50))
def doc_pool_fixed50(s: SparkSession, d: str) -> DataFrame:
    return pooled(s, d, "max", 50)


@query(
    "blend_long_chunks",
    f"""with sc as materialized (select a.vec_id as qid, b.vec_id as id, round({DOT}, 6) as score from (select * from embeddings where vec_id % 50 = 0) a, embeddings b),
c as (select qid, id // 2 * 2 as id, max(score) as chunk from sc where id % 2 = 1 group by all)
{sql_top("select w.qid, w.id, round(0.6 * w.score + 0.4 * greatest(w.score, coalesce(chunk, w.score)), 6) as score from (select * from sc where id % 2 = 0) w left join c using (qid, id)", 10)}""",
)
def blend_long_chunks(s: SparkSession, d: str) -> DataFrame:
    """Even ids are documents, the odd id after each is a chunk of it."""
    whole = vectors(s, d).where("id % 2 = 0")
    chunks = vectors(s, d).where("id % 2 = 1").select((F.floor(F.col("id") / 2) * 2).alias("doc_id"), "v")
    return dense.blended_search(vector_queries(s, d), whole, chunks, 0.4)


@query("hyde_blend", "with v as (select a.vec_id as id, list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double + 0.5 * p[2]::double) as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as first from v")
def hyde_blend(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    after = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return v.join(after, "id").select("id", F.round(F.get(dense.blend_vectors(F.col("v"), F.col("w"), 0.5), F.lit(0)), 6).alias("first"))


@query("index_bytes", "select count(*) * 64 * 4 as bytes from embeddings")
def index_bytes(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).agg((F.sum(F.size("v")) * 4).alias("bytes"))


SIM_SQL = """with t as (select vec_id, i, list_slice(embedding, i * 8 + 1, i * 8 + 8) as t from embeddings, unnest(generate_series(0, 7)) as g(i)),
best as (select a.vec_id as qid, b.vec_id as id, a.i, max(list_sum(list_transform(list_zip(a.t, b.t), lambda p: p[1]::double * p[2]::double))) as m from (select * from t where vec_id % 50 = 0) a, t b group by all),
sim as (select qid, id, round(sum(m), 6) as score from best group by all)"""


def token_pairs(s: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    tokens = vectors(s, d).select("id", dense.token_vectors(F.col("v"), 8).alias("t"))
    both = pairs.join(tokens, "id").join(tokens.select(F.col("id").alias("qid"), F.col("t").alias("q")), "qid")
    return both.select("qid", "id", F.round(dense.maxsim(F.col("q"), F.col("t")), 6).alias("score"))


@query("maxsim", f"{SIM_SQL} {sql_top('select * from sim', 10)}")
def maxsim(s: SparkSession, d: str) -> DataFrame:
    """The stated query set against every vector, read as eight token vectors."""
    return dense.maxsim_search(vector_queries(s, d), vectors(s, d), 8)


@query("maxsim_rerank", f"{SIM_SQL} {sql_top(f'select sim.* from sim join ({sql_dense(100)}) c using (qid, id)', 10).replace('as score from (select * from embeddings where', 'as score from (select * from embeddings where')}")
def maxsim_rerank(s: SparkSession, d: str) -> DataFrame:
    candidates = dense.search(vector_queries(s, d), vectors(s, d), 100).select("qid", "id")
    return lexical.top(token_pairs(s, d, candidates), 10)


@query("token_encode")
def token_encode(s: SparkSession, d: str) -> DataFrame:
    return providers.call(asked(s, d), providers.TokenEncoder(8), ["question"], "tokens", "array<array<double>>")


@query("token_index_add", f"with {FIXED_SQL} select doc_id, len(regexp_extract_all(lower(chunk), '[a-z0-9]+'))::bigint as n from fixed")
def token_index_add(s: SparkSession, d: str) -> DataFrame:
    chunks = chunking.apply(docs(s, d), chunking.fixed(F.col("text"))).select("doc_id", "chunk")
    return providers.call(chunks, providers.TokenEncoder(8), ["chunk"], "tokens", "array<array<double>>").select("doc_id", F.size("tokens").cast("bigint").alias("n"))


@query("index_extrapolate", "select count(*) * 64 * 4 as single, count(*) * 8 * 64 * 4 as multi, 8.0::double as ratio, round(count(*) * 64 * 4 / count(*)::double * 1000000, 6) as at_million from embeddings")
def index_extrapolate(s: SparkSession, d: str) -> DataFrame:
    one = F.sum(F.size("v")) * 4
    return vectors(s, d).agg(one.alias("single"), (one * 8).alias("multi"), (one * 8 / one).cast("double").alias("ratio"), F.round(one / F.count("*") * 1_000_000, 6).alias("at_million"))


# -- fusion ------------------------------------------------------------------------------------------------------------

NORM_SQL = "select *, case when max(score) over w - min(score) over w < 1e-9 then 0.5::double else (score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0) end as norm from runs window w as (partition by run, qid)"


def sql_rrf(weights: str, k: int = 60) -> str:
    return sql_top(f"select qid, id, round(sum({weights} / ({k} + rank)), 9) as score from runs group by all", 10)


def sql_weighted(first: float, second: float) -> str:
    return sql_top(f"select qid, id, round(sum(case run when 'first' then {first} else {second} end * norm), 6) as score from ({NORM_SQL}) group by all", 10)


@query("minmax", f"with {RUNS_SQL} select run, qid, id, round(norm, 6) as norm from ({NORM_SQL})")
def minmax(s: SparkSession, d: str) -> DataFrame:
    return fusion.minmax(runs(s, d)).select("run", "qid", "id", F.round("norm", 6).alias("norm"))


@query("rrf", f"with {RUNS_SQL} {sql_rrf('1.0::double')}")
def rrf(s: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(runs(s, d))


@query("rrf_weighted", f"""with {RUNS_SQL} {sql_rrf("case run when 'first' then 2.0::double else 1.0::double end")}""")
def rrf_weighted(s: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(runs(s, d), weights={"first": 2.0, "second": 1.0})


@query("weighted_fusion", f"with {RUNS_SQL} {sql_weighted(0.7, 0.3)}")
def weighted_fusion(s: SparkSession, d: str) -> DataFrame:
    return fusion.weighted_fusion(runs(s, d), {"first": 0.7, "second": 0.3})


@query("hybrid_candidates", f"with {RUNS_SQL} select qid, count(distinct id) as candidates, count(*) - count(distinct id) as shared from runs group by qid")
def hybrid_candidates(s: SparkSession, d: str) -> DataFrame:
    return runs(s, d).groupBy("qid").agg(F.countDistinct("id").alias("candidates"), (F.count("*") - F.countDistinct("id")).alias("shared"))


OVERLAP_SQL = f"""re as (select qid, id, round(case when len(u) = 0 then 0 else len(list_intersect(x, y)) / len(u)::double end, 6) as score
  from (select f.qid, f.id, x, y, list_distinct(list_concat(x, y)) as u from first f
    join (select item_id as qid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as x from benchmark) q on f.qid = q.qid
    join (select doc_id as id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as y from documents) t on f.id = t.id))"""


def reranked(s: SparkSession, d: str, first: DataFrame) -> DataFrame:
    pairs = first.select("qid", "id").join(asked(s, d), "qid").join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id")
    return providers.rerank(pairs, providers.OverlapScorer()).select("qid", "id", "score")


@query("interpolate_rerank", f"with {FIRST_SQL}, {OVERLAP_SQL}, runs as (select 'first' as run, qid, id, score from first where rank <= {RERANK_DEPTH} union all select 'second', re.qid, re.id, re.score from re join first using (qid, id) where rank <= {RERANK_DEPTH}) {sql_weighted(0.4, 0.6)}")
def interpolate_rerank(s: SparkSession, d: str) -> DataFrame:
    first = io.cut(ranking(s, d, k=RERANK_DEPTH))
    both = first.select("qid", "id", "score").withColumn("run", F.lit("first")).unionByName(reranked(s, d, first).withColumn("run", F.lit("second")))
    return fusion.weighted_fusion(both, {"first": 0.4, "second": 0.6})


def variants(s: SparkSession, d: str) -> DataFrame:
    """run, qid, id, rank: the original query's list and one for each rewrite."""
    rewritten = providers.rewrites(asked(s, d), providers.RuleGenerator("rewrite"))
    every = asked(s, d).withColumn("variant", F.lit(-1).cast("bigint")).unionByName(rewritten)
    keyed = every.select(F.concat_ws(":", "qid", "variant").alias("qid"), "question")
    hits = lexical.search(keyed, docs(s, d), 100)
    return hits.select(F.split("qid", ":")[0].cast("bigint").alias("qid"), F.when(F.split("qid", ":")[1] == "-1", "original").otherwise(F.split("qid", ":")[1]).alias("run"), "id", "rank", "score")


HALVES_SQL = f"""ask as (select qid, term, count(*) as times from (
  select qid, unnest({sql_tokens("q")}) as term from (
    select item_id || ':-1' as qid, text as q from benchmark
    union all select item_id || ':0', array_to_string(list_slice(w, 1, greatest(1, len(w) // 2)), ' ') from (select item_id, {sql_words("text")} as w from benchmark)
    union all select item_id || ':1', array_to_string(list_slice(w, greatest(1, len(w) // 2) + 1, len(w)), ' ') from (select item_id, {sql_words("text")} as w from benchmark))) group by all),
hit as materialized (select qid, id, tf, times, dl, df, n, avgdl from ask join tf using (term) join df using (term) join lens using (id), corp)"""
VARIANTS_SQL = f"with {BM25_SQL.split('ask as')[0]} {HALVES_SQL}, runs as materialized (select split_part(qid, ':', 1)::bigint as qid, case split_part(qid, ':', 2) when '-1' then 'original' else split_part(qid, ':', 2) end as run, id, rank, score from ({sql_top(sql_scores(1.2, 0.75), 100)}))"


@query("multi_query_fuse", f"{VARIANTS_SQL} {sql_rrf('1.0::double')}")
def multi_query_fuse(s: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(variants(s, d))


@query("additive_fuse", f"""{VARIANTS_SQL} {sql_rrf("case run when 'original' then 0.7::double else 0.3::double / m end").replace('from runs group by all', "from runs join (select qid, count(distinct run) - 1 as m from runs group by qid) using (qid) group by qid, id")}""")
def additive_fuse(s: SparkSession, d: str) -> DataFrame:
    return fusion.additive(variants(s, d), 0.3)


# -- reranking ---------------------------------------------------------------------------------------------------------


@query("rerank", f"with {FIRST_SQL}, {OVERLAP_SQL} {sql_top('select * from re', 10)}")
def rerank(s: SparkSession, d: str) -> DataFrame:
    return lexical.top(reranked(s, d, ranking(s, d)), 10)


@query("rerank_cached", f"with {FIRST_SQL}, {OVERLAP_SQL} {sql_top('select * from re', 10)}")
def rerank_cached(s: SparkSession, d: str) -> DataFrame:
    """The pairs of the best five are scored first; the second pass asks for the others only."""
    store = io.KeyedStore(s, io.scratch_dir(s), "double")
    pairs = io.cut(ranking(s, d).select("qid", "id", "rank").join(asked(s, d), "qid").join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id"))
    providers.rerank(pairs.where("rank <= 5"), providers.OverlapScorer(), store=store).count()
    return lexical.top(providers.rerank(pairs, providers.OverlapScorer(), store=store).select("qid", "id", "score"), 10)


@query("rerank_llm_yesno", "select vec_id as id, round(1 / (1 + exp(embedding[1]::double - embedding[2]::double)), 6) as p from embeddings")
def rerank_llm_yesno(s: SparkSession, d: str) -> DataFrame:
    no, yes = F.get("v", F.lit(0)).cast("double"), F.get("v", F.lit(1)).cast("double")
    return vectors(s, d).select("id", F.round(providers.yes_probability(no, yes), 6).alias("p"))


SWEEP = (10, 20, 50, 100)


@query("rerank_depth_sweep", f"with {FIRST_SQL}, {OVERLAP_SQL} " + " union all ".join(f"select {k}::bigint as depth, * from ({sql_top(f'select re.* from re join (select qid, id from first where rank <= {k}) using (qid, id)', 10)})" for k in SWEEP))
def rerank_depth_sweep(s: SparkSession, d: str) -> DataFrame:
    first = io.cut(ranking(s, d))
    scored = reranked(s, d, first).join(first.select("qid", "id", F.col("rank").alias("was")), ["qid", "id"])
    depths = s.createDataFrame([(k,) for k in SWEEP], "depth bigint")
    return lexical.top(scored.join(F.broadcast(depths), F.col("was") <= F.col("depth")).select("depth", "qid", "id", "score"), 10, ("depth", "qid"))


@query("candidate_recall", f"with {FIRST_SQL}, {QRELS_SQL} select depth::bigint as depth, round(avg(r), 6) as recall from (select depth, q.qid, count(f.id) / count(*)::double as r from (select unnest([10, 20, 50, 100]) as depth), qrels q left join first f on f.qid = q.qid and f.id = q.id and f.rank <= depth group by all) group by depth")
def candidate_recall(s: SparkSession, d: str) -> DataFrame:
    queries, rel = judged(s, d)
    scores = evaluate.per_query(queries, ranking(s, d), rel, ks=SWEEP, ndcg_ks=(10,))
    found = scores.agg(*[F.round(F.avg(f"recall_{k}"), 6).alias(str(k)) for k in SWEEP])
    return found.select(F.expr(f"stack({len(SWEEP)}, " + ", ".join(f"{k}L, `{k}`" for k in SWEEP) + ") as (depth, recall)"))


@query("rerank_spread", f"{SCORES_SQL} select round(max(m) - min(m), 6) as spread from (select run, round(avg(ndcg_10), 6) as m from scores group by run)")
def rerank_spread(s: SparkSession, d: str) -> DataFrame:
    each = run_scores(s, d).groupBy("run").agg(F.round(F.avg("ndcg_10"), 6).alias("m"))
    return each.agg(F.round(F.max("m") - F.min("m"), 6).alias("spread"))


@query("spearman", f"with {FIRST_SQL}, {OVERLAP_SQL}, r as (select f.qid, row_number() over (partition by f.qid order by f.score desc, f.id) as a, row_number() over (partition by f.qid order by re.score desc, f.id) as b from first f join re using (qid, id) where f.rank <= 50) select qid, count(*) as n, round(corr(a, b), 6) + 0.0::double as rho from r group by qid having count(*) >= 5")
def spearman(s: SparkSession, d: str) -> DataFrame:
    first = io.cut(ranking(s, d, k=RERANK_DEPTH))
    both = reranked(s, d, first).withColumnRenamed("score", "other").join(first, ["qid", "id"])
    a, b = (F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "id")).cast("double") for c in ("score", "other"))
    ranks = both.select("qid", a.alias("a"), b.alias("b"))
    return ranks.groupBy("qid").agg(F.count("*").alias("n"), (F.round(F.corr("a", "b"), 6) + F.lit(0.0)).alias("rho")).where("n >= 5")


# -- metrics -----------------------------------------------------------------------------------------------------------

METRICS_SQL = f"with {FIRST_SQL}, {QRELS_SQL}, m as materialized ({sql_metrics('first', JUDGED_SQL)})"


def first_scores(s: SparkSession, d: str, **how) -> DataFrame:
    queries, rel = judged(s, d)
    return evaluate.per_query(queries, ranking(s, d), rel, **how)


@query("recall_at_k", f"{METRICS_SQL} select qid, recall_1, recall_3, recall_5, recall_10 from m")
def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    return first_scores(s, d).select("qid", "recall_1", "recall_3", "recall_5", "recall_10")


@query("mrr", f"{METRICS_SQL} select qid, mrr from m")
def mrr(s: SparkSession, d: str) -> DataFrame:
    return first_scores(s, d).select("qid", "mrr")


@query("ndcg_at_k", f"{METRICS_SQL} select qid, ndcg_10 from m")
def ndcg_at_k(s: SparkSession, d: str) -> DataFrame:
    return first_scores(s, d).select("qid", "ndcg_10")


@query("evaluate", f"{METRICS_SQL} select count(*) as n, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in ("recall_1", "recall_3", "recall_5", "recall_10", "mrr", "ndcg_10")) + " from m")
def evaluate_all(s: SparkSession, d: str) -> DataFrame:
    return evaluate.means(first_scores(s, d))


@query("metrics_v2", f"with {FIRST_SQL}, {QRELS_SQL}, m as ({sql_metrics('first', JUDGED_SQL, membership=True)}) select qid, ndcg_10, recall_10, mrr from m")
def metrics_v2(s: SparkSession, d: str) -> DataFrame:
    return first_scores(s, d, by_membership=True).select("qid", "ndcg_10", "recall_10", "mrr")


HIT_SQL = f"with {FIRST_SQL}, {QRELS_SQL}, g as (select qid, min(id) as id from qrels group by qid), h as (select g.qid, f.rank from g left join first f on f.qid = g.qid and f.id = g.id and f.rank <= 5)"


@query("hit_at_k", f"{HIT_SQL} select count(*) as n, " + ", ".join(f"round(avg((coalesce(rank, 99) <= {k})::int), 6) as hit_{k}" for k in (1, 3, 5)) + ", round(avg(coalesce(1.0 / rank, 0)), 6) as mrr_5 from h")
def hit_at_k(s: SparkSession, d: str) -> DataFrame:
    queries, rel = judged(s, d)
    gold = rel.groupBy("qid").agg(F.min("id").alias("id"), F.lit(1).alias("grade"))
    scores = evaluate.per_query(queries, ranking(s, d), gold, ks=(1, 3, 5), ndcg_ks=(5,))
    return scores.agg(F.count("*").alias("n"), *[F.round(F.avg(f"recall_{k}"), 6).alias(f"hit_{k}") for k in (1, 3, 5)], F.round(F.avg("mrr"), 6).alias("mrr_5"))


FORMS_SQL = f"""{VARIANTS_SQL}, {QRELS_SQL}, scores as materialized ({sql_metrics('runs', f"select run, qid from ({JUDGED_SQL}), (select unnest(['original', '0']) as run)", 'run, qid')})"""


def form_scores(s: SparkSession, d: str) -> DataFrame:
    """run, qid and every metric of two forms of each judged query: as it is (original), and its first half (0)."""
    queries, rel = judged(s, d)
    hits = io.cut(variants(s, d).where("run in ('original', '0')"))
    parts = [evaluate.per_query(queries, hits.where(F.col("run") == r), rel).withColumn("run", F.lit(r)) for r in ("original", "0")]
    return parts[0].unionByName(parts[1])


@query("leakage_gap", f"{FORMS_SQL} select round(avg(recall_1) filter (where run = 'original') - avg(recall_1) filter (where run = '0'), 6) as gap from scores")
def leakage_gap(s: SparkSession, d: str) -> DataFrame:
    """How much better direct questions do than rewritten ones."""
    mean = lambda r: F.avg(F.when(F.col("run") == r, F.col("recall_1")))
    return form_scores(s, d).agg(F.round(mean("original") - mean("0"), 6).alias("gap"))


@query("record", f"{SCORES_SQL} select run as config, qid, ndcg_10, recall_10, mrr from scores")
def record(s: SparkSession, d: str) -> DataFrame:
    return run_scores(s, d).select(F.col("run").alias("config"), "qid", "ndcg_10", "recall_10", "mrr")


@query("tune", f"{GRID_SCORES_SQL} select param::bigint as param, k1, b, round(avg(ndcg_10) filter (where {TRAIN_SQL}), 6) as train_ndcg_10, round(avg(ndcg_10) filter (where not {TRAIN_SQL}), 6) as test_ndcg_10 from m join grid using (param) group by all order by train_ndcg_10 desc nulls last, param limit 1")
def tune(s: SparkSession, d: str) -> DataFrame:
    """The setting that is best on training queries, and what it gives on the others."""
    mean = lambda on: F.round(F.avg(F.when(on, F.col("ndcg_10"))), 6)
    each = grid_scores(s, d).groupBy("param", "k1", "b").agg(mean(for_training()).alias("train_ndcg_10"), mean(~for_training()).alias("test_ndcg_10"))
    return each.orderBy(F.desc_nulls_last("train_ndcg_10"), "param").limit(1)


@query("format_select", f"{FORMS_SQL} select run as format, m as train_ndcg_10 from (select run, round(avg(ndcg_10) filter (where {TRAIN_SQL}), 6) as m from scores group by run) order by m desc nulls last, run = 'original' desc limit 1")
def format_select(s: SparkSession, d: str) -> DataFrame:
    """The query format that is best on training queries; the plain one of equals."""
    each = form_scores(s, d).groupBy("run").agg(F.round(F.avg(F.when(for_training(), F.col("ndcg_10"))), 6).alias("m"))
    return each.orderBy(F.desc_nulls_last("m"), F.desc(F.col("run") == "original")).limit(1).select(F.col("run").alias("format"), F.col("m").alias("train_ndcg_10"))


@query(
    "complementarity",
    f"with {RUNS_SQL}, {QRELS_SQL}, h as (select distinct run, r.qid from runs r join qrels q using (qid, id) where rank <= 10 and grade > 0) "
    f"select case when a and b then 'both' when a then 'first only' when b then 'second only' else 'neither' end as case, count(*) as n from (select qid, qid in (select qid from h where run = 'first') as a, qid in (select qid from h where run = 'second') as b from ({JUDGED_SQL})) group by all",
)
def complementarity(s: SparkSession, d: str) -> DataFrame:
    queries, rel = judged(s, d)
    every = io.cut(runs(s, d))
    return evaluate.complementarity(queries, every.where("run = 'first'"), every.where("run = 'second'"), rel)


@query("qrels_per_query", f"with {QRELS_SQL} select round(avg(n), 6) as mean from (select count(*) as n from qrels group by qid)")
def qrels_per_query(s: SparkSession, d: str) -> DataFrame:
    return qrels(s, d).groupBy("qid").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"))


@query("gold_in_context", f"with {FIRST_SQL}, {QRELS_SQL} select qid, bool_or(f.id is not null) as found from qrels q left join (select qid, id from first where rank <= 3) f using (qid, id) group by qid")
def gold_in_context(s: SparkSession, d: str) -> DataFrame:
    rel = qrels(s, d)
    near = ranking(s, d, k=3).select("qid", "id", F.lit(True).alias("in"))
    return rel.join(near, ["qid", "id"], "left").groupBy("qid").agg(F.max(F.coalesce("in", F.lit(False))).alias("found"))


SHIFT_SQL = f"with {FIRST_SQL}, {OVERLAP_SQL}, {QRELS_SQL}, s as (select qid, id, rank as before, row_number() over (partition by qid order by re.score desc, id) as after from first join re using (qid, id))"


@query("gold_rank_shift", f"{SHIFT_SQL} select round(avg(before), 6) as before, round(avg(after), 6) as after, count(*) filter (where after < before) as up, count(*) filter (where after > before) as down, count(*) filter (where after = before) as same from s join qrels using (qid, id)")
def gold_rank_shift(s: SparkSession, d: str) -> DataFrame:
    first = io.cut(ranking(s, d))
    moved = lexical.top(reranked(s, d, first), DEPTH).select("qid", "id", F.col("rank").alias("after")).join(first.select("qid", "id", F.col("rank").alias("before")), ["qid", "id"]).join(qrels(s, d), ["qid", "id"])
    a, b = F.col("after"), F.col("before")
    return moved.agg(F.round(F.avg(b), 6).alias("before"), F.round(F.avg(a), 6).alias("after"), F.count(F.when(a < b, 1)).alias("up"), F.count(F.when(a > b, 1)).alias("down"), F.count(F.when(a == b, 1)).alias("same"))


@query("delta_table", f"{SCORES_SQL} select run, round(m - (select avg(ndcg_10) from scores where run = 'first'), 6) as delta from (select run, avg(ndcg_10) as m from scores group by run)")
def delta_table(s: SparkSession, d: str) -> DataFrame:
    each = io.cut(run_scores(s, d)).groupBy("run").agg(F.avg("ndcg_10").alias("m"))
    control = each.where("run = 'first'").select(F.col("m").alias("c"))
    return each.crossJoin(F.broadcast(control)).select("run", F.round(F.col("m") - F.col("c"), 6).alias("delta"))  # one row


# -- statistics --------------------------------------------------------------------------------------------------------

#: Each numeric column of the scores is a config; ndcg_10 of the first run is the control.
CONFIGS_SQL = f"""{SCORES_SQL}, cfg as materialized (
  select run || ' ' || metric as config, qid, value from (unpivot (select run, qid, recall_1, recall_5, mrr, ndcg_10 from scores) on recall_1, recall_5, mrr, ndcg_10 into name metric value value)),
diff as materialized (select t.config, t.qid, t.value as a, c.value as b, t.value - c.value as d from cfg t join cfg c on t.qid = c.qid and c.config = 'first ndcg_10' where t.config <> 'first ndcg_10')"""
SUMMARY_SQL = "select config, count(*) as n, round(avg(a), 6) as treatment_mean, round(avg(b), 6) as control_mean, round(avg(d), 6) as delta, count(*) filter (where d > 1e-9) as better, count(*) filter (where d < -1e-9) as worse from diff group by config"
BOOT_SQL = f"""idx as (select config, row_number() over (partition by config order by qid) - 1 as i, d from diff),
size as (select config, count(*) as n, avg(d) as mean from idx group by config),
draw as (select n, r, ('0x' || substr(md5(r || ':' || i), 1, 12))::bigint % n as pick from (select distinct n from size), unnest(generate_series(0, {RESAMPLES - 1})) as g(r), unnest(generate_series(0, n - 1)) as h(i)),
means as (select s.config, r, round(sum(x.d) / s.n, 9) as m, any_value(mean) as mean from size s join draw w on w.n = s.n join idx x on x.config = s.config and x.i = w.pick group by s.config, s.n, r),
boot as materialized (select config, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi, round(greatest(avg((abs(m - mean) >= abs(mean) - 1e-9)::int), 1 / {RESAMPLES}.0::double), 6) as p from means group by config)"""
HOLM_SQL = "select *, round(max(least(1.0, (count(*) over () - rn + 1) * p)) over (order by p, config rows unbounded preceding), 6) as p_holm from (select *, row_number() over (order by p, config) as rn from boot)"


def config_scores(s: SparkSession, d: str) -> DataFrame:
    names = ("recall_1", "recall_5", "mrr", "ndcg_10")
    wide = run_scores(s, d).select("run", "qid", *names)
    long = wide.select("run", "qid", F.expr("stack(4, " + ", ".join(f"'{n}', {n}" for n in names) + ") as (metric, value)"))
    return io.cut(long.select(F.concat_ws(" ", "run", "metric").alias("config"), "qid", "value"))


def config_diffs(s: SparkSession, d: str) -> DataFrame:
    return io.cut(stats.differences(config_scores(s, d), "first ndcg_10"))


def stage_diffs(s: SparkSession, d: str) -> DataFrame:
    """Differences of a whole stage: besides the configs, a copy of the control, the training rows and a config of fewer queries."""
    every = config_scores(s, d)
    control = every.where("config = 'first ndcg_10'")
    more = control.withColumn("config", F.lit("first again"))
    train = every.where("config = 'second ndcg_10'").where(for_training()).withColumn("config", F.lit("second ndcg_10" + stats.TRAIN))
    fewer = control.where(~for_training()).withColumn("config", F.lit("first in part"))
    stage = every.unionByName(more).unionByName(train).unionByName(fewer)
    return io.cut(stats.differences(stats.comparable(stage, "first ndcg_10"), "first ndcg_10"))


def stage_rows(diffs: DataFrame) -> DataFrame:
    rows = stats.summarize(diffs).where("better + worse > 0").select("config", "n", "delta").join(stats.hashed_bootstrap(diffs), "config")
    return stats.holm(rows).withColumn("verdict", stats.verdict(F.col("p_holm"), F.col("lo"), F.col("hi")))


IDENTICAL_SQL = "select 'first again' as config union all select distinct config from diff group by config having count(*) filter (where abs(d) > 1e-9) = 0"


@query("identical_configs", f"{CONFIGS_SQL} {IDENTICAL_SQL}")
def identical_configs(s: SparkSession, d: str) -> DataFrame:
    """Configs of a stage that never differ from its control."""
    return stats.summarize(stage_diffs(s, d)).where("better + worse = 0").select("config")


@query("paired_diff", f"{CONFIGS_SQL} {SUMMARY_SQL}")
def paired_diff(s: SparkSession, d: str) -> DataFrame:
    return stats.summarize(config_diffs(s, d))


@query("paired_bootstrap")
def paired_bootstrap(s: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap(config_diffs(s, d))


@query("paired_bootstrap_hashed", f"{CONFIGS_SQL}, {BOOT_SQL} select * from boot")
def paired_bootstrap_hashed(s: SparkSession, d: str) -> DataFrame:
    return stats.hashed_bootstrap(config_diffs(s, d))


@query("holm", f"{CONFIGS_SQL}, {BOOT_SQL}, h as (select *, (select count(*) from boot) as m from (select *, row_number() over (order by p, config) as rn from boot)) select config, p, round(max(least(1.0, (m - rn + 1) * p)) over (order by p, config rows unbounded preceding), 6) as p_holm from h")
def holm(s: SparkSession, d: str) -> DataFrame:
    return stats.holm(stats.hashed_bootstrap(config_diffs(s, d))).select("config", "p", "p_holm")


COMPARED_SQL = f"""{CONFIGS_SQL}, {BOOT_SQL}, h as (select *, (select count(*) from boot join sums using (config) where better + worse > 0) as m, row_number() over (order by p, config) as rn from boot join sums using (config) where better + worse > 0),
sums as ({SUMMARY_SQL}), ph as (select *, round(max(least(1.0, (m - rn + 1) * p)) over (order by p, config rows unbounded preceding), 6) as p_holm from h),
compared as (select config, n, delta, lo, hi, p, p_holm, case when p_holm < 0.05 and hi < 0 then 'worse' when p_holm < 0.05 and lo > 0 then 'better' else 'no detectable difference' end as verdict from ph)"""
COMPARED_SQL = COMPARED_SQL.replace(f"sums as ({SUMMARY_SQL}), ", "").replace(f"{BOOT_SQL}, h as", f"{BOOT_SQL}, sums as ({SUMMARY_SQL}), h as")


@query("stage_comparisons", f"{COMPARED_SQL} select * from compared")
def stage_comparisons(s: SparkSession, d: str) -> DataFrame:
    """Every config against the control, corrected together. Left out before that: training rows, configs of another number of
    queries, and configs that never differ from the control."""
    return stage_rows(stage_diffs(s, d))


@query("verdict", f"{COMPARED_SQL} select verdict, count(*) as n from compared group by verdict")
def verdict(s: SparkSession, d: str) -> DataFrame:
    return stage_comparisons(s, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("bm25_subview", f"{COMPARED_SQL} select config, delta from compared where starts_with(config, 'second')")
def bm25_subview(s: SparkSession, d: str) -> DataFrame:
    return stage_comparisons(s, d).where(F.startswith("config", F.lit("second"))).select("config", "delta")


@query(
    "headline_grid",
    f"""{COMPARED_SQL}, cells as (select config, case verdict when 'worse' then '▼' when 'better' then '▲' else '·' end || printf(' %+.3f', delta) as cell from compared union all select config, '= 0' from ({IDENTICAL_SQL}))
select metric, coalesce(max(cell) filter (where config = 'first ' || metric), 'n/a') as first, coalesce(max(cell) filter (where config = 'second ' || metric), 'n/a') as second from (select unnest(['recall_1', 'recall_5', 'mrr', 'ndcg_10']) as metric) left join cells on config in ('first ' || metric, 'second ' || metric) group by metric""",
)
def headline_grid(s: SparkSession, d: str) -> DataFrame:
    """Marks of each metric and run against the control: up, down or no difference found, ``= 0`` for equal and ``n/a`` for what was not compared."""
    diffs = stage_diffs(s, d)
    mark = F.when(F.col("verdict") == "worse", "▼").when(F.col("verdict") == "better", "▲").otherwise("·")
    cells = stage_rows(diffs).select("config", F.concat(mark, F.format_string(" %+.3f", "delta")).alias("cell"))
    same = stats.summarize(diffs).where("better + worse = 0").select("config", F.lit("= 0").alias("cell"))
    every = s.createDataFrame([(m, r, f"{r} {m}") for m in ("recall_1", "recall_5", "mrr", "ndcg_10") for r in RUNS], "metric string, run string, config string")
    rows = every.join(F.broadcast(cells.unionByName(same)), "config", "left")  # one row for each config
    return rows.groupBy("metric").pivot("run", list(RUNS)).agg(F.coalesce(F.max("cell"), F.lit("n/a")))


@query("percentile_nearest", f"with w as (select len({sql_words('text')})::bigint as n from documents), o as (select n, row_number() over (order by n) as r, count(*) over () as c from w) select " + ", ".join(f"max(n) filter (where r = floor(c * {p}::double)) as {name}" for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " from o")
def percentile_nearest(s: SparkSession, d: str) -> DataFrame:
    n = docs(s, d).select(F.size(T.words(F.col("text"))).alias("n"))
    return stats.nearest_percentile(n, "n", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(
    "truncation_report",
    f"with w as (select len({sql_words('text')}) as n from documents), t as (select round_even(n * 1.3::double, 0) as t1, n * 1.3::double as t2 from w) "
    "select count(*) as docs, count(*) filter (where t1 > 512) as over_v1, count(*) filter (where t2 > 512) as over_v2, sum(greatest(0, t1 - 512))::bigint as lost, round(100 * sum(greatest(0, t1 - 512)) / sum(t1), 6) as lost_percent from t",
)
def truncation_report(s: SparkSession, d: str) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    t = docs(s, d).select(T.estimated_tokens(n, rounded=True).alias("t1"), T.estimated_tokens(n).alias("t2"))
    lost = F.sum(F.greatest(F.lit(0), F.col("t1") - T.WINDOW_TOKENS))
    return t.agg(F.count("*").alias("docs"), F.count(F.when(F.col("t1") > T.WINDOW_TOKENS, 1)).alias("over_v1"), F.count(F.when(F.col("t2") > T.WINDOW_TOKENS, 1)).alias("over_v2"), lost.alias("lost"), F.round(100 * lost / F.sum("t1"), 6).alias("lost_percent"))


@query(
    "latency_stats",
    """with o as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null),
places as (select distinct event_type, n, greatest(1, least(n - 1, (n + 1) * 9 // 10)) as j from o),
cut as (select event_type, (max(value) filter (where r = j) * (10 - ((any_value(n) + 1) * 9 - any_value(j) * 10)) + coalesce(max(value) filter (where r = j + 1), max(value) filter (where r = j)) * ((any_value(n) + 1) * 9 - any_value(j) * 10)) / 10 as p90 from o join places using (event_type, n) group by event_type)
select event_type, round(median(value), 6) as median, round(any_value(p90), 6) as p90, count(*) as n from events join cut using (event_type) group by event_type""",
)
def latency_stats(s: SparkSession, d: str) -> DataFrame:
    events = io.table(s, d, "events")
    ninth = stats.exclusive_decile(events, "value", 9, "p90", ("event_type",))
    each = events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.count("*").alias("n"))
    return each.join(ninth, "event_type").select("event_type", "median", F.round("p90", 6).alias("p90"), "n")


@query("subsample", "select doc_id from documents order by md5('0:' || doc_id), doc_id limit 100")
def subsample(s: SparkSession, d: str) -> DataFrame:
    return stats.hashed_sample(docs(s, d).select("doc_id"), 100, "doc_id")


@query("subset_docs", f"with {QRELS_SQL}, g as (select distinct id as doc_id from qrels) select doc_id from g union all select * from (select doc_id from documents where doc_id not in (select doc_id from g) order by md5('0:' || doc_id), doc_id limit 100)")
def subset_docs(s: SparkSession, d: str) -> DataFrame:
    gold = qrels(s, d).select(F.col("id").alias("doc_id")).distinct()
    return gold.unionByName(stats.hashed_sample(docs(s, d).select("doc_id").join(gold, "doc_id", "left_anti"), 100, "doc_id"))


# -- model-backed operators --------------------------------------------------------------------------------------------


PROMPT_WORDS = sql_words("text")
REWRITES_SQL = f"""rw as (select item_id as qid, text, list_filter([array_to_string(list_slice(w, 1, greatest(1, len(w) // 2)), ' '), array_to_string(list_slice(w, greatest(1, len(w) // 2) + 1, len(w)), ' ')], lambda q: trim(q) <> '') as qs
  from (select item_id, text, {PROMPT_WORDS} as w from benchmark))"""


def sql_rewrites(least: int) -> str:
    return f"select qid, (i - 1)::bigint as variant, case when len(qs) >= {least} then qs[i] else text end as question from rw, unnest(generate_series(1, case when len(qs) >= {least} then len(qs) else 1 end)) as g(i)"


def sql_set(column: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({column}), '[a-z0-9]+'))"


@query("multi_query", f"with {REWRITES_SQL} {sql_rewrites(1)}")
def multi_query(s: SparkSession, d: str) -> DataFrame:
    return providers.rewrites(asked(s, d), providers.RuleGenerator("rewrite"))


@query("decompose", f"with {REWRITES_SQL} {sql_rewrites(2)}")
def decompose(s: SparkSession, d: str) -> DataFrame:
    """Two parts or more take the place of a question; with fewer it stays whole."""
    return providers.rewrites(asked(s, d), providers.RuleGenerator("rewrite"), least=2)


@query("hyde", "select item_id as qid, 0::bigint as variant, text || ' ' || text as question from benchmark")
def hyde(s: SparkSession, d: str) -> DataFrame:
    return providers.rewrites(asked(s, d), providers.RuleGenerator("passage"))


@query("step_back", f"select qid, 0::bigint as variant, string_agg(w, ' ' order by r) as question from (select qid, w, row_number() over (partition by qid order by len(w) desc, w) as r from (select item_id as qid, unnest({PROMPT_WORDS}) as w from benchmark)) where r <= 5 group by qid")
def step_back(s: SparkSession, d: str) -> DataFrame:
    return providers.rewrites(asked(s, d), providers.RuleGenerator("step_back"))


@query("llm_call", "select item_id as qid, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 8), ' ') as reply from benchmark")
def llm_call(s: SparkSession, d: str) -> DataFrame:
    store = io.KeyedStore(s, io.scratch_dir(s))
    for _ in range(2):
        replied = providers.generate(asked(s, d), F.col("question"), providers.RuleGenerator("blurb"), store=store)
        replied.count()
    return replied.select("qid", "reply")


@query(
    "contextualize",
    f"with {FIXED_SQL}, p as (select f.doc_id, ord, chunk, array_to_string(list_slice({sql_words("substr(d.text, 1, 6000) || chr(10) || '---' || chr(10) || chunk")}, 1, 8), ' ') as blurb from fixed f join documents d using (doc_id)) "
    "select doc_id, ord, blurb, case when trim(blurb) = '' then chunk else blurb || chr(10) || chr(10) || chunk end as chunk from p",
)
def contextualize(s: SparkSession, d: str) -> DataFrame:
    chunks = chunking.apply(docs(s, d), chunking.fixed(F.col("text"))).select("doc_id", "ord", "chunk")
    return providers.contextualize(chunks, docs(s, d), providers.RuleGenerator("blurb"))


NEAR_SQL = f"with {FIRST_SQL}, near as (select qid, array_to_string(list('[' || rank || '] ' || text order by rank), chr(10) || chr(10)) as context, min_by(text, rank) as best from first join documents on id = doc_id where rank <= 3 group by qid), answered as (select item_id as qid, context, case when context is null then '{T.NO_ANSWER}' else split_part(best, chr(10), 1) end as answer from benchmark left join near on qid = item_id)"


@query("answer", f"{NEAR_SQL} select qid, answer, contains(answer, '{T.NO_ANSWER}') as abstained from answered")
def answer(s: SparkSession, d: str) -> DataFrame:
    near = ranking(s, d, k=3).join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id").select("qid", "rank", "text")
    return providers.answer(asked(s, d), near, providers.RuleGenerator("answer")).select("qid", "answer", "abstained")


@query("naive_rag", f"with {FIRST_SQL}, ctx as (select qid, array_to_string(list('- ' || text order by rank), chr(10)) as c from first join documents on id = doc_id where rank <= 3 group by qid) select qid, md5(text || chr(10) || c) as prompt from ctx join benchmark on qid = item_id")
def naive_rag(s: SparkSession, d: str) -> DataFrame:
    near = contexts(s, d).join(asked(s, d), "qid")
    return near.select("qid", F.md5(F.concat("question", F.lit("\n"), T.bulleted_context(F.col("xs")["text"]))).alias("prompt"))


@query("check_faithfulness", f"{NEAR_SQL} select qid, 2 * len(list_intersect({sql_set('answer')}, {sql_set('context')})) >= len({sql_set('answer')}) and len({sql_set('answer')}) > 0 as supported from answered where not contains(answer, '{T.NO_ANSWER}')")
def check_faithfulness(s: SparkSession, d: str) -> DataFrame:
    near = ranking(s, d, k=3).join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id").select("qid", "rank", "text")
    answered = providers.answer(asked(s, d), near, providers.RuleGenerator("answer")).where(~F.col("abstained"))
    return providers.judge(answered, "answer", "context", providers.RuleGenerator("yes_no"), limit=None).select("qid", F.col("relevant").alias("supported"))


CONDITIONS_SQL = f"""with {FIRST_SQL}, {QRELS_SQL}, cond as (
  select qid, 'gold' as condition, min(id) as id, 1::bigint as rank from qrels where grade > 0 group by qid
  union all select qid, 'distractor', id, r from (select qid, id, row_number() over (partition by qid order by rank) as r from first where rank <= 8 and (qid, id) not in (select (qid, id) from qrels)) where r <= 3 and qid in (select qid from qrels)
  union all select distinct qid, 'empty', null::bigint, 1::bigint from qrels)"""


def three(s: SparkSession, d: str) -> DataFrame:
    queries, rel = judged(s, d)
    return adaptive.conditions(ranking(s, d).join(queries.select("qid"), "qid", "left_semi"), rel)


@query("three_conditions", f"{CONDITIONS_SQL} select * from cond")
def three_conditions(s: SparkSession, d: str) -> DataFrame:
    return three(s, d)


@query(
    "verify_claim",
    f"""{CONDITIONS_SQL}, ev as (select qid, condition, array_to_string(list(coalesce(d.text, '') order by rank), chr(10)) as evidence from cond left join documents d on id = doc_id group by qid, condition),
sh as (select condition, a, b, case when len(list_distinct(list_concat(a, b))) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end as share from (select condition, {sql_set('text')} as a, {sql_set('evidence')} as b from ev join benchmark on item_id = qid))
select condition, count(*) as n, count(*) filter (where share > 0.05) as supported, count(*) filter (where share <= 0.05 and share >= 0.01) as refuted, count(*) filter (where share < 0.01) as not_enough, count(*) filter (where share > 0.05) as cited from sh group by condition""",
)
def verify_claim(s: SparkSession, d: str) -> DataFrame:
    rows = three(s, d).join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id", "left").join(asked(s, d), "qid")
    evidence = rows.groupBy("qid", "condition", F.col("question").alias("claim")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("evidence"))
    return providers.verify_claims(evidence, providers.RuleGenerator("claim"))


@query("should_retrieve", "select item_id as qid, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 4 as retrieve from benchmark")
def should_retrieve(s: SparkSession, d: str) -> DataFrame:
    replied = providers.generate(asked(s, d), F.col("question"), providers.RuleGenerator("route"))
    return replied.select("qid", F.coalesce(F.from_json("reply", "yes boolean")["yes"], F.lit(True)).alias("retrieve"))


@query("grade_relevance", f"with {FIRST_SQL} select qid, id, 2 * len(list_intersect(a, b)) >= len(a) and len(a) > 0 as relevant from (select qid, id, {sql_set('q.text')} as a, {sql_set('substr(d.text, 1, 1500)')} as b from first join benchmark q on item_id = qid join documents d on doc_id = id where rank <= 5)")
def grade_relevance(s: SparkSession, d: str) -> DataFrame:
    near = ranking(s, d, k=5).join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id").join(asked(s, d), "qid")
    return providers.judge(near, "question", "text", providers.RuleGenerator("yes_no")).select("qid", "id", "relevant")


@query(
    "next_hop",
    f"""{CONTEXT_SQL}, t as (select item_id as qid, regexp_extract_all(lower(text || chr(10) || chr(10) || coalesce(array_to_string(bullets, chr(10)), '')), '[a-z0-9]+') as t from benchmark left join ctx on qid = item_id)
select qid, len(t) > 400 as have_enough, array_to_string(list_slice(t, greatest(1, len(t) - 5), len(t)), ' ') as next_query from t""",
)
def next_hop(s: SparkSession, d: str) -> DataFrame:
    """Whether the evidence so far is enough, and what to search next, from the question and its evidence."""
    near = asked(s, d).join(contexts(s, d), "qid", "left").withColumn("evidence", F.coalesce(T.bulleted_context(F.col("xs")["text"]), F.lit("")))
    replied = providers.generate(near, F.concat("question", F.lit("\n\n"), "evidence"), providers.RuleGenerator("next"))
    read = F.from_json("reply", "have_enough boolean, next_query string")
    return replied.select("qid", F.coalesce(read["have_enough"], F.lit(True)).alias("have_enough"), read["next_query"].alias("next_query"))


GRADES_SQL = f"{FIRST_SQL}, g as (select f.qid, quality = 1 as relevant from first f join labels l on f.id = l.doc_id where f.rank <= 5)"
TRIAGE_SQL = "tri as (select item_id as qid, count(relevant) filter (where relevant) as kept, count(relevant) as total from benchmark left join g on qid = item_id group by item_id), triaged as (select qid, kept, total, case when kept = 0 then 'incorrect' when kept >= 0.5 * total then 'correct' else 'ambiguous' end as triage from tri)"


def graded(s: SparkSession, d: str) -> DataFrame:
    marks = io.table(s, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("relevant"))
    return adaptive.triage(asked(s, d), ranking(s, d, k=5).join(marks, "id").select("qid", "relevant"))


@query("crag_triage", f"with {GRADES_SQL}, {TRIAGE_SQL} select * from triaged")
def crag_triage(s: SparkSession, d: str) -> DataFrame:
    return graded(s, d)


@query("crag_split", f"with {FIRST_SQL}, {QRELS_SQL} select qid, qid in (select qid from first join qrels using (qid, id) where rank <= 5) as succeeded from ({JUDGED_SQL})")
def crag_split(s: SparkSession, d: str) -> DataFrame:
    queries, rel = judged(s, d)
    return adaptive.split_by_success(queries, ranking(s, d), rel)


@query(
    "balanced_accuracy",
    f"with {GRADES_SQL}, {TRIAGE_SQL}, {QRELS_SQL}, r as (select qid, triage, qid in (select qid from first join qrels using (qid, id) where rank <= 5) as ok from triaged where qid in (select qid from qrels)), "
    "h as (select count(*) filter (where ok and triage = 'correct') / greatest(1, count(*) filter (where ok))::double as a, count(*) filter (where not ok and triage <> 'correct') / greatest(1, count(*) filter (where not ok))::double as b from r) "
    "select round(a, 6) as hit_ok, round(b, 6) as hit_bad, round(b - (1 - a), 6) as separation, round((a + b) / 2, 6) as balanced from h",
)
def balanced_accuracy(s: SparkSession, d: str) -> DataFrame:
    return stats.balanced_accuracy(graded(s, d).join(crag_split(s, d), "qid"))


@query("multi_hop")
def multi_hop(s: SparkSession, d: str) -> DataFrame:
    corpus = docs(s, d)
    _, trace = adaptive.multi_hop(asked(s, d), corpus, lambda q, k: lexical.search(q, corpus, k), providers.RuleGenerator("next"))
    return trace


@query("generate_evalset", f"with {REWRITES_SQL} select qid, case variant when 0 then 'direct' else 'paraphrased' end as variant, question from ({sql_rewrites(1)})")
def generate_evalset(s: SparkSession, d: str) -> DataFrame:
    made = providers.rewrites(asked(s, d), providers.RuleGenerator("rewrite"))
    return made.select("qid", F.when(F.col("variant") == 0, "direct").otherwise("paraphrased").alias("variant"), "question")


# -- graph -------------------------------------------------------------------------------------------------------------


def triples(s: SparkSession, d: str) -> DataFrame:
    """The star schema as a graph: customers and suppliers in nations, nations in regions."""
    nation = F.concat(F.lit("nation "), F.col("n_nationkey").cast("string"))
    c = io.table(s, d, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("subj"), F.lit("lives in").alias("rel"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("obj"), F.col("c_custkey").alias("doc_id"))
    p = io.table(s, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("subj"), F.lit("supplier in").alias("rel"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("obj"), F.col("s_suppkey").alias("doc_id"))
    n = io.table(s, d, "nation").select(nation.alias("subj"), F.lit("part of").alias("rel"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("obj"), F.col("n_nationkey").cast("bigint").alias("doc_id"))
    return graph.clean(c.unionByName(p).unionByName(n))


TRIPLES_SQL = """tri as materialized (select 'customer ' || c_custkey as subj, 'lives in' as rel, 'nation ' || c_nationkey as obj, c_custkey as doc_id from customer
  union all select 'supplier ' || s_suppkey, 'supplier in', 'nation ' || s_nationkey, s_suppkey from supplier
  union all select 'nation ' || n_nationkey, 'part of', 'region ' || n_regionkey, n_nationkey::bigint from nation),
adj as materialized (select subj as node, obj as neighbour from tri union select obj, subj from tri)"""


def regions(s: SparkSession, d: str) -> DataFrame:
    """Fixed communities: a node belongs to its nation's region."""
    n = io.table(s, d, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("obj"), F.col("n_regionkey").cast("bigint").alias("community"))
    ends = triples(s, d).join(n, "obj").select(F.col("subj").alias("node"), "community")
    region = n.select(F.concat(F.lit("region "), F.col("community").cast("string")).alias("node"), "community").distinct()
    return n.select(F.col("obj").alias("node"), "community").unionByName(ends).unionByName(region)


REGIONS_SQL = """nat as (select 'nation ' || n_nationkey as node, n_regionkey::bigint as community from nation),
mem as materialized (select * from nat union all select subj, community from tri join nat on obj = node union all select distinct 'region ' || community, community from nat)"""


@query("graph_extract")
def graph_extract(s: SparkSession, d: str) -> DataFrame:
    return graph.extract(docs(s, d), providers.RuleGenerator("triples"))


@query("graph_adjacency", f"with {TRIPLES_SQL} select * from adj")
def graph_adjacency(s: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(triples(s, d))


@query("label_propagation")
def label_propagation(s: SparkSession, d: str) -> DataFrame:
    return graph.communities(triples(s, d))


@query("community_facts", f"with {TRIPLES_SQL}, {REGIONS_SQL}, f as (select distinct community, doc_id, subj, rel, obj from tri join mem on node = subj or node = obj) select community, r as ord, subj || ' --' || rel || '--> ' || obj as fact from (select *, row_number() over (partition by community order by doc_id, subj, rel, obj) as r from f) where r <= 25")
def community_facts(s: SparkSession, d: str) -> DataFrame:
    return graph.community_facts(triples(s, d).withColumn("ord", F.col("doc_id")), regions(s, d))


@query("community_summaries")
def community_summaries(s: SparkSession, d: str) -> DataFrame:
    members = io.cut(regions(s, d))
    facts = graph.community_facts(triples(s, d).withColumn("ord", F.col("doc_id")), members)
    return graph.community_summaries(facts, members, providers.RuleGenerator("blurb"))


@query("local_search", f"with {TRIPLES_SQL}, s0 as (select distinct node from adj where node in ('region 1', 'nation 3')), s1 as (select node from s0 union select neighbour from adj join s0 using (node)), s2 as (select node from s1 union select neighbour from adj join s1 using (node)) select subj, rel, obj, doc_id from tri where subj in (select node from s2) and obj in (select node from s2)")
def local_search(s: SparkSession, d: str) -> DataFrame:
    entities = s.createDataFrame([("Region 1",), ("NATION 3",), ("nowhere",)], "node string")
    return graph.local_search(triples(s, d), entities, 2).select("subj", "rel", "obj", "doc_id")


@query("docs_for_entities", f"with {TRIPLES_SQL} select distinct doc_id from tri where subj in ('nation 3', 'region 1') or obj in ('nation 3', 'region 1')")
def docs_for_entities(s: SparkSession, d: str) -> DataFrame:
    return graph.docs_for_entities(triples(s, d), s.createDataFrame([("Region 1",), ("NATION 3",)], "node string"))


@query("graph_stats", f"with {TRIPLES_SQL}, {REGIONS_SQL} select (select count(*) from tri) as triples, (select count(distinct node) from adj) as entities, (select count(distinct community) from mem) as communities, (select max(n) from (select count(*) as n from mem group by community)) as largest_community")
def graph_stats(s: SparkSession, d: str) -> DataFrame:
    return graph.stats(triples(s, d), regions(s, d))


# -- further operators -------------------------------------------------------------------------------------------------


@query("metadata_filter", sql_top(f"select a.vec_id as qid, b.vec_id as id, round({DOT}, 6) as score from (select * from embeddings where vec_id % 50 = 0) a, (select * from embeddings where label = 1) b", 5))
def metadata_filter(s: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of one label; the label is filtered in the scan, before anything is ranked."""
    return dense.search(vector_queries(s, d), vectors(s, d).where("label = 1"), 5)


@query("history_context", "select conv_id, turn, array_to_string(list(role || ': ' || text) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding), chr(10)) as history from conversations")
def history_context(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    said = F.concat("role", F.lit(": "), "text")
    rows = io.table(s, d, "conversations").withColumn("h", F.collect_list(said).over(w))
    return rows.select("conv_id", "turn", F.when(F.size("h") > 0, F.array_join("h", "\n")).alias("history"))


@query("quantize_int8", "select vec_id as id, list_sum(list_transform(embedding, lambda x: round(x::double * 127)))::bigint as total from embeddings")
def quantize_int8(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).select("id", F.aggregate(dense.quantize(F.col("v")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


INT8_SQL = "select vec_id, list_transform(embedding, lambda x: round(x::double * 127)) as embedding from embeddings"


@query(
    "quantize_int8_recall",
    f"with e as ({sql_dense(10)}), z as ({INT8_SQL}), i as ({sql_top(f'select a.vec_id as qid, b.vec_id as id, {DOT} as score from (select * from z where vec_id % 50 = 0) a, z b', 10)}) "
    "select qid, count(i.id)::bigint as found, round(count(i.id) / count(*), 6) as recall from e left join i using (qid, id) group by qid",
)
def quantize_int8_recall(s: SparkSession, d: str) -> DataFrame:
    """For each query, the share of its exact best ten that a search over whole numbers of eight bits finds too."""
    small = lambda df: df.withColumn("v", dense.quantize(F.col("v")))
    exact = dense.search(vector_queries(s, d), vectors(s, d), 10)
    found = dense.search(small(vector_queries(s, d)), small(vectors(s, d)), 10).select("qid", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query("small_to_big", f"with {FIXED_SQL} select doc_id || '#' || ord as chunk_id, doc_id, length(text)::bigint as parent_chars from fixed join documents using (doc_id)")
def small_to_big(s: SparkSession, d: str) -> DataFrame:
    chunks = chunking.apply(docs(s, d).select("doc_id", "text"), chunking.fixed(F.col("text"))).select("chunk_id", "doc_id")
    return chunks.join(docs(s, d).select("doc_id", F.length("text").cast("bigint").alias("parent_chars")), "doc_id")


@query("incremental_ingest", f"with {BM25_SQL} select term, sum(tf)::bigint as tf, count(*) as df from tf group by term")
def incremental_ingest(s: SparkSession, d: str) -> DataFrame:
    """The corpus read as a stream of new files into a stored index."""
    path, checkpoint_dir = io.scratch_dir(s), io.scratch_dir(s)
    source = io.cut_path(docs(s, d).select("doc_id", "text"))
    stream = s.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 4).parquet(source)
    ingest.index_stream(stream, path, checkpoint_dir).awaitTermination()
    postings, _ = ingest.read_index(s, path)
    return postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
