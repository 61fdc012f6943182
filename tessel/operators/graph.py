"""Operators over a graph of triples (subj, rel, obj, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.providers import generate
from tessel.sources.io import cut


def clean(triples: DataFrame) -> DataFrame:
    """Lower-cased, stripped ends; empty ones and loops left out."""
    rows = triples.withColumn("subj", F.lower(F.trim("subj"))).withColumn("obj", F.lower(F.trim("obj"))).withColumn("rel", F.lower(F.trim("rel")))
    return rows.where("subj <> '' and obj <> '' and subj <> obj")


def extract(documents: DataFrame, provider, limit: int = 3000) -> DataFrame:
    """Triples that the model finds in (doc_id, text)."""
    replied = generate(documents.select("doc_id", "text"), F.substring("text", 1, limit), provider)
    found = F.from_json("reply", "triples array<struct<subject:string,relation:string,object:string>>")["triples"]
    rows = replied.select("doc_id", F.explode(found).alias("x"))
    return clean(rows.select(F.col("x.subject").alias("subj"), F.col("x.relation").alias("rel"), F.col("x.object").alias("obj"), "doc_id"))


def adjacency(triples: DataFrame) -> DataFrame:
    """(node, neighbour), both ways, each once."""
    a = triples.select(F.col("subj").alias("node"), F.col("obj").alias("neighbour"))
    return a.unionByName(a.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))).distinct()


def communities(triples: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community) by synchronous label propagation: each node takes the most frequent label around it, its own counting once,
    the least of equals. Stops when nothing changes; communities are numbered from 0 by their least member label.

    Every round is written to the shared folder.
    """
    edges = cut(adjacency(triples))
    labels = cut(edges.select("node", F.col("node").alias("label")).distinct())
    order = Window.partitionBy("node").orderBy(F.desc("c"), "label")
    for _ in range(rounds):
        votes = edges.join(labels.withColumnRenamed("node", "neighbour"), "neighbour").select("node", "label").unionByName(labels)
        counted = votes.groupBy("node", "label").agg(F.count("*").alias("c"))
        new = cut(counted.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("node", "label"))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            break
    return labels.join(number(labels.select("label").distinct(), "label", "community"), "label").select("node", "community")


def number(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with their place in order, from 0: ranges are counted, and each numbers its own keys after those before."""
    ranged = cut(keys.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")  # a row for each range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return ranged.join(before, "_p").select(key, (own - 1 + F.col("_b")).cast("bigint").alias(name))


def community_facts(triples: DataFrame, members: DataFrame, limit: int = 25, order: str = "ord") -> DataFrame:
    """(community, ord, fact): the first ``limit`` triples with an end in the community, by ``order``."""
    t = triples.select("subj", "rel", "obj", order)
    ends = t.join(members.withColumnRenamed("node", "subj"), "subj").select(order, "subj", "rel", "obj", "community").unionByName(t.join(members.withColumnRenamed("node", "obj"), "obj").select(order, "subj", "rel", "obj", "community")).distinct()
    w = Window.partitionBy("community").orderBy(order, "subj", "rel", "obj")
    rows = ends.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return rows.select("community", F.col("_r").cast("bigint").alias("ord"), F.concat("subj", F.lit(" --"), "rel", F.lit("--> "), "obj").alias("fact"))


def community_summaries(facts: DataFrame, members: DataFrame, provider, least: int = 3) -> DataFrame:
    """(community, summary) of communities with ``least`` members or more."""
    large = members.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    texts = facts.join(large, "community", "left_semi").groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "fact"))), lambda x: x["fact"]), "\n").alias("facts"))
    return generate(texts, F.col("facts"), provider, "summary").select("community", "summary")


def local_search(triples: DataFrame, entities: DataFrame, hops: int = 1) -> DataFrame:
    """Triples with both ends within ``hops`` steps of an entity (node) that the graph has."""
    edges = adjacency(triples)
    seen = edges.join(entities.select(F.lower("node").alias("node")).distinct(), "node", "left_semi").select("node").distinct()
    for _ in range(hops):
        near = edges.join(seen, "node", "left_semi").select(F.col("neighbour").alias("node"))
        seen = seen.unionByName(near).distinct()
    inside = triples.join(seen.withColumnRenamed("node", "subj"), "subj", "left_semi")
    return inside.join(seen.withColumnRenamed("node", "obj"), "obj", "left_semi").select(*triples.columns)


def docs_for_entities(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct doc_id of triples that touch an entity."""
    e = entities.select(F.lower("node").alias("node")).distinct()
    a = triples.join(e.withColumnRenamed("node", "subj"), "subj", "left_semi").select("doc_id")
    b = triples.join(e.withColumnRenamed("node", "obj"), "obj", "left_semi").select("doc_id")
    return a.unionByName(b).distinct()


def stats(triples: DataFrame, members: DataFrame) -> DataFrame:
    """One row: triples, entities, communities, largest_community."""
    sizes = members.groupBy("community").agg(F.count("*").alias("c")).agg(F.count("*").alias("communities"), F.coalesce(F.max("c"), F.lit(0)).alias("largest_community"))
    nodes = triples.select(F.col("subj").alias("n")).unionByName(triples.select(F.col("obj").alias("n"))).distinct().agg(F.count("*").alias("entities"))
    return triples.agg(F.count("*").alias("triples")).crossJoin(nodes).crossJoin(sizes)  # one row each
