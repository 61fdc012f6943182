"""The pipeline's stages, one by one, against their rules."""

import collections
import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import _removed, _shingles
from tokenizers import Tokenizer

from tessel.llm import ngram_join, quality_classifier
from tessel.llm.common import documents, labels, materialize

SF = "/root/testdata/sf0.001"


def test_stages_pass_on_what_they_keep(spark):
    docs = documents(spark, SF)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF))
        assert out.columns == corpus_pipeline.COLUMNS and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before, name
        if name == "quality classifier":
            lost = before - set(ids)
            assert not [i for i in lost if labels.get(i) == 1] and [i for i in lost if labels.get(i) == 0]
        if name == "exact dedup":
            texts = [r["text"] for r in out.collect()]
            assert len({"".join(t.split()) for t in texts}) == len(texts)
        if name == "suffix-array dedup":
            assert set(ids) == before
            for r in out.orderBy("doc_id").collect():
                assert r["n_chars"] == len(r["text"])
        docs, before = out, set(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == before


def test_near_copies_are_ordered_by_counts_of_every_document(spark, monkeypatch):
    class Counted(Exception):
        pass

    def seen(counts):
        raise Counted(int(counts.sum()))

    monkeypatch.setattr(ngram_join, "cut_order", seen)
    docs = spark.range(21_000).selectExpr("id as doc_id", "concat_ws(' ', 'a', 'b', 'c', 'd', 'e', id) as text", "'en' as lang", "'web' as source", "9L as n_chars")
    with pytest.raises(Counted) as got:
        corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.value.args == (2 * 21_000,)


def _texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def _one_of_near_copies(texts):
    sets = {i: _shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(i), find(j)
                least[max(u, v)] = min(u, v)
    return {i for i in ids if find(i) == i}


def _assert_packed(pieces, texts):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array([*tk.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_stages_and_run_equal_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, SF)
    scored = quality_classifier.classify(docs, quality_classifier.fit(docs, labels(spark, SF))).collect()
    left = materialize(stages["quality classifier"](spark, docs, SF))
    texts = _texts(docs)
    assert _texts(left) == {i: texts[i] for i in {r["doc_id"] for r in scored if r["score"] >= 0.3}}

    texts, docs = _texts(left), left
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    left = materialize(stages["exact dedup"](spark, docs, SF))
    assert _texts(left) == {i: texts[i] for _, i in map(min, groups.values())}

    texts, docs = _texts(left), left
    left = materialize(stages["n-gram Jaccard join"](spark, docs, SF))
    assert _texts(left) == {i: texts[i] for i in _one_of_near_copies(texts)}

    texts, docs = _texts(left), left
    left = materialize(stages["suffix-array dedup"](spark, docs, SF))
    want = {r[0]: (r[2], r[4]) for r in _removed(list(texts.items()))}
    assert any(n for n, _ in want.values())
    got = _texts(left)
    assert got.keys() == want.keys()
    for i, t in got.items():
        cut = len(texts[i].encode()) - want[i][0] - len(t.encode())
        assert hashlib.sha256(t.encode()).hexdigest() == want[i][1] if not cut else 0 < cut < 4 * 50

    _assert_packed(stages["packing"](spark, left, SF).collect(), got)
    _assert_packed(corpus_pipeline.run(spark, SF).collect(), got)
