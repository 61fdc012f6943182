import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import chunking


def _chunks(spark, text, column):
    row = spark.createDataFrame([("d", text)], "doc_id string, text string").select(column(F.col("text")).alias("c")).first()
    return row["c"]


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    got = spark.createDataFrame([("The BRCA1 gene, in mice! gene",), (None,)], "t string").select(T.tokenize(F.col("t")).alias("x")).collect()
    assert got[0]["x"] == ["brca1", "gene", "mice", "gene"]
    assert got[1]["x"] == []


def test_short_text_stays_as_it_is(spark):
    assert _chunks(spark, "a  b c", lambda c: chunking.fixed(c, 10, 2)) == ["a  b c"]


def test_fixed_windows_by_place(spark):
    w = [f"n{i}" for i in range(23)]
    got = _chunks(spark, "  ".join(w), lambda c: chunking.fixed(c, 7, 3))
    assert got == [" ".join(w[a : a + 7]) for a in (0, 4, 8, 12, 16, 20)]  # the last has three words, as many as overlap
    assert _chunks(spark, " ".join(w[:22]), lambda c: chunking.fixed(c, 7, 3)) == got[:4] + [" ".join(w[16:22])]
    assert chunking.windows(w, 7, 3) == got and chunking.windows(w[:22], 7, 3)[-1] == " ".join(w[16:22])


def test_sentence_chunks_by_hand(spark):
    text = "Rain fell. It fell on roofs all night! Did anyone hear? (Nobody did.) Morning came."
    by = lambda size, overlap: _chunks(spark, text, lambda c: chunking.sentence(c, size, overlap))
    assert by(5, 0) == ["Rain fell.", "It fell on roofs all night!", "Did anyone hear?", "(Nobody did.) Morning came."]
    assert by(5, 1)[:3] == ["Rain fell.", "Rain fell. It fell on roofs all night!", "It fell on roofs all night! Did anyone hear?"]
    assert by(100, 2) == [text] and _chunks(spark, None, lambda c: chunking.sentence(c, 5, 1)) == [None]


def test_a_batch_of_texts_is_packed_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(chunking, "sentences", lambda c: c)
    monkeypatch.setattr(chunking.F, "arrow_udf", lambda kind: lambda f: (seen.append(f), lambda c: F.split(c, " "))[1])
    chunking.sentence(F.col("text"), 3, 1)
    texts = [["one two three.", "Four."], [], ["x" * 300_000]] * 20
    made = list(seen[0](iter([pa.array(texts, pa.list_(pa.string()))])))
    assert [c for m in made for c in m.to_pylist()] == [chunking.pack_sentences(t, 3, 1) for t in texts]
    assert max(m.nbytes for m in made) < 2_000_000


@given(st.lists(st.integers(1, 9), max_size=25), st.integers(1, 20), st.integers(0, 3))
def test_packed_sentences_are_as_long_as_they_can_be(lengths, size, overlap):
    items = [" ".join([f"s{i}"] * n) for i, n in enumerate(lengths)]
    spans = [sorted({int(w[1:]) for w in c.split()}) for c in chunking.pack_sentences(items, size, overlap)]
    assert sorted({i for x in spans for i in x}) == list(range(len(items)))
    for k, x in enumerate(spans):
        assert x == list(range(x[0], x[-1] + 1))
        new = x if not k else [i for i in x if i > spans[k - 1][-1]]
        assert new and (len(new) == 1 or sum(lengths[i] for i in x) <= size)
        if k:
            assert x[0] == max(spans[k - 1][0], spans[k - 1][-1] + 1 - overlap)
        if k + 1 < len(spans):
            assert sum(lengths[i] for i in [*x, x[-1] + 1]) > size


def test_recursive_by_hand():
    cut = lambda text, size: chunking.cut_recursive(text, size, 1)
    assert cut("one two", 2) == ["one two"] and cut("", 2) == [""] and cut("   ", 0) == ["   "]
    assert cut("a b\n\nc\n\nd e f", 3) == ["a b\n\nc", "d e f"]
    assert cut("a b\nc d\n\ne", 3) == ["a b", "c d", "e"]  # the long paragraph goes on to lines, the short one is not merged into it
    assert cut("\n\n\n\na b c", 2) == ["a b", "c"]
    assert cut("p q. r s. t", 4) == ["p q. r s", "t"]
    assert cut("p . q. r", 3) == ["p . q", "r"]
    assert cut("p q . r s", 4) == ["p q ", "r s"]  # joined, the dot would be a fifth word
    assert cut("u\tv\tw\tx", 3) == ["u v w", "w x"]  # no separator at all: windows of words


_pieces = st.lists(st.tuples(st.sampled_from(["a", "bb", "c c", "d d d", "", " "]), st.sampled_from(["\n\n", "\n", ". ", " ", "\t"])), max_size=30)


@given(_pieces, st.integers(1, 8))
def test_recursive_keeps_every_word_in_order_and_the_size(pieces, size):
    text = "".join(a + b for a, b in pieces)
    chunks = chunking.cut_recursive(text, size, 0)
    assert re.findall(r"\w+", " ".join(chunks)) == re.findall(r"\w+", text)
    assert all(len(c.split()) <= size for c in chunks)
    if len(text.split()) > size:
        assert all(c.strip() for c in chunks)


def test_recursive_cuts_each_row_for_itself(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, None)], "doc_id int, text string")
    got = [tuple(r) for r in chunking.recursive(docs, "doc_id", "text", 1).collect()]
    assert sorted(got) == [(1, 0, "a"), (1, 0, "c"), (1, 1, "b"), (1, 1, "d"), (2, 0, "")]


def test_chunk_ids(spark):
    docs = spark.createDataFrame([("x", "k " * 9), ("y", "k")], "doc_id string, text string")
    got = chunking.apply(docs, chunking.fixed(F.col("text"), 4, 1)).select("chunk_id", "ord").orderBy("chunk_id").collect()
    assert [tuple(r) for r in got] == [("x#0", 0), ("x#1", 1), ("x#2", 2), ("y#0", 0)]
