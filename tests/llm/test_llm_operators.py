"""Operators against brute force on small fixtures with nulls, empties, ties, repeated rows and long texts."""

import collections
import hashlib
import math
import re
import unicodedata
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessel.llm import exact_dedup, language_id, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COMMON = "the of and to a in is that it for was on with as be by".split()


def _texts(n=60, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = [COMMON[rng.integers(len(COMMON))] if rng.random() < 0.4 else "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(int(rng.integers(3, 200)))]
        out.append(" ".join(words))
    shared = " ".join(f"passage{i}" for i in range(30))
    out[5] = out[4]
    out[6] = out[4].replace(" the ", " THE ", 1)
    out[7] = out[8] + " " + shared
    out[9] = shared + "\n" + out[10]
    out[11] = out[12][:-3]
    return [*out, None, "", " \n\t", "one", "a b c", "é ü 漢字 😀 ﬁ", out[20] * 30]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, 1) for i, t in enumerate(_texts())]
    rows += [(3, rows[3][1], "en", "s0", 5, 2), (None, "null id " * 30, "en", "s0", 5, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint").repartition(3).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_quality_rules_measures(docs, local, empty):
    got = collections.defaultdict(list)
    for r in quality_rules.quality_rules(docs).collect():
        got[r["doc_id"]].append(r)
    for i, t in local:
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        for r in got[i]:
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(covered), failed)
            assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
            assert not (failed and r["kept"])
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_tell_symbol_spam(spark):
    good = " ".join(["the", "stone", "of", "house", "and", "tree"][i % 6] + str("abc"[i % 3]) for i in range(90))
    good = "The " + " ".join(f"{a} {b}" for a, b in zip(COMMON * 8, [f"{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}wor" for i in range(128)], strict=True)) + "."
    bad = " ".join(w + "***" for w in good.split())
    rows = quality_rules.quality_rules(spark.createDataFrame([(1, good), (2, bad)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False]


def test_language_spans_and_undetermined(spark):
    en = [f"the house of the {w} and that was with this" for w in "river stone table window garden field".split()]
    de = [f"der garten und die {w} ist nicht mit dem" for w in "strasse schule wolke brücke mauer wiese".split()]
    rows = [(i, t, "en") for i, t in enumerate(en * 4)] + [(100 + i, t, "de") for i, t in enumerate(de * 4)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(table, F.lit(True))
    mixed = " ".join(en[:3]) + " " + " ".join(de[:2])
    ask = spark.createDataFrame([(1, mixed), (2, None), (3, "123 !!"), (4, de[0]), (5, "привет мир"), (6, "½ ² ① Ⅷ"), (7, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in language_id.identify(ask, model).collect()}
    assert got[1]["lang_pred"] == "en" and [s["lang"] for s in got[1]["spans"]] == ["en", "de"]
    assert {got[i]["lang_pred"] for i in (2, 3, 6, 7)} == {"und"} and got[4]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(ask, language_id.fit(table.limit(0), F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_letters_are_those_of_unicode():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    lower = [c for c in every if c.lower() == c]
    assert set("".join(language_id.letters("".join(lower)))) == {c for c in lower if unicodedata.category(c)[0] == "L"}
    assert language_id.letters("a½b Ⅷ c_d é2") == ["a", "b", "c", "d", "é"] and language_id.letters(None) == []


def _best_path(scores, switch):
    n, k = scores.shape
    best = {(0, j): (scores[0, j], [j]) for j in range(k)}
    for i in range(1, n):
        for j in range(k):
            v, path = max(((best[i - 1, p][0] - switch * (p != j), best[i - 1, p][1]) for p in range(k)), key=lambda x: x[0])
            best[i, j] = (v + scores[i, j], [*path, j])
    return max(best[n - 1, j][0] for j in range(k))


def test_viterbi_reaches_the_best_sum():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = -rng.exponential(3.0, (int(rng.integers(1, 40)), 3))
        path = language_id.viterbi(s, 6.0)
        value = s[np.arange(len(s)), path].sum() - 6.0 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(_best_path(s, 6.0))


def test_languages_equal_a_plain_count(spark):
    samples = {"en": "the river and the stone of that house with this", "de": "der garten und die strasse ist nicht mit dem", "fr": "la maison et les jardins dans une rue avec"}
    rows = [(i * 10 + k, " ".join(t.split()[k:] + t.split()[:k]), x) for i, (x, t) in enumerate(samples.items()) for k in range(8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert model.languages == ("de", "en", "fr")
    slot = lambda n, four: ((n + four * (1 << 40)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - language_id.TABLE_BITS

    def grams(word):
        raw = b"   " + word.encode() + b"       "
        size = len(word.encode()) + 3
        return [slot(int.from_bytes(raw[p : p + 3], "big"), 0) for p in range(size)] + [slot(int.from_bytes(raw[p : p + 4], "big"), 1) for p in range(size)]

    counts = {x: collections.Counter() for x in samples}
    for _, t, x in rows:
        words = t.split()
        for k, w in enumerate(words):  # the last 4-grams of a word see three blanks and the next word's first byte
            after = ("   " + words[k + 1]) if k + 1 < len(words) else "    "
            raw = b"   " + w.encode() + after.encode()
            size = len(w.encode()) + 3
            counts[x].update([slot(int.from_bytes(raw[p : p + 3], "big"), 0) for p in range(size)] + [slot(int.from_bytes(raw[p : p + 4], "big"), 1) for p in range(size)])
    size = 1 << language_id.TABLE_BITS

    def logs(x, g):
        return math.log((counts[x][g] + 0.05) / (counts[x].total() + 0.05 * size))

    for w in ("river", "strasse", "jardins", "zzz"):
        raw = np.array([sum(logs(x, g) for g in grams(w)) for x in model.languages])
        assert model.score_words([w])[0] == pytest.approx(np.maximum(raw - raw.max(), -language_id.WORD_CAP), abs=1e-3)


def _shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_equal_all_pairs(spark, docs, local, empty):
    rng = np.random.default_rng(9)
    family = [f"f{i}" for i in range(80)]
    extra = []
    for i in range(70):  # a large family around one text, links and near misses among them
        w = list(family)
        for p in rng.choice(80, int(rng.integers(1, 4)), replace=False):
            w[p] = f"x{i}_{p}"
        extra.append((1000 + i, " ".join(w)))
    every = [*local, *extra]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    sets = [(i, _shingles(t)) for i, t in every]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    got = ngram_join.near_duplicates(table).collect()
    assert len(got) == len(every)
    by_id = {i: len(s) for i, s in sets}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (by_id[r["doc_id"]], find(r["doc_id"]))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and 9 * shared >= 4 * (len(a) + len(b)):
            counts = [ngram_join.range_counts(x)[None, :] for x in (a, b)]
            assert ngram_join.may_link(*counts, np.array([len(a)]), np.array([len(b)]))[0]
            assert ngram_join.bits_allow(ngram_join.bit_map(a), ngram_join.bit_map(b), len(a), len(b))


def test_classifier_learns_and_compiles_rules(spark, empty):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = " ".join((f"word{i}x{k}***" if bad else f"word{i} of{k}") for k in range(30))
        rows.append((i, t))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality_classifier.fit(docs, marks)
    assert 0 < len(model.rules)
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, model).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["score"] == got[901]["score"]
    assert {r["doc_id"] for r in got.values() if r["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert quality_classifier.classify(empty, model).count() == 0
    assert quality_classifier.fit(docs, marks.where("quality = 1")).rules == ()


def test_classifier_equals_its_rules_read_plainly(docs, local):
    f = quality_classifier.FEATURES
    rules = (((("log_words", True, 2.5),), 1.25), ((("distinct", False, 0.9), ("word_length", True, 4.0)), -0.75), ((("wide", True, 0.01),), 0.5), ((("lines", False, 0.0), ("twin", True, 0.02)), -1.5))
    model = quality_classifier.RuleModel(0.2, rules)
    got = collections.defaultdict(list)
    for r in quality_classifier.classify(docs, model).collect():
        got[r["doc_id"]].append(r)
    for i, t in local:
        t = t or ""
        w = re.split(r"[\x20\x09-\x0D]+", t)
        chars, n = max(len(t), 1), len(w)
        share = lambda p, t=t, chars=chars: len(re.findall(p, t)) / chars
        x = {"log_words": math.log1p(n), "word_length": len(t) / n, "upper": share("[A-Z]"), "digit": share("[0-9]"), "symbol": share(r"[#*$%&|<>@=_{}]"), "punct": share(r"[.,;:?'\"()-]"), "loud": share("!"), "bar": share(r"\|"), "lines": t.count("\n") / n, "distinct": len(set(w)) / n, "twin": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "wide": (len(t.encode()) - len(t)) / chars}
        assert set(x) == set(f)
        z = 0.2 + sum(v for rule, v in rules if all((x[k] > h) == up for k, up, h in rule))
        assert any(r["score"] == pytest.approx(1 / (1 + math.exp(-z))) and r["predicted"] == int(1 / (1 + math.exp(-z)) >= 0.3) for r in got[i])


def test_sentencepiece_equals_the_library(docs, local, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sentencepiece_codec.ChunkCodec(path).chunked
    odd = [" ", "  a  b ", "a\n b\n\nc ", "▁x ▁", "\x00a", "<s>x</s>", "ﬁ Å", " \n ", "ab▁cd", "a b　c", "x" * 3000, "\r\n\t"]
    codec = sentencepiece_codec.ChunkCodec(path, table_size=20)
    for t in [*odd, *[t or "" for _, t in local]]:
        ids = sp.encode(t)
        assert codec.encode(t) == (",".join(map(str, ids)), len(ids), sp.decode(ids))
    got = sentencepiece_codec.encode_decode(docs, path).collect()
    want = collections.Counter((i, hashlib.sha256(",".join(map(str, sp.encode(t or ""))).encode()).hexdigest()) for i, t in local)
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in got) == want
    assert sentencepiece_codec.encode_decode(empty, path).count() == 0


def test_toxicity_folds_and_spares(spark, empty):
    clean = "we walked to the river and saw the old bridge"
    rows = [(i, clean + f" on day {i}") for i in range(200)] + [(1000 + i, f"you are a stupid moron on day {i} {clean}") for i in range(60)]
    marks = [(i, int(i >= 1000)) for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    assert any("moron" in p for p, _ in lexicon.weights)
    ask = [(1, "what a m0r0n you are"), (2, "mоrоn said so"), (3, clean), (4, None), (5, ""), (6, "$tupid thing")]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(ask, "doc_id bigint, text string"), lexicon).collect()}
    assert [got[i]["predicted"] for i in range(1, 7)] == [1, 1, 0, 0, 0, 1]
    spared = toxicity.Lexicon(((" trash ", 5.0),), 0.005, ("trash can",))
    assert spared.weigh("put it in the trash can now")[1] == 0 and spared.weigh("this is trash")[1] == 1
    assert toxicity.score_toxicity(empty, lexicon).count() == 0


def _plain_density(lexicon, text):
    """Weights of all entries at all places, words of folded text by words."""
    folded = toxicity.fold(text)
    spans = [(m.start(), m.start() + len(p)) for p in (toxicity.fold(x) for x in lexicon.exceptions) for m in re.finditer(f"(?={re.escape(p)})", folded)]
    total = 0.0
    for entry, weight in lexicon.weights:
        for m in re.finditer(f"(?={re.escape(entry)})", folded):
            total += weight * (not any(a <= m.start() and m.start() + len(entry) <= b for a, b in spans))
    return total / (folded.count(" ") + 19)


def test_toxicity_equals_plain_matching(spark, docs, local):
    lexicon = toxicity.Lexicon(((" ab", 1.5), (" the ", 0.5), (" on", 2.0), (" passage1", 0.25)), 0.01, ("on it", "the a"))
    got = collections.defaultdict(list)
    for r in toxicity.score_toxicity(docs, lexicon).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(local)
    for i, t in local:
        d = _plain_density(lexicon, t)
        assert any(r["score"] == pytest.approx(d / (d + 0.01)) and r["predicted"] == int(d / (d + 0.01) >= 0.7) for r in got[i])


def test_toxicity_learns_exceptions_from_clean_rows(spark):
    filler = lambda i: " ".join(f"w{i}x{k}" for k in range(6))
    rows = [(i, f"{filler(i)} put it in the garbage can {filler(-i)}") for i in range(20)] + [(100 + i, filler(i)) for i in range(300)]
    rows += [(1000 + i, f"{filler(i)} you garbage {filler(-i)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id bigint, toxic int"))
    assert {"garbage can", "the garbage"} <= set(lexicon.exceptions) and "you garbage" not in lexicon.exceptions
    assert lexicon.weigh("in the garbage can now")[1] == 0 < lexicon.weigh("you garbage you")[1]


def test_toxicity_counts_groups_of_copies(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(200)]
    rows += [(1000 + i, "you are a stupid moron on this day of ours") for i in range(1500)]  # copies of one text
    rows += [(3000 + i, " ".join(f"r{i}x{k}" for k in range(9)) + " blockhead") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id bigint, toxic int"))
    sampled = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    clean, holders = sum(i < 1000 for i in sampled), sum(i >= 3000 for i in sampled)
    held = {e: w for e, w in lexicon.weights if "blockhead".startswith(e.strip())}
    assert holders >= 3 and held
    want = math.log((holders + 0.5) / (holders + 2) * (clean + 1) / 0.5)
    assert all(w == pytest.approx(want) for w in held.values())


def test_packing_is_whole_and_gapless(docs, local, empty):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    got = packing.pack(docs, ranks, window=256, range_tokens=2048, quantum=32).collect()
    ids = collections.defaultdict(list)
    for i, t in local:
        ids[i].append(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, texts in ids.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, texts))
        for r in pieces[i]:
            assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in texts)
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(empty, ranks).count() == 0


def test_packing_finds_added_tokens(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {t.content: i for i, t in tk.get_added_tokens_decoder().items()} == packing.ADDED
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, f"{end}{end}", f"a{end}b", f"  {end}  \n{end}", f"{end[:-1]} {end[1:]}", "<|ENDOFTEXT|>", f"don't{end}'s 1{end}2", f"é{end}漢"]
    got = packing.pack(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_schedule_keeps_shares():
    lengths = [7000, 2000, 900, 100, 0, 37]
    served = packing.schedule(lengths, 256, 32)
    assert [sum(x[1] for x in s) for s in served] == lengths
    total = sum(lengths)
    for w in range(1, total // 256):
        for q, n in enumerate(lengths):
            done = sum(min(x[1], max(0, x[1])) for x in served[q] if x[2] < w)
            assert abs(done - w * 256 * n / total) <= 2 * 256


@pytest.mark.parametrize("weights", [None, [1, 3, 0, 0, 2]])
def test_ranges_hold_every_token_once_by_target_and_carry_deficits(weights):
    totals = [10_000, 5_000, 37, 0, 811]
    share = [Fraction(x) for x in weights or totals]
    ranges = packing.Ranges(totals, share if weights else None, 2048, 256, 32)
    windows = collections.defaultdict(list)
    for q, n in enumerate(totals):
        at = 0
        for a in range(0, n, 700):  # documents of 700 tokens
            for start, length, seq, offset in ranges.pieces(q, a, min(n, a + 700)):
                assert start == at
                at += length
                windows[seq].append((offset, length, q))
        assert at == n
    first_end = min(sum(share) * n / w for n, w in zip(totals, share, strict=True) if w)
    done, served = 0, [0] * len(totals)
    for seq in sorted(windows):
        at = 0
        for offset, length, q in sorted(windows[seq]):
            assert offset == at
            at += length
            served[q] += length
        assert at <= 256 and at & (at - 1) == 0
        done += at
        if done <= first_end:  # no queue has ended: each is within two windows of its target
            assert all(abs(served[q] - done * w / sum(share)) <= 2 * 256 for q, w in enumerate(share))
    assert served == totals
    deficits = [[x - int(x) for x in ranges.owed_at(r)] for r in range(ranges.count + 1)]
    assert any(any(d) for d in deficits[1:-1]) and not any(deficits[-1])


def test_packing_takes_target_proportions(spark):
    rows = [(i, f"word {i} " * 50, "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), window=64, range_tokens=256, quantum=8, targets={"b": 1.0}).collect()
    stride = packing.Ranges([1, 1], None, 256, 64, 8).stride
    first, second = ({r["sequence_id"] // stride for r in got if r["doc_id"] % 2 == k} for k in (1, 0))
    assert max(first) <= min(second) < max(second)  # a has no target and comes last; one range may hold both


def test_exact_dedup_by_brute_force(docs, local, empty):
    groups = collections.defaultdict(list)
    for i, t in local:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    want = {}
    for norm, members in groups.items():
        named = [m for m in members if m[0] is not None]
        keep = min(named, key=lambda m: (-m[1], m[0]))[0] if named else None
        for i, _ in members:
            want[i] = (keep, len(members), hashlib.sha256(norm.encode()).hexdigest())
    for chars in (64, 1, 0):  # and digests that many texts share
        got = exact_dedup.exact_dedup(docs, digest_chars=chars).collect()
        assert len(got) == len(local)
        for r in got:
            assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_dedup(empty).count() == 0


def _removed(local):
    holders = collections.defaultdict(lambda: math.inf)
    texts = [(i, (t or "").encode()) for i, t in local]
    for i, b in texts:
        for p in range(len(b) - 49):
            if i is not None:
                holders[b[p : p + 50]] = min(holders[b[p : p + 50]], i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and holders[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return collections.Counter(out)


def test_ngram_order_counts_every_document(spark):
    texts = [f"a{i} b{i % 7} c d e f{i % 3}" for i in range(25_000)]
    counts = np.zeros(1 << ngram_join.ORDER_BITS, np.int64)
    shingler = ngram_join.Shingler()
    for t in texts:
        np.add.at(counts, (shingler(t) >> np.uint64(64 - ngram_join.ORDER_BITS)).astype(np.int64), 1)
    want = ngram_join.cut_order(counts)
    got = ngram_join.learn_order(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    assert (got.rank_of_slot == want.rank_of_slot).all() and got.pivots == want.pivots


def test_suffix_dedup_equals_brute_force(docs, local, empty):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _removed(local)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    carried = suffix_dedup.remove_repeats(docs, keep_text=True, carry=("source", "n"))
    assert carried.count() == len(local) and carried.where("doc_id = 9 and text is null").count() == 0


@pytest.mark.parametrize("hot", [2, 1000])
def test_suffix_dedup_steps_agree_with_hot_anchors(local, monkeypatch, hot):
    import pyarrow as pa
    import pyarrow.compute as pc

    monkeypatch.setattr(suffix_dedup, "HOT_GROUPS", hot)
    n = 4
    named = [(i, t) for i, t in local if i is not None]
    tables = [pa.table({"pid": pa.array([p] * len(x), pa.int32()), "doc_id": pa.array([i for i, _ in x], pa.int64()), "text": pa.array([t for _, t in x], pa.string())}) for p in range(n) for x in [[d for d in named if d[0] % n == p]]]
    anchors = pa.concat_tables([suffix_dedup.report_anchors(t, n) for t in tables])
    shared = pa.Table.from_batches(list(suffix_dedup.match_anchors(iter(anchors.to_batches()))))
    pieces = pa.concat_tables([suffix_dedup.send_runs(p, t, shared.filter(pc.equal(shared["pid"], p)), n) for p, t in enumerate(tables)])
    flags = pa.Table.from_batches(list(suffix_dedup.judge(iter(pieces.to_batches()))))
    done = pa.concat_tables([suffix_dedup.apply_ranges(t, flags.filter(pc.equal(flags["pid"], p)), False) for p, t in enumerate(tables)]).to_pylist()
    assert collections.Counter(tuple(r.values()) for r in done) == _removed(named)


def test_suffix_dedup_anchors_in_many_groups_are_no_runs_of_windows():
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = np.random.default_rng(9)
    letters = [bytes(rng.choice(np.frombuffer(b"abcdefghijklmnop", np.uint8), 200)).decode() for _ in range(1201)]
    local = [(i, x[:100] + letters[-1][:60] + x[100:]) for i, x in enumerate(letters[:-1])]
    tables = [pa.table({"pid": pa.array([i], pa.int32()), "doc_id": pa.array([i], pa.int64()), "text": pa.array([t])}) for i, t in local]
    anchors = pa.concat_tables([suffix_dedup.report_anchors(t, 2) for t in tables]).sort_by("bucket")
    shared = pa.Table.from_batches(list(suffix_dedup.match_anchors(iter(anchors.to_batches()))))
    pieces = pa.concat_tables([suffix_dedup.send_runs(p, t, shared.filter(pc.equal(shared["pid"], p)), 2) for p, t in enumerate(tables)]).sort_by("bucket")
    assert pc.sum(pieces["size"]).as_py() < 3 * sum(len(t) for _, t in local)
    flags = pa.Table.from_batches(list(suffix_dedup.judge(iter(pieces.to_batches()))))
    done = pa.concat_tables([suffix_dedup.apply_ranges(t, flags.filter(pc.equal(flags["pid"], p)), False) for p, t in enumerate(tables)]).to_pylist()
    assert collections.Counter(tuple(r.values()) for r in done) == _removed(local)


def test_suffix_dedup_rows_between_groups_and_buckets_grow_with_the_input(monkeypatch):
    def rows(gb):
        monkeypatch.setattr(suffix_dedup, "shares_of", lambda _, mb: int(gb * 1000 / mb) + 1)
        groups, buckets, tasks = suffix_dedup.shape(None, 51)
        assert groups * 3 >= gb * 1000 and buckets * 8 >= gb * 1000 and buckets % tasks == 0
        return groups * buckets / gb

    assert rows(6) < 1.1 * rows(0.51)


def test_prefix_classes_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        text = np.append(rng.choice(np.frombuffer(b"ab", np.uint8), int(rng.integers(1, 400))), np.uint8(255))
        order = suffix_dedup.suffix_order(text)
        raw = text.tobytes()
        begins = suffix_dedup.prefix_classes(text, order, 6)
        heads = [raw[p : p + 6] for p in order]
        for k in range(1, len(heads)):
            if len(heads[k]) == len(heads[k - 1]) == 6 and b"\xff" not in heads[k] + heads[k - 1]:
                assert begins[k] == (heads[k] != heads[k - 1])


def test_lm_base_model_and_context_tree(docs, local, empty):
    rows = [(i, t) for i, t in local if i is not None]
    named = docs.where("doc_id is not null")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    condition = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    for most in (100_000, 100, 0):  # every word broadcast, most joined, and all joined
        got = {r["doc_id"]: r for r in lm_scoring.score_texts(named, ~condition, condition, hot_words=most, max_nodes=500).collect()}
        for i, t in rows:
            w = tokens(t)
            base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, held(i))
            assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert lm_scoring.score_texts(empty, ~condition, condition).count() == 0


def test_context_tree_is_a_distribution_and_weights_depths():
    text = b"abracadabra" * 50
    padded = b"\0" * lm_scoring.DEPTH + text + b"\0"
    table = collections.defaultdict(lambda: np.zeros(256))
    for p in range(lm_scoring.DEPTH, len(padded)):
        for d in range(lm_scoring.DEPTH + 1):
            table[d, int.from_bytes(padded[p - d : p], "big")][padded[p]] += 1
    keys = sorted(table)
    tree = lm_scoring.build_tree(np.array([d for d, _ in keys]), np.array([c for _, c in keys], np.int64), np.stack([table[k] for k in keys]))
    assert np.allclose((10.0 ** tree.log_p.astype(float)).sum(axis=1), 1, atol=1e-4)
    seen, unseen = tree.score([text, bytes(reversed(text))])
    assert seen > unseen and -seen / math.log10(2) / len(text) < 0.6
    flat = lm_scoring.build_tree(np.zeros(1, int), np.zeros(1, np.int64), np.zeros((1, 256)))
    assert flat.score([b"xyz"])[0] == pytest.approx(4 * math.log10(1 / 256), rel=1e-5)


@pytest.mark.parametrize("most", [20, 500, lm_scoring.MAX_NODES])
def test_lm_scores_by_every_context(spark, local, most):
    rows = [(i, t) for i, t in local if i is not None]
    table = collections.defaultdict(lambda: np.zeros(256))
    for i, t in rows:
        if i % 3:
            padded = b"\0" * lm_scoring.DEPTH + (t or "").encode().lower() + b"\0"
            for p in range(lm_scoring.DEPTH, len(padded)):
                for d in range(lm_scoring.DEPTH + 1):
                    table[d, int.from_bytes(padded[p - d : p], "big")][padded[p]] += 1
    keys = sorted(table)
    tree = lm_scoring.build_tree(np.array([d for d, _ in keys]), np.array([c for _, c in keys], np.int64), np.stack([table[k] for k in keys]))
    want = collections.defaultdict(set)
    for (i, _), x in zip(rows, tree.score([(t or "").encode().lower() for _, t in rows]), strict=True):
        want[i].add(float(x))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    learn = F.col("doc_id") % 3 != 0
    got = lm_scoring.score_texts(docs, learn, ~learn, max_nodes=most).collect()
    assert len(keys) > 500 and len(got) == len(rows)
    assert all(any(r["score"] == pytest.approx(x, rel=1e-4) for x in want[r["doc_id"]]) for r in got)


def test_filters_keep_columns_and_rows_without_id(docs, empty):
    for keep in (exact_dedup.keep_winners, ngram_join.keep_one):
        left = keep(docs)
        assert left.columns == docs.columns and left.where("doc_id is null").count() == 1
        ids = {r["doc_id"] for r in left.collect()}
        assert 4 in ids and 5 not in ids
        assert keep(empty).count() == 0


def test_suffix_dedup_of_short_texts_alone(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "short"), (3, None), (4, "x" * 50), (5, "y" * 49)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(rows).collect()} == {(i, 0) for i in range(1, 6)}


def test_odd_columns_and_very_long_texts(spark):
    """Columns named like the operators' own, ids that are null or repeat, and a text of a megabyte."""
    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(140_000))
    assert len(long) > 1_000_000
    rows = [(1, long, "en", "s"), (2, long + " end", "en", "s"), (3, None, None, None), (None, "no id " * 40, "en", None), (4, "", "en", "s"), (4, "again", "de", "t")]
    names = "digest node label norm stats part sha n key queue word gram total text_sha256 group pid bucket w t row".split()
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], ", ".join(["doc_id bigint", "text string", "lang string", "source string", *[f"`{n}` string" for n in names]]))
    held = F.lit(False)
    model = quality_classifier.RuleModel(0.0, (((("log_words", True, 3.0),), 1.0),))
    results = {
        "op1": quality_rules.quality_rules(docs),
        "op2": language_id.identify(docs, language_id.fit(docs, F.lit(True))),
        "op3": ngram_join.near_duplicates(docs),
        "op4": quality_classifier.classify(docs, model),
        "op5": sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), full=False),
        "op6": toxicity.score_toxicity(docs, toxicity.Lexicon(((" w", 1.0),), 0.01)),
        "op8": exact_dedup.exact_dedup(docs),
        "op9": suffix_dedup.remove_repeats(docs),
        "op10": lm_scoring.score_texts(docs, ~held, held),
    }
    got = {k: v.collect() for k, v in results.items()}
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys(results, len(rows))
    assert {r["component_id"] for r in got["op3"] if r["doc_id"] in (1, 2)} == {1}
    assert {r["doc_id"]: r["n_removed"] for r in got["op9"] if r["doc_id"] in (1, 2)} == {1: 0, 2: len(long) + 1}  # the text repeats itself, so its last word with a blank occurs in it too
    assert sum(r["length"] for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()) > 6
    for kept in (exact_dedup.keep_winners(docs), ngram_join.keep_one(docs), quality_classifier.keep_good(docs, model)):
        assert kept.columns == docs.columns
