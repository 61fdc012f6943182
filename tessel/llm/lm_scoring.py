"""Language-model scoring by context-tree weighting over bytes, beside an add-one word model.

Each byte is eight binary decisions, each with its own context tree over the bytes before. Every context
of the training corpus is a node and holds Krichevsky-Trofimov estimates; weighting mixes the estimates of
all depths along a context's path, with the weights that the training text itself gives. Both models see
A-Z in lower case.

The tree stays distributed. Counts of the byte 6-grams of all texts meet in a shuffle by the latest
``SUBTREE`` bytes of context, so that each subtree is whole in one row; the levels above are bounded by
their alphabet (65,793 nodes) and are summed and broadcast. Two passes over the subtrees, upwards for the
weights and downwards for the predictions, give a table of every 6-gram's log-probability. The most
frequent 6-grams, up to a fixed number, are broadcast from it; the rest of each text's 6-grams meets it in
a join, where no key is hot.

Word counts of the training corpus stay distributed. The most frequent words, up to a fixed number, are
broadcast (very long ones only for a fixed least share of all tokens, which bounds their bytes); the rest of
each text's words meets its counts in a join, where no key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import materialize, partitions_for

DEPTH = 5
#: Latest bytes of context that subtrees are dealt by; the levels above are summed and broadcast.
SUBTREE = 3
#: 6-grams whose log-probabilities are broadcast at most (16 bytes each), the most frequent first; the others are joined.
#: No result depends on it.
MAX_NODES = 1_000_000
#: 6-grams of whole subtrees that a row holds, about.
PACK = 500_000
#: Words of at most ``HOT_BYTES`` bytes whose counts are broadcast, the most frequent first. Longer ones are broadcast if they hold
#: one of ``HOT_WORDS`` equal shares of all training tokens; all others are joined.
HOT_WORDS, HOT_BYTES = 100_000, 64
#: Distinct keys that a task gathers before it passes its counts on.
FLUSH = 400_000
_CHUNK = 1 << 18


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``DEPTH`` zero bytes before and one after each, as one array; and where each text's predictions start.

    The zero byte after a text is its end symbol and is predicted too.
    """
    raw = np.frombuffer(b"".join(b"\0" * DEPTH + t + b"\0" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 + DEPTH for t in texts])
    return raw, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _codes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct 6-grams of ``texts`` and their counts, in blocks."""
    raw, starts = _joined(texts)
    for low in range(0, len(raw), 1 << 22):
        part = raw[max(0, low - DEPTH) : low + (1 << 22)].astype(np.int64)
        code = np.zeros(max(0, len(part) - DEPTH), np.int64)
        for i in range(DEPTH + 1):
            code = code << 8 | part[i : len(part) - DEPTH + i]
        first = max(low, DEPTH)
        skipped = (starts[:, None] + np.arange(DEPTH)).ravel() - first
        keep = np.ones(len(code), bool)
        keep[skipped[(skipped >= 0) & (skipped < len(code))]] = False
        yield np.unique(code[keep], return_counts=True)


def _merged(grams: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ``grams`` in order, and the sums of their ``counts``."""
    if not len(grams):
        return grams, *counts
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], *[np.add.reduceat(n[order], first) for n in counts]


def count_grams(rows: DataFrame) -> DataFrame:
    """gram (bytes of a 6-gram, the latest lowest), n (in rows to learn from), total (in all rows), by task, over text and learn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        pending = 0

        def out(c: np.ndarray, n: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(c), 50_000):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(c[a : a + 50_000]), "n": pa.array(n[a : a + 50_000]), "total": pa.array(total[a : a + 50_000])})

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                learn = piece.column(1).to_pylist()
                texts = [(t or "").encode().lower() for t in piece.column(0).to_pylist()]
                for side in (True, False):
                    own = [t for t, k in zip(texts, learn, strict=True) if k == side]
                    for c, n in _codes(own) if own else ():
                        held.append((c, n * side, n))
                        pending += len(c)
                if pending > 4 * FLUSH:
                    held = [_merged(*map(np.concatenate, zip(*held, strict=True)))]
                    pending = len(held[0][0])
                    if pending > 2 * FLUSH:
                        yield from out(*held[0])
                        held, pending = [], 0
        if held:
            yield from out(*_merged(*map(np.concatenate, zip(*held, strict=True))))

    return rows.select("text", "learn").mapInArrow(run, "gram bigint, n bigint, total bigint")


def pack_subtrees(grams: DataFrame, partitions: int) -> DataFrame:
    """gram, n, total (arrays of 64-bit integers): each row holds whole subtrees, with every 6-gram of theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        gram, n, total = _merged(*map(np.concatenate, zip(*parts, strict=True)))
        parts.clear()
        order = np.argsort(_subtree_first(gram))
        gram, n, total = gram[order], n[order], total[order]
        root = gram >> 8 & (1 << 8 * SUBTREE) - 1
        ends = np.append(np.flatnonzero(root[1:] != root[:-1]) + 1, len(root))
        a = 0
        while a < len(gram):
            b = int(ends[min(len(ends) - 1, np.searchsorted(ends, a + PACK))])
            yield pa.RecordBatch.from_pydict({"gram": pa.array([gram[a:b].tobytes()]), "n": pa.array([n[a:b].tobytes()]), "total": pa.array([total[a:b].tobytes()])})
            a = b

    root = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * SUBTREE) - 1))
    return grams.repartition(partitions, root).mapInArrow(run, "gram binary, n binary, total binary")


def _subtree_first(gram: np.ndarray) -> np.ndarray:
    """6-grams with the bytes of context turned round, so that subtrees of every depth stand together in order."""
    key = gram >> 8 & 255
    for i in range(2, DEPTH + 1):
        key = key << 8 | gram >> 8 * i & 255
    return key << 8 | gram & 255


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log(Gamma(n + 1/2)), by Stirling's series above 8 and by recurrence below."""
    x = n + 0.5
    small = x < 8
    shift = np.where(small, 8.0, 0.0)
    y = x + shift
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    steps = sum(np.log(x[small] + k) for k in range(8)) if small.any() else 0.0
    series[small] -= steps
    return series


def _log_gamma_int(n: np.ndarray) -> np.ndarray:
    """log(Gamma(n + 1)) in the same way."""
    return _log_gamma_half(n + 0.5)


#: Both functions of the counts below 4096, which nearly all counts are.
_HALF, _INT = _log_gamma_half(np.arange(4096.0)), _log_gamma_int(np.arange(4096.0))


def _read(table: np.ndarray, series: Callable[[np.ndarray], np.ndarray], n: np.ndarray) -> np.ndarray:
    """``series`` of the whole numbers ``n``, from ``table`` where it reaches."""
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    far = n >= len(table)
    out[far] = series(n[far])
    return out


def _bits(counts: np.ndarray) -> np.ndarray:
    """Zeros and ones of each binary decision: (node, 255, 2) from (node, 256). Decisions of a level stand together, first bit first."""
    levels = [counts.reshape(len(counts), 1 << k, 2, -1).sum(axis=3) for k in range(8)]
    return np.concatenate(levels, axis=1)


def _kt(pairs: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov log-probability of the pairs of counts."""
    a, b = pairs[..., 0], pairs[..., 1]
    return _read(_HALF, _log_gamma_half, a) + _read(_HALF, _log_gamma_half, b) - _read(_INT, _log_gamma_int, a + b) - np.log(np.pi)


@dataclass(frozen=True)
class ContextTree:
    """log10 of each byte's probability at each node (node, 256), and the child that one more byte of context leads to.

    Node 0 is the root. ``child`` has one further row, the dead end that every missing child leads to.
    """

    log_p: np.ndarray
    child: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end symbol."""
        raw, starts = _joined(texts)
        dead = len(self.log_p)
        out = np.zeros(len(raw))
        for low in range(DEPTH, len(raw), _CHUNK):
            part = raw[low - DEPTH : low + _CHUNK]
            n = len(part) - DEPTH
            walk = np.zeros(n, np.int32)
            state = walk
            for d in range(1, DEPTH + 1):
                walk = self.child[walk, part[DEPTH - d : DEPTH - d + n]]
                state = np.where(walk == dead, state, walk)
            out[low : low + n] = self.log_p[state, part[DEPTH:]]
        skip = (starts[:, None] + np.arange(DEPTH)).ravel()
        out[skip] = 0.0
        return np.add.reduceat(out, starts)


def build_tree(depth_of: np.ndarray, context: np.ndarray, counts: np.ndarray) -> ContextTree:
    """The weighted tree from nodes (depth, context bytes with the latest lowest) and their next-byte counts (node, 256).

    Node 0 must be the root. Every other node's shorter context must be a node too.
    """
    m = len(context)
    place = {(int(d), int(c)): i for i, (d, c) in enumerate(zip(depth_of, context, strict=True))}
    parent = np.array([0, *[place[int(d) - 1, int(c) & ((1 << 8 * (int(d) - 1)) - 1)] for d, c in zip(depth_of[1:], context[1:], strict=True)]])
    child = np.full((m + 1, 256), m, np.int32)
    for i in range(1, m):
        child[parent[i], int(context[i]) >> 8 * (int(depth_of[i]) - 1)] = i
    below = np.zeros_like(counts)
    np.add.at(below, parent[1:], counts[1:])
    children = np.zeros((m, 255))
    share = np.ones((m, 255), np.float32)
    order = [np.flatnonzero(depth_of == d) for d in range(DEPTH + 1)]
    for d in range(DEPTH, -1, -1):
        for rows in np.array_split(order[d], max(1, len(order[d]) // 1024)):
            if not len(rows):
                continue
            weighted = _kt(_bits(counts[rows]))
            if d < DEPTH:
                split = children[rows] + _kt(_bits(counts[rows] - below[rows]))
                share[rows] = 1 / (1 + np.exp(np.clip(split - weighted, -700, 700)))
                weighted = np.logaddexp(weighted, split) - np.log(2)
            if d:
                np.add.at(children, parent[rows], weighted)
    del children
    log_p = np.zeros((m, 256), np.float32)
    known = np.zeros((m, 255), np.float32)
    rest = np.ones((m, 255), np.float32)
    for d in range(DEPTH + 1):
        for rows in np.array_split(order[d], max(1, len(order[d]) // 1024)):
            if not len(rows):
                continue
            up = parent[rows]
            before, left = (known[up], rest[up]) if d else (np.zeros((1, 255)), np.ones((1, 255)))
            one = lambda p: (p[..., 1] + 0.5) / (p.sum(axis=-1) + 1)
            known[rows] = before + left * share[rows] * one(_bits(counts[rows]))
            rest[rows] = left * (1 - share[rows])
            p1 = np.clip(known[rows] + rest[rows] * one(_bits(counts[rows] - below[rows])), 1e-12, 1 - 1e-12).astype(np.float64)
            total = np.zeros((len(rows), 256))
            symbols = np.arange(256)
            for k in range(8):
                at = (1 << k) - 1 + (symbols >> (8 - k))
                bit = symbols >> (7 - k) & 1
                total += np.log10(np.where(bit, p1[:, at], 1 - p1[:, at]))
            log_p[rows] = total
    return ContextTree(log_p, child)


@dataclass
class Decisions:
    """The binary decisions of one depth and one bit: context and bits before (``ids``, in order), counts, and the own estimate's weight."""

    ids: np.ndarray
    pairs: np.ndarray
    share: np.ndarray


def _weigh(pairs: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the own estimate, and the log of the weighted probability."""
    own = _kt(pairs)
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700))), np.logaddexp(own, children) - np.log(2)


def _up(ids: np.ndarray, bit: int) -> np.ndarray:
    """Ids of the same decision one byte of context higher."""
    return ids >> 8 + bit << bit | ids & (1 << bit) - 1


def weigh_subtrees(key: np.ndarray, n: np.ndarray) -> tuple[list[list[Decisions]], list[np.ndarray]]:
    """Decisions by depth (deepest first, down to ``SUBTREE``) and bit; and of depth ``SUBTREE``, the logs of weighted probabilities by bit."""
    out: list[list[Decisions]] = []
    weighted: list[np.ndarray] = []
    for d in range(DEPTH, SUBTREE - 1, -1):
        if d < DEPTH:
            key, at = np.unique(key >> 16 << 8 | key & 255, return_inverse=True)
            n = np.bincount(at, n, len(key))
        level = []
        for bit in range(8):
            ids = key >> 8 - bit
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ids = ids[first]
            ones = np.add.reduceat(n * (key >> 7 - bit & 1), first)
            pairs = np.stack([np.add.reduceat(n, first) - ones, ones], axis=1).astype(float)
            if d == DEPTH:
                level.append(Decisions(ids, pairs, np.ones(len(ids))))
                weighted.append(_kt(pairs))
            else:
                children = np.bincount(np.searchsorted(ids, _up(out[-1][bit].ids, bit)), weighted[bit], len(ids))
                share, weighted[bit] = _weigh(pairs, children)
                level.append(Decisions(ids, pairs, share))
        out.append(level)
    return out, weighted


@dataclass(frozen=True)
class Top:
    """Of the contexts one byte shorter than ``SUBTREE`` (in order): for each of 255 decisions, what the path down to there
    predicts, and the weight left to deeper contexts."""

    contexts: np.ndarray
    known: np.ndarray
    rest: np.ndarray


def _one(pairs: np.ndarray) -> np.ndarray:
    return (pairs[..., 1] + 0.5) / (pairs.sum(axis=-1) + 1)


def weigh_top(context: np.ndarray, decision: np.ndarray, pairs: np.ndarray, children: np.ndarray) -> Top:
    """The top of the tree, from counts of its deepest contexts' decisions and the summed logs of their children."""
    contexts, at = np.unique(context, return_inverse=True)
    counts, below = np.zeros((len(contexts), 255, 2)), np.zeros((len(contexts), 255))
    counts[at, decision], below[at, decision] = pairs, children
    levels = []
    own = contexts
    for d in range(SUBTREE - 1, -1, -1):
        share, weighted = _weigh(counts, below)
        shorter, up = np.unique(own >> 8, return_inverse=True)
        levels.append((share, _one(counts), up))
        if d:
            above, sums = np.zeros((len(shorter), 255, 2)), np.zeros((len(shorter), 255))
            np.add.at(above, up, counts)
            np.add.at(sums, up, weighted)
            own, counts, below = shorter, above, sums
    known, rest = np.zeros((1, 255)), np.ones((1, 255))
    for share, one, up in reversed(levels):
        known = known[up] + rest[up] * share * one
        rest = rest[up] * (1 - share)
    return Top(contexts, known, rest)


def predict(key: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each 6-gram's last byte."""
    levels, _ = weigh_subtrees(key, n)
    out = np.zeros(len(key))
    for bit in range(8):
        above = None
        for level in reversed(levels):
            own = level[bit]
            up = _up(own.ids, bit)
            if above is None:
                at = np.searchsorted(top.contexts, up >> bit), (1 << bit) - 1 + (up & (1 << bit) - 1)
                known, rest = top.known[at], top.rest[at]
            else:
                at = np.searchsorted(above, up)
                known, rest = known[at], rest[at]
            known = known + rest * own.share * _one(own.pairs)
            rest = rest * (1 - own.share)
            above = own.ids
        ids = key >> 8 - bit
        at = np.cumsum(np.concatenate([[False], ids[1:] != ids[:-1]]))
        p = np.clip(known, 1e-12, 1 - 1e-12)[at]
        out += np.log10(np.where(key >> 7 - bit & 1, p, 1 - p))
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield tuple(np.frombuffer(x, np.int64) for x in row)


def fit_grams(rows: DataFrame) -> DataFrame:
    """gram, log_p (log10 of its last byte's probability after the others), total (in all rows), for each 6-gram of ``rows``
    (text, learn) under the tree learned from the rows with ``learn``."""
    packs = materialize(pack_subtrees(count_grams(rows), partitions_for(rows)))

    def upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, _ in _unpacked(batches):
            levels, weighted = weigh_subtrees(_subtree_first(gram), n)
            for bit, own in enumerate(levels[-1]):
                ids, at = np.unique(_up(own.ids, bit), return_inverse=True)
                sums = [np.bincount(at, x, len(ids)) for x in (own.pairs[:, 0], own.pairs[:, 1], weighted[bit])]
                yield pa.RecordBatch.from_pydict({"context": pa.array(ids >> bit), "decision": pa.array((1 << bit) - 1 + (ids & (1 << bit) - 1)), **{k: pa.array(x) for k, x in zip(("zeros", "ones", "children"), sums, strict=True)}})

    schema = "context bigint, decision bigint, zeros double, ones double, children double"
    found = packs.mapInArrow(upwards, schema).groupBy("context", "decision").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")]).toArrow()
    context, decision, zeros, ones, children = (found[c].to_numpy() for c in ("context", "decision", "zeros", "ones", "children"))
    sent = rows.sparkSession.sparkContext.broadcast(weigh_top(context, decision, np.stack([zeros, ones], axis=1), children))

    def downwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, total in _unpacked(batches):
            log_p = predict(_subtree_first(gram), n, sent.value)
            for a in range(0, len(gram), 50_000):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(gram[a : a + 50_000]), "log_p": pa.array(log_p[a : a + 50_000]), "total": pa.array(total[a : a + 50_000])})

    return materialize(packs.mapInArrow(downwards, "gram bigint, log_p double, total bigint"))


def most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of ``table`` with the greatest ``count``, ``most`` at most.

    Counts are cut between steps of a 64th of a power of two, which a count by step finds (4,032 rows or fewer).
    """
    step = F.floor(F.log2(count) * 64)
    held, least = 0, None
    for row in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > most:
            break
        least = row["step"]
    return table.where(step >= F.lit(least))


class HotGrams:
    """Log-probabilities of 6-grams in two hash tables; a 6-gram that finds no place in either is not held."""

    def __init__(self, gram: np.ndarray, log_p: np.ndarray):
        self.tables = []
        for spare, factor in ((2, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            shift = np.uint64(64 - max(4, len(gram).bit_length() + spare))
            keys, values = np.full(1 << 64 - int(shift), -1, np.int64), np.zeros(1 << 64 - int(shift))
            at = self._slot(gram, factor, shift)
            keys[at], values[at] = gram, log_p
            values[at] = np.where(keys[at] == gram, log_p, values[at])
            self.tables.append((factor, shift, keys, values))
            lost = keys[at] != gram
            gram, log_p = gram[lost], log_p[lost]

    @staticmethod
    def _slot(gram: np.ndarray, factor: int, shift: np.uint64) -> np.ndarray:
        return (gram.astype(np.uint64) * np.uint64(factor) >> shift).astype(np.int64)

    def look_up(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log_p of each 6-gram (0 where it is not held), and the places of those not held."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for factor, shift, keys, values in self.tables:
            own = gram[left]
            at = self._slot(own, factor, shift)
            same = keys[at] == own
            out[left[same]] = values[at[same]]
            left = left[~same]
        return out, left

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text, the sum over 6-grams held (its end symbol's included), and the others with how often each occurs."""
        raw, starts = _joined(texts)
        out = np.zeros(len(raw))
        owners, grams = [], []
        skip = np.zeros(len(raw), bool)
        skip[(starts[:, None] + np.arange(DEPTH)).ravel()] = True
        for low in range(DEPTH, len(raw), _CHUNK):
            part = raw[low - DEPTH : low + _CHUNK].astype(np.int64)
            n = len(part) - DEPTH
            code = np.zeros(n, np.int64)
            for i in range(DEPTH + 1):
                code = code << 8 | part[i : n + i]
            out[low : low + n], left = self.look_up(code)
            left = left[~skip[low + left]]
            owners.append(np.searchsorted(starts, low + left, side="right") - 1)
            grams.append(code[left])
        out[skip] = 0.0
        owner, gram = np.concatenate(owners), np.concatenate(grams)
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]))
        times = np.diff(np.append(first, len(gram))).astype(np.int32)
        offsets = pa.array(np.searchsorted(owner[first], np.arange(len(texts) + 1)).astype(np.int32))
        return np.add.reduceat(out, starts), pa.ListArray.from_arrays(offsets, pa.array(gram[first])), pa.ListArray.from_arrays(offsets, pa.array(times))


def _tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split cuts at exactly space and U+0009 to U+000D."""
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary), c over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(counts)
            for a in range(0, len(keys), 50_000):
                part = keys[a : a + 50_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.binary()), "c": pa.array([counts[k] for k in part], pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_tokens(text))
                if len(counts) > FLUSH:
                    yield from out()
                    counts.clear()
        yield from out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def score_texts(docs: DataFrame, training: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``training`` says which rows are learned from. Null text counts as empty: one token, the end, and
    the score of an end right at the start. Repeated rows are scored, and learned, each for itself. With
    nothing to learn from, every known count is 0. Very long texts are scored whole, in blocks. An empty table gives an empty result; no column but
    the two named and those of the conditions is read. At most ``max_nodes`` 6-grams and ``hot_words`` words
    are broadcast, the others joined; this changes no result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"), F.coalesce(training, F.lit(False)).alias("learn"))
    learn = rows.where("learn")
    words = materialize(count_words(learn))
    ends = learn.count()
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = total + ends, kinds + (ends > 0)
    long = F.length("word") > HOT_BYTES
    common_long = words.where(long & (F.col("c") >= max(2.0, n / max(1, hot_words))))  # their bytes: hot_words times the mean length of a word at most
    hot = {bytes(w): c for w, c in most_frequent(words.where(~long), "c", hot_words).unionByName(common_long).collect()}
    table = fit_grams(rows)
    frequent = most_frequent(table, "total", max_nodes).orderBy("total", "gram").select("gram", "log_p").toArrow()
    sent = spark.sparkContext.broadcast((frequent["gram"].to_numpy(), frequent["log_p"].to_numpy(), {w: (i, c) for i, (w, c) in enumerate(hot.items())}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, values, common = sent.value
        tree = HotGrams(grams, values)
        logs = {w: float(np.log10(c + 1)) for w, (_, c) in common.items()}
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                chunk = batch.slice(at, 200)
                texts = [(t or "").encode().lower() for t in chunk.column(1).to_pylist()]
                cold, times, tokens, known, base = [], [], [], [], []
                for t in texts:
                    held = Counter(t.split())
                    rare = [w for w in held if w not in logs]  # a difference of views would visit all of logs
                    cold.append(rare)
                    times.append([held[w] for w in rare])
                    mine = [(k, logs[w]) for w, k in held.items() if w in logs]
                    tokens.append(held.total() + 1)
                    known.append(sum([k for k, _ in mine]))
                    base.append(sum([k * x for k, x in mine]))
                score, cold_grams, gram_times = tree.score(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(texts), pa.int32()),
                        "row": pa.array(range(row, row + len(texts)), pa.int64()),
                        "doc_id": chunk.column(0),
                        "held_out": chunk.column(2),
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "n_tokens": pa.array(tokens, pa.int64()),
                        "known": pa.array(known, pa.int64()),
                        "base": pa.array(base, pa.float64()),
                        "score": pa.array(score),
                        "cold": pa.array(cold, pa.list_(pa.binary())),
                        "times": pa.array(times, pa.list_(pa.int32())),
                        "cold_grams": cold_grams,
                        "gram_times": gram_times,
                    }
                )
                row += len(texts)

    schema = "part int, row bigint, doc_id bigint, held_out boolean, n_bytes bigint, n_tokens bigint, known bigint, base double, score double, cold array<binary>, times array<int>, cold_grams array<bigint>, gram_times array<int>"
    scored = materialize(rows.select("doc_id", "text", "held_out").mapInArrow(run, schema))
    cold = scored.select("part", "row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("part", "row", F.col("x.cold").alias("word"), F.col("x.times").alias("k"))
    rare = cold.join(words, "word").groupBy("part", "row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("rare_base"), F.sum("k").cast("bigint").alias("rare_known"))
    seldom = scored.select("part", "row", F.explode(F.arrays_zip("cold_grams", "gram_times")).alias("x")).select("part", "row", F.col("x.cold_grams").alias("gram"), F.col("x.gram_times").alias("k"))
    deep = seldom.join(table.select("gram", "log_p"), "gram").groupBy("part", "row").agg(F.sum(F.col("k") * F.col("log_p")).alias("rare_score"))
    whole = scored.drop("cold", "times", "cold_grams", "gram_times").join(rare, ["part", "row"], "left").join(deep, ["part", "row"], "left").withColumn("score", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    end = float(np.log10(ends + 1))
    each = float(np.log10(n + v + 1))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
