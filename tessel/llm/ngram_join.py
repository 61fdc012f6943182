"""Similarity join of documents by the Jaccard similarity of their word n-grams, with vertical partitioning.

The n-grams (64-bit hashes) have one global order: rare ones first, as a sketch of their counts in the whole corpus
tells, then by hash. Pivots cut this order into fragments of equal mass. Each text is cut at the pivots, each
fragment's parts are compared in groups of their own, and the partial overlaps are summed for each pair.

Which pairs are counted: a text's n-grams within its prefix in the global order find candidates; two texts at the
threshold share one there at least. Counts of n-grams by ranges of the hash bound a pair's similarity from
above, which rules most candidates out before their texts are cut.

Texts that share one of a few leading n-grams of their prefixes are compared with one of them, a centre, first.
What these links leave in different components is then compared pair by pair, so copies need no pairs among
themselves and no link between components is lost. A pair that shares leading n-grams is looked at under the
least of them alone. Hash collisions aside (n^2 / 2^64 for a pair), the join is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import by_key, keep_ids, materialize, measured, partitions_for, shares_of

SIZE = 5
#: Links need ``NUMERATOR * union <= DENOMINATOR * intersection``, a similarity of 0.8.
NUMERATOR, DENOMINATOR = 4, 5
#: Fragments of the global order, which are compared apart, and ranges of the hash whose counts bound a pair's similarity first.
FRAGMENTS, BOUND_RANGES = 4, 64
#: Texts of so many n-grams or fewer have their counts kept for twice the ranges.
FEW = 600
#: Bits for each n-gram, at least, in the map that bounds the pairs that the counts let through.
BITS = 4
#: Pairs whose documents' ids are broadcast to the scan that fetches the texts, at most; beyond, the texts are joined by shuffle.
BROADCAST_PAIRS = 200_000
#: Slots of the sketch that counts n-grams for the order, as a power of two.
ORDER_BITS = 20
#: Leaves of a centre that one group compares; a centre with more is copied.
STAR = 512
#: Leading n-grams of a prefix: groups of the first round, and of the second for pairs that share one. Half are those of
#: least hash, half the first that are as frequent as those of a large group of near copies.
LEADING = 8
FREQUENT = 64
#: Rounds of links to centres before the pairs that they leave.
CENTRE_ROUNDS = 3
WORD_TABLE = 300_000
#: Bits that the n-grams of a prefix lose: equal ones stay equal, and what they find is compared in full.
_SHORT = np.uint64(16)
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct n-gram hashes of texts, sorted; hashes of words are kept in a table that is emptied when full."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.table: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        new = set(words).difference(self.table)
        if new:
            if len(self.table) + len(new) > WORD_TABLE:
                self.table.clear()
                new = set(words)
            self.table.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        w = np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _K + w[i : len(w) - k + 1 + i]
        return np.unique(_mix(h))


@dataclass(frozen=True)
class GlobalOrder:
    """The order of n-grams: by the rank of their slot of the sketch (0 for the rare half), then by hash. ``pivots`` (rank, hash) cut it into fragments."""

    rank_of_slot: np.ndarray
    pivots: tuple[tuple[int, int], ...]

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        return self.rank_of_slot[grams >> np.uint64(64 - ORDER_BITS)]

    def fragments(self, grams: np.ndarray) -> list[np.ndarray]:
        """The n-grams of each fragment, in the order given."""
        rank = self.ranks(grams)
        at = np.zeros(len(grams), np.int8)
        for r, h in self.pivots:
            at += (rank > r) | ((rank == r) & (grams >= np.uint64(h)))
        return [grams[at == f] for f in range(len(self.pivots) + 1)]


def cut_order(counts: np.ndarray) -> GlobalOrder:
    """The order that a sketch's counts by slot give, with pivots that leave each fragment an equal share of what was counted."""
    middle = float(np.median(counts))
    rank = np.clip(8 * (counts - middle) / np.sqrt(middle + 1), 0, 255).astype(np.uint8)
    mass = np.bincount(rank, counts + 1.0, 256)
    before = np.concatenate([[0.0], np.cumsum(mass)])
    pivots = []
    for f in range(1, FRAGMENTS):
        want = before[-1] * f / FRAGMENTS
        r = int(np.searchsorted(before, want, side="right")) - 1
        pivots.append((r, min((1 << 64) - 1, int((want - before[r]) / mass[r] * 2.0**64))))
    return GlobalOrder(rank, tuple(pivots))


def prefix(grams: np.ndarray, order_of: GlobalOrder) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the prefix, as many as two texts at the threshold cannot all miss, rarest first; and which of them lead."""
    n = len(grams)
    keep = n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1
    rank = order_of.ranks(grams)
    order = np.argsort(rank, kind="stable")[:keep]
    leads = np.zeros(len(order), bool)
    leads[np.flatnonzero(rank[order] >= FREQUENT)[: LEADING // 2]] = True
    leads[np.argsort(grams[order])[: LEADING // 2]] = True
    return grams[order], leads


def range_counts(grams: np.ndarray) -> np.ndarray:
    """64 bytes of counts: of 64 ranges of the hash, 255 at most, or, up to ``FEW`` n-grams, of 128 ranges in half a byte each, 15 at most."""
    if len(grams) > FEW:
        return np.minimum(np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8)
    halves = np.minimum(np.bincount((grams >> np.uint64(57)).astype(np.int64), minlength=128), 15).astype(np.uint8)
    return halves[::2] << 4 | halves[1::2]


def bit_map(grams: np.ndarray) -> np.ndarray:
    """One bit for each range of the hash order, set where the text has an n-gram; a power of two of them, ``BITS`` for each n-gram at least."""
    bits = max(3, int(BITS * len(grams) - 1).bit_length())
    out = np.zeros(1 << bits, np.uint8)
    out[(grams >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return np.packbits(out)


def bits_allow(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
    """Whether two bit maps leave room for a link: n-grams in ranges that the other text has none of are not shared."""
    while len(a) != len(b):
        long = a if len(a) > len(b) else b
        pairs = np.unpackbits(long).reshape(-1, 2).max(axis=1)
        a, b = (np.packbits(pairs), b) if len(a) > len(b) else (a, np.packbits(pairs))
    room = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return (NUMERATOR + DENOMINATOR) * room >= NUMERATOR * (n_a + n_b)


def _room(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Sum of the smaller counts; without bound where both are as high as is counted."""
    low = np.minimum(a, b)
    return low.sum(axis=1, dtype=np.int64) + np.where((low >= most).any(axis=1), 1 << 40, 0)


def _coarse(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of 64 ranges from those of either kind."""
    high, low = counts >> 4, counts & 15
    return np.where((n <= FEW)[:, None], np.where((high == 15) | (low == 15), 255, high + low), counts)


def may_link(counts_a: np.ndarray, counts_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether range counts leave room for a link: ``intersection <= sum of smaller counts``."""
    room = np.empty(len(n_a), np.int64)
    few = (n_a <= FEW) & (n_b <= FEW)
    a, b = counts_a[few], counts_b[few]
    room[few] = _room(np.hstack([a >> 4, a & 15]), np.hstack([b >> 4, b & 15]), 15)
    room[~few] = _room(_coarse(counts_a[~few], n_a[~few]), _coarse(counts_b[~few], n_b[~few]), 255)
    return ((NUMERATOR + DENOMINATOR) * room >= NUMERATOR * (n_a + n_b)) & (DENOMINATOR * np.minimum(n_a, n_b) >= NUMERATOR * np.maximum(n_a, n_b))


def learn_order(docs: DataFrame) -> GlobalOrder:
    """The order of n-grams by their counts in all of ``docs``, where a task counts each set of n-grams once."""
    slices, width = 16, (1 << ORDER_BITS) // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, own, seen = Shingler(), np.zeros(1 << ORDER_BITS, np.int64), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                grams = shingler(text)
                mark = xxhash.xxh3_64_intdigest(grams.tobytes())
                if mark not in seen:
                    seen.add(mark)
                    np.add.at(own, (grams >> np.uint64(64 - ORDER_BITS)).astype(np.int64), 1)
        yield _sketch(range(slices), own.reshape(slices, width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(at, np.zeros(width, np.int64))[:] += _counts(blob, width)
        yield _sketch(sums, sums.values())

    counts = np.zeros((slices, width), np.int64)
    partial = docs.select("text").mapInArrow(count, "slice int, blob binary")
    for r in partial.repartition(slices, "slice").mapInArrow(add, "slice int, blob binary").collect():
        counts[r["slice"]] = _counts(bytes(r["blob"]), width)
    return cut_order(counts.ravel())


def _sketch(slices: Iterable[int], counts: Iterable[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": pa.array(slices, pa.int32()), "blob": pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in counts], pa.binary())})


def _counts(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=8 * width, codec="zstd", asbytes=True), np.int64)


_READ = "node bigint, doc_id bigint, n bigint, digest binary, counts binary, fine binary, leading binary, bucket int, blob binary"


def read_texts(docs: DataFrame, order_of: GlobalOrder, buckets: int) -> DataFrame:
    """Two kinds of rows. Each document: node, doc_id, n, digest, and counts where it is the first of its node. Each bucket of
    prefix n-grams of some documents: bucket, blob (n-grams, nodes, sizes with
    the top bit set at leading ones).

    A node is a set of n-grams in a task; its copies there share it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(order_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, placed = Shingler(), sent.value
        part, row = TaskContext.get().partitionId(), 0
        nodes: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                node, size, digest, counts, fine, leading = [], [], [], [], [], []
                sig, owner, lead = [], [], []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    grams = shingler(text)
                    row += 1
                    size.append(len(grams))
                    if not len(grams) or doc is None:
                        for x in (node, digest, counts, fine, leading):
                            x.append(None)
                        continue
                    mark = xxhash.xxh3_128_digest(grams.tobytes())
                    digest.append(mark)
                    known = nodes.get(mark)
                    if known is None:
                        known = nodes[mark] = part << 40 | row
                        counts.append(range_counts(grams).tobytes())
                        fine.append(bit_map(grams).tobytes())
                        first, leads = prefix(grams, placed)
                        first = first >> _SHORT
                        leading.append(np.pad(first[leads], (0, LEADING - int(leads.sum()))).tobytes())
                        sig.append(first)
                        lead.append(leads)
                        owner.append((known, len(grams), len(first)))
                    else:
                        counts.append(None)
                        fine.append(None)
                        leading.append(None)
                    node.append(known)
                empty = [None] * len(node)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), piece.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(counts, pa.binary()), pa.array(fine, pa.binary()), pa.array(leading, pa.binary()), pa.array(empty, pa.int32()), pa.array(empty, pa.binary())], names=_READ_NAMES)
                if not sig:
                    continue
                s = np.concatenate(sig)
                lengths = [k for *_, k in owner]
                base = owner[0][0]
                who = np.repeat(np.array([o - base for o, *_ in owner], np.uint16), lengths)
                n = np.repeat(np.array([k for _, k, _ in owner], np.uint32), lengths)
                n |= np.where(np.concatenate(lead), np.uint32(1 << 31), np.uint32(0))
                b = ((s * _K) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(b, kind="stable")
                s, who, n, b = s[order], who[order], n[order], b[order]
                cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                ends = [*cuts[1:].tolist(), len(b)]
                empty = [None] * len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(empty, pa.int64())] * 3 + [pa.array(empty, pa.binary())] * 4 + [pa.array(b[cuts].astype(np.int32)), pa.array([base.to_bytes(8, "little") + _six(s[x:y]) + who[x:y].tobytes() + n[x:y].tobytes() for x, y in zip(cuts.tolist(), ends, strict=True)], pa.binary())],
                    names=_READ_NAMES,
                )

    return docs.select("doc_id", "text").mapInArrow(run, _READ)


_READ_NAMES = [c.split()[0] for c in _READ.split(", ")]


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _six(values: np.ndarray) -> bytes:
    """The low six bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def shared_grams(blobs: DataFrame, partitions: int) -> DataFrame:
    """sig, node, n, leads: the prefix n-grams that two nodes or more of like size share, and whether they lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, 0):
            yield from _shared(table.column(1).to_pylist())

    dealt = blobs.select("bucket", "blob").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "sig bigint, node bigint, n bigint, leads boolean")


def _shared(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    parts: list[list[np.ndarray]] = [[], [], []]
    for blob in blobs:
        k = (len(blob) - 8) // 12
        wide = np.zeros((k, 8), np.uint8)
        wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * k, 8).reshape(k, 6)
        parts[0].append(wide.view("<u8").ravel())
        parts[1].append(np.frombuffer(blob, np.uint16, k, 8 + 6 * k).astype(np.int64) + int.from_bytes(blob[:8], "little"))
        parts[2].append(np.frombuffer(blob[8 + 8 * k :], np.uint32))
    sig, node, n = (np.concatenate(x) for x in parts)
    leads, n = n >> np.uint32(31) > 0, (n & np.uint32((1 << 31) - 1)).astype(np.int64)
    order = np.lexsort((n, sig))
    sig, node, n, leads = sig[order], node[order], n[order], leads[order]
    close = (sig[1:] == sig[:-1]) & (DENOMINATOR * n[:-1] >= NUMERATOR * n[1:])
    keep = np.concatenate([close, [False]]) | np.concatenate([[False], close])
    sig, node, n, leads = sig[keep], node[keep], n[keep], leads[keep]
    for a in range(0, len(sig), 20_000):
        yield pa.RecordBatch.from_pydict({"sig": pa.array(sig[a : a + 20_000].view(np.int64)), "node": pa.array(node[a : a + 20_000]), "n": pa.array(n[a : a + 20_000]), "leads": pa.array(leads[a : a + 20_000])})


def _looked_at(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair with leading n-grams ``a`` and ``b`` (rows) is to be looked at under ``sig``: it shares none of them, or this is the least."""
    none = np.iinfo(np.uint64).max
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a != 0)
    least = np.where(shared, a, none).min(axis=1)
    return (least == none) | (least == sig.view(np.uint64))


class _Groups:
    """Rows by ``sig``, with what bounds their similarity."""

    def __init__(self, batches: list[pa.RecordBatch]):
        got: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            for i in range(4):
                got[i].append(batch.column(i).to_numpy())
            for i, width, kind in ((4, BOUND_RANGES, np.uint8), (5, LEADING, np.uint64)):
                blobs = batch.column(i).to_pylist() if i < batch.num_columns else [b"\0" * 8 * LEADING] * batch.num_rows
                got[i].append(np.frombuffer(b"".join(blobs), kind).reshape(-1, width))
        self.size = sum(len(x) for x in got[0])
        if self.size:
            columns = [np.concatenate(x) for x in got]
            sig, node, _, label = columns[:4]
            order = np.lexsort((label, sig))
            at = np.flatnonzero(np.concatenate([[True], (sig[order][1:] != sig[order][:-1]) | (label[order][1:] != label[order][:-1])]))
            sizes = np.diff(np.concatenate([at, [len(order)]]))
            alike = np.empty(len(order), np.int64)
            alike[order] = np.repeat(sizes, sizes)
            # Within a group, the largest component first; its rows in an order of the group's own, or by node where all stand alone.
            own = _mix(node.view(np.uint64) ^ sig.view(np.uint64) * _K)
            order = np.lexsort((node, np.where(alike > 1, own, np.uint64(0)), -alike, sig))
            self.sig, self.node, self.n, self.label, self.counts, self.leading = (c[order] for c in columns)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
        """Of the index pairs, (node, node, n, n) of those that may link and are to be looked at here, in blocks."""
        for at in range(0, len(i), 50_000):
            a, b = i[at : at + 50_000], j[at : at + 50_000]
            keep = may_link(self.counts[a], self.counts[b], self.n[a], self.n[b])
            a, b = a[keep], b[keep]
            keep = _looked_at(self.sig[a], self.leading[a], self.leading[b])  # all, where no leading n-grams are given
            a, b = a[keep], b[keep]
            if len(a):
                turned = self.node[a] > self.node[b]
                a, b = np.where(turned, b, a), np.where(turned, a, b)
                yield np.stack([self.node[a], self.node[b], self.n[a], self.n[b]], axis=1)

    def all_pairs(self) -> Iterator[np.ndarray]:
        """Pairs of different labels within each group, one distance after the other."""
        for k in range(1, self.size):
            i = np.flatnonzero(self.sig[k:] == self.sig[:-k])
            if not len(i):
                return
            n_i, n_j = self.n[i], self.n[i + k]
            i = i[(self.label[i] != self.label[i + k]) & (DENOMINATOR * np.minimum(n_i, n_j) >= NUMERATOR * np.maximum(n_i, n_j))]
            yield from self.pairs(i, i + k)

    def to_centres(self) -> Iterator[np.ndarray]:
        """Pairs (centre, other) of different labels: each group's first row is a centre, those that may not link to it choose again."""
        left = np.arange(self.size)
        while len(left):
            at = _starts(self.sig[left])
            centre = left[np.repeat(at, np.diff(np.concatenate([at, [len(left)]])))]
            linked = np.zeros(len(left), bool)
            other = np.flatnonzero(left != centre)
            for low in range(0, len(other), 100_000):
                o = other[low : low + 100_000]
                linked[o] = may_link(self.counts[left[o]], self.counts[centre[o]], self.n[left[o]], self.n[centre[o]])
            new = linked & (self.label[centre] != self.label[left])
            yield from self.pairs(centre[new], left[new])
            left = left[(left != centre) & ~linked]


def candidates(rows: DataFrame, partitions: int, centres: bool) -> DataFrame:
    """Pairs (a, b, n_a, n_b), a < b, that may link, from rows (sig, node, n, label, counts[, leading]): to centres, or all of different labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for table in by_key(batches, 0):
            groups = _Groups(table.to_batches())
            for x in groups.to_centres() if centres else groups.all_pairs():
                held.append(x)
                if sum(map(len, held)) > 100_000:
                    yield _pair_batch(held)
                    held = []
        if held:
            yield _pair_batch(held)

    dealt = rows.select("sig", "node", "n", "label", "counts", *["leading"] * (not centres)).repartition(partitions, "sig").sortWithinPartitions("sig")
    return dealt.mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint").distinct()


def _pair_batch(held: list[np.ndarray]) -> pa.RecordBatch:
    x = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_pydict({name: pa.array(x[:, i]) for i, name in enumerate(("a", "b", "n_a", "n_b"))})


def refine(pairs: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """The pairs that the bit maps of both texts let through; ``few`` says that their nodes may be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, left, right = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            keep = [bits_allow(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), m, n) for a, b, m, n in zip(left, right, n_a, n_b, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2, 3])

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    fine = nodes.select("node", "fine").join(F.broadcast(wanted) if few else wanted, "node")
    both = pairs.join(fine.toDF("a", "fine_a"), "a").join(fine.toDF("b", "fine_b"), "b")
    return both.select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint")


def links_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, order_of: GlobalOrder, partitions: int, few: bool) -> DataFrame:
    """The pairs (a, b) that link. ``nodes`` has node, doc_id (of its first document) and digest.

    Each fragment of the global order is compared in groups of its own: a centre's part, then those of its
    leaves. Partial overlaps are summed for each pair. ``few`` says that the pairs' documents may be broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(order_of)
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    spread = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.floor(F.col("degree") / STAR) + 1).cast("int"))
    leaves = spread.select(F.col("b").alias("node"), F.col("a").alias("centre"), "salt", F.lit(True).alias("leaf"))
    centres = spread.select(F.col("a").alias("node"), F.col("a").alias("centre"), "salt", F.lit(False).alias("leaf")).distinct()
    members = leaves.unionByName(centres).groupBy("node").agg(F.collect_list(F.struct("centre", "salt", "leaf")).alias("stars"))
    wanted = members.join(nodes.select("node", "doc_id", "digest"), "node")
    if few:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "node", "digest", "stars")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, placed = Shingler(), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                rows = []
                for text, node, digest, stars in zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True):
                    grams = shingler(text)
                    if xxhash.xxh3_128_digest(grams.tobytes()) != digest:
                        continue  # another text of the same id
                    parts = [x.tobytes() for x in placed.fragments(grams)]
                    rows += [(s["centre"], s["salt"], f, s["leaf"], node, len(grams), x) for s in stars for f, x in enumerate(parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["centre", "salt", "fragment", "leaf", "node", "n", "grams"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre, size, last = None, np.zeros(0, np.uint64), 0, None
        for batch in batches:
            out = []
            for c, salt, f, leaf, node, n, grams in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                own = np.frombuffer(grams, np.uint64)
                if not leaf:
                    key, centre, size, last = (c, salt, f), own, n, None
                elif key == (c, salt, f) and node != last:
                    last = node
                    if len(centre) and len(own):
                        at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                        out.append((c, node, size, n, int((centre[at] == own).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "n_a", "n_b", "k"])

    pieces = texts.mapInArrow(cut, "centre bigint, salt int, fragment int, leaf boolean, node bigint, n bigint, grams binary")
    dealt = pieces.repartition(partitions, "centre", "salt", "fragment").sortWithinPartitions("centre", "salt", "fragment", "leaf", "node")
    partial = dealt.mapInArrow(overlap, "a bigint, b bigint, n_a bigint, n_b bigint, k bigint")
    whole = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))
    return whole.where((NUMERATOR + DENOMINATOR) * F.col("k") >= NUMERATOR * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, label (the least node of its component) for every node of ``links`` (a, b) and of ``labels``, the components
    known so far, which the links join; written to the shared folder.

    Stars are rebuilt around smaller nodes until nothing changes: to all larger neighbours, then among the
    smaller ones. Minima are aggregated and joined, so a hub's links never meet in one task.
    """

    def put(edges: DataFrame) -> tuple[DataFrame, tuple]:
        return measured(edges.where("u <> v").distinct(), F.count("*"), F.bit_xor(F.xxhash64("u", "v")))

    ends = links.select("a", "b")
    for c in ("a", "b") if labels is not None else ():
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")), c, "left").withColumn(c, F.coalesce(f"of_{c}", c))
    edges, state = put(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    while state[0] and state != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = state
        edges, state = put(small.unionByName(least.select("u", F.col("m").alias("v"))))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    if labels is None:
        return found
    moved = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return materialize(moved.unionByName(found.join(labels, "node", "left_anti")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles and component_id, the least id that links reach.

    Null and wordless texts have no n-grams and stand alone; texts of fewer than five words have one.
    Rows that repeat an id belong to the component of each of their texts; rows with a null id are no
    part of any component and get null. Very long texts are read whole: their n-grams are held once, eight bytes
    each. An empty table gives an empty result, and no column but the two named is read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    partitions = partitions_for(rows)
    order_of = learn_order(rows)
    read = materialize(read_texts(rows, order_of, buckets=max(1024, 4 * shares_of(rows, 8.0))))
    info = read.where(F.col("bucket").isNull()).drop("bucket", "blob")
    nodes = info.where(F.col("counts").isNotNull()).select("node", "doc_id", "digest", "counts", "fine", "leading")
    shared = materialize(shared_grams(read.where(F.col("bucket").isNotNull()), partitions))
    bounds = nodes.select("node", "counts", "leading")
    labels = known = None
    for rows_of, centres in (*[(shared.where("leads"), True)] * CENTRE_ROUNDS, (shared, False)):
        labelled = bounds.withColumn("label", F.col("node")) if labels is None else bounds.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pairs, (n,) = measured(candidates(rows_of.join(labelled, "node"), partitions, centres), F.count("*"))
        if not n:
            continue
        pairs = refine(pairs, nodes, n <= BROADCAST_PAIRS)
        pairs, (n,) = measured(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), F.count("*"))
        if not n:
            continue
        found, (linked,) = measured(links_of(pairs, nodes, rows, order_of, partitions, n <= BROADCAST_PAIRS), F.count("*"))
        known = pairs.select("a", "b") if known is None else known.unionByName(pairs.select("a", "b"))
        if linked:
            labels = components(found, labels)
    placed = info.select("doc_id", "node", "n")
    placed = placed.withColumn("label", F.col("node")) if labels is None else placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Written, so that the join below reads both sides as they are and Spark can split a large component's rows.
    least = materialize(placed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id")))
    out = placed.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose id is the least of their component; rows with a null id all stay.

    Texts without words are no copies of each other and stay. Rows that repeat an id stay or go together. An empty table stays empty.
    """
    kept = near_duplicates(docs, id_col, text_col).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return keep_ids(docs, kept, id_col)
