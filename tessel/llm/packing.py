"""Mixture-controlled packing into fixed windows by deficit round-robin over source queues.

Documents are tokenised once, in place, and written with their place in their task's part of their
source queue. Prefix sums over tasks then give each document its token range in its queue.

Target proportions say what each queue is owed of the first T tokens, for every T: its share while it lasts, and
a larger one once another queue has ended. Packing ranges cut T evenly; slice r of a queue holds the whole tokens
that it is owed up to the end of range r and not before. What it is owed beyond whole tokens is the deficit that
the next range begins with. Within a range, deficit round-robin fills window after window, and deficits carry from
window to window. The schedule depends on the queues' totals alone, so each task computes the windows of its own
documents: nothing but a few totals is shuffled or sent.

The tokens of a range that do not fill a window form windows of powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import materialize

END_ID = 1
WINDOW = 2048
#: Tokens of a packing range, about; tokens that a queue is served at once at least, while it has them.
RANGE_TOKENS = 1 << 21
QUANTUM = 128
#: Queues at most, which bounds what every task holds. With more sources, sources share queues by hash: every document is
#: packed all the same, and the mixture is that of the queues.
MAX_QUEUES = 1024
#: Part offsets that are broadcast at most (rows of about 24 bytes); beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Added tokens of the JSON form, which are found in plain text.
ADDED = {"<|endoftext|>": 50256}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def _encoder(ranks_path: str) -> tiktoken.Encoding:
    """The byte-level BPE whose ranks lie at ``ranks_path``; it gives the ids of the JSON form of the same vocabulary, added tokens included."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def queue_of(source: str, queues: dict[str, int] | None) -> int | None:
    """The queue of a source, by ``queues`` or, without them, by a hash; None for a source that has none."""
    return zlib.crc32(source.encode()) % MAX_QUEUES if queues is None else queues.get(source)


def tokenised(docs: DataFrame, ranks_path: str, queues: dict[str, int] | None) -> DataFrame:
    """part, queue, start (in the queue's tokens of this part), n, doc_id, ids (little-endian unsigned 16-bit, end id included).

    ``queues`` maps a source to its queue; None takes a hash of the source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        part = TaskContext.get().partitionId()
        filled: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [np.array([*encoder.encode(t or "", allowed_special="all"), END_ID], "<u2") for t in piece.column(1).to_pylist()]
                queue = [queue_of(s or "", queues) for s in piece.column(2).to_pylist()]
                start = []
                for q, x in zip(queue, ids, strict=True):
                    start.append(filled.get(q, 0))
                    filled[q] = start[-1] + len(x)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(ids), pa.int32()), "queue": pa.array(queue, pa.int32()), "start": pa.array(start, pa.int64()), "n": pa.array([len(x) for x in ids], pa.int64()), "doc_id": piece.column(0), "ids": pa.array([x.tobytes() for x in ids])})

    return docs.mapInArrow(run, "part int, queue int, start bigint, n bigint, doc_id bigint, ids binary")


def part_offsets(tokens: DataFrame, block: int = 256) -> DataFrame:
    """part, queue, base: the queue's tokens in the parts before. Two levels, so no window holds more than ``block`` rows or blocks."""
    each = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("part") / block))
    blocks = each.groupBy("queue", "block").agg(F.sum("n").alias("bn"))
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("block_base", F.coalesce(F.sum("bn").over(before), F.lit(0))).drop("bn")
    inside = Window.partitionBy("queue", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("in_block", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return each.join(blocks, ["queue", "block"]).select("part", "queue", (F.col("in_block") + F.col("block_base")).alias("base"))


def schedule(lengths: list[int], window: int = WINDOW, quantum: int = QUANTUM, owed: list[float] | None = None, due: list[float] | None = None) -> list[list[tuple[int, int, int, int]]]:
    """Deficit round-robin over queues of ``lengths`` tokens: for each queue its services (start, length, window, offset).

    Each window owes each queue its share of the range's tokens: of ``due``, or of ``lengths``. Queues are visited in
    turn; one that is owed a quantum, or all that it has left, is served what it is owed. If a whole turn serves none,
    the queue that is owed most borrows. Deficits begin at ``owed`` (0) and carry from window to window.
    """
    total = sum(lengths)
    sizes = [window] * (total // window)
    rest = total % window
    sizes += [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    left = list(lengths)
    owed = list(owed) if owed else [0.0] * len(lengths)
    share = [n / total if total else 0.0 for n in due or lengths]
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    live = [q for q, n in enumerate(lengths) if n]
    turn = 0
    for w, size in enumerate(sizes):
        for q in live:
            owed[q] += size * share[q]
        space, idle = size, 0
        while space:
            if idle >= len(live):
                q = max(live, key=lambda i: (owed[i], -i))
                take = min(space, left[q], max(quantum, int(owed[q])))
            else:
                if turn >= len(live):
                    turn = 0
                q = live[turn]
                turn += 1
                if owed[q] < min(quantum, left[q]):
                    idle += 1
                    continue
                take = min(space, left[q], int(owed[q]) or 1)
            idle = 0
            out[q].append((lengths[q] - left[q], take, w, size - space))
            left[q] -= take
            owed[q] -= take
            space -= take
            if not left[q]:
                live.remove(q)
                turn = turn - 1 if turn else 0
    return out


def phases(totals: list[int], weights: list[Fraction]) -> list[tuple[Fraction, list[Fraction], list[Fraction]]]:
    """(tokens before, tokens of each queue before, rate of each queue) from the start on, a phase for each time that a queue ends.

    Queues with weight share the tokens by weight; when all of them have ended, the others share by what they have.
    """
    at, used = Fraction(0), [Fraction(0)] * len(totals)
    out = []
    while any(n > u for n, u in zip(totals, used, strict=True)):
        live = [q for q, n in enumerate(totals) if n > used[q]]
        own = {q: weights[q] for q in live if weights[q]} or {q: totals[q] - used[q] for q in live}
        whole = sum(own.values())
        rate = [Fraction(own.get(q, 0)) / whole for q in range(len(totals))]
        out.append((at, list(used), rate))
        span = min((totals[q] - used[q]) / rate[q] for q in own)
        at += span
        used = [u + span * x for u, x in zip(used, rate, strict=True)]
    return out


class Ranges:
    """Slices of the queues and schedules of packing ranges, the latest few kept."""

    def __init__(self, totals: list[int], weights: list[Fraction] | None, range_tokens: int, window: int, quantum: int):
        self.totals, self.window, self.quantum = totals, window, quantum
        self.count = max(1, sum(totals) // range_tokens)
        self.stride = 2 * range_tokens // window + 4 * len(totals) + 64
        self.phases = phases(totals, weights or [Fraction(n) for n in totals])
        self.begins = [p[0] for p in self.phases]
        self.kept: dict[int, list[np.ndarray]] = {}
        self.latest: dict[int, int] = {}
        self.owed_at = cache(self._owed_at)

    def _owed_at(self, r: int) -> list[Fraction]:
        """What each queue is owed of the tokens before range ``r``."""
        if not self.phases:
            return [Fraction(0)] * len(self.totals)
        t = Fraction(sum(self.totals) * r, self.count)
        begin, used, rate = self.phases[bisect_right(self.begins, t) - 1]
        return [u + (t - begin) * x for u, x in zip(used, rate, strict=True)]

    def bound(self, queue: int, r: int) -> int:
        return int(self.owed_at(r)[queue])

    def services(self, queue: int, r: int) -> np.ndarray:
        if r not in self.kept:
            if len(self.kept) >= 64:
                self.kept.pop(next(iter(self.kept)))
            before, after = self.owed_at(r), self.owed_at(r + 1)
            lengths = [int(b) - int(a) for a, b in zip(before, after, strict=True)]
            served = schedule(lengths, self.window, self.quantum, [float(a - int(a)) for a in before], [float(b - a) for a, b in zip(before, after, strict=True)])
            self.kept[r] = [np.array(x, np.int64).reshape(-1, 4) for x in served]
        return self.kept[r][queue]

    def range_of(self, queue: int, a: int) -> int:
        """The range whose slice of the queue holds token ``a``."""
        r = self.latest.get(queue, 0)
        if not self.bound(queue, r) <= a < self.bound(queue, r + 1):
            r = bisect_right(range(1, self.count + 1), a, key=lambda x: self.bound(queue, x))
        self.latest[queue] = r
        return r

    def pieces(self, queue: int, a: int, b: int) -> list[tuple[int, int, int, int]]:
        """The tokens [a, b) of a queue as (start, length, sequence, offset)."""
        out = []
        while a < b:
            r = self.range_of(queue, a)
            low, high = self.bound(queue, r), self.bound(queue, r + 1)
            s = self.services(queue, r)
            end = min(b, high)
            k = int(np.searchsorted(s[:, 0], a - low, side="right")) - 1
            while a < end:
                start, length, w, offset = map(int, s[k])
                inside = a - low - start
                n = min(length - inside, end - a)
                out.append((a, n, r * self.stride + w, offset + inside))
                a += n
                k += 1
        return out


def pack(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, range_tokens: int = RANGE_TOKENS, quantum: int = QUANTUM, targets: dict[str, float] | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``targets`` gives each source's share of the tokens, by which windows are filled as long as its documents last;
    sources without one come last. None takes the shares of the corpus. Null text counts as empty and packs its end id
    alone; null sources share the queue of the empty name. Each row is packed for itself, repeated ids too.
    Very long texts are tokenised and cut whole.
    Window sizes are ``window`` or smaller powers of two, so nothing is padded. An empty table gives an
    empty result, and only the three named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    names = sorted(r[0] for r in rows.select("source").distinct().limit(MAX_QUEUES + 1).collect())
    queues = {s: i for i, s in enumerate(names)} if len(names) <= MAX_QUEUES else None
    tokens = materialize(tokenised(rows, ranks_path, queues))
    offsets = materialize(part_offsets(tokens.select("part", "queue", "n")))
    found = dict(tokens.groupBy("queue").agg(F.sum("n")).collect())
    totals = [int(found.get(q, 0)) for q in range(max(found, default=-1) + 1)]
    weights = None
    if targets is not None:
        weights = [Fraction(0)] * len(totals)
        for source, share in targets.items():
            q = queue_of(source, queues)
            if q is not None and q < len(totals):
                weights[q] += Fraction(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(totals, weights, range_tokens, window, quantum)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                chunk = batch.slice(at, 1024)
                doc, start, length, crc, size, seq, offset = ([] for _ in range(7))
                for d, q, first, n, ids in zip(*(chunk.column(i).to_pylist() for i in range(5)), strict=True):
                    wide = np.frombuffer(ids, "<u2").astype("<u4")
                    for a, k, s, o in ranges.pieces(q, first, first + n):
                        doc.append(d)
                        start.append(a - first)
                        length.append(k)
                        crc.append(zlib.crc32(wide[a - first : a - first + k]))
                        size.append(n)
                        seq.append(s)
                        offset.append(o)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, size, seq, offset)], names=NAMES)

    small = offsets.count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(offsets) if small else offsets, ["part", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("start")).alias("first"), "n", "ids")
    return placed.mapInArrow(run, ", ".join(f"{n} bigint" for n in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
