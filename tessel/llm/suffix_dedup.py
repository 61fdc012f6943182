"""Removal of repeated substrings by suffix order: every byte in a string of ``LENGTH`` bytes that an earlier document holds.

Every window of ``LENGTH`` bytes has an anchor, the 24 bytes in it of least hash (the first of equals), and
consecutive windows with one anchor form a run. Equal windows have equal anchors, so:

1. Documents are dealt to groups by their id. Each group reports its distinct anchors and about how many
   distinct runs each has; anchors that no other document has are done with.
2. Runs of shared anchors go, by anchor, to shards. A shard sorts the suffixes of its runs, takes the
   Burrows-Wheeler transform and extends intervals backwards, breadth first: common prefixes of
   neighbouring suffixes come out by increasing length, and the search stops at ``LENGTH``. What is not
   split by then are the classes of equal windows; each window not in its class's least document goes.
   Anchors of very many distinct runs are hot: each of their windows is a run of its own, dealt by its own hash, so
   that no shard gets all surroundings of a frequent passage. It is compared in the same way.
3. Each group gets the ranges of its documents that go.

Equal runs meet within their group first, so a text with very many copies sends one run for each group.
The three passes over the text read one exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import MOST_PARTITIONS, by_key, shares_of

LENGTH = 50
GRAM = 24
#: An anchor in this many groups is hot, where a group counts for each of its distinct runs (in powers of two): they are
#: more than a shard sorts at once. How its windows are dealt depends on it, and no result.
HOT_GROUPS = 1 << 15
#: Bits of an anchor's hash that are sent, besides its bucket; the lowest tell the power of two of its distinct runs in a group.
_KEY = np.uint64((1 << 48) - 16)
_POWER = np.uint64(15)
#: MB of input for each group of documents, and for each bucket of anchors: the first of each until there are ``MANY`` of
#: them, then as many up to the second, as each group may send a row to each bucket.
GROUP_MB, BUCKET_MB, MANY = (1.0, 3.0), (2.0, 8.0), 512
#: Positions that minima are taken over at once, and bits that hold one.
_BLOCK, _PLACE = 1 << 16, 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _loads(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, zeros beyond the end."""
    padded = np.concatenate([raw, np.zeros(15, np.uint8)])
    out = np.empty(len(raw) + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (len(padded) - k) // 8 * 8].view(">u8")
        out[k::8] = part[: len(out[k::8])]
    return out[: len(raw)]


def _gram_hashes(load: np.ndarray, later: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of 24 bytes, given as three numbers each."""
    h = load * np.uint64(0x9E3779B97F4A7C15)
    h += later * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h += last * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Group:
    """The documents of a group in order of id, and the runs of their windows."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        order = sorted((i for i, d in enumerate(ids) if d is not None), key=lambda i: (ids[i], texts[i]))
        loose = [i for i, d in enumerate(ids) if d is None]
        self.rest = [(None, texts[i]) for i in loose]
        self.order = order + loose
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]

    def find_runs(self) -> None:
        """Sets raw, base (of each document in raw) and, for each run: row, first, last (windows in raw), key, copy.

        Documents that repeat the text of an earlier row have no runs; ``same_as`` leads to that row.
        """
        first_of: dict[bytes, int] = {}
        self.same_as = np.array([first_of.setdefault(t, i) for i, t in enumerate(self.texts)], np.int64)
        own = [i for i, t in enumerate(self.texts) if self.same_as[i] == i and len(t) >= LENGTH]
        self.raw = np.frombuffer(b"".join(self.texts[i] for i in own), np.uint8)
        sizes = np.array([len(self.texts[i]) for i in own], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(own) else np.zeros(0, np.int64)
        self.base = dict(zip(own, starts.tolist(), strict=True))
        self.load = _loads(self.raw)
        n = len(self.raw) - LENGTH + 1
        if n < 1:
            self.row = self.first = self.last = np.zeros(0, np.int64)
            self.key = self.bucket_key = np.zeros(0, np.uint64)
            return
        place = np.uint64((1 << _PLACE) - 1)
        places = np.arange(_BLOCK + LENGTH, dtype=np.uint64)
        anchor = np.empty(n, np.int64)
        for low in range(0, n, _BLOCK):
            many = min(_BLOCK, n - low) + LENGTH - GRAM
            v = _gram_hashes(*(self.load[low + k : low + k + many] for k in (0, 8, 16)))
            v &= ~place
            v |= places[:many]
            for k in (1, 2, 4, 8, 11):
                v = np.minimum(v[:-k], v[k:])
            v &= place
            anchor[low : low + len(v)] = v
            anchor[low : low + len(v)] += low
        # No window crosses the end of a document.
        ends = (starts + sizes)[:-1]
        crossing = (ends[:, None] - np.arange(1, LENGTH)).ravel()
        anchor[crossing] = -1
        change = np.flatnonzero(anchor[1:] != anchor[:-1])
        first = np.concatenate([[0], change + 1])
        last = np.concatenate([change, [n - 1]])
        real = anchor[first] >= 0
        self.first, self.last = first[real], last[real]
        self.row = np.array(own, np.int64)[np.searchsorted(starts, self.first, side="right") - 1]
        at = anchor[self.first]
        self.key = _gram_hashes(*(self.load[at + k] for k in (0, 8, 16)))
        self.bucket_key, self.key = self.key >> np.uint64(40), self.key & _KEY

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, with the power of two of their distinct runs (told by length and ends), and what their buckets come from."""
        run = self.load[self.first] * np.uint64(0x9E3779B97F4A7C15) + self.load[self.last + LENGTH - 8]
        run = _mix(run + (self.last - self.first).astype(np.uint64))
        order = np.lexsort((run, self.key))
        key, run = self.key[order], run[order]
        at = _groups(key)
        if not len(at):
            return key, key
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (run[1:] != run[:-1])])
        power = np.minimum(np.log2(np.add.reduceat(new.astype(np.int64), at)).astype(np.uint64), _POWER)
        return key[at] | power, self.bucket_key[order][at]


def _groups(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _slices(key: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers begins and ends; none of an empty array."""
    at = _groups(key).tolist()
    return list(zip(at, [*at[1:], len(key)][: len(at)], strict=True))


def report_anchors(table: pa.Table, buckets: int) -> pa.Table:
    """bucket, pid, keys: the group's distinct anchors, six bytes each."""
    group = Group(table)
    group.find_runs()
    pid = table.column("pid")[0].as_py()
    keys, of = group.anchors()
    b = (of % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    keys, b = keys[order], b[order]
    cuts = _slices(b)
    return pa.table({"bucket": pa.array([int(b[x]) for x, _ in cuts], pa.int32()), "pid": pa.array([pid] * len(cuts), pa.int32()), "keys": pa.array([_six(keys[x:y]) for x, y in cuts], pa.binary())})


def _six(keys: np.ndarray) -> bytes:
    """The low six bytes of each number."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def match_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pid, hot, keys: for each group, its anchors that another group has too, from rows in order of bucket."""
    for table in by_key(batches, 0):
        yield from _match(table)


def _match(table: pa.Table) -> Iterator[pa.RecordBatch]:
    blobs = table.column(2).to_pylist()
    key = _from_six(b"".join(blobs))
    pid = np.repeat(np.array(table.column(1), np.int32), [len(b) // 6 for b in blobs])
    order = np.argsort(key)
    key, pid = key[order], pid[order]
    power = (key & _POWER).astype(np.int64)
    key = key & _KEY
    at = _groups(key)
    if not len(at):
        return
    sizes = np.diff(np.concatenate([at, [len(key)]]))
    n, runs = np.repeat(sizes, sizes), np.repeat(np.add.reduceat(1 << power, at), sizes)
    key, pid, hot = key[n > 1], pid[n > 1], runs[n > 1] >= HOT_GROUPS
    order = np.lexsort((hot, pid))
    key, pid, hot = key[order], pid[order], hot[order]
    cuts = _slices(pid * 2 + hot)
    for a in range(0, len(cuts), 1000):
        some = cuts[a : a + 1000]
        yield pa.RecordBatch.from_pydict({"pid": pa.array([int(pid[x]) for x, _ in some], pa.int32()), "hot": pa.array([bool(hot[x]) for x, _ in some], pa.bool_()), "keys": pa.array([_six(key[x:y]) for x, y in some], pa.binary())})


_PIECE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("pid", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())])
PIECE = "bucket int, kind int, pid int, size bigint, blob binary"
#: Kinds of pieces: ranges that go; runs with their places.
GOES, RUN = 0, 1
_HEAD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("length", "<i4"), ("places", "<i4")])


def _packed(blob: bytes) -> tuple[int, bytes]:
    return len(blob), pa.compress(blob, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)


def send_runs(pid: int, table: pa.Table, shared: pa.Table, buckets: int) -> pa.Table:
    """Pieces for the shards: the group's runs of shared anchors, each distinct run once, and what goes for certain."""
    group = Group(table)
    group.find_runs()
    cold, hot = (np.sort(_from_six(b"".join([k for k, h in zip(shared.column("keys").to_pylist(), shared.column("hot").to_pylist(), strict=True) if h == want]))) for want in (False, True))
    order = np.lexsort((group.row, group.key))
    key, row = group.key[order], group.row[order]
    at = _groups(key)
    several = np.zeros(len(key), bool)
    if len(at):
        ends = np.concatenate([at[1:], [len(key)]])
        several = np.repeat(group.ids[row[at]] != group.ids[row[ends - 1]], ends - at)
    is_hot = np.isin(key, hot)
    take = several | is_hot | np.isin(key, cold)
    order, is_hot = order[take], is_hot[take]
    raw = group.raw.tobytes()
    goes: list[tuple[int, int, int]] = []
    rows: list[tuple] = []
    runs: dict[bytes, list] = {}
    base = group.base
    ids = group.ids.tolist()
    plain = order[~is_hot]
    for k, a, b, r in zip(group.key[plain].tolist(), group.first[plain].tolist(), (group.last[plain] + LENGTH).tolist(), group.row[plain].tolist(), strict=True):
        start = a - base[r]
        entry = runs.get(raw[a:b])
        if entry is None:
            runs[raw[a:b]] = [k, r, start]
        elif ids[entry[1]] == ids[r]:
            entry += (r, start)
        else:
            goes.append((r, start, start + b - a))
    dealt: dict[int, list[tuple[bytes, list]]] = {}
    for run, entry in runs.items():
        dealt.setdefault((entry[0] >> 4) % buckets, []).append((run, entry))
    picked = order[is_hot]
    if len(picked):
        lengths = group.last[picked] - group.first[picked] + 1
        owner = np.repeat(np.arange(len(picked)), lengths)
        at = group.first[picked][owner] + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        r = group.row[picked][owner]
        windows = np.lib.stride_tricks.sliding_window_view(group.raw, LENGTH)[at].view(f"S{LENGTH}").ravel()
        order = np.lexsort((at, r, windows))
        at, r, windows = at[order], r[order], windows[order]
        key = np.zeros(len(at), np.uint64)
        for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + group.load[at + k])
        cuts = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]]))
        later = group.ids[r] > group.ids[np.repeat(r[cuts], np.diff(np.concatenate([cuts, [len(r)]])))]
        place = at - np.array([base.get(i, 0) for i in range(len(ids))], np.int64)[r]
        goes += zip(r[later].tolist(), place[later].tolist(), (place[later] + LENGTH).tolist(), strict=True)
        for k, a, x, y in zip(key[cuts].tolist(), at[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            same = ~later[x:y]
            entry = [k, *np.stack([r[x:y][same], place[x:y][same]], axis=1).ravel().tolist()]
            dealt.setdefault(k % buckets, []).append((raw[a : a + LENGTH], entry))
    for bucket, some in dealt.items():
        head = np.array([(e[0], ids[e[1]], len(x), len(e) // 2) for x, e in some], _HEAD)
        places = np.array([v for _, e in some for v in e[1:]], "<i4")
        rows.append((bucket, RUN, pid, *_packed(np.array([len(some), len(places)], "<i8").tobytes() + head.tobytes() + places.tobytes() + b"".join([x for x, _ in some]))))
    if goes:
        rows.append((pid % buckets, GOES, pid, *_packed(_ranges(np.array(goes, np.int64)))))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_PIECE), _PIECE, strict=True)], schema=_PIECE)


def _ranges(found: np.ndarray) -> bytes:
    """(row, start, end) merged where they meet, as 32-bit numbers."""
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    reach = np.maximum.accumulate(found[:, 2] + (found[:, 0] << 32))
    new = np.concatenate([[True], (found[1:, 1] + (found[1:, 0] << 32)) > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(found)]]) - 1
    return np.stack([found[at, 0], found[at, 1], reach[last] & 0xFFFFFFFF], axis=1).astype(np.int32).tobytes()


def suffix_order(text: np.ndarray, depth: int = 64) -> np.ndarray:
    """Positions of ``text`` in the order of the ``depth`` bytes from them on, by doubling; equals in any order."""
    n = len(text)
    key = _loads(text)
    order = np.argsort(key)
    length = 8
    while True:
        same = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(same)
        if length >= depth or rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: max(0, n - length)] = rank[length:] + 1
        key = rank << 32 | later
        order = np.argsort(key)
        length *= 2


def prefix_classes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each row of the suffix order, whether a class of equal prefixes of ``length`` bytes begins there.

    Breadth-first backward extension over the Burrows-Wheeler transform: from the intervals whose common
    prefix is known come those that one more byte before makes. An interval that ends at a row where no
    common prefix is known yet tells its length, and is extended in the next round; intervals that tell
    nothing new are dropped. Rounds end at ``length``. The transform is taken around the end of the text, so the
    text must end with a byte that the prefixes asked about do not hold.
    """
    n = len(text)
    before = text[order - 1]
    lf = np.empty(n, np.int64)
    lf[np.argsort(before, kind="stable")] = np.arange(n)
    begins = np.zeros(n + 1, bool)
    begins[0] = begins[n] = True
    stamp = np.full(n + 1, -1, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    named = 0
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        rows = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        # One block for each interval and byte: rows of an interval that follow the same byte lie together in the image.
        image = lf[rows]
        block = np.repeat(np.arange(len(low)), sizes) * 256 + before[rows] + named
        named += len(low) * 256
        stamp[image] = block
        starts = np.sort(image[stamp[image - 1] != block])
        ends = np.sort(image[stamp[image + 1] != block]) + 1
        new = ~begins[ends]
        low, high = starts[new], ends[new]
        begins[high] = True
    return begins[:n]


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pid, ranges (row, start, end): what goes, from the pieces of a shard in order of bucket."""
    for table in by_key(batches, 0, 8.0):  # compressed
        yield from _judge_pieces(table)


def _judge_pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
    heads, places, pids, texts = [], [], [], []
    for kind, pid, size, blob in zip(*(table.column(i).to_pylist() for i in range(1, 5)), strict=True):
        blob = _unpacked(blob, size)
        if kind == GOES:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "ranges": pa.array([blob], pa.binary())})
            continue
        n, k = np.frombuffer(blob[:16], "<i8").tolist()
        at = 16 + n * _HEAD.itemsize
        heads.append(np.frombuffer(blob[16:at], _HEAD))
        places.append(np.frombuffer(blob[at : at + 4 * k], "<i4").reshape(-1, 2))
        pids.append(np.full(n, pid, np.int64))
        at += 4 * k
        for length in heads[-1]["length"].tolist():
            texts.append(blob[at : at + length])
            at += length
    if not texts:
        return
    goes = _judge_runs(np.concatenate(heads), np.concatenate(places).astype(np.int64), np.concatenate(pids), texts)
    goes = goes[np.argsort(goes[:, 0], kind="stable")]
    for x, y in _slices(goes[:, 0]):
        yield pa.RecordBatch.from_pydict({"pid": pa.array([int(goes[x, 0])], pa.int32()), "ranges": pa.array([_ranges(goes[x:y, 1:])], pa.binary())})


def _judge_runs(head: np.ndarray, places: np.ndarray, pid: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """(pid, row, start, end) that go by runs: those that a smaller document has whole, and equal windows of different runs."""
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(x, len(number)) for x in texts], np.int64)
    distinct = list(number)
    doc = head["doc"]
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    key = np.empty(len(distinct), np.uint64)
    key[same] = head["key"]
    place_at = np.concatenate([[0], np.cumsum(head["places"])]).astype(np.int64)

    def at_places(run: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The spans [a, b) of runs at each of their places."""
        times = head["places"][run].astype(np.int64)
        each = np.repeat(np.arange(len(run)), times)
        at = place_at[run][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        return np.stack([pid[run][each], places[at, 0], places[at, 1] + a[each], places[at, 1] + b[each]], axis=1)

    later = np.flatnonzero(doc > least[same])
    out = [at_places(later, np.zeros(len(later), np.int64), head["length"][later].astype(np.int64))]
    which, a, b = _repeated(distinct, key, least)
    if len(which):
        first = np.flatnonzero(doc == least[same])
        first = first[np.argsort(same[first], kind="stable")]
        low, high = (np.searchsorted(same[first], which, side=x) for x in ("left", "right"))
        each = np.repeat(np.arange(len(which)), high - low)
        run = first[low[each] + np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
        out.append(at_places(run, a[each], b[each]))
    return np.concatenate(out)


#: Bytes of runs whose suffixes are sorted at once; runs of one anchor stay together.
SORTED_BYTES = 1 << 21


def _repeated(runs: list[bytes], key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the bytes in windows that another run of the same anchor and of a smaller document holds."""
    order = np.lexsort((doc, key))
    at = _groups(key[order])
    ends = np.concatenate([at[1:], [len(order)]])
    several = doc[order[at]] != doc[order[ends - 1]]
    found = []
    some: list[int] = []
    size = 0
    for a, b in zip(at[several].tolist(), ends[several].tolist(), strict=True):
        members = order[a:b].tolist()
        some += members
        size += sum([len(runs[i]) + 1 for i in members])
        if size >= SORTED_BYTES:
            found.append(_mark(runs, doc, some))
            some, size = [], 0
    if some:
        found.append(_mark(runs, doc, some))
    whole = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return whole[:, 0], whole[:, 1], whole[:, 2]


def _mark(runs: list[bytes], doc_of: np.ndarray, some: list[int]) -> np.ndarray:
    text = np.frombuffer(b"".join([runs[i] + b"\xff" for i in some]), np.uint8)
    sizes = np.array([len(runs[i]) for i in some])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order = suffix_order(text)
    begins = prefix_classes(text, order)
    which = np.repeat(np.arange(len(some)), sizes + 1)
    inside = np.arange(len(text)) - starts[which]
    window = inside + LENGTH <= sizes[which]
    doc = np.where(window, doc_of[some][which], np.iinfo(np.int64).max)[order]
    at = np.flatnonzero(begins)
    least = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.concatenate([at, [len(doc)]])))
    found = np.sort(order[(doc > least) & window[order]])
    if not len(found):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], np.diff(found) != 1]))
    a, b = found[cut], found[np.concatenate([cut[1:], [len(found)]]) - 1]
    return np.stack([np.array(some, np.int64)[which[a]], inside[a], inside[b] + LENGTH], axis=1)


def apply_ranges(table: pa.Table, flags: pa.Table, keep_text: bool) -> pa.Table:
    """The group's documents with what is left of them."""
    group = Group(table)
    found = [np.frombuffer(x, np.int32).reshape(-1, 3) for x in flags.column("ranges").to_pylist()]
    ranges: dict[int, list[tuple[int, int]]] = {}
    if found:
        merged = np.frombuffer(_ranges(np.concatenate(found).astype(np.int64)), np.int32).reshape(-1, 3)
        for r, a, b in merged.tolist():
            ranges.setdefault(r, []).append((a, b))
    first_of: dict[bytes, int] = {}
    out = []
    for i, (doc, text) in enumerate([*zip(group.ids.tolist(), group.texts, strict=True), *group.rest]):
        spans = []
        if doc is not None:
            first = first_of.setdefault(text, i)
            if group.ids[first] < doc and len(text) >= LENGTH:
                spans = [(0, len(text))]
            else:
                spans = ranges.get(first, [])
        kept, at = [], 0
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        rest = b"".join([*kept, text[at:]])
        out.append((doc, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep_text else None))
    columns = list(zip(*out, strict=True))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    made = pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
    if not keep_text:
        return made.drop_columns(["text"])
    return made.append_column("carried", table.column("carried").take(pa.array(group.order, pa.int64()))) if "carried" in table.column_names else made


def shape(rows: DataFrame, least: int) -> tuple[int, int, int]:
    """Groups of documents, buckets of anchors and the tasks that these are dealt to, as many for each; ``least`` of each."""
    groups, buckets = (max(least, min(shares_of(rows, first), MANY), shares_of(rows, second)) for first, second in (GROUP_MB, BUCKET_MB))
    tasks = min(buckets, max(least, MOST_PARTITIONS))
    return groups, -(-buckets // tasks) * tasks, tasks


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the text left
    and a struct ``carried`` of other columns.

    A byte goes if a string of 50 bytes that covers it also starts in a document of a smaller id; matches
    are judged on the input. Null text counts as empty; texts under 50 bytes stay whole. Rows that repeat
    an id never take from each other. Rows with a null id stay whole and take nothing. Very long texts are read whole. A range may cut a
    character; the text left then drops the bytes of that character that remain (the digest keeps
    them). An empty table gives an empty result, and only the two named columns and those carried are read.
    """
    extra = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    groups, buckets, tasks = shape(rows, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(groups)).cast("int").alias("pid"), *rows.columns)
    anchors = rows.groupBy("pid").applyInArrow(lambda t: report_anchors(t, buckets), "bucket int, pid int, keys binary")
    shared = anchors.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket").mapInArrow(match_anchors, "pid int, hot boolean, keys binary")
    none = pa.table({"pid": pa.array([], pa.int32()), "hot": pa.array([], pa.bool_()), "keys": pa.array([], pa.binary())})

    def send(texts: pa.Table, keys: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _PIECE.empty_table()
        return send_runs(texts.column("pid")[0].as_py(), texts, keys if keys.num_rows else none, buckets)

    pieces = rows.groupBy("pid").cogroup(shared.groupBy("pid")).applyInArrow(send, PIECE)
    flags = pieces.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket").mapInArrow(judge, "pid int, ranges binary")

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        return apply_ranges(texts, found, keep_text)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * keep_text
    if carry and keep_text:
        schema += f", carried {rows.schema['carried'].dataType.simpleString()}"
    return rows.groupBy("pid").cogroup(flags.groupBy("pid")).applyInArrow(finish, schema)
