"""Exact removal of byte strings that documents with smaller ids hold too, by suffix arrays.

A byte goes if a 50-byte string (a window) over it also starts in a document of smaller id. Documents are dealt by ranges of the
id to shards of a few megabytes, each a file in the shared folder, so that shards come in the order of ids.

1. Suffix arrays of all text would have to meet those of all other text, so windows that can't repeat are left out first.
   Every window has an anchor that its content alone decides: equal windows have equal anchors. Shards exchange their anchors
   (a number each, in plane-coded steps); what has an anchor that no other run of windows has, repeats nowhere. Equal anchors
   decide nothing more.
2. Every shard builds the suffix array of the stretches that are left: Larsson-Sadakane refinement in numpy orders the suffixes
   (8, 16, 32 and then 50 bytes, only groups still tied are sorted again), Kasai's common prefixes of neighbours tell which
   windows are equal. Windows that a smaller id of the shard has too are found there. Of the windows whose anchors other shards
   have, the first place of each sends its bytes on, by anchor.
3. Every bucket of anchors builds the suffix arrays of what it got, from as many shards as fit one array, and merges the
   arrays' distinct windows by binary search. The first shard keeps a window and later ones are told.
4. Every shard removes what it found itself and what it was told, with the same windows elsewhere in the same documents.

So all that is removed was found equal byte for byte in a suffix array. An anchor that very many runs have is dealt further, window
by window, by a hash of the window, so that no task holds all runs of a hot anchor.

Each stage's result is a written table or file and tasks name their files by attempt, so a lost executor's work is repeated
without harm. What a task holds is bounded by the shard and bucket sizes, but for a single document or a single id's rows.

Defined cases: a null text is empty; a null id comes after every other id, and rows with equal or null ids never remove
anything from one another; repeated rows get equal results; texts shorter than 50 bytes keep all; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, stash
from tidemark.llm.files import from_planes, get, pack_arrays, put, to_planes, unpack_arrays

#: Bytes of a repeated string, and of the grams that anchor its windows.
LENGTH, GRAM = 50, 24
#: Text bytes of a shard, and of one suffix array; documents of a shard; anchors of a bucket.
SHARD_BYTES, ARRAY_BYTES, SHARD_DOCS, BUCKET = 4 << 20, 1 << 20, 1 << 20, 1 << 19
#: Runs that one anchor may have before its windows are dealt one by one.
HOT = 1 << 16
#: Windows handled at once, which bounds the memory of a task whatever a text's length.
STEP = 1 << 20
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C3
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data.tobytes() if not data.flags.c_contiguous else data.data, strides=(1,))


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position."""
    w = _words(data)
    n = len(data) - GRAM + 1
    return _mix(_mix(_mix(w[:n] * _C1) + w[8 : 8 + n] * _C2) + w[16 : 16 + n] * _C1)


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    least, have = key, 1
    while have < width:
        by = min(have, width - have)
        least = np.minimum(least[:-by], least[by:])
        have += by
    return least


class Runs:
    """Maximal runs of windows of one document that share their anchor.

    A window's anchor is its gram of least hash, the leftmost of equal ones, so equal windows have it at the same place.
    first, count: first window and number of windows; anchor: hash of the anchoring gram. Two windows are equal only if their
    runs have equal anchors.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        parts = []
        n = len(data)
        usable = np.zeros(max(0, n - LENGTH + 1), np.int8)
        long = ends - starts >= LENGTH
        mark = np.zeros(len(usable) + 1, np.int32)
        np.add.at(mark, starts[long], 1)
        np.add.at(mark, ends[long] - LENGTH + 1, -1)
        usable = np.cumsum(mark[:-1]) > 0
        for at in range(0, len(usable), STEP):
            stop = min(at + STEP, len(usable))
            piece = np.ascontiguousarray(data[at : stop + LENGTH - 1])
            gram = _grams(piece)
            key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
            place = (_sliding_least(key, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            ok = usable[at:stop]
            new = ok.copy()
            new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
            first = np.flatnonzero(new)
            if not len(first):
                continue
            turn = np.cumsum(new)
            count = np.bincount(turn[ok], minlength=len(first) + 1)[1:]
            parts.append((first + at, count, _mix(gram[place[first]] * _C1)))  # least hashes are small; buckets need even ones
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        self.first, self.count, anchor = (np.concatenate(x) for x in zip(none, *parts))
        self.anchor = anchor >> np.uint64(16)


class Shard:
    """One shard's texts; documents of one id count as one."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, ids: np.ndarray, known: np.ndarray):
        self.data, self.ends, self.ids, self.known = data, ends, ids, known
        self.starts = np.r_[0, ends[:-1]] if len(ends) else ends
        change = np.r_[False, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])] if len(ids) else np.zeros(0, bool)
        self.number = np.cumsum(change)

    @classmethod
    def load(cls, path: str) -> Shard:
        z = unpack_arrays(get(path))
        return cls(z["data"], z["ends"], z["ids"], z["known"])

    def doc(self, place: np.ndarray) -> np.ndarray:
        return self.number[np.searchsorted(self.ends, place, side="right")] if len(place) else place

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs' first windows, counts and anchors in order of (anchor, place); the distinct anchors, and where each one's runs start."""
        runs = Runs(self.data, self.starts, self.ends)
        order = np.argsort(runs.anchor, kind="stable")
        anchor = runs.anchor[order]
        cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(order) else order
        return runs.first[order], runs.count[order], anchor, anchor[cut], cut


def _coded(x: np.ndarray) -> bytes:
    """Ascending 48-bit numbers as plane-coded steps."""
    return pack_arrays(n=np.array([len(x)]), p=np.frombuffer(b"".join(planes := to_planes(np.diff(x, prepend=np.uint64(0)))), np.uint8), k=np.array([len(planes)]))


def _decoded(content: bytes) -> np.ndarray:
    z = unpack_arrays(content)
    n, k, p = int(z["n"][0]), int(z["k"][0]), z["p"].tobytes()
    return np.cumsum(from_planes([p[i * n : (i + 1) * n] for i in range(k)], n, np.uint64), dtype=np.uint64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_RECORDS = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("anchor", pa.binary()), ("runs", pa.binary())])
_REPLIES = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("anchor", pa.binary()), ("parts", pa.binary())])
_SPANS = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("content", pa.binary())])
_MASKS = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("content", pa.binary())])
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {dict(int64='long', int32='int').get(str(f.type), str(f.type))}" for f in schema)


def refine(data: np.ndarray, window: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: the suffixes at the windows (or all) in order of their first LENGTH bytes (what ends before is followed
    by zeros), equal ones by place, and their ranks.

    A round sorts those still tied by the rank of what follows what they are known to share, so it needs ranks only of the
    windows and of the places that later rounds look at from there.
    """
    n = len(data)
    need = [np.ones(n, bool) if window is None else np.bincount(window, minlength=n) > 0]
    shifts = (8, 16, LENGTH - 32)
    for shift in reversed(shifts):
        later = need[-1].copy()
        later[shift:] |= need[-1][:-shift]
        need.append(later)
    key = _words(np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)]))[:n].byteswap()
    sa = np.flatnonzero(need.pop())
    order = np.argsort(key[sa])
    sa, key = sa[order], key[sa[order]]
    rank = np.full(n + LENGTH, -1, np.int32 if n < 1 << 31 else np.int64)  # of a suffix: the first slot of its group; past the end below all
    at = np.arange(len(sa))
    rank[sa] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0)) if n else at
    del key, order, at
    for shift in shifts:
        sa = sa[need.pop()[sa]]
        group = rank[sa]
        tied = group[1:] == group[:-1]
        slots = np.flatnonzero(np.r_[False, tied] | np.r_[tied, False]) if len(sa) else sa
        if not len(slots):
            continue
        suffix, group = sa[slots], group[slots]
        both = group.astype(np.int64) * (n + 1) + rank[suffix + shift] + 1
        order = np.argsort(both)
        suffix, both = suffix[order], both[order]
        at = np.arange(len(slots))
        start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
        sub = np.maximum.accumulate(np.where(np.r_[True, both[1:] != both[:-1]], at, 0))
        sa[slots] = suffix
        rank[suffix] = group + sub - start
    ranks = rank[sa]
    order = np.argsort(ranks.astype(np.int64) * (n + 1) + sa)
    return sa[order], ranks[order]


def common_prefixes(data: np.ndarray, sa: np.ndarray, lanes: int = 16) -> np.ndarray:
    """Kasai's common prefix of each of the suffixes sa with the one before it, up to LENGTH bytes.

    Where the neighbour of a suffix is one byte behind the neighbour of the suffix a byte earlier, they share what those share,
    less one, so only what comes after that is compared. Places go in lanes: all that are first in theirs start from nothing,
    at once, and those after them take up from there.
    """
    n = len(data)
    words = _words(np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)]))
    before, out = np.full(n, -2, np.int32 if n < 1 << 31 else np.int64), np.zeros(n, np.int8)
    before[sa[1:]] = sa[:-1]
    place = np.sort(sa[1:])
    turn = place % lanes
    by = np.argsort(turn.astype(np.int8), kind="stable")
    ends = np.searchsorted(turn[by], np.arange(lanes + 1))
    for lane in range(lanes):
        at = place[by[ends[lane] : ends[lane + 1]]]
        other = before[at]
        have = np.where(before[at - 1] + 1 == other, np.maximum(out[at - 1] - 1, 0), 0).astype(np.int64) if lane else np.zeros(len(at), np.int64)
        rest = np.arange(len(at))
        while len(rest):
            a, b, k = at[rest], other[rest], have[rest]
            unlike = words[a + k] ^ words[b + k]
            low = unlike & (~unlike + np.uint64(1))
            have[rest] = k = np.minimum(k + np.where(unlike == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8), LENGTH)
            rest = rest[(unlike == 0) & (k < LENGTH)]
        out[at] = have
    return out[sa]


def equal_windows(data: np.ndarray, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-array order of the windows (start positions), their classes of equal windows from 0 up, and each class's least place."""
    sa, _ = refine(data, window)
    which = np.full(len(data), -1, np.int64)
    which[window] = np.arange(len(window))
    order = which[sa]
    new = common_prefixes(data, sa) < LENGTH
    return order, np.cumsum(new) - 1, np.minimum.reduceat(place[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)


def first_places(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For arrays (data, window, place): the least place of any array at which each window is.

    The arrays' distinct windows are merged in order by binary search, each with its least place.
    """
    found = [equal_windows(*p) for p in parts]
    keys, merged, least = [], np.zeros(0, f"S{LENGTH}"), np.zeros(0, np.int64)
    if len(parts) > 1:
        for (data, window, _), (order, cls, mine) in zip(parts, found):
            head = window[order[np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])]] if len(order) else window[:0]
            key = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[head].copy().view(f"S{LENGTH}").ravel() if len(head) else merged[:0]
            keys.append(key)
            at = np.searchsorted(merged, key)
            hit = merged[np.minimum(at, len(merged) - 1)] == key if len(merged) else np.zeros(len(key), bool)
            hit &= at < len(merged)
            least[at[hit]] = np.minimum(least[at[hit]], mine[hit])
            merged, least = np.insert(merged, at[~hit], key[~hit]), np.insert(least, at[~hit], mine[~hit])
    out = []
    for i, (_, window, _) in enumerate(parts):
        order, cls, mine = found[i]
        first = np.zeros(len(window), np.int64)
        first[order] = (least[np.searchsorted(merged, keys[i])] if len(parts) > 1 else mine)[cls]
        out.append(first)
    return out


def _cut(docs: DataFrame, id_col: str, text_col: str, folder: str, shard_bytes: int, ranges: int, buckets: int) -> DataFrame:
    """Write the shards' files and return their records: a row for each shard and bucket of anchors, one of which names the file."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.repartitionByRange(ranges, F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        texts: list[bytes] = []
        ids: list[int | None] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if texts and (size >= shard_bytes or len(texts) >= SHARD_DOCS) and i != ids[-1]:
                    yield from flush(number, texts, ids)
                    number, size, texts, ids = number + 1, 0, [], []
                texts.append(t)
                ids.append(i)
                size += len(t)
        if texts:
            yield from flush(number, texts, ids)

    def flush(number: int, texts: list[bytes], ids: list[int | None]) -> Iterator[pa.RecordBatch]:
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        known = np.array([i is not None for i in ids])
        numbers = np.array([0 if i is None else i for i in ids], np.int64)
        path = f"{folder}/{number}-{uuid.uuid4().hex}"
        put(path, pack_arrays(data=data, ends=ends, ids=numbers, known=known))
        _, _, every, anchor, at = Shard(data, ends, numbers, known).anchors()
        runs = np.minimum(np.diff(np.r_[at, len(every)]), 0xFFFF).astype(np.uint16)
        cut = np.searchsorted(anchor, np.array([(k << 48) // buckets for k in range(buckets + 1)], np.uint64))
        home = hash_of(number) % buckets
        made = [(k, number, path if k == home else None, _coded(anchor[a:b]), pack_arrays(runs=runs[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a or k == home]
        yield from _table(made, _RECORDS).to_batches()

    return rows.mapInArrow(run, _ddl(_RECORDS))


def hash_of(number: int) -> int:
    """Spreads shards, whose numbers have regular low bits, over buckets."""
    return number * 0x9E3779B97F4A7C15 % (1 << 64) >> 24


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """As _cut deals anchors: the k for which k 2**48 // buckets is the last not above the anchor."""
    return np.searchsorted(np.array([(k << 48) // buckets for k in range(buckets)], np.uint64), anchor, side="right") - 1


def _settle(hot: int):
    def run(t: pa.Table) -> pa.Table:
        """One bucket: which of each shard's anchors other shards have too, and in how many parts a hot one is dealt."""
        shard = np.asarray(t.column("shard"))
        anchors = [_decoded(x) for x in t.column("anchor").to_pylist()]
        rows = [(int(s), p, b"", b"") for s, p in zip(shard, t.column("path").to_pylist()) if p is not None]
        of = np.repeat(np.arange(len(shard)), [len(x) for x in anchors])
        anchor = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
        if len(anchor):
            runs = np.concatenate([unpack_arrays(x)["runs"] for x in t.column("runs").to_pylist()]).astype(np.int64)
            order = np.argsort(anchor, kind="stable")
            same = anchor[order[1:]] == anchor[order[:-1]]
            order = order[np.r_[False, same] | np.r_[same, False]]
            group = np.cumsum(np.r_[True, anchor[order][1:] != anchor[order][:-1]]) - 1 if len(order) else order
            parts = -(-np.bincount(group, weights=runs[order]).astype(np.int64) // hot) if len(order) else order
            by = np.argsort(of[order], kind="stable")  # anchors stay ascending within a shard
            for a, b in _runs_of(of[order[by]]):
                x = by[a:b]
                rows.append((int(shard[of[order[x[0]]]]), None, _coded(anchor[order[x]]), pack_arrays(parts=parts[group[x]])))
        return _table(rows, _REPLIES)

    return run


def _runs_of(x: np.ndarray) -> list[tuple[int, int]]:
    """Ends of the runs of equal numbers."""
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return list(zip(cut.tolist(), np.r_[cut[1:], len(x)].tolist()))


def _marked(n: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of stretches that do not overlap."""
    step = np.zeros(n + 1, np.int8)
    step[first] = 1
    step[first + count] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def _stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of set places."""
    edge = np.diff(np.r_[0, on.view(np.int8), 0])
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches (first, size), one after another."""
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(first) else np.zeros(0, np.int64)


def _window_hash(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    words, h = _words(data), np.zeros(len(place), np.uint64)
    for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        h = _mix(h * _C2 + words[place + k])
    return h


def _match(buckets: int, array_bytes: int):
    def run(t: pa.Table) -> pa.Table:
        """One shard: what its own suffix array finds, and the bytes that other shards may have, by bucket and part of anchors."""
        replies = t.to_pylist()
        number, path = replies[0]["shard"], next(r["path"] for r in replies if r["path"] is not None)
        asked = np.concatenate([np.zeros(0, np.uint64), *(_decoded(r["anchor"]) for r in replies if r["anchor"])])
        parts = np.concatenate([np.zeros(0, np.int64), *(unpack_arrays(r["parts"])["parts"] for r in replies if r["anchor"])])
        by = np.argsort(asked)
        asked, parts = asked[by], parts[by]
        shard = Shard.load(path)
        first, count, anchor, each, cut = shard.anchors()
        index = np.repeat(np.arange(len(each)), np.diff(np.r_[cut, len(anchor)]))
        doc = shard.doc(first)
        shared = doc[cut] < doc[np.r_[cut[1:], len(doc)] - 1] if len(each) else np.zeros(0, bool)  # anchors of several documents of this shard
        at = np.minimum(np.searchsorted(asked, each), max(0, len(asked) - 1))
        wanted = asked[at] == each if len(asked) else np.zeros(len(each), bool)
        dealt = np.where(wanted, parts[at], 0) if len(asked) else np.zeros(len(each), np.int64)
        many = np.diff(np.r_[cut, len(anchor)]) > 1  # the windows of a lone run are not in the shard a second time
        use, ask = (shared | wanted & many)[index], wanted[index]
        on, outer = _marked(len(shard.data), first[use], count[use]), _marked(len(shard.data), first[ask], count[ask])
        least = _least_in_shard(shard.data, on, array_bytes)
        place = np.flatnonzero(on)
        own, lead = shard.doc(place), shard.doc(least)
        gone = np.zeros(len(shard.data), bool)
        gone[place[own > lead]] = True
        twin = (own == lead) & (place != least) & outer[place]
        outer[place[place != least]] = False
        starts, sizes = _stretches(gone)
        rows = [(-1, number, number, path, pack_arrays(start=starts, size=sizes, twin=place[twin], of=least[twin]))]
        rep = np.r_[0, np.cumsum(outer)]  # places before each that stand for their windows
        some = np.flatnonzero(ask & (rep[first + count] > rep[first]) if len(first) else ask)
        hot = dealt[index[some]] > 1
        plain = some[~hot]
        # of a run only what lies between its first and last standing window
        mine = np.flatnonzero(outer)
        lo, hi = mine[rep[first[plain]]] if len(plain) else plain, mine[rep[first[plain] + count[plain]] - 1] if len(plain) else plain
        pieces = [(_bucket(anchor[plain], buckets), np.zeros(len(plain), np.int64), lo, hi - lo + 1)]
        if hot.any():
            runs = some[hot]
            spots = _spread(first[runs], count[runs])
            of = np.repeat(np.arange(len(runs)), count[runs])
            keep = rep[spots + 1] > rep[spots]
            spots, of = spots[keep], runs[of[keep]]
            part = (_window_hash(shard.data, spots) % dealt[index[of]].astype(np.uint64)).astype(np.int64)
            pieces.append((_bucket(anchor[of], buckets), part, spots, np.ones(len(spots), np.int64)))
        bucket, part, place, size = (np.concatenate(x) for x in zip(*pieces))
        by = np.lexsort((place, part, bucket))
        bucket, part, place, size = bucket[by], part[by], place[by], size[by]
        for a, b in _runs_of(bucket * (1 << 24) + part):
            x, n = place[a:b], size[a:b]
            rows.append((int(bucket[a]), int(part[a]), number, None, pack_arrays(place=x.astype(np.int32 if len(shard.data) < 1 << 31 else np.int64), count=n.astype(np.uint8), data=shard.data[_spread(x, n + LENGTH - 1)])))
        return _table(rows, _SPANS)

    return run


def _least_in_shard(data: np.ndarray, on: np.ndarray, array_bytes: int) -> np.ndarray:
    """For every marked window, in order, the first place in the shard of an equal one."""
    starts, sizes = _stretches(on)
    arrays = []
    group = np.cumsum(sizes + LENGTH - 1) // array_bytes  # stretches are whole; a longer one is an array of its own
    for a, b in _runs_of(group):
        first, size = starts[a:b], sizes[a:b]
        text = data[_spread(first, size + LENGTH - 1)]
        begin = np.r_[0, np.cumsum(size + LENGTH - 1)[:-1]]
        arrays.append((text, _spread(begin, size), _spread(first, size)))
    return np.concatenate([np.zeros(0, np.int64), *first_places(arrays)]) if arrays else np.zeros(0, np.int64)


def _alike(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run of bytes the first one that is equal to it, byte for byte (or itself, where hashes of unlike ones collide)."""
    words, last = _words(data), start + size - 8
    steps = range(0, int(size.max(initial=0)), 8)
    h = size.astype(np.uint64)
    for k in steps:
        h = _mix(h * _C2 + words[np.minimum(start + k, last)])
    order = np.argsort(h, kind="stable")
    head = order[np.maximum.accumulate(np.where(np.r_[True, h[order][1:] != h[order][:-1]], np.arange(len(h)), 0))] if len(h) else order
    first = np.empty(len(h), np.int64)
    first[order] = head
    same = size == size[first]
    for k in steps:
        same &= words[np.minimum(start + k, last)] == words[np.minimum(start[first] + k, last[first])]
    return np.where(same, first, np.arange(len(h)))


def later_windows(data: np.ndarray, start: np.ndarray, count: np.ndarray, owner: np.ndarray, array_bytes: int) -> np.ndarray:
    """For every window of runs, one after another, whether an earlier owner has it too. Runs come in the order of their owners.

    Runs that are equal byte for byte enter the arrays once, for the first owner, and share what is found.
    """
    size = count + LENGTH - 1
    first = _alike(data, start, size)
    lead = first == np.arange(len(first))
    arrays = []
    for a, b in _runs_of(np.cumsum(size[lead]) // array_bytes):
        at = np.flatnonzero(lead)[a:b]
        begin = np.r_[0, np.cumsum(size[at])[:-1]]
        arrays.append((data[_spread(start[at], size[at])], _spread(begin, count[at]), np.repeat(owner[at], count[at])))
    found = np.concatenate([np.zeros(0, np.int64), *first_places(arrays)])
    ends = np.cumsum(count[lead])
    at = np.cumsum(lead) - 1  # which of the leading runs
    return found[_spread((ends - count[lead])[at[first]], count)] < np.repeat(owner, count)


def _compare(array_bytes: int):
    def run(t: pa.Table) -> pa.Table:
        """One part of a bucket: the windows that earlier shards have, by suffix arrays over the runs' bytes. What a shard found itself passes through."""
        if t.column("bucket")[0].as_py() < 0:
            return t.select(["shard", "path", "content"])
        rows = sorted(t.select(["shard", "content"]).to_pylist(), key=lambda r: r["shard"])
        held = [unpack_arrays(r["content"]) for r in rows]
        data = np.concatenate([z["data"] for z in held])
        count = np.concatenate([z["count"] for z in held]).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(z["count"]) for z in held])
        start = np.r_[0, np.cumsum(count + LENGTH - 1)[:-1]]
        later = later_windows(data, start, count, owner, array_bytes)
        place = _spread(np.concatenate([z["place"] for z in held]).astype(np.int64), count)[later]
        who = np.repeat(owner, count)[later]
        out = [(rows[int(who[a])]["shard"], None, pack_arrays(place=place[a:b])) for a, b in _runs_of(who)]
        return _table(out, _MASKS)

    return run


def _finish(with_text: bool):
    def run(t: pa.Table) -> pa.Table:
        """One shard: what each of its documents keeps."""
        replies = t.to_pylist()
        own = next(r for r in replies if r["path"] is not None)
        shard, mine = Shard.load(own["path"]), unpack_arrays(own["content"])
        n = len(shard.data)
        starts = np.zeros(n + 1, bool)
        for r in replies:
            if r["path"] is None:
                starts[unpack_arrays(r["content"])["place"]] = True
        starts[mine["twin"][starts[mine["of"]]]] = True
        starts[_spread(mine["start"], mine["size"])] = True
        cover = np.zeros(n + LENGTH + 1, np.int32)
        at = np.flatnonzero(starts)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + LENGTH, -1)
        removed = np.cumsum(cover[:n]) > 0
        total = np.r_[0, np.cumsum(removed)]
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        begins[shard.starts[shard.starts < n]] = removed[shard.starts[shard.starts < n]]
        spans = np.r_[0, np.cumsum(begins)]
        digests, texts = [], []
        for a, b in zip(shard.starts.tolist(), shard.ends.tolist()):
            piece = shard.data[a:b]
            kept = (piece if total[b] == total[a] else piece[~removed[a:b]]).tobytes()
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept if with_text else None)
        ids = pa.array(shard.ids, mask=~shard.known)
        size = shard.ends - shard.starts
        return pa.table([ids, pa.array(size), pa.array(total[shard.ends] - total[shard.starts]), pa.array(spans[shard.ends] - spans[shard.starts]), pa.array(digests, pa.string()), pa.array(texts, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shard_bytes: int | None = None, array_bytes: int | None = None, bucket_records: int | None = None, hot: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of every row's text; kept is null without with_text."""
    shard_bytes, array_bytes, bucket_records, hot = shard_bytes or SHARD_BYTES, array_bytes or ARRAY_BYTES, bucket_records or BUCKET, hot or HOT
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    ranges = max(1, -(-total // shard_bytes))
    buckets = max(1, -(-total // 14 // bucket_records))  # about one run for fourteen bytes
    folder = fresh_path(docs.sparkSession, "shards")
    records = _cut(docs, id_col, text_col, folder, shard_bytes, ranges, buckets)
    replies = stash(records.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_settle(hot), _ddl(_REPLIES)), "replies")
    spans = replies.repartition(ranges, "shard").groupBy("shard").applyInArrow(_match(buckets, array_bytes), _ddl(_SPANS))
    masks = stash(spans.repartition(max(buckets, ranges), "bucket", "part").groupBy("bucket", "part").applyInArrow(_compare(array_bytes), _ddl(_MASKS)), "masks")
    return masks.repartition(ranges, "shard").groupBy("shard").applyInArrow(_finish(with_text), _RESULT)
