"""Repeated strings against a dictionary of all of them; the parts against their definitions."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import suffixes

L = suffixes.LENGTH
LAST = 1 << 63


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - L + 1):
            g = b[p : p + L]
            first[g] = min(first.get(g, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        b, mine = (t or "").encode(), LAST if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - L + 1):
            if first[b[p : p + L]] < mine:
                gone[p : p + L] = b"\1" * L
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for q in range(len(b)) if gone[q] and (not q or not gone[q - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


BASE = "the cat sat on the mat while the rain in spain fell mainly on the plain and nobody cared at all about it "
ROWS = [(1, BASE), (2, f"xx {BASE} yy"), (2, BASE[:60]), (3, None), (4, ""), (None, BASE), (None, "q" + BASE[3:]), (5, "is " * 60), (6, "z is " * 3 + "is " * 50), (7, BASE[:49]), (8, "a" * 200), (9, "b" + "a" * 120), (10, BASE[20:80] + "#" + BASE[:70]), (10, BASE), (11, "é" * 40 + "x"), (12, "é" * 30), (13, "\0" * 120), (14, "\0" * 60 + "y"), (15, BASE[:50]), (-3, "zz" + BASE[10:70]), (16, "w" * 5000 + BASE)]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 150, "array_bytes": 150, "bucket_records": 2}, {"shard_bytes": 1, "array_bytes": 1, "bucket_records": 50}, {"shard_bytes": 300, "bucket_records": 9, "hot": 1}])
def test_against_brute_force(docs, sizes):
    got = suffixes.deduplicated(docs(ROWS), **sizes).collect()
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=str) == brute(ROWS)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 150, "array_bytes": 150, "bucket_records": 2}])
def test_equal_runs_are_put_together_for_economy_only(docs, monkeypatch, sizes):
    """The arrays alone, every run of every shard in them, give the same result."""
    monkeypatch.setattr(suffixes, "_alike", lambda data, start, size: np.arange(len(start)))
    got = suffixes.deduplicated(docs(ROWS), **sizes).collect()
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=str) == brute(ROWS)


def test_nothing_goes_but_by_the_arrays(docs, monkeypatch):
    """Anchors only leave windows out: with suffix arrays that find nothing, nothing is removed."""
    monkeypatch.setattr(suffixes, "_alike", lambda data, start, size: np.arange(len(start)))
    monkeypatch.setattr(suffixes, "first_places", lambda parts: [p[2] for p in parts])
    assert sum(r["n_removed"] for r in suffixes.deduplicated(docs(ROWS)).collect()) == 0


def test_equal_anchors_decide_nothing(docs, monkeypatch):
    """With one anchor for everything the arrays still give the right result."""
    real = suffixes.Runs.__init__

    def poor(self, *a):
        real(self, *a)
        self.anchor = self.anchor & np.uint64(1) << np.uint64(40)

    monkeypatch.setattr(suffixes.Runs, "__init__", poor)
    got = suffixes.deduplicated(docs(ROWS), shard_bytes=400, array_bytes=300, bucket_records=3).collect()
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=str) == brute(ROWS)


@given(st.lists(st.binary(min_size=L, max_size=260).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_first_places(texts):
    parts, seen, base = [], {}, 0
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        window = np.arange(len(t) - L + 1)
        parts.append((data, window, window + base))
        for p in window.tolist():
            seen.setdefault(t[p : p + L], p + base)
        base += 1000
    for (data, window, _), first in zip(parts, suffixes.first_places(parts)):
        assert first.tolist() == [seen[data.tobytes()[p : p + L]] for p in window.tolist()]


def test_alike_is_byte_for_byte(monkeypatch):
    data = np.frombuffer(b"".join([b"a" * 60, b"b" * 60, b"a" * 60, b"a" * 61, b"b" * 60]), np.uint8)
    start, size = np.array([0, 60, 120, 180, 241]), np.array([60, 60, 60, 61, 60])
    assert suffixes._alike(data, start, size).tolist() == [0, 1, 0, 3, 1]
    monkeypatch.setattr(suffixes, "_mix", lambda x: x & np.uint64(0))  # all hashes equal: what is unlike stays apart
    assert suffixes._alike(data, start, size).tolist() == [0, 1, 0, 3, 4]


def test_empty(docs):
    assert suffixes.deduplicated(docs([])).count() == 0
    assert suffixes.deduplicated(docs([(1, None)]), with_text=False).first()["n_bytes"] == 0


@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(x % 3 for x in b)))
@settings(max_examples=60, deadline=None)
def test_suffix_order_and_prefixes(b):
    data = np.frombuffer(b, np.uint8)
    sa, rank = suffixes.refine(data)
    key = [(b[i : i + L]).ljust(L, b"\0") for i in sa]
    assert sorted(sa.tolist()) == list(range(len(b))) and key == sorted(key)
    assert [x == y for x, y in zip(rank, rank[1:])] == [x == y for x, y in zip(key, key[1:])]
    some = np.unique(np.random.default_rng(len(b)).integers(0, len(b), 1 + len(b) // 4))
    part, _ = suffixes.refine(data, some)
    order = {p: k for k, p in enumerate(sa.tolist())}
    assert part.tolist() == sorted(some.tolist(), key=order.get)
    for k, n in enumerate(suffixes.common_prefixes(data, part)[1:].tolist()):
        i, j = part[k], part[k + 1]
        assert n == next((x for x in range(L) if b[i : i + L].ljust(L, b"\0")[x] != b[j : j + L].ljust(L, b"\0")[x]), L)
    for k, n in enumerate(suffixes.common_prefixes(data, sa)[1:].tolist()):
        assert n == next((j for j in range(L) if key[k][j] != key[k + 1][j]), L)


@given(st.lists(st.binary(max_size=200).map(lambda b: bytes(x % 2 for x in b)), max_size=5))
@settings(max_examples=60, deadline=None)
def test_runs_cover_every_window_once(texts):
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)
    runs = suffixes.Runs(data, np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends, ends)
    windows = [p for f, c in zip(runs.first.tolist(), runs.count.tolist()) for p in range(f, f + c)]
    starts = [0, *ends[:-1].tolist()] if len(ends) else []
    assert sorted(windows) == [p for a, e in zip(starts, ends.tolist()) for p in range(a, e - L + 1)]
    seen = {}
    b = data.tobytes()
    for f, c, a in zip(runs.first.tolist(), runs.count.tolist(), runs.anchor.tolist()):
        for p in range(f, f + c):
            assert seen.setdefault(b[p : p + L], a) == a


def test_pieces_do_not_change_runs(monkeypatch):
    data = np.random.default_rng(0).integers(97, 100, 3000).astype(np.uint8)
    ends = np.array([1200, 3000])
    whole = suffixes.Runs(data, np.array([0, 1200]), ends)
    monkeypatch.setattr(suffixes, "STEP", 97)
    cut = suffixes.Runs(data, np.array([0, 1200]), ends)
    anchor = lambda r: {p: a for f, c, a in zip(r.first.tolist(), r.count.tolist(), r.anchor.tolist()) for p in range(f, f + c)}
    assert anchor(whole) == anchor(cut)
