"""Packing: nothing lost, nothing overlaps, sequences as short as their contents allow."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing

CAPS = (8, 16, 32)


@given(st.lists(st.integers(1, 32), max_size=60))
@settings(max_examples=100, deadline=None)
def test_bins_are_sound(sizes):
    sizes = sorted(sizes, reverse=True)
    where, offset, final = packing.pack(sizes, CAPS, lambda c: 2 + c)
    held = {}
    for s, w, o, f in zip(sizes, where.tolist(), offset.tolist(), final.tolist()):
        assert o == held.get(w, (0, f))[0]
        held[w] = (o + s, f)
    for content, length in held.values():
        assert content <= length and length == min(c for c in CAPS if c >= content)
    assert sum(c for c, _ in held.values()) == sum(sizes)


def least_cost(sizes, caps, cost):
    """The optimum, by trying every way to put the pieces together."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(cost(min(c for c in caps if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= max(caps) and bins[k] not in bins[:k]:
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_against_the_optimum():
    """Small cases against a search of all packings: never below it (nothing is lost), equal mostly, and close in every case."""
    rng, ratios = random.Random(6), []
    cost = lambda c: 3 + c + c * c / 64
    for _ in range(80):
        sizes = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(1, 8))), reverse=True)
        where, _, final = packing.pack(sizes, CAPS, cost)
        total = sum(cost(f) for _, f in set(zip(where.tolist(), final.tolist())))
        ratios.append(total / least_cost(sizes, CAPS, cost))
    assert min(ratios) >= 1 - 1e-12 and max(ratios) <= 1.3 and sum(r < 1 + 1e-12 for r in ratios) >= 0.6 * len(ratios)


def test_best_fit_takes_the_tightest_bin():
    where, _, content = packing.best_fit([10, 7, 6, 3], lambda size, left: 16)
    assert where == [0, 1, 0, 1] and content == [16, 10]


def test_joint_choice_beats_each_single_rule():
    sizes = sorted([30, 20, 12, 9, 8, 8, 5, 3, 3, 1] * 7, reverse=True)
    cost = lambda c: 3 + c
    total = lambda final, where: sum(cost(f) for f, _ in {(f, w) for f, w in zip(final.tolist(), where.tolist())})
    where, _, final = packing.pack(sizes, CAPS, cost)
    for c in CAPS:
        w, _, content = packing.best_fit(sizes, lambda size, left, c=c: min(x for x in CAPS if x >= max(size, c)))
        assert total(final, where) <= sum(cost(min(x for x in CAPS if x >= n)) for n in content)


def test_whole_documents(docs):
    rows = [(i, "w " * (i * 7 % 90)) for i in range(80)] + [(1, None), (None, "a b"), (3, "x"), (3, "x"), (9, "y " * 1000)]
    got = packing.packed(docs(rows), capacities=(16, 64), shard_rows=30).collect()
    want = sorted((i if i is not None else -1, len((t or "").split()) + 1) for i, t in rows)
    per = {}
    for r in got:
        assert r["piece_start"] == r["piece"] * 64 and 1 <= r["n_tokens"] <= 64
    pieces = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got)
    assert sum(n for _, n in pieces) == sum(n for _, n in want)
    for r in got:
        per.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"], r["bin_length"]))
    for items in per.values():
        at = 0
        for offset, n, length in sorted(items):
            assert offset == at
            at += n
        assert at <= length and length == (16 if at <= 16 else 64)
    assert packing.packed(docs([])).count() == 0


@pytest.mark.parametrize("left", [1, 100, 100_000])
def test_opening_is_by_unit_cost(left):
    where, offset, final = packing.pack([min(left, 600)], (512, 1024, 8192))
    assert final.tolist() == [512 if left < 512 else 1024]
