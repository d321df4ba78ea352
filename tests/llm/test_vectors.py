"""Both vector searches against brute force, with ties, copies and values that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, blockmax

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id int, v string")


def usable(rows, zero):
    keep = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            keep[i, tuple(np.float32(x).item() for x in v)] = None
    return list(keep)


def best(items, k, score):
    out = []
    for q, qv in items:
        if q % 20 == 0:
            found = sorted((-score(qv, v), i) for i, v in items if i != q and len(v) == len(qv))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def sample(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(1100, rows[20][1]), rows[5], rows[5]]
    return rows + [(2000, None), (2020, []), (2040, [0.0] * d), (2060, [NAN] * d), (2080, [None] + [1.0] * (d - 1)), (2100, [INF] + [0.0] * (d - 1)), (None, rows[1][1]), (3000, [1.0, 0.0]), (3001, [0.5, 0.5])]


def test_exact_top_k(spark):
    rows = sample(300, 16, 1)
    got = blockmax.top_k(table(spark, rows), F.col("id") % 20 == 0, k=20, block=16, segment=90, batch=7).collect()
    want = best(usable(rows, True), 20, lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b)))
    assert sorted(map(tuple, got)) == want


def test_pruned_segments_and_turns(spark, monkeypatch):
    """Clustered ids, so that most segments are ruled out for most queries; every limit so small that all paths are taken."""
    for name, n in (("TURN", 2), ("CHUNK", 2), ("SLICE", 2)):
        monkeypatch.setattr(blockmax, name, n)
    rng = np.random.default_rng(8)
    rows = [(i, [float(y) for y in (i % 7 + 1) * rng.normal(size=6)]) for i in range(400)]
    got = blockmax.top_k(table(spark, rows), F.col("id") % 20 == 0, k=5, block=8, segment=40, batch=3).collect()
    want = best(usable(rows, True), 5, lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b)))
    assert sorted(map(tuple, got)) == want


def test_wide_blocks_prune():
    """Blocks are ruled out for values beyond doubles' exact sums too, and the result is that of whole numbers."""
    x = np.sort(np.random.default_rng(3).integers(1, 1 << 40, (600, 1)), axis=0).astype(float) * np.ones((1, 3)) * 2.0**20
    s = blockmax.Segment(np.arange(600), x, 20)
    q = np.full((1, 3), 3.0 * 2**20)
    place, score, scored = s.top(np.array([599]), q, 5)
    whole = sorted(((-min((1 << 63) - 1, sum(int(v) * int(w) for v, w in zip(q[0], r))), j) for j, r in enumerate(x) if j != 599))[:5]
    assert [(-int(a), int(b)) for a, b in zip(score[0], place[0])] == whole
    small = blockmax.Segment(np.arange(600), x / 2.0**20 * 8, 20)
    place, score, scored = small.top(np.array([-1]), np.full((1, 3), 2.0**12 + 1), 5)
    assert blockmax.wide(np.full((1, 3), 2.0**12 + 1), small.x) and scored <= 3 and place[0].tolist() == [599, 598, 597, 596, 595]


def test_block_bounds_prune():
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(0, 50, (4000, 1)), axis=0) * np.ones((1, 4))
    s = blockmax.Segment(np.arange(4000), x, 64)
    place, score, scored = s.top(np.array([-1]), np.ones((1, 4)), 10)
    assert scored < 10 and score[0].tolist() == [196.0] * 10 and place[0].tolist() == list(range(int(np.flatnonzero(x[:, 0] == 49)[0]), int(np.flatnonzero(x[:, 0] == 49)[0]) + 10))


def test_wide_values(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 0.0]), (20, [1e10, 1e10]), (3, [1e5, 7.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in blockmax.top_k(table(spark, rows), F.col("id") % 20 == 0).collect()}
    assert got[0, 1] == (1 << 63) - 1 and got[0, 2] == -(1 << 63)
    f = lambda x: math.floor(64 * np.float32(x).item())
    assert got[20, 3] == f(1e10) * f(1e5) + f(1e10) * f(7.0)


def test_empty_and_few(spark):
    for op in (lambda t: blockmax.top_k(t, F.col("id") % 20 == 0), lambda t: ann.nearest(t, F.col("id") % 20 == 0)):
        assert op(table(spark, [])).count() == 0
        assert op(table(spark, [(0, [1.0, 0.0])])).count() == 0
        few = op(table(spark, [(0, [1.0, 0.0]), (7, [0.0, 1.0]), (4, [0.0, 1.0]), (9, [-1.0, 0.0])])).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"], r["score"] > -0.5) for r in few] == [(1, 4, True), (2, 7, True), (3, 9, False)]


@pytest.mark.parametrize("part", [1 << 14, 9])
def test_nearest(spark, part):
    rows = sample(700, 16, 3)
    got = sorted(map(tuple, ann.nearest(table(spark, rows), F.col("id") % 20 == 0, k=20, part=part).collect()))
    items = usable(rows, False)
    want = best(items, 20, lambda a, b: float((np.array(a) * np.array(b)).sum()))
    assert [r[:2] for r in got] == [r[:2] for r in want]  # as many for every query
    hit = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(hit) >= 0.9 * len(want)
    vectors = dict(items)
    for q, _, i, s in got:
        assert s == pytest.approx(float((np.array(vectors[q]) * np.array(vectors[i])).sum()), abs=1e-12)
    ranks = {}
    for q, r, i, s in got:
        ranks.setdefault(q, []).append((-s, i))
    assert all(v == sorted(v) for v in ranks.values())


def test_copies_beyond_k(spark):
    """A vector with many copies: the smallest ids, whoever asks."""
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 200)] + [(500, [0.0, 1.0, 0.0])]
    got = ann.nearest(table(spark, rows), F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    for q in (0, 40, 180):
        assert [r["vec_id"] for r in got if r["query_id"] == q] == [i for i in range(21) if i != q][:20]


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(10, 24))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 1), axis=1), np.linalg.norm(x, axis=1))


def test_probes_come_in_order_of_summed_coordinates():
    x = np.random.default_rng(0).normal(size=(5, 6))
    for polytopes in (1, 2, 3):
        ends = ann._ends(x, 4, polytopes)
        m = ends[0].shape[1]
        total = ends[0]
        for e in ends[1:]:
            total = (total[:, :, None] + e[:, None, :]).reshape(len(x), -1)
        for most in (1, 7, 60, m**polytopes):
            got = ann.probes(x, 4, polytopes, most)
            want = -np.sort(-total, axis=1)[:, :most]
            assert got.shape == want.shape and np.allclose(np.take_along_axis(total, got, axis=1), want)
        assert (ann.probes(x, 4, polytopes, 1)[:, 0] == ann.codes(x, 4, polytopes)).all()


def test_more_rows_are_looked_at_less():
    """Random unit vectors of 64 dimensions, the worst case: recall of the fitted probes, and the share of rows that they look at."""
    shares = []
    for n in (2_000, 8_000, 24_000):
        x = np.random.default_rng(n).normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        exact = x[:120] @ x.T
        exact[np.arange(120), np.arange(120)] = -2
        near = np.argsort(-exact, axis=1)[:, :20]
        polytopes, _ = ann.shape(n, 64)
        most = ann.fit_probes(x[:60], [x[i] for i in near[:60]], polytopes, ann.TABLES, ann.GOAL)
        seen = np.zeros((60, n), bool)
        for t in range(ann.TABLES):
            code, asked = ann.codes(x, t, polytopes), ann.probes(x[60:120], t, polytopes, most)
            for i in range(60):
                seen[i] |= np.isin(code, asked[i])
        assert np.take_along_axis(seen, near[60:], axis=1).mean() >= 0.9
        shares.append(seen.mean())
    assert shares[0] < 0.5 and shares[2] < shares[1] < shares[0]


def test_recall_of_the_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64)) * np.exp(rng.normal(0, 0.2, size=(1500, 1)))
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    got = ann.nearest(table(spark, rows), F.col("id") % 20 == 0, k=20).collect()
    x = np.array([v for _, v in rows])
    s = x[::20] @ x.T
    s[np.arange(75), np.arange(0, 1500, 20)] = -np.inf
    want = {(20 * q, int(i)) for q, r in enumerate(np.argsort(-s, axis=1)[:, :20]) for i in r}
    assert len(got) == 1500 and len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)
