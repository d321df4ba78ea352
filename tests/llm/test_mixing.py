"""The mix against an independent solution of its targets, and its defined cases."""

import random
from collections import defaultdict

import pytest

from tidemark.llm import mixing


def water(sizes, weights, budget, cap):
    """Targets by repeated resharing."""
    capped = set()
    while True:
        rest = [s for s in sizes if s not in capped]
        if not rest:
            return {s: cap * sizes[s] for s in sizes}
        level = (budget - sum(cap * sizes[s] for s in capped)) / sum(weights[s] for s in rest)
        over = [s for s in rest if level * weights[s] > cap * sizes[s] + 1e-9]
        if not over:
            return {s: cap * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped.update(over)


def planned(df, share=1.5):
    rows = mixing.numbered(mixing.measured(df))
    return mixing.copies(rows, mixing.plan(rows.drop("row"), share=share)[0]).select("row.doc_id", "source", "size", "source_size", "target", "copies", "imp").collect()


def test_targets_and_words(docs):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 5, 30, 200, 900 if i % 50 == 0 else 40]), rng.choice(["a"] * 8 + ["b", "c", "É", None])) for i in range(600)]
    got = planned(docs(rows))
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, planned(docs(rows[::-1]))), key=str)


def test_odds_follow_importance(docs):
    rows = [(i, "w " * (2 if i % 2 else 60), "a") for i in range(2000)] + [(10_000 + i, "x " * 400, "b") for i in range(100)]
    got = [r for r in planned(docs(rows), share=0.5) if r["source"] == "a"]
    mean = lambda n: sum(r["copies"] for r in got if r["size"] == n) / sum(r["size"] == n for r in got)
    assert mean(2) < 0.8 * mean(60)


def test_defined_cases(docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (None, "one two", "a"), (4, "x " * 5000, "b"), (4, "x " * 5000, "b"), (5, "é ü", "z")]
    got = planned(docs(rows))
    assert len(got) == len(rows)
    assert {r["copies"] * r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert {r["target"] for r in got if r["source"] is None} == {0.0}
    assert {r["copies"] for r in got if r["doc_id"] == 4} <= {0, 1, 2}


def test_mix_keeps_columns(docs):
    df = docs([(i, "some words here " * (i % 9), "abc"[i % 3]) for i in range(60)])
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    n = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 2 and set(n) <= set(range(60))
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("repeats", [1, 40, 200])
def test_repeated_rows_are_taken_as_they_fit(docs, repeats):
    """Equal rows are taken one by one, in the plan and in the mix: every source lands within one document of its target."""
    rows = [(5, "w " * 200, "a")] * repeats + [(100 + i, "v " * (3 + i % 60), "b") for i in range(300)] + [(7, "z " * 30, "c")] * 150
    df = docs(rows)
    got = planned(df)
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    mixed = defaultdict(int)
    for r in mixing.mix(df).collect():
        mixed[r["source"]] += len(r["text"].split())
    assert mixed == {s: n for s, n in taken.items() if n}


def test_targets_are_met_independently(spark, docs):
    """Words taken against targets worked out here, over sources of unlike sizes; the farthest is within its longest document."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 400), "abcdefg"[min(6, int(rng.expovariate(0.8)))]) for i in range(800)]
    got = planned(docs(rows))
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    want = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        assert abs(sum(r["size"] * r["copies"] for r in got if r["source"] == s) - want[s]) <= 200


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["s", "t", None]), rng.randrange(1, 50), rng.randrange(1 << 40), 0, i) for i in range(700)] + [("u", 2, 5, 1, 1000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "source string, size long, key long, rh long, tie long").repartition(3)
    got = {r["tie"]: r["cum"] for r in mixing.ordered(df, 9).collect()}
    total = defaultdict(int)
    for s, z, _, _, i in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        total[s] += z
        assert got[i] == total[s]
    assert len(got) == len(rows)
