"""Toxicity and quality: learnt on planted words, held-out accuracy, gradients, and defined cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality, toxicity
from tidemark.llm.linear import Rows, lbfgs

LABELS = "doc_id long, toxic int, quality int"


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(5, 120))
        toxic = rng.random() < 0.25
        poor = rng.random() < 0.4
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "Nastyterm"]))
        text = " ".join(w + "!!" if poor else w for w in words)
        rows.append((i, text))
        labels.append((i, int(toxic), int(not poor)))
    return rows, labels


def test_toxicity_learns_and_holds_out(spark, docs):
    rows, labels = corpus()
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, LABELS))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs(rows), model).select("row.doc_id", "score").collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= 0.5) == labels[i][1] for i in held])
    assert len(held) > 100 and right >= 0.98
    again = toxicity.fit(docs(rows[::-1]), spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels], LABELS))
    assert np.allclose(model.weights, again.weights, atol=1e-5)  # held-out labels change nothing


def test_toxicity_features_are_distinct_ngrams():
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    for t in ["", "ab", "abc", "aaaaaa", "The the", "é" * 10, None]:
        low = (t or "").lower()
        grams = {low[i : i + n] for n in toxicity.ORDERS for i in range(len(low) - n + 1)}
        got = toxicity.features(t, seen)
        assert len(got) == len(set(got.tolist())) == len(grams)
    assert set(toxicity.features("xabcx", seen)) & set(toxicity.features("yABCy", seen))


def test_toxicity_defined_cases(spark, docs):
    rows = docs([(1, None), (2, ""), (None, "x"), (3, "some text"), (3, "some text"), (4, "long " * 30_000)])
    none = toxicity.fit(rows, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in toxicity.scores(rows, none).collect()} == {0.25}
    odd = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (None, 1, 1), (4, 7, 1), (4, None, 1)], LABELS)
    model = toxicity.fit(rows, odd)
    out = toxicity.scores(rows, model)
    assert out.select("row.*").columns == rows.columns and out.count() == 6
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert toxicity.scores(docs([]), model).count() == 0


def test_toxicity_by_definition(spark, docs):
    """Counts, ratios, the features kept, the optimum and the scores, all worked out plainly from the texts."""
    rows, labels = corpus(220, seed=3)
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, LABELS), kept=60, l2=2.0)
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    grams = {i: set(toxicity.features(t, seen).tolist()) for i, t in rows}
    train = [(grams[i], t) for i, t, _ in labels if zlib.crc32(str(i).encode()) % 5]
    total, held = {0: 0, 1: 0}, {0: Counter(), 1: Counter()}
    for g, t in train:
        total[t] += 1
        held[t].update(g)
    ratio = {f: math.log((held[1][f] + 1) / (total[1] + 2)) - math.log((held[0][f] + 1) / (total[0] + 2)) for f in held[0].keys() | held[1].keys()}
    strength = {f: abs(r) / math.sqrt(1 / (held[0][f] + 1) + 1 / (held[1][f] + 1)) for f, r in ratio.items()}
    used = np.flatnonzero(model.weights).tolist()
    assert len(used) <= 60 and min(strength[f] for f in used) >= sorted(strength.values())[-60] - 1e-9
    x = np.array([[ratio[f] * (f in g) for f in used] for g, _ in train])
    y, w = np.array([t for _, t in train]), np.array([model.weights[f] / ratio[f] for f in used])

    def loss(w, b):
        z = x @ w + b
        return np.logaddexp(0, z).sum() - y @ z + w @ w

    best, rng = loss(w, model.intercept), np.random.default_rng(0)
    assert all(loss(w + d[:-1], model.intercept + d[-1]) >= best - 1e-3 * max(1, best) for d in 0.05 * rng.normal(size=(200, len(w) + 1)))
    for r in toxicity.scores(docs(rows), model).select("row.doc_id", "score").collect():
        z = model.intercept + sum(float(model.weights[f]) for f in grams[r["doc_id"]])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_sample_bound(spark, docs):
    from tidemark.llm.common import labelled_sample

    rows = docs([(i, f"t{i}") for i in range(500)] + [(7, "copy")] * 50)
    marks = spark.createDataFrame([(i, i % 2) for i in range(500)], "id long, y int")
    got = labelled_sample(rows, marks, "doc_id", "text", 100).collect()
    assert 60 <= len(got) <= 140 and len({r["id"] for r in got}) == len(got)


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    x = Rows([rng.choice(20, 3, replace=False) for _ in range(50)], [rng.normal(size=3) for _ in range(50)])
    loss = quality.ordinal_loss(x, rng.integers(0, 4, 50), 4, 20, 0.1)
    p = rng.normal(size=23) * 0.3
    slope = [(loss(p + 1e-6 * e)[0] - loss(p - 1e-6 * e)[0]) / 2e-6 for e in np.eye(23)]
    assert np.allclose(slope, loss(p)[1], atol=1e-7)


def test_lbfgs():
    a = np.diag([1.0, 10.0, 100.0])
    best = lbfgs(lambda x: (0.5 * (x - 1) @ a @ (x - 1), a @ (x - 1)), np.zeros(3), tolerance=1e-14)
    assert np.allclose(best, 1, atol=1e-4)


def test_quality_orders_grades(spark, docs):
    rows, labels = corpus()
    grade = spark.createDataFrame([(i, 0 if not q else 1 if t else 2) for i, t, q in labels if i % 5], "doc_id long, grade int")
    model = quality.fit(docs(rows), grade)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.scores(docs(rows), model, grade=1).select("row.doc_id", "expected_grade", "tail_probability", "keep").collect()}
    held = [i for i in range(len(rows)) if i % 5 == 0]
    assert np.mean([got[i]["keep"] == bool(labels[i][2]) for i in held]) >= 0.97
    mean = lambda g: np.mean([got[i]["expected_grade"] for i in held if (0 if not labels[i][2] else 1 if labels[i][1] else 2) == g])
    assert mean(0) < mean(1) < mean(2)


def test_quality_by_definition(spark, docs):
    """Grades' chances and expected grades worked out plainly from words and shapes, and a fit that no small step improves."""
    rows, labels = corpus(200, seed=5)
    graded = [(i, 0 if not q else 1 if t else 2) for i, t, q in labels]
    model = quality.fit(docs(rows), spark.createDataFrame(graded, "doc_id long, grade int"))

    def plain(text):
        words = text.split()
        if not words:
            return {}
        shape = lambda w: re.sub(r"([aA0u])\1+", r"\1", "".join("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else c for c in w))
        count = Counter()
        for seed, found in ((1, [w.lower() for w in words]), (2, [shape(w) for w in words])):
            for w in found:
                count[zlib.crc32(w.encode(), seed) % (1 << quality.BITS)] += 1
        length = math.sqrt(sum(n / len(words) for n in count.values()))
        return {f: math.sqrt(n / len(words)) / length for f, n in count.items()}

    def chances(weights, cuts, text):
        z = sum(float(weights[f]) * v for f, v in plain(text).items())
        return [1 / (1 + math.exp(c - z)) for c in cuts]

    got = {r["doc_id"]: r for r in quality.scores(docs(rows), model, grade=1).select("row.doc_id", "expected_grade", "tail_probability", "keep").collect()}
    for i, t in rows[:60]:
        tails = chances(model.weights, model.thresholds, t)
        assert got[i]["tail_probability"] == pytest.approx(tails[0], abs=1e-5) and got[i]["expected_grade"] == pytest.approx(sum(tails), abs=1e-5)
        assert got[i]["keep"] == (got[i]["tail_probability"] >= 0.5)

    feats, grade = [plain(t) for _, t in rows], [g for _, g in graded]

    def loss(weights, cuts):
        total = 0.15 * float((weights.astype(float) ** 2).sum())
        for x, g in zip(feats, grade):
            z = sum(float(weights[f]) * v for f, v in x.items())
            tail = [1.0] + [1 / (1 + math.exp(c - z)) for c in cuts] + [0.0]
            total -= math.log(max(tail[g] - tail[g + 1], 1e-300))
        return total

    best, rng = loss(model.weights, model.thresholds), np.random.default_rng(1)
    used = np.array(sorted({f for x in feats for f in x}))
    for _ in range(25):
        step = np.zeros_like(model.weights)
        step[used] = 0.05 * rng.normal(size=len(used))
        assert loss(model.weights + step, model.thresholds) >= best - 1e-2 * best
        assert loss(model.weights, np.sort(model.thresholds + 0.1 * rng.normal(size=2))) >= best - 1e-2 * best


@pytest.mark.parametrize("rated", [[], [(3, 1)], [(3, 0), (4, 2)], [(None, 1), (3, None), (3, -1)]])
def test_quality_defined_cases(spark, docs, rated):
    rows = docs([(1, None), (2, " "), (None, "x"), (3, "some text"), (3, "some text"), (4, "long " * 30_000)])
    model = quality.fit(rows, spark.createDataFrame(rated, "doc_id long, grade int"))
    out = quality.scores(rows, model, grade=1)
    assert out.count() == 6 and out.select("row.*").columns == rows.columns
    for r in out.collect():
        assert 0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2
    assert quality.scores(docs([]), model, grade=1).count() == 0
