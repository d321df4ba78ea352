"""Fingerprints by definition, trie joins against all pairs, components against union-find."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import simhash


def by_definition(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    grams = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.one_of(st.none(), st.text(alphabet="aB é\t .", max_size=60)))
@settings(max_examples=150, deadline=None)
def test_fingerprint(t):
    assert int(simhash.fingerprint(t and t.encode())[0]) == by_definition(t)


def classes(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("lanes", "budget", "wide"), [(1, 2, 1 << 18), (1, 3, 16), (2, 9, 64)])
def test_trie_join(lanes, budget, wide, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE", wide)
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**64, (40, lanes), dtype=np.uint64)
    near = [b ^ np.array([np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, budget + 2), replace=False))) for _ in range(lanes)], np.uint64) for b in base for _ in range(5)]
    root_of = rng.integers(0, 3, 240)
    rows = sorted({(int(r), *map(int, f)) for r, f in zip(root_of, [*base, *near])})
    root, fp = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], np.uint64)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if root[i] == root[j] and sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(fp[i], fp[j])) <= budget]
    assert simhash.trie_components(fp, root, budget).tolist() == classes(pairs, len(rows))


def groups(rows, hot=None):
    fps = [by_definition(t) for _, t in rows]
    cls = classes([(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 2], len(rows))
    least = {}
    for (i, _), c in zip(rows, cls):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, fp, least.get(c)) for (i, _), fp, c in zip(rows, fps, cls)), key=str)


@pytest.mark.parametrize("hot", [None, 3])
def test_near_duplicates(docs, hot):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.choice([2, 5, 400]))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{t} extra") for i, t in enumerate(texts)] + [(200 + i, t.upper()) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (-5, texts[1]), (7, texts[7]), (300, None), (301, ""), (302, " \t"), (None, "nobody else says this at all")]
    got = simhash.near_duplicates(docs(rows), hot=hot).collect()
    assert sorted(((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got), key=str) == groups(rows)


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + 7 * i, 1000 + 7 * (i + 1)) for i in range(50)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = {}
    for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, got.values())) == [2, 51, 301]


def test_one_of_each(docs):
    rng = random.Random(9)
    base = [f"word{rng.randrange(5000)}" for _ in range(400)]
    edit = base.copy()
    edit[50] = "changed"
    other = [f"word{rng.randrange(5000)}" for _ in range(400)]
    rows = [(5, " ".join(base)), (3, " ".join(edit)), (4, " ".join(other)), (None, " ".join(base)), (8, None), (9, ""), (3, " ".join(edit)), (3, "same id, other text"), (20, " ".join(base[:200] + other[200:]))]
    kept = simhash.one_of_each(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect()) == sorted([(3, " ".join(edit)[:9]), (4, " ".join(other)[:9]), (8, ""), (9, ""), (3, "same id, "), (20, " ".join(base)[:9])])
    assert simhash.one_of_each(docs([])).count() == simhash.near_duplicates(docs([])).count() == 0


def test_dense_groups_in_blocks(docs):
    rng = random.Random(2)
    base = [f"word{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(60):
        t = base.copy()
        t[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(t)))
    assert [r["doc_id"] for r in simhash.one_of_each(docs(rows)).collect()] == [0]
    got = simhash.near_copies(docs(rows), block=7).select("component").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_deals_grow_with_the_input():
    assert [simhash.deals_for(n, 0.8) for n in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 30)] == [(12, 24), (12, 24), (12, 24), (13, 28), (18, 66)]
    assert simhash.bit_budget(0.8) == 44


def pairs_at(count, edits, seed, words=200):
    """Pairs of random texts, the second with `edits` single words changed far apart (five shingles each)."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        t = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        u = t.copy()
        for k in range(edits):
            u[8 + k * (words - 16) // edits] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
    return rows


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_only_texts_at_the_similarity_are_copies(docs):
    rng = random.Random(5)
    line = " ".join(f"same{i}" for i in range(12))
    unlike = [(1000 + i, " ".join([f"v{rng.randrange(10**6)}" for _ in range(300)] + [line] * 20)) for i in range(2)]
    rows = pairs_at(40, 5, 1) + unlike
    assert all(0.75 < jaccard(rows[2 * i][1], rows[2 * i + 1][1]) < 0.8 for i in range(40))
    assert simhash.one_of_each(docs(rows)).count() == len(rows)


def test_no_copy_at_the_similarity_is_lost(docs):
    rng = random.Random(6)
    line = " ".join(f"again{i}" for i in range(12))
    base = " ".join(f"u{rng.randrange(10**6)}" for _ in range(300))
    rows = pairs_at(60, 4, 2) + [(1000, base), (1001, " ".join([base] + [line] * 5))]
    assert all(0.8 <= jaccard(rows[2 * i][1], rows[2 * i + 1][1]) < 0.83 for i in range(60)) and jaccard(base, rows[-1][1]) > 0.9
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(rows)).collect()) == [r[0] for r in rows[::2]]


def test_short_texts_are_no_copies_of_an_empty_one(docs):
    texts = (" ".join(f"{w}{i}" for w in "abcdef") for i in range(20_000))
    rare = next(t for t in texts if sum(int(x).bit_count() for x in simhash.fingerprint(t.encode(), 5, simhash.LANES)) <= 44)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs([(1, ""), (2, None), (3, rare)])).collect()) == [1, 2, 3]


def kin(count, edits, seed, words=300):
    """Texts that each have `edits` words of their own in place of one text's, at drawn places far apart."""
    rng = random.Random(seed)
    base, rows = [f"k{rng.randrange(10**6)}" for _ in range(words)], []
    for i in range(count):
        t = base.copy()
        for at in rng.sample(range(8, words - 8, 6), edits if isinstance(edits, int) else rng.choice(edits)):
            t[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    return rows


def test_rows_stay_in_proportion_to_a_group(docs, monkeypatch):
    """Texts just below the similarity: 19,900 pairs, none of which is a link."""
    made, stash = {}, simhash.stash

    def counted(df, what):
        out = stash(df, what)
        made[what] = max(made.get(what, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "stash", counted)
    rows = kin(200, 6, 1)
    assert all(0.65 < jaccard(rows[0][1], t) < 0.8 for _, t in rows[1:])
    assert simhash.one_of_each(docs(rows)).count() == 200
    assert max(made.values()) < 5_000, made  # the deals' links are 24 for each text at most


def test_ties_join_what_may_be_alike(spark):
    rng = np.random.default_rng(7)
    rows = np.array([(t, n % 7, n, 20 + n % 40, rng.integers(0, 8)) for t in range(30) for n in rng.choice(300, 9, replace=False)])
    many = np.array([(99, n, n, 100, 3) for n in range(500)])
    (few,), (crowd,) = (list(simhash._ties(0.8)(x)) for x in (rows, many))
    able = [(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and 0.8 * max(a[3], b[3]) <= min(a[3], b[3]) and min(a[4], b[4]) + min(a[3] - a[4], b[3] - b[4]) >= 0.8 / 1.8 * (a[3] + b[3]) - 1e-9]
    assert classes(zip(*few.to_pydict().values()), 300) == classes(able, 300) and len(able) > 100
    assert crowd.num_rows == 499 and set(classes(zip(*crowd.to_pydict().values()), 500)) == {0}


def hashed(docs, rows):
    return docs(rows).selectExpr("xxhash64(text) AS text_hash", "CAST(text AS BINARY) AS text")


@pytest.mark.parametrize("shard", [1 << 22, 700])
def test_suspects_are_counted_exactly(docs, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rows = pairs_at(20, 4, 3) + [(100 + i, t) for i, t in kin(5, 9, 4)] + [(200, "one two"), (201, "alone"), (202, ""), (203, "one two")]
    sets = {t: simhash.shingles(t.encode(), 5) for _, t in rows}
    own = {t: sum(all(x not in v for u, v in sets.items() if u != t) for x in s) for t, s in sets.items()}
    want = {simhash._node(s) for t, s in sets.items() if len(s) and own[t] <= len(s) - 0.8 * len(s) + 1e-9}
    got = {r[0] for r in simhash.suspects(hashed(docs, rows), 5, 0.8).collect()}
    assert want <= got <= want | {simhash._node(sets["one two"])} and len(want) >= 40  # copies in several tasks look shared


@pytest.mark.parametrize(("crowd", "part"), [(64, 1 << 16), (3, 500)])
def test_missed_against_all_pairs(spark, docs, crowd, part, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PART", part)
    rows = kin(40, (1, 2, 3, 4, 5, 8), 5) + [(100 + i, t) for i, t in pairs_at(10, 4, 6)] + [(200 + i, t) for i, t in pairs_at(10, 5, 7)]
    texts = [t for _, t in rows]
    nodes = [simhash._node(simhash.shingles(t.encode(), 5)) for t in texts]
    given = [(nodes[0], nodes[1]), (nodes[2], nodes[1])]  # links found before
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    named = hashed(docs, rows).selectExpr("text_hash AS rep", "CAST(text AS STRING) AS t")
    named = named.join(spark.createDataFrame(list(zip(nodes, texts)), "node long, t string"), "t").select("node", "rep")
    got = simhash.missed(hashed(docs, rows), named, simhash.components(spark.createDataFrame(given, "a long, b long")), 5, 0.8).collect()
    at = {n: i for i, n in enumerate(nodes)}
    found = [(at[r["a"]], at[r["b"]]) for r in got]
    assert set(map(frozenset, found)) <= set(map(frozenset, alike)) and 20 < len(alike)
    known = [(0, 1), (2, 1)]
    assert classes(found + known, len(rows)) == classes(alike + known, len(rows))


def test_few_edges_take_one_task(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    made, stash = [], simhash.stash
    monkeypatch.setattr(simhash, "stash", lambda df, what: made.append(what) or stash(df, what))
    for few in (simhash.FEW, 20, 0):
        monkeypatch.setattr(simhash, "FEW", few)
        got = {}
        for r in simhash.components(edges).collect():
            got.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(len, got.values())) == [2, 61]
        if few == 1 << 20:
            assert made == ["edges", "up"]
