"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Each of TABLES tables hashes a unit vector by several cross-polytopes: each turns it by a fast pseudo-rotation, three rounds of
random signs and a Hadamard transform, and takes the signed axis that the result is nearest to. Together the axes are the
vector's bucket, so buckets grow in number as a power of the dimensions with the rows, and how many a polytope more has is
chosen by the number of rows. A query probes buckets in the order of the summed coordinates of their axes, and every vector
in them is reranked by its exact inner product with the query.

The number of probes is fitted and not fixed: on at most TRIED queries whose exact nearest are found by brute force, it is the
least that finds GOAL of them. The more rows there are, the nearer the nearest are and the fewer probes suffice, so the share
of rows that a query looks at falls (README has figures). Every row is filed.

Vectors and probes meet by the leading axes of their buckets, so many as leave groups of about PART vectors, which are sorted by
the other axes. Groups that hold more vectors or probing queries than that are dealt to a grid of parts, of which every pair
is a task's, so none holds an unbounded group. Candidates below a score that a bounded sample of rows shows to be well below the
k-th best are not sent on. Equal vectors are one, with their smallest ids, before they are filed. Queries for which fewer than
k vectors were found although more exist look into all buckets of one table, which holds every vector.

Defined cases: null ids and vectors that are null, empty, zero or hold a null or a non-finite number take no part; rows equal
in id and vector are one; an id's other vectors are no candidates of its own query; vectors of other dimensions than the
query's are no candidates; with fewer than k candidates all are returned; ties go to the smaller id; empty tables give
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stash
from tidemark.llm.vectors import distinct_vectors, matrix, rows

TABLES, SEED = 20, 20
#: Queries that the number of probes is fitted on, the share of their nearest to find, and the most probes of a table.
TRIED, GOAL, MOST_PROBES = 96, 0.96, 4_096
#: Vectors, and queries, of a part of a group.
PART = 16_384
#: Rows of the sample that tells how low a score is not worth sending, and pairs scored at once.
SAMPLE, PAIRS = 2_048, 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """The pseudo-rotation of that number of rows, padded with zeros to a power of two."""
    d = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([SEED, number, d]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def padded(dims: int) -> int:
    return 1 << max(0, (dims - 1).bit_length())


def shape(n: int, dims: int) -> tuple[int, int]:
    """For n vectors the number of polytopes of a table, and how many leading ones name a group."""
    axes = math.log(2 * padded(dims))
    polytopes = max(1, min(int(62 * math.log(2) / axes), math.floor(math.log(max(n, 1)) / axes + 0.45)))
    return polytopes, min(polytopes, max(1, math.ceil(math.log(max(n, 1) / PART) / axes)))


def _ends(x: np.ndarray, table: int, polytopes: int) -> list[np.ndarray]:
    """For every polytope of the table the coordinates of unit rows along all signed axes; 2 i and 2 i + 1 are the ends of axis i."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [np.stack([y := rotate(x, table * 64 + p), -y], axis=2).reshape(len(x), -1) for p in range(polytopes)]


def codes(x: np.ndarray, table: int, polytopes: int) -> np.ndarray:
    """The bucket of each row: its axes as digits, the first the highest."""
    out = np.zeros(len(x), np.int64)
    for both in _ends(x, table, polytopes):
        out = out * both.shape[1] + both.argmax(axis=1)
    return out


def probes(x: np.ndarray, table: int, polytopes: int, most: int) -> np.ndarray:
    """For each row the buckets of greatest summed coordinates, greatest first: `most` of them, or all."""
    code, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for both in _ends(x, table, polytopes):
        axes = np.argsort(-both, axis=1, kind="stable")
        value = np.take_along_axis(both, axes, axis=1)
        # Of sums of two descending lists the i-th and j-th element's is among the `most` greatest only if (i + 1) (j + 1) <= most.
        i = np.repeat(np.arange(code.shape[1]), np.minimum(axes.shape[1], most // np.arange(1, code.shape[1] + 1)))
        j = np.arange(len(i)) - np.searchsorted(i, i)
        total = score[:, i] + value[:, j]
        kept = min(most, len(i))
        best = np.argpartition(-total, kept - 1, axis=1)[:, :kept]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(total, best, axis=1), axis=1, kind="stable"), axis=1)
        score = np.take_along_axis(total, best, axis=1)
        code = np.take_along_axis(code, i[best], axis=1) * both.shape[1] + np.take_along_axis(axes, j[best], axis=1)
    return code


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, each added up in the same order wherever it stands, so that equal vectors tie."""
    return (q * x).sum(axis=1)


def fit_probes(q: np.ndarray, near: list[np.ndarray], polytopes: int, tables: int, goal: float) -> int:
    """The least number of probes by which `goal` of the queries' nearest vectors are found."""
    if not len(q) or not sum(map(len, near)):
        return 1
    first = [np.full(len(x), 1 << 40) for x in near]
    most = min(MOST_PROBES, (2 * padded(q.shape[1])) ** polytopes)
    for t in range(tables):
        asked = np.concatenate([probes(q[at : at + 16], t, polytopes, most) for at in range(0, len(q), 16)])
        for i, x in enumerate(near):
            if len(x):
                hit = codes(x, t, polytopes)[:, None] == asked[i][None, :]
                first[i] = np.minimum(first[i], np.where(hit.any(axis=1), hit.argmax(axis=1), 1 << 40))
    rank = np.sort(np.concatenate(first))
    return int(min(most, rank[min(len(rank) - 1, math.ceil(goal * len(rank)) - 1)] + 1))


def _by_dims(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Batches by the length of their vectors, with those as a matrix."""
    for b in batches:
        size = np.diff(np.asarray(b.column(at).offsets))
        for d in np.unique(size).tolist():
            for start in range(0, len(where := np.flatnonzero(size == d)), 2_048):
                part = b.take(pa.array(where[start : start + 2_048]))
                yield d, part, matrix(part.column(at))


def _true_nearest(index: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict[int, list[np.ndarray]]:
    """By dimensions and query (id, v), the vectors of its k exact nearest: a bounded number of queries against all vectors."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b, x in _by_dims(batches, 1):
            own, q = sent.value.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
            if not len(own):
                continue
            ids = b.column(0).to_pylist()
            s = q @ x.T
            best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            row, col = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel()
            other = np.array([any(i != own[r] for i in ids[c]) for r, c in zip(row.tolist(), col.tolist())])
            row, col = row[other], col[other]
            yield pa.record_batch([pa.array(np.full(len(row), d, np.int32)), pa.array(row), pa.array(s[row, col]), pa.array(x[col].tolist(), pa.list_(pa.float64()))], names=["dims", "q", "s", "v"])

    found = index.mapInArrow(run, "dims int, q long, s double, v array<double>")
    rank = F.row_number().over(W.partitionBy("dims", "q").orderBy(F.col("s").desc(), "v"))
    out = {d: [np.zeros((0, d))] * len(own) for d, (own, _) in asked.items()}
    held: dict[tuple[int, int], list] = {}
    for r in found.withColumn("r", rank).where(F.col("r") <= k).collect():  # at most k of each asked query
        held.setdefault((r["dims"], r["q"]), []).append(r["v"])
    for (d, i), v in held.items():
        out[d][i] = np.array(v, float)
    return out


def _plan(index: DataFrame, queries: DataFrame, k: int, tables: int, goal: float) -> dict[int, tuple[int, int, int, np.ndarray, int]]:
    """By dimensions: polytopes, leading polytopes, probes, a sample of the vectors, and how many of those there are."""
    n = {r["d"]: r["n"] for r in index.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    dims = F.size("v")

    def drawn(df: DataFrame, salt: int, most: int, share: dict[int, float]) -> dict[int, list]:
        cut = F.lit(0.0)
        for d, s in share.items():
            cut = F.when(dims == d, s).otherwise(cut)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "v"), 11) / float(1 << 53)
        got = df.where(u < cut).withColumn("r", F.row_number().over(W.partitionBy(dims).orderBy(u, df.columns[0]))).where(F.col("r") <= most)
        out: dict[int, list] = {}
        for r in got.collect():  # bounded for each length
            out.setdefault(len(r["v"]), []).append(r)
        return out

    asked_n = {r["d"]: r["n"] for r in queries.groupBy(dims.alias("d")).agg(F.count("*").alias("n")).collect()}
    tried = drawn(queries.select("id", "v"), 1, TRIED, {d: min(1.0, 2 * TRIED / m) for d, m in asked_n.items()})
    asked = {d: (np.array([r["id"] for r in rs], np.int64), np.array([r["v"] for r in rs], float)) for d, rs in tried.items()}
    sample = drawn(index.select("ids", "v"), 2, SAMPLE, {d: min(1 / 8, 0.9 * SAMPLE / m) for d, m in n.items()})
    near = _true_nearest(index, asked, k) if asked else {}
    out = {}
    for d, m in n.items():
        polytopes, lead = shape(m, d)
        q = asked.get(d, (None, np.zeros((0, d))))[1]
        out[d] = (polytopes, lead, fit_probes(q, near.get(d, []), polytopes, tables, goal), np.array([r["v"] for r in sample.get(d, [])], float).reshape(-1, d), m)
    return out


def _file(index: DataFrame, plan: dict, tables: int) -> DataFrame:
    """(ids, v, dims, tab, grp, sub): every vector in each table's bucket."""
    kind = dict(index.dtypes)["v"]
    how = {d: p[:2] for d, p in plan.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b, x in _by_dims(batches, 1):
            polytopes, lead = how[d]
            rest = (2 * padded(d)) ** (polytopes - lead)
            for t in range(tables):
                code = codes(x, t, polytopes)
                yield pa.record_batch([*b.columns, pa.array(np.full(len(x), d, np.int32)), pa.array(np.full(len(x), t, np.int32)), pa.array(code // rest), pa.array(code % rest)], names=["ids", "v", "dims", "tab", "grp", "sub"])

    return index.select("ids", "v").mapInArrow(run, f"ids array<long>, v {kind}, dims int, tab int, grp long, sub long")


def _visits(queries: DataFrame, plan: dict, tables: int, k: int) -> DataFrame:
    """(query_id, v, least, dims, tab, grp, subs): the buckets that each query looks into, by group, and the score worth sending."""
    kind = dict(queries.dtypes)["v"]
    sent = queries.sparkSession.sparkContext.broadcast(plan)  # a bounded sample for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b, whole in _by_dims(batches, 1):
            polytopes, lead, most, sample, n = sent.value[d]
            rest = (2 * padded(d)) ** (polytopes - lead)
            for at in range(0, len(whole), 64):
                x, part = whole[at : at + 64], b.slice(at, 64)
                rank = max(1, round(12 * k * len(sample) / n)) + 1  # about the 12 k-th of all; one more for the query's own vector
                least = np.sort(x @ sample.T, axis=1)[:, -rank] - 1e-9 if len(sample) >= rank else np.full(len(x), -np.inf)
                for t in range(tables):
                    code = np.sort(probes(x, t, polytopes, most), axis=1)
                    grp = code // rest
                    row = np.repeat(np.arange(len(x)), code.shape[1])
                    flat = grp.ravel()
                    new = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])
                    subs = pa.ListArray.from_arrays(pa.array(np.r_[new, len(flat)].astype(np.int32)), pa.array(code.ravel() % rest))
                    of = pa.array(row[new])
                    yield pa.record_batch([part.column(0).take(of), part.column(1).take(of), pa.array(least[row[new]]), pa.array(np.full(len(new), d, np.int32)), pa.array(np.full(len(new), t, np.int32)), pa.array(flat[new]), subs], names=["query_id", "v", "least", "dims", "tab", "grp", "subs"])

    return queries.select("id", "v").mapInArrow(run, f"query_id long, v {kind}, least double, dims int, tab int, grp long, subs array<long>")


_GROUP = ["dims", "tab", "grp"]


def _search(filed: DataFrame, visits: DataFrame, k: int, part: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of every group's probed buckets, for each query that visits it. subs null: all of the group's buckets."""
    x_parts = filed.groupBy(*_GROUP).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    q_parts = visits.groupBy(*_GROUP).agg(F.ceil(F.count("*") / part).cast("int").alias("turns"))
    grid = stash(x_parts.join(q_parts, _GROUP), "groups")
    nothing = lambda t: F.lit(None).cast(t)
    held = filed.join(grid, _GROUP).select(*_GROUP, F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "ids", "v", "sub", nothing("long").alias("query_id"), nothing("double").alias("least"), nothing("array<long>").alias("subs"))
    asked = visits.join(grid, _GROUP).select(*_GROUP, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn"), nothing("array<long>").alias("ids"), "v", nothing("long").alias("sub"), "query_id", "least", "subs")

    def run(t: pa.Table) -> pa.Table:
        mine = np.asarray(t.column("query_id").is_valid())
        x, q = t.filter(pa.array(~mine)), t.filter(pa.array(mine))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if x.num_rows and q.num_rows:
            sub = np.asarray(x.column("sub"))
            order = np.argsort(sub, kind="stable")
            sub, xs = sub[order], matrix(x.column("v"))[order]
            lists = x.column("ids").combine_chunks().take(pa.array(order))
            sizes, flat_ids = np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten())
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            qs, own, least = matrix(q.column("v")), np.asarray(q.column("query_id")), np.asarray(q.column("least"))
            asked_for = q.column("subs").combine_chunks()
            whole = np.asarray(asked_for.is_null())
            n = np.where(whole, 0, np.diff(np.asarray(asked_for.offsets)))
            want = np.asarray(asked_for.flatten())
            row = np.r_[np.repeat(np.arange(len(own)), n), np.flatnonzero(whole)]
            lo = np.r_[np.searchsorted(sub, want), np.zeros(int(whole.sum()), np.int64)]
            hi = np.r_[np.searchsorted(sub, want, side="right"), np.full(int(whole.sum()), len(sub))]
            some = hi > lo
            row, lo, size = row[some], lo[some], (hi - lo)[some]
            by = np.argsort(row, kind="stable")
            row, lo, size = row[by], lo[by], size[by]
            total = np.cumsum(size)
            for first in range(0, int(total[-1]) if len(total) else 0, PAIRS):
                pair = np.arange(first, min(first + PAIRS, int(total[-1])))
                at = np.searchsorted(total, pair, side="right")
                i, j = row[at], lo[at] + pair - (total[at] - size[at])
                s = exact_scores(qs[i], xs[j])
                ok = s >= least[i]
                i, j, s = i[ok], j[ok], s[ok]
                m = sizes[j]
                ids = flat_ids[np.repeat(starts[j] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())] if len(m) else np.zeros(0, np.int64)
                i, s = np.repeat(i, m), np.repeat(s, m)
                ok = ids != own[i]
                found.append(_best(i[ok], ids[ok], s[ok], k))
        i, ids, s = _best(*(np.concatenate(c) for c in zip(*found)), k) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(own[i] if len(i) else i), pa.array(ids), pa.array(s)], names=["query_id", "vec_id", "score"])

    both = held.unionByName(asked).repartition(partitions(filed.sparkSession), *_GROUP, "part", "turn")
    return both.groupBy(*_GROUP, "part", "turn").applyInArrow(run, "query_id long, vec_id long, score double")


def _best(i: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (ids, scores) of every query i, each id once."""
    order = np.lexsort((ids, -s, i))
    i, ids, s = i[order], ids[order], s[order]
    same = np.r_[False, (i[1:] == i[:-1]) & (ids[1:] == ids[:-1]) & (s[1:] == s[:-1])] if len(i) else np.zeros(0, bool)
    i, ids, s = i[~same], ids[~same], s[~same]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], ids[keep], s[keep]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a candidate of several tables has one score."""
    best = found.select("query_id", "vec_id", "score").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, goal: float = GOAL, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest found by inner product for every row that is_query (over id) holds of."""
    vectors = stash(rows(table, id_col, vector_col, allow_zero=False), "vectors")
    queries = vectors.where(is_query)
    distinct = stash(distinct_vectors(vectors, k + 1), "distinct-vectors")
    plan = _plan(distinct, queries, k, tables, goal)
    index = stash(_file(distinct, plan, tables), "index")
    found = stash(ranked(_search(index, stash(_visits(queries, plan, tables, k), "visits"), k, part), k), "found")
    # Few vectors: those who found fewer than there are look everywhere.
    there = vectors.groupBy(F.size("v").alias("dims")).agg(F.count_distinct("id").alias("n"))
    have = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("have"))
    want = queries.join(there, F.size("v") == F.col("dims")).join(have, "id", "left")
    short = stash(want.where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("id", "v").distinct(), "short")
    if not short.limit(1).count():
        return found
    groups = index.where("tab = 0").select(*_GROUP).distinct()
    everywhere = short.withColumn("dims", F.size("v")).join(groups, "dims").select(F.col("id").alias("query_id"), "v", F.lit(float("-inf")).alias("least"), *_GROUP, F.lit(None).cast("array<long>").alias("subs"))
    again = ranked(_search(index.where("tab = 0"), everywhere, k, part), k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
