"""Vector and lexical search over records, exact: every record is scored where it lies, against a bounded batch of queries."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import normalize, tokenize

#: Queries that a task holds at once, and records that one block of more queries than that streams past.
QUERY_BATCH, SHARE = 2_048, 1 << 20
FOUND = "query_id long, id long, score double, ts double"
W_SEM = W_LEX = 0.5


def knn(records: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", causal: bool = False, newest: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k records of highest cosine for every query (query_id, vector[, ts]), ties by id or, with
    newest, to the latest ts and then the greatest id.

    Up to QUERY_BATCH queries go to every task, past which records stream; more meet the records block by block (see `_blocks`).
    A batch of records gives each query's best k, which are merged. With causal, only records whose ts is not after the query's
    count. Scores are rounded to six places before they are ranked. Zero vectors score 0.
    """
    timed = causal or newest
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("v"), (F.col("ts").cast("double") if causal else F.lit(0.0)).alias("ts"))
    source = records.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), (F.col("ts").cast("double") if timed else F.lit(0.0)).alias("ts")).where("id IS NOT NULL AND v IS NOT NULL")

    def score(q: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        s = np.round(_unit(np.array(q["v"], float)) @ _unit(np.array(b["v"], float)).T, 6) + 0.0
        if causal:
            s[np.asarray(q["ts"])[:, None] < np.asarray(b["ts"])[None, :]] = -np.inf
        return s, np.asarray(b["ts"])

    found = _past(source, asked, score, k, newest)
    order = [F.col("score").desc(), F.col("ts").desc(), F.col("id").desc()] if newest else [F.col("score").desc(), "id"]
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _past(records: DataFrame, queries: DataFrame, score: Callable[[dict, dict], tuple[np.ndarray, np.ndarray]], k: int, newest: bool = False) -> DataFrame:
    """(query_id, id, score, ts): for each batch of records (id, ...) that streams past a block of queries (query_id, ...), each query's best k.

    score: scores of queries by records, both as columns of lists by name, -inf for those that do not count, and the records' times.
    """
    asks = queries.columns
    parts, best = _scorer(records.columns, score, k, newest)
    head = queries.limit(QUERY_BATCH + 1).collect()  # at most one more than a block
    if len(head) <= QUERY_BATCH:
        sent = records.sparkSession.sparkContext.broadcast({c: [r[c] for r in head] for c in asks})

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in parts(b) if sent.value["query_id"] else ():
                    yield best(sent.value, x)

        return records.mapInArrow(stream, FOUND)
    return _blocks(records, queries, parts, best)


def _scorer(names: list[str], score: Callable[[dict, dict], tuple[np.ndarray, np.ndarray]], k: int, newest: bool = False) -> tuple[Callable, Callable]:
    """What cuts a batch of records with these columns into parts, and what gives a block of queries its best k of a part."""

    def best(q: dict, b: dict) -> pa.RecordBatch:
        s, ts = score(q, b)
        key, qid = np.asarray(b["id"], np.int64), np.asarray(q["query_id"], np.int64)
        ties = (np.broadcast_to(-key, s.shape), np.broadcast_to(-ts, s.shape)) if newest else (np.broadcast_to(key, s.shape),)
        top = np.lexsort((*ties, -s), axis=1)[:, :k]
        value = np.take_along_axis(s, top, axis=1)
        ok = ~np.isneginf(value)
        return pa.record_batch([pa.array(np.broadcast_to(qid[:, None], top.shape)[ok]), pa.array(key[top][ok]), pa.array(value[ok]), pa.array(ts[top][ok])], names=["query_id", "id", "score", "ts"])

    def parts(b: pa.RecordBatch) -> Iterator[dict]:
        for at in range(0, b.num_rows, 2_048):
            yield {n: b.column(n).slice(at, 2_048).to_pylist() for n in names}

    return parts, best


def _blocks(records: DataFrame, queries: DataFrame, parts: Callable, best: Callable, within: str | None = None) -> DataFrame:
    """All blocks of queries past all parts of the records, for any number of either: a grid of tasks, each of which holds one
    block of queries and lets its part of the records stream past. Rows are dealt by a hash of the id, so no counting window and
    no loop on the driver is needed. A part has SHARE records, which bounds how often a query is copied. With within, a column of
    both, only rows that are equal in it meet: each of its values has a grid of its own, as large as its largest needs."""

    def most(df: DataFrame) -> int:
        return df.count() if within is None else df.groupBy(within).count().agg(F.max("count")).first()[0] or 0

    spread = [max(1, -(-most(df) // n)) for df, n in ((queries, QUERY_BATCH), (records, SHARE))]
    asks, names = [[c for c in df.columns if c != within] for df in (queries, records)]
    group = F.lit(0) if within is None else F.col(within).cast("int")
    both = lambda df, own, kind, mine, other: df.select(group.alias("grid"), F.struct(*own).alias(kind), *(F.pmod(F.xxhash64(own[0]), F.lit(n)).cast("int").alias(c) if c == mine else F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c) for c, n in zip(("block", "part"), spread)))
    q = both(queries, asks, "q", "block", "part").withColumn("r", F.lit(None).cast(records.select(F.struct(*names)).schema[0].dataType))
    r = both(records, names, "r", "part", "block").withColumn("q", F.lit(None).cast(queries.select(F.struct(*asks)).schema[0].dataType))
    cells = q.unionByName(r).withColumn("late", F.col("r").isNotNull()).repartition("grid", "block", "part").sortWithinPartitions("grid", "block", "part", "late").select(F.struct("grid", "block", "part").alias("cell"), "q", "r")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {c: [] for c in asks}
        for b in batches:
            cell = np.stack([np.asarray(x, np.int64) for x in b.column(0).flatten()], axis=1)
            cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)]) if len(cell) else np.zeros(0, np.int64)
            for lo, hi in zip(cut, np.r_[cut[1:], len(cell)]):
                if tuple(cell[lo]) != at:
                    at, held = tuple(cell[lo]), {c: [] for c in asks}
                x = b.slice(lo, hi - lo)
                mine = x.filter(x.column(1).is_valid()).column(1)
                for c in asks:
                    held[c] += mine.field(c).to_pylist() if len(mine) else []
                rest = x.filter(x.column(2).is_valid()).column(2)
                if len(rest) and held["query_id"]:
                    for part in parts(pa.RecordBatch.from_struct_array(rest)):
                        yield best(held, part)

    return cells.mapInArrow(stream, FOUND)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def visible(records: DataFrame, until: float | None = None, tier: str | None = None, entity: str | None = None, window: tuple[float, float] | None = None) -> DataFrame:
    """Records that a search may see: not after `until`, of the tier, tagged with the entity, within the window (both ends in)."""
    out = records
    if until is not None:
        out = out.where(F.col("ts") <= until)
    if tier is not None:
        out = out.where(F.col("tier") == tier)
    if entity is not None:
        out = out.where(F.exists("entities", lambda e: normalize(e) == normalize(F.lit(entity))))
    if window is not None:
        out = out.where(F.col("ts").between(*window))
    return out


def hybrid(records: DataFrame, questions: DataFrame, k: int, dims: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the k best records (id, text) for every question (query_id, text), ties by id.

    The score is half the cosine of hashed token counts and half the overlap of token sets, rounded to six places; records that
    share neither a hash bucket nor a token with the question do not count. If both sides have a namespace, it must be the same.
    Records stream past blocks of questions, as in knn, and only a batch's best per question leave it.
    """
    tenants = "namespace" in records.columns and "namespace" in questions.columns
    extra = ["namespace"] if tenants else []
    asked = questions.select("query_id", tokenize(F.col("text")).alias("tokens"), *extra)
    source = records.select(F.col("id").cast("long").alias("id"), tokenize(F.col("text")).alias("tokens"), *extra).where("id IS NOT NULL")

    def score(q: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        place: dict[str, int] = {}  # words of this part of the records, so the matrices are bounded by its texts
        mine = [sorted({place.setdefault(t, len(place)) for t in ts}) for ts in b["tokens"]]
        theirs = [{t for t in ts} for ts in q["tokens"]]
        both = np.zeros((len(theirs), len(mine)))
        holders: dict[int, list[int]] = {}
        for i, ws in enumerate(mine):
            for w in ws:
                holders.setdefault(w, []).append(i)
        for n, words in enumerate(theirs):
            for t in words:
                if t in place:
                    both[n, holders[place[t]]] += 1
        union = np.array([len(w) for w in theirs])[:, None] + np.array([len(w) for w in mine])[None, :] - both
        lex = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        q_vec, vec = _counts(q["tokens"], dims), _counts(b["tokens"], dims)
        shared = ((q_vec != 0).astype(np.float32) @ (vec != 0).T.astype(np.float32) > 0) | (both > 0)
        s = np.where(shared, np.round(W_SEM * (_unit(q_vec) @ _unit(vec).T) + W_LEX * lex, 6) + 0.0, -np.inf)
        if tenants:
            s[np.array(q["namespace"], object)[:, None] != np.array(b["namespace"], object)[None, :]] = -np.inf
        return s, np.zeros(len(mine))

    return top(_past(source, asked, score, k), k).select("query_id", "rank", "id", "score")


def _counts(lists: list[list[str]], dims: int) -> np.ndarray:
    """Signed hashed token counts, as functions.vectors.hash_embed sums them before scaling."""
    place: dict[str, tuple[int, float]] = {}
    out = np.zeros((len(lists), dims))
    for i, ts in enumerate(lists):
        for t in ts:
            if t not in place:
                h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
                place[t] = (h % dims, 1.0 if h // dims % 2 else -1.0)
            b, sign = place[t]
            out[i, b] += sign
    return out


def embed_text(text: Column, dims: int = 256) -> Column:
    """The dense unit vector of a text's signed hashed token counts, all zeros without tokens; in Arrow batches."""
    from pyspark.sql.pandas.functions import ArrowUDFType

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            x = _unit(_counts(p.to_pylist(), dims))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))

    return F.arrow_udf(run, "array<double>", ArrowUDFType.SCALAR_ITER)(tokenize(text))


def top(found: DataFrame, k: int, score: str = "score", places: int = 6) -> DataFrame:
    """The k best per query_id by the rounded score, ties by id."""
    out = found.withColumn(score, F.round(score, places))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col(score).desc(), "id"))).where(F.col("rank") <= k)


def remove(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id").distinct(), "id", "left_anti")


def reembed(records: DataFrame, embed, model_id: str, text_col: str = "text", dims: int | None = None) -> DataFrame:
    """records with embedding made anew by embed(list of texts) -> matrix, in batches, and the model's id."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            made = [list(map(float, v)) for v in embed(p.to_pylist())]
            if dims is not None and any(len(v) != dims for v in made):
                raise ValueError("the embedder's vectors have another length")
            yield pa.array(made, pa.list_(pa.float64()))

    from pyspark.sql.pandas.functions import ArrowUDFType

    return records.withColumns({"embedding": F.arrow_udf(run, "array<double>", ArrowUDFType.SCALAR_ITER)(F.col(text_col)), "embed_model_id": F.lit(model_id)})


def ivf_index(records: DataFrame, lists: int, seed: int = 0, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Records with the list of their nearest centroid, and the centroids: k-means on a bounded sample, every record assigned."""
    total = records.count()
    drawn = records.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(1, total))).select(vector_col).limit(2 * sample).collect()
    x = _unit(np.array([r[0] for r in drawn], float))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(10):
        near = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return assign_lists(records, c, 1, id_col, vector_col), c


def assign_lists(rows: DataFrame, centroids: np.ndarray, probes: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, list): each row once for each of its nearest centroids."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _unit(np.asarray(b.column(1).flatten()).astype(float).reshape(b.num_rows, -1)) @ sent.value.T
                for p in np.argsort(-s, axis=1, kind="stable")[:, :probes].T:
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(p.astype(np.int32))], names=["id", "v", "list"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, v array<double>, list int")


def ivf_search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, rank, id, score): k best among the records of each query's nearest lists.

    The queries of a list meet its records in blocks (see `_blocks`), scored as matrices; only a batch's best per query leave it.
    """
    asked = assign_lists(queries.select("query_id", "vector"), centroids, probes, "query_id", "vector").select(F.col("id").alias("query_id"), "v", "list")

    def score(q: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        s = np.round(_unit(np.array(q["v"], float)) @ _unit(np.array(b["v"], float)).T, 6) + 0.0
        return s, np.zeros(s.shape[1])

    records = index.select("id", "v", "list")
    return top(_blocks(records, asked, *_scorer(["id", "v"], score, k), within="list"), k).select("query_id", "rank", "id", "score")


def ivf_probes(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, least: int = 1, recall: float = 0.95, sample: int = 96) -> int:
    """The fewest lists, not under least, that hold this share of the k nearest by brute force of a bounded sample of the queries."""
    drawn = queries.select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    asked = {r["query_id"]: _unit(np.array([r["vector"]], float)) @ centroids.T for r in drawn.collect()}
    place = {q: np.argsort(np.argsort(-s[0], kind="stable")) for q, s in asked.items()}
    true = index.select("id", "list").join(F.broadcast(knn(index, drawn, k, "id", "v")), "id").select("query_id", "list").collect()
    depth = np.sort([place[r["query_id"]][r["list"]] for r in true])
    return max(least, int(depth[int(np.ceil(recall * len(depth))) - 1]) + 1) if len(depth) else least


def ivf_search_filtered(index: DataFrame, centroids: np.ndarray, queries: DataFrame, allowed: DataFrame, k: int, probes: int = 1) -> DataFrame:
    """ivf_search among allowed ids only: queries that find fewer than k look into twice as many lists, until all are looked into."""
    inside = index.join(allowed.select("id").distinct(), "id", "left_semi").persist()
    out, left = None, queries
    while True:
        found = ivf_search(inside, centroids, left, k, probes).persist()
        full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        if probes >= len(centroids):
            return found if out is None else out.unionByName(found)
        done = found.join(full, "query_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left, probes = left.join(full, "query_id", "left_anti").persist(), 2 * probes
        if not left.limit(1).count():
            return out


def open_index(snapshots, records: DataFrame, lists: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The list index kept in a snapshot store if it is of as many records as there are; else a new one, which is then kept."""
    spark, total = records.sparkSession, records.count()
    held = snapshots.load()
    if {"lists", "centroids"} <= held.keys() and held["lists"].count() == total:
        return held["lists"], np.array([r["v"] for r in held["centroids"].orderBy("n").collect()])
    if held:
        warnings.warn("the kept index is not of these records and is made anew", stacklevel=2)
    index, c = ivf_index(records, lists, id_col=id_col, vector_col=vector_col)
    rows = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(c)], "n int, v array<double>")
    snapshots.save({"lists": index, "centroids": rows})
    return snapshots.load()["lists"], c
