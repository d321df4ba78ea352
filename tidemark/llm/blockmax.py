"""Exact top-k inner products by block-at-a-time pruning.

Vectors of integers are documents whose dimensions are terms. Documents in id order are cut into blocks; each block has, for
every term, the largest and smallest weight in it, and a forward index, its rows. A query's bound on a block is the sum over
terms of its weight times the extreme that makes it largest. Each query visits blocks from the highest bound down, scores a
block's rows through the forward index, and stops at the first block whose bound is below its k-th score so far; a bound equal
to it is still visited, since a smaller id may tie. All queries of a batch advance together, one block each a round.

Documents are dealt to segments and queries to batches of bounded size, in packed arrays of the narrowest numbers. A batch first
meets one segment, which gives each query a score that its k-th best is not below. Segments' own term extremes then tell, before
anything larger moves, which queries can have a document of that score in which segment, and only those queries travel there;
segments stay where they are but for one copy for every TURN batches that come. Queries stream past a segment, so a task holds one
segment and one batch. Each meeting gives a query's best k of the segment, which are merged per query.

Defined cases: null ids and vectors that are null, empty or hold a null or a non-finite number take no part; rows equal in id
and vector are one; an id's other vectors are no candidates of its own query; only vectors of the query's dimensions are
candidates; with fewer than k candidates all are returned; ties go to the smaller id; sums too large for a long are held at
its ends; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stash
from tidemark.llm.files import pack_arrays, unpack_arrays
from tidemark.llm.vectors import matrix, rows

BLOCK, SEGMENT, BATCH = 256, 32_768, 1_024
#: Batches that one copy of a segment serves; segments whose extremes travel together, and batches that meet them in one task.
TURN, CHUNK, SLICE = 64, 1_024, 256
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Segment:
    """Blocks of documents in id order, with their term extremes. Weights are whole numbers, as doubles."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.block = ids[order], x[order], block
        starts = np.arange(0, len(ids), block)
        self.most, self.least = np.maximum.reduceat(self.x, starts), np.minimum.reduceat(self.x, starts)

    def top(self, own: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places (-1: none) and scores of each query's k best, best first, and the number of blocks scored. With least, a score for
        each query, blocks that can't reach it are passed over and lower scores may be left out."""
        least = np.full(len(q), -np.inf) if least is None else least
        if wide(q, self.x):
            return self._top_wide(own, q, k, least)
        bound = np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T
        order = np.argsort(-bound, axis=1, kind="stable")
        n, blocks = bound.shape
        place = np.full((n, k), -1, np.int64)
        score = np.full((n, k), -np.inf)
        live, scored = np.arange(n), 0
        for turn in range(blocks):
            at = order[live, turn]
            go = bound[live, at] >= np.maximum(score[live, k - 1], least[live])
            live, at = live[go], at[go]
            if not len(live):
                break
            scored += len(live)
            by = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.r_[True, at[by][1:] != at[by][:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(by)]):
                who, blk = live[by[a:b]], at[by[a]]
                lo, hi = blk * self.block, min((blk + 1) * self.block, len(self.ids))
                s = q[who] @ self.x[lo:hi].T
                s[self.ids[None, lo:hi] == own[who][:, None]] = -np.inf
                some = np.flatnonzero(s.max(axis=1) >= score[who, k - 1])
                if not len(some):
                    continue
                who, s = who[some], s[some]
                if s.shape[1] > k:  # the k best of the block, ties to the smaller place, which is the smaller id
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    above = s > kth
                    tie = s == kth
                    keep = above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1, keepdims=True)))
                    places = np.nonzero(keep)[1].reshape(len(who), k)
                    s = np.take_along_axis(s, places, axis=1)
                else:
                    places = np.broadcast_to(np.arange(s.shape[1]), s.shape)
                p = np.concatenate([place[who], np.where(np.isneginf(s), -1, places + lo)], axis=1)
                s = np.concatenate([score[who], s], axis=1)
                best = np.lexsort((np.where(p < 0, len(self.ids), p), -s), axis=1)[:, :k]
                place[who], score[who] = np.take_along_axis(p, best, axis=1), np.take_along_axis(s, best, axis=1)
        return place, score, scored

    def _top_wide(self, own: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The same for weights whose sums doubles can't hold exactly: bounds in doubles, raised by more than they can be off, and
        whole numbers of any size for the documents of the blocks that these leave."""
        bound = np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T
        bound += 2.0**-40 * (np.abs(q) @ np.maximum(np.abs(self.most), np.abs(self.least)).T) + 1
        place, score, scored = np.full((len(q), k), -1, np.int64), np.zeros((len(q), k), object), 0
        rows: dict[int, list[list[int]]] = {}
        for i, r in enumerate(q):
            w, best = [int(v) for v in r], []
            for b in np.argsort(-bound[i], kind="stable").tolist():
                if min(bound[i, b], float(_HIGH)) < (max(least[i], -best[k - 1][0]) if len(best) >= k else least[i]):
                    break
                scored += 1
                lo = b * self.block
                if b not in rows:
                    rows[b] = [[int(v) for v in y] for y in self.x[lo : lo + self.block]]
                best += [(-max(_LOW, min(_HIGH, sum(x * y for x, y in zip(w, row)))), lo + j) for j, row in enumerate(rows[b]) if self.ids[lo + j] != own[i]]
                best = sorted(best)[:k]
            for c, (s, j) in enumerate(best):
                place[i, c], score[i, c] = j, -s
        return place, score, scored


def wide(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether some sum of products may be too large for doubles to hold exactly."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) >= 2.0**52


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers as the narrowest type that holds them; those too large for any stay doubles."""
    most = float(np.abs(x).max(initial=0))
    return x.astype(next((t for t, top in ((np.int8, 127), (np.int16, 32_767), (np.int32, 2**31 - 1)) if most <= top), np.float64))


def _floor(x: Column) -> Column:
    """The floor as a double, of doubles of any size (Spark's own floor gives a long); those past 2**52 are whole already."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _packed(vectors: DataFrame, size: int, what: str) -> DataFrame:
    """(dims, pack, packs, content): vectors in packs of about `size`, dealt by a hash of the id; packs: how many were dealt to."""
    per = stash(vectors.groupBy(F.size("v").alias("dims")).agg(F.ceil(F.count("*") / size).cast("int").alias("packs")), "packs")
    dealt = vectors.withColumn("dims", F.size("v")).join(per, "dims").withColumn("pack", F.pmod(F.xxhash64("id"), F.col("packs")).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        content = pack_arrays(ids=np.asarray(t.column("id")), x=narrow(matrix(t.column("v"))))
        return pa.table([t.column("dims")[:1], t.column("pack")[:1], t.column("packs")[:1], pa.array([content], pa.binary())], names=["dims", "pack", "packs", "content"])

    n = partitions(vectors.sparkSession)
    return stash(dealt.select("dims", "pack", "packs", "id", "v").repartition(n, "dims", "pack").groupBy("dims", "pack").applyInArrow(run, "dims int, pack int, packs int, content binary"), what)


def _meet(held: DataFrame, sent: DataFrame, keys: list[str], make: Callable[[bytes], object], meet: Callable[[object, tuple, int, bytes], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """Rows of sent (keys, tag, content) stream past the one row of held (keys, content) of their keys: meet(make(its content), keys, tag, content)."""
    both = held.select(*keys, F.lit(0).alias("kind"), F.lit(0).alias("tag"), "content").unionByName(sent.select(*keys, F.lit(1).alias("kind"), F.col("tag").cast("int").alias("tag"), "content"))
    both = both.repartition(partitions(held.sparkSession), *keys).sortWithinPartitions(*keys, "kind", "tag")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for b in batches:
            for i in range(b.num_rows):
                key, content = tuple(b.column(c)[i].as_py() for c in range(n)), b.column(n + 2)[i].as_py()
                if b.column(n)[i].as_py() == 0:
                    at, mine = key, make(content)
                elif key == at:
                    yield from meet(mine, key, b.column(n + 1)[i].as_py(), content)

    return both.mapInArrow(run, ddl)


def _read(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's ids, vectors and least scores."""
    z = unpack_arrays(content)
    return z["ids"], z["x"].astype(np.float64), z["least"] if "least" in z else np.full(len(z["ids"]), -np.inf)


def _with_least(batches: DataFrame, segments: DataFrame, k: int, block: int) -> DataFrame:
    """(dims, batch, content): batches with a score for each query that k documents of one segment reach, or none where there are fewer."""
    home = segments.select(F.col("dims").alias("d"), F.col("pack").alias("p"), F.col("content").alias("docs"), F.col("packs").alias("dealt"))
    met = batches.join(home, (F.col("d") == F.col("dims")) & (F.col("p") == F.pmod("pack", "dealt")), "left").select("dims", F.col("pack").alias("batch"), "content", "docs")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                ids, q, least = _read(b.column(2)[i].as_py())
                if b.column(3)[i].is_valid:
                    d = unpack_arrays(b.column(3)[i].as_py())
                    place, score, _ = Segment(d["ids"], d["x"].astype(np.float64), block).top(ids, q, k)
                    least = np.where(place[:, k - 1] >= 0, score[:, k - 1].astype(np.float64), -np.inf)
                    least = np.where(np.abs(least) < 2.0**52, least, least - np.abs(least) * 2.0**-40)
                yield pa.record_batch([b.column(0)[i : i + 1], b.column(1)[i : i + 1], pa.array([pack_arrays(ids=ids, x=narrow(q), least=np.nan_to_num(least, nan=-np.inf, neginf=-np.inf))], pa.binary())], names=["dims", "batch", "content"])

    return stash(met.repartition(partitions(batches.sparkSession), "dims", "batch").mapInArrow(run, "dims int, batch int, content binary"), "batches")


def _routed(segments: DataFrame, batches: DataFrame) -> DataFrame:
    """(dims, pack, tag, content): for every segment, of each batch (tag) the queries that may have a document of their least score there."""
    n = partitions(segments.sparkSession)

    def extremes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                x = unpack_arrays(b.column(2)[i].as_py())["x"].astype(np.float64)
                yield pa.record_batch([b.column(0)[i : i + 1], b.column(1)[i : i + 1], pa.array([x.max(axis=0).tolist()]), pa.array([x.min(axis=0).tolist()])], names=["dims", "pack", "most", "least"])

    def bundle(t: pa.Table) -> pa.Table:
        content = pack_arrays(packs=np.asarray(t.column("pack")), most=matrix(t.column("most")), least=matrix(t.column("least")))
        return pa.table([t.column("dims")[:1], t.column("chunk")[:1], pa.array([content], pa.binary())], names=["dims", "chunk", "content"])

    ends = segments.select("dims", "pack", "content").mapInArrow(extremes, "dims int, pack int, most array<double>, least array<double>").withColumn("chunk", F.floor(F.col("pack") / CHUNK).cast("int"))
    chunks = stash(ends.repartition(n, "dims", "chunk").groupBy("dims", "chunk").applyInArrow(bundle, "dims int, chunk int, content binary"), "extremes")
    number = stash(batches.groupBy("dims").agg(F.max("batch").alias("last")).join(chunks.groupBy("dims").agg(F.max("chunk").alias("most")), "dims"), "numbers")  # a row for each length of vectors
    held = chunks.join(number, "dims").withColumn("slice", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / SLICE).cast("int"))))
    sent = batches.join(number, "dims").withColumn("chunk", F.explode(F.sequence(F.lit(0), "most"))).withColumn("slice", F.floor(F.col("batch") / SLICE).cast("int")).withColumn("tag", F.col("batch"))

    def meet(ends: dict, key: tuple, batch: int, content: bytes) -> Iterator[pa.RecordBatch]:
        ids, q, least = _read(content)
        bound = np.maximum(q, 0) @ ends["most"].T + np.minimum(q, 0) @ ends["least"].T
        if wide(q, np.concatenate([ends["most"], ends["least"]])):
            bound += 2.0**-40 * (np.abs(q) @ np.maximum(np.abs(ends["most"]), np.abs(ends["least"])).T) + 1
            least = np.minimum(least, float(_HIGH) * (1 - 2.0**-40))  # scores end there
        for j, pack in enumerate(ends["packs"].tolist()):
            go = bound[:, j] >= least
            if go.any():
                yield pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([pack], pa.int32()), pa.array([batch], pa.int32()), pa.array([pack_arrays(ids=ids[go], x=narrow(q[go]), least=least[go])], pa.binary())], names=["dims", "pack", "tag", "content"])

    return stash(_meet(held, sent, ["dims", "chunk", "slice"], unpack_arrays, meet, "dims int, pack int, tag int, content binary"), "routed")


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, segment: int = SEGMENT, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * component) for every row that is_query (over id) holds of."""
    vectors = rows(table, id_col, vector_col, allow_zero=True).withColumn("v", F.transform("v", lambda x: _floor(x.cast("double") * scale)))
    vectors = stash(vectors.distinct(), "weights")
    segments = _packed(vectors, segment, "segments")
    batches = _with_least(_packed(vectors.where(is_query), batch, "batches"), segments, k, block)
    sent = _routed(segments, batches).withColumn("turn", F.floor(F.col("tag") / TURN).cast("int"))
    held = segments.select("dims", "pack", "content").join(sent.select("dims", "pack", "turn").distinct(), ["dims", "pack"])

    def make(content: bytes) -> Segment:
        d = unpack_arrays(content)
        return Segment(d["ids"], d["x"].astype(np.float64), block)

    def meet(seg: Segment, key: tuple, tag: int, content: bytes) -> Iterator[pa.RecordBatch]:
        ids, q, least = _read(content)
        place, score, _ = seg.top(ids, q, k, least)
        has = place >= 0
        scores = score[has]
        scores = pa.array([int(s) for s in scores], pa.int64()) if scores.dtype == object else pa.array(scores.astype(np.int64))
        yield pa.record_batch([pa.array(np.repeat(ids, has.sum(axis=1))), pa.array(seg.ids[place[has]]), scores], names=["query_id", "vec_id", "score"])

    found = _meet(held, sent, ["dims", "pack", "turn"], make, meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
