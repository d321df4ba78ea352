"""SimHash near-duplicates: 64-bit fingerprints linked by a binary-trie self-join, grouped into components.

Fingerprints are taken from whole texts (one pass, nothing shuffled). Only distinct fingerprints are joined, so any number
of copies of a text costs one trie leaf. Two fingerprints that differ in at most `budget` bits agree on at least one of
`budget + 1` bit blocks, so each fingerprint is dealt once per block by that block's value; every block's fingerprints form
one binary trie, whose node pairs are traversed together. A block value that holds more than HOT fingerprints is dealt again
by blocks of its free bits, which is exact for the same reason, and what is still more than that in one place is cut into parts,
every pair of parts a trie of its own, so no task holds more than two parts. Tasks return spanning
links (a fingerprint and the smallest one its task connects it with), never all pairs; components follow from those.

Defined cases: a null or word-less text has fingerprint zero and is linked like any other; texts with fewer words than the
shingle length have one shingle, the whole word sequence; a null id never becomes a component id unless all of the
component's ids are null; repeated rows stay repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import has_word, partitions, stash
from tidemark.llm.files import from_planes, to_planes

_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Fingerprints that one block value may hold before it is dealt again by its free bits.
HOT = 50_000
#: Node pairs held at once while traversing.
WIDE = 1 << 18


def _lane(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a shingle, mixed from its first; lane 0 is the hash itself."""
    if not k:
        return h
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes | None, words: int = 3, lanes: int = 1) -> np.ndarray:
    """SimHash of a UTF-8 text over its word shingles, repeats included, as `lanes` uint64: a bit is set if over half of the hashes have it."""
    found = _SPLIT.findall((text or b"").translate(_LOWER))
    n = len(found)
    if not n:
        return np.zeros(lanes, np.uint64)
    flat = b" ".join(found)
    if n <= words:
        one = np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
        return np.concatenate([_lane(one, k) for k in range(lanes)])
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    total, m = np.zeros((lanes, 64), np.int64), n - words + 1
    for at in range(0, m, 1 << 14):
        lo, hi = starts[at : min(at + (1 << 14), m)].tolist(), ends[at + words - 1 : min(at + (1 << 14), m) + words - 1].tolist()
        h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(lo, hi)), np.uint64, len(lo))
        for k in range(lanes):
            total[k] += np.unpackbits(_lane(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > m).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Distinct hashes of a UTF-8 text's word shingles, sorted; empty for a text without words."""
    found = _SPLIT.findall((text or b"").translate(_LOWER))
    grams = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def set_fingerprint(h: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash over distinct hashes, each counted once, as `lanes` uint64."""
    total = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(h), 1 << 14):
        for k in range(lanes):
            total[k] += np.unpackbits(_lane(h[at : at + (1 << 14)], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ((2 * total > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words)[0] for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [[int(b) for b in part] for part in np.array_split(np.array(bits), n)]


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while len(i):
        parent = _find(parent)
        i, j = parent[i], parent[j]
        apart = i != j
        i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
        np.minimum.at(parent, j, i)
    return _find(parent)


def trie_components(fp: np.ndarray, root: np.ndarray, budget: int) -> np.ndarray:
    """Self-join of binary tries. fp: distinct rows of one or more uint64, sorted by (root, fp); root: which trie each is in.

    A node is a run of sorted fingerprints that share their upper bits. Pairs of nodes of one level go down together: a pair
    splits into its children's pairs, a pair of unlike children costs one differing bit, and a pair over budget is dropped.
    Pairs whose nodes are single fingerprints are settled at once by all of their bits. Neighbours in order are settled
    first, and pairs of nodes that one component holds already are dropped, so a dense group costs its size and not its
    square. Returns, for each fingerprint, the index of the first one it is connected with.
    """
    fp = fp.reshape(len(fp), -1)
    n, lanes = fp.shape
    parent = np.arange(n, dtype=np.int64)
    if n < 2:
        return parent

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= budget

    i = np.flatnonzero(root[1:] == root[:-1])
    i = i[near(i, i + 1)]
    parent = _unite(parent, i, i + 1)
    cut = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
    lo, hi = cut, np.r_[cut[1:], n]
    many = hi - lo > 1
    todo = [(0, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int16))]

    def middle(a: np.ndarray, b: np.ndarray, bit: int) -> np.ndarray:
        """First index in each run [a, b) whose bit is set; runs share all higher bits, so a binary search finds it."""
        a, end, lane, shift = a.copy(), b.copy(), fp[:, bit // 64], np.uint64(63 - bit % 64)
        while True:
            open_ = a < end
            if not open_.any():
                return a
            mid = (a + end) >> 1
            one = (lane[np.minimum(mid, n - 1)] >> shift & np.uint64(1)).astype(bool)
            end = np.where(open_ & one, mid, end)
            a = np.where(open_ & ~one, mid + 1, a)

    turns = np.cumsum(np.r_[0, parent[1:] != parent[:-1]])  # equal at both ends of a run: one component holds the run
    while todo:
        bit, a0, a1, b0, b1, d = todo.pop()
        if len(a0) > WIDE:
            for at in range(0, len(a0), WIDE):
                todo.append((bit, *(x[at : at + WIDE] for x in (a0, a1, b0, b1, d))))
            continue
        one = (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1]) & (parent[a0] == parent[b0])
        single = (a1 - a0 == 1) & (b1 - b0 == 1) & ~one
        if single.any():
            i, j = a0[single], b0[single]
            close = near(i, j)
            if close.any():
                parent = _unite(parent, i[close], j[close])
                turns = np.cumsum(np.r_[0, parent[1:] != parent[:-1]])
        go = ~single & ~one
        if bit == 64 * lanes or not go.any():
            continue
        a0, a1, b0, b1, d = a0[go], a1[go], b0[go], b1[go], d[go]
        am, bm = middle(a0, a1, bit), middle(b0, b1, bit)
        other = a0 != b0
        parts = [  # zeros with zeros, ones with ones, zeros with ones; ones with zeros only where the nodes differ
            (a0, am, b0, bm, d),
            (am, a1, bm, b1, d),
            (a0, am, bm, b1, d + 1),
            (am[other], a1[other], b0[other], bm[other], d[other] + 1),
        ]
        x0, x1, y0, y1, e = (np.concatenate(x) for x in zip(*parts))
        keep = (x0 < x1) & (y0 < y1) & (e <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
        if keep.any():
            todo.append((bit + 1, x0[keep], x1[keep], y0[keep], y1[keep], e[keep].astype(np.int16)))
    return parent


def _join_buckets(keys: int, lanes: int, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (keys, lanes) of long, sorted by the keys: the spanning links (a, b) of every key's trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(keys + lanes)], axis=1))
            if sum(map(len, held)) >= 1 << 17:
                rows = np.concatenate(held)
                last = (rows[:, :keys] == rows[-1, :keys]).all(axis=1)
                start = 0 if last.all() else len(rows) - int(np.argmin(last[::-1]))
                yield from settle(rows[:start])
                held = [rows[start:]]
        if held:
            yield from settle(np.concatenate(held))

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        root = np.r_[0, np.cumsum((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1))]
        fp = np.ascontiguousarray(rows[:, keys:]).view(np.uint64)
        order = np.lexsort((*fp.T[::-1], root))
        fp, root = fp[order], root[order]
        parent = trie_components(fp, root, budget)
        joined = np.flatnonzero(parent != np.arange(len(parent)))
        if len(joined):
            first, second = (fp[x, 0].view(np.int64) if lanes == 1 else np.ascontiguousarray(fp[x]).view(np.int64) for x in (joined, parent[joined]))
            if lanes == 1:
                yield pa.record_batch([pa.array(first), pa.array(second)], names=["a", "b"])
            else:
                yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), lanes).cast(pa.list_(pa.int64())) for x in (first, second)], names=["a", "b"])

    return run


def links(fps: DataFrame, budget: int = 2, hot: int | None = None) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints (column fp) that differ in at most budget bits; b is a's class in one trie."""
    hot = HOT if hot is None else hot
    spark, n = fps.sparkSession, partitions(fps.sparkSession)

    def bits_of(bits: list[int]) -> F.Column:
        out = F.lit(0).cast("long")
        for k, b in enumerate(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), k))
        return out

    def mask_of(bits: list[int]) -> F.Column:
        mask = sum(1 << b for b in bits)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))

    first = _blocks(list(range(64)), budget + 1)
    dealt = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), mask_of(b).alias("v")) for k, b in enumerate(first)))).alias("x")).select(F.col("x.k").alias("k"), F.col("x.v").alias("v"), "fp")
    sizes = stash(dealt.groupBy("k", "v").count().where("count > 1"), "buckets")
    crowded = sizes.where(F.col("count") > hot).select("k", "v")
    kept = dealt.join(sizes.where(F.col("count") <= hot).select("k", "v"), ["k", "v"], "left_semi").select("k", "v", F.lit(0).cast("long").alias("w"), "fp")
    if crowded.limit(1).count():
        again = dealt.join(crowded, ["k", "v"], "left_semi")
        for k, block in enumerate(first):
            free = _blocks([b for b in range(64) if b not in block], budget + 1)
            parts = F.array(*(F.struct(F.lit((k + 1) * 100 + j).alias("k"), mask_of(b).alias("w")) for j, b in enumerate(free)))
            kept = kept.unionByName(again.where(F.col("k") == k).select("v", "fp", F.explode(parts).alias("x")).select(F.col("x.k").alias("k"), "v", F.col("x.w").alias("w"), "fp"))

        sizes = stash(kept.where("k >= 100").groupBy("k", "v", "w").count(), "buckets").withColumn("parts", F.ceil(F.col("count") / hot)).drop("count")
        kept = kept.join(sizes, ["k", "v", "w"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
        mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(o, mine) * F.col("parts") + F.greatest(o, mine))
        kept = kept.select("k", "v", "w", F.explode(pairs).alias("p"), "fp")
    else:
        kept = kept.select("k", "v", "w", F.lit(0).cast("long").alias("p"), "fp")
    keys = ["k", "v", "w", "p"]
    return kept.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_join_buckets(4, 1, budget), "a long, b long").distinct()


#: Edges that one task may settle.
FEW = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, root): one node of its component, the same for the whole component, for every node of an edge.

    In each round every node moves to the neighbour (or itself) of least hashed priority, and the edges between the nodes
    so reached go to the next round. Priorities change by round, so that no order of the ids makes long chains slow; the
    nodes shrink by a constant factor. The rounds' maps are then followed. Each round is a written table, so its cost and
    its recovery do not depend on the rounds before it. FEW edges or less are settled by one task, which saves the driver the
    plans of further rounds.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([np.asarray(b.column(k)) for k in range(2)]) for b in batches]
        if held:
            name, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            at = at.reshape(2, -1)
            yield pa.record_batch([pa.array(name), pa.array(name[_unite(np.arange(len(name)), at[0], at[1])])], names=["node", "up"])

    maps: list[DataFrame] = []
    edges = stash(edges.select("a", "b").where("a <> b"), "edges")
    while many := edges.count():
        if many <= FEW:
            maps.append(stash(edges.coalesce(1).mapInArrow(settle, "node long, up long"), "up"))
            break
        turn = F.lit(len(maps))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, turn).alias("p"), F.col(c).alias("n"))
        up = stash(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), "m")["n"].alias("up")), "up")
        maps.append(up)
        x = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        edges = stash(x.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("up").alias("root"))
    for up in maps[1:]:
        out = out.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2, hot: int | None = None) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id reachable over links of at most budget differing bits."""
    marks = stash(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = stash(marks.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(least.select("fp"), budget, hot))
    joined = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owner = joined.groupBy("root").agg(F.min("least").alias("component"))
    return marks.join(joined.join(owner, "root").select("fp", "component"), "fp").select("id", "fp", "component")


#: 64-bit words of a wide fingerprint, and the chance that a pair at the asked similarity meets in no deal.
LANES, MISSED = 4, 0.03


def deals_for(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a deal and number of deals for n fingerprints.

    12 bits up to 2**18 fingerprints and one more for every further four times as many, so a trie grows with the square root of
    the input; as many deals as leave a pair at the similarity apart with probability MISSED (24 at 0.8 and 12 bits).
    """
    bits = 12 + max(0, math.ceil((math.log2(max(n, 1)) - 18) / 2))
    meets = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - meets))


def bit_budget(similarity: float, bits: int = 64 * LANES) -> int:
    """Bits that two texts at this Jaccard similarity of shingles may differ in: the expected share and one standard error."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + math.sqrt(bits * share * (1 - share)))


#: Bits of the filter that keeps sets without a proposed pair from moving.
SIEVE = 1 << 24


def _sieve(need: DataFrame) -> np.ndarray:
    """A bit for each of SIEVE classes of numbers that holds one of need; fixed in size, and it passes every number of need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(SIEVE, bool)
        for b in batches:
            on[np.asarray(b.column(0)) & SIEVE - 1] = True
        yield pa.record_batch([pa.array([np.packbits(on).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(SIEVE // 8, np.uint8)
    for r in need.coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def _node(h: np.ndarray) -> int:
    """A set's name: a hash of its sorted shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64))


def _sets(rows: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(node, s): the shingle sets of nodes (node, rep), made anew from the rows (text_hash, text) whose hash is a node's rep.

    Sets are several times as large as what they come from, so they are not kept; texts that are nobody's rep cost one look at
    a filter of fixed size, and of a task's copies one is made.
    """
    bits = rows.sparkSession.sparkContext.broadcast(_sieve(reps.select("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[int] = set()
        for b in batches:
            at = np.asarray(b.column(0))
            place = at & SIEVE - 1
            on = np.flatnonzero(bits.value[place >> 3] >> (7 - (place & 7)) & 1)
            fresh = [i for i in on.tolist() if int(at[i]) not in made and not made.add(int(at[i]))]
            for start in range(0, len(fresh), 500):
                sets = [shingles(b.column(1)[i].as_py(), words) for i in fresh[start : start + 500]]
                yield pa.record_batch([pa.array([_node(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "s"])

    found = rows.select("text_hash", "text").mapInArrow(run, "node long, s binary")
    return stash(found.join(reps.select("node"), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")), "candidate-sets")


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have this Jaccard similarity or more, by the whole sets. nodes: (node, rep)."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    reps = stash(need.join(nodes.select("node", "rep"), "node").groupBy("node").agg(F.min("rep").alias("rep")), "candidates")
    sets = _sets(rows, reps, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared > 0 and shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: Bits kept of a shingle's hash where only its rarity is asked: shingles that these take for one look shared, which costs time and no link.
KEPT = 44
#: Shingles that a task packs into one shard.
SHARD = 1 << 22


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(to_planes(x)), 1)


def _unpacked(content: bytes, n: int) -> np.ndarray:
    whole = zstandard.decompress(content)
    return from_planes([whole[k : k + n] for k in range(0, len(whole), n)], n, np.int64)


def suspects(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node): the sets that may have a partner at the similarity; any that has one is among them. rows: (text_hash, text).

    A set with a partner shares at least `similarity` of its shingles, so one with more shingles of its own is out. Shingles are
    counted exactly, at any size: a task sorts those of its texts and sends each range of hashes its part of them, as packed steps
    with the number of the only text that has a shingle (0: several have). The range's task finds which no other shard has and
    answers each shard with a count for every text. Copies of a text in other tasks make its shingles look shared.
    """
    ranges = partitions(rows.sparkSession)
    bounds = np.array([(k << KEPT) // ranges for k in range(ranges + 1)], np.uint64)
    schema = "shard long, range int, n int, h binary, x binary"

    def row(*values: object) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=["shard", "range", "n", "h", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[int] = set()
        shard, held, name, total = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            for t, text in zip(b.column(0).to_pylist(), b.column(1)):
                if t in made:
                    continue
                made.add(t)
                h = shingles(text.as_py(), words)
                if len(h):
                    held.append(h)
                    name.append(_node(h))
                    total += len(h)
                if total >= SHARD:
                    yield from flush(shard, held, name)
                    shard, held, name, total = shard + 1, [], [], 0
        if held:
            yield from flush(shard, held, name)

    def flush(shard: int, held: list[np.ndarray], name: list[int]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(h) for h in held], np.int64)
        yield row(shard, shard % ranges, -len(sizes), np.array(name, np.int64).tobytes(), sizes.tobytes())
        h, text = np.concatenate(held) >> np.uint64(64 - KEPT), np.repeat(np.arange(1, len(sizes) + 1), sizes)
        order = np.argsort(h)
        h, text = h[order], text[order]
        first = np.r_[True, h[1:] != h[:-1]]
        text = np.where(np.r_[first[1:], True], text, 0)[first]
        h = h[first]
        ends = np.searchsorted(h, bounds)
        for k in np.flatnonzero(np.diff(ends)).tolist():
            a, b = ends[k], ends[k + 1]
            yield row(shard, k, b - a, _packed(np.diff(h[a:b], prepend=np.uint64(0))), _packed(text[a:b]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                shard, k, n, h, x = (c[i].as_py() for c in b.columns)
                if n < 0:
                    yield row(shard, k, n, h, x)
                    continue
                if k != at and held:
                    yield from settle(held)
                    held = []
                at = k
                held.append((shard, np.cumsum(_unpacked(h, n)), _unpacked(x, n)))
        if held:
            yield from settle(held)

    def settle(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[1] for x in held])
        order = np.argsort(h)
        first = np.r_[True, np.diff(h[order]) > 0]
        alone = np.empty(len(h), bool)
        alone[order] = first & np.r_[first[1:], True]
        at = 0
        for shard, _, text in held:
            own = np.bincount(text[alone[at : at + len(text)]])
            own[:1] = 0
            at += len(text)
            if own.any():
                yield row(shard, 0, len(own), _packed(own), None)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, named = None, np.zeros(1, np.int64), None
        for b in batches:
            for i in range(b.num_rows):
                shard, _, n, h, x = (c[i].as_py() for c in b.columns)
                if shard != at and named:
                    yield found(own, *named)
                    own, named = np.zeros(1, np.int64), None
                at = shard
                if n < 0:
                    named = np.frombuffer(h, np.int64), np.frombuffer(x, np.int64)
                    continue
                more = _unpacked(h, n)
                own = np.pad(own, (0, max(0, n - len(own))))
                own[:n] += more
        if named:
            yield found(own, *named)

    def found(own: np.ndarray, name: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        own = np.pad(own, (0, max(0, len(sizes) + 1 - len(own))))[1:]
        return pa.record_batch([pa.array(name[own < sizes - np.ceil(similarity * sizes - 1e-9) + 1])], names=["node"])

    sent = rows.select("text_hash", "text").mapInArrow(pack, schema).repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(count, schema)
    return sent.repartition(ranges, "shard").sortWithinPartitions("shard").mapInArrow(judge, "node long").distinct()


def _runs(columns: int, settle: Callable[[np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows of long sorted by the first: settle gets whole runs of equal ones, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([np.asarray(b.column(i)) for i in range(columns)], axis=1))
            if sum(map(len, held)) >= 1 << 17:
                rows = np.concatenate(held)
                last = rows[:, 0] == rows[-1, 0]
                start = 0 if last.all() else len(rows) - int(np.argmin(last[::-1]))
                if start:
                    yield from settle(rows[:start])
                held = [rows[start:]]
        rows = np.concatenate(held) if held else []
        if len(rows):
            yield from settle(rows)

    return run


def _contested(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows (token, class, node, size) those whose token several classes have, with the number of these."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
    cut = np.flatnonzero(new)
    classes = np.add.reduceat((new | np.r_[True, rows[1:, 1] != rows[:-1, 1]]).astype(np.int64), cut)
    classes = np.repeat(classes, np.diff(np.r_[cut, len(rows)]))
    on = classes > 1
    yield pa.record_batch([pa.array(x) for x in (*rows[on].T, classes[on])], names=["token", "class", "node", "size", "classes"])


#: Sets that one token may bring together pair by pair; of more, each is linked with the next by size.
CROWD = 64


def _ties(similarity: float) -> Callable[[np.ndarray], Iterator[pa.RecordBatch]]:
    """Of rows (token, class, node, size, pos): spanning links (a, b) of all nodes of unlike classes that share a token and whose sizes
    and places of the token allow the similarity. No more rows than nodes, however many pairs there are."""

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows[np.lexsort((rows[:, 3], rows[:, 0]))]
        token, cls, node, size, pos = rows.T
        cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.r_[cut, len(rows)])
        crowd = np.repeat(length > CROWD, length)
        name, at = np.unique(node, return_inverse=True)
        parent = np.arange(len(name))
        i = np.arange(len(rows))
        for step in range(1, CROWD):
            i = i[i + step < len(rows)]
            j = i + step
            on = (token[i] == token[j]) & (size[i] >= similarity * size[j] - 1e-9)  # sizes rise within a token
            i, j = i[on], j[on]
            most = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j])
            can = (cls[i] != cls[j]) & (most >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9)
            can |= crowd[i]  # neighbours by size link all that sizes allow
            parent = _unite(parent, at[i[can]], at[j[can]])
            i = i[~crowd[i]]
            if not len(i):
                break
        tied = np.flatnonzero(parent != np.arange(len(parent)))
        yield pa.record_batch([pa.array(name[tied]), pa.array(name[parent[tied]])], names=["a", "b"])

    return settle


def _compare(size: np.ndarray, cls: np.ndarray, part: np.ndarray, tokens: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Spanning links between sets (tokens, one after the other) of unlike classes and, where there are two, unlike parts, by the exact similarity."""
    m, ends = len(size), np.cumsum(size)
    token = np.unique(tokens, return_inverse=True)[1]
    n = np.bincount(token)
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(m), size)[np.argsort(token, kind="stable")]
    label = np.unique(cls, return_inverse=True)[1]
    two = part.min() != part.max()
    for x in range(m - 1):
        open_ = label != label[x]
        open_[: x + 1] = False
        if two:
            open_ &= part != part[x]
        if not open_.any():
            continue
        mine = token[ends[x] - size[x] : ends[x]]
        mine = mine[n[mine] > 1]
        shared = np.zeros(m, np.int64)
        for some in np.split(mine, np.flatnonzero(np.diff(np.cumsum(n[mine]) >> 21)) + 1):
            k = n[some]
            shared += np.bincount(owner[np.repeat(start[some] - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=m)
        for y in np.flatnonzero(open_ & (shared > 0) & (shared >= similarity * (size[x] + size - shared) - 1e-9)).tolist():
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                yield x, y


#: Shingles of a group of this many are compared in one task; of more, parts that grow with the root of their number.
PART = 1 << 16


def missed(rows: DataFrame, nodes: DataFrame, roots: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links that join all nodes of unlike roots that have the similarity, by the whole sets. rows: (text_hash, text).

    Only the sets of suspects are made. With shingles in one common order, two sets of the similarity share one of their first
    `size - ceil(similarity * size) + 1` (prefix filtering); the order is by the exact number of classes that have a shingle, and those
    of a single class come first and need not travel. Sets that so meet are tied, not paired: a group's rows stay in proportion to its
    sets, and the sets of a group are then compared where they lie, in a grid of parts if they are many.
    """
    spark = rows.sparkSession
    reps = stash(nodes.join(suspects(rows, words, similarity), "node").groupBy("node").agg(F.min("rep").alias("rep")), "suspects")
    named = _sets(rows, reps, words).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"), "s")
    named = stash(named, "suspect-sets")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                node, cls = (np.asarray(b.column(k).slice(at, 500)) for k in range(2))
                tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2).slice(at, 500)]
                n = np.array([len(x) for x in tokens], np.int64)
                yield pa.record_batch([pa.array(x) for x in (np.concatenate(tokens), *(np.repeat(x, n) for x in (cls, node, n)))], names=["token", "class", "node", "size"])

    def by_token(df: DataFrame) -> DataFrame:
        return df.repartition(partitions(spark), "token").sortWithinPartitions("token")

    shared = by_token(named.mapInArrow(spread, "token long, class long, node long, size long")).mapInArrow(_runs(4, _contested), "token long, class long, node long, size long, classes long")
    heads = shared.groupBy("node", "class", "size").agg(F.sort_array(F.collect_list(F.struct("classes", "token"))).alias("x")).withColumn("own", F.col("size") - F.size("x"))
    heads = heads.withColumn("left", F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1 - F.col("own")).where("left > 0")
    tokens = heads.select("class", "node", "size", "own", F.posexplode(F.slice("x", F.lit(1), F.col("left").cast("int"))).alias("k", "t"))
    tokens = by_token(tokens.select("t.token", "class", "node", "size", (F.col("own") + F.col("k")).alias("pos")))
    tied = components(tokens.mapInArrow(_runs(5, _ties(similarity)), "a long, b long").distinct())

    met = named.join(tied.withColumnRenamed("root", "group"), "node")
    parts = stash(met.groupBy("group").agg(F.sum(F.octet_length("s") / 8).alias("n")), "groups").select("group", F.ceil(F.sqrt(F.col("n") / PART)).alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(o, mine) * F.col("parts") + F.greatest(o, mine))
    dealt = met.join(parts, "group").select("group", F.explode(pairs).alias("w"), mine.alias("part"), "class", "node", "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for i, key in enumerate(keys):
                if key != at and held:
                    yield settle(held)
                    held = []
                at = key
                held.append((*(b.column(k)[i].as_py() for k in (2, 3, 4)), np.frombuffer(b.column(5)[i].as_py(), np.uint64)))
        if held:
            yield settle(held)

    def settle(held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        part, cls, node = (np.array(x, np.int64) for x in list(zip(*held))[:3])
        sets = [x[3] for x in held]
        found = list(_compare(np.array([len(s) for s in sets], np.int64), cls, part, np.concatenate(sets), similarity))
        return pa.record_batch([pa.array(node[[p[k] for p in found]], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition(partitions(spark), "group", "w").sortWithinPartitions("group", "w").mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block: int | None = None) -> DataFrame:
    """(id, text_hash, fp, component, root): groups of texts linked by a Jaccard similarity of distinct shingles of at least `similarity`.

    A node is a set of shingles, named by its hash; texts without words share the empty set, which nothing else is linked with.
    A link holds by the exact similarity of the sets. The trie self-join proposes spanning links first, so that dense groups cost
    their size: fingerprints of distinct shingles have 256 bits here, as 64 cannot tell 0.8 from 0.5, and the budget of that similarity.
    Pairs meet in any of several deals, each a set of tries over the fingerprints that agree on some drawn bits. A trie of more
    than `block` fingerprints is dealt in blocks, every pair of blocks a trie of its own, so that no task holds more than two. What
    fingerprints miss, or a refused link hid, comes from `missed`, which leaves out no link between the groups so found. Shingle sets
    are larger than the texts: they are made from these where they are needed, and only those of few texts are written.
    """
    block = HOT if block is None else block
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                node, fps = [], []
                for t in part.column(2):
                    h = shingles(t.as_py(), words)
                    node.append(_node(h))
                    fps.append(set_fingerprint(h, LANES))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(fps).view(np.int64)), LANES).cast(pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(node, pa.int64()), lists], names=["id", "text_hash", "node", "fp"])

    marks = stash(rows.mapInArrow(run, "id long, text_hash long, node long, fp array<long>"), "fingerprints")
    nodes = stash(marks.groupBy("node", "fp").agg(F.min("id").alias("least"), F.min("text_hash").alias("rep")), "nodes")
    least = stash(nodes.groupBy("fp").agg(F.min("node").alias("node")), "distinct-fingerprints")
    drawn = np.random.default_rng(SEED)
    width, number = deals_for(least.count(), similarity)
    deals = np.stack([drawn.choice(64 * LANES, width, replace=False) for _ in range(number)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).flatten()
            bits = np.unpackbits(np.asarray(fp).view(np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
            for k, places in enumerate(deals):
                value = bits[:, places].astype(np.int64) @ (1 << np.arange(width))
                yield pa.record_batch([pa.array(np.full(b.num_rows, k, np.int32)), pa.array(value), b.column(0)], names=["k", "v", "fp"])

    dealt = least.select("fp").mapInArrow(deal, "k int, v long, fp array<long>")
    sizes = stash(dealt.groupBy("k", "v").count().where("count > 1"), "buckets").withColumn("blocks", F.ceil(F.col("count") / block))
    dealt = dealt.join(sizes.drop("count"), ["k", "v"])
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(o, mine) * F.col("blocks") + F.greatest(o, mine))
    dealt = dealt.select("k", "v", F.explode(pairs).alias("w"), "fp")
    cols = [F.col("fp")[k].alias(f"f{k}") for k in range(LANES)]
    found = dealt.select("k", "v", "w", *cols).repartition(partitions(docs.sparkSession), "k", "v", "w").sortWithinPartitions("k", "v", "w").mapInArrow(_join_buckets(3, LANES, bit_budget(similarity)), "a array<long>, b array<long>").distinct()
    ends = [least.select(F.col("fp").alias(f"fp_{x}"), F.col("node").alias(x)) for x in "ab"]
    near = found.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(ends[0], "fp_a").join(ends[1], "fp_b").select("a", "b")
    alike = nodes.select("fp", F.col("node").alias("a")).join(least.withColumnRenamed("node", "b"), "fp").where("a <> b").select("a", "b")
    edges = verified(stash(near.unionByName(alike), "proposed"), rows, nodes, words, similarity)
    edges = stash(edges, "links")
    roots = components(edges.unionByName(missed(rows, nodes, components(edges), words, similarity)))
    joined = nodes.join(roots, "node", "left").select("node", "fp", "least", F.coalesce("root", "node").alias("root"))
    owner = joined.groupBy("root").agg(F.min("least").alias("component"))
    return marks.select("id", "text_hash", "node").join(joined.join(owner, "root").select("node", "fp", "component", "root"), "node").select("id", "text_hash", "fp", "component", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of every group of near copies: that of the smallest id (null ids last), then of the smallest text hash.

    Rows without a word in their text, null texts among them, are nobody's copies: they take no part and all stay.
    """
    worded = has_word(F.col(text_col).cast("string"))
    blank, docs = docs.where(~worded), docs.where(worded)
    groups = near_copies(docs, id_col, text_col, words, similarity)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")).alias("m"))

    def key(i: str, h: str) -> F.Column:  # one column, never null: the join and the grouping after it share an exchange
        return F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("~")), F.col(h).cast("string")).alias("__key")

    keep = first.select(key("m.id", "m.text_hash")).distinct()
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    kept = named.select("row", key("i", "h")).join(keep, "__key", "left_semi")
    return kept.groupBy("__key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*").unionByName(blank)
