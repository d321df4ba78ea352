"""Variable-capacity best-fit packing of documents into training sequences.

Sequences may have any of several permitted lengths, each with a cost. Pieces are placed longest first into the open sequence
with the least room that still fits; where none fits, a sequence of the least-cost length is opened. After the last piece
every sequence shrinks to the least permitted length that holds its contents. Which length is cheapest to open depends on all
the others, so several opening rules (least cost per token that can still be placed, and each length as the preferred one)
are run and the one whose shrunk sequences cost least in all is kept.

Documents longer than the largest length are cut into consecutive pieces of it, so no token is dropped. Rows are dealt evenly
to shards of a bounded number of pieces, by position in a written table, and every shard is packed on its own; copies of one
row spread like any others. What shards leave unfilled is less than one sequence each.

Defined cases: a null text is empty; an empty document is one piece, its end mark; rows with null or repeated ids are packed
like others; ties go by id and piece; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash, word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Pieces to a shard.
SHARD = 50_000


def sequence_cost(length: int) -> float:
    """Relative cost of a sequence: a fixed overhead, its tokens, and attention that grows with the square."""
    return 64.0 + length + length * length / 16384.0


def best_fit(sizes: Sequence[int], opened: Callable[[int, int], int]) -> tuple[list[int], list[int], list[int]]:
    """Place sizes in order. opened(size, left) is the length to open. Returns each piece's bin and offset, and bins' contents."""
    room: dict[int, list[int]] = {}
    mask, left = 0, sum(sizes)
    where, offset, content, length = [], [], [], []
    for size in sizes:
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            at, free = len(content), opened(size, left)
            content.append(0)
            length.append(free)
        where.append(at)
        offset.append(content[at])
        content[at] += size
        left -= size
        if free > size:
            room.setdefault(free - size, []).append(at)
            mask |= 1 << (free - size)
    return where, offset, content


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each size; sizes must be in descending order and fit the largest capacity."""
    caps = sorted(capacities)
    costs = {c: cost(c) for c in caps}
    cap_array = np.array(caps)

    def least_unit_cost(size: int, left: int) -> int:
        return min((c for c in caps if c >= size), key=lambda c: (costs[c] / min(c, left), -c))

    def preferring(want: int) -> Callable[[int, int], int]:
        return lambda size, left: next(c for c in caps if c >= max(size, want))

    best = None
    for rule in (least_unit_cost, *map(preferring, caps)):
        where, offset, content = best_fit(sizes, rule)
        final = cap_array[np.searchsorted(cap_array, content)] if content else np.zeros(0, np.int64)
        total = sum(costs[int(c)] * int(n) for c, n in zip(*np.unique(final, return_counts=True)))
        if best is None or total < best[0]:
            best = (total, np.array(where, np.int64), np.array(offset, np.int64), final)
    _, where, offset, final = best
    return where, offset, final[where] if len(where) else final


def packed(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, shard_rows: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_length.

    length: tokens of a row; by default its words and one end mark.
    """
    most = max(capacities)
    length = word_count(F.col(text_col).cast("string")) + 1 if length is None else length
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(length.cast("long"), F.lit(1)).alias("n"))
    pieces = sizes.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most))).alias("piece"))
    pieces = stash(pieces.select("doc_id", "piece", (F.col("piece") * most).alias("piece_start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).alias("n_tokens")), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(t.column("piece")), np.asarray(t.column("doc_id").fill_null(-1)), -np.asarray(t.column("n_tokens"))))
        t = t.take(pa.array(order))
        where, offset, final = pack(np.asarray(t.column("n_tokens")).tolist(), capacities, cost)
        shard = np.asarray(t.column("shard"))
        new = {"bin_id": (shard << 32) + where, "bin_offset": offset, "bin_length": final}
        return pa.table([t.column(c) for c in ("doc_id", "piece", "piece_start", "n_tokens")] + [pa.array(x.astype(np.int64)) for x in new.values()], names=["doc_id", "piece", "piece_start", "n_tokens", *new])

    dealt = pieces.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, piece_start long, n_tokens long, bin_id long, bin_offset long, bin_length long")
