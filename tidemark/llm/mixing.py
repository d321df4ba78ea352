"""Mixing sources to target weights by Pareto order sampling.

Sources get word targets by weight, capped at a multiple of their size, the excess reshared. Within a source a document's
expected copies are proportional to its importance (and capped too), scaled so that the expected words meet the target. The
whole part of that number is taken for certain; the rest is an inclusion probability p, and documents are ranked by the
Pareto statistic, the odds of their own uniform number divided by the odds of p. The sample is of fixed size in words: the
longest prefix of that order that fits what the certain copies leave of the target. What is then left of it is filled, twice,
by the document beyond whose size comes nearest to it, if that comes closer than leaving it.

Places in the order are found by one sort of a narrow table (source, size, statistic) into ranges, running sums within a range
and the sums of the ranges before it, so a source that holds most rows is spread over many tasks. A decision is a place in the
order, one row per source. Texts do not move: they meet their source's decision by its place. Uniform numbers are keyed hashes
of id and text: reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows with null ids take part;
repeated rows are rows of their own with neighbouring places, of which as many are taken as fit; a source without words has
target 0; an empty table gives an empty result. Some rows per source (its target, its decision, and one for each importance
class) are the only thing that a single task or a broadcast may hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stash, word_count

BITS = 48
#: Rows of a range of the order, about.
RANGE = 1 << 22


def uniform(seed: int, id_col: Column, text: Column) -> Column:
    """A number in (0, 1) fixed by the seed, the id and the text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("~")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def length_importance(size: Column, half: int = 16) -> Column:
    """Importance for the registered query: rises smoothly with the size from a half to one, in steps of a 32nd; three quarters at `half` words."""
    return F.ceil(32 * (size + half / 2) / (size + half)) / 32.0


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size): share of all words dealt by weight, at most cap times a source's own."""
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = sizes.withColumn("w", F.element_at(cycle, F.pmod(place, F.lit(len(weights))) + 1)).withColumn("most", F.col("source_size") * float(cap))
    order = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    # Capping the sources in order of cap to weight raises the others' level for as long as it is due and lowers it after.
    return per.withColumn("target", F.least("most", F.max("level").over(everything) * F.col("w"))).select("source", "source_size", "target")


def _same_source(x: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """x with the columns of per, a row per source; nothing is moved while that fits Spark's checked broadcast size."""
    other = per.withColumnRenamed("source", "__source")
    return x.join(other, F.col("__source").eqNullSafe(x["source"]), how).drop("__source")


def _scales(bands: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets with lam: expected copies are least(cap, lam * importance). bands: (source, imp, words)."""
    x = _same_source(bands.where("words > 0"), targets)
    order = W.partitionBy("source").orderBy(F.col("imp").desc())
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * float(cap)
    after = F.sum(F.col("imp") * F.col("words")).over(order.rowsBetween(0, W.unboundedFollowing))
    x = x.withColumn("lam", (F.col("target") - before) / after)
    fits = x.where(F.col("lam") * F.col("imp") <= cap).groupBy("source").agg(F.max_by("lam", "imp").alias("lam"))
    return _same_source(targets, fits, "left").withColumn("lam", F.when(F.col("source_size") > 0, F.coalesce("lam", F.lit(float("inf")))).otherwise(0.0))


def _copies(cap: float) -> tuple[Column, Column]:
    """Certain copies of a row, and its place in the Pareto order (null if nothing is left to chance)."""
    expected = F.least(F.lit(float(cap)), F.col("lam") * F.col("imp"))
    whole = F.floor(expected)
    p, u = expected - whole, F.col("u")
    odds = (u / (1 - u)) * ((1 - p) / p)
    return whole, F.when((p > 0) & (F.col("size") > 0), F.floor(odds / (1 + odds) * float(1 << BITS)))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (source, size, ...), sorted by source: run, the sum of the source's sizes up to the row, and part, the task's number."""
    part, held, last, total = TaskContext.get().partitionId(), False, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(b.column(1))
        code = np.asarray(b.column(0).dictionary_encode(null_encoding="encode").indices)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        cum = np.cumsum(size)
        run = cum - np.repeat((cum - size)[starts], np.diff(np.r_[starts, len(size)]))
        if held and b.column(0)[0].as_py() == last:
            run[: starts[1] if len(starts) > 1 else None] += total
        held, last, total = True, b.column(0)[-1].as_py(), int(run[-1])
        yield pa.record_batch([*b.columns, pa.array(run), pa.array(np.full(len(run), part, np.int64))], names=[*b.schema.names, "run", "part"])


def ordered(rows: DataFrame, n: int) -> DataFrame:
    """rows (source, size, key, rh, tie) of the order with cum, the sum of their source's sizes up to them. n: number of ranges."""
    order = [F.col("source").asc_nulls_last(), "key", "rh", "tie"]
    ranged = rows.select("source", "size", "key", "rh", "tie").repartitionByRange(n, *order).sortWithinPartitions(*order)
    x = stash(ranged.mapInArrow(_running, "source string, size long, key long, rh long, tie long, run long, part long"), "order")
    ends = x.groupBy("source", "part").agg(F.max("run").alias("words"))  # a row per range, and one more for each further source in it
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = stash(ends.withColumn("before", before).select(F.col("source").alias("__source"), F.col("part").alias("__part"), "before"), "ranges")
    on = (F.col("__part") == F.col("part")) & F.col("__source").eqNullSafe(F.col("source"))
    return x.join(ends, on).select("source", "size", "key", "rh", "tie", (F.col("run") + F.col("before")).alias("cum"))


def _place() -> Column:
    return F.struct("key", "rh", "tie")


def _beyond() -> Column:
    return F.coalesce(_place() > F.col("cut"), F.lit(True))


def plan(rows: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Decisions for rows (source, size, imp, u, rh, tie) of a written table: (source, source_size, target, lam, cut, fill1, fill2), and the
    edges (source, key, rh, n, m): groups of equal rows that are decided one by one, with their rows and how many of those are taken."""
    bands = stash(rows.groupBy("source", "imp").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "bands")
    targets = source_targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    scales = stash(_scales(bands, targets, cap), "scales")
    whole, key = _copies(cap)
    placed = _same_source(rows, scales).select("source", "size", "rh", "tie", whole.alias("whole"), key.alias("key"))
    sure = placed.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    out = stash(_same_source(scales, sure).withColumn("gap", F.col("target") - F.col("sure")).drop("sure"), "gaps")
    total = bands.agg(F.sum("n")).first()[0] or 0
    line = ordered(placed.where("key IS NOT NULL"), max(partitions(rows.sparkSession), -(-total // RANGE)))
    fits = F.col("cum") <= F.col("gap")
    cut = _same_source(line, out.select("source", "gap")).groupBy("source").agg(F.max(F.when(fits, _place())).alias("cut"), F.coalesce(F.max(F.when(fits, F.col("cum"))), F.lit(0)).alias("used"))
    out = stash(_same_source(out, cut, "left").withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0))).drop("used"), "cuts")
    for k in (1, 2):
        open_ = _beyond() if k == 1 else _beyond() & F.coalesce(_place() != F.col("fill1"), F.lit(True))
        rest = _same_source(line, out.drop("source_size", "target", "lam")).where(open_).where(F.abs(F.col("gap") - F.col("size")) < F.abs("gap"))
        best = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("d"), "key", "rh", "tie", "size")).alias("b"))
        best = best.select("source", F.struct("b.key", "b.rh", "b.tie").alias(f"fill{k}"), F.col("b.size").alias("s"))
        out = stash(_same_source(out, best, "left").withColumn("gap", F.col("gap") - F.coalesce("s", F.lit(0))).drop("s"), "cuts")
    at = lambda c: F.struct(F.col(f"{c}.key"), F.col(f"{c}.rh"))
    group = F.struct("key", "rh")
    near = _same_source(line, out.drop("source_size", "target", "lam")).where(F.coalesce(group == at("cut"), F.lit(False)) | F.coalesce(group == at("fill1"), F.lit(False)) | F.coalesce(group == at("fill2"), F.lit(False)))
    edges = near.groupBy("source", "key", "rh").agg(F.count("*").alias("n"), F.count_if(_taken()).alias("m"))
    return out.drop("gap"), stash(edges, "edges")


def _taken() -> Column:
    """Whether the row's place is in the prefix or fills the rest."""
    no = F.lit(False)
    return F.coalesce(_place() <= F.col("cut"), no) | F.coalesce(_place() == F.col("fill1"), no) | F.coalesce(_place() == F.col("fill2"), no)


def copies(rows: DataFrame, decisions: DataFrame, cap: float = 2.0) -> DataFrame:
    """The rows (source, size, imp, u, rh, tie, ...) that decisions were made for, with source_size, target and copies, the times that the mix takes each."""
    whole, key = _copies(cap)
    x = _same_source(rows, decisions, "left").withColumn("key", key)
    x = x.withColumn("copies", (whole + F.coalesce(_taken() & F.col("key").isNotNull(), F.lit(False)).cast("long")).cast("long"))
    return x.drop("key", "lam", "cut", "fill1", "fill2", "rh", "tie")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, importance=length_importance) -> DataFrame:
    """docs as (row, source, size, imp, u, rh): row is a struct of all of its columns, so no name can clash; rh a hash of it."""
    text = F.col(f"row.{text_col}").cast("string")
    hashed = [F.col(f"row.`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    x = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.{source_col}").cast("string").alias("source"), word_count(text).alias("size"), uniform(seed, F.col(f"row.{id_col}"), text).alias("u"), F.xxhash64(*hashed).alias("rh"))
    return x.select("row", "source", "size", importance(F.col("size")).cast("double").alias("imp"), "u", "rh")


def numbered(rows: DataFrame) -> DataFrame:
    """rows as a written table in which each has a number of its own, tie, by which equal rows are told apart."""
    return stash(rows.withColumn("tie", F.monotonically_increasing_id()), "sizes")


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 7, importance=length_importance, **cols: str) -> DataFrame:
    """The mix itself: every row of docs as many times as it is taken, with docs' columns.

    Of equal rows at an edge any may stand for the ones taken, so they are counted and not numbered.
    """
    rows = measured(docs, seed=seed, importance=importance, **cols)
    decisions, edges = plan(numbered(rows.drop("row")), weights, share, cap)
    whole, key = _copies(cap)
    x = _same_source(rows, decisions, "left").select("row", "source", "rh", "cut", whole.alias("whole"), key.alias("key"))
    e = edges.select(F.col("source").alias("__source"), F.col("key").alias("__key"), F.col("rh").alias("__rh"), "n", "m")
    x = x.join(e, (F.col("__key") == F.col("key")) & (F.col("__rh") == F.col("rh")) & F.col("__source").eqNullSafe(F.col("source")), "left")
    inside = F.coalesce(F.struct("key", "rh") < F.struct("cut.key", "cut.rh"), F.lit(False)) & F.col("key").isNotNull()
    some = F.coalesce((F.col("m") > 0) & (F.col("m") < F.col("n")), F.lit(False))
    plain = x.where(~some).select("row", (F.col("whole") + F.coalesce(F.col("m") > 0, inside).cast("long")).alias("copies"))
    shared = x.where(some).groupBy("source", "key", "rh").agg(F.first("row").alias("row"), F.sum("whole").alias("sure"), F.first("m").alias("m"))
    taken = plain.unionByName(shared.select("row", (F.col("sure") + F.col("m")).alias("copies"))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
