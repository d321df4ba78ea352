"""Toxicity: a linear classifier over hashed character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased characters, over the whole text. Every feature is
scaled by its log-count ratio, the log of how much likelier toxic training texts hold it than clean ones. The model is
fitted on at most `max_rows` labelled rows, drawn by a hash of the id: counts are added up on the executors, the `kept`
features whose ratios stand out most from their error stay, and a logistic regression with an L2 penalty on the scaled
features is fitted on the driver. Both bounds hold at any input size, and the sample's ids are all that is broadcast.
Scores are probabilities, computed where the rows are.

Defined cases: a null or very short text has no features and gets about the training rows' rate of label 1; training rows
need an id, a text and a label of 0 or 1, anything else is left out; of several texts of one id the smallest trains; with no
training rows every score is 0.25; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from tidemark.llm.common import labelled_sample
from tidemark.llm.linear import Rows, lbfgs

BITS = 18
ORDERS = (3, 4, 5)
MAX_ROWS = 8_000
KEPT = 1 << 11
_M = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xD6E8FEB86659FD93)


def features(text: str | None, seen: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Distinct hashed n-grams of a text. seen: scratch of 2**bits int32, with any content."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts, h = [], c + np.uint64(1)
    for n in range(2, max(orders) + 1):
        if len(c) < n:
            break
        h = h[:-1] * _M + c[n - 1 :] + np.uint64(1)
        if n in orders:
            parts.append(((h ^ (h >> np.uint64(29))) * (_FINAL + np.uint64(2 * n)) >> np.uint64(64 - bits)).astype(np.int32))
    if not parts:
        return np.zeros(0, np.int32)
    f = np.concatenate(parts)
    place = np.arange(len(f), dtype=np.int32)
    seen[f] = place  # of equal features one write stays, so exactly one place reads itself back
    return f[seen[f] == place]


@dataclass
class Model:
    """weights: per feature, ratios already multiplied in; intercept: of the log-odds."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None, seen: np.ndarray) -> float:
        return probability(self.weights, self.intercept, text, seen)


def probability(weights: np.ndarray, intercept: float, text: str | None, seen: np.ndarray) -> float:
    z = intercept + float(weights[features(text, seen)].sum(dtype=np.float64))
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by five; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, kept: int = KEPT, l2: float = 2.0, alpha: float = 1.0, hold_out: bool = True) -> Model:
    """Learn from at most max_rows labelled rows; with hold_out, from none of the held-out fifth."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    marks = marks.where(~held_out(F.col("id"))) if hold_out else marks
    rows = labelled_sample(docs, marks, id_col, text_col, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, n = np.zeros(1 << BITS, np.int32), np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), b.column("text")):
                total[y][features(t.as_py(), seen)] += 1
                n[y] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch([pa.array(np.r_[at, -1]), pa.array(np.r_[total[0, at], n[0]]), pa.array(np.r_[total[1, at], n[1]])], names=["f", "n0", "n1"])

    sums = rows.mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    at, n0, n1 = (np.asarray(sums.column(k)) for k in range(3))
    counts, real = np.zeros((2, 1 << BITS)), at >= 0
    counts[0, at[real]], counts[1, at[real]] = n0[real], n1[real]
    clean, toxic = (int(x[~real].sum()) for x in (n0, n1))
    rate = (toxic + 0.5) / (clean + toxic + 2)
    prior = float(np.log(rate / (1 - rate)))
    if not clean or not toxic:
        return Model(np.zeros(1 << BITS, np.float32), prior)
    ratio = np.log((counts[1] + alpha) / (toxic + 2 * alpha)) - np.log((counts[0] + alpha) / (clean + 2 * alpha))
    error = np.sqrt(1 / (counts[0] + alpha) + 1 / (counts[1] + alpha))
    best = np.sort(np.argsort(-np.abs(ratio) / error, kind="stable")[:kept])
    place = np.full(1 << BITS, -1, np.int32)
    place[best] = np.arange(len(best))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int32)
        for b in batches:
            found = [(f := place[features(t.as_py(), seen)])[f >= 0].tobytes() for t in b.column("text")]
            yield pa.record_batch([b.column("y"), pa.array(found, pa.binary())], names=["y", "f"])

    part = rows.mapInArrow(project, "y int, f binary").toArrow()
    y = np.asarray(part.column("y")).astype(np.float64)
    x = Rows([np.frombuffer(f.as_buffer(), np.int32) for chunk in part.column("f").chunks for f in chunk])
    x.scaled(ratio[best])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w[:-1]) + w[-1]
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        f = float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * l2 * w[:-1].dot(w[:-1]))
        return f, np.r_[x.gather(p - y, len(best)) + l2 * w[:-1], (p - y).sum()]

    w = lbfgs(loss, np.r_[np.zeros(len(best)), prior])
    weights = np.zeros(1 << BITS, np.float32)
    weights[best] = w[:-1] * ratio[best]
    return Model(weights, float(w[-1]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, score): row is a struct of docs' columns."""
    # 2**BITS floats whatever the input; an array and a number, as objects of this package need it on the executors
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, intercept = sent.value
        seen = np.zeros(1 << BITS, np.int32)
        for t in texts:
            yield pa.array([probability(weights, intercept, x.as_py(), seen) for x in t], pa.float64())

    score = F.arrow_udf(run, "double", ArrowUDFType.SCALAR_ITER)
    return docs.select(F.struct("*").alias("row")).withColumn("score", score(F.col(f"row.{text_col}").cast("string")))
