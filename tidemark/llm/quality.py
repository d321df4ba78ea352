"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

One weight vector scores a text; ordered thresholds cut the score into grades: P(grade >= g) = logistic(score - threshold g).
All grades share the weights, so a rating says on which side of each threshold a text lies. The result is the expected grade
and the tail probability of a grade, by which rows are kept.

Features of a whole text are hashed counts of its lower-cased words and of the words' shapes (letter case, digits and marks,
runs shortened), each as a square root of its share of the text, scaled to unit length together. The model is fitted on the
driver by L-BFGS over at most `max_rows` rated rows, drawn by a hash of the id; weights take 2**BITS numbers, whatever the
input. Thresholds are kept in order by fitting the logarithms of their steps.

Defined cases: a null or word-less text has no features and gets the grades' base rates; rated rows need an id, a text and a
whole grade from 0; of several texts of one id the smallest trains, of several grades the highest; with fewer than two grades
every row gets the one grade there is (0 if there is none); repeated rows get equal results; an empty table stays empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from tidemark.llm.common import labelled_sample
from tidemark.llm.linear import Rows, lbfgs

BITS = 16
MAX_ROWS = 6_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes by class: lower case a, upper case A, digits 0, other UTF-8 bytes u, marks themselves, blanks as they are.
_SHAPE = bytes(97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 117 if c >= 128 else c for c in range(256))
_RUN = re.compile(rb"([aA0u])\1+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of a UTF-8 text and their values."""
    raw = text or b""
    words = _WORD.findall(raw.translate(_LOWER))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    total = np.zeros(0)
    index, count = [], []
    for seed, found in ((1, Counter(words)), (2, Counter(_WORD.findall(_RUN.sub(rb"\1", raw.translate(_SHAPE)))))):
        index += [zlib.crc32(w, seed) for w in found]
        count += found.values()
    f, inverse = np.unique(np.array(index, np.int64) & (1 << BITS) - 1, return_inverse=True)
    total = np.sqrt(np.bincount(inverse, weights=np.array(count, float)) / len(words))
    return f.astype(np.int32), (total / np.sqrt((total**2).sum())).astype(np.float32)


@dataclass
class Model:
    """weights, and the thresholds between grades in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: bytes | None) -> np.ndarray:
        """P(grade >= g) for each g from 1 up."""
        return tail_chances(self.weights, self.thresholds, text)


def tail_chances(weights: np.ndarray, thresholds: np.ndarray, text: bytes | None) -> np.ndarray:
    f, v = features(text)
    z = float(weights[f].astype(np.float64) @ v) - thresholds
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0, -x)


def ordinal_loss(x: Rows, grade: np.ndarray, grades: int, dims: int, l2: float):
    """Negative log-likelihood of the cumulative-link model and its gradient; parameters are weights, the first threshold, and log steps."""
    n = len(grade)
    low, high = grade > 0, grade < grades - 1

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, steps = p[:dims], np.exp(np.clip(p[dims + 1 :], -30, 30))
        cuts = p[dims] + np.r_[0.0, np.cumsum(steps)]
        z = x.dot(w)
        a = np.where(low, z - cuts[np.maximum(grade - 1, 0)], np.inf)  # P(grade or more)
        b = np.where(high, z - cuts[np.minimum(grade, grades - 2)], -np.inf)  # P(more)
        with np.errstate(invalid="ignore"):
            # log(s(a) - s(b)) = log s(a) + log s(-b) + log(1 - exp(b - a))
            gap = np.where(low & high, np.minimum(b - a, -1e-12), -np.inf)
            ll = np.where(low, _log_sigmoid(np.where(low, a, 0)), 0) + np.where(high, _log_sigmoid(-np.where(high, b, 0)), 0) + np.where(low & high, np.log1p(-np.exp(gap)), 0)
            mid = np.where(low & high, np.exp(gap) / -np.expm1(gap), 0)
        da = np.where(low, 1 / (1 + np.exp(np.clip(np.where(low, a, 0), -500, 500))) + mid, 0)
        db = np.where(high, -1 / (1 + np.exp(np.clip(-np.where(high, b, 0), -500, 500))) - mid, 0)
        g_cut = -np.bincount(np.maximum(grade - 1, 0)[low], weights=da[low], minlength=grades - 1) - np.bincount(np.minimum(grade, grades - 2)[high], weights=db[high], minlength=grades - 1)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.r_[x.gather(da + db, dims), tail[0], tail[1:] * steps]
        g[:dims] -= l2 * w
        return float(-ll.sum() + 0.5 * l2 * w @ w) / n, -g / n

    return loss


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "grade", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, l2: float = 0.3) -> Model:
    """Learn from at most max_rows rated rows."""
    marks = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("y")).where("id IS NOT NULL AND y >= 0")
    rows = labelled_sample(docs, marks, id_col, text_col, max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([f.tobytes() for f, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["y", "f", "v"])

    held = rows.select("y", F.col("text").cast("binary").alias("text")).mapInArrow(extract, "y int, f binary, v binary").toArrow()
    y = np.asarray(held.column("y")).astype(np.int64)
    dims, grades = 1 << BITS, int(y.max()) + 1 if len(y) else 1
    if len(np.unique(y)) < 2:
        return Model(np.zeros(dims, np.float32), np.repeat([-30.0], grades - 1))
    part = lambda name, t: [np.frombuffer(x.as_buffer(), t) for c in held.column(name).chunks for x in c]
    x = Rows(part("f", np.int32), part("v", np.float32))
    share = np.clip([(y >= g).mean() for g in range(1, grades)], 1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    p = lbfgs(ordinal_loss(x, y, grades, dims, l2), np.r_[np.zeros(dims), start[0], np.log(np.maximum(np.diff(start), 1e-3))], rounds=100, tolerance=2e-5)
    return Model(p[:dims].astype(np.float32), p[dims] + np.r_[0.0, np.cumsum(np.exp(np.clip(p[dims + 1 :], -30, 30)))])


def scores(docs: DataFrame, model: Model, grade: int, keep: float = 0.5, text_col: str = "text") -> DataFrame:
    """(row, expected_grade, tail_probability, keep): row is a struct of docs' columns; rows whose chance of `grade` or more is at least `keep` are kept."""
    # 2**BITS floats whatever the input; plain arrays, as objects of this package need it on the executors
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, thresholds = sent.value
        for t in texts:
            tails = [tail_chances(weights, thresholds, x.as_py()) for x in t]
            tail = [float(p[grade - 1]) if grade <= len(p) else 0.0 for p in tails] if grade else [1.0] * len(tails)
            yield pa.StructArray.from_arrays([pa.array([float(p.sum()) for p in tails], pa.float64()), pa.array(tail, pa.float64())], names=["expected", "tail"])

    score = F.arrow_udf(run, "expected double, tail double", ArrowUDFType.SCALAR_ITER)
    rated = docs.select(F.struct("*").alias("row")).withColumn("s", score(F.col(f"row.{text_col}").cast("string").cast("binary")))
    return rated.select("row", F.col("s.expected").alias("expected_grade"), F.col("s.tail").alias("tail_probability"), (F.col("s.tail") >= keep).alias("keep"))
