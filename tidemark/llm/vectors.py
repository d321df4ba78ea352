"""Vectors as rows of longs and arrays: what both vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column, allow_zero: bool) -> Column:
    """Whether a vector is there and all of its components are finite numbers, and not all of them zero unless that is allowed."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & (F.lit(True) if allow_zero else some), F.lit(False))


def rows(table: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """(id, v): valid vectors, as floats if they came so and as doubles otherwise. Rows equal in both are one row, and null ids take no part."""
    kind = "array<float>" if dict(table.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    return v.where(F.col("id").isNotNull() & valid(F.col("v"), allow_zero)).distinct()


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """(ids, v): every distinct vector with its smallest ids, at most `ids` of them.

    More copies of a vector can never be among the nearest, since ties go to the smaller id; `ids` is one more than a result
    has, for the query's own row. Copies are cut to that number before they move, so a hot vector is no large group.
    """
    from pyspark.sql import Window as W

    first = vectors.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= ids)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "v")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists are of one length, as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
