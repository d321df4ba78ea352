"""Vector functions as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import stable_hash, tokenize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def hash_embed(docs: DataFrame, id_col: str, text_col: str, dims: int = 256) -> DataFrame:
    """(id, bucket, weight): sparse unit vectors of signed hashed token counts; texts without tokens have no rows."""
    tokens = docs.select(F.col(id_col).alias("id"), F.explode(tokenize(F.col(text_col))).alias("t"))
    counts = tokens.groupBy("id", "t").agg(F.count("*").alias("n"))
    h = stable_hash(F.col("t"))
    sign = F.when(F.floor(h / dims) % 2 == 1, 1.0).otherwise(-1.0)
    sums = counts.select("id", (h % dims).cast("int").alias("bucket"), (sign * F.col("n")).alias("w")).groupBy("id", "bucket").agg(F.sum("w").alias("w")).where("w <> 0")
    lengths = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return sums.join(lengths, "id").select("id", "bucket", (F.col("w") / F.col("len")).alias("weight"))
