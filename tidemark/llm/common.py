"""Shared ground for the training-data operators: durable intermediate tables, input access, word counts."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the operators' Python functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["tidemark"])

#: A word, as every operator here counts them: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is
    local (tests). On a cluster it must be set, as executors can't see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables and files of this application, once its results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_word(text: Column) -> Column:
    """Whether there is a word in a text; false for null."""
    return F.coalesce(text.rlike(WORD), F.lit(False))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """(id, y, text): about max_rows labelled rows at most, as a written table.

    marks: (id, y). Ids are drawn by their hash, so the draw does not depend on partitions. The drawn ids are bounded and
    may be broadcast; texts are read once and only drawn ones move. Of several texts of one id the smallest stays, and of
    several labels the largest.
    """
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    share = max_rows / max(1, marks.count())
    drawn = marks.where(F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53) < share) if share < 1 else marks
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return stash(texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")
