"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data gets surrogates, sources are
mixed to their weights, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all of docs; its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Rows without a word in their text, null texts among them, give
no ground to reject them and are nobody's copies: both filters keep all of them. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, pii, simhash, toxicity
from tidemark.llm.common import has_word, stash, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half, by a model of all labelled ones, and those without a word."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), hold_out=False)
    return toxicity.scores(docs, model).where((F.col("score") < 0.5) | ~has_word(F.col("row.text"))).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share about 0.8 or more of their five-word shingles."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the new text."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return pii.pseudonymise(docs).select(*(new[c].alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan: one row per piece of a document."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints, a fitted classifier and best-fit packing have no SQL form; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"stage-{name}")
    return docs
