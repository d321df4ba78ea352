"""Counts, costs and scores over a store and its write log, and the baselines that it is compared with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import count_tokens


@dataclass(frozen=True)
class Pricing:
    """Prices per thousand tokens embedded and served, and per extraction call."""

    embed_per_1k: float = 0.0001
    serve_per_1k: float = 0.0025
    extract_call: float = 0.0


def store_stats(records: DataFrame, versions: DataFrame) -> DataFrame:
    """(namespace, episodic, semantic, facts, open_facts, bytes): counts, and bytes of the records' text."""
    r = records.groupBy("namespace").agg(F.count_if(F.col("tier") == "episodic").alias("episodic"), F.count_if(F.col("tier") == "semantic").alias("semantic"), F.sum(F.octet_length("content")).alias("bytes"))
    f = versions.groupBy("namespace").agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to").isNull() & F.col("expired_at").isNull()).alias("open_facts"))
    return r.join(f, "namespace", "full").na.fill(0)


def write_metrics(decisions: DataFrame) -> DataFrame:
    """(namespace, writes, stored, reinforced, discarded, discard_rate)."""
    n = {d: F.count_if(F.col("decision") == d).alias(d) for d in ("stored", "reinforced", "discarded")}
    return decisions.groupBy("namespace").agg(F.count("*").alias("writes"), *n.values(), F.avg((F.col("decision") == "discarded").cast("int")).alias("discard_rate"))


def operations(decisions: DataFrame, records: DataFrame, versions: DataFrame, served: DataFrame | None = None) -> DataFrame:
    """write_metrics with store_size and structured_facts and, given the contexts served (namespace, tokens), queries and their average tokens."""
    out = write_metrics(decisions).join(records.groupBy("namespace").agg(F.count("*").alias("store_size")), "namespace", "full")
    out = out.join(versions.groupBy("namespace").agg(F.count("*").alias("structured_facts")), "namespace", "full")
    if served is not None:
        out = out.join(served.groupBy("namespace").agg(F.count("*").alias("queries"), F.avg("tokens").alias("avg_context_tokens")), "namespace", "full")
    return out.na.fill(0)


def cost(embed_tokens: Column, served_tokens: Column, extract_calls: Column, prices: Pricing | None = None) -> Column:
    p = prices or Pricing()
    return embed_tokens / 1000.0 * p.embed_per_1k + served_tokens / 1000.0 * p.serve_per_1k + extract_calls * p.extract_call


def growth(decisions: DataFrame) -> DataFrame:
    """decisions with seen, stored_so_far and ratio: how much of the stream the store has kept up to each write."""
    order = W.partitionBy("namespace").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    seen, stored = F.count("*").over(order), F.sum((F.col("decision") == "stored").cast("long")).over(order)
    return decisions.withColumns({"seen": seen, "stored_so_far": stored, "ratio": stored / seen})


def long_context(records: DataFrame, budget: int = 800) -> DataFrame:
    """Newest records of a namespace up to the first that would overflow the token budget.

    Token counts are added up to the newest first; an empty record costs nothing, so a prefix sum stops where a loop would.
    """
    order = W.partitionBy("namespace").orderBy(F.col("ts").desc(), F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
    return records.withColumn("tokens", count_tokens(F.col("text"))).withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= budget)


def no_memory(questions: DataFrame) -> DataFrame:
    """(query_id, context): nothing for any question."""
    return questions.select("query_id", F.lit("").alias("context"))


def read_answers(contexts: DataFrame, probes: DataFrame) -> DataFrame:
    """(query_id, answer) from contexts (query_id, line_no, line): the longest candidate (query_id, candidate) in the first line that
    mentions the subject (query_id, subject, question) and that is not in the question."""
    asked = probes.select("query_id", "subject", "question", F.explode("candidates").alias("candidate")).where(~F.contains(F.lower("question"), F.lower("candidate")))
    lines = contexts.join(probes.select("query_id", F.col("subject").alias("who")), "query_id").where(F.contains(F.lower("line"), F.lower("who")))
    hits = lines.join(asked, "query_id").where(F.contains(F.lower("line"), F.lower("candidate")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("line_no", -F.length("candidate"), "candidate"))
    return hits.withColumn("n", rank).where("n = 1").select("query_id", F.col("candidate").alias("answer"))


def harness_scores(results: DataFrame, stored: float | None = None, written: float | None = None) -> DataFrame:
    """(category, probes, score) of results (category, gold, stale, answer, served_tokens): accuracy, for C2 not counting stale
    answers, for C3 less half of the tokens relative to the most of any category, for C4 less the share of what was written that
    the store holds, where both numbers are given."""
    right = F.coalesce(F.lower("answer") == F.lower("gold"), F.lit(False)) & ~F.coalesce(F.lower("answer") == F.lower("stale"), F.lit(False))
    per = results.groupBy("category").agg(F.count("*").alias("probes"), F.avg(right.cast("int")).alias("accuracy"), F.avg("served_tokens").alias("tokens"))
    worst = results.groupBy("category").agg(F.avg("served_tokens").alias("t")).agg(F.max("t").alias("worst"))
    x = per.join(F.broadcast(worst))  # one row
    size = stored / max(1.0, written) if stored is not None and written is not None else 0.0
    score = F.when(F.col("category") == "C3", F.col("accuracy") - 0.5 * F.col("tokens") / F.greatest("worst", F.lit(1.0))).when(F.col("category") == "C4", F.col("accuracy") - size)
    return x.select("category", "probes", score.otherwise(F.col("accuracy")).alias("score"))
