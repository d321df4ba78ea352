"""Consolidation of episodes into claims, and erasure.

Episodes have namespace, id, ts, content, tier, support_count, last_seen_ts and, if they assert a fact, fact_subject,
fact_predicate and fact_object.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import normalize
from tidemark.operators import temporal
from tidemark.operators.ordered import fold


#: What a claim takes over from the episode that speaks for it.
LINK = ("ts", "fact_subject", "fact_predicate", "fact_object")


def _fact_keys(episodes: DataFrame) -> DataFrame:
    return episodes.withColumns({k: normalize(F.col(c)) for k, c in (("s_key", "fact_subject"), ("p_key", "fact_predicate"), ("o_key", "fact_object"))})


def prune_outdated(episodes: DataFrame, versions: DataFrame) -> DataFrame:
    """Fact-linked episodes that state the current value of their key; others, and those of keys without one, go."""
    now = temporal.keyed(temporal.current(versions)).select(*temporal.KEY, "o_key")
    linked = _fact_keys(episodes.where(F.col("fact_predicate").isNotNull()))
    return linked.join(now, [*temporal.KEY, "o_key"], "left_semi").select(*episodes.columns)


def consolidated(episodes: DataFrame, versions: DataFrame, embedding: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(claims, absorbed): what stands for several episodes from now on, and the episodes (namespace, id) that no longer stand for
    themselves: those merged, and those that state what is no longer so."""
    kept = prune_outdated(episodes, versions)
    linked = episodes.where(F.col("fact_predicate").isNotNull()).select("namespace", "id")
    free = episodes.where(F.col("fact_predicate").isNull())
    clusters = leader_clusters(free.select("namespace", "ts", "id", embedding.alias("embedding")), threshold)
    claims = merge_same_fact(kept).unionByName(merge_clusters(free, clusters))
    merged = claims.select("namespace", F.explode("supports").alias("id"))
    outdated = linked.join(kept.select("namespace", "id"), ["namespace", "id"], "left_anti")
    return claims, merged.unionByName(outdated).distinct()


def _representative(*cols: str) -> list[Column]:
    best = F.struct(-F.col("support_count"), F.col("id"))
    return [F.min_by(c, best).alias(c) for c in cols]


def merge_same_fact(episodes: DataFrame) -> DataFrame:
    """Claims of current fact-linked episodes: one per key that several assert, in the words of the best supported.

    (namespace, content, support_count, last_seen_ts, supports, entities, and the ts and fact of the best supported); keys with one
    episode are no claims.
    """
    rows = _fact_keys(episodes).groupBy("namespace", "s_key", "p_key")
    claims = rows.agg(
        *_representative("content", *LINK), F.sum("support_count").alias("support"), F.max("last_seen_ts").alias("last_seen_ts"),
        F.array_sort(F.collect_list("id")).alias("supports"), F.array_sort(F.collect_set("fact_subject")).alias("entities"),
    ).where(F.size("supports") > 1)
    return claims.select("namespace", "content", F.col("support").alias("support_count"), "last_seen_ts", "supports", "entities", *LINK)


def leader_clusters(rows: DataFrame, threshold: float) -> DataFrame:
    """(namespace, ts, id, embedding, leader): each row joins the first cluster whose first member is similar enough, or starts one."""

    def start() -> dict:
        return {"x": np.zeros((0, 0)), "n": 0, "ids": []}

    def step(s: dict, row: dict) -> dict:
        v = np.array(row["embedding"] or [], float)
        length = np.linalg.norm(v)
        v = v / length if length else v
        if s["n"] and len(v):
            near = np.flatnonzero(s["x"][: s["n"]] @ v >= threshold)
            if len(near):
                return {"leader": s["ids"][near[0]]}
        if len(v):
            if s["n"] == len(s["x"]):
                grown = np.zeros((max(64, 2 * s["n"]), len(v)))
                grown[: s["n"]] = s["x"][: s["n"]] if s["n"] else 0
                s["x"] = grown
            s["x"][s["n"]] = v
            s["n"] += 1
            s["ids"].append(row["id"])
        return {"leader": row["id"]}

    return fold(rows, ["namespace"], ["ts", "id"], start, step, "leader long")


def merge_clusters(episodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Claims of free-text episodes that share a leader, like merge_same_fact."""
    rows = episodes.join(clusters.select("namespace", "id", "leader"), ["namespace", "id"]).groupBy("namespace", "leader")
    claims = rows.agg(*_representative("content", *LINK), F.sum("support_count").alias("support"), F.max("last_seen_ts").alias("last_seen_ts"), F.array_sort(F.collect_list("id")).alias("supports"))
    return claims.where(F.size("supports") > 1).select("namespace", "content", F.col("support").alias("support_count"), "last_seen_ts", "supports", F.array().cast("array<string>").alias("entities"), *LINK)


def summarise(claims: DataFrame, completions: DataFrame) -> DataFrame:
    """claims in the first line of a model's completion (content, completion), where there is a non-empty one."""
    first = F.trim(F.element_at(F.split(F.trim("completion"), r"\r?\n"), 1))
    return claims.join(completions, "content", "left").withColumn("content", F.when(first != "", first).otherwise(F.col("content"))).drop("completion")


def near_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine): pairs of rows (id, bucket, weight) of sparse unit vectors at least this similar, a < b.

    With the buckets in one common order, rarest first, a pair whose first shared bucket lies where the rest of a vector is shorter than the
    threshold can't reach it. So pairs meet by the buckets before that only, and their products are summed over all buckets after.
    """
    held = rows.groupBy("bucket").agg(F.count("*").alias("held"))
    rest = F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("id").orderBy("held", "bucket").rowsBetween(0, W.unboundedFollowing))
    least = max(0.0, threshold - 1e-6) ** 2 - 1e-9  # cosines are rounded to six places
    head = rows.join(held, "bucket").withColumn("rest", rest).where(F.col("rest") >= least).select("id", "bucket")
    met = head.toDF("a", "bucket").join(head.toDF("b", "bucket"), "bucket").where("a < b").select("a", "b").distinct()
    found = met.join(rows.toDF("a", "bucket", "wa"), "a").join(rows.toDF("b", "bucket", "wb"), ["b", "bucket"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return found.where(F.round("cosine", 6) >= threshold)


def report(episodes: DataFrame, claims: DataFrame, kept: DataFrame, versions: DataFrame) -> DataFrame:
    """(namespace, episodes_in, claims_out, dupes_merged, pruned, contradictions_resolved); every fact that is not open counts as a contradiction."""
    linked = episodes.where(F.col("fact_predicate").isNotNull())
    sums = [
        episodes.groupBy("namespace").agg(F.count("*").alias("episodes_in")),
        claims.groupBy("namespace").agg(F.count("*").alias("claims_out"), F.sum(F.size("supports") - 1).alias("dupes_merged")),
        linked.groupBy("namespace").agg(F.count("*").alias("linked")),
        kept.groupBy("namespace").agg(F.count("*").alias("kept")),
        versions.where(~temporal.is_open()).groupBy("namespace").agg(F.count("*").alias("contradictions_resolved")),
    ]
    out = sums[0]
    for s in sums[1:]:
        out = out.join(s, "namespace", "left")
    out = out.na.fill(0)
    return out.select("namespace", "episodes_in", "claims_out", "dupes_merged", (F.col("linked") - F.col("kept")).alias("pruned"), "contradictions_resolved")


def forget_cascade(subjects: DataFrame, versions: DataFrame, episodes: DataFrame, vectors: DataFrame, asserted: DataFrame) -> dict[str, DataFrame]:
    """Everything that is left once subjects (namespace, subject) are erased: facts, episodes linked to them, vectors tagged with
    them, and the texts that the echo guard remembers (namespace, text_id). Mentions in free text stay."""
    gone = subjects.select("namespace", normalize(F.col("subject")).alias("s_key")).distinct()
    rows = _fact_keys(episodes)
    by_subject = rows.join(gone, ["namespace", "s_key"], "left_semi").select("id")
    by_object = rows.join(gone.withColumnRenamed("s_key", "o_key"), ["namespace", "o_key"], "left_semi").select("id")
    doomed = by_subject.union(by_object).distinct()
    tagged = vectors.select("id", "namespace", F.explode("entities").alias("e")).select("id", "namespace", normalize(F.col("e")).alias("s_key"))
    tags = tagged.join(gone, ["namespace", "s_key"], "left_semi").select("id").union(doomed).distinct()
    return {
        "facts": temporal.forget(versions, subjects),
        "episodes": episodes.join(doomed, "id", "left_anti"),
        "vectors": vectors.join(tags, "id", "left_anti"),
        "asserted": asserted.join(doomed.withColumnRenamed("id", "text_id"), "text_id", "left_anti"),
    }
