"""The write gate: what of a stream is stored, reinforces what is there, or is discarded. Sequential per namespace."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import fold


@dataclass(frozen=True)
class GateConfig:
    """Share of the stream to store, the threshold's start, floor, ceiling and rate, and the similarity that reinforces."""

    budget: float = 0.2
    theta: float = 0.5
    theta_floor: float = 0.35
    theta_max: float = 0.95
    lr: float = 0.05
    reinforce_sim: float = 0.7


def decide(state: dict, config: GateConfig, novelty: float, contradiction: bool) -> dict:
    """One decision; the threshold then moves by how far the stored share is from the budget."""
    theta = state["theta"]
    stored = contradiction or novelty >= theta
    decision = "stored" if stored else "reinforced" if 1 - novelty >= config.reinforce_sim else "discarded"
    state["seen"] += 1
    state["stored"] += stored
    state["theta"] = min(config.theta_max, max(config.theta_floor, theta + config.lr * (state["stored"] / state["seen"] - config.budget)))
    return {"decision": decision, "theta": theta, "theta_next": state["theta"]}


def _start(config: GateConfig) -> dict:
    return {"theta": config.theta, "seen": 0, "stored": 0}


def adaptive_gate(stream: DataFrame, config: GateConfig | None = None) -> DataFrame:
    """stream (namespace, ts, id, novelty, contradiction) with decision, theta (that decided) and theta_next."""
    config = config or GateConfig()
    return fold(stream, ["namespace"], ["ts", "id"], lambda: _start(config), lambda s, r: decide(s, config, r["novelty"], bool(r["contradiction"])), "decision string, theta double, theta_next double")


def gate_vectors(stream: DataFrame, config: GateConfig | None = None) -> DataFrame:
    """stream (namespace, ts, id, embedding) gated by novelty against what was stored before: decision, novelty, target.

    novelty is one less the highest cosine to a stored record, in [0, 1], and 1 for a zero vector or an empty store; target is
    the stored record that a reinforced one is nearest to. A column surprise, if there is one, raises novelty to itself. What is
    held per namespace is what the gate stores.
    """
    config = config or GateConfig()

    def start() -> dict:
        return _start(config) | {"x": None, "ids": [], "n": 0}

    def step(s: dict, row: dict) -> dict:
        v = np.array(row["embedding"] or [], float)
        length = np.linalg.norm(v)
        target, novelty = None, 1.0
        if length > 0:
            v = v / length
            if s["n"]:
                sims = s["x"][: s["n"]] @ v
                best = int(sims.argmax())
                target, novelty = s["ids"][best], 1.0 - min(1.0, max(0.0, float(sims[best])))
        got = decide(s, config, max(novelty, row.get("surprise") or 0.0), bool(row.get("contradiction")))
        if got["decision"] == "stored" and length > 0:
            if s["x"] is None:
                s["x"] = np.zeros((64, len(v)))
            if s["n"] == len(s["x"]):
                s["x"] = np.concatenate([s["x"], np.zeros_like(s["x"])])
            s["x"][s["n"]] = v
            s["ids"].append(row["id"])
            s["n"] += 1
        return got | {"novelty": novelty, "target": target if got["decision"] == "reinforced" else None}

    return fold(stream, ["namespace"], ["ts", "id"], start, step, "decision string, theta double, theta_next double, novelty double, target long")


def reinforcement(decisions: DataFrame) -> DataFrame:
    """(namespace, id, support_count, last_seen_ts) of stored records: themselves and what reinforced them."""
    target = F.when(F.col("decision") == "reinforced", F.col("target")).otherwise(F.col("id"))
    rows = decisions.where(F.col("decision").isin("stored", "reinforced")).withColumn("target", target)
    return rows.groupBy("namespace", F.col("target").alias("id")).agg(F.count("*").alias("support_count"), F.max("ts").alias("last_seen_ts"))


def predictive_surprise(logprobs: Column) -> Column:
    """One less the likelihood per token; 0 without tokens. Nulls are passed over."""
    known = F.filter(logprobs, lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    return F.when(F.size(known) > 0, 1 - F.exp(mean)).otherwise(0.0)


def fused_novelty(novelty: Column, surprise: Column) -> Column:
    return F.greatest(novelty, F.coalesce(surprise, F.lit(0.0)))


def session_first_ts(writes: DataFrame) -> DataFrame:
    """(namespace, session_no, ts): the earliest time of every session named s and a number."""
    no = F.regexp_extract("session_id", r"^s(\d+)$", 1)
    return writes.where(no != "").groupBy("namespace", no.cast("int").alias("session_no")).agg(F.min("ts").alias("ts"))


def as_dict(config: GateConfig) -> dict:
    return asdict(config)
