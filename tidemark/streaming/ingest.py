"""Streaming forms of the order-dependent operators: the same decisions as the batch folds, one keyed state per key.

Rows of a key must reach the stream in arrival order; a late valid_from is history and never dropped, so there is no
watermark. State is checkpointed by the engine, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import gate, temporal

_LABEL = "namespace string, id long, subject string, predicate string, object string, valid_from double, created_at double, label string, open_id long, open_from double"
_GATE = "namespace string, id long, ts double, novelty double, contradiction boolean, decision string, theta double"


def label_assertions(stream: DataFrame) -> DataFrame:
    """A stream of assertions with label, open_id and open_from, as operators.temporal.label_assertions gives them."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get) if state.exists else None  # id, object key, valid_from
        rows = pd.concat(list(parts)).sort_values(["created_at", "id"], kind="stable")
        labels: list[tuple] = []
        for r in rows.itertuples():
            if open_ and open_[1] == r.o_key:
                labels.append(("noop", None, None))
            elif open_ and r.valid_from < open_[2]:
                labels.append(("hist", open_[0], open_[2]))
            else:
                labels.append(("super", open_[0] if open_ else None, None))
                open_ = [int(r.id), r.o_key, float(r.valid_from)]
        if open_:
            state.update(tuple(open_))
        out = rows.drop(columns=["s_key", "p_key", "o_key"])
        out["label"], out["open_id"], out["open_from"] = (pd.Series(x, index=out.index, dtype=t) for x, t in zip(zip(*labels), ("object", "Int64", "Float64")))
        yield out

    keyed = temporal.keyed(stream.select("namespace", "id", "subject", "predicate", "object", "valid_from", "created_at"))
    return keyed.groupBy(*temporal.KEY).applyInPandasWithState(run, _LABEL, "id long, object string, valid_from double", "append", GroupStateTimeout.NoTimeout)


def gate_stream(stream: DataFrame, config: gate.GateConfig | None = None) -> DataFrame:
    """A stream (namespace, id, ts, novelty, contradiction) with the gate's decision and threshold."""
    config = config or gate.GateConfig()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        theta, seen, stored = state.get if state.exists else (config.theta, 0, 0)
        s = {"theta": theta, "seen": seen, "stored": stored}
        rows = pd.concat(list(parts)).sort_values(["ts", "id"], kind="stable")
        got = [gate.decide(s, config, r.novelty, bool(r.contradiction)) for r in rows.itertuples()]
        rows["decision"], rows["theta"] = [g["decision"] for g in got], [g["theta"] for g in got]
        state.update((float(s["theta"]), int(s["seen"]), int(s["stored"])))
        yield rows

    return stream.groupBy("namespace").applyInPandasWithState(run, _GATE, "theta double, seen long, stored long", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run write(batch, number) on everything that is there, in order, each batch once; a journal's append fits."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
