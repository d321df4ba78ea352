"""Joins of tables that grow: whole results, and no side of them in a broadcast."""

from collections import Counter

import pytest
from support import SF

from tidemark.operators import joins, retrieve, temporal
from tidemark.plans.catalog import QUERIES


def sent(df) -> list[int]:
    """Rows of every broadcast that a run of df makes."""

    def below(node):
        kind = node.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            yield node.metrics().apply("numOutputRows").value()
        inner = "plan" if kind.endswith("QueryStageExec") else {"AdaptiveSparkPlanExec": "executedPlan", "ReusedExchangeExec": "child"}.get(kind)
        for x in [getattr(node, inner)()] if inner else [node.children().apply(k) for k in range(node.children().size())]:
            yield from below(x)

    df._jdf.queryExecution().executedPlan().executeCollect()
    return list(below(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("frequent", [0, 1, 3, 1_000])
def test_meet_is_a_join(spark, monkeypatch, frequent):
    monkeypatch.setattr(joins, "FREQUENT", frequent)
    many = [(n, "n0" if n % 5 else None, "the" if n % 3 else f"w{n}") for n in range(60)] + [(99, "n1", "the"), (100, "n0", None)]
    few = [("n0", "the", 1), ("n0", "the", 2), ("n0", "w3", 3), (None, "w6", 4), ("n0", None, 5), ("n1", "w9", 6)]
    left, right = spark.createDataFrame(many, "id long, namespace string, word string"), spark.createDataFrame(few, "namespace string, word string, what int")
    got = joins.meet(left, right, ["namespace", "word"])
    assert got.columns == ["id", "namespace", "word", "what"]
    want = [(i, n, w, x) for i, n, w in many for m, v, x in few if n is not None and w is not None and (n, w) == (m, v)]
    assert Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("name", ["plan_entity", "plan_predicate", "plan_preference", "plan_chain", "plan_hops", "structured_fetch", "backstop_facts"])
def test_questions_and_entities_are_not_broadcast(name, spark, monkeypatch):
    monkeypatch.setattr(joins, "FREQUENT", 9)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")  # only what is planned, not what turns out small
    try:
        assert max(sent(QUERIES[name](spark, SF)), default=0) < spark.read.parquet(f"{SF}/customer.parquet").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_one_fact_and_paths_come_from_one_chain_of_joins(spark):
    rows = [("n", 1, "Ann", "boss", "Bo", 0.0, 0.0), ("n", 2, "bo", "city", "Oslo", 0.0, 0.0), ("n", 3, "bo", "city", "Rome", 5.0, 5.0)]
    v = temporal.assert_facts(spark.createDataFrame(rows, "namespace string, id long, subject string, predicate string, object string, valid_from double, created_at double"))
    plans = [(1, "n", "ann", "boss", None, None), (2, "n", "ann", "city", ["boss", "city"], None), (3, "n", "ann", "city", ["boss", "city"], 1.0), (4, "n", "ann", "city", None, None), (5, "m", "ann", "boss", None, None)]
    plans = spark.createDataFrame([(*p, False) for p in plans], "query_id long, namespace string, entity string, predicate string, hops array<string>, as_of double, preference boolean")
    got = sorted(map(tuple, retrieve.structured_fetch(plans, v).collect()))
    assert got == [(1, 1, "Ann's current boss is Bo.", 1), (2, 1, "ann boss city is Rome.", 1), (2, 2, "ann boss city is Rome.", 3), (3, 1, "ann boss city is Oslo.", 1), (3, 2, "ann boss city is Oslo.", 2)]


def test_predicates_need_all_of_their_words(spark):
    stored = spark.createDataFrame([("n", "favorite color"), ("n", "color"), ("n", "favorite food"), ("m", "shade"), ("n", "the")], "namespace string, predicate string")
    asked = [(1, "n", "What is the favorite color of c1?"), (2, "n", "Which color, and where does c1 live?"), (3, "m", "favorite color or shade"), (4, "n", None), (5, None, "color")]
    got = retrieve.plan_predicates(spark.createDataFrame(asked, "query_id long, namespace string, question string"), stored)
    assert {r["query_id"]: r["predicates"] for r in got.collect()} == {1: ["color", "favorite color"], 2: ["color", "city"], 3: ["shade"], 4: [], 5: []}
