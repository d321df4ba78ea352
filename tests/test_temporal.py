"""Bi-temporal operators against a plain replay."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import temporal

SCHEMA = "namespace string, id long, subject string, predicate string, object string, valid_from double, created_at double"


def replay(rows):
    """One assertion after another against the one open version of its key."""
    versions, current = {}, {}
    for ns, i, s, p, o, vf, at in sorted(rows, key=lambda r: (r[6], r[1])):
        key = (ns, s.strip().lower(), p.strip().lower())
        held = current.get(key)
        if held is None:
            versions[i] = [o, vf, None, at, None, None]
        elif versions[held][0].strip().lower() == o.strip().lower():
            continue
        elif vf < versions[held][1]:
            versions[i] = [o, vf, versions[held][1], at, None, held]
            continue
        else:
            versions[held][2], versions[held][4], versions[held][5] = vf, at, i
            versions[i] = [o, vf, None, at, None, None]
        current[key] = i
    return {i: tuple(v) for i, v in versions.items()}


def collected(df):
    return {r["id"]: (r["object"], r["valid_from"], r["valid_to"], r["created_at"], r["expired_at"], r["superseded_by"]) for r in df.collect()}


assertion = st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["Erin", "erin ", "Bob"]), st.sampled_from(["city", "role"]), st.sampled_from(["x", "X ", "y", "z"]), st.integers(0, 6), st.integers(0, 4))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(assertion, max_size=40))
def test_versions_equal_a_replay(spark, drawn):
    rows = [(ns, i, s, p, o, float(vf), float(at)) for i, (ns, s, p, o, vf, at) in enumerate(drawn)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(temporal.assert_facts(df)) == replay(rows)
    monotone = [(*r[:5], r[6], r[6]) for r in rows]
    assert collected(temporal.assert_monotone(spark.createDataFrame(monotone, SCHEMA))) == replay(monotone)


def facts(spark):
    rows = [("n", 1, "Erin", "city", "Berlin", 1.0, 1.0), ("n", 2, "Erin", "city", "Vienna", 5.0, 5.0), ("n", 3, "Erin", "city", "Oslo", 3.0, 6.0), ("n", 4, "Erin", "manager", "Bob", 1.0, 1.0), ("n", 5, "Bob", "city", "Riga", 1.0, 1.0), ("m", 6, "Erin", "city", "Turin", 1.0, 1.0)]
    return temporal.assert_facts(spark.createDataFrame(rows, SCHEMA))


def ask(spark, t, subject="ERIN ", predicate="City", ns="n"):
    q = spark.createDataFrame([(1, ns, subject, predicate, t)], "query_id long, namespace string, subject string, predicate string, t double")
    got = temporal.as_of(facts(spark), q).collect()
    return got[0]["object"] if got else None


def test_as_of(spark):
    assert [ask(spark, t) for t in (None, 0.5, 1.0, 4.9, 5.0, 9.0)] == ["Vienna", None, "Berlin", "Berlin", "Vienna", "Vienna"]
    assert ask(spark, None, ns="m") == "Turin"
    assert ask(spark, None, predicate="none") is None


def test_paths_inverse_and_forget(spark):
    v = facts(spark)
    q = spark.createDataFrame([(1, "n", "Erin", None), (2, "n", "Bob", None)], "query_id long, namespace string, subject string, t double")
    assert [tuple(r) for r in temporal.path(v, q, ["manager", "city"]).collect()] == [(1, "Riga", [4, 5])]
    assert [r["subject"] for r in temporal.subjects_where(v, "city", " riga").collect()] == ["Bob"]
    assert temporal.subjects_where(v, "city", "Berlin").count() == 0
    assert temporal.subjects_where(v, "city", "Berlin", t=2.0).count() == 1
    gone = spark.createDataFrame([("n", "bob")], "namespace string, subject string")
    assert {r["id"] for r in temporal.forget(v, gone).collect()} == {1, 2, 3, 6}
    assert {r["id"] for r in temporal.forget(v, gone, as_object=False).collect()} == {1, 2, 3, 4, 6}
    assert {r["id"] for r in temporal.forget(v, gone, predicate="CITY").collect()} == {1, 2, 3, 4, 6}


def test_at_most_one_open_version(spark):
    v = temporal.keyed(temporal.open_facts(facts(spark)))
    assert v.groupBy(*temporal.KEY).count().where(F.col("count") > 1).count() == 0


def test_contradictions_are_of_the_open_fact(spark):
    """A late telling does not become the open fact, so what repeats the open fact after it contradicts nothing."""
    rows = [("n", 1, "Erin", "city", "Rome", 10.0, 1.0), ("n", 2, "Erin", "city", "Oslo", 5.0, 2.0), ("n", 3, "Erin", "city", "Rome", 30.0, 3.0), ("n", 4, "Erin", "city", "Bonn", 31.0, 4.0), ("n", 5, "Bob", "city", "A", 1.0, 1.0), ("n", 6, "Bob", "city", "b", 1.0, 2.0), ("n", 7, "Bob", "city", "B", 2.0, 3.0)]
    got = {r["id"]: r["contradicts"] for r in temporal.contradictions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert temporal.assert_facts(none).count() == temporal.assert_monotone(none).count() == 0
