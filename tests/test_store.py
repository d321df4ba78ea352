"""Gate, search, retrieval, durable state, streams and the store as a whole."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import consolidate, gate, metrics, retrieve, temporal, vector
from tidemark.sources import observations, store
from tidemark.store import Config, MemoryStore
from tidemark.streaming import ingest

FACTS = "namespace string, id long, subject string, predicate string, object string, valid_from double, created_at double"


def root(tmp_path):
    return f"file://{tmp_path}"


def test_gate_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [("n", i, float(i), float(x), bool(i % 9 == 0)) for i, x in enumerate(rng.random(400))]
    got = [tuple(r) for r in gate.adaptive_gate(spark.createDataFrame(rows, "namespace string, id long, ts double, novelty double, contradiction boolean")).orderBy("id").select("decision", "theta").collect()]
    theta, stored = 0.5, 0
    for (_, i, _, novelty, c), (decision, at) in zip(rows, got):
        assert at == pytest.approx(theta)
        assert decision == ("stored" if c or novelty >= theta else "reinforced" if 1 - novelty >= 0.7 else "discarded")
        stored += decision == "stored"
        theta = min(0.95, max(0.35, theta + 0.05 * (stored / (i + 1) - 0.2)))


def test_vector_gate_and_leaders_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    rows = [("n", float(i), i, [float(y) for y in v]) for i, v in enumerate(x)] + [("n", 200.0, 200, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "namespace string, ts double, id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    leaders, want = [], {}
    for i, v in enumerate(u):
        near = [j for j in leaders if u[j] @ v >= 0.9]
        want[i] = near[0] if near else i
        leaders += [] if near else [i]
    got = {r["id"]: r["leader"] for r in consolidate.leader_clusters(df, 0.9).collect()}
    assert {k: v for k, v in got.items() if k != 200} == want and got[200] == 200
    kept, theta, stored = [], 0.5, 0
    for r in gate.gate_vectors(df).orderBy("id").collect()[:120]:
        i = r["id"]
        sims = [max(0.0, min(1.0, u[j] @ u[i])) for j in kept]
        novelty = 1 - max(sims) if sims else 1.0
        assert r["novelty"] == pytest.approx(novelty)
        assert (r["decision"] == "stored") == (novelty >= theta)
        if r["decision"] == "reinforced":
            assert r["target"] == kept[int(np.argmax(sims))]
        if novelty >= theta:
            kept.append(i)
        stored += novelty >= theta
        theta = min(0.95, max(0.35, theta + 0.05 * (stored / (i + 1) - 0.2)))


def test_knn_ties_turns_and_zero_vectors(spark, monkeypatch):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 0.0]), (10, [-1.0, 0.0])]
    r = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(5)], "query_id long, vector array<double>")
    want = [(k, n + 1, n, 1.0) for k in range(5) for n in range(3)]
    assert sorted(map(tuple, vector.knn(r, q, 3).collect())) == want
    monkeypatch.setattr(vector, "QUERY_BATCH", 2)
    assert sorted(map(tuple, vector.knn(r, q, 3).collect())) == want
    assert vector.knn(r.limit(0), q, 3).count() == 0


def test_ivf_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(60, 16)) for c in centres])
    r = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = r.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index, c = vector.ivf_index(r, 8)
    found = {(a["query_id"], a["id"]) for a in vector.ivf_search(index, c, q, 10, 2).collect()}
    exact = {(a["query_id"], a["id"]) for a in vector.knn(r, q, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_stale_pairs_equal_a_nested_loop(spark):
    texts = [(1, "Erin moved from Berlin to Vienna"), (2, "Berlin is big"), (3, "erin lives in new york"), (4, "Erin in New Orleans"), (5, None)]
    pairs = spark.createDataFrame([(["erin"], ["berlin"]), (["erin"], ["new", "york"])], "subject_tokens array<string>, value_tokens array<string>")
    left = retrieve.drop_stale(spark.createDataFrame(texts, "id long, text string"), pairs)
    assert {r["id"] for r in left.collect()} == {2, 4, 5}


@pytest.mark.parametrize(
    ("question", "entity", "predicates", "hops"),
    [
        ("What city does Erin's manager's manager's city have?", "erin", ["city", "manager"], ["manager", "manager", "city"]),
        ("What city does Erin's manager's manager live in?", "erin", ["city", "manager"], ["manager", "manager", "city"]),
        ("The role of Erin's boss's boss now?", "erin", ["role", "manager"], ["manager", "manager", "role"]),
        ("Erin's boss's boss then", "erin", ["manager"], None),
        ("Erin's boss's role", "erin", ["role", "manager"], None),
        ("Erin's manager's manager's manager's job", "erin", ["role", "manager"], ["manager", "manager", "manager", "role"]),
        ("Who is Bob", "erin", ["role"], None),
        ("Who is Bob", None, ["role"], None),
    ],
)
def test_chains_of_relations(spark, question, entity, predicates, hops):
    df = spark.createDataFrame([(1, question, entity, predicates)], "query_id long, question string, entity string, predicates array<string>")
    assert retrieve.plan_chains(df).first()["hops"] == hops


def test_fuzzy_entities(spark):
    import difflib

    known = ["anna", "automobile", "building", "buildings", "machinery"]
    asked = ["What about autoxmobile?", "machinerx or anna", "a buildin", "nothing", "machinerx machineri", None]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    got = {r["query_id"]: r["entity"] for r in retrieve.fuzzy_entities(q, known).collect()}
    assert got == {0: "automobile", 1: None, 2: None, 3: None, 4: "machinery", 5: None}
    assert len(difflib.get_close_matches("buildin", known, n=2, cutoff=0.8)) == 2


def test_paths_of_unlike_predicates(spark):
    rows = [("n", 1, "a", "boss", "b", 0.0, 0.0), ("n", 2, "b", "city", "Oslo", 0.0, 0.0), ("n", 3, "b", "boss", "c", 0.0, 0.0), ("n", 4, "c", "role", "cook", 0.0, 0.0)]
    v = temporal.assert_facts(spark.createDataFrame(rows, FACTS))
    asked = [(1, "n", "a", None, ["boss", "city"]), (2, "n", "a", None, ["boss", "boss", "role"]), (3, "n", "a", None, ["boss", "role"]), (4, "n", "c", None, ["role"])]
    got = temporal.paths(v, spark.createDataFrame(asked, "query_id long, namespace string, subject string, t double, hops array<string>")).collect()
    assert sorted(map(tuple, got)) == [(1, "Oslo", [1, 2]), (2, "cook", [1, 3, 4]), (4, "cook", [4])]


def test_long_context_stops_at_the_first_overflow(spark):
    rows = [("n", i, float(i), "w " * n) for i, n in enumerate([1, 5, 600, 300, 100])]
    got = metrics.long_context(spark.createDataFrame(rows, "namespace string, id long, ts double, text string"), 800)
    assert {r["id"] for r in got.collect()} == {3, 4}


def test_observations(spark):
    made = observations.generate(spark, sessions=3)
    assert made.count() == 3 * 6 * 6 and made.distinct().count() == made.count()
    assert observations.strict(made).count() == made.count()
    bad = made.withColumn("ts", F.lit(float("nan")))
    with pytest.raises(PySparkException):
        observations.strict(bad).collect()
    assert observations.redundant_stream(spark, distinct=5, repeats=4).groupBy("text").count().select("count").distinct().first()[0] == 4


def test_snapshot(spark, tmp_path):
    s = store.SnapshotStore(spark, root(tmp_path))
    assert s.load() == {}
    t = spark.createDataFrame([(1, 2.5, None), (2, float("inf"), "x")], "a long, b double, c string")
    assert [s.save({"t": t.where(f"a <= {n}")}) for n in (1, 2, 2)] == [1, 2, 3]
    assert sorted(map(tuple, s.load()["t"].collect())) == sorted(map(tuple, t.collect()))
    s.folder.replace("manifest.json", '{"format": 99}')
    with pytest.raises(ValueError, match="format"):
        s.load()


def test_short_snapshot_is_refused(spark, tmp_path):
    s = store.SnapshotStore(spark, root(tmp_path))
    s.save({"t": spark.range(5)})
    spark.range(3).write.mode("overwrite").parquet(f"{root(tmp_path)}/v1/t")
    with pytest.raises(ValueError, match="rows"):
        s.load()
    with pytest.raises(PySparkException):
        store.check_vectors(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2).collect()


@pytest.mark.parametrize("text", ["not json", "[]", '{"format": 1}', '{"format": 1, "version": "2", "tables": {}, "settings": {}}', '{"format": 1, "version": 2, "tables": [], "settings": {}}', '{"format": 1, "version": 2, "tables": {"log": {"rows": "x", "schema": {}}}, "settings": {}}', '{"format": 1, "version": 2, "tables": {"log": 5}, "settings": {}}'])
def test_hostile_manifests_are_refused(spark, tmp_path, text):
    s = store.SnapshotStore(spark, root(tmp_path))
    s.folder.replace("manifest.json", text)
    with pytest.raises(ValueError):
        s.load()


def test_providers(spark):
    from tidemark.sources import providers

    calls, failures = [], [TimeoutError("slow"), ConnectionError("gone")]

    def call(texts):
        calls.append(len(texts))
        if failures:
            raise failures.pop()
        return [t.upper() for t in texts]

    p = providers.Provider(call, "m", batch=2, wait=0.0)
    assert p(["a", "b", "c"]) == ["A", "B", "C"] and calls == [2, 2, 2, 1]
    with pytest.raises(ValueError, match="answers"):
        providers.Provider(lambda t: t[1:], "m")(["a", "b"])
    with pytest.raises(OSError):
        providers.Provider(lambda t: (_ for _ in ()).throw(OSError("down")), "m", retries=1, wait=0.0)(["a"])
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, text string")
    scorer = providers.Provider(lambda texts: [[-0.5] * len(t) for t in texts], "m")
    got = df.select("id", providers.completed(F.col("text"), providers.Provider(lambda t: [x + "!" for x in t], "m")).alias("c"), F.round(gate.predictive_surprise(providers.logprobs(F.col("text"), scorer)), 6).alias("s"), providers.embedded(F.col("text"), providers.Provider(lambda t: [[len(x)] for x in t], "m")).alias("e")).collect()
    assert sorted((r["id"], r["c"], r["s"], r["e"]) for r in got) == [(1, "ab!", 0.393469, [2.0]), (2, None, 0.0, None), (3, "!", 0.0, [0.0])]


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows, full = [], {}
    for i in range(60):
        at = rng.choice(30, rng.integers(1, 7), replace=False)
        w = rng.normal(size=len(at))
        w /= np.linalg.norm(w)
        full[i] = np.zeros(30)
        full[i][at] = w
        rows += [(i, int(b), float(x)) for b, x in zip(at, w)]
    df = spark.createDataFrame(rows, "id long, bucket int, weight double")
    for t in (0.1, 0.6, 0.9):
        want = {(a, b) for a in full for b in full if a < b and set(np.flatnonzero(full[a])) & set(np.flatnonzero(full[b])) and round(float(full[a] @ full[b]), 6) >= t}
        assert {(r["a"], r["b"]) for r in consolidate.near_pairs(df, t).collect()} == want


def test_cassette(spark):
    tape = spark.createDataFrame([("c", store.cassette_key("c", "hi"), "hello")], "kind string, key string, value string")
    rows = spark.createDataFrame([("hi",), ("new",)], "text string")
    assert store.replay_cassette(rows, tape, "c", "text", strict=False).where("completion IS NULL").count() == 1
    with pytest.raises(PySparkException):
        store.replay_cassette(rows, tape, "c", "text").collect()
    longer = store.record_cassette(rows, tape, "c", "text", lambda texts: [t.upper() for t in texts])
    assert {r["completion"] for r in store.replay_cassette(rows, longer, "c", "text").collect()} == {"hello", "NEW"}


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("n", i, f"s{rng.integers(4)}", "p", f"o{rng.integers(3)}", float(i - 5 * (rng.random() < 0.3)), float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, FACTS)
    for k in range(3):
        df.where(f"floor(id / 30) = {k}").coalesce(1).write.parquet(f"{root(tmp_path)}/in/{k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root(tmp_path)}/in/*")
    q = ingest.label_assertions(source).writeStream.format("parquet").option("checkpointLocation", f"{root(tmp_path)}/c").trigger(availableNow=True).start(f"{root(tmp_path)}/out")
    q.awaitTermination()
    cols = ["id", "label", "open_id", "open_from"]
    got = sorted(map(tuple, spark.read.parquet(f"{root(tmp_path)}/out").select(cols).collect()))
    assert got == sorted(map(tuple, temporal.label_assertions(df).select(cols).collect()))
    g = df.select("namespace", "id", F.col("created_at").alias("ts"), ((F.col("id") * 37 % 100) / 100).alias("novelty"), F.lit(False).alias("contradiction"))
    for k in range(3):
        g.where(f"floor(id / 30) = {k}").coalesce(1).write.parquet(f"{root(tmp_path)}/gin/{k}")
    source = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(f"{root(tmp_path)}/gin/*")
    ingest.gate_stream(source).writeStream.format("parquet").option("checkpointLocation", f"{root(tmp_path)}/gc").trigger(availableNow=True).start(f"{root(tmp_path)}/gout").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{root(tmp_path)}/gout").select("id", "decision").collect()))
    assert got == sorted(map(tuple, gate.adaptive_gate(g).select("id", "decision").collect()))


def observed(spark, rows):
    df = spark.createDataFrame(rows, "namespace string, id long, ts double, text string, fact struct<subject: string, predicate: string, object: string, valid_from: double>")
    return df.select("namespace", F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.col("id").alias("seq"), "id", "ts", F.lit("user").alias("actor"), F.lit(None).cast("string").alias("speaker"), "text", "fact")


def test_store_end_to_end(spark, tmp_path):
    m = MemoryStore(spark, root(tmp_path))
    m.write(observed(spark, [("n", 1, 10.0, "Erin moved to Berlin.", None), ("n", 2, 20.0, "Bob reports to Erin.", None), ("o", 3, 20.0, "Erin lives in Rome.", None)]))
    receipts = m.write(observed(spark, [("n", 4, 30.0, "note", ("Erin", "city", "Vienna", None)), ("n", 5, 40.0, "Erin moved to Berlin.", None)]))
    assert {r["id"]: r["decision"] for r in receipts.collect()} == {4: "stored", 5: "reinforced"}
    assert m.answer("n", "erin", "city") == "Vienna"
    assert m.answer("n", "erin", "city", 15.0) == "Berlin"
    assert m.answer("o", "erin", "city") == "Rome"
    lines = m.memories("n", "What city does Bob's manager live in?", 50.0)
    assert lines[0] == "[1] bob manager city is Vienna."
    before = sorted(map(tuple, m.facts().collect()), key=str)
    m.save()
    again = MemoryStore(spark, root(tmp_path))
    assert sorted(map(tuple, again.facts().collect()), key=str) == before
    assert again.journal.read().count() == 0
    again.forget(spark.createDataFrame([("n", "Erin")], "namespace string, subject string"))
    assert again.answer("n", "erin", "city") is None and again.answer("o", "erin", "city") == "Rome"
    again.drop("o")
    assert again.answer("o", "erin", "city") is None
    assert again.stats().count() <= 1


@pytest.mark.parametrize("stop", ["put", "drop"])
def test_a_stop_while_replacing_leaves_a_whole_state(spark, tmp_path, monkeypatch, stop):
    """Whatever step a writer stops at, the state before or the new one is read, whole."""
    f = store.Folder(spark, root(tmp_path))
    for text in ("one", "two"):
        f.replace("m", text)

    def fail(*a):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(f, stop, fail)
        with pytest.raises(OSError):
            f.replace("m", "three")
    assert f.read("m") == ("two" if stop == "put" else "three")
    f.replace("m", "four")
    assert f.read("m") == "four" and len(f._states("m")) <= 3


def test_a_stop_between_snapshot_and_journal_doubles_nothing(spark, tmp_path, monkeypatch):
    m = MemoryStore(spark, root(tmp_path))
    for i in range(3):
        m.write(observed(spark, [("n", i, float(i), f"text {i}", None)]))

    def fail(*a):
        raise OSError("stopped")

    with monkeypatch.context() as c:
        c.setattr(m.journal, "compact", fail)
        with pytest.raises(OSError):
            m.save()
    again = MemoryStore(spark, root(tmp_path))
    assert sorted(r["id"] for r in again.log().collect()) == [0, 1, 2]
    again.write(observed(spark, [("n", 3, 3.0, "text 3", None)]))
    again.save()
    assert sorted(r["id"] for r in MemoryStore(spark, root(tmp_path)).log().collect()) == [0, 1, 2, 3] and again.journal.committed() == []


def test_two_writers_share_a_journal(spark, tmp_path):
    """Batches of writers that know nothing of each other all stay, under numbers of their own; an unfinished one is not read."""
    from concurrent.futures import ThreadPoolExecutor

    a, b = (store.Journal(spark, root(tmp_path), "id long") for _ in "ab")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: (a if k % 2 else b).append(spark.range(k, k + 1)), range(8)))
    assert len(a.committed()) == 8 and sorted(r["id"] for r in a.read().collect()) == list(range(8))
    spark.range(99, 100).write.parquet(f"{root(tmp_path)}/batch=50/writer=unfinished")
    assert len(b.read().collect()) == 8
    first = b.committed()[0]
    assert sorted(r["id"] for r in b.read(skip=[first]).collect()) != list(range(8)) and b.read(skip=b.committed()).count() == 0
    a.compact([first])
    assert first not in b.committed() and len(b.committed()) == 7
    a.compact()
    assert a.committed() == [] and a.append(spark.range(1)) == 0 and b.read().count() == 1


def test_refused_batch_leaves_no_trace(spark, tmp_path):
    m = MemoryStore(spark, root(tmp_path))
    with pytest.raises(PySparkException):
        m.write(observed(spark, [("n", 1, 1.0, "fine", None), ("n", 2, float("nan"), "bad", None)]))
    assert m.log().count() == 0


def test_filtered_lists_and_kept_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    r = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = r.where("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    s = store.SnapshotStore(spark, root(tmp_path))
    index, c = vector.open_index(s, r, 6)
    again, c2 = vector.open_index(s, r, 6)
    assert np.allclose(c, c2) and sorted(map(tuple, again.select("id", "list").collect())) == sorted(map(tuple, index.select("id", "list").collect()))
    few = r.where("vec_id % 50 = 7").select(F.col("vec_id").alias("id"))
    got = vector.ivf_search_filtered(index, c, q, few, 4)
    assert got.groupBy("query_id").count().where("count = 4").count() == 5 and got.select("id").distinct().join(few, "id", "left_anti").count() == 0
    with pytest.warns(UserWarning, match="made anew"):
        vector.open_index(s, r.where("vec_id < 200"), 6)


def test_json_rows(spark):
    df = spark.createDataFrame([(1, float("inf"), "x"), (2, 0.5, None), (3, float("nan"), "")], "a long, b double, c string")
    import json

    got = {r["a"]: r for r in (json.loads(x["json"]) for x in store.json_rows(df).collect())}
    assert got[1]["b__special"] == {"__f__": "inf"} and got[2]["b"] == 0.5 and got[3]["b__special"] == {"__f__": "nan"}


def test_service(spark, tmp_path):
    from tidemark.service import MemoryService

    tools = MemoryService(MemoryStore(spark, root(tmp_path)), clock=lambda: 100.0).tools()
    assert tools["write"]("Erin lives in Oslo.")["decision"] == "stored"
    tools["write"]("note", namespace="b", fact={"subject": "Erin", "predicate": "city", "object": "Rome"})
    assert tools["answer"]("erin", "city") == {"object": "Oslo"} and tools["answer"]("erin", "city", namespace="b") == {"object": "Rome"}
    assert tools["namespaces"]() == ["b", "default"]
    tools["drop"]("b")
    assert tools["namespaces"]() == ["default"] and tools["query"]("What city does erin live in?")["context"][0] == "[1] Erin's current city is Oslo."
