"""A memory store over Spark tables: write, query, consolidate and forget, with snapshots and a journal.

Everything is a batch: writes are a DataFrame of observations, questions a DataFrame, answers too. State is a set of tables
under one root, the log of accepted observations being the source of truth from which facts, records and the gate's decisions
are derived by the operators; a snapshot keeps the log and what consolidation made of its episodes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import normalize
from tidemark.operators import consolidate, extract, gate, metrics, resolve, retrieve, temporal, vector
from tidemark.sources import observations, store

CLAIMS = (
    "namespace string, id long, ts double, content string, support_count long, last_seen_ts double, supports array<long>, "
    "entities array<string>, fact_subject string, fact_predicate string, fact_object string"
)


@dataclass(frozen=True)
class Config:
    """Settings of a store: lines of a context, candidates, similarity of free text that merges, how facts are read, and the gate's.

    reading: "plain", or what beyond it stands for a subject: "pronouns", "ellipsis" (and pronouns) or "definite" roles. embed: a
    text column's vectors, hashed token counts if it is not given. surprise: a column over the observations that raises their novelty. summarise: makes one text
    of a claim's texts, in batches, where claims are not to be told in the words of the best supported.
    """

    max_context_items: int = retrieve.MAX_ITEMS
    candidates: int = retrieve.CANDIDATES
    free_dedup_threshold: float = 0.85
    extract_facts: bool = True
    reading: str = "plain"
    preferences: bool = False
    dates: bool = False
    embed: Callable[[Column], Column] | None = None
    surprise: Column | None = None
    summarise: Callable[[list[list[str]]], list[str]] | None = None
    gate: gate.GateConfig = field(default_factory=gate.GateConfig)


class MemoryStore:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.snapshots = store.SnapshotStore(spark, f"{root.rstrip('/')}/snapshots")
        schema = spark.createDataFrame([], observations.OBSERVATION).schema
        self.journal = store.Journal(spark, f"{root.rstrip('/')}/journal", schema)
        self._derived: dict[str, DataFrame] = {}
        self.folder = store.Folder(spark, f"{root.rstrip('/')}/derived")
        self._before, self._now = uuid.uuid4().hex, uuid.uuid4().hex
        self._tables: dict[str, DataFrame] = {}
        self._version: int | None = None

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, written beside the log until that changes: what builds on it has a short plan, and a lost executor costs nothing."""
        if name not in self._derived:
            df, path = make(), f"{self.folder.root}/{self._now}/{name}"
            df.write.parquet(path)
            self._derived[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._derived[name]

    def _changed(self) -> None:
        """The log has changed. The tables before stay for one more change, as results may still be read from them."""
        self.folder.drop(self._before)
        self._derived.clear()
        self._before, self._now = self._now, uuid.uuid4().hex

    # Writing

    def write(self, rows: DataFrame, compact: bool = True) -> DataFrame:
        """Check and append observations; returns their receipts (namespace, id, decision, contradiction). One bad row refuses all."""
        self.journal.append(observations.strict(rows.select(*self.journal.schema.names)))
        self._changed()
        ids = rows.select("namespace", "id")
        receipts = self.decisions().join(ids, ["namespace", "id"], "left_semi").select("namespace", "id", "decision", "contradiction")
        if compact and self.journal.due():
            self.compact()
        return receipts

    def log(self) -> DataFrame:
        """All accepted observations, those of forgotten subjects left out."""
        return self._log()[0]

    def _snapshot(self) -> tuple[dict[str, DataFrame], list[str]]:
        """The current snapshot's tables, checked once for every version, and the journal's batches that are in it."""
        m = self.snapshots.manifest()
        if m is None:
            return {}, []
        if self._version != m["version"]:
            self._tables, self._version = self.snapshots.load(), m["version"]
        return self._tables, m["settings"].get("batches", [])

    def _log(self) -> tuple[DataFrame, list[str]]:
        """The log, and the journal's batches that it holds beside the snapshot's. Batches that the snapshot says it holds are not read twice."""
        tables, inside = self._snapshot()
        held = tables.get("log")
        batches = [b for b in self.journal.committed() if b not in inside]
        tail = self.journal.read(skip=inside).drop("batch")
        return (tail if held is None else held.unionByName(tail)), batches

    def _kept(self) -> tuple[DataFrame, DataFrame]:
        """What consolidation made: claims, and the episodes (namespace, id) that they stand for or that are outdated."""
        held, _ = self._snapshot()
        none = lambda ddl: self.spark.createDataFrame([], ddl)
        return held.get("claims", none(CLAIMS)), held.get("absorbed", none("namespace string, id long"))

    def _replace(self, change: Callable[[DataFrame], DataFrame], kept: tuple[DataFrame, DataFrame] | None = None, **more: DataFrame) -> None:
        """Make the changed log the snapshot, with the batches that are in it, and drop those from the journal; a stop anywhere loses and doubles nothing."""
        log, batches = self._log()
        inside = self._snapshot()[1]
        claims, absorbed = kept or self._kept()
        tables = {"log": change(log).dropDuplicates(["namespace", "id"]), "claims": claims, "absorbed": absorbed, **more}
        self.snapshots.save(tables, {"batches": sorted({*inside, *batches} & {*self.journal.committed()})})
        self.journal.compact([*inside, *batches])
        self._changed()

    def compact(self) -> None:
        self._replace(lambda log: log)

    def save(self) -> int:
        self.compact()
        return self.snapshots.manifest()["version"]

    # Derived state

    def assertions(self) -> DataFrame:
        """Facts that came with observations, and those read from the text of the others, echoes left out."""
        return self._once("assertions", self._assertions)

    def _assertions(self) -> DataFrame:
        log = self.log()
        given = observations.assertions(log)
        if not self.config.extract_facts:
            return given.withColumn("id", F.col("id") * extract.MAX_FACTS)
        texts = log.where("fact IS NULL").select("namespace", F.col("id").alias("text_id"), "ts", "speaker", "text")
        facts = extract.read(texts, self.config.reading, self.config.preferences, self.config.dates)
        first = extract.suppress_echoes(texts, facts).select("namespace", "text_id")
        read = facts.join(first, ["namespace", "text_id"]).select("namespace", (F.col("text_id") * extract.MAX_FACTS + F.col("clause_no")).alias("id"), "subject", "predicate", "object", "valid_from", F.col("ts").alias("created_at"))
        return given.withColumn("id", F.col("id") * extract.MAX_FACTS).unionByName(read)

    def facts(self) -> DataFrame:
        """All versions. Every fact counts, whatever the gate decides about its text."""
        return self._once("facts", lambda: temporal.assert_facts(self.assertions()))

    def decisions(self) -> DataFrame:
        """The gate's decision on every observation, by how near its text is to what was stored before it; what contradicts an open fact is stored."""
        return self._once("decisions", self._decide)

    def _embedded(self, text: Column) -> Column:
        return (self.config.embed or vector.embed_text)(text)

    def _decide(self) -> DataFrame:
        told = temporal.contradictions(self.assertions()).withColumn("text_id", F.floor(F.col("id") / extract.MAX_FACTS))
        flagged = told.groupBy("namespace", F.col("text_id").alias("id")).agg(F.min_by("contradicts", F.col("id")).alias("contradiction"))  # the first fact's
        s = self.log().withColumn("surprise", (F.lit(0.0) if self.config.surprise is None else self.config.surprise).cast("double"))
        s = s.join(flagged, ["namespace", "id"], "left").withColumn("contradiction", F.coalesce("contradiction", F.lit(False)))
        s = s.select("namespace", "id", "ts", "text", "contradiction", "surprise", self._embedded(F.col("text")).alias("embedding"))
        return gate.gate_vectors(s, self.config.gate).drop("embedding", "surprise")

    def records(self) -> DataFrame:
        """What search sees: stored texts that stand for themselves, and claims."""
        claims, absorbed = self._kept()
        own = self.decisions().where(F.col("decision") == "stored").select("namespace", "id", "ts", "text").join(absorbed, ["namespace", "id"], "left_anti")
        return own.unionByName(claims.select("namespace", "id", "ts", F.col("content").alias("text")))

    def entities(self) -> DataFrame:
        return self._once("entities", self._entities)

    def _entities(self) -> DataFrame:
        named = self.facts().select("namespace", F.col("subject").alias("name"), F.col("created_at").alias("ts"), "id")
        s = resolve.surfaces(named).select("namespace", "surface")
        return resolve.vocabulary(s.where(F.contains("surface", F.lit(" "))), s.where(~F.contains("surface", F.lit(" "))))

    def sessions(self) -> DataFrame:
        return gate.session_first_ts(self.log())

    # Reading

    def plan(self, questions: DataFrame) -> DataFrame:
        versions, entities = self.facts(), self.entities()
        words = versions.select("namespace", "predicate").distinct()
        preds = retrieve.plan_predicates(questions, words).join(questions.select("query_id", "namespace"), "query_id")
        hops = retrieve.plan_hops(preds, temporal.relation_predicates(versions, entities))
        out = questions
        for part in (retrieve.plan_entities(questions, entities), hops, retrieve.plan_as_of(questions, self.sessions()), retrieve.plan_preference(questions, entities, words)):
            out = out.join(part, "query_id", "left")
        return out

    def query(self, questions: DataFrame, now: float, window: tuple[float, float] | None = None) -> DataFrame:
        """(query_id, context, items, tokens) for questions (query_id, namespace, question); with a window of time, from records of that time only."""
        if window is not None and not (len(window) == 2 and all(math.isfinite(x) for x in window) and window[0] <= window[1]):
            raise ValueError(f"a window is two finite times in order, not {window!r}")
        versions = self.facts()
        plans = self.plan(questions)
        lines = retrieve.structured_fetch(plans, versions)
        missed = questions.join(lines.select("query_id").distinct(), "query_id", "left_anti")
        lines = lines.unionByName(retrieve.backstop(missed, versions, self.entities(), self.config.max_context_items))
        lines = lines.dropDuplicates(["query_id", "line"])
        seen = retrieve.drop_stale(vector.visible(self.records(), until=now, window=window), retrieve.stale_pairs(versions))
        asked = questions.select("query_id", "namespace", F.col("question").alias("text"))
        found = vector.hybrid(seen, asked, self.config.candidates).join(questions.select("query_id", "namespace"), "query_id").join(seen.select("namespace", "id", "ts", "text"), ["namespace", "id"])
        fused = retrieve.fuse(found, F.lit(float(now)))
        return retrieve.context(lines, fused, self.config.max_context_items)

    def answer(self, namespace: str, subject: str, predicate: str, t: float | None = None) -> str | None:
        """The value of a key, now or as of t."""
        asked = self.spark.range(1).select(F.col("id").alias("query_id"), F.lit(namespace).alias("namespace"), F.lit(subject).alias("subject"), F.lit(predicate).alias("predicate"), F.lit(t).cast("double").alias("t"))
        row = temporal.as_of(self.facts(), asked).first()
        return row["object"] if row else None

    def answer_path(self, namespace: str, subject: str, predicates: list[str], t: float | None = None) -> str | None:
        """The value at the end of a path of predicates, now or as of t."""
        asked = self.spark.range(1).select(F.col("id").alias("query_id"), F.lit(namespace).alias("namespace"), F.lit(subject).alias("subject"), F.lit(t).cast("double").alias("t"))
        row = temporal.path(self.facts(), asked, predicates).first()
        return row["object"] if row else None

    def answer_who(self, namespace: str, predicate: str, obj: str, t: float | None = None) -> list[str]:
        """Whose predicate has this value, now or as of t."""
        found = temporal.subjects_where(self.facts(), predicate, obj, t).where(F.col("namespace") == namespace)
        return sorted(r["subject"] for r in found.collect())

    def memories(self, namespace: str, question: str, now: float) -> list[str]:
        """Context lines for one question: what a retriever or a tool of an agent framework hands on."""
        q = self.spark.createDataFrame([(0, namespace, question)], "query_id long, namespace string, question string")
        row = self.query(q, now).first()
        return row["context"].split("\n") if row else []

    # Maintenance

    def consolidate(self) -> DataFrame:
        """Merge episodes of one fact and near copies of free text into claims and drop outdated ones; returns the report, per namespace.

        The log stays, so facts and their history do not change; what search sees and counts does.
        """
        versions, episodes = self.facts(), self.episodes().persist()
        old, absorbed = self._kept()
        claims, gone = consolidate.consolidated(episodes, versions, self._embedded(F.col("content")), self.config.free_dedup_threshold)
        rep = consolidate.report(episodes, claims, consolidate.prune_outdated(episodes, versions), versions)
        if self.config.summarise is not None:
            claims = self._summarised(claims, episodes)
        # Claims are named by the least episode that they stand for, so claims of claims stand for episodes again.
        flat = claims.withColumn("claim", F.monotonically_increasing_id()).persist()
        inner = old.select("namespace", F.col("id").alias("support"), F.col("supports").alias("inner"))
        parts = flat.select("claim", "namespace", F.explode("supports").alias("support")).join(inner, ["namespace", "support"], "left")
        whole = parts.select("claim", F.explode(F.coalesce("inner", F.array("support"))).alias("s")).groupBy("claim").agg(F.array_sort(F.collect_set("s")).alias("supports"))
        new = flat.drop("supports").join(whole, "claim").withColumn("id", -F.col("supports")[0] - 1)
        still = old.join(gone, ["namespace", "id"], "left_anti")
        cols = [f.name for f in old.schema]
        self._replace(lambda log: log, (still.select(cols).unionByName(new.select(cols)), absorbed.unionByName(gone.where("id >= 0")).distinct()), report=rep)
        for df in (episodes, flat):
            df.unpersist()
        return self._snapshot()[0]["report"]

    def _summarised(self, claims: DataFrame, episodes: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.functions import ArrowUDFType

        model = self.config.summarise

        def run(parts):
            for p in parts:
                yield pa.array(model(p.to_pylist()), pa.string())

        texts = claims.select("namespace", "content", F.explode("supports").alias("id")).join(episodes.select("namespace", "id", F.col("content").alias("t")), ["namespace", "id"])
        told = texts.groupBy("namespace", "content").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]).alias("all"))
        made = told.select("content", F.arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(F.col("all")).alias("completion")).dropDuplicates(["content"])
        return consolidate.summarise(claims, made)

    def episodes(self) -> DataFrame:
        """Stored texts with the first fact that each states and how often it was told, and the claims that stand for merged ones."""
        claims, absorbed = self._kept()
        support = gate.reinforcement(self.decisions())
        first = self.assertions().groupBy("namespace", F.floor(F.col("id") / extract.MAX_FACTS).alias("id")).agg(F.min_by(F.struct("subject", "predicate", "object"), "id").alias("f"))
        stored = self.decisions().where(F.col("decision") == "stored").join(absorbed, ["namespace", "id"], "left_anti")
        own = stored.join(first, ["namespace", "id"], "left").join(support, ["namespace", "id"])
        own = own.select("namespace", "id", "ts", F.col("text").alias("content"), F.lit("episodic").alias("tier"), "support_count", "last_seen_ts", F.col("f.subject").alias("fact_subject"), F.col("f.predicate").alias("fact_predicate"), F.col("f.object").alias("fact_object"))
        told = claims.select("namespace", F.col("id").alias("claim"), F.explode("supports").alias("id")).join(support, ["namespace", "id"]).groupBy("namespace", F.col("claim").alias("id")).agg(F.sum("support_count").alias("support_count"), F.max("last_seen_ts").alias("last_seen_ts"))
        merged = claims.drop("support_count", "last_seen_ts").join(told, ["namespace", "id"]).withColumn("tier", F.lit("semantic"))
        return own.unionByName(merged.select(*own.columns))

    def forget(self, subjects: DataFrame) -> None:
        """Erase subjects (namespace, subject): every observation that asserts a fact of or about them leaves the log."""
        gone = subjects.select("namespace", normalize(F.col("subject")).alias("k")).distinct()
        log = self.log()
        told = observations.assertions(log).select("namespace", "id", "subject", "object")
        if self.config.extract_facts:  # echoes too, or one would take the place of what it repeats
            texts = log.where("fact IS NULL").select("namespace", F.col("id").alias("text_id"), "ts", "speaker", "text")
            read = extract.read(texts, self.config.reading, self.config.preferences, self.config.dates)
            told = told.unionByName(read.select("namespace", F.col("text_id").alias("id"), "subject", "object"))
        a = told.select("namespace", "id", F.explode(F.array(normalize(F.col("subject")), normalize(F.col("object")))).alias("k"))
        doomed = a.join(gone, ["namespace", "k"], "left_semi").select("namespace", "id").distinct()
        claims, absorbed = self._kept()
        about = claims.select("namespace", "id", F.explode(F.array(normalize(F.col("fact_subject")), normalize(F.col("fact_object")))).alias("k")).join(gone, ["namespace", "k"], "left_semi")
        kept = claims.join(about.select("namespace", "id").distinct(), ["namespace", "id"], "left_anti").select(*claims.columns), absorbed
        self._replace(lambda log: log.join(doomed, ["namespace", "id"], "left_anti"), kept)

    def drop(self, namespace: str) -> None:
        """Everything of a tenant goes."""
        claims, absorbed = self._kept()
        self._replace(lambda log: store.drop_namespace(log, namespace), (store.drop_namespace(claims, namespace), store.drop_namespace(absorbed, namespace)))

    def metrics(self, served: DataFrame | None = None) -> DataFrame:
        """Writes by decision, sizes and, given the contexts served (namespace, tokens), what they cost."""
        return metrics.operations(self.decisions(), self.records(), self.facts(), served)

    def stats(self) -> DataFrame:
        return metrics.store_stats(self.episodes(), self.facts())
