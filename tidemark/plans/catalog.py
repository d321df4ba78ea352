"""The registered queries of the store's operators, and their SQL.

QUERIES run the operators over the driver's tables (see plans/fixtures.py for how those become a store's inputs). ORACLE_SQL
says the same in DuckDB's SQL, written for plainness and not from the operators' plans.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.vectors import hash_embed
from tidemark.operators import consolidate, extract, gate, metrics, resolve, retrieve, temporal, vector
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog_sql import ORACLE_SQL as ORACLE_SQL
from tidemark.sources import observations, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(f: Query) -> Query:
    """Under the function's name; a last underscore keeps names of imported functions free."""
    QUERIES[f.__name__.rstrip("_")] = f
    return f


# Bi-temporal facts


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.assert_monotone(fx.events(spark, sf))


@register
def bitemporal_facts(spark, sf):
    return _versions(spark, sf)


@register
def open_facts(spark, sf):
    return temporal.open_facts(_versions(spark, sf)).select("namespace", "id", "object")


@register
def bitemporal_retro(spark, sf):
    return temporal.assert_facts(fx.late_events(spark, sf))


@register
def current_facts(spark, sf):
    return temporal.current(_versions(spark, sf)).drop("valid_to", "expired_at", "superseded_by")


@register
def as_of_lookup(spark, sf):
    """What every event's user was doing half a day after it."""
    asked = fx.events(spark, sf).select(F.col("id").alias("query_id"), "namespace", "subject", "predicate", (F.col("valid_from") + 43_200.0).alias("t"))
    found = temporal.as_of(_versions(spark, sf), asked)
    line = text.render_fact(F.col("subject"), F.col("predicate"), F.col("object"), F.col("t"))
    return found.select("query_id", "subject", "object", "valid_from", F.col("id").alias("fact_id"), line.alias("line"))


def _hop_questions(spark, sf):
    return fx.profiles(spark, sf).where("predicate = 'role'").select(F.floor(F.col("id") / 4).alias("query_id"), "namespace", F.lit(None).cast("double").alias("t"), "subject")


@register
def path_lookup(spark, sf):
    return temporal.path(fx.profiles(spark, sf), _hop_questions(spark, sf), ["manager", "city"]).select("query_id", "object")


@register
def path_chain(spark, sf):
    return temporal.path(fx.profiles(spark, sf), _hop_questions(spark, sf), ["manager", "manager", "role"])


@register
def fact_history(spark, sf):
    return temporal.history(_versions(spark, sf), "n1", "user5", "state").select("id", "object", "valid_from", "valid_to")


@register
def inverse_lookup(spark, sf):
    return temporal.subjects_where(_versions(spark, sf), "state", "purchase")


@register
def predicates_for(spark, sf):
    return temporal.predicates_for(fx.profiles(spark, sf)).select("subject", F.array_join("predicates", ",").alias("predicates"))


@register
def forget_facts(spark, sf):
    gone = fx.profiles(spark, sf).where("id % 20 = 0").select("namespace", "subject")
    return temporal.forget(fx.profiles(spark, sf), gone).select("id", "subject", "predicate", "object")


@register
def contradictions(spark, sf):
    return temporal.contradictions(fx.events(spark, sf)).select("id", "contradicts")


@register
def contradictions_retro(spark, sf):
    return temporal.contradictions(fx.late_events(spark, sf)).select("id", "contradicts")


@register
def relation_predicates(spark, sf):
    return temporal.relation_predicates(fx.profiles(spark, sf), fx.entities(spark, sf))


# Text


def _docs(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "text")


@register
def tokenize_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.array_join(text.tokenize(F.col("text")), " ")).alias("tokens_md5"), F.size(text.tokenize(F.col("text"))).alias("n"))


@register
def token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", text.count_tokens(F.col("text")).alias("tokens"))


@register
def lexical_jaccard(spark, sf):
    """Every turn against the turn before it."""
    c = fx.table(spark, sf, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(p, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("text"), F.col("before")), 6).alias("jaccard"))


@register
def normalize_keys(spark, sf):
    c = fx.table(spark, sf, "customer")
    padded = F.concat(F.lit("  Straße "), F.upper("c_name"), F.lit(" \t"))
    return c.select("c_custkey", text.normalize(padded).alias("name_key"))


@register
def stable_hash(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", text.stable_hash(F.col("c_name")).alias("h"))


@register
def hash_embed_(spark, sf):
    e = hash_embed(fx.table(spark, sf, "benchmark"), "item_id", "text")
    return e.select(F.col("id").alias("item_id"), "bucket", F.round("weight", 6).alias("weight"))


@register
def strip_honorific(spark, sf):
    titles = F.array(*map(F.lit, ("Mr. ", "mrs ", "Dr. ", "Prof ", "Mx. ", "", "Miss", "MS. ")))
    name = F.concat(F.element_at(titles, (F.col("c_custkey") % 8).cast("int") + 1), F.col("c_mktsegment"))
    return fx.table(spark, sf, "customer").select("c_custkey", text.strip_honorific(name).alias("name"))


@register
def canon_predicate(spark, sf):
    forms = F.array(*map(F.lit, ("current mailing address", "The previous Location", "latest role", "originally first", "e-mail of the office", "location")))
    attribute = F.element_at(forms, (F.col("p_partkey") % 6).cast("int") + 1)
    return fx.table(spark, sf, "part").select("p_partkey", text.canonical_predicate(attribute).alias("predicate"))


@register
def clean_objects(spark, sf):
    ends = F.array(*map(F.lit, (".", " ...", "!? ", ";: ,", "", " x.")))
    return fx.table(spark, sf, "part").select("p_partkey", text.clean_object(F.concat(F.lit("  "), F.col("p_name"), F.element_at(ends, (F.col("p_partkey") % 6).cast("int") + 1))).alias("value"))


@register
def clause_split(spark, sf):
    parts = text.clauses(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(parts).alias("clauses"), F.md5(F.array_join(parts, "|")).alias("parts_md5"))


@register
def first_person(spark, sf):
    forms = F.array(*map(F.lit, ("I am here and I've seen my home.", "I work at Acme, I love it.", "My email is x@y.com; I'm Ill.", "Iris likes I and mine.")))
    told = F.element_at(forms, (F.col("c_custkey") % 4).cast("int") + 1)
    return fx.table(spark, sf, "customer").select("c_custkey", text.first_person(told, F.lower(fx.letters(F.col("c_custkey")))).alias("told"))


@register
def event_date(spark, sf):
    return fx.dated(spark, sf).select("id", dates.event_date(F.col("text"), F.col("ref")).alias("event_ts"))


@register
def strip_dates(spark, sf):
    return fx.dated(spark, sf).select("id", dates.strip_dates(F.col("text")).alias("rest"))


@register
def render_fact(spark, sf):
    p = fx.profiles(spark, sf)
    past = F.when(F.col("id") % 3 == 0, F.lit(1.0))
    hops = F.when(F.col("id") % 5 == 0, F.array(F.lit("manager"), F.col("predicate")))
    line = text.render_fact(F.col("subject"), F.col("predicate"), F.col("object"), past, hops)
    liked = text.render_preference(F.col("subject"), F.concat(F.lit("preference:"), F.col("object")), F.element_at(F.array(F.lit("like"), F.lit("dislike"), F.lit("Thai")), (F.col("id") % 3).cast("int") + 1))
    return p.select("id", line.alias("line"), liked.alias("preference_line"))


@register
def recency_decay(spark, sf):
    e = fx.events(spark, sf)
    return e.select("id", F.round(text.recency(F.lit(1_700_000_000.0), F.col("created_at")), 6).alias("decay"))


@register
def fuzzy_entity(spark, sf):
    """Market segments, each with a letter too many."""
    c = fx.table(spark, sf, "customer")
    names = [r[0] for r in c.select(F.lower("c_mktsegment")).distinct().collect()]  # a handful at any scale
    asked = c.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("What about "), F.substring("c_mktsegment", 1, 4), F.lit("x"), F.substr("c_mktsegment", F.lit(5))).alias("question"))
    return retrieve.fuzzy_entities(asked, names)


# Extraction


@register
def extract_facts(spark, sf):
    return extract.extract(fx.sentences(spark, sf)).select("text_id", "clause_no", "subject", "predicate", "object")


@register
def preferences(spark, sf):
    return extract.extract(fx.sentences(spark, sf), preferences=True).where(F.col("predicate").startswith("preference:"))


@register
def coref_pronoun(spark, sf):
    return extract.extract_with_pronouns(fx.sentences(spark, sf)).select("text_id", "clause_no", "subject", "predicate", "object")


@register
def llm_parse_ground(spark, sf):
    s = fx.sentences(spark, sf)
    said = F.concat(F.lit("- "), fx.letters(F.col("text_id")), F.lit(" | city | the\n* "), fx.letters(F.col("text_id")), F.lit(" | Role | Acme\nNONE\nbroken | line\n"), fx.letters(F.col("text_id")), F.lit(" | role | acme"))
    return extract.parse_completions(s.select("text_id", "text", said.alias("completion")))


@register
def echo_suppress(spark, sf):
    s = fx.sentences(spark, sf).withColumn("text", F.regexp_replace("text", "N[a-j]+", "Ann"))
    return extract.suppress_echoes(s, extract.extract(s)).select("text_id")


@register
def dated_facts(spark, sf):
    d = fx.dated(spark, sf).select(F.col("id").alias("text_id"), F.col("ref").alias("ts"), F.concat(F.lit("Erin moved to Vienna. "), F.lit("Bob lives in Oslo since "), F.col("text")).alias("text"))
    facts = extract.split_clauses(d).withColumn("fact", extract.parse_clause(F.col("clause"))).where("fact IS NOT NULL").select("text_id", "ts", "clause_no", "clause", "fact.*")
    return extract.date_facts(facts).select("text_id", "clause_no", "object", "valid_from")


@register
def ellipsis_facts(spark, sf):
    """Statements of which every third one leaves its subject out."""
    s = fx.sentences(spark, sf)
    bare = F.when(F.col("text_id") % 3 == 0, F.concat(F.lit("Works at "), F.col("text_id").cast("string"))).otherwise(F.col("text"))
    return extract.extract_with_pronouns(s.withColumn("text", bare), ellipsis=True).where("object RLIKE '^[0-9]+$'").select("text_id", "subject", "object")


@register
def definite_np(spark, sf):
    """Roles of customers, each held by one or more, and statements told by role."""
    k = F.col("c_custkey")
    role = F.translate(F.floor(k / 3).cast("string"), "0123456789", "abcdefghij")
    text = F.when(k % 3 == 2, F.concat(F.lit("The "), role, F.lit(" moved to City"), fx.letters(k), F.lit("."))).otherwise(F.concat(fx.letters(k), F.lit(" is a "), F.when(k % 6 == 4, F.lit("clerk")).otherwise(role), F.lit(".")))
    t = fx.table(spark, sf, "customer").select(F.lit("n").alias("namespace"), k.alias("text_id"), k.cast("double").alias("ts"), text.alias("text"))
    return extract.extract_definite(t).where("predicate = 'city'").select("text_id", "subject", "object")


# Entities


def _names(spark, sf):
    k = F.col("c_custkey")
    given = F.element_at(F.array(*map(F.lit, ("Ann", "Bob", "Cara", "Dan", "Eve", "Finn", "Gus"))), (k % 7).cast("int") + 1)
    name = F.when(k % 3 == 0, F.concat(given, F.lit(" "), fx.letters(F.floor(k / 20)))).when(k % 3 == 1, fx.letters(F.floor(k / 10))).otherwise(F.concat(F.lit("Dr. "), given))
    return fx.table(spark, sf, "customer").select(F.concat(F.lit("n"), (k % 5).cast("string")).alias("namespace"), name.alias("name"), k.cast("double").alias("ts"), k.alias("id"))


@register
def entity_resolve(spark, sf):
    return resolve.resolve_and_register(_names(spark, sf))


def _full_and_single(spark, sf):
    s = resolve.surfaces(_names(spark, sf)).select("namespace", "surface")
    return s.where(F.contains("surface", F.lit(" "))), s.where(~F.contains("surface", F.lit(" ")) & (F.length("surface") % 2 == 0))


@register
def entity_canonical(spark, sf):
    full, single = _full_and_single(spark, sf)
    return resolve.canonical(resolve.surfaces(_names(spark, sf)).select("namespace", "surface"), full, single)


@register
def entity_vocab(spark, sf):
    return resolve.vocabulary(*_full_and_single(spark, sf))


# Vectors


def _asked_vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("vec_id").cast("double").alias("ts"))


@register
def knn_exact(spark, sf):
    return vector.knn(fx.table(spark, sf, "embeddings"), _asked_vectors(spark, sf), 10)


@register
def knn_filtered(spark, sf):
    records = fx.table(spark, sf, "embeddings").withColumns({"ts": F.col("vec_id").cast("double"), "tier": F.when(F.col("label") % 2 == 0, "episodic").otherwise("semantic"), "entities": F.array(F.concat(F.lit("E"), (F.col("label") % 3).cast("string")))})
    last = records.agg(F.max("ts")).first()[0] or 0.0
    return vector.knn(vector.visible(records, until=0.8 * last, tier="episodic", entity="e0 ", window=(0.04 * last, 0.76 * last)), _asked_vectors(spark, sf), 5)


@register
def nearest_prior(spark, sf):
    records = fx.table(spark, sf, "embeddings").withColumn("ts", F.col("vec_id").cast("double") + 1)
    return vector.knn(records, _asked_vectors(spark, sf), 1, causal=True).select("query_id", "id", "score")


def _hybrid(spark, sf, k):
    q = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return vector.hybrid(fx.turns(spark, sf).select("id", "text"), q, k)


@register
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, 8)


@register
def ann_ivf(spark, sf):
    index, centroids = vector.ivf_index(fx.table(spark, sf, "embeddings"), 16)
    asked = _asked_vectors(spark, sf)
    return vector.ivf_search(index, centroids, asked, 10, vector.ivf_probes(index, centroids, asked, 10, least=8))


@register
def reembed(spark, sf):
    def embed(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], float)

    return vector.reembed(fx.table(spark, sf, "benchmark"), embed, "counts-v1", dims=3).select("item_id", "embedding", "embed_model_id")


# Gate


@register
def adaptive_gate(spark, sf):
    g = gate.adaptive_gate(fx.stream(spark, sf))
    return g.select("namespace", "id", "decision", F.round("theta", 9).alias("theta"))


@register
def novelty(spark, sf):
    s = fx.table(spark, sf, "embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("namespace"), F.col("vec_id").alias("id"), F.col("vec_id").cast("double").alias("ts"), F.col("embedding").cast("array<double>").alias("embedding"))
    return gate.gate_vectors(s).select("namespace", "id", "decision", F.round("novelty", 6).alias("novelty"), "target")


def _decided(spark, sf):
    """Decisions by fixed thresholds, each reinforcing one told the id's hundred."""
    s = fx.stream(spark, sf)
    d = F.when(F.col("novelty") >= 0.7, "stored").when(F.col("novelty") <= 0.3, "reinforced").otherwise("discarded")
    return s.select("namespace", "id", "ts", d.alias("decision"), (F.floor(F.col("id") / 100) * 100).alias("target"))


@register
def reinforcement(spark, sf):
    return gate.reinforcement(_decided(spark, sf))


@register
def predictive_surprise(spark, sf):
    e = fx.table(spark, sf, "events")
    logs = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 5).cast("int") + 1), lambda i: F.when(i % 3 != 0, -((F.col("event_id") + i) % 7) / 4.0))
    return e.select("event_id", F.round(gate.fused_novelty(F.lit(0.2), gate.predictive_surprise(logs)), 6).alias("surprise"))


@register
def session_first_ts(spark, sf):
    return gate.session_first_ts(fx.turns(spark, sf))


# Planning and answers


@register
def plan_entity(spark, sf):
    return retrieve.plan_entities(fx.questions(spark, sf), fx.entities(spark, sf))


def _vocabulary(spark, sf):
    return fx.profiles(spark, sf).select("namespace", "predicate").distinct()


@register
def plan_predicate(spark, sf):
    return retrieve.plan_predicates(fx.questions(spark, sf), _vocabulary(spark, sf)).select("query_id", F.array_join("predicates", ",").alias("predicates"))


def _plans(spark, sf):
    q, e = fx.questions(spark, sf), fx.entities(spark, sf)
    preds = retrieve.plan_predicates(q, _vocabulary(spark, sf))
    sessions = gate.session_first_ts(fx.turns(spark, sf))
    out = q
    for part in (retrieve.plan_entities(q, e), retrieve.plan_hops(preds), retrieve.plan_as_of(q, sessions)):
        out = out.join(part.hint("merge"), "query_id", "left")
    return out.withColumn("preference", F.lit(False))


@register
def plan_hops(spark, sf):
    return _plans(spark, sf).select("query_id", "predicate", F.array_join("hops", ">").alias("hops"))


@register
def plan_as_of(spark, sf):
    return retrieve.plan_as_of(fx.questions(spark, sf), gate.session_first_ts(fx.turns(spark, sf)))


@register
def plan_preference(spark, sf):
    q = fx.questions(spark, sf).withColumn("question", F.when(F.col("query_id") % 4 == 3, F.concat(F.lit("What does "), F.regexp_extract("question", "c[0-9]+", 0), F.lit(" like?"))).otherwise(F.col("question")))
    words = _vocabulary(spark, sf).union(spark.createDataFrame([("n0", "preference:jazz")], "namespace string, predicate string"))
    return retrieve.plan_preference(q, fx.entities(spark, sf), words)


@register
def plan_chain(spark, sf):
    q = fx.questions(spark, sf).withColumn("question", F.regexp_replace("question", "manager", "manager's boss"))
    p = q.join(retrieve.plan_entities(q, fx.entities(spark, sf)).hint("merge"), "query_id").join(retrieve.plan_predicates(q, _vocabulary(spark, sf)).hint("merge"), "query_id")
    return retrieve.plan_chains(p).select("query_id", F.array_join("hops", ">").alias("hops"))


@register
def structured_fetch(spark, sf):
    return retrieve.structured_fetch(_plans(spark, sf).withColumn("as_of", F.col("as_of") * 0 + 1.0), fx.profiles(spark, sf))


@register
def backstop_facts(spark, sf):
    q = fx.questions(spark, sf).withColumn("question", F.concat("question", F.lit(" And c7, c9?")))
    return retrieve.backstop(q, fx.profiles(spark, sf), fx.entities(spark, sf))


def _pairs(spark, sf):
    """Pairs of words of benchmark texts, as if a value had been superseded."""
    toks = text.tokenize(F.col("text"))
    return fx.table(spark, sf, "benchmark").select(F.slice(toks, 1, 1).alias("subject_tokens"), F.slice(toks, 2, 2).alias("value_tokens"))


@register
def stale_filter(spark, sf):
    docs = _docs(spark, sf).withColumnRenamed("doc_id", "id")
    return retrieve.drop_stale(docs, _pairs(spark, sf)).select("id")


@register
def stale_pairs(spark, sf):
    p = retrieve.stale_pairs(_versions(spark, sf))
    return p.select(F.array_join("subject_tokens", " ").alias("subject"), F.array_join("value_tokens", " ").alias("value"))


@register
def superseded_filter(spark, sf):
    return retrieve.drop_superseded(fx.episodes(spark, sf), _versions(spark, sf)).select("id")


def _fused(spark, sf):
    found = _hybrid(spark, sf, retrieve.CANDIDATES).join(fx.turns(spark, sf).select("id", "ts", "text"), "id")
    return retrieve.fuse(found, F.lit(90_000_000.0))


@register
def fuse_rank(spark, sf):
    return _fused(spark, sf).select("query_id", "id", F.round("fused", 6).alias("fused"))


@register
def context_payload(spark, sf):
    structured = fx.table(spark, sf, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.lit(1).alias("line_no"), F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(" is known.")).alias("line"))
    fused = _fused(spark, sf).withColumn("fused", F.round("fused", 6))
    return retrieve.context(structured, fused).select("query_id", F.md5("context").alias("context_md5"), "items", "tokens")


@register
def window_query(spark, sf):
    q = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    turns = fx.turns(spark, sf)
    last = turns.agg(F.max("ts")).first()[0] or 0.0
    return vector.hybrid(vector.visible(turns, window=(0.1 * last, 0.6 * last)).select("id", "text"), q, 4)


# Consolidation and erasure


@register
def consolidate_prune(spark, sf):
    return consolidate.prune_outdated(fx.episodes(spark, sf), _versions(spark, sf)).select("id", "content")


@register
def consolidate_merge(spark, sf):
    c = consolidate.merge_same_fact(consolidate.prune_outdated(fx.episodes(spark, sf), _versions(spark, sf)))
    return c.select("namespace", "content", "support_count", "last_seen_ts", F.array_join(F.transform("supports", lambda x: x.cast("string")), ",").alias("supports"), F.array_join("entities", ",").alias("entities"))


@register
def leader_cluster(spark, sf):
    s = fx.table(spark, sf, "embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("namespace"), F.col("vec_id").cast("double").alias("ts"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return consolidate.leader_clusters(s, 0.25).select("namespace", "id", "leader")


@register
def near_dup_pairs(spark, sf):
    e = hash_embed(fx.table(spark, sf, "benchmark"), "item_id", "text")
    return consolidate.near_pairs(e.select("id", "bucket", "weight"), 0.1).select("a", "b", F.round("cosine", 6).alias("cosine"))


@register
def consolidation_report(spark, sf):
    e, v = fx.episodes(spark, sf), _versions(spark, sf)
    kept = consolidate.prune_outdated(e, v)
    return consolidate.report(e, consolidate.merge_same_fact(kept), kept, v)


@register
def forget_cascade(spark, sf):
    e = fx.episodes(spark, sf)
    gone = e.where("id % 500 = 0").select("namespace", F.col("fact_subject").alias("subject")).where("subject IS NOT NULL")
    vectors = e.select("namespace", "id", F.array(F.coalesce("fact_subject", F.lit("none"))).alias("entities"))
    left = consolidate.forget_cascade(gone, _versions(spark, sf), e, vectors, e.select("namespace", F.col("id").alias("text_id")))
    parts = [d.select(F.lit(name).alias("kind"), F.col("text_id" if name == "asserted" else "id").alias("id")) for name, d in left.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# Sources and state


def _observations(spark, sf):
    e = fx.events(spark, sf)
    k = F.col("id")
    fact = F.when(k % 5 != 0, F.struct(F.when(k % 11 == 0, F.lit(" ")).otherwise(F.col("subject")).alias("subject"), "predicate", F.col("object"), F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("valid_from")).alias("valid_from")))
    return e.select("namespace", F.concat(F.lit("s"), (k % 50).cast("string")).alias("session_id"), k.alias("seq"), "id", F.when(k % 17 == 0, F.lit(float("inf"))).otherwise(F.col("created_at")).alias("ts"), F.lit("user").alias("actor"), F.lit(None).cast("string").alias("speaker"), F.when(k % 19 != 0, F.concat("subject", F.lit(" is "), "object")).alias("text"), fact.alias("fact"))


@register
def fact_validation(spark, sf):
    return observations.validate(_observations(spark, sf)).select("id", "problem")


@register
def ingest_receipts(spark, sf):
    good = observations.validate(_observations(spark, sf)).where("problem IS NULL").drop("problem")
    flagged = temporal.contradictions(observations.assertions(good)).select("id", "contradicts")
    h = text.stable_hash(F.col("text")) % 1000 / 1000.0
    s = good.join(flagged, "id", "left").select("namespace", "id", "ts", h.alias("novelty"), F.coalesce("contradicts", F.lit(False)).alias("contradiction"))
    return gate.adaptive_gate(s).select("namespace", "id", "decision", "contradiction")


def _state_folder(spark, what: str) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex}"


@register
def snapshot_roundtrip(spark, sf):
    s = store.SnapshotStore(spark, _state_folder(spark, "snapshot"))
    s.save({"versions": _versions(spark, sf)})
    s.save({"versions": _versions(spark, sf), "profiles": fx.profiles(spark, sf)})
    return s.load()["versions"].select("namespace", "id", "object", "valid_from", "valid_to")


@register
def journal_replay(spark, sf):
    """A snapshot of the first half of the events and the rest from the journal, through the normal path."""
    e = fx.events(spark, sf)
    half = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY id)")).first()[0]
    j = store.Journal(spark, _state_folder(spark, "journal"), e.schema)
    j.append(e.where((F.col("id") > half) & (F.col("id") % 2 == 0)))
    j.append(e.where((F.col("id") > half) & (F.col("id") % 2 == 1)))
    return store.replay(e.where(F.col("id") <= half), j.read(), temporal.assert_monotone).select("namespace", "id", "object", "valid_from", "valid_to")


@register
def namespace_isolation(spark, sf):
    v = store.drop_namespace(_versions(spark, sf), "n2")
    return v.groupBy("namespace").agg(F.count("*").alias("versions"), F.count_distinct("subject").alias("subjects"))


@register
def cassette_replay(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    tape = b.select(F.lit("complete").alias("kind"), F.md5(F.concat(F.lit("complete\x1f"), F.col("text"))).alias("key"), F.concat(F.lit("answer "), F.substring("text", 1, 5)).alias("value")).distinct()
    return store.replay_cassette(b.select("item_id", "text"), tape, "complete", "text").select("item_id", "completion")


# Metrics, baselines, evaluation


@register
def store_stats(spark, sf):
    return metrics.store_stats(fx.episodes(spark, sf).select("namespace", F.when(F.col("id") % 10 == 9, "semantic").otherwise("episodic").alias("tier"), "content"), _versions(spark, sf))


@register
def write_metrics(spark, sf):
    return metrics.write_metrics(_decided(spark, sf)).withColumn("discard_rate", F.round("discard_rate", 9))


@register
def pricing(spark, sf):
    c = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(text.count_tokens(F.col("text"))).alias("t"), F.count("*").alias("n"))
    return c.select("conv_id", F.round(metrics.cost(F.col("t"), F.col("t") / 4, F.col("n"), metrics.Pricing(extract_call=0.001)), 9).alias("cost"))


@register
def growth_curve(spark, sf):
    return metrics.growth(_decided(spark, sf)).select("id", "seen", "stored_so_far", F.round("ratio", 9).alias("ratio"))


@register
def baseline_naive(spark, sf):
    return vector.knn(fx.table(spark, sf, "embeddings").withColumn("ts", F.col("vec_id").cast("double")), _asked_vectors(spark, sf).withColumn("ts", F.col("ts") + 250.0), 4, causal=True, newest=True)


@register
def baseline_long_context(spark, sf):
    return metrics.long_context(fx.turns(spark, sf), 800).select("namespace", "id", "tokens")


def _probes(spark, sf):
    """Questions about customers' cities with three candidate answers each, and the lines served to them."""
    p = fx.profiles(spark, sf).where("predicate = 'city'")
    key = F.floor(F.col("id") / 4)
    probes = p.select(key.alias("query_id"), "subject", F.lit("What city, CANADA aside?").alias("question"), F.array(F.col("object"), F.lit("CANADA"), F.lit("A")).alias("candidates"))
    lines = p.select(key.alias("query_id"), F.lit(2).alias("line_no"), F.concat("subject", F.lit("'s current city is "), "object", F.lit(".")).alias("line")).union(p.select(key, F.lit(1), F.lit("Nothing of note in CANADA.")))
    return probes, lines, p.select(key.alias("query_id"), F.col("object").alias("gold"))


@register
def reader(spark, sf):
    probes, lines, _ = _probes(spark, sf)
    return metrics.read_answers(lines, probes)


@register
def harness_scores(spark, sf):
    probes, lines, gold = _probes(spark, sf)
    r = gold.join(metrics.read_answers(lines, probes), "query_id", "left")
    k = F.col("query_id")
    rows = r.select(F.concat(F.lit("C"), (k % 6 + 1).cast("string")).alias("category"), "gold", F.when(k % 5 == 0, F.col("gold")).alias("stale"), "answer", (k % 40).alias("served_tokens"))
    return metrics.harness_scores(rows).withColumn("score", F.round("score", 9))
