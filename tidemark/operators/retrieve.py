"""Planning and answering batches of questions over facts and records: every step is a table keyed by query_id.

Questions, facts and entities all grow, so they meet by merge joins and none is sent to every task (operators/joins.py).
"""

from __future__ import annotations

import difflib
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import recency, render_fact, render_preference, tokenize, words
from tidemark.operators import temporal
from tidemark.operators.joins import meet

# Words of questions that name predicates, ask for preferences or for a past state, and the fusion weights.
KEYWORDS = {
    "email": ["email", "e-mail"],
    "city": ["city", "live", "lives", "living", "located", "location", "reside", "moved"],
    "role": ["role", "job", "position", "works", "promoted", "title"],
    "project": ["project"],
    "manager": ["manager", "manages", "manage", "reports", "boss"],
}
RELATIONS = ("manager",)
PREFERENCE_WORDS = (
    "like likes liked love loves enjoy enjoys prefer prefers preferred preference "
    "favorite favourite favor favors hate hates dislike dislikes"
).split()
SESSION = r"session\s+(\d+)"
AS_OF = r"as[-\s]of|believ|back then|at the time"
W_REL, W_REC, W_IMP, IMPORTANCE = 1.0, 0.5, 0.3, 0.5
MAX_ITEMS, CANDIDATES = 4, 8


def plan_entities(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity): the first known entity (namespace, entity), in order, that is a word of the question."""
    said = questions.select("query_id", "namespace", F.explode(F.array_distinct(tokenize(F.col("question"), drop_stop=False))).alias("entity"))
    return meet(said, entities, ["namespace", "entity"]).groupBy("query_id").agg(F.min("entity").alias("entity"))


def plan_predicates(questions: DataFrame, predicates: DataFrame) -> DataFrame:
    """(query_id, predicates): stored predicates (namespace, predicate) whose content words are all in the question, in order,
    then those that a keyword stands for. The stored vocabulary meets questions by its first content word, then by all."""
    toks = F.array_distinct(tokenize(F.col("question"), drop_stop=False))
    stored = predicates.select("namespace", "predicate", F.array_distinct(tokenize(F.col("predicate"))).alias("need")).where(F.size("need") > 0).withColumn("pivot", F.col("need")[0])
    near = meet(questions.select("query_id", "namespace", F.explode(toks).alias("pivot")), stored, ["namespace", "pivot"])
    near = near.groupBy("query_id").agg(F.collect_list(F.struct("predicate", "need")).alias("near"))
    asked = questions.select("query_id", "question").join(near.hint("merge"), "query_id", "left").select("query_id", "near", toks.alias("toks"))
    held = F.filter(F.coalesce("near", F.array().cast("array<struct<predicate:string,need:array<string>>>")), lambda p: F.size(F.array_except(p["need"], F.col("toks"))) == 0)
    by_word = F.array(*(F.when(F.arrays_overlap("toks", words(*kws)), F.lit(p)) for p, kws in KEYWORDS.items()))
    out = asked.withColumn("stored", F.array_sort(F.array_distinct(F.transform(held, lambda p: p["predicate"]))))
    return out.select("query_id", F.concat("stored", F.array_except(F.array_compact(by_word), "stored")).alias("predicates"))


def plan_hops(predicates: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(query_id, predicate, hops) of (query_id, predicates), with relations also namespace: a relation and an attribute make a path of two."""
    known = predicates.withColumn("rels", words(*RELATIONS))
    if relations is not None:
        held = relations.groupBy("namespace").agg(F.collect_set("predicate").alias("more"))
        known = known.join(held, "namespace", "left").withColumn("rels", F.array_union("rels", F.coalesce("more", F.array().cast("array<string>"))))
    rel, attr = F.filter("predicates", lambda p: F.array_contains("rels", p)), F.filter("predicates", lambda p: ~F.array_contains("rels", p))
    x = known.select("query_id", F.try_element_at(rel, F.lit(1)).alias("rel"), F.try_element_at(attr, F.lit(1)).alias("attr"))
    return x.select("query_id", F.coalesce("attr", "rel").alias("predicate"), F.when(F.col("rel").isNotNull() & F.col("attr").isNotNull(), F.array("rel", "attr")).alias("hops"))


def plan_as_of(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """(query_id, as_of): the named session's first time, for questions about a past state; null otherwise or if unknown."""
    q = F.lower("question")
    no = F.when(q.rlike(AS_OF) & q.rlike(SESSION), F.regexp_extract(q, SESSION, 1).cast("int"))
    asked = questions.select("query_id", "namespace", no.alias("session_no"))
    return asked.join(sessions.withColumnRenamed("ts", "as_of"), ["namespace", "session_no"], "left").select("query_id", "as_of")


def plan_preference(questions: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """(query_id, preference): whether the question asks what a known entity likes, and preferences are stored."""
    stored = predicates.where(F.col("predicate").startswith("preference:")).select("namespace").distinct()
    asks = F.arrays_overlap(tokenize(F.col("question"), drop_stop=False), words(*PREFERENCE_WORDS))
    known = plan_entities(questions.where(asks), entities.join(stored, "namespace", "left_semi"))
    x = questions.select("query_id").join(known.hint("merge"), "query_id", "left")
    return x.select("query_id", F.col("entity").isNotNull().alias("preference"))


def plan_chains(planned: DataFrame, relations: Collection[str] = RELATIONS) -> DataFrame:
    """(query_id, hops) for rows (query_id, question, entity, predicates): paths of two relations or more, of any depth.

    The words behind the entity ("x's manager's city") each mean a predicate: the first planned one that has the word, else the
    first that it is a keyword of. The path is those words' predicates up to the first attribute, or to a word that means
    none; where only relations are named, the question's first attribute ends it.
    """
    rels = words(*relations)
    toks = tokenize(F.col("question"), drop_stop=False)
    behind = F.filter(F.when(F.array_position(toks, F.col("entity")) > 0, F.slice(toks, F.array_position(toks, F.col("entity")).cast("int") + 1, F.size(toks))), lambda w: w != "s")
    by_name = F.flatten(F.transform("predicates", lambda p: F.transform(tokenize(p), lambda w: F.struct(w.alias("w"), p.alias("p")))))
    every = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for p, kws in KEYWORDS.items() for w in kws))
    by_keyword = F.flatten(F.transform("predicates", lambda p: F.filter(every, lambda e: e["p"] == p)))
    x = planned.select("query_id", "predicates", behind.alias("behind"), F.concat(by_name, by_keyword).alias("means"))
    x = x.withColumn("named", F.transform("behind", lambda w: F.try_element_at(F.filter("means", lambda e: e["w"] == w), F.lit(1))["p"]))
    stop = F.array_position(F.transform("named", lambda p: p.isNull() | ~F.array_contains(rels, p)), True)  # 0: none
    until = F.when(stop == 0, F.size("named")).when(F.element_at("named", F.greatest(stop, F.lit(1)).cast("int")).isNull(), stop - 1).otherwise(stop)
    run = F.when(F.size("named") > 0, F.slice("named", 1, until.cast("int")))
    x = x.withColumn("run", run)
    inner, attr = F.filter("run", lambda p: F.array_contains(rels, p)), F.try_element_at(F.filter("predicates", lambda p: ~F.array_contains(rels, p)), F.lit(1))
    whole = F.when(F.size(inner) < F.size("run"), F.col("run")).when(attr.isNotNull(), F.concat(inner, F.array(attr)))
    return x.select("query_id", F.when(F.size(inner) >= 2, whole).alias("hops"))


def fuzzy_entities(questions: DataFrame, entities: Sequence[str], cutoff: float = 0.8) -> DataFrame:
    """(query_id, entity): the one known entity that the question's longer words are close to; null if none or several are.

    Closeness is difflib's ratio, which no built-in function has: it is worked out once for every distinct word of all questions,
    in Arrow batches, and the questions meet their words by a join. entities must be a bounded list.
    """
    from pyspark.sql.pandas.functions import ArrowUDFType

    known = sorted(entities)

    def close(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            yield pa.array([difflib.get_close_matches(w, known, n=2, cutoff=cutoff) for w in p.to_pylist()], pa.list_(pa.string()))

    said = questions.select("query_id", F.explode(F.array_distinct(tokenize(F.col("question")))).alias("word")).where(F.length("word") >= 3)
    near = said.select("word").distinct().select("word", F.arrow_udf(close, "array<string>", ArrowUDFType.SCALAR_ITER)(F.col("word")).alias("near")).where(F.size("near") > 0)
    found = said.join(near, "word").groupBy("query_id").agg(F.max(F.size("near")).alias("most"), F.count_distinct(F.col("near")[0]).alias("n"), F.min(F.col("near")[0]).alias("entity"))
    only = found.where((F.col("most") == 1) & (F.col("n") == 1)).select("query_id", "entity")
    return questions.select("query_id").join(only, "query_id", "left")


def structured_fetch(plans: DataFrame, versions: DataFrame) -> DataFrame:
    """(query_id, line_no, line, fact_id) for plans (query_id, namespace, entity, predicate, hops, as_of, preference).

    Preferences of the entity, else the end of the path with every hop cited, else the one fact, which is a path of one. All are
    answered by one chain of joins, whatever predicates they follow.
    """
    asked = plans.where(F.col("entity").isNotNull())
    likes = asked.where("preference").select("query_id", F.col("namespace").alias("ns"), F.col("entity").alias("e"))
    stored = temporal.keyed(temporal.open_facts(versions)).where(F.col("predicate").startswith("preference:"))
    pref = likes.join(stored.hint("merge"), (F.col("ns") == F.col("namespace")) & (F.col("e") == F.col("s_key")))
    pref = pref.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("predicate", "id")).alias("line_no"), render_preference(F.col("subject"), F.col("predicate"), F.col("object")).alias("line"), F.col("id").alias("fact_id"))
    rest = asked.where(~F.coalesce("preference", F.lit(False)) & F.col("predicate").isNotNull())
    rest = rest.select("query_id", "namespace", F.col("entity").alias("subject"), F.col("as_of").alias("t"), F.coalesce("hops", F.array("predicate")).alias("hops"), F.col("hops").isNull().alias("single"))
    ends = temporal.follow(versions, rest)
    one = render_fact(F.col("at.subject"), F.col("at.predicate"), F.col("at.object"), F.col("t"))
    line = F.when(F.col("single"), one).otherwise(render_fact(F.col("subject"), F.element_at("hops", -1), F.col("at.object"), F.col("t"), F.col("hops")))
    lines = ends.where(F.size("chain") > 0).select("query_id", line.alias("line"), F.posexplode("chain").alias("pos", "fact_id"))
    return pref.unionByName(lines.select("query_id", (F.col("pos") + 1).alias("line_no"), "line", "fact_id"))


def backstop(questions: DataFrame, versions: DataFrame, entities: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """(query_id, line_no, line, fact_id): facts of every entity that a question names, a predicate of each in turn, up to half of the lines."""
    half = (most + 1) // 2
    said = questions.select("query_id", "namespace", F.explode(F.array_distinct(tokenize(F.col("question"), drop_stop=False))).alias("entity"))
    facts = temporal.keyed(temporal.open_facts(versions)).select("namespace", F.col("s_key").alias("entity"), "subject", "predicate", "object", "id")
    turn = F.row_number().over(W.partitionBy("namespace", "entity").orderBy("predicate", "id"))
    first = facts.join(entities.hint("merge"), ["namespace", "entity"], "left_semi").withColumn("turn", turn).where(F.col("turn") <= half)  # no line has a later turn
    held = meet(said, first, ["namespace", "entity"])
    line = F.row_number().over(W.partitionBy("query_id").orderBy("turn", "entity", "id"))
    rows = held.withColumn("line_no", line).where(F.col("line_no") <= half)
    return rows.select("query_id", "line_no", render_fact(F.col("subject"), F.col("predicate"), F.col("object"), F.lit(None)).alias("line"), F.col("id").alias("fact_id"))


def stale_pairs(versions: DataFrame) -> DataFrame:
    """(subject_tokens, value_tokens): superseded values that are not current again, as distinct token sets."""
    k = temporal.keyed(versions)
    now = temporal.open_facts(k).select("namespace", "s_key", "p_key", F.col("o_key").alias("now_o")).distinct()
    gone = k.where(~temporal.is_open()).select("namespace", "s_key", "p_key", "subject", "object", "o_key")
    left = gone.join(now.withColumnRenamed("now_o", "o_key"), ["namespace", "s_key", "p_key", "o_key"], "left_anti")
    toks = lambda c: F.array_sort(F.array_distinct(tokenize(F.col(c))))
    return left.select(toks("subject").alias("subject_tokens"), toks("object").alias("value_tokens")).where((F.size("subject_tokens") > 0) & (F.size("value_tokens") > 0)).distinct()


def drop_stale(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """records (id, text) whose words do not hold both sides of a stale pair.

    Pairs meet records by the one of their words that fewest records hold, so there is no nested loop and no common word is a key;
    a pair with a word that none holds meets nobody. Only ids and words move.
    """
    toks = records.select("id", F.array_distinct(tokenize(F.col("text"))).alias("toks"))
    said = toks.select("id", F.explode("toks").alias("word"))
    need = pairs.select(F.array_sort(F.array_distinct(F.concat("subject_tokens", "value_tokens"))).alias("need")).distinct()
    wanted = need.select("need", F.explode("need").alias("word"))
    heard = said.join(wanted.select("word").distinct(), "word", "left_semi")
    held = heard.groupBy("word").agg(F.count("*").alias("held"))
    keyed = wanted.join(held, "word", "left").groupBy("need").agg(F.min_by("word", F.struct(F.coalesce("held", F.lit(0)), "word")).alias("word"))
    near = heard.join(keyed, "word").select("id", "need", F.explode("need").alias("word")).join(heard, ["id", "word"])
    hits = near.groupBy("id", "need").agg(F.count("*").alias("n")).where(F.col("n") == F.size("need"))
    return records.join(hits.select("id").distinct(), "id", "left_anti")


def drop_superseded(records: DataFrame, versions: DataFrame) -> DataFrame:
    """records (namespace, id, fact_subject, fact_predicate, fact_object) without those whose asserted value is no longer current."""
    k = temporal.keyed(versions)
    now = temporal.open_facts(k).select("namespace", F.col("s_key").alias("ks"), F.col("p_key").alias("kp"), F.col("o_key").alias("ko")).distinct()
    past = k.select("namespace", F.col("s_key").alias("ks"), F.col("p_key").alias("kp"), F.col("o_key").alias("ko")).distinct().join(now, ["namespace", "ks", "kp", "ko"], "left_anti")
    from tidemark.functions.text import normalize

    linked = records.select("id", "namespace", *(normalize(F.col(f"fact_{c}")).alias(k) for c, k in (("subject", "ks"), ("predicate", "kp"), ("object", "ko"))))
    return records.join(linked.join(past, ["namespace", "ks", "kp", "ko"]).select("id").distinct(), "id", "left_anti")


def fuse(candidates: DataFrame, now: Column, half_life: float = 30 * 86_400.0) -> DataFrame:
    """candidates (query_id, id, score, ts) with fused: relevance, recency and the constant importance, as a weighted sum."""
    return candidates.withColumn("fused", W_REL * F.col("score") + W_REC * recency(now, F.col("ts"), half_life) + W_IMP * IMPORTANCE)


def context(structured: DataFrame, fused: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """(query_id, context, items, tokens): numbered lines, structured ones first, then records by fused score, up to `most`."""
    lines = structured.select("query_id", F.lit(0).alias("tier"), F.col("line_no").cast("double").alias("pos"), F.lit(0).cast("long").alias("tie"), "line")
    lines = lines.unionByName(fused.select("query_id", F.lit(1).alias("tier"), (-F.col("fused")).alias("pos"), F.col("id").cast("long").alias("tie"), F.col("text").alias("line")))
    lines = lines.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("tier", "pos", "tie"))).where(F.col("n") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["line"])), "\n")
    from tidemark.functions.text import count_tokens

    out = lines.groupBy("query_id").agg(text.alias("context"), F.count("*").alias("items"))
    return out.withColumn("tokens", count_tokens(F.col("context")))
