"""Facts from text by patterns: (text_id, clause, subject, predicate, object), no model and no Python in the main path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.dates import event_date, strip_dates
from tidemark.functions.text import canonical_predicate, clauses, clean_object, first_person, normalize, tokenize
from tidemark.operators.ordered import fold

MAX_FACTS = 8

# The statement forms that are read, their predicates, preference verbs, and words that are no names.
NAME = r"\b([A-Z][a-zA-Z]*)"
POSSESSIVE = NAME + r"'s\s+(.+?)\s+(?:is|was|are|were|will be)\s+(.+)"
VERBS = (
    (NAME + r"\s+(?:ha[sd]\s+|have\s+)?(?:moved|relocated)\s+to\s+(.+)", "city"),
    (NAME + r"\s+(?:lives|resides)\s+in\s+(.+)", "city"),
    (NAME + r"\s+is\s+(?:based|located)\s+in\s+(.+)", "city"),
    (NAME + r"\s+is\s+headquartered\s+in\s+(.+)", "headquarters"),
    (NAME + r"\s+(?:is\s+work(?:ing)?|work(?:s|ed)?)\s+on\s+(?:the\s+)?project\s+(.+)", "project"),
    (NAME + r"\s+(?:works|worked)\s+(?:at|for)\s+(.+)", "employer"),
    (NAME + r"\s+(?:works|worked)\s+as\s+(?:an?\s+)?(.+)", "role"),
    (NAME + r"\s+was\s+promoted\s+to\s+(?:an?\s+)?(.+)", "role"),
    (NAME + r"\s+reports\s+to\s+(.+)", "manager"),
    (NAME + r"\s+is\s+an?\s+(.+)", "role"),
)
LIKES, DISLIKES = ("enjoys", "favors", "likes", "loves", "prefers"), ("dislikes", "hates")
BAD_SUBJECTS = (
    "i a an the it we they he she you there this that these those someone anyone everyone nobody"
).split()
LEAD, PRONOUNS = r"\s*(?:[A-Za-z][^,]*,\s+)?", "their|his|her|its"
PRONOUN = rf"(?i)^({LEAD})(?:{PRONOUNS})\s+(.*)$"
ELLIPSIS = r"(?i)^\s*(?:moved|relocated|lives|resides|reports|works|was\s+promoted|has\s+(?:moved|relocated))\b"
DEFINITE = r"^\s*[Tt]he\s+([a-z]+)('s\b|\s)"


def _fact(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.struct(subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"))


def _named(subject: Column) -> Column:
    return (subject != "") & ~F.lower(subject).isin(BAD_SUBJECTS)


def _favorite(attribute: Column) -> Column:
    toks = tokenize(attribute)
    topic = F.array_join(F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))), " ")
    return F.when(F.element_at(toks, 1).isin("favorite", "favourite") & (topic != ""), topic)


def parse_clause(clause: Column, preferences: bool = False) -> Column:
    """The fact that a clause states, as a struct, or null. The possessive form is tried first, then the verbs in order."""
    subject, attribute, obj = (F.regexp_extract(clause, POSSESSIVE, k) for k in (1, 2, 3))
    obj = clean_object(obj)
    out = []
    if preferences:
        topic = F.when(F.size(tokenize(attribute)) > 0, _favorite(attribute))
        out.append(F.when(_named(subject) & topic.isNotNull() & (obj != ""), _fact(subject, F.concat(F.lit("preference:"), topic), obj)))
    predicate = canonical_predicate(attribute)
    out.append(F.when(_named(subject) & (predicate != "") & (obj != ""), _fact(subject, predicate, obj)))
    if preferences:
        form = NAME + rf"\s+({'|'.join(sorted(LIKES + DISLIKES))})\s+(.+)"
        who, verb, what = F.regexp_extract(clause, form, 1), F.regexp_extract(clause, form, 2), clean_object(F.regexp_extract(clause, form, 3))
        toks = tokenize(what)
        plain = ~what.rlike(r"\bto\b|\bover\b|\brather than\b") & (F.size(toks) > 0)
        out.append(F.when(_named(who) & plain, _fact(who, F.concat(F.lit("preference:"), F.try_element_at(toks, F.lit(-1))), F.when(verb.isin(*DISLIKES), "dislike").otherwise("like"))))
    for pattern, name in VERBS:
        who, what = F.regexp_extract(clause, pattern, 1), clean_object(F.regexp_extract(clause, pattern, 2))
        out.append(F.when(_named(who) & (what != ""), _fact(who, F.lit(name), what)))
    return F.coalesce(*out)


def split_clauses(texts: DataFrame) -> DataFrame:
    """(all columns but text, clause_no, clause) of texts (text_id, ts, speaker, text)."""
    told = first_person(F.col("text"), F.col("speaker")) if "speaker" in texts.columns else F.col("text")
    keep = [c for c in texts.columns if c != "text"]
    return texts.select(*keep, F.posexplode(clauses(told)).alias("clause_no", "clause"))


def _bounded(facts: DataFrame) -> DataFrame:
    """A text's facts without repeats, at most MAX_FACTS, in order."""
    keys = [normalize(F.col(f"fact.{c}")) for c in ("subject", "predicate", "object")]
    first = facts.withColumn("n", F.row_number().over(W.partitionBy("text_id", *keys).orderBy("clause_no"))).where("n = 1")
    return first.withColumn("n", F.row_number().over(W.partitionBy("text_id").orderBy("clause_no"))).where(F.col("n") <= MAX_FACTS).drop("n")


def _plain(texts: DataFrame, preferences: bool = False) -> DataFrame:
    return _bounded(split_clauses(texts).withColumn("fact", parse_clause(F.col("clause"), preferences)).where("fact IS NOT NULL"))


def extract(texts: DataFrame, preferences: bool = False) -> DataFrame:
    """(text_id, clause_no, subject, predicate, object) of texts (text_id, text[, speaker]), clause by clause."""
    return _plain(texts, preferences).select("text_id", "clause_no", "fact.*")


def read(texts: DataFrame, reading: str = "plain", preferences: bool = False, dates: bool = False) -> DataFrame:
    """(namespace, text_id, ts, clause_no, subject, predicate, object, valid_from) of texts (namespace, text_id, ts, speaker, text).

    reading: "plain", "pronouns", "ellipsis" or "definite"; a text of several namespaces' ids is told apart by both. valid_from is the text's
    time or, with dates, the time that a clause states.
    """
    keyed = texts.withColumn("__id", F.col("text_id")).withColumn("text_id", F.struct("namespace", "text_id"))
    ways = {"plain": lambda: _plain(keyed, preferences), "pronouns": lambda: _resolved(keyed, False, preferences), "ellipsis": lambda: _resolved(keyed, True, preferences), "definite": lambda: _definite(keyed, preferences)}
    facts = ways[reading]().withColumn("clause", F.col("resolved") if reading in ("pronouns", "ellipsis") else F.col("clause"))
    facts = facts.select("namespace", F.col("__id").alias("text_id"), "ts", "clause_no", "clause", "fact.*")
    facts = date_facts(facts) if dates else facts.withColumn("valid_from", F.col("ts"))
    return facts.drop("clause")


def extract_with_pronouns(texts: DataFrame, ellipsis: bool = False) -> DataFrame:
    """As extract, for texts (namespace, text_id, ts, text): a leading possessive pronoun stands for the last named subject.

    The antecedent is the subject of the last clause before that states a fact, in this text or an earlier one of the
    namespace; a clause that resolves to it feeds the same name, so one pass over the order is enough. With ellipsis, clauses
    without a subject that start with a known verb take it too.
    """
    return _resolved(texts, ellipsis).select("namespace", "text_id", "clause_no", "fact.*", "resolved")


def _resolved(texts: DataFrame, ellipsis: bool, preferences: bool = False) -> DataFrame:
    rows = split_clauses(texts).withColumn("fact", parse_clause(F.col("clause"), preferences))
    order = W.partitionBy("namespace").orderBy("ts", "text_id", "clause_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last("fact.subject", ignorenulls=True).over(order))
    clause, last = F.col("clause"), F.col("last")
    lead, rest = F.regexp_extract(clause, PRONOUN, 1), F.regexp_extract(clause, PRONOUN, 2)
    new = F.when(last.isNotNull() & clause.rlike(PRONOUN), F.concat(lead, last, F.lit("'s "), rest))
    if ellipsis:
        bare = F.ltrim(clause)
        new = F.coalesce(new, F.when(last.isNotNull() & clause.rlike(ELLIPSIS), F.concat(last, F.lit(" "), F.lower(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))))
    rows = rows.withColumn("resolved", F.coalesce(new, clause)).withColumn("fact", F.when(new.isNotNull(), parse_clause(F.col("resolved"), preferences)).otherwise(F.col("fact")))
    return _bounded(rows.where("fact IS NOT NULL"))


def resolve_definite(clause: Column, holder: Column) -> Column:
    """A clause that opens with "The <role>" told of the role's sole holder; unchanged where holder is null."""
    tail = F.regexp_extract(clause, r"^\s*[Tt]he\s+[a-z]+('s\b.*|\s.*)$", 1)
    return F.when(holder.isNotNull() & clause.rlike(DEFINITE), F.concat(holder, tail)).otherwise(clause)


def definite_role(clause: Column) -> Column:
    return F.regexp_extract(clause, DEFINITE, 1)


def extract_definite(texts: DataFrame) -> DataFrame:
    """As extract, for texts (namespace, text_id, ts, text): "The manager ..." is told of the one who holds that role then.

    Whether a clause has a holder depends on the facts of earlier ones, which may be told by role themselves. What a clause says
    does not depend on who the holder is but for the subject, so both readings are parsed first, and one pass over the clauses
    that name or give a role, in order, finds the holders. Its state is a role for each subject of a namespace.
    """
    return _definite(texts).select("namespace", "text_id", "clause_no", "fact.*")


def _definite(texts: DataFrame, preferences: bool = False) -> DataFrame:
    somebody = "Xholder"
    clause = F.col("clause")
    rows = split_clauses(texts).withColumns({"noun": definite_role(clause), "plain": parse_clause(clause, preferences)})
    rows = rows.withColumn("told", F.when(F.col("noun") != "", parse_clause(resolve_definite(clause, F.lit(somebody)), preferences)))
    said = [F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in ("plain", "told") for c in ("subject", "predicate")]
    keys = [normalize(F.col(f"{w}.{c}")).alias(f"{w}_{k}") for w in ("plain", "told") for c, k in (("subject", "s_key"), ("object", "o_key"))]
    role = (F.col("plain.predicate") == "role") | (F.col("noun") != "")
    asked = rows.where(role).select("namespace", "ts", "text_id", "clause_no", "noun", *said, *keys)

    def start() -> dict:
        return {"role": {}, "name": {}, "held": {}}

    def step(state: dict, row: dict) -> dict:
        holders = state["held"].get(row["noun"], ()) if row["noun"] else ()
        key = next(iter(holders)) if len(holders) == 1 else None
        holder = None if key is None else state["name"][key]
        which = "plain" if holder is None else "told"
        if row[f"{which}_predicate"] == "role":
            named = row[f"{which}_subject"] != somebody or which == "plain"
            who = row[f"{which}_s_key"] if named else key
            state["name"][who] = row[f"{which}_subject"] if named else holder
            state["held"].get(state["role"].get(who), set()).discard(who)
            state["role"][who] = row[f"{which}_o_key"]
            state["held"].setdefault(row[f"{which}_o_key"], set()).add(who)
        return {"holder": holder}

    found = fold(asked, ["namespace"], ["ts", "text_id", "clause_no"], start, step, "holder string").where("holder IS NOT NULL").select("namespace", "text_id", "clause_no", "holder")
    out = rows.join(found, ["namespace", "text_id", "clause_no"], "left")
    told = F.when(F.col("told").isNotNull(), _fact(F.when(F.col("told.subject") == somebody, F.col("holder")).otherwise(F.col("told.subject")), F.col("told.predicate"), F.col("told.object")))
    facts = out.withColumn("fact", F.when(F.col("holder").isNotNull(), told).otherwise(F.col("plain"))).where("fact IS NOT NULL").drop("plain", "told", "holder", "noun")
    return _bounded(facts)


def date_facts(facts: DataFrame, clause: str = "clause", ts: str = "ts") -> DataFrame:
    """facts with valid_from: the event date that the clause states, else the text's time; the object loses the date phrase."""
    when = event_date(F.col(clause), F.col(ts))
    cleaned = strip_dates(F.col("object"))
    return facts.withColumns({"valid_from": F.coalesce(when, F.col(ts)), "object": F.when(when.isNotNull() & (cleaned != ""), cleaned).otherwise(F.col("object"))})


def parse_completions(rows: DataFrame) -> DataFrame:
    """Facts of model completions: rows (text_id, text, completion). Lines "a | b | c" whose subject and object occur in the text."""
    line = F.trim(F.regexp_replace(F.trim("line"), r"^[-*•]+", ""))
    lines = rows.select("text_id", "text", F.posexplode(F.split("completion", r"\r?\n")).alias("clause_no", "line")).select("text_id", "text", "clause_no", F.transform(F.split(line, r"\|"), lambda p: F.trim(p)).alias("p"))
    lines = lines.where((F.size("p") == 3) & F.forall("p", lambda x: x != ""))
    source = tokenize(F.col("text"), drop_stop=False)

    def grounded(c: Column) -> Column:
        toks = tokenize(c, drop_stop=False)
        return (F.size(toks) > 0) & (F.size(F.array_except(toks, source)) == 0)

    subject, predicate, obj = (F.get("p", F.lit(k)) for k in range(3))
    kept = lines.where(grounded(subject) & grounded(obj))
    return _bounded(kept.withColumn("fact", _fact(subject, predicate, obj))).select("text_id", "clause_no", "fact.*")


def suppress_echoes(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """texts (namespace, text_id, ts, text) without repeats of a text that stated facts: only its first telling counts."""
    key = normalize(F.col("text"))
    told = texts.join(facts.select("text_id").distinct().withColumn("has_facts", F.lit(True)), "text_id", "left")
    n = F.row_number().over(W.partitionBy("namespace", key).orderBy("ts", "text_id"))
    return told.withColumn("n", n).where(F.col("has_facts").isNull() | (F.col("n") == 1)).drop("n", "has_facts")
