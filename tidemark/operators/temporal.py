"""Bi-temporal facts: versions of (namespace, subject, predicate) from assertions, and lookups over them.

Assertions have namespace, subject, predicate, object, valid_from, created_at (seconds) and id, in arrival order of
(created_at, id). Versions have half-open intervals of validity and belief with null for an open end. Keys are normalized;
the texts stay as they came.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import normalize
from tidemark.operators.ordered import fold

KEY = ("namespace", "s_key", "p_key")
VERSION = ("namespace", "id", "subject", "predicate", "object", "valid_from", "valid_to", "created_at", "expired_at", "superseded_by")


def keyed(rows: DataFrame) -> DataFrame:
    """rows with normalized keys of subject, predicate and object."""
    return rows.withColumns({"s_key": normalize(F.col("subject")), "p_key": normalize(F.col("predicate")), "o_key": normalize(F.col("object"))})


def assert_monotone(assertions: DataFrame) -> DataFrame:
    """Versions for assertions whose valid_from never falls within a key: changes of the object, closed by the next one."""
    arrival = W.partitionBy(*KEY).orderBy("created_at", "id")
    before = F.lag("o_key").over(arrival)
    rows = assertions if "o_key" in assertions.columns else keyed(assertions)
    changes = rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("o_key")))
    return changes.select(
        "namespace", "id", "subject", "predicate", "object", "valid_from", F.lead("valid_from").over(arrival).alias("valid_to"),
        "created_at", F.lead("created_at").over(arrival).alias("expired_at"), F.lead("id").over(arrival).alias("superseded_by"),
    )


def label_assertions(assertions: DataFrame) -> DataFrame:
    """Every assertion as what it does on arrival: noop (the open fact says so), hist (older than the open fact) or super.

    hist rows get the open fact's id and start, super rows the id of the one they supersede. Needed where valid_from may fall:
    whether a row supersedes depends on the rows that did before it.
    """

    def step(state: dict, row: dict) -> dict:
        if state and state["object"] == row["o_key"]:
            return {"label": "noop"}
        if state and row["valid_from"] < state["valid_from"]:
            return {"label": "hist", "open_id": state["id"], "open_from": state["valid_from"]}
        before = state.get("id")
        state.update(object=row["o_key"], valid_from=row["valid_from"], id=row["id"])
        return {"label": "super", "open_id": before}

    return fold(assertions if "o_key" in assertions.columns else keyed(assertions), list(KEY), ["created_at", "id"], dict, step, "label string, open_id long, open_from double")


def _by_order(assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed assertions of keys whose valid_from never falls in arrival order, and those of the others."""
    arrival = W.partitionBy(*KEY).orderBy("created_at", "id")
    x = keyed(assertions).withColumn("__fall", F.coalesce(F.lag("valid_from").over(arrival) > F.col("valid_from"), F.lit(False)))
    x = x.withColumn("__fall", F.max("__fall").over(W.partitionBy(*KEY)))
    return x.where(~F.col("__fall")).drop("__fall"), x.where("__fall").drop("__fall")


def assert_facts(assertions: DataFrame) -> DataFrame:
    """Versions for assertions in any order of validity. Late ones become closed history under the fact that was open.

    Keys without late assertions need no fold: their versions are two window functions.
    """
    plain, late = _by_order(assertions)
    labelled = label_assertions(late).where(F.col("label") != "noop")
    arrival = W.partitionBy(*KEY, "label").orderBy("created_at", "id")
    hist = F.col("label") == "hist"

    def after(col: str) -> Column:
        return F.lead(col).over(arrival)

    folded = labelled.select(
        "namespace", "id", "subject", "predicate", "object", "valid_from",
        F.when(hist, F.col("open_from")).otherwise(after("valid_from")).alias("valid_to"), "created_at",
        F.when(~hist, after("created_at")).alias("expired_at"), F.when(hist, F.col("open_id")).otherwise(after("id")).alias("superseded_by"),
    )
    return assert_monotone(plain).unionByName(folded)


def is_open() -> Column:
    return F.col("valid_to").isNull() & F.col("expired_at").isNull()


def open_facts(versions: DataFrame) -> DataFrame:
    return versions.where(is_open())


def _latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, of the latest valid_from, created_at and id."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("valid_from", "created_at", "id"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def current(versions: DataFrame) -> DataFrame:
    """The open fact of each key."""
    return _latest(keyed(open_facts(versions)), KEY).select(*VERSION)


def holds_at(t: Column) -> Column:
    """Whether a version was valid at t and believed at t."""
    valid = (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))
    return valid & (F.col("created_at") <= t) & (F.col("expired_at").isNull() | (t < F.col("expired_at")))


def as_of(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """For each row (query_id, namespace, subject, predicate, t) of asked the version that held at t, if any.

    An equi-join on the key with the interval as a residual; t null asks for the current fact.
    """
    q = asked.select("query_id", "t", F.col("namespace").alias("q_ns"), normalize(F.col("subject")).alias("q_s"), normalize(F.col("predicate")).alias("q_p"))
    t = F.col("t")
    on = (F.col("q_ns") == F.col("namespace")) & (F.col("q_s") == F.col("s_key")) & (F.col("q_p") == F.col("p_key"))
    found = q.join(keyed(versions), on).where(F.when(t.isNull(), is_open()).otherwise(holds_at(t)))
    return _latest(found.select("query_id", "t", *VERSION), ("query_id", "t"))


def path(versions: DataFrame, asked: DataFrame, hops: Sequence[str]) -> DataFrame:
    """For rows (query_id, namespace, subject, t) follow the predicates of hops; the object of a hop is the next subject.

    Returns query_id, object and chain, the version ids of every hop; no row where a hop is missing.
    """
    at = asked.select("query_id", "namespace", "t", "subject", F.array().cast("array<long>").alias("chain"))
    for hop in hops:
        found = as_of(versions, at.select("query_id", "namespace", "subject", F.lit(hop).alias("predicate"), "t")).select("query_id", "id", F.col("object").alias("next"))
        at = at.join(found, "query_id").select("query_id", "namespace", "t", F.col("next").alias("subject"), F.concat("chain", F.array("id")).alias("chain"))
    return at.select("query_id", F.col("subject").alias("object"), "chain")


def paths(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """As path, for rows (query_id, namespace, subject, t, hops) that each have their own predicates; as many joins as the longest has."""
    return follow(versions, asked).select("query_id", F.col("at.object").alias("object"), "chain")


def follow(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked, one per query_id, whose whole path is there, with chain, the version ids of every hop, and at, the last version.

    Every hop is one merge join and one aggregation: rows carry what they need. A row whose path has ended keeps a key of its
    own, which meets nobody, so such rows do not gather in one task.
    """
    kept = [c for c in asked.columns if c != "query_id"]
    last = "struct<id:long,subject:string,predicate:string,object:string>"
    rows = asked.withColumns({"chain": F.array().cast("array<long>"), "at": F.struct(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("predicate"), F.col("subject").alias("object")).cast(last)})
    held = keyed(versions).select("s_key", "p_key", F.col("namespace").alias("v_ns"), "valid_from", "valid_to", "created_at", "expired_at", F.struct("id", "subject", "predicate", "object").cast(last).alias("v"))
    longest = asked.agg(F.max(F.size("hops"))).first()[0] or 0
    for k in range(longest):
        due = F.size("hops") > k
        q = rows.withColumns({"q_s": F.when(due, normalize(F.col("at.object"))).otherwise(F.concat(F.lit("\0"), F.col("query_id").cast("string"))), "q_p": F.when(due, normalize(F.get("hops", F.lit(k)))).otherwise(F.lit("\0"))})
        on = (F.col("q_ns") == F.col("v_ns")) & (F.col("q_s") == F.col("s_key")) & (F.col("q_p") == F.col("p_key"))
        on = on & F.when(F.col("q_t").isNull(), is_open()).otherwise(holds_at(F.col("q_t")))
        met = q.withColumns({"q_ns": F.col("namespace"), "q_t": F.col("t")}).join(held.hint("merge"), on, "left")
        best = F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("valid_from", "created_at", F.col("v.id"))))
        one = met.groupBy("query_id").agg(best.alias("v"), F.first(F.struct(*kept, "chain", "at")).alias("r")).select("query_id", "r.*", "v")
        one = one.where((F.size("hops") <= k) | F.col("v").isNotNull())
        rows = one.withColumns({"chain": F.when(F.col("v").isNotNull(), F.concat("chain", F.array("v.id"))).otherwise(F.col("chain")), "at": F.coalesce("v", "at")}).drop("v")
    return rows


def history(versions: DataFrame, namespace: str, subject: str, predicate: str) -> DataFrame:
    """All versions of a key, oldest first."""
    rows = keyed(versions).where((F.col("namespace") == namespace) & (F.col("s_key") == normalize(F.lit(subject))) & (F.col("p_key") == normalize(F.lit(predicate))))
    return rows.orderBy("valid_from", "created_at", "id").select(*VERSION)


def subjects_where(versions: DataFrame, predicate: str, obj: str, t: float | None = None) -> DataFrame:
    """(namespace, subject): whose predicate has this object, now or at t."""
    when = is_open() if t is None else holds_at(F.lit(t))
    rows = keyed(versions).where((F.col("p_key") == normalize(F.lit(predicate))) & (F.col("o_key") == normalize(F.lit(obj))) & when)
    return rows.select("namespace", "subject").distinct()


def predicates_for(versions: DataFrame) -> DataFrame:
    """(namespace, subject, predicates): the sorted open predicates of every subject."""
    return open_facts(versions).groupBy("namespace", "subject").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))


def forget(versions: DataFrame, subjects: DataFrame, predicate: str | None = None, as_object: bool = True) -> DataFrame:
    """versions without those of the subjects (namespace, subject): of one predicate, or all and those that name them as object."""
    gone = subjects.select(F.col("namespace").alias("g_ns"), normalize(F.col("subject")).alias("g_s")).distinct()
    rows = keyed(versions)
    mine = (F.col("g_ns") == F.col("namespace")) & (F.col("g_s") == F.col("s_key"))
    if predicate is not None:
        return rows.join(gone, mine & (F.col("p_key") == normalize(F.lit(predicate))), "left_anti").select(*versions.columns)
    rows = rows.join(gone, mine, "left_anti")
    if as_object:
        rows = rows.join(gone, (F.col("g_ns") == F.col("namespace")) & (F.col("g_s") == F.col("o_key")), "left_anti")
    return rows.select(*versions.columns)


def contradictions(assertions: DataFrame) -> DataFrame:
    """assertions with contradicts: whether the key's open fact says otherwise on arrival."""
    plain, late = _by_order(assertions)
    before = F.lag("o_key").over(W.partitionBy(*KEY).orderBy("created_at", "id"))
    told = plain.withColumn("contradicts", F.coalesce(before != F.col("o_key"), F.lit(False)))
    folded = label_assertions(late).withColumn("contradicts", (F.col("label") != "noop") & F.col("open_id").isNotNull()).drop("label", "open_id", "open_from")
    return told.unionByName(folded).drop("s_key", "p_key", "o_key")


def relation_predicates(versions: DataFrame, entities: DataFrame) -> DataFrame:
    """(namespace, predicate): predicates of which some object is a known entity (namespace, entity)."""
    known = entities.select(F.col("namespace").alias("e_ns"), F.col("entity").alias("e"))
    return keyed(versions).join(known, (F.col("namespace") == F.col("e_ns")) & (F.col("o_key") == F.col("e")), "left_semi").select("namespace", "predicate").distinct()
