"""Entity resolution: names of several words make their first and last words stand for them, unless those are ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalize, strip_honorific
from tidemark.operators.ordered import fold


def surfaces(rows: DataFrame) -> DataFrame:
    """(namespace, surface, ts, id): normalized names without titles, each at its first mention."""
    named = rows.select("namespace", normalize(strip_honorific(F.col("name"))).alias("surface"), "ts", "id").where("surface <> ''")
    return named.groupBy("namespace", "surface").agg(F.min(F.struct("ts", "id")).alias("m")).select("namespace", "surface", "m.ts", "m.id")


def resolve_and_register(rows: DataFrame) -> DataFrame:
    """(namespace, surface, canonical): what each distinct name stands for when it is first met, in order of arrival.

    A name of several words registers itself and lends its first and last word, whose second lender makes them ambiguous for
    good. A single word stands for the one full name that lends it, unless it came first on its own or is ambiguous.
    """

    def start() -> dict:
        return {"lent": {}, "single": set()}

    def step(state: dict, row: dict) -> dict:
        name = row["surface"]
        parts, lent = name.split(), state["lent"]
        if len(parts) > 1:
            for role, word in (("given", parts[0]), ("surname", parts[-1])):
                if lent.setdefault((role, word), name) != name:
                    lent[role, word] = None  # ambiguous
            return {"canonical": name}
        holders = [lent[role, name] for role in ("given", "surname") if (role, name) in lent]
        if name not in state["single"] and holders and None not in holders and len(set(holders)) == 1:
            return {"canonical": holders[0]}
        state["single"].add(name)
        return {"canonical": name}

    return fold(surfaces(rows), ["namespace"], ["ts", "id", "surface"], start, step, "canonical string").drop("ts", "id")


def lent_words(full: DataFrame) -> DataFrame:
    """(namespace, word, canonical): words that exactly one full name (namespace, surface) lends, in whichever role."""
    parts = F.split("surface", r"\s+")
    roles = full.where(F.size(parts) > 1).select("namespace", "surface", F.explode(F.array_distinct(F.array(F.element_at(parts, 1), F.element_at(parts, -1)))).alias("word"))
    return roles.groupBy("namespace", "word").agg(F.count_distinct("surface").alias("n"), F.min("surface").alias("canonical")).where("n = 1").drop("n")


def canonical(names: DataFrame, full: DataFrame, singles: DataFrame) -> DataFrame:
    """names (namespace, surface) with canonical, given the full names and the words that stand for themselves."""
    own = singles.select("namespace", F.col("surface").alias("word"))
    lent = lent_words(full).join(own, ["namespace", "word"], "left_anti")
    return names.join(lent.withColumnRenamed("word", "surface"), ["namespace", "surface"], "left").withColumn("canonical", F.coalesce("canonical", "surface"))


def vocabulary(full: DataFrame, singles: DataFrame) -> DataFrame:
    """(namespace, entity): full names, single ones, and the words that stand for one full name."""
    own = singles.select("namespace", F.col("surface").alias("entity"))
    lent = lent_words(full).select("namespace", F.col("word").alias("entity"))
    return full.select("namespace", F.col("surface").alias("entity")).union(own).union(lent).distinct()


def forget(full: DataFrame, singles: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The full names and single ones without names (namespace, surface), and the words that stay ambiguous for good: those that
    more than one full name lent before, so that a survivor does not take what was refused while both were there."""
    parts = F.split("surface", r"\s+")
    lent = full.where(F.size(parts) > 1).select("namespace", "surface", F.explode(F.array_distinct(F.array(F.element_at(parts, 1), F.element_at(parts, -1)))).alias("word"))
    poisoned = lent.groupBy("namespace", "word").agg(F.count_distinct("surface").alias("n")).where("n > 1").select("namespace", F.col("word").alias("surface"))
    gone = names.select("namespace", normalize(F.col("surface")).alias("surface"))
    return full.join(gone, ["namespace", "surface"], "left_anti"), singles.join(gone, ["namespace", "surface"], "left_anti"), poisoned
