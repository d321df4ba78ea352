"""Observations: reading, checking and making them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import stable_hash

OBSERVATION = "namespace string, session_id string, seq long, id long, ts double, actor string, speaker string, text string, fact struct<subject: string, predicate: string, object: string, valid_from: double>"


def problem() -> Column:
    """Why an observation is refused, or null: text, finite time, and a whole fact with a finite start if there is one."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    return (
        F.when(F.col("text").isNull(), "no text").when(~finite(F.col("ts")), "no finite time")
        .when(F.col("fact").isNotNull() & (blank("fact.subject") | blank("fact.predicate") | blank("fact.object")), "fact is not whole")
        .when(F.col("fact.valid_from").isNotNull() & ~finite(F.col("fact.valid_from")), "fact has no finite start")
    )


def validate(observations: DataFrame) -> DataFrame:
    """observations with problem: null for good ones."""
    return observations.withColumn("problem", problem())


def strict(observations: DataFrame) -> DataFrame:
    """observations, failing at the first that is refused."""
    return observations.where(F.when(problem().isNull(), True).otherwise(F.raise_error(F.concat(F.lit("observation refused: "), problem())).cast("boolean")))


def assertions(observations: DataFrame) -> DataFrame:
    """(namespace, id, subject, predicate, object, valid_from, created_at) of observations that carry a fact."""
    f = F.col("fact")
    return observations.where(f.isNotNull()).select("namespace", "id", "fact.subject", "fact.predicate", "fact.object", F.coalesce(f["valid_from"], F.col("ts")).alias("valid_from"), F.col("ts").alias("created_at"))


# Names and values of generated observations.
PEOPLE = ("erin", "bob", "carol", "dave", "frank", "grace")
CITIES = ("Berlin", "Vienna", "Oslo", "Lisbon", "Prague", "Dublin", "Turin", "Riga")
ROLES = ("designer", "analyst", "engineer", "editor", "planner")


def generate(spark: SparkSession, seed: int = 0, people: int = 6, sessions: int = 64, noise: int = 4) -> DataFrame:
    """A stream over sessions a day apart: each person's city and role, a change of each, restatements, and chit-chat.

    Values come from hashes of the row's place and the seed, so any number of rows is made in parallel and reruns agree.
    """
    kinds = 2 + noise
    n = spark.range(sessions * people * kinds).select(F.floor(F.col("id") / (people * kinds)).alias("session"), F.floor(F.col("id") / kinds % people).cast("int").alias("p"), (F.col("id") % kinds).cast("int").alias("k"), "id")
    person = F.concat(F.element_at(F.array(*map(F.lit, PEOPLE)), F.col("p") % len(PEOPLE) + 1), F.when(F.col("p") >= len(PEOPLE), (F.col("p") / len(PEOPLE)).cast("int").cast("string")).otherwise(""))
    name = F.initcap(person)

    def pick(values: tuple[str, ...], what: str, turn: Column) -> Column:
        h = stable_hash(F.concat_ws(":", F.lit(str(seed)), F.lit(what), person, turn.cast("string")))
        return F.element_at(F.array(*map(F.lit, values)), (h % len(values)).cast("int") + 1)

    city = pick(CITIES, "city", (F.col("session") >= 30 + F.col("p")).cast("int"))
    role = pick(ROLES, "role", (F.col("session") >= 45 + F.col("p")).cast("int"))
    text = F.when(F.col("k") == 0, F.concat(name, F.lit(" moved to "), city, F.lit("."))).when(F.col("k") == 1, F.concat(name, F.lit(" works as a "), role, F.lit("."))).otherwise(F.concat(F.lit("The weather was "), pick(("mild", "wet", "cold", "bright"), "weather", F.col("id")), F.lit(" again.")))
    fact = F.when(F.col("k") < 2, F.struct(person.alias("subject"), F.when(F.col("k") == 0, "city").otherwise("role").alias("predicate"), F.when(F.col("k") == 0, city).otherwise(role).alias("object"), F.lit(None).cast("double").alias("valid_from")))
    seq = F.col("p") * kinds + F.col("k")
    return n.select(F.lit("default").alias("namespace"), F.format_string("s%03d", F.col("session")).alias("session_id"), seq.cast("long").alias("seq"), "id", (1_700_000_000.0 + F.col("session") * 86_400.0 + seq * 60.0).alias("ts"), F.lit("user").alias("actor"), F.lit(None).cast("string").alias("speaker"), text.alias("text"), fact.alias("fact"))


def redundant_stream(spark: SparkSession, seed: int = 0, distinct: int = 24, repeats: int = 12) -> DataFrame:
    """distinct facts told repeats times each in a shuffled order, a minute apart, ten to a session."""
    rows = spark.range(distinct * repeats).select((F.col("id") % distinct).alias("d"), F.floor(F.col("id") / distinct).alias("r"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))).alias("h"))
    from pyspark.sql import Window as W

    text = F.concat(F.lit("Note "), F.col("d").cast("string"), F.lit(": item"), stable_hash(F.col("d").cast("string")).cast("string"), F.lit(" is kept in place "), F.col("d").cast("string"))
    order = F.row_number().over(W.orderBy("h")) - 1  # a fixture: as many rows as asked for
    return rows.withColumn("seq", order.cast("long")).select(F.lit("default").alias("namespace"), F.format_string("s%03d", F.floor(F.col("seq") / 10)).alias("session_id"), "seq", F.col("seq").alias("id"), (1_700_000_000.0 + F.col("seq") * 60.0).alias("ts"), text.alias("text"), F.col("d").alias("fact_no"))
