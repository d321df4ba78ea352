"""The store's inputs made from the driver's tables, for the registered queries; plans/catalog.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") / 1_000_000.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions: each user's state is the type of their last event. Namespaces are the users' remainder by four."""
    t = seconds("ts")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")).alias("namespace"), F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("subject"), F.lit("state").alias("predicate"), F.col("event_type").alias("object"), t.alias("valid_from"), t.alias("created_at"))


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, every seventh event told three days after it was so."""
    return events(spark, sf_dir).withColumn("valid_from", F.col("valid_from") - F.when(F.col("id") % 7 == 0, 3 * 86_400.0).otherwise(0.0))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions: every customer's city, role and manager, all open."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    who = F.concat(F.lit("c"), key.cast("string"))
    boss = F.when(key >= 10, F.concat(F.lit("c"), F.floor(key / 10).cast("string")))
    facts = F.array(F.struct(F.lit(0).alias("k"), F.lit("city").alias("predicate"), F.col("n_name").alias("object")), F.struct(F.lit(1).alias("k"), F.lit("role").alias("predicate"), F.col("c_mktsegment").alias("object")), F.struct(F.lit(2).alias("k"), F.lit("manager").alias("predicate"), boss.alias("object")))
    rows = c.select(key.alias("key"), who.alias("subject"), F.explode(facts).alias("f")).where("f.object IS NOT NULL")
    open_ = {"valid_to": "double", "expired_at": "double", "superseded_by": "long"}
    return rows.select(F.lit("n0").alias("namespace"), (F.col("key") * 4 + F.col("f.k")).alias("id"), "subject", "f.predicate", "f.object", F.lit(0.0).alias("valid_from"), F.lit(0.0).alias("created_at"), *(F.lit(None).cast(t).alias(c) for c, t in open_.items()))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four questions about every customer."""
    who = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    texts = [F.concat(F.lit("What city does "), who, F.lit(" live in?")), F.concat(F.lit("What is the role of "), who, F.lit("'s manager?")), F.concat(F.lit("As of session 3, who was the boss of "), who, F.lit("?")), F.concat(F.lit("Tell me about "), who, F.lit("."))]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(*texts)).alias("k", "question"))
    return rows.select((F.col("c_custkey") * 4 + F.col("k")).alias("query_id"), F.lit("n0").alias("namespace"), "question")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("namespace", F.col("subject").alias("entity")).distinct()


def letters(n: Column) -> Column:
    """A name of letters for a number."""
    return F.concat(F.lit("N"), F.translate(n.cast("string"), "0123456789", "abcdefghij"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about customers in all forms that are read, and some that are not."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name, other, place, segment = letters(F.col("c_custkey")), letters(F.col("c_custkey") + 1), F.col("n_name"), F.col("c_mktsegment")
    forms = [
        F.concat(name, F.lit("'s current mailing address is "), place, F.lit(".")),
        F.concat(name, F.lit(" moved to "), place, F.lit(". After that, their role was "), segment, F.lit(".")),
        F.concat(name, F.lit(" works at Acme "), segment, F.lit("; "), name, F.lit(" lives in "), place),
        F.concat(name, F.lit(" is an "), segment, F.lit(" buyer! The weather is a mess.")),
        F.concat(name, F.lit(" reports to "), other, F.lit(". His location is "), place, F.lit(".")),
        F.concat(name, F.lit(" likes classic "), segment, F.lit(". "), name, F.lit("'s favorite ice cream is "), place, F.lit(".")),
        F.concat(F.lit("I moved to "), place, F.lit(". It was "), segment, F.lit(".")),
        F.concat(name, F.lit(" was promoted to a senior "), segment, F.lit(". "), name, F.lit(" worked on the project "), place, F.lit(".")),
    ]
    text = F.element_at(F.array(*forms), (F.col("c_custkey") % 8).cast("int") + 1)
    return c.select(F.concat(F.lit("n"), (F.col("c_custkey") % 4).cast("string")).alias("namespace"), F.col("c_custkey").alias("text_id"), F.col("c_custkey").cast("double").alias("ts"), text.alias("text"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with dates in all forms, and the time that they are told."""
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("January", "feb", "March", "Apr", "May", "june", "Jul", "August", "Sept", "October", "nov", "December")))
    month = F.element_at(names, (k % 12).cast("int") + 1)
    d = (k % 31 + 1).cast("string")
    forms = [
        F.date_format("o_orderdate", "'Moved on 'yyyy-MM-dd' for good'"), F.concat(F.lit("It was "), (k % 12 + 1).cast("string"), F.lit("/"), d, F.lit("/2019 at last")),
        F.concat(F.lit("Met in "), month, F.lit(" "), d, F.lit("th, 2018")), F.concat(F.lit("Since "), month, F.lit(" "), ((k % 28) + 1).cast("string")),
        F.concat(F.lit("Left "), (k % 40).cast("string"), F.lit(" days ago")), F.concat(F.lit("Started two months ago in "), month), F.lit("Joined a year ago"),
        F.concat(F.lit("Back last "), month), F.lit("It happened last week"), F.lit("Seen yesterday"), F.lit("No date here"), F.lit("On 2021-02-30 or 2021-13-01 ten weeks ago"),
    ]
    text = F.element_at(F.array(*forms), F.floor(k / 32).cast("int") % len(forms) + 1)
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text"), (seconds("o_orderdate") + 3_600.0).alias("ref"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records: every turn of the conversations, a minute apart, of the namespace of its conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("n"), (F.col("conv_id") % 4).cast("string")).alias("namespace"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 86_400.0 + F.col("turn") * 60.0).alias("ts"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.col("role").alias("actor"), "text")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate's stream: events with a novelty and, now and then, a contradiction."""
    h = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), F.col("event_id").alias("id"), seconds("ts").alias("ts"), ((h % 1000) / 1000.0).alias("novelty"), (F.col("event_id") % 41 == 0).alias("contradiction"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that assert the events' states, and free ones."""
    e = events(spark, sf_dir)
    return e.select("namespace", "id", F.col("created_at").alias("ts"), F.concat("subject", F.lit(" is "), "object").alias("content"), F.lit("episodic").alias("tier"), (1 + F.col("id") % 3).alias("support_count"), F.col("created_at").alias("last_seen_ts"), *(F.when(F.col("id") % 10 != 9, F.col(c)).alias(f"fact_{c}") for c in ("subject", "predicate", "object")))
