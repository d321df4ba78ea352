"""Text, date, extraction and resolution functions on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import extract, resolve


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, "The Größe of a_b ½ É́ 日本 3.5", text.tokenize) == ["grösse", "b", "½", "é", "日本", "3", "5"]
    assert one(spark, None, text.tokenize) == []
    assert one(spark, "a the of", text.count_tokens) == 3


def test_normalize(spark):
    assert one(spark, " Ｆｉｎ ﬁ １ Straße ", lambda c: text.normalize(c, compatibility=True)) == "fin fi 1 strasse"
    assert one(spark, " AbC\t", text.normalize) == "abc"


def test_phrases(spark):
    assert one(spark, "current Mailing address", text.canonical_predicate) == "mailing address"
    assert one(spark, " Vienna !?. ", text.clean_object) == "Vienna"
    assert one(spark, "See a@b.com, 3.5. Yes! No", text.clauses) == ["See a@b.com, 3.5.", "Yes!", "No"]
    assert one(spark, "Dr. Ann", text.strip_honorific) == "Ann"
    assert one(spark, "Miss", text.strip_honorific) == "Miss"
    told = one(spark, "I'm here, I've moved; I work and my dog", lambda c: text.first_person(c, F.lit("erin")))
    assert told == "Erin is here, Erin has moved; Erin works and Erin's dog"


REF = dt.datetime(2024, 3, 31, 15, 30, tzinfo=dt.UTC).timestamp()


def utc(*day, hours=0):
    return dt.datetime(*day, tzinfo=dt.UTC).timestamp() + hours * 3600


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("on 2023-03-15", utc(2023, 3, 15)), ("3/5/2021", utc(2021, 3, 5)), ("March 3rd, 2020", utc(2020, 3, 3)), ("since Apr 5", utc(2023, 4, 5)), ("on mar 31", utc(2024, 3, 31)),
        ("a month ago", utc(2024, 2, 29, hours=15.5)), ("two weeks ago", REF - 14 * 86400), ("10 days ago", REF - 864000), ("a year ago", utc(2023, 3, 31, hours=15.5)),
        ("last December", utc(2023, 12, 1)), ("this march", utc(2024, 3, 1)), ("last week", REF - 7 * 86400), ("past month", utc(2024, 2, 29, hours=15.5)), ("Yesterday", REF - 86400),
        ("nothing", None), ("2021-02-30 yesterday", None), ("2021-13-01 yesterday", REF - 86400), (None, None),
    ],
)
def test_event_dates(spark, said, want):
    assert one(spark, said, lambda c: dates.event_date(c, F.lit(REF))) == want


def test_strip_dates(spark):
    assert one(spark, "Vienna back on March 3", dates.strip_dates) == "Vienna"
    assert one(spark, "Oslo two months ago", dates.strip_dates) == "Oslo"


def triples(spark, said, **options):
    df = spark.createDataFrame([(1, said)], "text_id long, text string")
    return [tuple(r)[2:] for r in extract.extract(df, **options).orderBy("clause_no").collect()]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Erin's current mailing address is 5 Elm St.", ("Erin", "mailing address", "5 Elm St")), ("Erin has moved to Vienna.", ("Erin", "city", "Vienna")), ("Acme is headquartered in Oslo", ("Acme", "headquarters", "Oslo")),
        ("Bob is working on the project Apollo!", ("Bob", "project", "Apollo")), ("Bob worked for Acme", ("Bob", "employer", "Acme")), ("Bob works as a designer", ("Bob", "role", "designer")),
        ("Bob was promoted to an editor", ("Bob", "role", "editor")), ("Bob reports to Carol", ("Bob", "manager", "Carol")), ("Bob's location is Riga", ("Bob", "city", "Riga")),
    ],
)
def test_statement_forms(spark, said, want):
    assert triples(spark, said) == [want]


def test_what_is_not_read(spark):
    assert triples(spark, "The weather is a mess. I moved to Oslo. it is raining") == []
    assert triples(spark, " ".join(f"Bob{'abcdefghij'[i]}x lives in C{i}." for i in range(10)))[-1][2] == "C7"
    assert triples(spark, "Bob lives in Oslo. Bob lives in oslo.") == [("Bob", "city", "Oslo")]


def test_preferences(spark):
    said = "Erin likes classic jazz. Erin hates crowds. Erin's favorite ice cream is Plum. Erin prefers tea to milk."
    assert triples(spark, said, preferences=True) == [("Erin", "preference:jazz", "like"), ("Erin", "preference:crowds", "dislike"), ("Erin", "preference:ice cream", "Plum")]
    assert triples(spark, "Erin likes jazz.") == []


def test_references(spark):
    rows = [("n", 1, 1.0, "Erin moved to Oslo."), ("n", 2, 2.0, "After that, her role was editor. Moved to Riga."), ("m", 3, 3.0, "His city is Rome.")]
    df = spark.createDataFrame(rows, "namespace string, text_id long, ts double, text string")
    got = [(r["subject"], r["predicate"], r["object"]) for r in extract.extract_with_pronouns(df, ellipsis=True).orderBy("text_id", "clause_no").collect()]
    assert got == [("Erin", "city", "Oslo"), ("Erin", "role", "editor"), ("Erin", "city", "Riga")]
    assert one(spark, "The manager's project is X", lambda c: extract.resolve_definite(c, F.lit("Bob"))) == "Bob's project is X"
    assert one(spark, "The manager moved", extract.definite_role) == "manager"


def test_resolution(spark):
    rows = [("n", n, float(i), i) for i, n in enumerate(["Erin", "Dr. Erin Smith", "Smith", "Bob Jones", "Bob", "Bob Stone", "Jones", "Stone", "bob jones"])]
    got = {r["surface"]: r["canonical"] for r in resolve.resolve_and_register(spark.createDataFrame(rows, "namespace string, name string, ts double, id long")).collect()}
    assert got == {"erin": "erin", "erin smith": "erin smith", "smith": "erin smith", "bob jones": "bob jones", "bob": "bob jones", "bob stone": "bob stone", "jones": "bob jones", "stone": "bob stone"}
    full = spark.createDataFrame([("n", "bob jones"), ("n", "bob stone"), ("n", "erin smith")], "namespace string, surface string")
    single = spark.createDataFrame([("n", "erin")], "namespace string, surface string")
    words = {r["entity"] for r in resolve.vocabulary(full, single).collect()}
    assert words == {"bob jones", "bob stone", "erin smith", "erin", "jones", "stone", "smith"}


def test_definite_references(spark):
    said = ["Ann is a manager.", "The manager was promoted to director.", "The director moved to Oslo.", "Bob is a manager.", "Cid is a manager.", "The manager moved to Rome.", "Bob is a clerk.", "The manager's project is Apollo.", "The weather moved to Riga."]
    df = spark.createDataFrame([("n", i, float(i), t) for i, t in enumerate(said)], "namespace string, text_id long, ts double, text string")
    got = {(r["text_id"], r["subject"], r["predicate"], r["object"]) for r in extract.extract_definite(df).collect()}
    assert {x for x in got if x[0] in (1, 2, 5, 7, 8)} == {(1, "Ann", "role", "director"), (2, "Ann", "city", "Oslo"), (7, "Cid", "project", "Apollo")}


def test_definite_references_nest_to_any_depth(spark):
    roles = ["a" * (k + 1) for k in range(13)]
    said = [f"Ann is a {roles[0]}."] + [f"The {roles[k]} was promoted to {roles[k + 1]}." for k in range(12)] + ["The aaaaaaaaaaaaa moved to Oslo."]
    df = spark.createDataFrame([("n", i, float(i), t) for i, t in enumerate(said)], "namespace string, text_id long, ts double, text string")
    got = sorted((r["text_id"], r["subject"], r["object"]) for r in extract.extract_definite(df).collect())
    assert got == [(k, "Ann", roles[k]) for k in range(13)] + [(13, "Ann", "Oslo")]


def test_forgotten_names_stay_ambiguous(spark):
    make = lambda names: spark.createDataFrame([("n", x) for x in names], "namespace string, surface string")
    full, single, poisoned = resolve.forget(make(["bob jones", "bob stone"]), make(["erin", "al"]), make([" Bob Stone", "AL"]))
    assert [[r["surface"] for r in d.collect()] for d in (full, single, poisoned)] == [["bob jones"], ["erin"], ["bob"]]
