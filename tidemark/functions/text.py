"""Text functions as column expressions; everything here stays in the JVM unless it says so."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of token sets, and words that date an attribute without naming it.
STOP_WORDS = (
    "a an the of to in on at for and or is are was were be been do does did "
    "i you he she it we they this that with as by from"
).split()
TEMPORAL_MARKERS = (
    "current previous old new latest former currently now recent earlier originally "
    "first prior updated nowadays presently initially"
).split()
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "mx")
PREDICATE_ALIASES = {"location": "city"}

TOKEN = r"[\p{L}\p{N}]+"
CLAUSE_END = r"(?<=[.!?;])\s+"


def words(*items: str) -> Column:
    return F.array(*map(F.lit, items))


def fold_case(text: Column) -> Column:
    """Case folding for matching: lower case with ß as ss. Greek final sigma keeps its own form."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokenize(text: Column, drop_stop: bool = True) -> Column:
    """Folded runs of letters and digits in any script, in order; null text has none."""
    found = F.regexp_extract_all(fold_case(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if drop_stop else found


def count_tokens(text: Column) -> Column:
    return F.regexp_count(fold_case(F.coalesce(text, F.lit(""))), F.lit(TOKEN))


def set_jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(tokenize(a), tokenize(b))


def _nfkc(text: Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def normalize(text: Column, compatibility: bool = False) -> Column:
    """Key form of a name or value. ASCII needs no more than trimming and folding; with compatibility, non-ASCII text is
    brought to NFKC by a vectorised Python function (Spark has none)."""
    trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    plain = fold_case(trimmed)
    return F.when(trimmed.rlike(r"[^\x00-\x7F]"), _nfkc(trimmed)).otherwise(plain) if compatibility else plain


def stable_hash(text: Column) -> Column:
    """A 32-bit number from a text's md5, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def strip_honorific(name: Column) -> Column:
    """Without one leading title, if a word is left."""
    return F.regexp_replace(F.trim(name), rf"(?i)^(?:{'|'.join(HONORIFICS)})\.?\s+(?=\S)", "")


def canonical_predicate(attribute: Column) -> Column:
    """Content words of an attribute without temporal markers, aliases resolved."""
    key = F.array_join(F.filter(tokenize(attribute), lambda t: ~t.isin(TEMPORAL_MARKERS)), " ")
    for alias, name in PREDICATE_ALIASES.items():
        key = F.when(key == alias, name).otherwise(key)
    return key


def clean_object(value: Column) -> Column:
    """Trimmed, without trailing sentence punctuation."""
    return F.regexp_replace(value, r"^\s+|[.!?,;:\s]+$", "")


def clauses(text: Column) -> Column:
    """Parts of a text that end in . ! ? or ; before white space."""
    return F.split(text, CLAUSE_END)


def first_person(text: Column, speaker: Column) -> Column:
    """First-person statements told of the speaker, in the order: contractions, verbs that agree, I, my."""
    s = F.regexp_replace(F.concat(F.upper(F.substring(speaker, 1, 1)), F.substr(speaker, F.lit(2))), r"([\\$])", r"\\$1")
    # The verbs that agree and the forms that are rewritten, in order.
    verbs = "work|live|reside|report|move|relocate|like|love|enjoy|prefer|favor|dislike|hate"
    steps = (
        (r"\b(?:I\s+am|I'm)\b", F.concat(s, F.lit(" is"))),
        (r"\bI've\b", F.concat(s, F.lit(" has"))),
        (rf"\bI\s+({verbs})\b", F.concat(s, F.lit(" $1s"))),
        (r"\bI\b", s),
        (r"\b[Mm]y\b", F.concat(s, F.lit("'s"))),
    )
    out = text
    for pattern, new in steps:
        out = F.regexp_replace(out, F.lit(pattern), new)
    return F.when(speaker.isNull() | (speaker == ""), text).otherwise(out)


def recency(now: Column, ts: Column, half_life: float = 30 * 86_400.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), now - ts) / half_life)


def render_fact(subject: Column, predicate: Column, obj: Column, as_of: Column, hops: Column | None = None) -> Column:
    """One line for a resolved fact: a chain, a past value or a current one."""
    plain = F.when(as_of.isNotNull(), F.concat(subject, F.lit("'s "), predicate, F.lit(" as of that time was "), obj, F.lit("."))).otherwise(F.concat(subject, F.lit("'s current "), predicate, F.lit(" is "), obj, F.lit(".")))
    if hops is None:
        return plain
    return F.when(F.size(hops) > 0, F.concat(F.array_join(F.concat(F.array(subject), hops), " "), F.lit(" is "), obj, F.lit("."))).otherwise(plain)


def render_preference(subject: Column, predicate: Column, obj: Column) -> Column:
    topic = F.regexp_replace(predicate, "^preference:", "")
    polar = F.concat(subject, F.lit(" "), obj, F.lit("s "), topic, F.lit("."))
    return F.when(obj.isin("like", "dislike"), polar).otherwise(F.concat(subject, F.lit("'s favorite "), topic, F.lit(" is "), obj, F.lit(".")))
