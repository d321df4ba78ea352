"""Event dates stated in text, as column expressions: the first form that is found decides, absolute forms before relative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and number words.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}

_NAME = "|".join(sorted(MONTHS + SHORT_MONTHS, key=len, reverse=True))
_COUNT = r"\d+|" + "|".join(NUMBER_WORDS)
# The forms of dates that are read, and what they leave dangling.
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
NUMERIC = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
MONTH_DAY = rf"(?i)\b({_NAME})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b"
AGO = rf"(?i)\b({_COUNT})\s+(day|week|month|year)s?\s+ago\b"
LAST_MONTH = rf"(?i)\b(?:last|this|in)\s+({_NAME})\b"
LAST_UNIT = r"(?i)\b(?:last|past|previous)\s+(week|month|year)\b"
YESTERDAY = r"(?i)\byesterday\b"
PHRASES = (ISO, NUMERIC, MONTH_DAY, AGO, LAST_MONTH, LAST_UNIT, YESTERDAY)
DAY = 86_400.0


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _number(text: Column, pattern: str, group: int) -> Column:
    found = _part(text, pattern, group)
    return F.when(found != "", found.cast("int"))


def _month(name: Column) -> Column:
    """Number of a month's name; the first three letters tell them apart."""
    short = F.array(*(F.lit(m[:3]) for m in MONTHS))
    return F.array_position(short, F.substring(F.lower(name), 1, 3)).cast("int")


def _midnight(year: Column, month: Column, day: Column) -> Column:
    """Seconds of a UTC midnight; null where the calendar has no such day."""
    return F.unix_date(F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")))) * DAY


def _shift(ref: Column, months: Column) -> Column:
    """Whole calendar months away at the same time of day, the day clamped to the month."""
    return F.unix_date(F.add_months(_day(ref), months)) * DAY + (ref - F.floor(ref / DAY) * DAY)


def _day(ref: Column) -> Column:
    """The UTC day of a time in seconds, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(ref / DAY).cast("int"))


def event_date(text: Column, ref: Column) -> Column:
    """Seconds of the event date stated in text, relative to ref (seconds, UTC); null if there is none.

    An ISO or M/D/Y date with an impossible month or day number is passed over; one that only the calendar lacks (Feb 30)
    ends the search with null.
    """
    year, month = F.year(_day(ref)), F.month(_day(ref))

    def plausible(m: Column, d: Column) -> Column:
        return m.between(1, 12) & d.between(1, 31)

    iso = [_number(text, ISO, g) for g in (1, 2, 3)]
    num = [_number(text, NUMERIC, g) for g in (3, 1, 2)]
    named, day, stated = _month(_part(text, MONTH_DAY, 1)), _number(text, MONTH_DAY, 2), _number(text, MONTH_DAY, 3)
    this, before = _midnight(year, named, day), _midnight(year - 1, named, day)
    recent = F.when(this.isNull(), None).when(this <= ref, this).otherwise(before)
    raw = F.lower(_part(text, AGO, 1))
    numbers = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    count = F.when(raw.rlike(r"^\d+$"), raw.cast("int")).otherwise(numbers[raw])
    unit = F.lower(_part(text, AGO, 2))
    ago = F.when(unit == "month", _shift(ref, -count)).when(unit == "year", _shift(ref, -12 * count)).when(unit == "week", ref - 7 * DAY * count).otherwise(ref - DAY * count)
    last = _month(_part(text, LAST_MONTH, 1))
    span = F.lower(_part(text, LAST_UNIT, 1))
    back = F.when(span == "month", _shift(ref, F.lit(-1))).when(span == "year", _shift(ref, F.lit(-12))).otherwise(ref - 7 * DAY)
    out = F.when(plausible(iso[1], iso[2]), _midnight(*iso)).when(plausible(num[1], num[2]), _midnight(*num))
    out = out.when(named.isNotNull() & (named > 0) & day.isNotNull(), F.when(stated.isNotNull(), _midnight(stated, named, day)).otherwise(recent))
    out = out.when(raw != "", ago).when(last > 0, _midnight(F.when(last <= month, year).otherwise(year - 1), last, F.lit(1)))
    return out.when(span != "", back).when(text.rlike(YESTERDAY), ref - DAY)


def strip_dates(text: Column) -> Column:
    """Without date phrases and the connectives that they leave dangling at the end."""
    for p in PHRASES:
        text = F.regexp_replace(text, p, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"^[ ,;]+|[ ,;]+$", "")
    return F.regexp_replace(text, r"(?i)(?:[\s,]+(?:on|in|at|around|back|since|by|from|until))+$", "")
