"""Amounts, dates and lists in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake.functions.vocabulary import MONEY_PATTERN, STATE_CODES, STATE_NAMES, TIMES_PATTERN


def clean(text: Column) -> Column:
    """White space as single spaces, none around; a null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def split_list(text: Column) -> Column:
    """Parts between commas, semicolons and bars, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;|]"), clean), lambda x: x != "")


def amount(text: Column) -> Column:
    """Whole dollars, of up to 32 digits: the first of two numbers joined by x or per, else the first number; none or not above zero is null."""
    t = clean(text)
    times = F.regexp_extract(t, TIMES_PATTERN, 1)
    first = F.replace(F.regexp_extract(t, MONEY_PATTERN, 1), F.lit(","), F.lit("")).try_cast("decimal(38,6)")
    return F.when(times != "", times.try_cast("decimal(33,0)")).when(first > 0, F.floor(first))


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def day(text: Column, as_of: str) -> Column:
    """The date that a text holds, without what is in brackets; today, tomorrow and yesterday count from as_of.

    Permissive: words around a date do not count. A year first, else two numbers and a year (the month first, unless it can
    only be the day), else a month's name with a day and a year. A missing day is the first, a missing month January, a
    missing year that of as_of; a year of two digits is the nearest such to as_of. Nothing of the kind, or a day that the
    month lacks, is null.
    """
    t = F.lower(F.trim(F.regexp_replace(clean(text), r"\([^)]*\)", "")))
    now = F.lit(as_of).cast("date")
    number = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit("")).cast("int")
    iso, sliced = r"\b(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?\b", r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})\b"
    packed, year = r"\b(\d{4})(\d{2})(\d{2})\b", r"\b(1[6-9]\d\d|20\d\d)\b"
    short = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:[a-z]*)\b"
    named = F.element_at(lookup_months(), F.nullif(F.regexp_extract(t, short, 1), F.lit("")))
    near = r"(?:\b(\d{1,2})(?:st|nd|rd|th)?(?: of)? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?\b)"
    of_name = F.coalesce(number(near, 1), number(near, 2), F.lit(1))
    this = F.year(now)
    full = F.when(number(sliced, 3) < 100, number(sliced, 3) + F.floor((this + 49 - number(sliced, 3)) / 100) * 100).otherwise(number(sliced, 3)).cast("int")
    a, b = number(sliced, 1), number(sliced, 2)
    made = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    found = (
        F.when(F.rlike(t, F.lit(iso)), made(number(iso, 1), number(iso, 2), F.coalesce(number(iso, 3), F.lit(1))))
        .when(F.rlike(t, F.lit(packed)), made(number(packed, 1), number(packed, 2), number(packed, 3)))
        .when(F.rlike(t, F.lit(sliced)), F.when(a > 12, made(full, b, a)).otherwise(made(full, a, b)))
        .when(named.isNotNull(), made(F.coalesce(number(year, 1), this), named, of_name))
        .when(F.rlike(t, F.lit(year)), made(number(year, 1), F.lit(1), F.lit(1)))
    )
    return F.when(t == "today", now).when(t == "tomorrow", F.date_add(now, 1)).when(t == "yesterday", F.date_sub(now, 1)).otherwise(found)


def lookup_months() -> Column:
    """A literal map from the first three letters of a month to its number."""
    return F.create_map(*[x for k, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(k + 1))])


def state_hint(url: Column) -> Column:
    """The state that an address names as /xx. in any case, in upper case."""
    return F.nullif(F.upper(F.regexp_extract(F.lower(url), r"/([a-z]{2})\.", 1)), F.lit(""))


def residency(text: Column) -> Column:
    """The state that a page asks its readers to live in: by name first, then by code."""
    low = F.lower(text)
    named = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in STATE_NAMES])
    coded = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in STATE_CODES])
    said = F.coalesce(F.when(named == "ohio", "OH").when(named == "pennsylvania", "PA"), F.upper(coded))
    return F.when(low.contains("resid") | low.contains("living"), said)  # all patterns have one of them
