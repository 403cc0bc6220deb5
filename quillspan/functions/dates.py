"""Dates of machine-readable fields, months and waits; the present is always a parameter."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mrz_date(text: Column, birth: bool, as_of_year: int) -> Column:
    """Six digits as a date: a birth is not in the future, an expiry at most fifty years ahead; invalid ones are null."""
    yy, now = F.substring(text, 1, 2).try_cast("int"), as_of_year % 100
    century = F.when(yy > now, "19").otherwise("20") if birth else F.when(yy <= now + 50, "20").otherwise("19")
    return F.when(text.rlike(r"^\d{6}$"), F.try_to_date(F.concat(century, text), "yyyyMMdd"))


def month_name(day: Column) -> Column:
    return F.date_format(day, "yyyy_MM")


def retention_cutoff(today: Column, days: int) -> Column:
    return F.date_sub(today, days)


# The pattern of a date-like token, and the months' names.
DATE_TOKEN = r"\b(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}|[A-Z][a-z]+\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Z][a-z]+\.?\s+\d{4})\b"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _named(token: Column) -> Column:
    """A date whose month is a name, or its first three letters and more, before or behind the day."""
    part = lambda pattern: F.regexp_extract(token, pattern, 1)
    word = F.lower(part(r"([A-Za-z]+)"))
    month = F.array_position(F.transform(F.array(*[F.lit(m) for m in MONTHS]), lambda m: F.startswith(m, word)), F.lit(True))
    date = F.concat_ws("-", part(r"(\d{4})$"), month.cast("string"), part(r"(?:^|\s)(\d{1,2})\b"))
    return F.when((F.length(word) >= 3) & (month > 0), date.try_cast("date"))


def first_date(text: Column) -> Column:
    """The first date-like token as yyyy-MM-dd, the month before the day unless that is no date, else as it stands."""
    token = F.regexp_extract(text, DATE_TOKEN, 1)
    plain = F.translate(token, "/", "-")
    parsed = F.coalesce(*[F.try_to_date(plain, form) for form in ("yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy")], _named(token))
    return F.when(token != "", F.coalesce(parsed.cast("string"), token))
