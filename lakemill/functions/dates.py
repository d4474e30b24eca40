"""Times and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(moment: Column) -> Column:
    return F.unix_micros(moment)


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# Written forms of dates, and the first year that counts; the last is the next one.
WRITTEN = ["MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
FIRST_YEAR = 1800


def publication_date(text: Column, first_year: int = FIRST_YEAR, last_year: Column | int | None = None) -> Column:
    """The first ISO date in the text (parted by - or /; one digit will do for month and day); if there is none, the whole text as a time, or as month day
    year or day month year. Null outside the years, and for an ISO date that is none."""
    last = last_year if last_year is not None else F.year(F.current_date()) + 1
    t = F.trim(text)
    iso = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
    at = lambda k: F.regexp_extract(t, iso, k)
    whole = F.try_to_date(F.concat_ws("-", at(1), F.lpad(at(2), 2, "0"), F.lpad(at(3), 2, "0")), "yyyy-MM-dd")
    moment = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    compact = F.when(t.rlike(r"^\d{8}(?:T.*)?$"), F.try_to_date(F.substring(t, 1, 8), "yyyyMMdd"))
    plain = F.initcap(F.lower(F.regexp_replace(t, r"\s+", " ")))
    written = [F.when(plain.rlike(shape), F.try_to_date(plain, form)) for form, shape in zip(WRITTEN, (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"))]
    may = F.when(plain.rlike(r"^(?:May \d{1,2},|\d{1,2} May) \d{4}$"), F.coalesce(F.try_to_date(plain, "MMMM d, yyyy"), F.try_to_date(plain, "d MMMM yyyy")))
    day = F.when(t.rlike(iso), whole).otherwise(F.coalesce(moment, compact, *written, may))
    return F.when(F.year(day).between(F.lit(first_year), last if isinstance(last, Column) else F.lit(last)), day)
