"""Dates: parsing day-first texts, ages, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of the months.
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
# How a date is written.
_DATE = r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"


def parse_date(text: Column) -> Column:
    """timestamp_ntz of the first ``dd/mm/yy[yy] [hh:mm[:ss]]``; two-digit years are of this century; invalid: null."""
    part = lambda i: F.regexp_extract(text, _DATE, i).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.try_make_timestamp_ntz(year, part(2), part(1), zero(part(4)), zero(part(5)), zero(part(6)).cast("decimal(8,6)"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def earliest_date(text: Column) -> Column:
    """The earliest valid day-first date of a text."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1))
    return F.array_min(F.transform(found, lambda d: F.try_to_date(d, "d/M/yyyy")))


def normal_birth(text: Column) -> Column:
    """``yyyy-mm-dd`` of a birth date in either order; other texts stay."""
    dmy, ymd = r"^\s*(\d{1,2})[-/](\d{1,2})[-/](\d{4})\s*$", r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})\s*$"
    two = lambda p, i: F.lpad(F.regexp_extract(text, p, i), 2, "0")
    return (
        F.when(text.rlike(dmy), F.concat_ws("-", F.regexp_extract(text, dmy, 3), two(dmy, 2), two(dmy, 1)))
        .when(text.rlike(ymd), F.concat_ws("-", F.regexp_extract(text, ymd, 1), two(ymd, 2), two(ymd, 3)))
        .otherwise(text)
    )


def age_years(birth: Column, today: Column) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(today, birth) / 365).cast("int")


def parse_age(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)(\d{1,3})\s*a(?:ñ|n)os", 1), F.lit("")).cast("int")


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between two timestamps, floored by their time of day."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / 86_400_000_000)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_label(ts: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts)), F.lit(" "), F.year(ts).cast("string"))


def day_text(text: Column) -> Column:
    """First ten characters of a textual timestamp."""
    return F.substring(text, 1, 10)


def plain_timestamp(text: Column) -> Column:
    """A textual timestamp with a blank for the T and without fractions, as texts are compared."""
    return F.split_part(F.translate(text, "T", " "), F.lit("."), F.lit(1))
