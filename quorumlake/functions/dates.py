"""Dates and times as the sources write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# German names of months.
MONTHS = {"januar": 1, "februar": 2, "märz": 3, "maerz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12}
DATE = r"(\d{1,2})\.\s*([A-Za-zäöüÄÖÜ]+)\s*(\d{4})"
WINDOW = r"(?i)(\d{1,2})(?:[.:](\d{1,2}))?\s*(?:bis|-|–|—)\s*(\d{1,2})(?:[.:](\d{1,2}))?\s*Uhr"


def german_date(c: Column) -> Column:
    """The first ``19. Mai 2026`` as a date; null if there is none or it doesn't exist."""
    part = lambda i: F.regexp_extract(F.coalesce(c, F.lit("")), DATE, i)
    month = F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.lower(part(2)))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", part(3).try_cast("int"), month, part(1).try_cast("int")), "yyyy-MM-dd")


def time_window(time: Column, day: Column) -> Column:
    """``struct<start, end>`` of ``15.30 bis 20 Uhr`` on a day; past midnight the end is on the next one.

    Null without a match, out of range, or if both are equal.
    """
    t = F.coalesce(time, F.lit(""))
    part = lambda i: F.regexp_extract(t, WINDOW, i)
    number = lambda i: F.when(part(i) == "", 0).otherwise(part(i).try_cast("int"))
    h1, m1, h2, m2 = number(1), number(2), number(3), number(4)
    fine = F.rlike(t, F.lit(WINDOW)) & (h1 <= 23) & (h2 <= 23) & (m1 <= 59) & (m2 <= 59) & (h1 * 60 + m1 != h2 * 60 + m2)
    midnight = day.cast("timestamp_ntz")
    at = lambda h, m: midnight + F.make_dt_interval(F.lit(0), h, m)
    end = F.when(h2 * 60 + m2 < h1 * 60 + m1, at(h2 + 24, m2)).otherwise(at(h2, m2))
    return F.when(fine & day.isNotNull(), F.struct(at(h1, m1).alias("start"), end.alias("end")))


def german_window(start: Column, end: Column) -> Column:
    """Inverse of ``time_window`` for local timestamps; null at midnight or without a later end."""
    hour = lambda t: F.concat(F.hour(t).cast("string"), F.when(F.minute(t) > 0, F.concat(F.lit("."), F.lpad(F.minute(t).cast("string"), 2, "0"))).otherwise(""))
    midnight = (F.hour(start) == 0) & (F.minute(start) == 0)
    return F.when((end > start) & ~midnight, F.concat(hour(start), F.lit(" bis "), hour(end), F.lit(" Uhr")))


def modified_key(c: Column) -> Column:
    """An ISO timestamp as an instant, local time in Berlin where it names no offset, whatever the session's zone; what can't be read is
    the earliest, which holds a watermark back."""
    zoned = F.when(F.rlike(c, F.lit(r"(Z|[+-]\d{2}:?\d{2})$")), c)
    timed = F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}[T ][\d:.]+$")), F.concat(c, F.lit("Europe/Berlin")))
    dated = F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(c, F.lit("T00:00:00Europe/Berlin")))
    read = lambda x: x.try_cast("timestamp")
    return F.coalesce(F.try_to_timestamp(zoned), read(timed), read(dated), F.lit("0001-01-01T00:00:00Z").cast("timestamp"))


def month_starts(first: Column, last: Column) -> Column:
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def rfc2822(c: Column) -> Column:
    return F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
