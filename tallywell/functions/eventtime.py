"""Dates and times a message states, checked and joined with its arrival time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywell.fixed_values import LOCAL_ZONE
from tallywell.functions.text import group1, pad2, wide_trim

TWO_DIGIT = r"^(\d{2})/(\d{2})/(\d{4})$"
LOOSE = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
ISO = r"^(\d{4})-(\d{2})-(\d{2})$"


def _parts(text: Column, pattern: str) -> list[Column]:
    return [group1(text, pattern, g).try_cast("int") for g in (1, 2, 3)]


def _slashes(day: Column, month: Column, year: Column) -> Column:
    return F.concat_ws("/", pad2(day.cast("string")), pad2(month.cast("string")), year.cast("string"))


def fix_date(date: Column) -> Column:
    """DD/MM/YYYY from DD/MM/YYYY, D/M/YYYY or ISO, else NULL.

    Only the form with a one-digit part is swapped when its month cannot be one, and that
    form is range-checked on the year alone. The calendar is not consulted: 31/02 passes.
    """
    return fix_trimmed_date(wide_trim(date))


def fix_trimmed_date(text: Column) -> Column:
    """``fix_date`` of a text without white space around it; reads the text often, so it should be a column."""
    day, month, year = (F.substring(text, at, n).try_cast("int") for at, n in ((1, 2), (4, 2), (7, 4)))
    strict = month.between(1, 12) & day.between(1, 31) & year.between(2000, 2100)
    first, second, loose_year = _parts(text, LOOSE)
    swapped = (second > 12) & first.between(1, 12) & ~((first > 12) & second.between(1, 12))
    iso_year, iso_month, iso_day = (F.substring(text, at, n).try_cast("int") for at, n in ((1, 4), (6, 2), (9, 2)))
    iso_ok = iso_month.between(1, 12) & iso_day.between(1, 31) & iso_year.between(2000, 2100)
    return (
        F.when(text.rlike(TWO_DIGIT), F.when(strict, text))
        .when(
            text.rlike(LOOSE) & loose_year.between(2000, 2100),
            F.when(swapped, _slashes(second, first, loose_year)).otherwise(
                _slashes(first, second, loose_year)
            ),
        )
        .when(text.rlike(ISO), F.when(iso_ok, _slashes(iso_day, iso_month, iso_year)))
    )


def fix_time(time: Column) -> Column:
    """HH:MM from HH:MM or H:MM, else NULL."""
    return fix_trimmed_time(wide_trim(time))


def fix_trimmed_time(text: Column) -> Column:
    """``fix_time`` of a text without white space around it."""
    hours = group1(text, r"^(\d{1,2}):\d{2}$").try_cast("int")
    minutes = group1(text, r"^\d{1,2}:(\d{2})$").try_cast("int")
    return F.when(hours.between(0, 23) & minutes.between(0, 59), F.lpad(text, 5, "0"))


def to_iso(slashed: Column) -> Column:
    """DD/MM/YYYY -> YYYY-MM-DD, without a calendar check."""
    p = F.split(slashed, "/")
    return F.concat(F.get(p, F.lit(2)), F.lit("-"), F.get(p, F.lit(1)), F.lit("-"), F.get(p, F.lit(0)))


def to_slashed(iso: Column) -> Column:
    """YYYY-MM-DD -> DD/MM/YYYY."""
    p = F.split(iso, "-")
    return F.concat(F.get(p, F.lit(2)), F.lit("/"), F.get(p, F.lit(1)), F.lit("/"), F.get(p, F.lit(0)))


def local_arrival(received_at: Column) -> Column:
    """Arrival (UTC, no zone) on the local wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), received_at)


def arrival_date(received_at: Column) -> Column:
    return F.to_date(local_arrival(received_at))


def arrival_time(received_at: Column) -> Column:
    return F.date_format(local_arrival(received_at), "HH:mm")


def choose_date(fixed: Column, received_at: Column) -> Column:
    """The fixed stated date where there is one, else the arrival date; NULL off the calendar."""
    return F.when(fixed.isNotNull(), F.try_to_date(fixed, "dd/MM/yyyy")).otherwise(
        arrival_date(received_at)
    )


def choose_time(fixed_date: Column, fixed_time: Column, received_at: Column) -> Column:
    """A stated time counts only beside a stated date."""
    return F.coalesce(F.when(fixed_date.isNotNull(), fixed_time), arrival_time(received_at))


def usage_month(ts: Column) -> Column:
    """Usage is charged to the UTC arrival month, not to the ledger date."""
    return F.date_format(ts, "yyyy-MM")


def epoch_second(ts: Column) -> Column:
    """Whole seconds since 1970 of a UTC wall-clock time, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return days * 86_400 + of_day
