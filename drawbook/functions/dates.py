"""Printed dates, calendar checks, ages and clock times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawbook.constants import MONTHS, PLACEHOLDER_TIMES

_SLASHED = r"(?<!\d)(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})(?!\d)"
_ISO = r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)"
_NAMED = r"\b([a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})\b"


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def folded_date_text(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"\.+\z", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def date_key(col: Column) -> Column:
    """STRUCT<y, m, d> of a printed date, NULL when no accepted form is printed. Not calendar-checked."""
    months = F.create_map(*[F.lit(part) for pair in MONTHS.items() for part in pair])

    def parts(text: Column, pattern: str) -> Column:
        return F.struct(*[F.regexp_extract(text, pattern, group).alias(f"p{group}") for group in (1, 2, 3)])

    def triple(year: Column, month: Column, day: Column) -> Column:
        return F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"))

    def slashed(p: Column, text: Column) -> Column:
        year = p["p3"].cast("int")
        return F.when(p["p3"] != "", triple(F.when(year < 100, year + 2000).otherwise(year), p["p1"], p["p2"])).otherwise(
            let(parts(text, _ISO), lambda iso: standard(iso, text)))

    def standard(p: Column, text: Column) -> Column:
        return F.when(p["p1"] != "", triple(p["p1"], p["p2"], p["p3"])).otherwise(let(parts(text, _NAMED), named))

    def named(p: Column) -> Column:
        month = F.try_element_at(months, p["p1"])
        return F.when(month.isNotNull(), triple(p["p3"], month, p["p2"]))

    # A form is tried only where those before it are not printed.
    return let(folded_date_text(col), lambda text: let(parts(text, _SLASHED), lambda p: slashed(p, text)))


def date_group(col: Column) -> Column:
    """Grouping key: the normalised date, else the folded raw text."""
    return let(date_key(col), lambda k: F.when(
        k.isNotNull(), F.format_string("%04d-%02d-%02d", k["y"], k["m"], k["d"])).otherwise(folded_date_text(col)))


def valid_day(key: Column) -> Column:
    """DATE of a key that names a calendar day, else NULL."""
    return F.to_date(F.try_to_timestamp(
        F.format_string("%04d-%02d-%02d", key["y"], key["m"], key["d"]), F.lit("yyyy-MM-dd")))


def display_day(day: Column) -> Column:
    return F.date_format(day, "MM/dd/yyyy")


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def age_on(born: Column, day: Column) -> Column:
    """Whole years by calendar comparison; NULL outside 0..120."""
    before = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(born), F.dayofmonth(born))
    age = F.year(day) - F.year(born) - F.when(before, 1).otherwise(0)
    return F.when(age.between(0, 120), age)


_CLOCK = r"^\s*(\d{1,2}):(\d{2})\s*([AaPp][Mm])?\s*\z"


def clock_minutes(col: Column) -> Column:
    """Minutes after midnight of a printed 12- or 24-hour time, NULL when it is not one."""
    hour, minute = _part(col, _CLOCK, 1).cast("int"), _part(col, _CLOCK, 2).cast("int")
    half = F.upper(F.regexp_extract(col, _CLOCK, 3))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return F.when((hour24 < 24) & (minute < 60), hour24 * 60 + minute)


def is_placeholder_time(col: Column) -> Column:
    return F.coalesce(F.regexp_extract(col, r"^\s*(\d{1,2}:\d{2})", 1).isin(PLACEHOLDER_TIMES), F.lit(False))


def in_window(minutes: Column, from_hour: Column, to_hour: Column) -> Column:
    return F.coalesce(minutes.between(from_hour * 60, to_hour * 60), F.lit(False))
