"""Time columns. Wall-clock zones are explicit; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def utc(wall: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(wall, zone)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def offset_minutes(ts: Column, zone: str = ZONE) -> Column:
    return ((F.unix_timestamp(local(ts, zone)) - F.unix_timestamp(ts.cast("timestamp"))) / 60).cast("long")


def iso_with_offset(ts: Column, zone: str = ZONE) -> Column:
    off = offset_minutes(ts, zone)
    sign = F.when(off < 0, "-").otherwise("+")
    return F.concat(
        F.date_format(local(ts, zone), "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad(F.floor(F.abs(off) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(off) % 60).cast("string"), 2, "0")
    )


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of `3:50P`, `12:00 AM`, `3PM`, `15:50`; null if it is no time of day."""
    pattern = r"^\s*(\d{1,2})(?::(\d{2}))?\s*([AaPp])?\.?[Mm]?\.?\s*$"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("int"), F.lit(0))
    half = F.upper(F.regexp_extract(text, pattern, 3))
    bare = (half == "") & (F.regexp_extract(text, pattern, 2) == "")
    full = F.when(half == "P", hour % 12 + 12).when(half == "A", hour % 12).otherwise(hour)
    bad = hour.isNull() | bare | (minute > 59) | F.when(half == "", hour > 23).otherwise((hour > 12) | (hour < 1))
    return F.when(~bad, full * 60 + minute).cast("long")


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def date_only(text: Column) -> Column:
    """A date of `2026-09-15`, `9/15/2026`, `9/15/26` (years from 70 are 19xx) or `Sep 15, 2026`."""
    iso = [F.regexp_extract(text, r"(\d{4})-(\d{1,2})-(\d{1,2})", k) for k in (1, 2, 3)]
    us = [F.regexp_extract(text, r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?!\d)", k) for k in (3, 1, 2)]
    named = [F.regexp_extract(F.lower(text), r"([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})", k) for k in (3, 1, 2)]
    year = us[0].try_cast("int")
    full = F.when(F.length(us[0]) == 4, year).when(year >= 70, year + 1900).otherwise(year + 2000)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), named[1]).cast("int")
    made = lambda y, m, d: F.to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))
    return F.coalesce(
        F.when(iso[0] != "", made(*iso)),
        F.when(us[0] != "", made(full, us[1], us[2])),
        F.when((named[0] != "") & (month > 0), made(named[0], month, named[2])),
    )


def season_year(day: Column) -> Column:
    """Seasons run from August: the year in which one starts."""
    return F.when(F.month(day) >= 8, F.year(day)).otherwise(F.year(day) - 1)


def rolled_end(start: Column, end: Column) -> Column:
    """An end that is not after its start belongs to the next day."""
    return F.when(end <= start, end + F.expr("INTERVAL 1 DAY")).otherwise(end)
