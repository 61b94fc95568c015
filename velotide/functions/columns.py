"""Column expressions shared by the operators. All of them stay in the JVM.

Timestamps are naive wall-clock (``timestamp_ntz``). The helpers avoid ``date_trunc`` and
``timestampdiff``, which go through the session time zone and would bend around daylight saving.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000  # fixed value


def hours(n: int | Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n)


def days(n: int | Column) -> Column:
    return F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def seconds(n: int | Column) -> Column:
    whole = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), whole)


def naive(value: date | datetime | str) -> Column:
    """A wall-clock literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def midnight(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def hour_floor(ts: Column) -> Column:
    return midnight(ts) + hours(F.hour(ts))


def floor_millis(ts: Column) -> Column:
    """Drop everything below one millisecond."""
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint") % 1000
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros / F.lit(1e6).cast("decimal(18,6)"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end`` by elapsed time, for hour-aligned stamps."""
    return (end - start).cast("bigint")


# Everything that counts as white space: ASCII controls, no-break and typographic spaces.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_to_null(text: Column) -> Column:
    """Strip white space of every kind at both ends; what is then empty is NULL."""
    return F.nullif(F.btrim(text, F.lit(WHITE_SPACE)), F.lit(""))


def name_key(name: Column) -> Column:
    """Lower-cased name without anything but letters a-z and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def haversine_m(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin((F.radians(lat_b) - F.radians(lat_a)) / 2)
    half_lng = F.sin((F.radians(lng_b) - F.radians(lng_a)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * (
        half_lng * half_lng
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def monday_weekday(ts: Column) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(ts)
