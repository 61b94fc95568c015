"""Calendar columns for the hourly grid. All of it is known years ahead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month-day ranges of the university terms, both ends included, every year.
SEMESTERS = (("01-20", "05-15"), ("09-01", "12-20"))

# The public holidays of the United States and of Massachusetts.
FIXED_HOLIDAYS = (
    ("New Year's Day", 1, 1, 0),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 0),
    ("Veterans Day", 11, 11, 0),
    ("Christmas Day", 12, 25, 0),
)
WEEKDAY_HOLIDAYS = (
    ("Martin Luther King Jr. Day", 1, "MON", 3),
    ("Washington's Birthday", 2, "MON", 3),
    ("Patriots' Day", 4, "MON", 3),
    ("Labor Day", 9, "MON", 1),
    ("Columbus Day", 10, "MON", 2),
    ("Thanksgiving Day", 11, "THU", 4),
)
EVACUATION_DAY = ("Evacuation Day", 3, 17, 0)


def is_semester(ts: Column) -> Column:
    day = F.date_format(ts, "MM-dd")
    return reduce(lambda a, b: a | b, [day.between(low, high) for low, high in SEMESTERS])


def _on(month: int, day: int) -> Column:
    return F.make_date("year", F.lit(month), F.lit(day))


def _entry(day: Column, name: Column) -> Column:
    return F.struct(day.alias("date"), name.alias("holiday_name"))


def holidays(years: DataFrame, evacuation_day: bool = False) -> DataFrame:
    """Holidays (date, holiday_name) of the given years (a column ``year``), from their rules.

    A fixed holiday on a Saturday is also observed on the Friday before, one on a Sunday on the
    Monday after. One date has one row: names that meet on a date are joined. The observance of
    the following New Year may fall into a given year, so that year is looked at as well.
    """
    span = years.select(F.explode(F.array("year", F.col("year") + 1)).alias("year")).distinct()
    fixed = [*FIXED_HOLIDAYS, *([EVACUATION_DAY] if evacuation_day else [])]
    entries = []
    for name, month, day, since in fixed:
        valid = F.col("year") >= since
        own = _on(month, day)
        shift = F.when(F.weekday(own) == 5, -1).when(F.weekday(own) == 6, 1)
        entries.append(_entry(F.when(valid, own), F.lit(name)))
        entries.append(_entry(F.when(valid, F.date_add(own, shift)), F.lit(f"{name} (observed)")))
    for name, month, weekday, nth in WEEKDAY_HOLIDAYS:
        first = F.next_day(F.date_sub(_on(month, 1), 1), weekday)
        entries.append(_entry(F.date_add(first, 7 * (nth - 1)), F.lit(name)))
    memorial = F.next_day(_on(5, 24), "MON")
    entries.append(_entry(memorial, F.lit("Memorial Day")))
    dated = span.select(F.inline(F.array(*entries))).filter("date IS NOT NULL")
    named = dated.groupBy("date").agg(
        F.array_join(F.array_sort(F.collect_set("holiday_name")), "; ").alias("holiday_name")
    )
    return named.join(years.select(F.col("year")).distinct(), F.year("date") == F.col("year"), "left_semi")


def years_of(ts_rows: DataFrame) -> DataFrame:
    """All years from the first to the last time in ``ts_rows``."""
    bounds = ts_rows.agg(F.year(F.min("ts")).alias("low"), F.year(F.max("ts")).alias("high"))
    return bounds.filter("low IS NOT NULL").select(
        F.explode(F.sequence("low", "high")).alias("year")
    )


def calendar_features(ts_rows: DataFrame, evacuation_day: bool = False) -> DataFrame:
    """Hour, weekday (Monday 0), month, weekend, holiday and term per row of ``ts``."""
    named = holidays(years_of(ts_rows), evacuation_day)
    return (
        ts_rows.select("ts", F.to_date("ts").alias("date"))
        .join(named, "date", "left")
        .select(
            "ts",
            F.hour("ts").alias("hour"),
            F.weekday("ts").alias("dow"),
            F.month("ts").alias("month"),
            (F.weekday("ts") >= 5).alias("is_weekend"),
            F.col("holiday_name").isNotNull().alias("is_holiday"),
            "holiday_name",
            is_semester(F.col("ts")).alias("is_semester"),
        )
    )


def calendar_profile(calendar: DataFrame) -> DataFrame:
    return calendar.agg(
        F.count("*").alias("hours"),
        F.count_distinct(F.when(F.col("is_holiday"), F.to_date("ts"))).alias("holiday_days"),
        F.avg(F.col("is_semester").cast("int")).alias("semester_share"),
    )
