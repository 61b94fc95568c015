"""Model inputs for day D from rows before D only, as columns over the hourly grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotide.operators.weather import weather_features
from velotide.settings import TARGETS

# The lags in hours, and the order of the encoded inputs.
LAGS = (24, 48, 168)
CALENDAR_COLUMNS = ("hour", "dow", "month", "is_weekend", "is_holiday", "is_semester")
HOURLY_DEMAND = tuple(
    f"{t}_{f}" for t in TARGETS for f in ("lag24", "lag48", "lag168", "same_hour_mean_7d")
)
HOURLY_WEATHER = ("temp_c", "wind_kmh", "precip_log")
DAY_DEMAND = tuple(f"{t}_prev_day_mean" for t in TARGETS)


def demand_features(hourly: DataFrame) -> DataFrame:
    """Lags, the same-hour mean of seven days (NULL if one is missing), and the previous day's
    mean. Needs a complete grid, see ``require_complete_grid``.

    On a complete grid the previous day's mean is a window expression too: the mean of the day,
    taken from the row 24 hours earlier. Windows over a station come first: the windows over its
    days find their rows where they are, so that there is one shuffle.
    """
    by_time = Window.partitionBy("station_id").orderBy("ts")
    own_day = Window.partitionBy("station_id", "_date")
    day_means = {f"_{t}_day": F.avg(t).over(own_day) for t in TARGETS}
    columns: dict[str, Column] = {}
    for t in TARGETS:
        for n in LAGS:
            columns[f"{t}_lag{n}"] = F.lag(t, n).over(by_time)
        week = [F.lag(t, 24 * k).over(by_time) for k in range(1, 8)]
        columns[f"{t}_same_hour_mean_7d"] = sum(week[1:], week[0]) / 7
    return (
        hourly.withColumn("_date", F.to_date("ts"))
        .withColumns(columns)
        .withColumns(day_means)
        .withColumns({f"{t}_prev_day_mean": F.lag(f"_{t}_day", 24).over(by_time) for t in TARGETS})
        .drop("_date", *day_means)
    )


def build_feature_table(hourly: DataFrame, weather: DataFrame, calendar: DataFrame) -> DataFrame:
    """Demand features with the calendar and weather of each hour, where they exist. Both are one
    row per hour: small next to the stations, and broadcast by size."""
    return (
        demand_features(hourly)
        .join(calendar.select("ts", *CALENDAR_COLUMNS), "ts", "left")
        .join(weather_features(weather), "ts", "left")
    )


def closed_share(flagged: DataFrame) -> DataFrame:
    """Share of closed hours one and seven days earlier, per station and date."""
    by_date = Window.partitionBy("station_id").orderBy("date")
    daily = flagged.groupBy("station_id", F.to_date("ts").alias("date")).agg(
        F.avg((~F.col("in_service")).cast("int")).alias("closed")
    )
    return daily.select(
        "station_id",
        "date",
        F.lag("closed", 1).over(by_date).alias("closed_d1"),
        F.lag("closed", 7).over(by_date).alias("closed_d7"),
    )


def with_closed_share(flagged: DataFrame) -> DataFrame:
    """The same per hourly row, without a join, on a complete grid."""
    own_day = Window.partitionBy("station_id", "_date")
    by_time = Window.partitionBy("station_id").orderBy("ts")
    closed = F.avg((~F.col("in_service")).cast("int")).over(own_day)
    return (
        flagged.withColumn("_date", F.to_date("ts"))
        .withColumn("_closed", closed)
        .withColumns(
            {
                "closed_d1": F.lag("_closed", 24).over(by_time),
                "closed_d7": F.lag("_closed", 168).over(by_time),
            }
        )
        .drop("_date", "_closed")
    )


def weather_statistics(table: DataFrame) -> DataFrame:
    """One row with mean and sample deviation per weather column, as they are."""
    aggregates = []
    for c in HOURLY_WEATHER:
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return table.agg(*aggregates)


def weather_scaling(table: DataFrame) -> DataFrame:
    """The same for use as a divisor: a deviation of 0 becomes 1."""
    stds = {
        f"{c}_std": F.when(F.col(f"{c}_std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_std"))
        for c in HOURLY_WEATHER
    }
    return weather_statistics(table).withColumns(stds)


def standardized(table: DataFrame, scaling: DataFrame) -> DataFrame:
    """Weather columns with the fitted mean and deviation applied, read as scalar subqueries."""
    return table.withColumns(
        {
            c: (F.col(c) - scaling.select(f"{c}_mean").scalar())
            / scaling.select(f"{c}_std").scalar()
            for c in HOURLY_WEATHER
        }
    )


def station_day_violations(table: DataFrame) -> DataFrame:
    """One row: station-days, and those without exactly 24 rows."""
    per_day = table.groupBy("station_id", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n")
    )
    return per_day.agg(
        F.count("*").alias("station_days"), F.count_if(F.col("n") != 24).alias("bad_station_days")
    )


def encode_station_days(table: DataFrame, scaling: DataFrame) -> DataFrame:
    """One row per station-day: inputs ``x``, targets ``y`` (24 departures, then 24 arrivals) and
    ``mask`` (1 in service). Station-days with a missing input are dropped; one without exactly
    24 hours is an error.

    ``x`` has, per hour, eight log1p demand columns and three standardized weather columns, then
    the day: two log1p means, weekday one-hot, month on a circle, holiday, term, closed shares.
    A station-day is 24 rows, so collecting one is bounded.
    """
    scaled = standardized(table, scaling)
    per_hour = F.array(
        *[F.log1p(c) for c in HOURLY_DEMAND], *[F.col(c).cast("double") for c in HOURLY_WEATHER]
    )
    turn = F.col("month") * (2 * math.pi / 12)
    per_day = F.array(
        *[F.log1p(c) for c in DAY_DEMAND],
        *[(F.col("dow") == d).cast("double") for d in range(7)],
        F.sin(turn),
        F.cos(turn),
        F.col("is_holiday").cast("double"),
        F.col("is_semester").cast("double"),
        F.col("closed_d1"),
        F.col("closed_d7"),
    )
    rows = scaled.select(
        "station_id",
        F.to_date("ts").alias("date"),
        F.struct(
            F.hour("ts").alias("hour"),
            per_hour.alias("inputs"),
            per_day.alias("day"),
            *[F.col(t).cast("double").alias(t) for t in TARGETS],
            F.col("in_service").cast("double").alias("mask"),
        ).alias("h"),
    )
    grouped = rows.groupBy("station_id", "date").agg(F.sort_array(F.collect_list("h")).alias("h"))
    checked = F.when(F.size("h") == 24, F.col("h")).otherwise(
        F.raise_error(F.lit("this day of a station lacks some of its 24 hourly rows"))
    )

    def series(field: str) -> Column:
        return F.transform("h", lambda h: h[field])

    x = F.concat(F.flatten(series("inputs")), F.col("h")[0]["day"])
    encoded = grouped.withColumn("h", checked).select(
        "station_id",
        "date",
        x.alias("x"),
        F.concat(*[series(t) for t in TARGETS]).alias("y"),
        F.concat(series("mask"), series("mask")).alias("mask"),
    )
    return encoded.filter(F.forall("x", lambda v: v.isNotNull()))


def regressor_frame(calendar: DataFrame, weather: DataFrame) -> DataFrame:
    """Hourly regressors of the additive model; only hours that have both calendar and weather."""
    workday = ~F.col("is_weekend") & ~F.col("is_holiday")
    return (
        calendar.select("ts", "is_weekend", "is_holiday", "is_semester")
        .join(weather_features(weather), "ts")
        .select(
            "ts",
            workday.alias("workday"),
            (~workday).alias("offday"),
            "temp_c",
            "precip_log",
            "wind_kmh",
            F.col("is_semester").cast("double").alias("semester"),
        )
    )
