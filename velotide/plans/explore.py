"""Exploratory tables over the daily and hourly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.plans.analysis import daytime_temperature
from velotide.plans.report import daily_rain
from velotide.settings import RAIN_MM

# Bins of the temperature curve, and the names that mark a campus station.
BIN_DEGREES = 3
BIN_RANGE = (-12, 30)
MIN_BIN_DAYS = 5
CAMPUS_NAMES = r"\bMIT\b|Harvard"


def daily_table(system: DataFrame, calendar: DataFrame, weather: DataFrame) -> DataFrame:
    """One row per day: departures, calendar, daytime temperature and precipitation."""
    per_day = system.groupBy(F.to_date("ts").alias("date")).agg(
        F.sum("departures").alias("departures")
    )
    days = calendar.groupBy(F.to_date("ts").alias("date")).agg(
        F.min_by("is_holiday", "ts").alias("is_holiday"),
        F.min_by("is_semester", "ts").alias("is_semester"),
    )
    return (
        per_day.join(days, "date", "left")
        .join(daytime_temperature(weather), "date", "left")
        .join(daily_rain(weather), "date", "left")
        .select(
            "date",
            "departures",
            F.weekday("date").alias("dow"),
            (F.weekday("date") >= 5).alias("is_weekend"),
            "is_holiday",
            "is_semester",
            "temp_c",
            "precip_mm",
            F.coalesce(F.col("precip_mm") >= RAIN_MM, F.lit(False)).alias("rainy"),
            F.year("date").alias("year"),
            F.month("date").alias("month"),
        )
    )


def demand_summary(system: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row of headline numbers: trips, range, masked and zero shares, and quantiles.

    Hourly counts are small integers, so the exact quantiles fold to few distinct values.
    """
    open_hours = F.when(F.col("in_service"), F.col("departures"))
    stations = flagged.agg(
        F.count("*").alias("station_hours"),
        F.avg((~F.col("in_service")).cast("int")).alias("masked_share"),
        F.avg((open_hours == 0).cast("int")).alias("zero_share"),
        F.percentile(open_hours, 0.5).alias("median_departures"),
        F.avg(open_hours).alias("mean_departures"),
        F.percentile(open_hours, 0.99).alias("p99_departures"),
        F.max(open_hours).alias("max_departures"),
    )
    totals = system.agg(
        F.sum("departures").alias("trips"),
        F.to_date(F.min("ts")).alias("first_day"),
        F.to_date(F.max("ts")).alias("last_day"),
    )
    return stations.select(
        *[totals.select(c).scalar().alias(c) for c in totals.columns], *stations.columns
    )


def centred_mean(daily: DataFrame, value: str = "departures", days: int = 7) -> DataFrame:
    """Mean of the ``days`` days around each day; NULL unless all of them exist.

    Each day is sent to the days it is near, and they are averaged there. A window over all days
    would need every row in one task.
    """
    reach = days // 2
    spread = daily.select(
        F.explode(F.sequence(F.date_sub("date", reach), F.date_add("date", reach))).alias("near"),
        "date",
        value,
    )
    own = F.max(F.when(F.col("near") == F.col("date"), F.col(value)))
    complete = F.when(F.count(value) == days, F.avg(value))
    return (
        spread.groupBy(F.col("near").alias("date"))
        .agg(
            own.alias(value),
            complete.alias("centred_mean"),
            F.bool_or(F.col("near") == F.col("date")).alias("_exists"),
        )
        .filter("_exists")
        .drop("_exists")
    )


def yearly_totals(daily: DataFrame, value: str = "departures") -> DataFrame:
    return (
        daily.groupBy("year")
        .agg(
            F.sum(value).alias("trips"),
            F.avg(value).alias("mean_per_day"),
            F.count("*").alias("days"),
        )
        .orderBy("year")
    )


def same_months_growth(daily: DataFrame, value: str = "departures", last_month: int = 9) -> DataFrame:
    """Trips of January to ``last_month`` per year against the first year. One row per year."""
    totals = daily.filter(F.col("month") <= last_month).groupBy("year").agg(
        F.sum(value).alias("trips")
    )
    first = totals.agg(F.min_by("trips", "year")).scalar()
    return totals.withColumn("growth", F.try_divide(F.col("trips"), first) - 1).orderBy("year")


def _mean_if(condition: Column, value: str = "departures") -> Column:
    return F.avg(F.when(condition, F.col(value)))


def hour_profile(system: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean departures per hour on weekdays and at weekends, without holidays."""
    days = calendar.select("ts", "hour", "is_weekend", "is_holiday")
    return (
        system.join(days, "ts")
        .filter(~F.col("is_holiday"))
        .groupBy("hour")
        .agg(
            _mean_if(~F.col("is_weekend")).alias("weekday"),
            _mean_if(F.col("is_weekend")).alias("weekend"),
        )
        .orderBy("hour")
    )


def peaks(profile: DataFrame) -> DataFrame:
    """One row: peak hours (the earlier on ties) and the morning to midday ratio of weekdays."""

    def peak(c: str) -> Column:
        return F.min_by("hour", F.struct(-F.col(c), F.col("hour")))

    morning = _mean_if(F.col("hour").between(7, 9), "weekday")
    midday = _mean_if(F.col("hour").between(11, 13), "weekday")
    return profile.agg(
        peak("weekday").alias("weekday_peak"),
        peak("weekend").alias("weekend_peak"),
        F.try_divide(morning, midday).alias("morning_to_midday"),
    )


def weekday_means(daily: DataFrame) -> DataFrame:
    return (
        daily.filter(~F.col("is_holiday"))
        .groupBy("dow")
        .agg(F.avg("departures").alias("departures"))
        .orderBy("dow")
    )


def monthly_means(daily: DataFrame, years: list[int], value: str = "departures") -> DataFrame:
    """Mean per day, months as rows and years as columns."""
    table = daily.groupBy("month").pivot("year", years).agg(F.avg(value))
    return table.select("month", *[F.col(str(y)).alias(f"y{y}") for y in years]).orderBy("month")


def month_extremes(daily: DataFrame, value: str = "departures") -> DataFrame:
    """One row: the months with the highest and lowest mean per day, and their ratio."""
    months = daily.groupBy("month").agg(F.avg(value).alias("mean"))
    return months.agg(
        F.min_by("month", F.struct(-F.col("mean"), F.col("month"))).alias("peak_month"),
        F.max("mean").alias("peak_mean"),
        F.min_by("month", F.struct("mean", "month")).alias("low_month"),
        F.min("mean").alias("low_mean"),
        F.try_divide(F.max("mean"), F.min("mean")).alias("ratio"),
    )


def working_days(daily: DataFrame) -> DataFrame:
    return daily.filter(~F.col("is_weekend") & ~F.col("is_holiday"))


def temperature_curve(daily: DataFrame, min_days: int = MIN_BIN_DAYS) -> DataFrame:
    """Mean trips of working days per temperature bin, dry and rainy, bins with enough days."""
    low, high = BIN_RANGE
    bin_ = F.floor(F.col("temp_c") / BIN_DEGREES) * BIN_DEGREES
    clipped = F.when(F.col("temp_c").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), bin_)))
    return (
        working_days(daily)
        .filter("temp_c IS NOT NULL")
        .groupBy(clipped.cast("int").alias("temp_bin"), "rainy")
        .agg(F.avg("departures").alias("mean"), F.count("*").alias("days"))
        .filter(F.col("days") >= min_days)
        .orderBy("temp_bin", "rainy")
    )


def rain_effect(daily: DataFrame, by: list[str]) -> DataFrame:
    """Rainy against dry working days within each group (the month): groups with both."""
    per_group = (
        working_days(daily)
        .groupBy(*by)
        .agg(_mean_if(F.col("rainy")).alias("rainy"), _mean_if(~F.col("rainy")).alias("dry"))
    )
    effect = F.try_divide(F.col("rainy"), F.col("dry")) - 1
    return per_group.withColumn("effect", effect).filter("effect IS NOT NULL")


def rain_effect_summary(effects: DataFrame) -> DataFrame:
    return effects.agg(
        F.count("*").alias("groups"),
        F.median("effect").alias("median_effect"),
        F.min("effect").alias("lowest"),
        F.max("effect").alias("highest"),
    )


def temperature_correlation(daily: DataFrame) -> DataFrame:
    trips = F.col("departures").cast("double")
    return working_days(daily).agg(F.corr("temp_c", trips).alias("correlation"))


def busiest_stations(stations: DataFrame, n: int = 15) -> DataFrame:
    return stations.orderBy(F.desc("rank_volume"), "canonical_id").limit(n)


def top_prefix(stations: DataFrame, prefix: str) -> DataFrame:
    """One row: share of the top stations in all volume, and how many IDs start with ``prefix``."""
    top = F.col("is_top")
    return stations.agg(
        F.try_divide(
            F.sum(F.when(top, F.col("rank_volume")).otherwise(0)), F.sum("rank_volume")
        ).alias("top_share"),
        F.count_if(top & F.col("canonical_id").startswith(prefix)).alias("with_prefix"),
    )


def net_flow_matrix(flagged: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean net flow per station (rows) and hour (columns) on working days in service, with the
    morning sum; missing hours count 0 in the sum."""
    days = calendar.select("ts", "hour", "is_weekend", "is_holiday")
    rows = flagged.filter("in_service").join(days, "ts").filter(
        ~F.col("is_weekend") & ~F.col("is_holiday")
    )
    table = rows.groupBy("station_id").pivot("hour", list(range(24))).agg(F.avg("net_flow"))
    named = table.select("station_id", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])
    morning = sum((F.coalesce(f"h{h}", F.lit(0.0)) for h in (8, 9)), F.coalesce("h7", F.lit(0.0)))
    return named.withColumn("morning", morning)


def morning_extremes(matrix: DataFrame, n: int = 8) -> DataFrame:
    """The n stations that drain most in the morning and the n that fill most."""
    pair = matrix.select("station_id", "morning")
    drains = pair.orderBy("morning", "station_id").limit(n).withColumn("side", F.lit("drains"))
    fills = pair.orderBy(F.desc("morning"), "station_id").limit(n).withColumn("side", F.lit("fills"))
    return drains.unionByName(fills)


def morning_counts(matrix: DataFrame, bikes: float = 10.0) -> DataFrame:
    return matrix.agg(
        F.count_if(F.col("morning") < -bikes).alias("draining"),
        F.count_if(F.col("morning") > bikes).alias("filling"),
    )


def lowest_days(daily: DataFrame, n: int = 6) -> DataFrame:
    """The n days with the fewest trips, with weather, holiday and weekday."""
    return (
        daily.orderBy("departures", "date")
        .limit(n)
        .select(
            "date",
            "departures",
            "precip_mm",
            "temp_c",
            "is_holiday",
            F.date_format("date", "EEEE").alias("weekday"),
        )
    )


def holiday_effect(daily: DataFrame) -> DataFrame:
    """One row: mean of weekday holidays against other weekdays."""
    means = daily.filter(~F.col("is_weekend")).agg(
        _mean_if(F.col("is_holiday")).alias("holiday"),
        _mean_if(~F.col("is_holiday")).alias("normal"),
    )
    return means.withColumn("effect", F.try_divide(F.col("holiday"), F.col("normal")) - 1)


def campus_share(flagged: DataFrame, stations: DataFrame, daily: DataFrame) -> DataFrame:
    """Mean share of campus stations in the departures of a working day, in and out of term."""
    campus = stations.select(
        F.col("canonical_id").alias("station_id"),
        F.coalesce(F.col("name").rlike(CAMPUS_NAMES), F.lit(False)).alias("campus"),
    )
    per_day = (
        flagged.filter("in_service")
        .groupBy("station_id", F.to_date("ts").alias("date"))
        .agg(F.sum("departures").alias("departures"))
        .join(campus, "station_id", "left")
        .groupBy("date")
        .agg(
            F.sum(F.when(F.col("campus"), F.col("departures"))).alias("on_campus"),
            F.sum("departures").alias("departures"),
        )
    )
    context = working_days(daily).select("date", "is_semester")
    return (
        per_day.join(context, "date")
        .groupBy("is_semester")
        .agg(F.avg(F.try_divide("on_campus", "departures")).alias("campus_share"))
        .orderBy("is_semester")
    )

