"""Where and when forecasts go wrong, over enriched predictions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotide.functions import metrics as M
from velotide.plans.report import add_groups, daily_rain, order_models
from velotide.session import written
from velotide.settings import AVERAGE, TARGETS

# The morning window [7, 10), and the hours that count as daytime.
MORNING_HOURS = (7, 10)
DAYTIME = (7, 20)


def enrich(preds: DataFrame, weather_actual: DataFrame, calendar: DataFrame) -> DataFrame:
    """Report groups, the holiday of each hour, and its date and hour."""
    return (
        add_groups(preds, weather_actual)
        .join(calendar.select("ts", "is_holiday", "holiday_name"), "ts", "left")
        .withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})
    )


def station_scores(preds: DataFrame, stations: DataFrame, models: list[str]) -> DataFrame:
    """Per station: MAE and skill of each model, mean actual, name and volume; busiest first."""
    columns: list[Column] = []
    for m in models:
        miss = F.when(F.col("model") == m, F.abs(F.col("y") - F.col("yhat")))
        columns.append(F.avg(miss).alias(f"mae_{m}"))
    actual = F.avg(F.when(F.col("model") == AVERAGE, F.col("y"))).alias("mean_actual")
    per_station = preds.groupBy("station_id").agg(*columns, actual)
    skills = {
        f"skill_{m}": M.skill(F.col(f"mae_{m}"), F.col(f"mae_{AVERAGE}")) for m in models
    }
    info = stations.select(F.col("canonical_id").alias("station_id"), "name", "rank_volume")
    return (
        per_station.withColumns(skills)
        .join(info, "station_id", "left")
        .orderBy(F.desc_nulls_last("rank_volume"), "station_id")
    )


def bias_by_hour(preds: DataFrame, models: list[str]) -> DataFrame:
    return preds.groupBy("hour").pivot("model", models).agg(M.bias()).orderBy("hour")


def daily_errors(preds: DataFrame, weather_actual: DataFrame) -> DataFrame:
    """MAE per date and model with the day's holiday, trips, precipitation and weekday.

    ``actual_trips`` adds up the actuals of every model's rows, so it grows with the number of
    models; ``model_trips`` is the total of the model's own rows.
    """
    # Holidays are constant within a day: as grouping keys they leave only numbers to aggregate.
    folded = preds.groupBy("date", "model", "is_holiday", "holiday_name").agg(
        F.sum(F.abs(F.col("y") - F.col("yhat"))).alias("_miss"),
        F.sum("y").alias("_y"),
        F.count("*").alias("_n"),
    )
    per_model = folded.groupBy("date", "model").agg(
        (F.sum("_miss") / F.sum("_n")).alias("mae"),
        F.sum("_y").alias("model_trips"),
        F.min(F.col("is_holiday").cast("int")).alias("_holiday"),
        F.min("holiday_name").alias("_name"),
    )
    day = Window.partitionBy("date")
    return (
        per_model.withColumns(
            {
                "is_holiday": F.min("_holiday").over(day).cast("boolean"),
                "holiday_name": F.min("_name").over(day),
                "actual_trips": F.sum("model_trips").over(day),
            }
        )
        .drop("_holiday", "_name")
        .join(daily_rain(weather_actual), "date", "left")
        .withColumn("weekday", F.date_format("date", "EEEE"))
    )


def worst_days(daily: DataFrame, model: str, n: int = 10) -> DataFrame:
    return daily.filter(F.col("model") == model).orderBy(F.desc("mae"), "date").limit(n)


def coverage_by_hour(preds: DataFrame) -> DataFrame:
    """Coverage per hour over the rows that have an interval."""
    if "yhat_lower" not in preds.columns:
        return preds.limit(0).select("hour", F.lit(0.0).alias("coverage"))
    bounded = preds.filter("yhat_lower IS NOT NULL")
    return bounded.groupBy("hour").agg(M.coverage().alias("coverage")).orderBy("hour")


def coverage_extremes(by_hour: DataFrame) -> DataFrame:
    """One row: the hours of lowest and highest coverage, the earlier one on ties."""
    return by_hour.agg(
        F.min_by("hour", F.struct("coverage", "hour")).alias("lowest_hour"),
        F.min("coverage").alias("lowest"),
        F.min_by("hour", F.struct(-F.col("coverage"), F.col("hour"))).alias("highest_hour"),
        F.max("coverage").alias("highest"),
    )


def net_flow(rows: DataFrame, by: list[str], hours: tuple[int, int]) -> DataFrame:
    """Forecast and actual arrivals minus departures per group, for groups with every hour of the
    window for both targets, so that a partial closure cannot look like a drain.

    Sums are of decimals: those of doubles depend on the order of the rows, and a flow that lies on a
    threshold would fall on either side of it from run to run.
    """
    low, high = hours
    arrivals = F.col("target") == "arrivals"

    def signed(c: str) -> Column:
        exact = F.when(arrivals, F.col(c)).otherwise(-F.col(c)).cast("decimal(28,18)")
        return F.sum(exact).cast("double")

    return (
        rows.filter(F.col("hour").between(low, high - 1))
        .groupBy(*by)
        .agg(
            signed("yhat").alias("forecast"), signed("y").alias("actual"), F.count("*").alias("_n")
        )
        .filter(F.col("_n") == len(TARGETS) * (high - low))
        .drop("_n")
    )


def morning_net_flow(
    preds: DataFrame, model: str, hours: tuple[int, int] = MORNING_HOURS
) -> DataFrame:
    """Net flow per station and morning, on weekdays that are not holidays."""
    working = (F.weekday("ts") < 5) & ~F.coalesce("is_holiday", F.lit(False))
    chosen = preds.filter((F.col("model") == model) & working)
    return net_flow(chosen, ["station_id", "date"], hours)


def volume_thirds(scores: DataFrame, models: list[str]) -> DataFrame:
    """Median skill of each model in the quiet, middle and busy third of the stations.

    The cut points are exact quantiles of the volume, and each third includes its upper cut.
    """
    cuts = scores.agg(F.percentile("rank_volume", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    low = cuts.select(F.col("c")[0]).scalar()
    high = cuts.select(F.col("c")[1]).scalar()
    third = (
        F.when(F.col("rank_volume") <= low, "quietest")
        .when(F.col("rank_volume") <= high, "middle")
        .when(F.col("rank_volume").isNotNull(), "busiest")
    )
    medians = [F.median(f"skill_{m}").alias(f"median_skill_{m}") for m in models]
    return scores.groupBy(third.alias("volume_third")).agg(F.count("*").alias("stations"), *medians)


def skill_and_volume(scores: DataFrame, models: list[str]) -> DataFrame:
    """One row: correlation of skill with volume, and stations beaten, per model."""
    columns = [F.count("*").alias("stations")]
    for m in models:
        volume = F.col("rank_volume").cast("double")
        columns.append(F.corr(f"skill_{m}", volume).alias(f"corr_{m}"))
        columns.append(F.count_if(F.col(f"skill_{m}") > 0).alias(f"better_{m}"))
    return scores.agg(*columns)


def overall_bias(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model").agg(M.bias().alias("bias")).orderBy(*order_models())


def mae_with_skill(preds: DataFrame, by: str, models: list[str], model: str) -> DataFrame:
    """MAE per group and model with one model's skill against the historical average."""
    table = preds.groupBy(by).pivot("model", models).agg(M.mae())
    return table.withColumn("skill", M.skill(F.col(model), F.col(AVERAGE))).orderBy(by)


def most_missed(preds: DataFrame, stations: DataFrame, model: str, day: date, n: int = 5) -> DataFrame:
    """Stations whose trips on a day exceeded the forecast most."""
    chosen = preds.filter((F.col("model") == model) & (F.col("date") == F.lit(day)))
    per_station = chosen.groupBy("station_id").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat"))
    names = stations.select(F.col("canonical_id").alias("station_id"), "name")
    return (
        per_station.withColumn("missed", F.col("y") - F.col("yhat"))
        .orderBy(F.desc("missed"), "station_id")
        .limit(n)
        .join(names, "station_id", "left")
        .orderBy(F.desc("missed"), "station_id")
    )


def day_totals(preds: DataFrame, model: str) -> DataFrame:
    """Actual and forecast trips of one model per day."""
    return (
        preds.filter(F.col("model") == model)
        .groupBy("date")
        .agg(F.sum("y").alias("actual"), F.sum("yhat").alias("forecast"))
        .orderBy("date")
    )


def daytime_temperature(weather: DataFrame) -> DataFrame:
    """Mean temperature of the hours 7 to 20 per day; days without a reading then are NULL."""
    inside = F.hour("ts").between(*DAYTIME)
    return weather.groupBy(F.to_date("ts").alias("date")).agg(
        F.avg(F.when(inside, F.col("temp_c"))).alias("temp_c")
    )


def daily_mae_pivot(daily: DataFrame, dates: list[date], models: list[str]) -> DataFrame:
    chosen = daily.filter(F.col("date").isin(*dates))
    return chosen.groupBy("date").pivot("model", models).agg(F.max("mae")).orderBy("date")


def _with_average_rank(rows: DataFrame, column: str, rank: str, *, descending: bool = False) -> DataFrame:
    """``rank``, the place of ``column``: ties share their mean place, NULL has none.

    Rows are folded to one per value, and the values are dealt out in order; each task counts through
    its own range and starts where the ranges before it end. Only the ranges pass through one task.
    """
    value = F.col(column)
    counts = rows.filter(value.isNotNull()).groupBy(value.alias("_value")).agg(F.count("*").alias("_n"))
    order = F.col("_value").desc() if descending else F.col("_value").asc()
    # Written, as the bounds of the ranges are drawn anew whenever the deal is computed again.
    dealt = written(counts.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranks")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum("_n").alias("_in_range"))
    starts = ranges.select("_range", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_start"))
    within = F.sum("_n").over(Window.partitionBy("_range").orderBy(order))
    places = dealt.join(starts, "_range").select(
        "_value", (F.col("_start") + within - (F.col("_n") - 1) / 2).alias(rank)
    )
    return rows.join(places, value == F.col("_value"), "left").drop("_value")


def relative_errors(scores: DataFrame, model: str) -> DataFrame:
    """Error relative to demand per station, ranked next to skill.

    The ranking is over stations: one row each, after all predictions have been folded.
    """
    relative = F.try_divide(F.col(f"mae_{model}"), F.col("mean_actual"))
    skill = F.col(f"skill_{model}").alias("skill")
    known = written(scores.select("station_id", "name", skill, relative.alias("relative_error")), "station-errors")
    ranked = _with_average_rank(known, "skill", "skill_rank")
    ranked = _with_average_rank(ranked, "relative_error", "relative_error_rank", descending=True)
    return ranked.select("station_id", "name", "skill", "skill_rank", "relative_error", "relative_error_rank")

