"""The tables behind a dashboard: one day, one window, one station, one comparison."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotide.plans.analysis import net_flow
from velotide.plans.report import order_models, scored_table, spot_check

# The two windows, and the smallest colour limit of the map.
WINDOWS = {"morning": (7, 10), "evening": (16, 19)}
MIN_COLOUR_LIMIT = 5.0


def window_net_flow(
    preds: DataFrame, model: str, day: date, hours: tuple[int, int] = WINDOWS["morning"]
) -> DataFrame:
    """Net flow per station on one day; stations closed in any hour of the window are left out."""
    chosen = preds.filter((F.col("model") == model) & (F.col("date") == F.lit(day)))
    return net_flow(chosen, ["station_id"], hours)


def rebalancing_list(flow: DataFrame, info: DataFrame, n: int = 10) -> DataFrame:
    """Where to bring bikes (largest forecast deficit) and where to free docks (largest surplus).

    The n most extreme on each side are taken first; those on the wrong side of zero are dropped
    after that, so a list can be shorter than n.
    """
    rounded = flow.join(info.select("station_id", "name"), "station_id").select(
        "name",
        "station_id",
        F.round("forecast", 1).alias("forecast"),
        F.round("actual", 1).alias("actual"),
    )
    lowest = rounded.orderBy("forecast", "station_id").limit(n).filter("forecast < 0")
    highest = rounded.orderBy(F.desc("forecast"), "station_id").limit(n).filter("forecast > 0")
    return lowest.withColumn("side", F.lit("drains")).unionByName(
        highest.withColumn("side", F.lit("fills"))
    )


def comparison_table(preds: DataFrame) -> DataFrame:
    """Pooled scores per model with skill against both baselines, in model order."""
    table = scored_table(preds.withColumn("level", F.lit("all")), ["level"])
    return table.select("model", "mae", "rmse", "wape", "skill", "skill_vs_hist_avg").orderBy(
        *order_models()
    )


def backtest_days(preds: DataFrame) -> DataFrame:
    return preds.select("date").distinct().orderBy("date")


def week_of(preds: DataFrame, day: date) -> DataFrame:
    return preds.filter(F.col("date") == F.lit(day)).select("test_week").limit(1)


def map_rows(flow: DataFrame, info: DataFrame) -> DataFrame:
    """Net flow with names and positions, the colour limit and the centre of all stations."""
    placed = flow.join(info.select("station_id", "name", "lat", "lng"), "station_id")
    limit = placed.agg(F.greatest(F.lit(MIN_COLOUR_LIMIT), F.max(F.abs("forecast")))).scalar()
    centre = info.agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    return placed.select(
        "*",
        limit.alias("colour_limit"),
        centre.select("lat").scalar().alias("centre_lat"),
        centre.select("lng").scalar().alias("centre_lng"),
    )


def day_context(preds: DataFrame) -> DataFrame:
    """Per day: the holiday, if it is one, and whether it rained."""
    seen = preds.select("date", "holiday_name", "weather").distinct()
    rainy = F.coalesce(F.col("weather") == "rainy", F.lit(False))
    return seen.groupBy("date").agg(
        F.min("holiday_name").alias("holiday_name"), F.bool_or(rainy).alias("rainy")
    )


def station_view(
    preds: DataFrame, station_id: str, test_week: str, target: str, models: list[str]
) -> DataFrame:
    """One station's week: actual, all models, interval."""
    return spot_check(preds, station_id, test_week, target, models)
