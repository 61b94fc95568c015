"""Scored reports over long predictions (model, test_week, station_id, ts, target, y, yhat, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotide.functions import metrics as M
from velotide.settings import AVERAGE, NAIVE, RAIN_MM

# The published reports use these groups and labels.
HOUR_BANDS = (
    (0, 5, "night 0-5"),
    (6, 9, "am peak 6-9"),
    (10, 15, "midday 10-15"),
    (16, 19, "pm peak 16-19"),
    (20, 23, "evening 20-23"),
)
SEASONS = (
    ("winter", (12, 1, 2)),
    ("spring", (3, 4, 5)),
    ("summer", (6, 7, 8)),
    ("fall", (9, 10, 11)),
)


def hour_band(hour: Column) -> Column:
    chain = reduce(
        lambda done, band: done.when(hour.between(band[0], band[1]), band[2]),
        HOUR_BANDS[1:],
        F.when(hour.between(HOUR_BANDS[0][0], HOUR_BANDS[0][1]), HOUR_BANDS[0][2]),
    )
    return chain.otherwise("")


def band_rank(band: Column) -> Column:
    """Position of a band within the day, for ordering rows."""
    return F.array_position(F.array(*[F.lit(b[2]) for b in HOUR_BANDS]), band)


def season(ts: Column) -> Column:
    month = F.month(ts)
    first, *rest = SEASONS
    return reduce(
        lambda done, s: done.when(month.isin(*s[1]), s[0]),
        rest,
        F.when(month.isin(*first[1]), first[0]),
    )


def daily_rain(weather_actual: DataFrame) -> DataFrame:
    """Precipitation per calendar day."""
    return weather_actual.groupBy(F.to_date("ts").alias("date")).agg(
        F.sum("precip_mm").alias("precip_mm")
    )


def add_groups(preds: DataFrame, weather_actual: DataFrame) -> DataFrame:
    """Add day_type, season, hour_band and weather. The season is that of the test week. Days
    without any weather reading get a NULL weather."""
    rain = daily_rain(weather_actual).select(
        F.col("date").alias("_day"), (F.col("precip_mm") >= RAIN_MM).alias("_rainy")
    )
    return (
        preds.withColumn("_day", F.to_date("ts"))
        .join(rain, "_day", "left")
        .withColumn("day_type", F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday"))
        .withColumn("season", season(F.col("test_week")))
        .withColumn("hour_band", hour_band(F.hour("ts")))
        .withColumn("weather", F.when(F.col("_rainy"), "rainy").when(~F.col("_rainy"), "dry"))
        .drop("_day", "_rainy")
    )


def row_set_differences(preds: DataFrame) -> DataFrame:
    """Per model: scored rows that the baseline lacks (extra) and baseline rows it lacks (missing).

    One aggregation per row key finds which models scored it; a second one counts per model. The
    set of models is found from the rows themselves, so a model absent from all keys cannot hide.
    """
    keys = ["test_week", "station_id", "ts", "target"]
    per_key = preds.groupBy(*keys).agg(F.collect_set("model").alias("models"))
    by_models = per_key.groupBy("models").agg(F.count("*").alias("n"))
    in_baseline = F.array_contains("models", NAIVE)
    own = by_models.select(F.explode("models").alias("model"), "n", in_baseline.alias("common"))
    per_model = own.groupBy("model").agg(
        F.sum("n").alias("scored"),
        F.coalesce(F.sum(F.when(F.col("common"), F.col("n"))), F.lit(0)).alias("shared"),
    )
    reference = by_models.filter(in_baseline).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return per_model.select(
        "model",
        (F.col("scored") - F.col("shared")).alias("extra"),
        (reference - F.col("shared")).alias("missing"),
    )


def require_identical_rows(preds: DataFrame) -> DataFrame:
    """Return ``preds``, or raise when a model was scored on different rows than the baseline."""
    bad = row_set_differences(preds).filter("extra > 0 OR missing > 0").orderBy("model").first()
    if bad:
        raise ValueError(
            f"{bad['model']} and {NAIVE} cover different rows, so their scores do not compare: "
            f"{bad['extra']} extra, {bad['missing']} missing"
        )
    return preds


def scores(preds: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, WAPE and row count per model and group, in one aggregation."""
    return preds.groupBy("model", *by).agg(
        M.mae().alias("mae"),
        M.rmse().alias("rmse"),
        M.wape().alias("wape"),
        F.count("*").alias("n"),
    )


def order_models(model: Column | str = "model") -> list[Column]:
    """The seasonal naive first, then the others by name."""
    name = F.col(model) if isinstance(model, str) else model
    return [name != NAIVE, name]


def scored_table(preds: DataFrame, by: list[str]) -> DataFrame:
    """Scores with skill against both baselines of the same group, by group, then model.

    Groups without either baseline are dropped. The window runs over the few rows of the scored
    table, not over predictions.
    """
    group = Window.partitionBy(*by)

    def reference(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("mae"))).over(group)

    return (
        scores(preds, by)
        .withColumn("baseline_mae", reference(NAIVE))
        .withColumn("strong_mae", reference(AVERAGE))
        .filter("baseline_mae IS NOT NULL AND strong_mae IS NOT NULL")
        .withColumn("skill", M.skill(F.col("mae"), F.col("baseline_mae")))
        .withColumn("skill_vs_hist_avg", M.skill(F.col("mae"), F.col("strong_mae")))
        .orderBy(*by, *order_models())
    )


def wide_mae(preds: DataFrame, by: str, models: list[str]) -> DataFrame:
    """Groups as rows, models as columns, both targets pooled. Hour bands keep the day's order."""
    table = preds.groupBy(by).pivot("model", models).agg(M.mae())
    return table.orderBy(band_rank(F.col(by)) if by == "hour_band" else F.col(by))


def station_skill(preds: DataFrame) -> DataFrame:
    """Per station and model: MAE and skill against the historical average there."""
    strong = F.max(F.when(F.col("model") == AVERAGE, F.col("mae"))).over(
        Window.partitionBy("station_id")
    )
    per_station = preds.groupBy("station_id", "model").agg(M.mae().alias("mae"))
    return per_station.withColumn("skill", M.skill(F.col("mae"), strong))


def station_skill_summary(preds: DataFrame) -> DataFrame:
    """Per model: at how many stations it beats the historical average, and by how much."""
    return (
        station_skill(preds)
        .filter(F.col("model") != AVERAGE)
        .groupBy("model")
        .agg(
            F.count_if(F.col("skill") > 0).alias("better"),
            F.count("*").alias("stations"),
            F.median("skill").alias("median_skill"),
            F.min("skill").alias("lowest"),
            F.max("skill").alias("highest"),
        )
        .orderBy(*order_models())
    )


def interval_report(preds: DataFrame) -> DataFrame:
    """Coverage, mean width and rows per model for all rows and per target, season and hour band.

    One pass with grouping sets; models without intervals and empty groups do not appear.
    """
    sets = [["model"], ["model", "target"], ["model", "season"], ["model", "hour_band"]]
    label = (
        F.when(F.grouping("target") == 0, F.concat(F.lit("target: "), "target"))
        .when(F.grouping("season") == 0, F.concat(F.lit("season: "), "season"))
        .when(F.grouping("hour_band") == 0, F.concat(F.lit("hours: "), "hour_band"))
        .otherwise("all")
    )
    return (
        preds.filter("yhat_lower IS NOT NULL")
        .groupingSets(sets, "model", "target", "season", "hour_band")
        .agg(
            label.alias("group"),
            M.coverage().alias("coverage"),
            F.avg(F.col("yhat_upper") - F.col("yhat_lower")).alias("mean_width"),
            F.count("*").alias("n"),
        )
        .select("model", "group", "coverage", "mean_width", "n")
    )


def weather_sensitivity(preds: DataFrame, with_actual_weather: DataFrame) -> DataFrame:
    """MAE with forecast weather against MAE with actual weather, for models that have both."""
    forecast = preds.groupBy("model").agg(M.mae().alias("mae_forecast_weather"))
    actual = with_actual_weather.filter("in_service").groupBy("model").agg(
        M.mae().alias("mae_actual_weather")
    )
    ratio = F.try_divide(F.col("mae_actual_weather"), F.col("mae_forecast_weather"))
    return forecast.join(actual, "model").withColumn("difference", ratio - 1)


def masked_rows(all_preds: DataFrame) -> DataFrame:
    """How many station-hour-target rows of the baseline are not scored, of how many."""
    return all_preds.filter(F.col("model") == NAIVE).agg(
        F.count_if(~F.col("in_service")).alias("masked"), F.count("*").alias("all_rows")
    )


def mae_by_hour(preds: DataFrame, models: list[str]) -> DataFrame:
    return preds.groupBy(F.hour("ts").alias("hour")).pivot("model", models).agg(M.mae()).orderBy(
        "hour"
    )


def spot_check(
    preds: DataFrame, station_id: str, test_week: str, target: str, models: list[str]
) -> DataFrame:
    """One station, week and target: the actual, each model, and the interval, by hour."""
    chosen = preds.filter(
        (F.col("station_id") == station_id)
        & (F.col("test_week") == F.lit(str(test_week)).cast("timestamp_ntz"))
        & (F.col("target") == target)
    )
    columns = [F.max("y").alias("actual")]
    columns += [F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m) for m in models]
    if "yhat_lower" in preds.columns:
        columns += [F.max("yhat_lower").alias("lower"), F.max("yhat_upper").alias("upper")]
    return chosen.groupBy("ts").agg(*columns).orderBy("ts")
