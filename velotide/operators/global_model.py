"""One model across all stations, fitted with Spark ML per test week.

A sample is one station, hour and target. What a station is like enters as learned columns, its
mean level per target, hour and kind of day over the training rows, so that the width of the
model does not grow with the number of stations. Two losses are tried per week, and the one with
the lower error on the validation days is kept; the test week has no part in any choice.
"""

from __future__ import annotations

import math
from datetime import date, datetime

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.functions.columns import days, midnight, naive
from velotide.operators.features import (
    DAY_DEMAND,
    HOURLY_DEMAND,
    HOURLY_WEATHER,
    build_feature_table,
    standardized,
    weather_scaling,
    with_closed_share,
)
from velotide.operators.forecast import hours_of_weeks, reached_days
from velotide.operators.grid import open_as_of, visible_before, with_idle_runs
from velotide.session import materialize
from velotide.settings import CLOSED_MIN_HOURS, TARGETS

# Days held out for validation, and the candidate losses.
VALIDATION_DAYS = 14
LOSSES = ("poisson", "l1")

SHARED = ("month_sin", "month_cos", "holiday", "semester", "closed_d1", "closed_d7")
OWN = ("lag24", "lag48", "lag168", "same_hour_mean_7d", "prev_day_mean")
NUMERIC = (*(f"own_{c}" for c in OWN), *(f"other_{c}" for c in OWN), *HOURLY_WEATHER, *SHARED,
           "station_level", "station_hour")


def closed_share_as_of(hourly: DataFrame, week_starts: list, min_hours: int) -> DataFrame:
    """Closed share on D-1 and D-7 per station and forecast day, with the mask as of D."""
    reach = reached_days(hourly.sparkSession, week_starts, (1, 7))
    runs = with_idle_runs(hourly.drop("in_service")).withColumn("date", F.to_date("ts"))
    rows = runs.join(F.broadcast(reach), "date")
    closed = (~open_as_of(F.col("day"), min_hours)).cast("int")
    return rows.groupBy("station_id", "test_week", "day").agg(
        F.avg(F.when(F.col("back") == 1, closed)).alias("closed_d1"),
        F.avg(F.when(F.col("back") == 7, closed)).alias("closed_d7"),
    )


def training_table(
    hourly: DataFrame, weather: DataFrame, calendar: DataFrame, cutoff: date | datetime, min_hours: int
) -> DataFrame:
    """Features of all hours before the cutoff, masked as of the cutoff."""
    visible = visible_before(hourly, cutoff, min_hours)
    return with_closed_share(build_feature_table(visible, weather, calendar))


def prediction_table(
    hourly: DataFrame, weather: DataFrame, calendar: DataFrame, week_starts: list, min_hours: int
) -> DataFrame:
    """Features of all hours of the test weeks. Every demand feature looks back a day or more, so
    those of day D are what blank rows for D would get; the closed shares are taken as of D."""
    shares = closed_share_as_of(hourly, week_starts, min_hours)
    near = F.lit(False)
    for start in week_starts:  # nothing looks back further than eight days
        near = near | ((F.col("ts") >= naive(start) - days(8)) & (F.col("ts") < naive(start) + days(7)))
    table = build_feature_table(hourly.drop("in_service").filter(near), weather, calendar)
    due = hours_of_weeks(table, week_starts).withColumn("day", midnight(F.col("ts")))
    return due.join(shares, ["test_week", "station_id", "day"], "left")


def _hourly_inputs() -> list[str]:
    return [*HOURLY_DEMAND, *DAY_DEMAND, *HOURLY_WEATHER, "closed_d1", "closed_d7"]


def incomplete_inputs(table: DataFrame) -> DataFrame:
    """One row: prediction rows, and those that lack an input."""
    missing = F.lit(False)
    for c in _hourly_inputs():
        missing = missing | F.col(c).isNull()
    return table.agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("incomplete"))


def validation_split(table: DataFrame, cutoff: date | datetime, val_days: int) -> DataFrame:
    """Complete station-days before the cutoff, marked as training or validation.

    The last ``val_days`` days validate. The first week has no full lags and drops out.
    """
    start = naive(cutoff) - days(val_days)
    complete = table.dropna(subset=_hourly_inputs())
    whole = complete.groupBy("station_id", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n")
    )
    kept = whole.filter("n = 24").select("station_id", "date")
    rows = complete.withColumn("date", F.to_date("ts")).join(kept, ["station_id", "date"])
    return rows.withColumn("is_validation", F.col("ts") >= start)


def _samples(table: DataFrame) -> DataFrame:
    """One row per target: its own demand columns, those of the other target, and the shared."""
    turn = F.col("month") * (2 * math.pi / 12)
    first, second = TARGETS

    def sample(own: str, other: str, index: int) -> Column:
        fields = [F.lit(own).alias("target"), (F.col("hour") + 24 * index).cast("double").alias("slot")]
        for c in OWN:
            fields.append(F.log1p(f"{own}_{c}").alias(f"own_{c}"))
            fields.append(F.log1p(f"{other}_{c}").alias(f"other_{c}"))
        fields.append(F.col(own).cast("double").alias("y"))
        return F.struct(*fields)

    return table.select(
        "station_id",
        "ts",
        *[c for c in ("is_validation", "in_service", "test_week") if c in table.columns],
        F.col("dow").cast("double").alias("dow"),
        F.when(F.col("is_weekend") | F.col("is_holiday"), 1).otherwise(0).alias("off"),
        F.sin(turn).alias("month_sin"),
        F.cos(turn).alias("month_cos"),
        F.col("is_holiday").cast("double").alias("holiday"),
        F.col("is_semester").cast("double").alias("semester"),
        "closed_d1",
        "closed_d7",
        *HOURLY_WEATHER,
        F.inline(F.array(sample(first, second, 0), sample(second, first, 1))),
    )


def _station_levels(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Learned station columns: mean log demand per target, and per target, hour and day kind."""
    open_rows = train.filter("in_service")
    level = F.avg(F.log1p("y"))
    by_station = open_rows.groupBy("station_id", "target").agg(level.alias("station_level"))
    by_hour = open_rows.groupBy("station_id", "slot", "off").agg(level.alias("station_hour"))
    return by_station, by_hour


def _with_levels(samples: DataFrame, levels: tuple[DataFrame, DataFrame]) -> DataFrame:
    by_station, by_hour = levels
    joined = samples.join(by_station, ["station_id", "target"], "left").join(
        by_hour, ["station_id", "slot", "off"], "left"
    )
    level = F.coalesce("station_level", F.lit(0.0))
    return joined.withColumns(
        {"station_level": level, "station_hour": F.coalesce("station_hour", level)}
    )


def _estimator(loss: str) -> Pipeline:
    stages = [
        OneHotEncoder(inputCols=["slot", "dow"], outputCols=["slot_v", "dow_v"], handleInvalid="keep"),
        VectorAssembler(inputCols=[*NUMERIC, "slot_v", "dow_v"], outputCol="all_features"),
        # Columns that never change in training (the month in a short history) fit nothing.
        VarianceThresholdSelector(featuresCol="all_features", outputCol="features"),
    ]
    common = {"featuresCol": "features", "weightCol": "weight", "predictionCol": "raw"}
    if loss == "poisson":
        model = GeneralizedLinearRegression(
            family="poisson", link="log", labelCol="y", regParam=1e-3, maxIter=15, **common
        )
    else:
        # The robust loss of Spark ML on log counts: like absolute error it aims at the median.
        model = LinearRegression(
            loss="huber", labelCol="log_y", regParam=1e-3, maxIter=60, solver="l-bfgs", **common
        )
    return Pipeline(stages=[*stages, model])


def _counts(loss: str) -> Column:
    value = F.col("raw") if loss == "poisson" else F.expm1("raw")
    return F.greatest(F.lit(0.0), value)


def masked_mae(yhat: Column, mask: Column, y: str = "y") -> Column:
    """Mean absolute error in which closed hours weigh nothing."""
    weight = mask.cast("double")
    return F.sum(F.abs(F.col(y) - yhat) * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def masked_poisson_loss(log_rate: Column, mask: Column, y: str = "y") -> Column:
    """Mean Poisson loss (without the constant term) in which closed hours weigh nothing."""
    weight = mask.cast("double")
    loss = F.exp(log_rate) - F.col(y) * log_rate
    return F.sum(loss * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def choose(runs: DataFrame, by: list[str]) -> DataFrame:
    """The candidate with the lowest validation error per group, the first by name on ties."""
    return runs.groupBy(*by).agg(
        F.min_by("loss", F.struct("val_mae", "loss")).alias("chosen_loss"),
        F.min("val_mae").alias("val_mae"),
    )


def fit_week(
    hourly: DataFrame,
    weather: DataFrame,
    calendar: DataFrame,
    week: date,
    val_days: int = VALIDATION_DAYS,
    min_hours: int = CLOSED_MIN_HOURS,
    losses: tuple[str, ...] = LOSSES,
) -> tuple[DataFrame, list[dict]]:
    """Forecasts of one test week (test_week, station_id, ts, targets), and a record of the fit.

    Training rows are written once before the solvers go over them again and again. Closed hours
    have weight 0.
    """
    table = validation_split(
        training_table(hourly, weather, calendar, week, min_hours), week, val_days
    )
    table = materialize(table)
    scaling = materialize(weather_scaling(table.filter("NOT is_validation")))
    samples = _samples(standardized(table, scaling))
    train_rows = samples.filter("NOT is_validation")
    levels = tuple(materialize(t) for t in _station_levels(train_rows))
    ready = _with_levels(samples, levels).withColumns(
        {"weight": F.col("in_service").cast("double"), "log_y": F.log1p("y")}
    )
    ready = materialize(ready)
    train, validation = ready.filter("NOT is_validation"), ready.filter("is_validation")
    runs, models = [], {}
    for loss in losses:
        models[loss] = _estimator(loss).fit(train)
        scored = models[loss].transform(validation)
        error = scored.agg(masked_mae(_counts(loss), F.col("in_service")).alias("e")).first()["e"]
        runs.append({"loss": loss, "val_mae": float(error)})
    chosen = min(runs, key=lambda r: (r["val_mae"], r["loss"]))["loss"]
    sizes = {r["is_validation"]: r["n"] for r in table.groupBy("is_validation").agg(
        F.count_distinct("station_id", "date").alias("n")).collect()}

    ahead = materialize(prediction_table(hourly, weather, calendar, [week], min_hours))
    gaps = incomplete_inputs(ahead).first()
    if gaps["incomplete"]:
        raise ValueError(f"week of {week}: {gaps['incomplete']} of {gaps['n_rows']} rows lack an input")
    inputs = _with_levels(_samples(standardized(ahead, scaling)), levels)
    predicted = models[chosen].transform(inputs).select(
        "test_week", "station_id", "ts", "target", _counts(chosen).alias("yhat")
    )
    wide = predicted.groupBy("test_week", "station_id", "ts").pivot("target", list(TARGETS)).agg(
        F.max("yhat")
    )
    record = {
        "cutoff": str(week),
        "train_samples": sizes.get(False, 0),
        "val_samples": sizes.get(True, 0),
        "chosen_loss": chosen,
        "runs": runs,
    }
    return wide, [record]


def global_forecasts(
    hourly: DataFrame,
    weather: DataFrame,
    calendar: DataFrame,
    week_starts: list[date],
    val_days: int = VALIDATION_DAYS,
    min_hours: int = CLOSED_MIN_HOURS,
    losses: tuple[str, ...] = LOSSES,
) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all test weeks and the log of fits. Weeks are fitted one after another, as
    each has its own cutoff; the work of a fit is distributed."""
    forecasts, log = None, []
    for week in week_starts:
        wide, records = fit_week(hourly, weather, calendar, week, val_days, min_hours, losses)
        forecasts = wide if forecasts is None else forecasts.unionByName(wide)
        log += records
    spark = hourly.sparkSession
    schema = (
        "cutoff string, train_samples long, val_samples long, chosen_loss string, "
        "runs array<struct<loss string, val_mae double>>"
    )
    return forecasts, spark.createDataFrame(log, schema)

