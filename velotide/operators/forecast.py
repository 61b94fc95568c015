"""Baseline forecasts and the rolling-origin protocol, over all test weeks and days at once.

The protocol: each day D is forecast at midnight from rows before D, with the closure mask as it
looked at D. Instead of slicing the history per day, every history hour is sent to the forecast
hours it informs (the same weekday and hour one to eight weeks later), and one aggregation per
forecast hour turns what arrives into both baselines and the actual.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.functions.columns import days, hours, naive
from velotide.operators.grid import forecast_days, in_service, open_as_of, with_idle_runs
from velotide.settings import AVERAGE, CLOSED_MIN_HOURS, HISTORY_WEEKS, NAIVE, TARGETS


def reached_days(spark: SparkSession, week_starts: list, backs: Iterable[int]) -> DataFrame:
    """For each date, the forecast days it informs: (date, test_week, day, back), where the day is
    ``back`` days later. A handful of rows per forecast day, set by the parameters alone."""
    steps = F.array(*[F.lit(b) for b in backs])
    return spark.range(1).select(F.inline(forecast_days(week_starts))).select(
        "test_week", "day", F.explode(steps).alias("back")
    ).select("*", F.date_sub(F.to_date("day"), F.col("back")).alias("date"))


def baseline_forecasts(
    hourly: DataFrame,
    week_starts: list,
    weeks: int = HISTORY_WEEKS,
    min_hours: int | None = CLOSED_MIN_HOURS,
) -> DataFrame:
    """Wide forecasts: test_week, station_id, ts, in_service, actuals, and per target the seasonal
    naive and the historical average.

    The average skips hours that were closed as of D and is 0 without history. The naive repeats
    the hour a week earlier unless it was closed as of D; then it takes the average.
    ``min_hours=None`` treats every hour as in service (the system series).

    The windows that find closures leave the rows partitioned by station, and the aggregation by
    station and hour reuses that partitioning: no further shuffle.
    """
    if min_hours is None:
        runs, open_then, final = hourly, F.lit(True), F.lit(True)
    else:
        runs = with_idle_runs(hourly.drop("in_service"))
        open_then = open_as_of(F.col("day"), min_hours)
        final = in_service(min_hours)
    # The day itself carries the actual; the same weekday of the weeks before carries history.
    reach = reached_days(hourly.sparkSession, week_starts, range(0, 7 * weeks + 1, 7))
    dated = runs.withColumn("date", F.to_date("ts")).join(F.broadcast(reach), "date")
    sent = dated.select(
        "station_id",
        "test_week",
        (F.col("day") + hours(F.hour("ts"))).alias("slot"),
        "back",
        *TARGETS,
        open_then.alias("open_then"),
        final.alias("final"),
    )
    current = F.col("back") == 0
    usable = (F.col("back") >= 1) & F.col("open_then")
    last_week = usable & (F.col("back") == 7)
    aggregates = [
        F.count_if(current).alias("actual_rows"),
        F.max(F.when(current, F.col("final"))).alias("in_service"),
    ]
    for t in TARGETS:
        aggregates += [
            F.max(F.when(current, F.col(t))).cast("double").alias(f"{t}_y"),
            F.coalesce(F.avg(F.when(usable, F.col(t))), F.lit(0.0)).alias(f"{t}_{AVERAGE}"),
            F.max(F.when(last_week, F.col(t))).cast("double").alias(f"{t}_week_ago"),
        ]
    merged = sent.groupBy("station_id", "test_week", F.col("slot").alias("ts")).agg(*aggregates)
    naive = [
        F.coalesce(F.col(f"{t}_week_ago"), F.col(f"{t}_{AVERAGE}")).alias(f"{t}_{NAIVE}")
        for t in TARGETS
    ]
    return merged.filter("actual_rows > 0").select(
        "test_week",
        "station_id",
        "ts",
        "in_service",
        *[f"{t}_y" for t in TARGETS],
        *[f"{t}_{AVERAGE}" for t in TARGETS],
        *naive,
    )


def to_long(wide: DataFrame, models: list[str]) -> DataFrame:
    """One row per model, week, station, hour and target from columns ``{target}_{model}``.

    Models for which ``{target}_{model}_lower`` and ``_upper`` exist carry an interval; if any
    does, all rows have the two columns, NULL where there is none.
    """
    with_bounds = any(f"{t}_{m}_lower" in wide.columns for t in TARGETS for m in models)
    rows = []
    for m in models:
        for t in TARGETS:
            fields = [
                F.lit(m).alias("model"),
                F.lit(t).alias("target"),
                F.col(f"{t}_y").cast("double").alias("y"),
                F.col(f"{t}_{m}").cast("double").alias("yhat"),
            ]
            if with_bounds:
                for bound in ("lower", "upper"):
                    name = f"{t}_{m}_{bound}"
                    value = F.col(name) if name in wide.columns else F.lit(None)
                    fields.append(value.cast("double").alias(f"yhat_{bound}"))
            rows.append(F.struct(*fields))
    return wide.select(
        "test_week", "station_id", "ts", "in_service", F.inline(F.array(*rows))
    ).select(
        "model",
        "test_week",
        "station_id",
        "ts",
        "target",
        "y",
        "yhat",
        *(["yhat_lower", "yhat_upper"] if with_bounds else []),
        "in_service",
    )


def backtest_baselines(
    hourly: DataFrame,
    week_starts: list,
    weeks: int = HISTORY_WEEKS,
    min_hours: int | None = CLOSED_MIN_HOURS,
) -> DataFrame:
    """Long predictions of both baselines for every test week in one job."""
    return to_long(baseline_forecasts(hourly, week_starts, weeks, min_hours), [NAIVE, AVERAGE])


def attach_actuals(
    hourly: DataFrame, forecasts: DataFrame, model: str, week_starts: list | None = None
) -> DataFrame:
    """Long predictions of a fitted model. ``forecasts`` has test_week, station_id, ts, a column
    per target and optionally its bounds; ``hourly`` needs in_service. With ``week_starts``, the hours
    of these weeks drive a left join, so that an hour without a forecast stays and is noticed."""
    names = {
        c: f"{t}_{model}{c[len(t):]}"
        for t in TARGETS
        for c in (t, f"{t}_lower", f"{t}_upper")
        if c in forecasts.columns
    }
    renamed = [F.col(c).alias(n) for c, n in names.items()]
    wanted = forecasts.select("test_week", "station_id", "ts", *renamed)
    actual = hourly.select(
        "station_id", "ts", "in_service", *[F.col(t).alias(f"{t}_y") for t in TARGETS]
    )
    if week_starts is None:
        return to_long(actual.join(wanted, ["station_id", "ts"]), [model])
    due = hours_of_weeks(actual, week_starts)
    return to_long(due.join(wanted, ["test_week", "station_id", "ts"], "left"), [model])


def hours_of_weeks(hourly: DataFrame, week_starts: list) -> DataFrame:
    """The rows in the seven days from each start, with the start as test_week."""
    week = F.lit(None).cast("timestamp_ntz")
    for start in sorted(week_starts, reverse=True):
        inside = (F.col("ts") >= naive(start)) & (F.col("ts") < naive(start) + days(7))
        week = F.when(inside, naive(start)).otherwise(week)
    return hourly.withColumn("test_week", week).filter(F.col("test_week").isNotNull())


def require_forecasts(hourly: DataFrame, preds: DataFrame, week_starts: list) -> DataFrame:
    """Return the long predictions ``preds`` of one model, or raise unless every hour of the test
    weeks has exactly one forecast per target and there is no other. One aggregation over both sides."""
    due = hours_of_weeks(hourly.select("station_id", "ts"), week_starts)
    due = due.withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    keys = ["test_week", "station_id", "ts", "target"]
    left = due.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("p"))
    right = preds.select(*keys, F.lit(0).alias("a"), F.col("yhat").isNotNull().cast("int").alias("p"))
    counted = left.unionByName(right).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    bad = counted.filter("a <> 1 OR p <> 1").groupBy("station_id", "test_week").agg(
        F.count_if(F.col("p") < F.col("a")).alias("missing"), F.count_if(F.col("p") > F.col("a")).alias("surplus")
    )
    first = bad.orderBy("test_week", "station_id").first()
    if first:
        raise ValueError(
            f"station {first['station_id']}, week of {first['test_week']}: "
            f"{first['missing']} forecasts missing, {first['surplus']} too many"
        )
    return preds


def protocol_violations(actual: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row of counts that must all be 0 for a backtest to be scored.

    ``actual``: station_id, ts of the forecast hours. ``forecasts``: station_id, ts, day and the
    targets. Counted: forecasts outside their day, actual hours without a forecast, and keys that
    occur more than once on either side. One aggregation over the union of both sides.
    """
    no_value = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in TARGETS])
    left = actual.select("station_id", "ts", F.lit(1).alias("a"), F.lit(0).alias("p"),
                         F.lit(0).alias("outside"), F.lit(0).alias("empty"))
    right = forecasts.select(
        "station_id",
        "ts",
        F.lit(0).alias("a"),
        F.lit(1).alias("p"),
        F.when((F.col("ts") >= F.col("day")) & (F.col("ts") < F.col("day") + days(1)), 0)
        .otherwise(1)
        .alias("outside"),
        no_value.cast("int").alias("empty"),
    )
    keys = left.unionByName(right).groupBy("station_id", "ts").agg(
        F.sum("a").alias("a"), F.sum("p").alias("p"),
        F.sum("outside").alias("outside"), F.sum("empty").alias("empty"),
    )
    return keys.agg(
        F.sum("outside").alias("outside_day"),
        F.count_if((F.col("a") > 0) & ((F.col("p") == 0) | (F.col("empty") > 0))).alias("missing"),
        F.count_if((F.col("a") > 1) | (F.col("p") > 1)).alias("not_one_to_one"),
    )


def require_protocol(actual: DataFrame, forecasts: DataFrame) -> DataFrame:
    found = protocol_violations(actual, forecasts).first().asDict()
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise ValueError(f"backtest protocol broken: {broken}")
    return forecasts
