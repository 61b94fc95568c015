from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import START, commute, hourly, rows_by
from pyspark.sql import functions as F

from velotide.operators import forecast as FC
from velotide.operators import grid as G
from velotide.settings import AVERAGE, NAIVE


def traceable(spark, days=70):
    """Departures are the day's number (plus 100 at B), arrivals the hour."""
    n = days * 24
    day, hour = [i // 24 + 1 for i in range(n)], [i % 24 for i in range(n)]
    return hourly(spark, {"A": (day, hour), "B": ([d + 100 for d in day], hour)})


def monday(week):
    return (START + timedelta(weeks=week)).date()


def test_naive_repeats_last_week_and_average_takes_eight(spark):
    got = rows_by(FC.baseline_forecasts(traceable(spark), [monday(9)]), "station_id", "ts")
    assert len(got) == 2 * 168
    row = got[("A", START + timedelta(days=63, hours=7))]
    assert row[f"departures_{NAIVE}"] == 57 and row["departures_y"] == 64
    assert row[f"departures_{AVERAGE}"] == np.mean([1 + 7 * k for k in range(1, 9)])
    assert row[f"arrivals_{NAIVE}"] == row[f"arrivals_{AVERAGE}"] == 7
    assert got[("B", START + timedelta(days=65))][f"departures_{NAIVE}"] == 159


def test_a_closed_week_ago_falls_back_to_the_average(spark):
    data = traceable(spark)
    low, high = (F.lit(str(START + timedelta(days=d))).cast("timestamp_ntz") for d in (27, 30))
    shut = (F.col("station_id") == "A") & (F.col("ts") >= low) & (F.col("ts") < high)
    for c in ("departures", "arrivals"):
        data = data.withColumn(c, F.when(shut, 0.0).otherwise(F.col(c)))
    got = rows_by(FC.baseline_forecasts(data, [monday(5)]), "station_id", "ts")
    row = got[("A", START + timedelta(days=35, hours=3))]
    assert row[f"departures_{NAIVE}"] == row[f"departures_{AVERAGE}"] == np.mean([1, 8, 15, 22])
    assert got[("B", START + timedelta(days=35, hours=3))][f"departures_{NAIVE}"] == 129


def test_without_history_the_forecast_is_zero(spark):
    got = FC.baseline_forecasts(traceable(spark, 7), [START.date()]).agg(
        F.max(f"departures_{AVERAGE}"), F.max(f"arrivals_{NAIVE}"), F.count("*")
    )
    assert tuple(got.first()) == (0.0, 0.0, 336)


def test_long_rows_per_model_and_target(spark):
    preds = FC.backtest_baselines(traceable(spark), [monday(4), monday(7)])
    assert preds.count() == 2 * 168 * 2 * 2 * 2
    assert preds.columns == ["model", "test_week", "station_id", "ts", "target", "y", "yhat",
                             "in_service"]


@pytest.mark.parametrize("offset", [0, 3])
def test_demand_from_the_forecast_day_on_changes_nothing(spark, offset):
    """Everything from midnight of day D on is replaced; the forecasts for D must not move. A
    closure is under way at the cut, so the mask matters."""
    day = START + timedelta(days=49 + offset)
    counts = commute(70, 3)
    counts[(49 + offset - 3) * 24 : (49 + offset + 3) * 24] = 0
    data = hourly(spark, {"A": (counts, counts), "B": (commute(70, 4), commute(70, 5))})
    cut = F.col("ts") >= F.lit(str(day)).cast("timestamp_ntz")
    spoiled = data
    for c in ("departures", "arrivals"):
        spoiled = spoiled.withColumn(c, F.when(cut, 1e6).otherwise(F.col(c)))

    def of_day(df):
        wide = FC.baseline_forecasts(df, [monday(7)]).filter(F.to_date("ts") == F.lit(day.date()))
        models = [f"{t}_{m}" for t in ("departures", "arrivals") for m in (NAIVE, AVERAGE)]
        return sorted(tuple(r) for r in wide.select("station_id", "ts", *models).collect())

    assert of_day(data) == of_day(spoiled)
    next_week = [monday(8)]
    control = [FC.baseline_forecasts(d, next_week).agg(F.sum(f"departures_{NAIVE}")).first()[0]
               for d in (data, spoiled)]
    assert control[0] != control[1]  # later forecasts do see it


def test_protocol_guard_counts_every_kind_of_violation(spark):
    schema = "station_id string, ts timestamp_ntz, day timestamp_ntz, departures double, arrivals double"
    day = datetime(2024, 1, 8)
    hours = [day + timedelta(hours=h) for h in range(4)]
    actual = spark.createDataFrame([("A", h) for h in hours], "station_id string, ts timestamp_ntz")
    good = spark.createDataFrame([("A", h, day, 1.0, 1.0) for h in hours], schema)
    assert FC.require_protocol(actual, good) is good
    rows = [("A", hours[0], day, 1.0, 1.0), ("A", hours[0], day, 1.0, 1.0),
            ("A", hours[1], day, None, 1.0), ("A", hours[2], day - timedelta(days=1), 1.0, 1.0)]
    bad = spark.createDataFrame(rows, schema)
    found = FC.protocol_violations(actual, bad).first().asDict()
    assert found == {"outside_day": 1, "missing": 2, "not_one_to_one": 1}
    with pytest.raises(ValueError, match="protocol"):
        FC.require_protocol(actual, bad)


def test_forecast_days_are_the_seven_days_of_each_week(spark):
    weeks = [date(2024, 1, 15), date(2024, 2, 5)]
    days = spark.range(1).select(F.inline(G.forecast_days(weeks))).collect()
    assert [d["day"].date() for d in days[:7]] == [date(2024, 1, 15 + i) for i in range(7)]
    assert days[13]["day"].date() == date(2024, 2, 11) and len(days) == 14
