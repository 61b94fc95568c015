import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import START, commute, hourly, rows_by, weather
from pyspark.sql import functions as F

from velotide.operators import calendar as CA
from velotide.operators import features as FE
from velotide.operators import grid as G
from velotide.operators import weather as W
from velotide.registry import load


def ramp(spark, days=10):
    n = days * 24
    return hourly(spark, {"A": (range(n), [1] * n)})


def calendar_of(df):
    return CA.calendar_features(df.select("ts").distinct())


def test_lags_and_means_look_at_the_right_hours(spark):
    got = rows_by(FE.demand_features(ramp(spark)), "ts")
    row = got[datetime(2024, 1, 9, 5)]  # the 198th hour
    assert [row[f"departures_lag{n}"] for n in (24, 48, 168)] == [173, 149, 29]
    assert row["departures_same_hour_mean_7d"] == np.mean([197 - 24 * k for k in range(1, 8)])
    whole_day = np.arange(168, 192).mean()
    assert {got[datetime(2024, 1, 9, h)]["departures_prev_day_mean"] for h in range(24)} == {whole_day}
    early = got[datetime(2024, 1, 7, 23)]
    assert early["departures_same_hour_mean_7d"] is None and early["departures_lag168"] is None


def test_feature_table_joins_and_clips(spark):
    data = ramp(spark)
    w = weather(spark, 10).withColumn(
        "precip_mm", F.when(F.col("ts") == F.lit(str(START + timedelta(hours=3))).cast("timestamp_ntz"), 99.0)
        .otherwise(-1.0))
    got = rows_by(FE.build_feature_table(data, w, calendar_of(data)), "ts")
    assert len(got) == 240
    assert got[START + timedelta(hours=3)]["precip_log"] == pytest.approx(math.log1p(30))
    assert got[START]["precip_log"] == 0.0 and got[START]["is_holiday"]


def test_closed_shares_follow_days(spark):
    pattern = [1] * 24 + [0] * 60 + [1] * (24 * 9 - 60)
    flagged = G.flag_in_service(hourly(spark, {"A": (pattern, pattern)}))
    got = [(r["closed_d1"], r["closed_d7"]) for r in FE.closed_share(flagged).orderBy("date").collect()]
    assert got[:6] == [(None, None), (0.0, None), (1.0, None), (1.0, None), (0.5, None), (0.0, None)]
    assert got[8] == (0.0, 1.0)
    by_row = FE.with_closed_share(flagged).groupBy(F.to_date("ts").alias("d")).agg(
        F.max("closed_d1"), F.min("closed_d1")).orderBy("d").collect()
    assert [(r[1], r[2]) for r in by_row] == [(a, a) for a, _ in got]


def test_encoding_shapes_and_guard(spark):
    data = hourly(spark, {"A": (commute(12, 1), commute(12, 2)), "B": (commute(12, 3), commute(12, 4))})
    flagged = G.flag_in_service(data)
    table = FE.with_closed_share(FE.build_feature_table(flagged, weather(spark, 12), calendar_of(data)))
    scaling = FE.weather_scaling(table.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")))
    rows = FE.encode_station_days(table, scaling).orderBy("station_id", "date").collect()
    assert len(rows) == 2 * 5  # a week is lost to lags
    assert {len(r["x"]) for r in rows} == {24 * 11 + 15}
    assert {(len(r["y"]), len(r["mask"])) for r in rows} == {(48, 48)}
    source = rows_by(table, "station_id", "ts")
    first = source[("A", datetime(2024, 1, 8))]
    assert rows[0]["x"][0] == pytest.approx(math.log1p(first["departures_lag24"]))
    assert rows[0]["y"][:24] == [source[("A", datetime(2024, 1, 8, h))]["departures"] for h in range(24)]
    holed = table.filter(F.col("ts") != F.lit("2024-01-09 05:00:00").cast("timestamp_ntz"))
    with pytest.raises(Exception, match="24 hourly rows"):
        FE.encode_station_days(holed, scaling).collect()


def test_scaling_of_a_constant_column_is_one(spark):
    data = ramp(spark, 2)
    w = W.weather_features(weather(spark, 2).withColumn("wind_kmh", F.lit(3.0)))
    got = FE.weather_scaling(data.join(w, "ts")).first()
    assert got["wind_kmh_std"] == 1.0 and got["wind_kmh_mean"] == 3.0


def test_published_deviation_of_a_constant_column_is_zero(spark, tmp_path):
    """So much rain in every hour that the clip leaves one value: its SQL gives a deviation of 0."""
    events = (
        spark.range(24 * 30 * 70)
        .withColumn("ts", F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(hours=F.expr("int(id div 70)")))
        .select(
            F.col("id").alias("event_id"), "ts", (F.col("id") % 3).alias("user_id"),
            F.lit("error").alias("event_type"), F.lit(50.0).alias("value"),
            F.lit('{"k": 4}').alias("props"),
        )
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = load()[0]["f8_weather_scaling"](spark, str(tmp_path)).first()
    assert got["precip_log_std"] == 0.0 and got["precip_log_mean"] == round(math.log(31), 6)


def test_features_of_a_day_do_not_see_it(spark):
    """Demand from day D on is replaced: no feature of D may move."""
    data = hourly(spark, {"A": (commute(16, 1), commute(16, 2))})
    day = F.lit("2024-01-12").cast("timestamp_ntz")
    spoiled = data
    for c in ("departures", "arrivals"):
        spoiled = spoiled.withColumn(c, F.when(F.col("ts") >= day, 1e6).otherwise(F.col(c)))

    def of_day(df):
        table = FE.demand_features(df).filter(F.to_date("ts") == F.to_date(day))
        return [tuple(r) for r in table.drop("departures", "arrivals").orderBy("ts").collect()]

    assert of_day(data) == of_day(spoiled)
