from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import START, commute, hourly, rows_by, weather
from pyspark.sql import functions as F

from velotide.functions import metrics as M
from velotide.operators import calendar as CA
from velotide.operators import features as FE
from velotide.operators import forecast as FC
from velotide.operators import global_model as GM
from velotide.operators import grid as G
from velotide.operators import regression as RG
from velotide.settings import AVERAGE

DAYS = 42
WEEK = date(2024, 2, 5)


@pytest.fixture(scope="module")
def data(spark):
    names = {"A": 2.0, "B": 5.0, "C": 9.0}
    series = {s: (commute(DAYS, 10 + i, v), commute(DAYS, 20 + i, v)) for i, (s, v) in enumerate(names.items())}
    return hourly(spark, series).cache()


@pytest.fixture(scope="module")
def dims(spark):
    spine = G.hour_spine(spark, START, START + timedelta(days=DAYS)).cache()
    calendar = CA.calendar_features(spine).cache()
    return weather(spark, DAYS).cache(), calendar, CA.holidays(CA.years_of(spine))


def additive(data, dims, weeks=(WEEK,)):
    w, calendar, names = dims
    return RG.additive_forecasts(
        data, FE.regressor_frame(calendar, w), names, list(weeks), yearly=False
    )


def spoil(df, day):
    cut = F.col("ts") >= F.lit(str(day)).cast("timestamp_ntz")
    for c in ("departures", "arrivals"):
        df = df.withColumn(c, F.when(cut, 1e5).otherwise(F.col(c)))
    return df


def test_additive_curves_have_the_shape_of_their_days(data, dims):
    got = rows_by(additive(data, dims), "station_id", "ts")
    assert len(got) == 3 * 168
    day = datetime(2024, 2, 6)
    tuesday = [got[("C", day + timedelta(hours=h))]["departures"] for h in range(24)]
    saturday = [got[("C", day + timedelta(days=4, hours=h))]["departures"] for h in range(24)]
    assert min(tuesday[8], tuesday[17]) > 1.5 * tuesday[13]
    assert 12 <= int(np.argmax(saturday)) <= 16
    for row in got.values():
        assert 0 <= row["departures_lower"] <= row["departures"] <= row["departures_upper"]


def test_additive_intervals_cover_about_what_they_promise(data, dims):
    flagged = G.flag_in_service(data)
    preds = FC.attach_actuals(flagged, additive(data, dims), "additive")
    share = preds.agg(M.coverage()).first()[0]
    assert 0.7 < share < 0.95


def test_additive_fit_does_not_see_its_week_and_repeats(data, dims):
    def values(df):
        return sorted(tuple(r) for r in additive(df, dims).select("station_id", "ts", "arrivals").collect())

    once = values(data)
    assert once == values(data) == values(spoil(data, WEEK))


def test_additive_fits_of_several_weeks_are_independent(data, dims):
    both = additive(data, dims, (date(2024, 1, 29), WEEK))
    last = both.filter(F.col("test_week") == F.lit(str(WEEK)).cast("timestamp_ntz"))
    alone = additive(data, dims)
    pairs = list(zip(sorted(map(tuple, last.collect())), sorted(map(tuple, alone.collect())), strict=True))
    assert len(pairs) == 3 * 168
    for a, b in pairs:  # sums over other buckets add up in another order
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-9)


def test_horizon_guards(data, dims):
    w, calendar, _ = dims
    regressors = FE.regressor_frame(calendar, w)
    assert RG.require_horizon(regressors, [WEEK]) is regressors
    with pytest.raises(ValueError, match="week 2024-02-12"):
        RG.require_horizon(regressors, [date(2024, 2, 12)])
    with pytest.raises(ValueError, match="horizon"):
        RG.forecasts_of_day(additive(data, dims), date(2024, 2, 20))


def test_split_loses_a_week_to_lags_and_holds_out_the_last_days(data, dims):
    w, calendar, _ = dims
    table = GM.training_table(data, w, calendar, WEEK, 48)
    split = GM.validation_split(table, WEEK, 14)
    got = split.groupBy("is_validation").agg(F.count_distinct("station_id", "date").alias("n"))
    assert {r["is_validation"]: r["n"] for r in got.collect()} == {False: 3 * 14, True: 3 * 14}


def test_global_model_beats_the_average_and_does_not_see_the_future(spark, data, dims):
    w, calendar, _ = dims
    forecasts, log = GM.global_forecasts(data, w, calendar, [WEEK], val_days=7)
    flagged = G.flag_in_service(data)
    own = FC.attach_actuals(flagged, forecasts, "global")
    assert own.count() == 3 * 168 * 2 and own.agg(F.min("yhat")).first()[0] >= 0
    entry = log.first()
    assert entry["train_samples"] == 3 * 21 and entry["val_samples"] == 3 * 7
    best = min(entry["runs"], key=lambda r: r["val_mae"])
    assert entry["chosen_loss"] == best["loss"] and len(entry["runs"]) == 2
    base = FC.backtest_baselines(data, [WEEK]).filter(F.col("model") == AVERAGE)
    assert own.agg(M.mae()).first()[0] < base.agg(M.mae()).first()[0]

    first_day = F.to_date("ts") == F.lit(WEEK)
    again, _ = GM.global_forecasts(spoil(data, WEEK), w, calendar, [WEEK], val_days=7)
    pairs = forecasts.filter(first_day).alias("a").join(again.filter(first_day).alias("b"), ["station_id", "ts"])
    moved = pairs.agg(F.max(F.abs(F.col("a.departures") - F.col("b.departures"))), F.count("*")).first()
    assert moved[1] == 3 * 24 and moved[0] < 1e-6


def test_closed_shares_of_a_forecast_day_are_as_of_its_midnight(spark):
    pattern = [1] * (24 * 8) + [0] * 60 + [1] * (24 * 6 - 60)
    df = hourly(spark, {"A": (pattern, pattern)})
    got = rows_by(GM.closed_share_as_of(df, [date(2024, 1, 8)], 48), "day")
    shares = [got[datetime(2024, 1, d)]["closed_d1"] for d in range(8, 15)]
    # The closure starts on the 9th; by midnight of the 11th it is 48 hours old.
    assert shares == [0.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0]


def test_masked_losses_ignore_closed_hours(spark):
    rows = [(1.0, 2.0, True), (5.0, 0.0, False), (3.0, 3.5, True)]
    df = spark.createDataFrame(rows, "y double, yhat double, open boolean")
    l1, poisson = df.agg(
        GM.masked_mae(F.col("yhat"), F.col("open")),
        GM.masked_poisson_loss(F.ln(F.col("yhat")), F.col("open") & (F.col("yhat") > 0)),
    ).first()
    assert l1 == pytest.approx(0.75)
    assert GM.choose(
        spark.createDataFrame([("w", "l1", 0.9), ("w", "poisson", 0.9), ("v", "poisson", 0.1), ("v", "l1", 0.2)],
                              "week string, loss string, val_mae double"), ["week"]
    ).orderBy("week").select("chosen_loss").collect() == [("poisson",), ("l1",)]
