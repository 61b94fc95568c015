"""The network: gradients, masks, cutoffs, partitions, and what a vector per station is for."""

from datetime import date, timedelta

import numpy as np
import pytest
from helpers import START, commute, hourly, weather
from pyspark.sql import functions as F

from velotide.functions import metrics as M
from velotide.operators import calendar as CA
from velotide.operators import forecast as FC
from velotide.operators import global_model as GM
from velotide.operators import grid as G
from velotide.operators import network as N

DAYS = 42
WEEKS = [date(2024, 1, 29), date(2024, 2, 5)]


@pytest.fixture(scope="module")
def dims(spark):
    spine = G.hour_spine(spark, START, START + timedelta(days=DAYS))
    return weather(spark, DAYS).cache(), CA.calendar_features(spine).cache()


@pytest.fixture(scope="module")
def data(spark):
    series = {s: [commute(DAYS, 10 + i, v), commute(DAYS, 20 + i, v)] for i, (s, v) in enumerate({"A": 2.0, "B": 6.0}.items())}
    for begin, end in ((300, 360), (630, 700)):
        for t in series["A"]:
            t[begin:end] = 0
    return hourly(spark, series).cache()


@pytest.fixture(scope="module")
def days(spark, data, dims):
    index = spark.createDataFrame([("A", 0), ("B", 1)], "station_id string, station int")
    return N.station_days(data, *dims, 48).join(index, "station_id").cache()


@pytest.mark.parametrize("loss", N.LOSSES)
def test_gradient_equals_finite_differences(loss):
    draw = np.random.default_rng(3)
    shape = N.Shape(3, 7, hidden=5, vector=2)
    flat = draw.normal(0, 0.5, shape.count)
    station, x = np.array([0, 2, 2, 1]), draw.normal(size=(4, 7))
    y, mask = draw.poisson(3.0, (4, N.OUTPUTS)).astype(float), (draw.random((4, N.OUTPUTS)) < 0.7).astype(float)
    found, value, weight = N.gradient(shape, flat, loss, station, x, y, mask)
    assert weight == mask.sum()
    for k in draw.choice(shape.count, 40, replace=False):
        step = np.zeros(shape.count)
        step[k] = 1e-6
        ends = [N.gradient(shape, flat + s * step, loss, station, x, y, mask)[1] for s in (1, -1)]
        assert found[k] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-5)


def test_closed_hours_have_no_gradient():
    draw = np.random.default_rng(4)
    shape = N.Shape(2, 4, hidden=3, vector=2)
    flat, x, mask = draw.normal(size=shape.count), draw.normal(size=(2, 4)), np.ones((2, N.OUTPUTS))
    mask[:, 5] = 0
    y = draw.poisson(2.0, (2, N.OUTPUTS)).astype(float)
    spoiled = y.copy()
    spoiled[:, 5] = 1e6
    one, two = (N.gradient(shape, flat, "poisson", np.array([0, 1]), x, v, mask) for v in (y, spoiled))
    assert (one[0] == two[0]).all() and one[1:] == two[1:]


def test_inputs_are_those_known_at_the_cutoff(data, dims, days):
    """Masks and closed shares of a cutoff equal those of the table that is cut off there."""
    cutoffs = {c.week: c for c in N.read_cutoffs(days, WEEKS, 7)}
    for week in WEEKS:
        table = GM.training_table(data, *dims, week, 48)
        want = {
            (r.station_id, r.d): (r.closed, r.d1, r.d7)
            for r in table.groupBy("station_id", F.to_date("ts").alias("d"))
            .agg(F.sum((~F.col("in_service")).cast("int")).alias("closed"), F.max("closed_d1").alias("d1"), F.max("closed_d7").alias("d7"))
            .collect()
        }
        rows = days.filter(F.col("day") < cutoffs[week].day).collect()
        hour, seen = cutoffs[week].day * 24, 0
        for r in rows:
            day = date(1970, 1, 1) + timedelta(days=r.day)
            shares = tuple(np.mean(np.array(t) <= hour) for t in (r.told_1, r.told_7))
            assert (sum(t <= hour for t in r.told), *shares) == pytest.approx(want[r.station_id, day])
            seen += sum(t <= hour for t in r.told)
        assert seen > 40
        split = GM.validation_split(table, week, 7).groupBy("is_validation").agg(F.count_distinct("station_id", "date").alias("n"))
        sizes = {r.is_validation: r.n for r in split.collect()}
        assert (cutoffs[week].train_samples, cutoffs[week].val_samples) == (sizes[False], sizes[True])


def test_epoch_does_not_depend_on_partitions_or_other_weeks(days):
    cutoffs = N.read_cutoffs(days, WEEKS, 7)
    shape = N.Shape(2, len(days.first()["inputs"]) + N.WEATHER + 2)
    models = [N.Model(c, loss, shape.start(c.level, 1)) for c in cutoffs for loss in N.LOSSES]
    one = N.epoch_sums(days.coalesce(1), shape, models)
    many = N.epoch_sums(days.repartition(7), shape, models)
    alone = N.epoch_sums(days, shape, models[2:])
    for k in range(4):
        assert np.allclose(one[0][k], many[0][k], atol=1e-9) and np.allclose(one[1][k], many[1][k])
    assert np.allclose(one[0][2], alone[0][0], atol=1e-9) and one[1][0][3] > 0


def test_jobs_do_not_depend_on_the_number_of_weeks(spark, days):
    def jobs(weeks):
        context = spark.sparkContext
        group = f"weeks-{len(weeks)}"
        context.setJobGroup(group, group)
        N.train(days, N.read_cutoffs(days, weeks, 7), 2, epochs=3)
        context.setJobGroup("other", "other")
        return len(context.statusTracker().getJobIdsForGroup(group))

    assert jobs(WEEKS) == jobs(WEEKS[1:])


def spoil(df, day):
    cut = F.col("ts") >= F.lit(str(day)).cast("timestamp_ntz")
    for c in ("departures", "arrivals"):
        df = df.withColumn(c, F.when(cut, 1e5).otherwise(F.col(c)))
    return df


def test_forecasts_do_not_see_their_week(data, dims):
    def first_day(df):
        wide, _ = N.network_forecasts(df, *dims, WEEKS[:1], 7, 48, epochs=5)
        rows = wide.filter(F.to_date("ts") == F.lit(WEEKS[0])).orderBy("station_id", "ts").collect()
        return np.array([(r.departures, r.arrivals) for r in rows])

    once = first_day(data)
    assert once.shape == (48, 2) and (once >= 0).all() and np.allclose(once, first_day(spoil(data, WEEKS[0])), atol=1e-7)


def test_a_vector_per_station_learns_what_one_model_cannot(spark):
    """Half of the stations are busy on warm days and half on cold ones, by the same inputs else."""
    n, week = 119, date(2024, 4, 22)
    draw, series = np.random.default_rng(8), {}
    warmth = np.repeat(draw.choice([-1.0, 1.0], n), 24)
    rows = [(START + timedelta(hours=i), float(10 + 5 * v + draw.normal(0, 0.5)), 5.0 + i % 7, 0.0) for i, v in enumerate(warmth)]
    w = spark.createDataFrame(rows, "ts timestamp_ntz, temp_c double, wind_kmh double, precip_mm double").cache()
    for k in range(6):
        rate = 10 * np.exp((0.7 if k % 2 else -0.7) * warmth)
        series[f"S{k}"] = (draw.poisson(rate), draw.poisson(rate))
    grid = hourly(spark, series)
    calendar = CA.calendar_features(G.hour_spine(spark, START, START + timedelta(days=n)))
    flagged = G.flag_in_service(grid)

    def error(wide):
        return FC.attach_actuals(flagged, wide, "m").agg(M.mae()).first()[0]

    network, log = N.network_forecasts(grid, w, calendar, [week], 14, losses=("poisson",))
    linear, _ = GM.global_forecasts(grid, w, calendar, [week], 14, losses=("poisson",))
    assert error(network) < 0.9 * error(linear)
    assert log.first()["chosen_loss"] == "poisson" and log.first()["train_samples"] == 6 * (112 - 14 - 7)
