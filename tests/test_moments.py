"""Fits from sums against fits from rows, bends of the trend, and intervals."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import START, commute, hourly, weather

from velotide.operators import calendar as CA
from velotide.operators import features as FE
from velotide.operators import grid as G
from velotide.operators import moments as MO
from velotide.operators import regression as RG

DAYS = 42
WEEKS = [date(2024, 1, 29), date(2024, 2, 5)]
MIN_HOURS = 48


@pytest.fixture(scope="module")
def series():
    made = {s: [commute(DAYS, 10 + i, v), commute(DAYS, 20 + i, v)] for i, (s, v) in enumerate({"A": 2.0, "B": 5.0}.items())}
    for begin, end in ((200, 260), (630, 700), (830, 900)):  # idle runs; two of them lie across a cutoff
        for t in made["A"]:
            t[begin:end] = 0
    return made


@pytest.fixture(scope="module")
def dims(spark):
    spine = G.hour_spine(spark, START, START + timedelta(days=DAYS)).cache()
    calendar = CA.calendar_features(spine).cache()
    return FE.regressor_frame(calendar, weather(spark, DAYS)), CA.holidays(CA.years_of(spine))


def open_before(departures, arrivals, cutoff):
    """Hours in service as of an hour number, by walking through the runs."""
    idle = [d == 0 and a == 0 for d, a in zip(departures, arrivals, strict=True)]
    mask = np.ones(cutoff, bool)
    i = 0
    while i < cutoff:
        if not idle[i]:
            i += 1
            continue
        j = i
        while j < cutoff and idle[j]:
            j += 1
        if j - i >= MIN_HOURS:
            mask[i:j] = False
        i = j
    return mask


def test_coefficients_equal_those_from_rows(spark, series, dims):
    regressors, names = dims
    grid = hourly(spark, series)
    bounds = MO.grid_bounds(grid)
    design = RG.design_of(regressors, names, bounds, WEEKS, yearly=True, knot_days=0)
    fits = {(r.station_id, r.test_week): r for r in RG.additive_fits(grid, design, WEEKS, bounds[0], MIN_HOURS).collect()}
    x = np.array([r.x for r in design.rows.orderBy("ts").collect()])
    assert x.shape == (DAYS * 24, design.k)
    for station, (departures, arrivals) in series.items():
        for week in WEEKS:
            cutoff = (week - START.date()).days * 24
            mask = open_before(departures, arrivals, cutoff)
            z, y = x[:cutoff][mask], np.column_stack([departures, arrivals])[:cutoff][mask].astype(float)
            scale = np.maximum(np.sqrt((z**2).mean(axis=0)), 1e-9)
            penalty = np.full(design.k, RG.RIDGE)
            penalty[0] = 0
            beta = np.linalg.solve((z / scale).T @ (z / scale) + np.diag(penalty), (z / scale).T @ y) / scale[:, None]
            noise = np.sqrt(((y - z @ beta) ** 2).mean(axis=0))
            got = fits[station, datetime.combine(week, datetime.min.time())]
            ahead = x[cutoff : cutoff + 168]
            for i, t in enumerate(("departures", "arrivals")):
                assert np.allclose(ahead @ np.array(got[f"{t}_beta"]), ahead @ beta[:, i], atol=1e-6)
                assert got[f"{t}_noise"] == pytest.approx(noise[i], rel=1e-9)
    assert open_before(*series["A"], 28 * 24).sum() == 28 * 24 - 60


def test_history_never_leaves_the_aggregation(spark, series, dims):
    """What reaches Python is sums: the rows of the grid are aggregated before."""
    regressors, names = dims
    grid = hourly(spark, series)
    design = RG.design_of(regressors, names, MO.grid_bounds(grid), WEEKS, yearly=False, knot_days=7)
    sums = MO.station_sums(grid, design.rows, WEEKS, design.k, MIN_HOURS)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "partial_sum" in plan
    assert sums.groupBy("station_id", "bucket", "i", "j").count().filter("count > 1").isEmpty()


def test_a_station_without_the_whole_grid_is_refused(spark, series, dims):
    regressors, names = dims
    grid = hourly(spark, series).filter("NOT (station_id = 'B' AND ts = TIMESTAMP_NTZ '2024-01-10 05:00:00')")
    with pytest.raises(Exception, match="station B lacks hours"):
        RG.additive_forecasts(grid, regressors, names, WEEKS, MIN_HOURS, yearly=False).count()


def bent(days, seed, noise):
    """A level that rises, and from the middle on falls."""
    draw = np.random.default_rng(seed)
    hours = np.arange(days * 24)
    turn = len(hours) // 2
    level = 40 + 40 * np.minimum(hours, turn) / turn - 60 * np.maximum(hours - turn, 0) / turn
    return level + draw.normal(0, noise, len(hours))


def test_a_planted_change_of_slope_is_found(spark):
    days = 120
    week = date(2024, 4, 15)
    spine = G.hour_spine(spark, START, START + timedelta(days=days))
    regressors = FE.regressor_frame(CA.calendar_features(spine), weather(spark, days))
    names = CA.holidays(CA.years_of(spine))
    level = bent(days, 3, 0.3)
    grid = hourly(spark, {"A": (level, bent(days, 4, 0.3))})
    ahead = slice((week - START.date()).days * 24, (week - START.date()).days * 24 + 168)
    errors = {}
    for knots in (0, 7):
        got = RG.additive_forecasts(grid, regressors, names, [week], 48, yearly=False, knot_days=knots).toPandas()
        got = got.sort_values("ts")
        errors[knots] = np.abs(got["departures"].to_numpy() - level[ahead]).mean()
    assert errors[7] < 2.5 < 0.5 * errors[0]
    width = (got["departures_upper"] - got["departures_lower"]).to_numpy().reshape(7, 24).mean(axis=1)
    assert width[-1] > 1.05 * width[0] and (np.diff(width) > -0.2).all()
    inside = (level[ahead] >= got["departures_lower"]) & (level[ahead] <= got["departures_upper"])
    assert inside.mean() > 0.72


def test_intervals_cover_what_they_promise_on_plain_noise():
    draw = np.random.default_rng(1)
    below, above = RG.interval_offsets(np.zeros(5), 2.0, 3.0, 168, 0.8, 7)
    noise = draw.normal(0, 3, (400, 168))
    assert ((noise >= below) & (noise <= above)).mean() == pytest.approx(0.8, abs=0.01)
    again = RG.interval_offsets(np.full(9, 40.0), 2.0, 3.0, 168, 0.8, 7)
    assert (again[1] == RG.interval_offsets(np.full(9, 40.0), 2.0, 3.0, 168, 0.8, 7)[1]).all()


def test_descent_meets_the_conditions_of_its_optimum():
    draw = np.random.default_rng(5)
    rows = draw.normal(size=(200, 12)).cumsum(axis=1)
    target = rows @ np.where(np.arange(12) % 5 == 0, 3.0, 0.0) + draw.normal(size=200)
    gram, moments, price = rows.T @ rows, rows.T @ target, 400.0
    slopes = RG._descend(gram, moments, price)
    pull = moments - gram @ slopes
    assert (np.abs(pull) <= price + 1e-3).all() and 0 < (slopes != 0).sum() < 12
    assert np.allclose(pull[slopes != 0], price * np.sign(slopes[slopes != 0]), atol=1e-3)


def test_knots_do_not_depend_on_the_weeks_asked_for():
    first = datetime(2024, 1, 1)
    one, two = (RG.knot_years(first, weeks, 7) for weeks in ([date(2024, 4, 1)], [date(2024, 4, 1), date(2024, 5, 1)]))
    assert one == two[: len(one)] and len(one) == 10 and RG.knot_years(first, [date(2024, 4, 1)], 0) == ()


def test_matrices_add_up_over_cutoffs():
    rows = pd.DataFrame({"bucket": [0, 1, 1, 2], "i": [0, 0, 0, 0], "j": [0, 0, 1, 0], "value": [1.0, 2.0, 5.0, 9.0]})
    got = MO._matrices(rows, 2, 2)
    assert got.tolist() == [[[1, 0], [0, 0]], [[3, 5], [5, 0]]]
