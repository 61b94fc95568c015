"""One additive regression per station: a trend that may bend, seasonal curves, holidays and regressors, with intervals.

Fits of all stations and test weeks come from sums (see ``moments``): an aggregation gives matrices the size
of the design, and only those reach numpy. The design row of an hour is made of column expressions and
shared by all stations; forecasts are its products with the coefficients, in the JVM again.

The trend is piecewise linear. Knots stand at fixed times, and a fit may use those in the first part of its history.
Their changes of slope are under an absolute penalty, found by coordinate descent on the sums after
all other columns are projected out. What lies ahead may bend as the past did: intervals come from simulated
changes of slope, as frequent and as large as those found, and noise.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.functions.columns import elapsed_seconds, naive
from velotide.operators import moments as MO
from velotide.operators.features import HOURLY_WEATHER
from velotide.operators.grid import forecast_days
from velotide.session import materialize
from velotide.settings import CLOSED_MIN_HOURS, TARGETS

# Fourier orders per period, the width of the interval, and the knots of the trend: their
# distance, the part of the history that they may bend, and the scale of their changes of slope.
DAILY_ORDER = 12
WEEKLY_ORDER = 3
YEARLY_ORDER = 10
YEAR_DAYS = 365.25
INTERVAL = 0.8
RIDGE = 1.0
KNOT_DAYS = 28
KNOT_RANGE = 0.8
SLOPE_SCALE = 0.05
DRAWS = 1000
REGRESSORS = (*HOURLY_WEATHER, "semester")

def horizon_gaps(regressors: DataFrame, week_starts: list) -> DataFrame:
    """Per test week: hours of its seven days that have no complete regressor row."""
    wanted = regressors.sparkSession.range(1).select(F.inline(forecast_days(week_starts)))
    hours = F.sequence(
        "day", F.col("day") + F.expr("INTERVAL '23' HOUR"), F.expr("INTERVAL '1' HOUR")
    )
    spine = wanted.select("test_week", F.explode(hours).alias("ts"))
    usable = regressors.dropna(subset=list(REGRESSORS)).select("ts", F.lit(1).alias("known"))
    return (
        spine.join(usable, "ts", "left")
        .groupBy("test_week")
        .agg(F.count("*").alias("hours"), F.count_if(F.col("known").isNull()).alias("missing"))
    )


def require_horizon(regressors: DataFrame, week_starts: list) -> DataFrame:
    bad = horizon_gaps(regressors, week_starts).filter("missing > 0").orderBy("test_week").first()
    if bad:
        raise ValueError(
            f"no weather or calendar for {bad['missing']} hours of the week {bad['test_week']}"
        )
    return regressors


@dataclass(frozen=True)
class Design:
    """The columns of a fit: how many plain ones, then one for each knot of the trend."""

    plain: int
    knots: tuple[float, ...]  # years after the first hour
    rows: DataFrame  # ts, x

    @property
    def k(self) -> int:
        return self.plain + len(self.knots)


def _days_since_2000() -> Column:
    return elapsed_seconds(naive("2000-01-01"), F.col("ts")) / 86400


def _fourier(period: float, order: int) -> list[Column]:
    # The angle within one turn: a curve that is 0 at all whole hours then is, but for the last digits.
    turn = _days_since_2000() % F.lit(period) / period * (2 * math.pi)
    return [F.sin(turn * k) for k in range(1, order + 1)] + [F.cos(turn * k) for k in range(1, order + 1)]


def knot_years(first: datetime, week_starts: list[date], knot_days: int) -> tuple[float, ...]:
    """Times of knots in years after the first hour, ``knot_days`` apart (0: none), as far as any fit may use
    them. They do not depend on which weeks are asked for, so that fits do not either."""
    if not knot_days:
        return ()
    longest = max((datetime.fromisoformat(str(w)) - first) / timedelta(days=1) for w in week_starts)
    return tuple(i * knot_days / 365.25 for i in range(1, int(KNOT_RANGE * longest / knot_days) + 1))


def design_of(
    regressors: DataFrame, holiday_names: DataFrame, bounds: tuple, week_starts: list[date], yearly: bool, knot_days: int
) -> Design:
    """Intercept, trend, two daily curves (working days and other days), week, year, holidays, regressors, knots,
    for every hour of the grid that has complete regressors."""
    first, last = bounds
    end = min(last, datetime.fromisoformat(str(max(week_starts))) + timedelta(days=7, hours=-1))
    hours = (
        regressors.dropna(subset=list(REGRESSORS))
        .filter(F.col("ts").between(naive(first), naive(end)))
        .join(
            holiday_names.select(F.col("date").alias("_date"), "holiday_name"),
            F.to_date("ts") == F.col("_date"),
            "left",
        )
    )
    names = [r[0] for r in hours.select("holiday_name").dropna().distinct().orderBy("holiday_name").collect()]
    trend = elapsed_seconds(naive(first), F.col("ts")) / (86400 * 365.25)
    work = F.col("workday").cast("double")
    daily = _fourier(1.0, DAILY_ORDER)
    columns = [F.lit(1.0), trend, *(c * work for c in daily), *(c * (1 - work) for c in daily), work]
    columns += _fourier(7.0, WEEKLY_ORDER) + (_fourier(YEAR_DAYS, YEARLY_ORDER) if yearly else [])
    columns += [F.coalesce((F.col("holiday_name") == n).cast("double"), F.lit(0.0)) for n in names]
    columns += [F.col(c).cast("double") for c in REGRESSORS]
    times = knot_years(first, week_starts, knot_days)
    bends = [F.greatest(trend - t, F.lit(0.0)) for t in times]
    return Design(len(columns), times, hours.select("ts", F.array(*columns, *bends).alias("x")))


def bent_ridge(sums: MO.Sums, plain: int, usable: int, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual deviation per target with changes of slope at the first ``usable`` knots.

    Half the squared error, a ridge on the plain columns, and an absolute penalty on changes of slope:
    noise variance over ``SLOPE_SCALE``, in units of the largest value over the whole history. The plain columns are
    projected out, so that coordinate descent runs over knots alone.
    """
    chosen = np.arange(plain)
    base = MO.Sums(sums.gram[:plain, :plain], sums.by_target[:plain], sums.squares, sums.largest, sums.n)
    beta, noise = MO.ridge(base, RIDGE)
    full = np.zeros((len(sums.gram), len(TARGETS)))
    full[:plain] = beta
    bends = np.arange(plain, plain + usable)
    spread = np.sqrt(np.maximum(np.diag(sums.gram)[bends], 0))
    if not usable or not (spread > 0).any():
        return full, noise
    scale = np.maximum(np.sqrt(np.maximum(np.diag(base.gram), 0) / sums.n), 1e-9)
    weights = RIDGE * scale**2
    weights[0] = 0.0
    # Regressions of the knots' columns on the plain ones.
    cross = sums.gram[np.ix_(chosen, bends)]
    shadow = np.linalg.solve(base.gram + np.diag(weights), cross)
    inner = sums.gram[np.ix_(bends, bends)] - cross.T @ shadow
    for i in range(len(TARGETS)):
        if sums.largest[i] <= 0:
            continue
        reach = sums.by_target[bends, i] - shadow.T @ sums.by_target[chosen, i]
        price = noise[i] ** 2 * span / (sums.largest[i] * SLOPE_SCALE)
        slopes = _descend(inner, reach, price)
        full[bends, i] = slopes
        full[:plain, i] = beta[:, i] - shadow @ slopes
    return full, np.sqrt(np.maximum(MO.residual(sums, full), 0) / sums.n)


def _descend(gram: np.ndarray, moments: np.ndarray, price: float, rounds: int = 2000) -> np.ndarray:
    """Least of half a quadratic form plus ``price`` times the absolute values, by coordinate descent."""
    slopes, left, size = np.zeros(len(moments)), moments.copy(), np.diag(gram)
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(size > 1e-12 * max(size.max(), 1e-300)):
            pull = left[j] + size[j] * slopes[j]
            new = math.copysign(max(abs(pull) - price, 0.0), pull) / size[j]
            if new != slopes[j]:
                left -= gram[:, j] * (new - slopes[j])
                moved = max(moved, abs(new - slopes[j]) * math.sqrt(size[j]))
                slopes[j] = new
        if moved <= 1e-9 * (1.0 + math.sqrt(float(np.abs(moments).max()))):
            break
    return slopes


def interval_offsets(
    slopes: np.ndarray, span: float, noise: float, hours: int, interval: float, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each hour ahead, as differences from the forecast. Changes of slope come at the rate of the
    knots, with Laplace sizes of the mean size found, and add up over the horizon; noise is normal."""
    reach = NormalDist().inv_cdf(0.5 + interval / 2)
    size = float(np.abs(slopes).mean()) if len(slopes) else 0.0
    if size == 0.0:
        return np.full(hours, -reach * noise), np.full(hours, reach * noise)
    draw = np.random.default_rng(seed)
    ahead = (np.arange(hours) + 1) / (24 * 365.25)
    chance = min(1.0, len(slopes) / span / (24 * 365.25))  # of a change in an hour
    changes = np.where(draw.random((DRAWS, hours)) < chance, draw.laplace(0.0, size, (DRAWS, hours)), 0.0)
    drift = np.cumsum(np.cumsum(changes, axis=1), axis=1) * (ahead[0])
    outcomes = drift + draw.normal(0.0, noise, (DRAWS, hours))
    low, high = np.quantile(outcomes, [0.5 - interval / 2, 0.5 + interval / 2], axis=0)
    return np.minimum(low, -reach * noise), np.maximum(high, reach * noise)


FIT_SCHEMA = "station_id string, test_week timestamp_ntz, " + ", ".join(
    f"{t}_beta array<double>, {t}_below array<double>, {t}_above array<double>, {t}_noise double" for t in TARGETS
)


def _fitter(weeks: list, shared: MO.SharedSums, design: tuple[int, tuple], first: datetime, interval: float) -> Callable:
    plain, knots = design

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        station, out = rows["station_id"].iloc[0], []
        for week, sums in zip(weeks, MO.sums_at(shared, rows, plain + len(knots)), strict=True):
            if sums.n < 1:
                raise ValueError(f"station {station} has no hour to learn from before {week}")
            span = (datetime.fromisoformat(str(week)) - first) / timedelta(days=365.25)
            usable = sum(k <= KNOT_RANGE * span for k in knots)
            beta, noise = bent_ridge(sums, plain, usable, span)
            row = {"station_id": station, "test_week": pd.Timestamp(week)}
            for i, t in enumerate(TARGETS):
                seed = zlib.crc32(f"{station}|{t}|{week}".encode())
                slopes = beta[plain : plain + usable, i]
                below, above = interval_offsets(slopes, span, float(noise[i]), 7 * 24, interval, seed)
                row |= {f"{t}_beta": beta[:, i], f"{t}_below": below, f"{t}_above": above, f"{t}_noise": noise[i]}
            out.append(row)
        return pd.DataFrame(out)

    return fit


def additive_fits(
    hourly: DataFrame,
    design: Design,
    week_starts: list[date],
    first: datetime,
    min_hours: int = CLOSED_MIN_HOURS,
    interval: float = INTERVAL,
) -> DataFrame:
    """One row per station and test week: coefficients in the order of the design, bounds and noise."""
    weeks = MO.sorted_cutoffs(week_starts)
    shared = MO.shared_sums(design.rows, weeks, design.k)
    rows = MO.station_sums(hourly, design.rows, weeks, design.k, min_hours)
    fit = _fitter(weeks, shared, (design.plain, design.knots), first, interval)
    return rows.groupBy("station_id").applyInPandas(fit, FIT_SCHEMA)


def additive_forecasts(
    hourly: DataFrame,
    regressors: DataFrame,
    holiday_names: DataFrame,
    week_starts: list[date],
    min_hours: int = CLOSED_MIN_HOURS,
    interval: float = INTERVAL,
    yearly: bool = True,
    knot_days: int = KNOT_DAYS,
) -> DataFrame:
    """Wide forecasts with bounds for all hours of the test weeks, fitted per station and week on
    the hours before the week that were in service as far as known then. Nothing is below 0. A
    station without such an hour cannot be forecast, which is an error.

    ``regressors``: see ``regressor_frame``; ``holiday_names``: date, holiday_name. Hours without
    complete regressors do not train; check the horizon with ``require_horizon``. ``hourly`` has all hours of
    the grid for every station.
    """
    hourly = materialize(hourly.select("station_id", "ts", *TARGETS))
    bounds = MO.grid_bounds(hourly)
    design = design_of(regressors, holiday_names, bounds, week_starts, yearly, knot_days)
    design = Design(design.plain, design.knots, materialize(design.rows))
    fits = additive_fits(hourly, design, week_starts, bounds[0], min_hours, interval)
    days_ahead = hourly.sparkSession.range(1).select(F.inline(forecast_days(MO.sorted_cutoffs(week_starts))))
    ahead = design.rows.join(F.broadcast(days_ahead), F.to_date("ts") == F.to_date("day")).select("test_week", "ts", "x")
    hour = (elapsed_seconds(F.col("test_week"), F.col("ts")) / 3600).cast("int")
    rows = fits.join(F.broadcast(ahead), "test_week").withColumn("_hour", hour)
    columns = []
    for t in TARGETS:
        centre = F.aggregate(F.zip_with(f"{t}_beta", "x", lambda b, x: b * x), F.lit(0.0), lambda a, v: a + v)
        for name, shift in ((t, F.lit(0.0)), (f"{t}_lower", F.get(f"{t}_below", F.col("_hour"))), (f"{t}_upper", F.get(f"{t}_above", F.col("_hour")))):
            columns.append(F.greatest(centre + shift, F.lit(0.0)).alias(name))
    return rows.select("test_week", "station_id", "ts", *columns)


def forecasts_of_day(forecasts: DataFrame, day: date) -> DataFrame:
    """The slice of one day; an error when no fit reaches it."""
    chosen = forecasts.filter(F.to_date("ts") == F.lit(day))
    if chosen.isEmpty():
        raise ValueError(f"{day} is outside the fitted horizon")
    return chosen
