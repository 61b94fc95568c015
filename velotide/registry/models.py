"""Section G, fitted models: per-station regression and the global model."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import functions as F

from velotide.functions.columns import elapsed_seconds, naive
from velotide.operators import calendar as CA
from velotide.operators import features as FE
from velotide.operators import forecast as FC
from velotide.operators import global_model as GM
from velotide.operators import grid as G
from velotide.operators import moments as MO
from velotide.operators import network as NN
from velotide.operators import regression as RG
from velotide.operators import weather as W
from velotide.plans import projection as P
from velotide.plans.report import scored_table
from velotide.registry.base import query
from velotide.registry.dims import calendar
from velotide.registry.sql import with_ctes
from velotide.session import materialize

VAL_DAYS = 3
WEEKS = list(P.WEEKS)


def filled_weather(spark, sf):
    """The hourly readings on the whole grid. Gaps of up to two hours are filled, as published; tables
    with longer gaps, as the smallest ones have, are refused by the guards of the models."""
    spine = G.hour_spine(spark, P.START, P.END)
    return W.interpolate(spine.join(P.weather(spark, sf), "ts", "left"), limit=2)


def regressors(spark, sf):
    return FE.regressor_frame(calendar(spark), filled_weather(spark, sf))


def holiday_names(spark):
    return CA.holidays(CA.years_of(G.hour_spine(spark, P.START, P.END)))


def additive(spark, sf):
    known = RG.require_horizon(regressors(spark, sf), WEEKS)
    hourly = P.station_hourly(spark, sf)
    return RG.additive_forecasts(
        hourly, known, holiday_names(spark), WEEKS, P.IDLE_HOURS, yearly=False, knot_days=4
    )


@query("g4_additive_regression")
def _(spark, sf):
    """Long predictions with intervals of one regression per station and week."""
    hourly = G.flag_in_service(P.station_hourly(spark, sf), P.IDLE_HOURS)
    return FC.attach_actuals(hourly, additive(spark, sf), "additive", WEEKS)


def small_design(spark):
    """Five columns of an hour that SQL can say as well: one, years, working day, daily curve, bent trend."""
    trend = elapsed_seconds(naive(P.START), F.col("ts")) / (86400 * 365.25)
    x = F.array(
        F.lit(1.0), trend, (F.weekday("ts") < 5).cast("double"), F.sin(F.hour("ts") * (2 * math.pi / 24)),
        F.greatest(trend - 0.02, F.lit(0.0)),
    )
    return G.hour_spine(spark, P.START, P.END).select("ts", x.alias("x"))


OPEN_ROWS = """
    SELECT r.station_id, w.test_week AS cutoff, r.departures AS y0, r.arrivals AS y1, 1.0::DOUBLE AS x0,
           (epoch(r.ts) - epoch(TIMESTAMP '2024-01-01')) / (86400 * 365.25) AS x1,
           CASE WHEN isodow(r.ts) < 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS x2, sin(hour(r.ts) * 2 * pi() / 24) AS x3,
           greatest((epoch(r.ts) - epoch(TIMESTAMP '2024-01-01')) / (86400 * 365.25) - 0.02, 0.0) AS x4
    FROM runs r JOIN (SELECT DISTINCT test_week FROM forecast_days) w ON r.ts < w.test_week
    WHERE NOT (r.idle AND epoch(least(r.run_end + INTERVAL 1 HOUR, w.test_week)) - epoch(r.run_start) >= 6 * 3600)"""
_PLACES = ["x0", "x1", "x2", "x3", "x4", "y0", "y1"]
_PAIRS = [(i, j) for j in range(7) for i in range(j + 1) if (i, j) != (5, 6)]


@query("g4_moments", with_ctes(
    "SELECT station_id, cutoff, n, p.i, p.j, p.value FROM (SELECT station_id, cutoff, CAST(count(*) AS DOUBLE) AS n, unnest(["
    + ", ".join(f"{{'i': {i}, 'j': {j}, 'value': CAST(sum({_PLACES[i]} * {_PLACES[j]}) AS DOUBLE)}}" for i, j in _PAIRS)
    + "]) AS p FROM open_rows GROUP BY 1, 2)", open_rows=OPEN_ROWS), doubles="n value")
def _(spark, sf):
    """Sums of products over the hours in service as of each week, from buckets and closed runs."""
    table = MO.moments_table(P.station_hourly(spark, sf), small_design(spark), WEEKS, 5, P.IDLE_HOURS)
    return table


@query("g4_ridge", with_ctes("""
    SELECT station_id, cutoff, target, (sy - slope * sx / scale) / n AS intercept, slope / scale AS slope,
           sqrt(greatest(syy - 2 * ((sy - slope * sx / scale) / n * sy + slope / scale * sxy)
                + (sy - slope * sx / scale) / n * (sy - slope * sx / scale) / n * n
                + 2 * (sy - slope * sx / scale) / n * slope / scale * sx + slope / scale * slope / scale * sxx, 0) / n) AS noise
    FROM (SELECT *, (sxy / scale - sx / scale * sy / n) / (sxx / scale / scale + 1 - sx / scale * sx / scale / n) AS slope
          FROM (SELECT *, sqrt(sxx / n) AS scale
                FROM (SELECT station_id, cutoff, t.target, count(*) AS n, sum(x3 + 2) AS sx, sum((x3 + 2) * (x3 + 2)) AS sxx,
                             sum(t.y) AS sy, sum(t.y * t.y) AS syy, sum((x3 + 2) * t.y) AS sxy
                      FROM (SELECT station_id, cutoff, x3, unnest([{'target': 'departures', 'y': y0}, {'target': 'arrivals', 'y': y1}]) AS t
                            FROM open_rows) GROUP BY 1, 2, 3)))""", open_rows=OPEN_ROWS),
    doubles="intercept slope noise")
def _(spark, sf):
    """Ridge with one column besides the intercept, solved from the sums."""
    design = small_design(spark).select("ts", F.array(F.lit(1.0), F.get("x", F.lit(3)) + 2).alias("x"))
    found = MO.ridge_table(P.station_hourly(spark, sf), design, WEEKS, 2, P.IDLE_HOURS, 1.0)
    return found.select(
        "station_id", "cutoff", "target", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("slope"), "noise"
    )


def contract(preds):
    """One row of counts and sums that hold for any model: rows, what they span, and what must not be."""
    bad = F.coalesce((F.col("yhat") < 0) | F.isnan("yhat"), F.lit(True))
    if "yhat_lower" in preds.columns:
        ordered = (F.col("yhat_lower") >= 0) & (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
        bad = bad | ~F.coalesce(ordered, F.lit(False))
    return preds.agg(
        F.count("*").alias("n_rows"), F.count_distinct("station_id").alias("stations"),
        F.count_distinct("ts").alias("n_hours"), F.count_distinct("test_week").alias("weeks"),
        F.sum("y").cast("double").alias("y"), F.count_if("in_service").alias("in_service"), F.count_if(bad).alias("bad"),
    )


CONTRACT = """
    SELECT 2 * count(*) AS n_rows, count(DISTINCT s.station_id) AS stations, count(DISTINCT s.ts) AS n_hours,
           count(DISTINCT s.test_week) AS weeks, CAST(sum(s.departures + s.arrivals) AS DOUBLE) AS y,
           2 * count(*) FILTER (WHERE f.in_service) AS in_service, CAST(0 AS BIGINT) AS bad
    FROM slots s JOIN flagged f ON f.station_id = s.station_id AND f.ts = s.ts"""


@query("g4_contract", with_ctes(CONTRACT), doubles="y")
def _(spark, sf):
    """The regressions forecast every station and hour once, with ordered bounds that are not below 0."""
    hourly = G.flag_in_service(P.station_hourly(spark, sf), P.IDLE_HOURS)
    return contract(FC.attach_actuals(hourly, additive(spark, sf), "additive", WEEKS))


@query("g5_horizon", with_ctes("""
    SELECT d.test_week, count(*) * 24 AS hours, CAST(0 AS BIGINT) AS missing
    FROM forecast_days d GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    return RG.horizon_gaps(regressors(spark, sf), WEEKS)


@query("g5_horizon_before_filling", with_ctes("""
    SELECT d.test_week, count(*) AS hours, count(*) FILTER (WHERE w.temp_c IS NULL) AS missing
    FROM forecast_days d JOIN spine h ON h.ts >= d.day AND h.ts < d.day + INTERVAL 1 DAY
    LEFT JOIN weather w ON w.ts = h.ts GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    return RG.horizon_gaps(FE.regressor_frame(calendar(spark), P.weather(spark, sf)), WEEKS)


@query("g5_wide_forecasts")
def _(spark, sf):
    """The forecasts of one day, cut from the fitted horizon."""
    return RG.forecasts_of_day(materialize(additive(spark, sf)), date(2024, 1, 17))


def global_model(spark, sf):
    hourly = materialize(P.station_hourly(spark, sf))
    weather = materialize(filled_weather(spark, sf))
    return hourly, *GM.global_forecasts(
        hourly, weather, calendar(spark), WEEKS, VAL_DAYS, P.IDLE_HOURS
    )


@query("g6_global_model")
def _(spark, sf):
    """Long predictions of one model over all stations."""
    hourly, forecasts, _ = global_model(spark, sf)
    return FC.attach_actuals(G.flag_in_service(hourly, P.IDLE_HOURS), forecasts, "global", WEEKS)


def network(spark, sf, epochs=40):
    hourly = materialize(P.station_hourly(spark, sf))
    return hourly, *NN.network_forecasts(
        hourly, filled_weather(spark, sf), calendar(spark), WEEKS, VAL_DAYS, P.IDLE_HOURS, epochs=epochs
    )


@query("g6_network")
def _(spark, sf):
    """Long predictions of the network with a learned vector per station."""
    hourly, forecasts, _ = network(spark, sf)
    return FC.attach_actuals(G.flag_in_service(hourly, P.IDLE_HOURS), forecasts, "network", WEEKS)


@query("g6_network_contract", with_ctes(CONTRACT), doubles="y")
def _(spark, sf):
    """The network forecasts every station and hour once, never below 0."""
    hourly, forecasts, _ = network(spark, sf, epochs=2)
    return contract(FC.attach_actuals(G.flag_in_service(hourly, P.IDLE_HOURS), forecasts, "network", WEEKS))


@query("g6_contract", with_ctes(CONTRACT), doubles="y")
def _(spark, sf):
    """The generalised linear model forecasts every station and hour once, never below 0."""
    hourly, forecasts, _ = global_model(spark, sf)
    return contract(FC.attach_actuals(G.flag_in_service(hourly, P.IDLE_HOURS), forecasts, "global", WEEKS))


@query("g7_masked_losses", with_ctes("""
    SELECT model, target,
           sum(abs(y - yhat)) FILTER (WHERE in_service) / count(*) FILTER (WHERE in_service) AS l1,
           sum(yhat + 0.1 - y * ln(yhat + 0.1)) FILTER (WHERE in_service)
             / count(*) FILTER (WHERE in_service) AS poisson
    FROM all_preds GROUP BY 1, 2"""), doubles="l1 poisson")  # fmt: skip
def _(spark, sf):
    """Both losses with closed hours at weight 0, for forecasts that already exist."""
    mask, rate = F.col("in_service"), F.ln(F.col("yhat") + 0.1)
    return P.all_predictions(spark, sf).groupBy("model", "target").agg(
        GM.masked_mae(F.col("yhat"), mask).alias("l1"),
        GM.masked_poisson_loss(rate, mask).alias("poisson"),
    )


@query("g8_validation_split", with_ctes(f"""
    SELECT DATE '2024-01-22' - {VAL_DAYS} <= d.date AS is_validation,
           count(*) * 24 AS n_rows, count(*) AS station_days
    FROM station_ids s CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS date FROM spine) d
    WHERE d.date >= DATE '2024-01-08' AND d.date < DATE '2024-01-22' GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    """Station-days before the second week: a week is lost to lags, the last days validate."""
    week = P.WEEKS[1]
    table = GM.training_table(
        P.station_hourly(spark, sf), filled_weather(spark, sf), calendar(spark), week, P.IDLE_HOURS
    )
    split = GM.validation_split(table, week, VAL_DAYS)
    return split.groupBy("is_validation").agg(
        F.count("*").alias("n_rows"), F.count_distinct("station_id", "date").alias("station_days")
    )


@query("g9_candidate_selection", with_ctes("""
    SELECT station_id, arg_min(model, (round(val_mae, 9), model)) AS chosen_loss,
           min(val_mae) AS val_mae
    FROM (SELECT station_id, model, avg(abs(y - yhat)) AS val_mae FROM preds GROUP BY 1, 2)
    GROUP BY 1"""), doubles="val_mae")  # fmt: skip
def _(spark, sf):
    """The best of three candidates per station."""
    runs = P.predictions(spark, sf).groupBy("station_id", F.col("model").alias("loss")).agg(
        F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("val_mae")
    )
    return GM.choose(runs, ["station_id"])


@query("g9_fit_log")
def _(spark, sf):
    """The record of every fit: sizes, candidates and the one that was chosen."""
    _, _, log = global_model(spark, sf)
    return log.select("cutoff", "train_samples", "val_samples", "chosen_loss", F.inline("runs"))


@query("g9_network_choice", with_ctes(f"""
    SELECT CAST(w.week AS VARCHAR) AS cutoff, s.n * (w.days - 7 - {VAL_DAYS}) AS train_samples,
           s.n * {VAL_DAYS} AS val_samples, CAST(2 AS BIGINT) AS candidates, true AS least
    FROM (VALUES (DATE '2024-01-15', 14), (DATE '2024-01-22', 21)) w(week, days),
         (SELECT count(*) AS n FROM station_ids) s"""))  # fmt: skip
def _(spark, sf):
    """Of each week: its station-days, and whether the chosen loss has the least validation error."""
    _, _, log = network(spark, sf, epochs=2)
    chosen = F.filter("runs", lambda r: r["loss"] == F.col("chosen_loss"))[0]["val_mae"]
    least = F.array_min(F.transform("runs", lambda r: r["val_mae"]))
    return log.select(
        "cutoff", "train_samples", "val_samples", F.size("runs").cast("long").alias("candidates"), (chosen == least).alias("least")
    )


@query("g12_cutoff_sums", with_ctes(f"""
    SELECT w.week AS cutoff, count(*) AS hours, avg(h.departures) AS departures, avg(h.arrivals) AS arrivals,
           avg(h.departures) FILTER (WHERE hour(h.ts) = 8) AS departures_at_8
    FROM (VALUES (TIMESTAMP '2024-01-15'), (TIMESTAMP '2024-01-22')) w(week)
    JOIN hourly h ON h.ts >= TIMESTAMP '2024-01-08' AND h.ts < w.week - INTERVAL {VAL_DAYS} DAY
    GROUP BY 1"""), doubles="departures arrivals departures_at_8")  # fmt: skip
def _(spark, sf):
    """What every cutoff reads off running sums by day: hours that train, and the means of the outputs."""
    days = NN.station_days(P.station_hourly(spark, sf), filled_weather(spark, sf), calendar(spark), P.IDLE_HOURS)
    rows = [
        (str(c.week), 24 * c.train_samples, *(float(c.level[i : i + 24].mean()) for i in (0, 24)), float(c.level[8]))
        for c in NN.read_cutoffs(materialize(days), WEEKS, VAL_DAYS)
    ]
    schema = "cutoff string, hours long, departures double, arrivals double, departures_at_8 double"
    return spark.createDataFrame(rows, schema).withColumn("cutoff", F.col("cutoff").cast("timestamp_ntz"))


@query("g10_prediction_inputs", with_ctes("""
    SELECT d.test_week, l.station_id, l.ts,
           l.departures_lag24, l.departures_lag168, l.departures_same_hour_mean_7d,
           c.closed_d1, c.closed_d7
    FROM forecast_days d
    JOIN user_lags l ON CAST(l.ts AS DATE) = CAST(d.day AS DATE)
    JOIN (SELECT r.station_id, r.day,
                 avg(CASE WHEN r.closed THEN 1.0 ELSE 0.0 END) FILTER (WHERE back = 1) AS closed_d1,
                 avg(CASE WHEN r.closed THEN 1.0 ELSE 0.0 END) FILTER (WHERE back = 7) AS closed_d7
          FROM (SELECT q.station_id, g.day, g.back,
                       q.idle AND epoch(least(q.run_end + INTERVAL 1 HOUR, g.day))
                                  - epoch(q.run_start) >= 48 * 3600 AS closed
                FROM user_runs q
                JOIN (SELECT day, back, CAST(day - back * INTERVAL 1 DAY AS DATE) AS date
                      FROM forecast_days CROSS JOIN (VALUES (1), (7)) AS b(back)) g
                  ON CAST(q.ts AS DATE) = g.date) r
          GROUP BY 1, 2) c ON c.station_id = l.station_id AND c.day = d.day""", materialized=("user_hourly", "user_runs", "user_lags")),
    doubles="departures_same_hour_mean_7d closed_d1 closed_d7")
def _(spark, sf):
    """Inputs for each forecast day of sparse series, closures as they were known at midnight."""
    table = GM.prediction_table(
        P.user_hourly(spark, sf), filled_weather(spark, sf), calendar(spark), WEEKS, 48
    )
    return table.select(
        "test_week", "station_id", "ts", "departures_lag24", "departures_lag168",
        "departures_same_hour_mean_7d", "closed_d1", "closed_d7",
    )


@query("g10_input_guard", with_ctes("""
    SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS incomplete FROM slots"""))  # fmt: skip
def _(spark, sf):
    table = GM.prediction_table(
        P.station_hourly(spark, sf), filled_weather(spark, sf), calendar(spark), WEEKS, P.IDLE_HOURS
    )
    return GM.incomplete_inputs(table)


@query("g12_four_model_comparison")
def _(spark, sf):
    """All four models on the same rows, scored together with both baselines."""
    hourly, forecasts, _ = global_model(spark, sf)
    flagged = G.flag_in_service(hourly, P.IDLE_HOURS)
    parts = [
        FC.backtest_baselines(hourly, WEEKS, min_hours=P.IDLE_HOURS),
        FC.attach_actuals(flagged, additive(spark, sf), "additive"),
        FC.attach_actuals(flagged, forecasts, "global"),
    ]
    preds = parts[0]
    for part in parts[1:]:
        preds = preds.unionByName(part, allowMissingColumns=True)
    return scored_table(preds.filter("in_service"), ["target"])

