"""Section G: baselines and the backtest protocol; section H: metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from velotide.functions import metrics as M
from velotide.operators import forecast as FC
from velotide.operators import grid as G
from velotide.plans import projection as P
from velotide.registry.base import query
from velotide.registry.sql import with_ctes
from velotide.settings import AVERAGE, NAIVE


def _wide(spark, sf):
    return FC.baseline_forecasts(P.station_hourly(spark, sf), list(P.WEEKS), min_hours=P.IDLE_HOURS)


@query("g1_day_grid", with_ctes("SELECT station_id, test_week, day, ts FROM slots"))
def _(spark, sf):
    return G.day_grid(P.station_ids(P.valid_trips(spark, sf)), list(P.WEEKS))


@query(
    "g2_historical_average",
    with_ctes(
        """SELECT test_week, station_id, ts, departures_historical_average AS departures,
                  arrivals_historical_average AS arrivals FROM baselines"""
    ),
    doubles="departures arrivals",
)
def _(spark, sf):
    return _wide(spark, sf).select(
        "test_week",
        "station_id",
        "ts",
        F.col(f"departures_{AVERAGE}").alias("departures"),
        F.col(f"arrivals_{AVERAGE}").alias("arrivals"),
    )


@query(
    "g3_seasonal_naive",
    with_ctes(
        """SELECT test_week, station_id, ts, departures_seasonal_naive AS departures,
                  arrivals_seasonal_naive AS arrivals FROM baselines"""
    ),
    doubles="departures arrivals",
)
def _(spark, sf):
    return _wide(spark, sf).select(
        "test_week",
        "station_id",
        "ts",
        F.col(f"departures_{NAIVE}").alias("departures"),
        F.col(f"arrivals_{NAIVE}").alias("arrivals"),
    )


@query("g11_forecast_days", with_ctes("""
    SELECT d.test_week, d.day, count(e.event_id) AS n_events
    FROM forecast_days d LEFT JOIN events e ON e.ts >= d.day AND e.ts < d.day + INTERVAL 1 DAY
    GROUP BY 1, 2"""))  # fmt: skip
def _(spark, sf):
    """The forecast days, with how many events fall on each."""
    wanted = spark.range(1).select(F.inline(G.forecast_days(list(P.WEEKS))))
    per_day = (
        P.table(spark, sf, "events")
        .groupBy(F.to_date("ts").cast("timestamp_ntz").alias("day"))
        .agg(F.count("*").alias("n_events"))
    )
    return wanted.join(per_day, "day", "left").fillna(0, ["n_events"]).select(
        "test_week", "day", "n_events"
    )


@query("g12_rolling_backtest", with_ctes("""
    SELECT model, test_week, station_id, ts, target, y, yhat, in_service
    FROM all_preds WHERE model <> 'blend'"""), doubles="y yhat")  # fmt: skip
def _(spark, sf):
    return FC.backtest_baselines(
        P.station_hourly(spark, sf), list(P.WEEKS), min_hours=P.IDLE_HOURS
    )


@query("g12_user_backtest", with_ctes("""
    SELECT d.test_week, u.station_id, u.ts, u.departures AS y,
           coalesce(avg(r.departures) FILTER (WHERE r.open_then), 0.0) AS yhat
    FROM forecast_days d
    JOIN user_hourly u ON u.ts >= d.day AND u.ts < d.day + INTERVAL 1 DAY
    LEFT JOIN (SELECT q.*, f.day, f.test_week AS week,
                      NOT (q.idle AND epoch(least(q.run_end + INTERVAL 1 HOUR, f.day))
                                      - epoch(q.run_start) >= 48 * 3600) AS open_then
               FROM user_runs q JOIN forecast_days f
                 ON q.ts < f.day AND isodow(q.ts) = isodow(f.day)) r
      ON r.station_id = u.station_id AND r.day = d.day AND hour(r.ts) = hour(u.ts)
    GROUP BY 1, 2, 3, 4"""), doubles="yhat")  # fmt: skip
def _(spark, sf):
    """Historical average over sparse series, where two-day closures shape the history."""
    wide = FC.baseline_forecasts(P.user_hourly(spark, sf), list(P.WEEKS))
    return wide.select(
        "test_week",
        "station_id",
        "ts",
        F.col("departures_y").cast("int").alias("y"),
        F.col(f"departures_{AVERAGE}").alias("yhat"),
    )


@query("g13_protocol_guard", with_ctes("""
    SELECT CAST(0 AS BIGINT) AS outside_day,
           count(*) FILTER (WHERE b.departures_seasonal_naive IS NULL) AS missing,
           count(*) - count(DISTINCT (s.station_id, s.ts)) AS not_one_to_one
    FROM slots s LEFT JOIN baselines b ON b.station_id = s.station_id AND b.ts = s.ts"""))  # fmt: skip
def _(spark, sf):
    hourly = P.station_hourly(spark, sf)
    forecasts = _wide(spark, sf).select(
        "station_id",
        "ts",
        F.to_date("ts").cast("timestamp_ntz").alias("day"),
        F.col(f"departures_{NAIVE}").alias("departures"),
        F.col(f"arrivals_{NAIVE}").alias("arrivals"),
    )
    days = F.array(*[F.lit(str(w)).cast("date") for w in P.WEEKS])
    actual = hourly.filter(
        F.exists(days, lambda w: F.to_date("ts").between(w, F.date_add(w, 6)))
    )
    return FC.protocol_violations(actual, forecasts)


@query("g14_wide_to_long", with_ctes("SELECT * FROM all_preds"),
       doubles="y yhat yhat_lower yhat_upper")
def _(spark, sf):
    return P.all_predictions(spark, sf)


@query("g15_system_backtest", with_ctes("""
    SELECT m.model, d.test_week, s.station_id, s.ts, t.target,
           CASE t.target WHEN 'departures' THEN CAST(s.departures AS DOUBLE)
                         ELSE CAST(s.arrivals AS DOUBLE) END AS y,
           CASE t.target WHEN 'departures'
                THEN avg(h.departures) FILTER (WHERE m.model = 'historical_average' OR h.k = 1)
                ELSE avg(h.arrivals) FILTER (WHERE m.model = 'historical_average' OR h.k = 1)
           END AS yhat,
           true AS in_service
    FROM forecast_days d
    JOIN system s ON s.ts >= d.day AND s.ts < d.day + INTERVAL 1 DAY
    JOIN (SELECT q.ts + to_days(CAST(7 * g.k AS INTEGER)) AS slot, g.k, q.departures, q.arrivals
          FROM system q CROSS JOIN generate_series(1, 8) g(k)) h ON h.slot = s.ts
    CROSS JOIN (VALUES ('seasonal_naive'), ('historical_average')) m(model)
    CROSS JOIN (VALUES ('departures'), ('arrivals')) t(target)
    GROUP BY m.model, d.test_week, s.station_id, s.ts, t.target, s.departures, s.arrivals"""),
    doubles="y yhat")
def _(spark, sf):
    """The same backtest on the system series, which is always in service."""
    system = G.system_counts(P.valid_trips(spark, sf), P.START, P.END)
    return FC.backtest_baselines(system, list(P.WEEKS), min_hours=None)


def _by_model(df, **metrics):
    return df.groupBy("model", "target").agg(*[c.alias(n) for n, c in metrics.items()])


@query("h1_mae", with_ctes("""
    SELECT model, target, avg(abs(y - yhat)) AS mae FROM preds GROUP BY 1, 2"""), doubles="mae")  # fmt: skip
def _(spark, sf):
    return _by_model(P.predictions(spark, sf), mae=M.mae())


@query("h2_rmse", with_ctes("""
    SELECT model, target, sqrt(avg((y - yhat) ** 2)) AS rmse
    FROM preds GROUP BY 1, 2"""), doubles="rmse")  # fmt: skip
def _(spark, sf):
    return _by_model(P.predictions(spark, sf), rmse=M.rmse())


@query("h3_wape", with_ctes("""
    SELECT station_id, model, CAST(hour(ts) AS INTEGER) AS hour,
           CASE WHEN sum(y) > 0 THEN sum(abs(y - yhat)) / sum(y) END AS wape
    FROM preds GROUP BY 1, 2, 3"""), doubles="wape")  # fmt: skip
def _(spark, sf):
    """Per station and hour, where some groups have no trips at all and the ratio is NULL."""
    return P.predictions(spark, sf).groupBy("station_id", "model", F.hour("ts").alias("hour")).agg(
        M.wape().alias("wape")
    )


@query("h4_skill", with_ctes("""
    SELECT target, 1 - avg(abs(y - yhat)) FILTER (WHERE model = 'blend')
                       / avg(abs(y - yhat)) FILTER (WHERE model = 'historical_average') AS skill
    FROM preds GROUP BY 1"""), doubles="skill")  # fmt: skip
def _(spark, sf):
    miss = F.abs(F.col("y") - F.col("yhat"))
    of = {m: F.avg(F.when(F.col("model") == m, miss)) for m in (P.BLEND, AVERAGE)}
    return P.predictions(spark, sf).groupBy("target").agg(
        M.skill(of[P.BLEND], of[AVERAGE]).alias("skill")
    )


@query("h5_coverage", with_ctes("""
    SELECT target, avg(CASE WHEN y BETWEEN yhat_lower AND yhat_upper THEN 1.0 ELSE 0.0 END)
        AS coverage
    FROM preds WHERE yhat_lower IS NOT NULL GROUP BY 1"""), doubles="coverage")  # fmt: skip
def _(spark, sf):
    bounded = P.predictions(spark, sf).filter("yhat_lower IS NOT NULL")
    return bounded.groupBy("target").agg(M.coverage().alias("coverage"))


@query("h6_missing_inputs", with_ctes("""
    SELECT count(*) AS rows_checked,
           count(*) FILTER (WHERE y IS NULL OR yhat_lower IS NULL OR isnan(yhat_lower))
               AS rows_missing FROM preds"""))  # fmt: skip
def _(spark, sf):
    """Only the model with an interval could be scored for coverage: the guard counts the rest."""
    return M.missing_inputs(P.predictions(spark, sf), "y", "yhat_lower")
