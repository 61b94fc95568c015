"""Sections J, K and L: error analysis, rebalancing, dashboard tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from velotide.plans import analysis as A
from velotide.plans import dashboard as D
from velotide.plans import projection as P
from velotide.plans import rebalancing as K
from velotide.registry.base import query
from velotide.registry.dims import calendar
from velotide.registry.report import grouped
from velotide.registry.sql import CTES, with_ctes
from velotide.settings import AVERAGE

CTES["info"] = """
    SELECT *, row_number() OVER (ORDER BY rank_volume DESC, canonical_id) <= 15 AS is_top
    FROM (SELECT canonical_id,
                 CASE WHEN i = 7 THEN NULL
                      ELSE (CASE i % 4 WHEN 0 THEN 'MIT Lab ' WHEN 1 THEN 'Harvard Yard '
                                       WHEN 2 THEN 'Summit Road ' ELSE 'Harbor Point ' END)
                           || CAST(i AS VARCHAR) END AS name,
                 CAST(42.36 AS DOUBLE) + (i % 10) * CAST(0.01 AS DOUBLE) AS lat,
                 CAST(-71.06 AS DOUBLE) + (i % 3) * CAST(0.01 AS DOUBLE) AS lng, rank_volume
          FROM (SELECT station_id AS canonical_id, CAST(substr(station_id, 2) AS INTEGER) AS i,
                       count(*) AS rank_volume
                FROM (SELECT start_station_id AS station_id, started_at FROM valid
                      UNION ALL SELECT end_station_id, started_at FROM valid)
                WHERE station_id IS NOT NULL AND started_at >= TIMESTAMP '2024-01-01'
                  AND started_at < TIMESTAMP '2024-01-08' GROUP BY 1))"""
CTES["enriched"] = """
    SELECT g.*, c.is_holiday, c.holiday_name, CAST(g.ts AS DATE) AS date,
           CAST(hour(g.ts) AS INTEGER) AS hour
    FROM grouped g LEFT JOIN calendar c ON c.ts = g.ts"""
CTES["by_station"] = """
    SELECT station_id, avg(abs(y - yhat)) FILTER (WHERE model = 'seasonal_naive') AS naive,
           avg(abs(y - yhat)) FILTER (WHERE model = 'historical_average') AS average,
           avg(abs(y - yhat)) FILTER (WHERE model = 'blend') AS blend,
           avg(y) FILTER (WHERE model = 'historical_average') AS mean_actual
    FROM preds GROUP BY 1"""
CTES["station_scores"] = """
    SELECT b.station_id, b.naive AS mae_seasonal_naive, b.average AS mae_historical_average,
           b.blend AS mae_blend, b.mean_actual, 1 - b.naive / b.average AS skill_seasonal_naive,
           1 - b.average / b.average AS skill_historical_average,
           1 - b.blend / b.average AS skill_blend, i.name, i.rank_volume
    FROM by_station b LEFT JOIN info i ON i.canonical_id = b.station_id"""
CTES["daily_errors"] = """
    SELECT m.date, m.model, m.mae, m.model_trips, d.is_holiday, d.holiday_name, d.actual_trips,
           r.precip_mm, dayname(m.date) AS weekday
    FROM (SELECT date, model, avg(abs(y - yhat)) AS mae, sum(y) AS model_trips
          FROM enriched GROUP BY 1, 2) m
    JOIN (SELECT date, bool_and(is_holiday) AS is_holiday, min(holiday_name) AS holiday_name,
                 sum(y) AS actual_trips FROM enriched GROUP BY 1) d ON d.date = m.date
    LEFT JOIN rain r ON r.date = m.date"""
CTES["flows"] = """
    SELECT model, station_id, date,
           sum(CASE target WHEN 'arrivals' THEN yhat ELSE -yhat END) AS forecast,
           sum(CASE target WHEN 'arrivals' THEN y ELSE -y END) AS actual
    FROM enriched
    WHERE hour IN (7, 8, 9) AND isodow(ts) < 6 AND NOT coalesce(is_holiday, false)
    GROUP BY 1, 2, 3 HAVING count(*) = 6"""
CTES["classes"] = """
    SELECT *, CASE WHEN days < 5 THEN 'too few days' WHEN forecast_fill_share >= 0.5 THEN 'fills'
                   WHEN forecast_drain_share >= 0.5 THEN 'drains' ELSE 'mixed' END AS label
    FROM (SELECT model, station_id, count(*) AS days,
                 avg(CASE WHEN forecast < -1 THEN 1.0 ELSE 0.0 END) AS forecast_drain_share,
                 avg(CASE WHEN forecast > 1 THEN 1.0 ELSE 0.0 END) AS forecast_fill_share,
                 avg(CASE WHEN actual < -1 THEN 1.0 ELSE 0.0 END) AS actual_drain_share,
                 avg(CASE WHEN actual > 1 THEN 1.0 ELSE 0.0 END) AS actual_fill_share,
                 median(forecast) AS median_forecast, median(actual) AS median_actual
          FROM flows GROUP BY 1, 2)"""
NUMBERS = "y yhat yhat_lower yhat_upper"
WIDE = "seasonal_naive historical_average blend"
DAY = date(2024, 1, 16)


def enriched(spark, sf):
    return A.enrich(P.predictions(spark, sf), P.weather(spark, sf), calendar(spark))


def dated(spark, sf):
    """Predictions with date and hour only, where no other context is needed."""
    return P.predictions(spark, sf).withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})


def scores(spark, sf):
    return A.station_scores(P.predictions(spark, sf), P.station_info(spark, sf), P.MODELS)


def _wide_sql(by: str, value: str, source: str, extra: str = "") -> str:
    each = ", ".join(f"{value} FILTER (WHERE model = '{m}') AS {m}" for m in P.MODELS)
    return with_ctes(f"SELECT {by}, {each}{extra} FROM {source} GROUP BY 1")


@query("j1_enriched", with_ctes("SELECT * FROM enriched"), doubles=NUMBERS, dates="date")
def _(spark, sf):
    return enriched(spark, sf)


@query("j2_station_scores", with_ctes("SELECT * FROM station_scores"),
       doubles=" ".join(f"mae_{m} skill_{m}" for m in P.MODELS) + " mean_actual")
def _(spark, sf):
    return scores(spark, sf)


@query("j3_bias_by_hour", _wide_sql("hour", "avg(yhat - y)", "enriched"), doubles=WIDE)
def _(spark, sf):
    return A.bias_by_hour(dated(spark, sf), P.MODELS)


DAILY = "mae model_trips actual_trips precip_mm"


@query("j4_daily_errors", with_ctes("SELECT * FROM daily_errors"), doubles=DAILY, dates="date")
def _(spark, sf):
    return A.daily_errors(enriched(spark, sf), P.weather(spark, sf))


@query("j5_worst_days", with_ctes("""
    SELECT * FROM daily_errors WHERE model = 'blend' ORDER BY mae DESC, date LIMIT 5"""),
    doubles=DAILY, dates="date")
def _(spark, sf):
    return A.worst_days(A.daily_errors(enriched(spark, sf), P.weather(spark, sf)), P.BLEND, 5)


COVERED = """
    SELECT hour, avg(CASE WHEN y BETWEEN yhat_lower AND yhat_upper THEN 1.0 ELSE 0.0 END)
        AS coverage FROM enriched WHERE yhat_lower IS NOT NULL GROUP BY 1"""


@query("j6_coverage_by_hour", with_ctes(COVERED), doubles="coverage")
def _(spark, sf):
    return A.coverage_by_hour(dated(spark, sf))


@query("j7_morning_net_flow", with_ctes("""
    SELECT station_id, date, forecast, actual FROM flows WHERE model = 'blend'"""),
    doubles="forecast actual", dates="date")
def _(spark, sf):
    return A.morning_net_flow(enriched(spark, sf), P.BLEND)


@query("j8_volume_thirds", with_ctes("""
    SELECT CASE WHEN rank_volume <= low THEN 'quietest' WHEN rank_volume <= high THEN 'middle'
                WHEN rank_volume IS NOT NULL THEN 'busiest' END AS volume_third,
           count(*) AS stations, median(skill_seasonal_naive) AS median_skill_seasonal_naive,
           median(skill_blend) AS median_skill_blend
    FROM station_scores, (SELECT quantile_cont(rank_volume, 1.0 / 3) AS low,
                                 quantile_cont(rank_volume, 2.0 / 3) AS high FROM station_scores)
    GROUP BY 1"""), doubles="median_skill_seasonal_naive median_skill_blend")  # fmt: skip
def _(spark, sf):
    return A.volume_thirds(scores(spark, sf), ["seasonal_naive", P.BLEND])


@query("j9_skill_and_volume", with_ctes("""
    SELECT count(*) AS stations, corr(skill_blend, rank_volume) AS corr_blend,
           count(*) FILTER (WHERE skill_blend > 0) AS better_blend FROM station_scores"""),
    doubles="corr_blend")
def _(spark, sf):
    return A.skill_and_volume(scores(spark, sf), [P.BLEND])


@query("j10_overall_bias", with_ctes("""
    SELECT model, avg(yhat - y) AS bias FROM preds GROUP BY 1"""), doubles="bias")  # fmt: skip
def _(spark, sf):
    return A.overall_bias(P.predictions(spark, sf))


for _by in ("day_type", "season", "weather"):

    @query(f"j11_mae_skill_by_{_by}", _wide_sql(_by, "avg(abs(y - yhat))", "grouped", """,
           1 - avg(abs(y - yhat)) FILTER (WHERE model = 'blend')
               / avg(abs(y - yhat)) FILTER (WHERE model = 'historical_average') AS skill"""),
           doubles=f"{WIDE} skill")
    def _(spark, sf, by=_by):
        return A.mae_with_skill(grouped(spark, sf), by, P.MODELS, P.BLEND)


@query("j12_most_missed", with_ctes("""
    SELECT s.*, i.name FROM (
        SELECT station_id, sum(y) AS y, sum(yhat) AS yhat, sum(y) - sum(yhat) AS missed
        FROM enriched WHERE model = 'blend' AND date = DATE '2024-01-16'
        GROUP BY 1 ORDER BY round(missed, 6) DESC, station_id LIMIT 5) s
    LEFT JOIN info i ON i.canonical_id = s.station_id"""), doubles="y yhat missed")  # fmt: skip
def _(spark, sf):
    return A.most_missed(dated(spark, sf), P.station_info(spark, sf), P.BLEND, DAY)


@query("j12_day_totals", with_ctes("""
    SELECT date, sum(y) AS actual, sum(yhat) AS forecast FROM enriched WHERE model = 'blend'
    GROUP BY 1"""), doubles="actual forecast", dates="date")  # fmt: skip
def _(spark, sf):
    return A.day_totals(dated(spark, sf), P.BLEND)


@query("j13_daytime_temperature", with_ctes("""
    SELECT CAST(ts AS DATE) AS date, avg(temp_c) FILTER (WHERE hour(ts) BETWEEN 7 AND 20)
        AS temp_c FROM weather GROUP BY 1"""), doubles="temp_c", dates="date")  # fmt: skip
def _(spark, sf):
    return A.daytime_temperature(P.weather(spark, sf))


@query("j13_daily_mae_pivot", _wide_sql("date", "max(mae)",
       "(SELECT * FROM daily_errors WHERE date IN (DATE '2024-01-15', DATE '2024-01-22'))"),
       doubles=WIDE, dates="date")
def _(spark, sf):
    daily = A.daily_errors(enriched(spark, sf), P.weather(spark, sf))
    return A.daily_mae_pivot(daily, list(P.WEEKS), P.MODELS)


@query("j14_relative_errors", with_ctes("""
    SELECT station_id, name, skill_blend AS skill,
           rank() OVER (ORDER BY skill_blend)
             + (count(*) OVER (PARTITION BY skill_blend) - 1) / 2.0 AS skill_rank,
           mae_blend / mean_actual AS relative_error,
           rank() OVER (ORDER BY mae_blend / mean_actual DESC)
             + (count(*) OVER (PARTITION BY mae_blend / mean_actual) - 1) / 2.0
             AS relative_error_rank
    FROM station_scores"""), doubles="skill skill_rank relative_error relative_error_rank")  # fmt: skip
def _(spark, sf):
    return A.relative_errors(scores(spark, sf), P.BLEND)


@query("j15_coverage_extremes", with_ctes("""
    SELECT (SELECT hour FROM covered ORDER BY coverage, hour LIMIT 1) AS lowest_hour,
           min(coverage) AS lowest,
           (SELECT hour FROM covered ORDER BY coverage DESC, hour LIMIT 1) AS highest_hour,
           max(coverage) AS highest FROM covered""", covered=COVERED), doubles="lowest highest")  # fmt: skip
def _(spark, sf):
    return A.coverage_extremes(A.coverage_by_hour(dated(spark, sf)))


# --- K


def classes(flows):
    return K.classify(flows, drain_below=-1.0, fill_above=1.0, min_days=5, share=0.5)


SHARES = (
    "forecast_drain_share forecast_fill_share actual_drain_share actual_fill_share "
    "median_forecast median_actual"
)


@query("k1_classes", with_ctes("SELECT * EXCLUDE (model) FROM classes WHERE model = 'blend'"),
       doubles=SHARES)
def _(spark, sf):
    return classes(A.morning_net_flow(enriched(spark, sf), P.BLEND))


@query("k2_summary", with_ctes("""
    SELECT l.label, (SELECT count(DISTINCT date) FROM flows WHERE model = 'blend') AS weekdays,
           coalesce(t.stations, 0) AS stations,
           l.sign * coalesce(t.forecast, 0.0) AS bikes_forecast,
           l.sign * coalesce(t.actual, 0.0) AS bikes_actual, h.hit_rate, h.hit_rate_threshold
    FROM (VALUES ('drains', -1), ('fills', 1)) l(label, sign)
    LEFT JOIN (SELECT label, count(*) AS stations, sum(median_forecast) AS forecast,
                      sum(median_actual) AS actual
               FROM classes WHERE model = 'blend' GROUP BY 1) t ON t.label = l.label
    LEFT JOIN (SELECT c.label,
                      avg(CASE WHEN f.actual * (CASE c.label WHEN 'drains' THEN -1 ELSE 1 END) > 0
                               THEN 1.0 ELSE 0.0 END) AS hit_rate,
                      avg(CASE WHEN f.actual * (CASE c.label WHEN 'drains' THEN -1 ELSE 1 END) > 1
                               THEN 1.0 ELSE 0.0 END) AS hit_rate_threshold
               FROM flows f JOIN classes c USING (model, station_id)
               WHERE f.model = 'blend' GROUP BY 1) h ON h.label = l.label"""),
    doubles="bikes_forecast bikes_actual hit_rate hit_rate_threshold")
def _(spark, sf):
    flows = A.morning_net_flow(enriched(spark, sf), P.BLEND)
    return K.summarize(flows, classes(flows), drain_below=-1.0)


@query("k3_flagged_by_both", with_ctes("""
    SELECT m.label, count(r.label) AS shared, count(*) AS stations
    FROM classes m LEFT JOIN classes r
      ON r.model = 'historical_average' AND r.station_id = m.station_id AND r.label = m.label
    WHERE m.model = 'blend' AND m.label IN ('drains', 'fills') GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    preds = enriched(spark, sf)
    mine, theirs = (classes(A.morning_net_flow(preds, m)) for m in (P.BLEND, AVERAGE))
    return K.flagged_by_both(mine, theirs)


@query("k4_pooled_skill", with_ctes("""
    SELECT avg(abs(y - yhat)) FILTER (WHERE model = 'blend') AS model_mae,
           avg(abs(y - yhat)) FILTER (WHERE model = 'historical_average') AS reference_mae,
           1 - avg(abs(y - yhat)) FILTER (WHERE model = 'blend')
               / avg(abs(y - yhat)) FILTER (WHERE model = 'historical_average') AS skill
    FROM preds"""), doubles="model_mae reference_mae skill")  # fmt: skip
def _(spark, sf):
    return K.pooled_skill(P.predictions(spark, sf), P.BLEND, AVERAGE)


for _label, _side in (("drains", "drain"), ("fills", "fill")):

    @query(f"k5_{_label}_list", with_ctes(f"""
        SELECT c.station_id, coalesce(i.name, c.station_id) AS name, c.days,
               c.forecast_{_side}_share AS forecast_share, c.actual_{_side}_share AS actual_share,
               c.median_forecast, c.median_actual
        FROM classes c LEFT JOIN info i ON i.canonical_id = c.station_id
        WHERE c.model = 'blend' AND c.label = '{_label}'"""),
        doubles="forecast_share actual_share median_forecast median_actual")
    def _(spark, sf, label=_label):
        table = classes(A.morning_net_flow(enriched(spark, sf), P.BLEND))
        return K.ranked_list(table, P.station_info(spark, sf), label)


# --- L

CTES["window_flow"] = """
    SELECT station_id, sum(CASE target WHEN 'arrivals' THEN yhat ELSE -yhat END) AS forecast,
           sum(CASE target WHEN 'arrivals' THEN y ELSE -y END) AS actual
    FROM enriched WHERE model = 'blend' AND date = DATE '2024-01-16' AND hour IN (16, 17, 18)
    GROUP BY 1 HAVING count(*) = 6"""


def evening_flow(spark, sf):
    return D.window_net_flow(dated(spark, sf), P.BLEND, DAY, D.WINDOWS["evening"])


def map_info(spark, sf):
    info = P.station_info(spark, sf).filter("is_top")
    return info.withColumnRenamed("canonical_id", "station_id").drop("is_top")


@query("l1_window_net_flow", with_ctes("SELECT * FROM window_flow"), doubles="forecast actual")
def _(spark, sf):
    return evening_flow(spark, sf)


@query("l2_rebalancing_list", with_ctes("""
    SELECT * FROM (SELECT *, 'drains' AS side FROM rounded
                   ORDER BY forecast, station_id LIMIT 10) WHERE forecast < 0
    UNION ALL
    SELECT * FROM (SELECT *, 'fills' AS side FROM rounded
                   ORDER BY forecast DESC, station_id LIMIT 10) WHERE forecast > 0""",
    rounded="""SELECT i.name, f.station_id, round(f.forecast, 1) AS forecast,
                      round(f.actual, 1) AS actual
               FROM window_flow f JOIN info i ON i.canonical_id = f.station_id AND i.is_top"""),
    doubles="forecast actual")
def _(spark, sf):
    return D.rebalancing_list(evening_flow(spark, sf), map_info(spark, sf))


@query("l3_comparison", with_ctes("""
    SELECT s.model, s.mae, s.rmse, s.wape, 1 - s.mae / b.mae AS skill,
           1 - s.mae / a.mae AS skill_vs_hist_avg
    FROM scored s JOIN scored b ON b.model = 'seasonal_naive'
    JOIN scored a ON a.model = 'historical_average'""",
    scored="""SELECT model, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse,
                     CASE WHEN sum(y) > 0 THEN sum(abs(y - yhat)) / sum(y) END AS wape
              FROM preds GROUP BY 1"""),
    doubles="mae rmse wape skill skill_vs_hist_avg")
def _(spark, sf):
    return D.comparison_table(P.predictions(spark, sf))


@query("l4_backtest_days", with_ctes("SELECT DISTINCT date FROM enriched"), dates="date")
def _(spark, sf):
    return D.backtest_days(dated(spark, sf))


@query("l5_week_of", with_ctes("""
    SELECT DISTINCT test_week FROM enriched WHERE date = DATE '2024-01-16'"""))  # fmt: skip
def _(spark, sf):
    return D.week_of(dated(spark, sf), DAY)


@query("l6_map_rows", with_ctes("""
    SELECT f.*, i.name, i.lat, i.lng,
           greatest(5.0, (SELECT max(abs(forecast)) FROM window_flow
                          WHERE station_id IN (SELECT canonical_id FROM info WHERE is_top)))
               AS colour_limit,
           (SELECT avg(lat) FROM info WHERE is_top) AS centre_lat,
           (SELECT avg(lng) FROM info WHERE is_top) AS centre_lng
    FROM window_flow f JOIN info i ON i.canonical_id = f.station_id AND i.is_top"""),
    doubles="forecast actual lat lng colour_limit centre_lat centre_lng")
def _(spark, sf):
    return D.map_rows(evening_flow(spark, sf), map_info(spark, sf))


@query("l7_day_context", with_ctes("""
    SELECT date, min(holiday_name) AS holiday_name, bool_or(weather = 'rainy') AS rainy
    FROM enriched GROUP BY 1"""), dates="date")  # fmt: skip
def _(spark, sf):
    return D.day_context(enriched(spark, sf))


@query("l8_station_view", with_ctes("""
    SELECT ts, max(y) AS actual, max(yhat) FILTER (WHERE model = 'historical_average')
               AS historical_average, max(yhat) FILTER (WHERE model = 'blend') AS blend,
           max(yhat_lower) AS lower, max(yhat_upper) AS upper
    FROM preds WHERE station_id = 'S11' AND test_week = TIMESTAMP '2024-01-22'
                 AND target = 'departures' GROUP BY 1"""),
    doubles="actual historical_average blend lower upper")
def _(spark, sf):
    return D.station_view(
        P.predictions(spark, sf), "S11", "2024-01-22", "departures", [AVERAGE, P.BLEND]
    )


