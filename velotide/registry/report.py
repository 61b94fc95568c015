"""Section I: scored reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from velotide.plans import projection as P
from velotide.plans import report as R
from velotide.registry.base import query
from velotide.registry.sql import CTES, with_ctes
from velotide.settings import NAIVE

CTES["grouped"] = """
    SELECT p.*, CASE WHEN isodow(p.ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type,
           CASE WHEN month(p.test_week) IN (12, 1, 2) THEN 'winter'
                WHEN month(p.test_week) IN (3, 4, 5) THEN 'spring'
                WHEN month(p.test_week) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
           CASE WHEN hour(p.ts) <= 5 THEN 'night 0-5' WHEN hour(p.ts) <= 9 THEN 'am peak 6-9'
                WHEN hour(p.ts) <= 15 THEN 'midday 10-15'
                WHEN hour(p.ts) <= 19 THEN 'pm peak 16-19' ELSE 'evening 20-23' END AS hour_band,
           CASE WHEN r.precip_mm >= 1.0 THEN 'rainy' WHEN r.precip_mm < 1.0 THEN 'dry' END
               AS weather
    FROM preds p LEFT JOIN rain r ON r.date = CAST(p.ts AS DATE)"""


def grouped(spark, sf):
    return R.add_groups(P.predictions(spark, sf), P.weather(spark, sf))


def scored_sql(by: str, source: str = "preds") -> str:
    return with_ctes(f"""
        SELECT s.model, {by}, s.mae, s.rmse, s.wape, s.n, b.mae AS baseline_mae,
               a.mae AS strong_mae, 1 - s.mae / b.mae AS skill,
               1 - s.mae / a.mae AS skill_vs_hist_avg
        FROM scored s
        JOIN (SELECT {by}, mae FROM scored WHERE model = 'seasonal_naive') b USING ({by})
        JOIN (SELECT {by}, mae FROM scored WHERE model = 'historical_average') a USING ({by})""",
        scored=f"""
        SELECT model, {by}, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse,
               CASE WHEN sum(y) > 0 THEN sum(abs(y - yhat)) / sum(y) END AS wape, count(*) AS n
        FROM {source} GROUP BY ALL""")  # fmt: skip


SCORED = "mae rmse wape baseline_mae strong_mae skill skill_vs_hist_avg"


@query("i1_groups", with_ctes("SELECT * FROM grouped"), doubles="y yhat yhat_lower yhat_upper")
def _(spark, sf):
    return grouped(spark, sf)


@query("i2_identical_rows", with_ctes("""
    SELECT model, count(*) FILTER (WHERE NOT shared) AS extra,
           (SELECT count(*) FROM preds WHERE model = 'seasonal_naive')
               - count(*) FILTER (WHERE shared) AS missing
    FROM (SELECT p.model, EXISTS (SELECT 1 FROM preds b WHERE b.model = 'seasonal_naive'
                 AND b.station_id = p.station_id AND b.ts = p.ts AND b.target = p.target) AS shared
          FROM preds p)
    GROUP BY model"""))  # fmt: skip
def _(spark, sf):
    return R.row_set_differences(P.predictions(spark, sf))


@query("i2_different_rows", with_ctes("""
    SELECT model, count(*) FILTER (WHERE NOT shared) AS extra,
           (SELECT count(*) FROM uneven WHERE model = 'seasonal_naive')
               - count(*) FILTER (WHERE shared) AS missing
    FROM (SELECT p.model, EXISTS (SELECT 1 FROM uneven b WHERE b.model = 'seasonal_naive'
                 AND b.station_id = p.station_id AND b.ts = p.ts AND b.target = p.target) AS shared
          FROM uneven p)
    GROUP BY model""",
    uneven="""SELECT * FROM preds
              WHERE CASE model WHEN 'blend' THEN y > 0
                               WHEN 'seasonal_naive' THEN isodow(ts) < 6 ELSE true END"""))  # fmt: skip
def _(spark, sf):
    """Models scored on different rows on purpose: the guard must count both directions."""
    uneven = (
        F.when(F.col("model") == P.BLEND, F.col("y") > 0)
        .when(F.col("model") == NAIVE, F.weekday("ts") < 5)
        .otherwise(True)
    )
    return R.row_set_differences(P.predictions(spark, sf).filter(uneven))


@query("i3_scores", with_ctes("""
    SELECT model, target, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse,
           CASE WHEN sum(y) > 0 THEN sum(abs(y - yhat)) / sum(y) END AS wape, count(*) AS n
    FROM preds GROUP BY 1, 2"""), doubles="mae rmse wape")  # fmt: skip
def _(spark, sf):
    return R.scores(P.predictions(spark, sf), ["target"])


@query("i4_scored_table", scored_sql("target"), doubles=SCORED)
def _(spark, sf):
    return R.scored_table(P.predictions(spark, sf), ["target"])


@query("i4_scored_by_station", scored_sql("station_id"), doubles=SCORED)
def _(spark, sf):
    return R.scored_table(P.predictions(spark, sf), ["station_id"])


@query("i5_model_order", with_ctes("""
    SELECT model, CAST(row_number() OVER (ORDER BY model <> 'seasonal_naive', model) AS INTEGER)
        AS position FROM (SELECT DISTINCT model FROM preds)"""))  # fmt: skip
def _(spark, sf):
    """Position of each model: the rank of its sort key among the handful of models."""
    models = P.predictions(spark, sf).select("model").distinct()
    everyone = F.array_sort(F.collect_set(F.struct((F.col("model") != NAIVE), F.col("model"))))
    return models.agg(everyone.alias("ordered")).select(F.posexplode("ordered")).select(
        F.col("col.model").alias("model"), (F.col("pos") + 1).alias("position")
    )


def _wide_sql(by: str) -> str:
    return with_ctes(f"""
        SELECT {by}, avg(abs(y - yhat)) FILTER (WHERE model = 'seasonal_naive') AS seasonal_naive,
               avg(abs(y - yhat)) FILTER (WHERE model = 'historical_average')
                   AS historical_average,
               avg(abs(y - yhat)) FILTER (WHERE model = 'blend') AS blend
        FROM grouped GROUP BY 1""")  # fmt: skip


WIDE = "seasonal_naive historical_average blend"
for _by in ("test_week", "season", "day_type", "weather", "hour_band"):

    @query(f"i6_mae_by_{_by}", _wide_sql(_by), doubles=WIDE)
    def _(spark, sf, by=_by):
        return R.wide_mae(grouped(spark, sf), by, P.MODELS)


@query("i7_station_skill", with_ctes("""
    SELECT m.model, count(*) FILTER (WHERE 1 - m.mae / a.mae > 0) AS better,
           count(*) AS stations, median(1 - m.mae / a.mae) AS median_skill,
           min(1 - m.mae / a.mae) AS lowest, max(1 - m.mae / a.mae) AS highest
    FROM by_station m JOIN by_station a
      ON a.station_id = m.station_id AND a.model = 'historical_average'
    WHERE m.model <> 'historical_average' GROUP BY 1""",
    by_station="""SELECT station_id, model, avg(abs(y - yhat)) AS mae FROM preds GROUP BY 1, 2"""),
    doubles="median_skill lowest highest")
def _(spark, sf):
    return R.station_skill_summary(P.predictions(spark, sf))


def _interval_sql() -> str:
    parts = []
    for label, column in (("all", None), ("target: ", "target"), ("season: ", "season"),
                          ("hours: ", "hour_band")):
        name = f"'{label}'" if column is None else f"'{label}' || {column}"
        parts.append(f"""
            SELECT model, {name} AS "group",
                   avg(CASE WHEN y BETWEEN yhat_lower AND yhat_upper THEN 1.0 ELSE 0.0 END)
                       AS coverage,
                   avg(yhat_upper - yhat_lower) AS mean_width, count(*) AS n
            FROM grouped WHERE yhat_lower IS NOT NULL GROUP BY 1, 2""")
    return with_ctes(" UNION ALL ".join(parts))


@query("i8_interval_report", _interval_sql(), doubles="coverage mean_width")
def _(spark, sf):
    return R.interval_report(grouped(spark, sf))


@query("i9_weather_sensitivity", with_ctes("""
    SELECT 'blend' AS model, f.mae AS mae_forecast_weather, a.mae AS mae_actual_weather,
           a.mae / f.mae - 1 AS difference
    FROM (SELECT avg(abs(y - yhat)) AS mae FROM preds WHERE model = 'blend') f,
         (SELECT avg(abs(y - yhat)) AS mae FROM preds WHERE model = 'historical_average') a"""),
    doubles="mae_forecast_weather mae_actual_weather difference")
def _(spark, sf):
    """The historical average stands in for the rerun of the blend with actual weather."""
    rows = P.all_predictions(spark, sf)
    rerun = rows.filter(F.col("model") == "historical_average").withColumn("model", F.lit(P.BLEND))
    return R.weather_sensitivity(rows.filter("in_service"), rerun)


@query("i10_masked_rows", with_ctes("""
    SELECT count(*) FILTER (WHERE NOT in_service) AS masked, count(*) AS all_rows
    FROM all_preds WHERE model = 'seasonal_naive'"""))  # fmt: skip
def _(spark, sf):
    return R.masked_rows(P.all_predictions(spark, sf))


@query("i11_mae_by_hour", with_ctes("""
    SELECT CAST(hour(ts) AS INTEGER) AS hour,
           avg(abs(y - yhat)) FILTER (WHERE model = 'seasonal_naive') AS seasonal_naive,
           avg(abs(y - yhat)) FILTER (WHERE model = 'historical_average') AS historical_average,
           avg(abs(y - yhat)) FILTER (WHERE model = 'blend') AS blend
    FROM preds GROUP BY 1"""), doubles=WIDE)  # fmt: skip
def _(spark, sf):
    return R.mae_by_hour(P.predictions(spark, sf), P.MODELS)


@query("i12_spot_check", with_ctes("""
    SELECT ts, max(y) AS actual, max(yhat) FILTER (WHERE model = 'seasonal_naive')
               AS seasonal_naive,
           max(yhat) FILTER (WHERE model = 'historical_average') AS historical_average,
           max(yhat) FILTER (WHERE model = 'blend') AS blend,
           max(yhat_lower) AS lower, max(yhat_upper) AS upper
    FROM preds WHERE station_id = 'S3' AND test_week = TIMESTAMP '2024-01-15'
                 AND target = 'arrivals' GROUP BY 1"""),
    doubles="actual seasonal_naive historical_average blend lower upper")
def _(spark, sf):
    return R.spot_check(P.predictions(spark, sf), "S3", "2024-01-15", "arrivals", P.MODELS)
