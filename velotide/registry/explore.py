"""Section M: exploratory tables, over the trip series and over orders as a longer series."""

from __future__ import annotations

from pyspark.sql import functions as F

from velotide.operators import grid as G
from velotide.plans import explore as X
from velotide.plans import projection as P
from velotide.registry import analysis  # noqa: F401  (its SQL definitions are used here)
from velotide.registry.base import query
from velotide.registry.dims import calendar
from velotide.registry.features import flagged
from velotide.registry.sql import CTES, with_ctes

CTES["daily"] = """
    SELECT s.date, s.departures, CAST(isodow(s.date) - 1 AS INTEGER) AS dow,
           isodow(s.date) >= 6 AS is_weekend, c.is_holiday, c.is_semester, w.temp_c, w.precip_mm,
           coalesce(w.precip_mm >= 1.0, false) AS rainy, CAST(year(s.date) AS INTEGER) AS year,
           CAST(month(s.date) AS INTEGER) AS month
    FROM (SELECT CAST(ts AS DATE) AS date, CAST(sum(departures) AS BIGINT) AS departures
          FROM system GROUP BY 1) s
    LEFT JOIN (SELECT CAST(ts AS DATE) AS date, arg_min(is_holiday, ts) AS is_holiday,
                      arg_min(is_semester, ts) AS is_semester FROM calendar GROUP BY 1) c
      ON c.date = s.date
    LEFT JOIN (SELECT CAST(ts AS DATE) AS date, sum(precip_mm) AS precip_mm,
                      avg(temp_c) FILTER (WHERE hour(ts) BETWEEN 7 AND 20) AS temp_c
               FROM weather GROUP BY 1) w ON w.date = s.date"""
CTES["ordered"] = """
    SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS departures,
           CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
    FROM orders GROUP BY ALL"""
CTES["shipped"] = """
    SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS departures,
           CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month
    FROM lineitem GROUP BY ALL"""
CTES["matrix"] = f"""
    SELECT station_id,
           {', '.join(f'avg(net_flow) FILTER (WHERE c.hour = {h}) AS h{h}' for h in range(24))}
    FROM flagged f JOIN calendar c ON c.ts = f.ts
    WHERE f.in_service AND NOT c.is_weekend AND NOT c.is_holiday GROUP BY 1"""
CTES["mornings"] = """
    SELECT *, coalesce(h7, 0.0) + coalesce(h8, 0.0) + coalesce(h9, 0.0) AS morning FROM matrix"""
CTES["profile"] = """
    SELECT c.hour, avg(s.departures) FILTER (WHERE NOT c.is_weekend) AS weekday,
           avg(s.departures) FILTER (WHERE c.is_weekend) AS weekend
    FROM system s JOIN calendar c ON c.ts = s.ts WHERE NOT c.is_holiday GROUP BY 1"""


def system(spark, sf):
    return G.system_counts(P.valid_trips(spark, sf), P.START, P.END)


def daily(spark, sf):
    return X.daily_table(system(spark, sf), calendar(spark), P.weather(spark, sf))


def _per_day(df, ts):
    day = F.to_date(ts)
    return df.groupBy(day.alias("date")).agg(F.count("*").alias("departures")).withColumns(
        {"year": F.year("date"), "month": F.month("date")}
    )


def ordered(spark, sf):
    return _per_day(P.table(spark, sf, "orders"), "o_orderdate")


def shipped(spark, sf):
    return _per_day(P.table(spark, sf, "lineitem"), "l_shipdate")


@query("m1_daily_table", with_ctes("SELECT * FROM daily"), doubles="temp_c precip_mm", dates="date")
def _(spark, sf):
    return daily(spark, sf)


@query("m2_demand_summary", with_ctes("""
    SELECT s.*, count(*) AS station_hours,
           avg(CASE WHEN in_service THEN 0.0 ELSE 1.0 END) AS masked_share,
           avg(CASE WHEN departures = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE in_service)
               AS zero_share,
           median(departures) FILTER (WHERE in_service) AS median_departures,
           avg(departures) FILTER (WHERE in_service) AS mean_departures,
           quantile_cont(departures, 0.99) FILTER (WHERE in_service) AS p99_departures,
           max(departures) FILTER (WHERE in_service) AS max_departures
    FROM flagged, (SELECT CAST(sum(departures) AS BIGINT) AS trips,
                          CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day
                   FROM system) s
    GROUP BY ALL"""),
    doubles="masked_share zero_share median_departures mean_departures p99_departures",
    dates="first_day last_day")
def _(spark, sf):
    return X.demand_summary(system(spark, sf), flagged(spark, sf))


for _source, _read in (("daily", daily), ("ordered", ordered), ("shipped", shipped)):

    @query(f"m3_centred_mean_{_source}", with_ctes(f"""
        SELECT date, departures,
               (SELECT CASE WHEN count(*) = 7 THEN avg(n.departures) END FROM {_source} n
                WHERE n.date BETWEEN d.date - 3 AND d.date + 3) AS centred_mean
        FROM {_source} d"""), doubles="centred_mean", dates="date")  # fmt: skip
    def _(spark, sf, read=_read):
        return X.centred_mean(read(spark, sf))

    @query(f"m4_yearly_{_source}", with_ctes(f"""
        SELECT year, CAST(sum(departures) AS BIGINT) AS trips, avg(departures) AS mean_per_day,
               count(*) AS days FROM {_source} GROUP BY 1"""), doubles="mean_per_day")  # fmt: skip
    def _(spark, sf, read=_read):
        return X.yearly_totals(read(spark, sf))

    @query(f"m5_growth_{_source}", with_ctes(f"""
        SELECT year, CAST(sum(departures) AS BIGINT) AS trips,
               sum(departures) / (SELECT sum(departures) FROM {_source} WHERE month <= 9
                   AND year = (SELECT min(year) FROM {_source} WHERE month <= 9)) - 1 AS growth
        FROM {_source} WHERE month <= 9 GROUP BY 1"""), doubles="growth")  # fmt: skip
    def _(spark, sf, read=_read):
        return X.same_months_growth(read(spark, sf))

    @query(f"m10_month_extremes_{_source}", with_ctes(f"""
        SELECT (SELECT month FROM months ORDER BY mean DESC, month LIMIT 1) AS peak_month,
               max(mean) AS peak_mean,
               (SELECT month FROM months ORDER BY mean, month LIMIT 1) AS low_month,
               min(mean) AS low_mean, max(mean) / min(mean) AS ratio FROM months""",
        months=f"SELECT month, avg(departures) AS mean FROM {_source} GROUP BY 1"),
        doubles="peak_mean low_mean ratio")
    def _(spark, sf, read=_read):
        return X.month_extremes(read(spark, sf))


@query("m6_hour_profile", with_ctes("SELECT * FROM profile"), doubles="weekday weekend")
def _(spark, sf):
    return X.hour_profile(system(spark, sf), calendar(spark))


@query("m7_peaks", with_ctes("""
    SELECT (SELECT hour FROM profile ORDER BY weekday DESC, hour LIMIT 1) AS weekday_peak,
           (SELECT hour FROM profile ORDER BY weekend DESC, hour LIMIT 1) AS weekend_peak,
           avg(weekday) FILTER (WHERE hour BETWEEN 7 AND 9)
             / avg(weekday) FILTER (WHERE hour BETWEEN 11 AND 13) AS morning_to_midday
    FROM profile"""), doubles="morning_to_midday")  # fmt: skip
def _(spark, sf):
    return X.peaks(X.hour_profile(system(spark, sf), calendar(spark)))


@query("m8_weekday_means", with_ctes("""
    SELECT dow, avg(departures) AS departures FROM daily WHERE NOT is_holiday GROUP BY 1"""),
    doubles="departures")
def _(spark, sf):
    return X.weekday_means(daily(spark, sf))


YEARS = list(range(1995, 2002))


@query("m9_month_by_year", with_ctes(f"""
    SELECT month, {', '.join(f'avg(departures) FILTER (WHERE year = {y}) AS y{y}' for y in YEARS)}
    FROM ordered GROUP BY 1"""), doubles=" ".join(f"y{y}" for y in YEARS))  # fmt: skip
def _(spark, sf):
    return X.monthly_means(ordered(spark, sf), YEARS)


@query("m11_temperature_curve", with_ctes("""
    SELECT CAST(greatest(-12, least(30, floor(temp_c / 3) * 3)) AS INTEGER) AS temp_bin, rainy,
           avg(departures) AS mean, count(*) AS days
    FROM daily WHERE NOT is_weekend AND NOT is_holiday AND temp_c IS NOT NULL
    GROUP BY 1, 2 HAVING count(*) >= 2"""), doubles="mean")  # fmt: skip
def _(spark, sf):
    return X.temperature_curve(daily(spark, sf), min_days=2)


# There is only one month, and it has no dry day at some scales: the weekday takes the month's
# place, and the median of the daily precipitation the place of 1 mm.
CTES["wet"] = """
    SELECT dow, avg(departures) FILTER (WHERE wet) AS rainy,
           avg(departures) FILTER (WHERE NOT wet) AS dry
    FROM (SELECT *, precip_mm >= (SELECT median(precip_mm) FROM daily) AS wet FROM daily)
    WHERE NOT is_weekend AND NOT is_holiday GROUP BY 1"""


def wet_days(spark, sf):
    days = daily(spark, sf)
    middle = days.agg(F.median("precip_mm")).scalar()
    return days.withColumn("rainy", F.col("precip_mm") >= middle)


@query("m12_rain_effect", with_ctes("""
    SELECT *, rainy / dry - 1 AS effect FROM wet WHERE rainy / dry IS NOT NULL"""),
    doubles="rainy dry effect")
def _(spark, sf):
    return X.rain_effect(wet_days(spark, sf), ["dow"])


@query("m12_rain_effect_summary", with_ctes("""
    SELECT count(*) AS "groups", median(rainy / dry - 1) AS median_effect,
           min(rainy / dry - 1) AS lowest, max(rainy / dry - 1) AS highest
    FROM wet WHERE rainy / dry IS NOT NULL"""), doubles="median_effect lowest highest")  # fmt: skip
def _(spark, sf):
    return X.rain_effect_summary(X.rain_effect(wet_days(spark, sf), ["dow"]))


@query("m13_temperature_correlation", with_ctes("""
    SELECT corr(temp_c, departures) AS correlation FROM daily
    WHERE NOT is_weekend AND NOT is_holiday"""), doubles="correlation")  # fmt: skip
def _(spark, sf):
    return X.temperature_correlation(daily(spark, sf))


@query("m14_busiest_stations", with_ctes("""
    SELECT * FROM info ORDER BY rank_volume DESC, canonical_id LIMIT 15"""), doubles="lat lng")  # fmt: skip
def _(spark, sf):
    return X.busiest_stations(P.station_info(spark, sf))


@query("m14_top_prefix", with_ctes("""
    SELECT sum(rank_volume) FILTER (WHERE is_top) / sum(rank_volume) AS top_share,
           count(*) FILTER (WHERE is_top AND canonical_id LIKE 'S1%') AS with_prefix
    FROM info"""), doubles="top_share")  # fmt: skip
def _(spark, sf):
    return X.top_prefix(P.station_info(spark, sf), "S1")


def matrix(spark, sf):
    return X.net_flow_matrix(flagged(spark, sf), calendar(spark))


@query("m15_net_flow_matrix", with_ctes("SELECT * FROM mornings"),
       doubles=" ".join(f"h{h}" for h in range(24)) + " morning")
def _(spark, sf):
    return matrix(spark, sf)


@query("m15_morning_extremes", with_ctes("""
    SELECT * FROM (SELECT station_id, morning, 'drains' AS side FROM mornings
                   ORDER BY round(morning, 9), station_id LIMIT 8)
    UNION ALL
    SELECT * FROM (SELECT station_id, morning, 'fills' FROM mornings
                   ORDER BY round(morning, 9) DESC, station_id LIMIT 8)"""), doubles="morning")  # fmt: skip
def _(spark, sf):
    return X.morning_extremes(matrix(spark, sf))


@query("m15_morning_counts", with_ctes("""
    SELECT count(*) FILTER (WHERE morning < -0.5) AS draining,
           count(*) FILTER (WHERE morning > 0.5) AS filling FROM mornings"""))  # fmt: skip
def _(spark, sf):
    return X.morning_counts(matrix(spark, sf), 0.5)


@query("m16_lowest_days", with_ctes("""
    SELECT date, departures, precip_mm, temp_c, is_holiday, dayname(date) AS weekday
    FROM daily ORDER BY departures, date LIMIT 6"""), doubles="precip_mm temp_c", dates="date")  # fmt: skip
def _(spark, sf):
    return X.lowest_days(daily(spark, sf))


@query("m17_holiday_effect", with_ctes("""
    SELECT avg(departures) FILTER (WHERE is_holiday) AS holiday,
           avg(departures) FILTER (WHERE NOT is_holiday) AS normal,
           avg(departures) FILTER (WHERE is_holiday)
             / avg(departures) FILTER (WHERE NOT is_holiday) - 1 AS effect
    FROM daily WHERE NOT is_weekend"""), doubles="holiday normal effect")  # fmt: skip
def _(spark, sf):
    return X.holiday_effect(daily(spark, sf))


@query("m18_campus_share", with_ctes(r"""
    SELECT is_semester, avg(share) AS campus_share
    FROM (SELECT CAST(f.ts AS DATE) AS date,
                 sum(f.departures) FILTER (WHERE regexp_matches(i.name, '\bMIT\b|Harvard'))
                   / nullif(sum(f.departures), 0) AS share
          FROM flagged f LEFT JOIN info i ON i.canonical_id = f.station_id
          WHERE f.in_service GROUP BY 1) s
    JOIN daily d ON d.date = s.date WHERE NOT d.is_weekend AND NOT d.is_holiday
    GROUP BY 1"""), doubles="campus_share")  # fmt: skip
def _(spark, sf):
    return X.campus_share(flagged(spark, sf), P.station_info(spark, sf), daily(spark, sf))
