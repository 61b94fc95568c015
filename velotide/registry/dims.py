"""Section E: weather and calendar."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from velotide.functions.columns import days
from velotide.operators import calendar as CA
from velotide.operators import grid as G
from velotide.operators import weather as W
from velotide.plans import projection as P
from velotide.registry.base import query
from velotide.registry.sql import CTES, with_ctes

# The readings are moved by whole days, so that they span a change of the clock.
SPRING, FALL = 60, 300
SPRING_RANGE = (datetime(2024, 3, 2), datetime(2024, 3, 30))


def readings(spark, sf, shift=0):
    """Hourly readings as if their times were UTC, moved by ``shift`` days."""
    return P.weather(spark, sf).withColumn("utc", F.col("ts") + days(shift)).drop("ts")


CTES["spring"] = f"""
    SELECT ts, avg(temp_c) AS temp_c, avg(precip_mm) AS precip_mm, avg(wind_kmh) AS wind_kmh
    FROM (SELECT *, CASE WHEN utc < TIMESTAMP '2024-03-10 07:00:00' THEN utc - INTERVAL 5 HOUR
                         ELSE utc - INTERVAL 4 HOUR END AS ts
          FROM (SELECT temp_c, precip_mm, wind_kmh, ts + INTERVAL {SPRING} DAY AS utc
                FROM weather)) GROUP BY 1"""
CTES["fall"] = f"""
    SELECT ts, avg(temp_c) AS temp_c, avg(precip_mm) AS precip_mm, avg(wind_kmh) AS wind_kmh
    FROM (SELECT *, CASE WHEN utc < TIMESTAMP '2024-11-03 06:00:00' THEN utc - INTERVAL 4 HOUR
                         ELSE utc - INTERVAL 5 HOUR END AS ts
          FROM (SELECT temp_c, precip_mm, wind_kmh, ts + INTERVAL {FALL} DAY AS utc
                FROM weather)) GROUP BY 1"""


def _filled(f: str) -> str:
    return f"""
        CASE WHEN {f} IS NOT NULL THEN {f}
             WHEN {f}_b IS NULL OR n - {f}_n > 2 THEN NULL
             WHEN {f}_a IS NULL THEN {f}_b
             ELSE {f}_b + ({f}_a - {f}_b) * (epoch(ts) - epoch({f}_bt))
                          / (epoch({f}_at) - epoch({f}_bt)) END AS {f}"""


def _around(f: str) -> str:
    known = f"CASE WHEN {f} IS NOT NULL THEN"
    return f"""
        last_value({f} IGNORE NULLS) OVER back AS {f}_b,
        last_value({known} ts END IGNORE NULLS) OVER back AS {f}_bt,
        last_value({known} n END IGNORE NULLS) OVER back AS {f}_n,
        last_value({f} IGNORE NULLS) OVER ahead AS {f}_a,
        last_value({known} ts END IGNORE NULLS) OVER ahead AS {f}_at"""


CTES["spring_grid"] = f"""
    SELECT ts, {', '.join(_filled(f) for f in W.FIELDS)}
    FROM (SELECT *, {', '.join(_around(f) for f in W.FIELDS)}
          FROM (SELECT coalesce(s.ts, r.ts) AS ts, s.ts IS NOT NULL AS wanted,
                       temp_c, precip_mm, wind_kmh,
                       row_number() OVER (ORDER BY coalesce(s.ts, r.ts)) AS n
                FROM (SELECT unnest(generate_series(TIMESTAMP '2024-03-02',
                                 TIMESTAMP '2024-03-29 23:00:00', INTERVAL 1 HOUR)) AS ts) s
                FULL OUTER JOIN spring r ON r.ts = s.ts)
          WINDOW back AS (ORDER BY ts ROWS UNBOUNDED PRECEDING),
                 ahead AS (ORDER BY ts DESC ROWS UNBOUNDED PRECEDING))
    WHERE wanted"""
CTES["holidays"] = """
    SELECT * FROM (VALUES (DATE '2024-01-01', 'New Year''s Day'),
                          (DATE '2024-01-15', 'Martin Luther King Jr. Day')) h(date, holiday_name)"""
CTES["calendar"] = """
    SELECT s.ts, CAST(hour(s.ts) AS INTEGER) AS hour, CAST(isodow(s.ts) - 1 AS INTEGER) AS dow,
           CAST(month(s.ts) AS INTEGER) AS month, isodow(s.ts) >= 6 AS is_weekend,
           h.holiday_name IS NOT NULL AS is_holiday, h.holiday_name,
           strftime(s.ts, '%m-%d') BETWEEN '01-20' AND '05-15'
           OR strftime(s.ts, '%m-%d') BETWEEN '09-01' AND '12-20' AS is_semester
    FROM spine s LEFT JOIN holidays h ON h.date = CAST(s.ts AS DATE)"""
FIELDS = "temp_c precip_mm wind_kmh"


def local_grid(spark, sf):
    return W.to_local_grid(readings(spark, sf, SPRING), *SPRING_RANGE)


def calendar(spark):
    return CA.calendar_features(G.hour_spine(spark, P.START, P.END))


@query("e1_utc_to_local", with_ctes("""
    SELECT ts AS utc, ts - INTERVAL 5 HOUR AS ts, temp_c FROM weather"""), doubles="temp_c")  # fmt: skip
def _(spark, sf):
    rows = readings(spark, sf)
    return rows.select("utc", W.to_local(F.col("utc")).alias("ts"), "temp_c")


@query("e2_fall_back_mean", with_ctes("SELECT * FROM fall"), doubles=FIELDS)
def _(spark, sf):
    return W.local_readings(readings(spark, sf, FALL))


@query("e3_local_grid", with_ctes("SELECT * FROM spring_grid"), doubles=FIELDS)
def _(spark, sf):
    return local_grid(spark, sf)


@query("e4_gaps", with_ctes("""
    SELECT count(*) FILTER (WHERE temp_c IS NULL OR precip_mm IS NULL OR wind_kmh IS NULL)
               AS missing_hours,
           min(h.ts) FILTER (WHERE temp_c IS NULL OR precip_mm IS NULL OR wind_kmh IS NULL)
               AS first_missing
    FROM spine h LEFT JOIN weather w ON w.ts = h.ts"""))  # fmt: skip
def _(spark, sf):
    """The guard on the grid before anything is filled."""
    spine = G.hour_spine(spark, P.START, P.END)
    return W.weather_gaps(spine.join(P.weather(spark, sf), "ts", "left"))


@query("e5_weather_profile", with_ctes("""
    SELECT count(*) AS hours, min(temp_c) AS min_temp, max(temp_c) AS max_temp,
           avg(CASE WHEN precip_mm > 0 THEN 1.0 ELSE 0.0 END) AS wet_share FROM spring_grid"""),
    doubles="min_temp max_temp wet_share")
def _(spark, sf):
    return W.weather_profile(local_grid(spark, sf))


@query("e6_calendar", with_ctes("SELECT c.* FROM calendar c JOIN bounds b ON c.ts BETWEEN b.low AND b.high",
       bounds="SELECT date_trunc('hour', min(ts)) AS low, max(ts) AS high FROM events"))
def _(spark, sf):
    """The calendar over the hours from the first event to the last."""
    bounds = P.table(spark, sf, "events").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    low = F.to_date("low").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour("low"))
    hours = F.sequence(low, "high", F.expr("INTERVAL '1' HOUR"))
    return CA.calendar_features(bounds.select(F.explode(hours).alias("ts")))


@query("e7_semester", """
    SELECT strftime(o_orderdate, '%m-%d') BETWEEN '01-20' AND '05-15'
           OR strftime(o_orderdate, '%m-%d') BETWEEN '09-01' AND '12-20' AS is_semester,
           CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n
    FROM orders GROUP BY 1, 2""")  # fmt: skip
def _(spark, sf):
    """Orders in and out of term, per month of the order."""
    when = F.col("o_orderdate")
    return P.table(spark, sf, "orders").groupBy(
        CA.is_semester(when).alias("is_semester"), F.month(when).alias("month")
    ).agg(F.count("*").alias("n"))


def _nth(month: int, dow: int, nth: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"{first} + CAST((({dow} - isodow({first}) + 7) % 7) + {7 * (nth - 1)} AS INTEGER)"


def _holiday_sql() -> str:
    parts = []
    for name, month, day, since in CA.FIXED_HOLIDAYS:
        own, text = f"make_date(y, {month}, {day})", name.replace("'", "''")
        parts.append(f"SELECT {own} AS date, '{text}' AS name FROM ys WHERE y >= {since}")
        for dow, step in ((6, -1), (7, 1)):
            parts.append(
                f"SELECT {own} + {step}, '{text} (observed)' FROM ys "
                f"WHERE y >= {since} AND isodow({own}) = {dow}"
            )
    for name, month, weekday, nth in CA.WEEKDAY_HOLIDAYS:
        text, dow = name.replace("'", "''"), {"MON": 1, "THU": 4}[weekday]
        parts.append(f"SELECT {_nth(month, dow, nth)}, '{text}' FROM ys")
    parts.append(
        "SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER), "
        "'Memorial Day' FROM ys"
    )
    union = " UNION ALL ".join(parts)
    return f"""
        WITH span AS (SELECT CAST(year(min(o_orderdate)) AS BIGINT) AS low,
                             CAST(year(max(o_orderdate)) AS BIGINT) AS high FROM orders),
             ys AS (SELECT unnest(generate_series(low, high + 1)) AS y FROM span),
             named AS ({union})
        SELECT date, string_agg(name, '; ' ORDER BY name) AS holiday_name
        FROM named, span WHERE year(date) BETWEEN low AND high GROUP BY 1"""


@query("e8_holidays", _holiday_sql(), dates="date")
def _(spark, sf):
    """Holidays of all years in which there are orders."""
    ordered = P.table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"))
    return CA.holidays(CA.years_of(ordered))


@query("e9_calendar_profile", with_ctes("""
    SELECT count(*) AS hours,
           count(DISTINCT CASE WHEN is_holiday THEN CAST(c.ts AS DATE) END) AS holiday_days,
           avg(CASE WHEN is_semester THEN 1.0 ELSE 0.0 END) AS semester_share
    FROM calendar c JOIN (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events) e
      ON e.ts = c.ts"""), doubles="semester_share")  # fmt: skip
def _(spark, sf):
    """Over the hours that have events."""
    return CA.calendar_profile(CA.calendar_features(P.weather(spark, sf).select("ts")))
