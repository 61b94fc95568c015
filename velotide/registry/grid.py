"""Section D: hourly grid, zero fill, closures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from velotide.functions.columns import naive
from velotide.operators import closures as C
from velotide.operators import grid as G
from velotide.plans import projection as P
from velotide.registry.base import query
from velotide.registry.sql import with_ctes


@query(
    "d1_hour_spine",
    """SELECT unnest(generate_series(date_trunc('day', low),
                     date_trunc('day', high) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts
       FROM (SELECT min(ts) AS low, max(ts) AS high FROM events)""",
)
def _(spark, sf):
    """Hours of every day from the first event to the last, unfolded from one row of bounds."""
    day = F.expr("INTERVAL '1' HOUR")
    bounds = P.table(spark, sf, "events").agg(
        F.to_date(F.min("ts")).cast("timestamp_ntz").alias("low"),
        F.to_date(F.max("ts")).cast("timestamp_ntz").alias("high"),
    )
    return bounds.select(
        F.explode(F.sequence("low", F.col("high") + F.expr("INTERVAL '23' HOUR"), day)).alias("ts")
    )


@query("d2_grid", with_ctes("SELECT station_id, ts FROM station_ids CROSS JOIN spine"))
def _(spark, sf):
    return G.station_grid(P.station_ids(P.valid_trips(spark, sf)), P.START, P.END)


@query("d3_departures_by_hour", with_ctes("SELECT station_id, ts, n FROM departures_h"))
def _(spark, sf):
    return G.departures_by_hour(P.valid_trips(spark, sf), P.START, P.END)


@query("d4_arrivals_by_hour", with_ctes("SELECT station_id, ts, n FROM arrivals_h"))
def _(spark, sf):
    return G.arrivals_by_hour(P.valid_trips(spark, sf), P.START, P.END)


@query("d5_hourly_zero_filled", with_ctes("SELECT * FROM hourly"))
def _(spark, sf):
    return P.station_hourly(spark, sf)


@query("d5_user_hourly_zero_filled", with_ctes("SELECT * FROM user_hourly"))
def _(spark, sf):
    return P.user_hourly(spark, sf)


@query("d6_system_hourly", with_ctes("SELECT * FROM system"))
def _(spark, sf):
    return G.system_counts(P.valid_trips(spark, sf), P.START, P.END)


@query("d7_closure_mask", with_ctes("SELECT * FROM user_flagged"))
def _(spark, sf):
    return G.flag_in_service(P.user_hourly(spark, sf))


@query("d7_closure_mask_short_runs", with_ctes("SELECT * FROM flagged"))
def _(spark, sf):
    return G.flag_in_service(P.station_hourly(spark, sf), P.IDLE_HOURS)


# The twin flags each slice from scratch: runs are found again on the rows before each cutoff.
CUTOFFS = [datetime(2024, 1, d) for d in (5, 9, 15, 22, 30)]


AS_OF = """
        SELECT cutoff, station_id, ts, departures, arrivals, net_flow,
               NOT (idle AND count(*) OVER (PARTITION BY cutoff, station_id, idle, island) >= 48)
                   AS in_service
        FROM (SELECT c.cutoff, h.*, departures = 0 AND arrivals = 0 AS idle,
                     row_number() OVER (PARTITION BY c.cutoff, station_id ORDER BY ts)
                     - row_number() OVER (PARTITION BY c.cutoff, station_id,
                                                       departures = 0 AND arrivals = 0
                                          ORDER BY ts) AS island
              FROM user_hourly h
              JOIN (VALUES (TIMESTAMP '2024-01-05'), (TIMESTAMP '2024-01-09'),
                           (TIMESTAMP '2024-01-15'), (TIMESTAMP '2024-01-22'),
                           (TIMESTAMP '2024-01-30')) c(cutoff) ON h.ts < c.cutoff)"""


@query("d8_closure_mask_as_of", with_ctes(AS_OF))
def _(spark, sf):
    return G.visible_before_each(P.user_hourly(spark, sf), CUTOFFS)


def week():
    """The bounds of the pieces of the given tables, which cover less than two months."""
    return F.trunc(F.col("ts").cast("date"), "week").cast("timestamp_ntz")


@query(
    "d7_idle_summaries",
    with_ctes(
        """
        SELECT station_id, piece, min(ts) AS low, max(ts) AS high, count(*) AS hours,
               min(ts) FILTER (WHERE busy) AS first_busy, max(ts) FILTER (WHERE busy) AS last_busy,
               count(*) FILTER (WHERE gap >= 48) AS n_runs,
               CAST(coalesce(sum(gap) FILTER (WHERE gap >= 48), 0) AS BIGINT) AS run_hours
        FROM (SELECT *, CASE WHEN busy THEN date_diff('hour', lag(ts) OVER (
                            PARTITION BY station_id, piece, busy ORDER BY ts), ts) - 1 END AS gap
              FROM (SELECT station_id, ts, CAST(date_trunc('week', ts) AS TIMESTAMP) AS piece,
                           departures <> 0 OR arrivals <> 0 AS busy
                    FROM user_hourly))
        GROUP BY station_id, piece"""
    ),
)
def _(spark, sf):
    """A row per station and week: bounds, busy ends, long runs inside."""
    found = C.idle_summaries(P.user_hourly(spark, sf), week())
    one = F.transform("runs", lambda r: F.timestamp_diff("HOUR", r["run_start"], r["run_end"]) + 1)
    total = F.aggregate(one, F.lit(0).cast("long"), lambda done, n: done + n)
    return found.select(
        *[c for c in found.columns if c != "runs"],
        F.size("runs").cast("long").alias("n_runs"),
        total.alias("run_hours"),
    )


@query(
    "d7_closed_runs",
    with_ctes(
        """
        SELECT station_id, min(ts) AS run_start, max(ts) AS run_end
        FROM (SELECT station_id, ts, ts - row_number() OVER (PARTITION BY station_id ORDER BY ts)
                                          * INTERVAL 1 HOUR AS island
              FROM user_flagged WHERE NOT in_service)
        GROUP BY station_id, island"""
    ),
)
def _(spark, sf):
    """Runs of whole series, merged from summaries of weeks."""
    runs = C.closed_runs(C.idle_summaries(P.user_hourly(spark, sf), week()))
    return runs.select("station_id", F.inline("runs"))


@query("d7_closure_mask_merged", with_ctes("SELECT * FROM user_flagged"))
def _(spark, sf):
    hourly = P.user_hourly(spark, sf)
    return C.flag_from_runs(hourly, C.closed_runs(C.idle_summaries(hourly, week())))


@query("d8_closure_mask_as_of_merged", with_ctes(AS_OF))
def _(spark, sf):
    hourly = P.user_hourly(spark, sf)
    runs = C.closed_runs(C.idle_summaries(hourly, week()))
    every = F.explode(F.array(*[naive(c) for c in CUTOFFS]))
    return C.flag_as_of(hourly.withColumn("cutoff", every), runs, F.col("cutoff"))


@query(
    "d9_grid_profile",
    with_ctes(
        """
        SELECT count(*) AS grid_rows,
               (SELECT count(*) FROM station_ids) * 720 AS expected_rows,
               avg(CASE WHEN departures = 0 THEN 1.0 ELSE 0.0 END) AS zero_share,
               count(*) FILTER (WHERE NOT in_service) AS closed_hours,
               avg(CASE WHEN in_service THEN 0.0 ELSE 1.0 END) AS closed_share,
               count(DISTINCT CASE WHEN NOT in_service THEN station_id END) AS closed_stations,
               CAST(sum(departures) AS BIGINT) AS departures,
               CAST(sum(arrivals) AS BIGINT) AS arrivals
        FROM flagged"""
    ),
    doubles="zero_share closed_share",
)
def _(spark, sf):
    flagged = G.flag_in_service(P.station_hourly(spark, sf), P.IDLE_HOURS)
    return G.grid_profile(flagged, P.START, P.END)
