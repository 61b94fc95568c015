"""SQL definitions of the projections, as named common table expressions for the twin queries.

They are written apart from the Spark plans (joins where Spark uses one aggregation, gaps and
islands where Spark counts busy hours), so that agreement between the two means something.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "trips": """
        SELECT CAST(event_id AS VARCHAR) AS ride_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'classic_bike'
                    ELSE 'electric_bike' END AS rideable_type,
               ts AS started_at,
               ts + to_seconds(CAST(4 * round(value * 100) - 20 AS BIGINT)) AS ended_at,
               'S' || CAST(user_id % 20 AS VARCHAR) AS start_station_id,
               CASE WHEN k % 17 <> 0 THEN 'S' || CAST(k % 20 AS VARCHAR) END AS end_station_id,
               CASE WHEN event_type <> 'error' THEN 'member' ELSE 'casual' END AS member_type,
               k
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""",
    "valid": """
        SELECT * FROM trips
        WHERE ended_at - started_at BETWEEN INTERVAL 60 SECOND AND INTERVAL 86400 SECOND""",
    "spine": """
        SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00',
                                      INTERVAL 1 HOUR)) AS ts""",
    "station_ids": """
        SELECT start_station_id AS station_id FROM valid WHERE start_station_id IS NOT NULL
        UNION SELECT end_station_id FROM valid WHERE end_station_id IS NOT NULL""",
    "departures_h": """
        SELECT start_station_id AS station_id, date_trunc('hour', started_at) AS ts, count(*) AS n
        FROM valid
        WHERE start_station_id IS NOT NULL
          AND started_at >= TIMESTAMP '2024-01-01' AND started_at < TIMESTAMP '2024-01-31'
        GROUP BY 1, 2""",
    "arrivals_h": """
        SELECT end_station_id AS station_id, date_trunc('hour', ended_at) AS ts, count(*) AS n
        FROM valid
        WHERE end_station_id IS NOT NULL
          AND ended_at >= TIMESTAMP '2024-01-01' AND ended_at < TIMESTAMP '2024-01-31'
        GROUP BY 1, 2""",
    "hourly": """
        SELECT s.station_id, h.ts,
               CAST(coalesce(d.n, 0) AS INTEGER) AS departures,
               CAST(coalesce(a.n, 0) AS INTEGER) AS arrivals,
               CAST(coalesce(a.n, 0) - coalesce(d.n, 0) AS INTEGER) AS net_flow
        FROM station_ids s CROSS JOIN spine h
        LEFT JOIN departures_h d ON d.station_id = s.station_id AND d.ts = h.ts
        LEFT JOIN arrivals_h a ON a.station_id = s.station_id AND a.ts = h.ts""",
    "user_hourly": """
        SELECT u.station_id, h.ts, CAST(coalesce(d.n, 0) AS INTEGER) AS departures,
               0 AS arrivals, CAST(-coalesce(d.n, 0) AS INTEGER) AS net_flow
        FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS station_id FROM events) u
        CROSS JOIN spine h
        LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS station_id, date_trunc('hour', ts) AS ts,
                          count(*) AS n FROM events GROUP BY 1, 2) d
          ON d.station_id = u.station_id AND d.ts = h.ts""",
    "runs": """
        SELECT r.station_id, r.ts, r.departures, r.arrivals, r.net_flow, r.idle,
               CASE WHEN r.idle THEN min(r.ts) OVER w END AS run_start,
               CASE WHEN r.idle THEN max(r.ts) OVER w END AS run_end
        FROM (SELECT *, departures = 0 AND arrivals = 0 AS idle,
                     row_number() OVER (PARTITION BY station_id ORDER BY ts)
                     - row_number() OVER (PARTITION BY station_id, departures = 0 AND arrivals = 0
                                          ORDER BY ts) AS island
              FROM hourly) r
        WINDOW w AS (PARTITION BY r.station_id, r.idle, r.island)""",
    "user_runs": """
        SELECT r.station_id, r.ts, r.departures, r.arrivals, r.net_flow, r.idle,
               CASE WHEN r.idle THEN min(r.ts) OVER w END AS run_start,
               CASE WHEN r.idle THEN max(r.ts) OVER w END AS run_end
        FROM (SELECT *, departures = 0 AND arrivals = 0 AS idle,
                     row_number() OVER (PARTITION BY station_id ORDER BY ts)
                     - row_number() OVER (PARTITION BY station_id, departures = 0 AND arrivals = 0
                                          ORDER BY ts) AS island
              FROM user_hourly) r
        WINDOW w AS (PARTITION BY r.station_id, r.idle, r.island)""",
    "flagged": """
        SELECT station_id, ts, departures, arrivals, net_flow,
               NOT (idle AND run_end + INTERVAL 1 HOUR - run_start >= INTERVAL 6 HOUR)
                   AS in_service
        FROM runs""",
    "user_flagged": """
        SELECT station_id, ts, departures, arrivals, net_flow,
               NOT (idle AND epoch(run_end) + 3600 - epoch(run_start) >= 48 * 3600) AS in_service
        FROM user_runs""",
    "system": """
        SELECT 'SYSTEM' AS station_id, h.ts,
               CAST(coalesce(d.n, 0) AS INTEGER) AS departures,
               CAST(coalesce(a.n, 0) AS INTEGER) AS arrivals,
               CAST(coalesce(a.n, 0) - coalesce(d.n, 0) AS INTEGER) AS net_flow
        FROM spine h
        LEFT JOIN (SELECT ts, sum(n) AS n FROM departures_h GROUP BY ts) d ON d.ts = h.ts
        LEFT JOIN (SELECT ts, sum(n) AS n FROM arrivals_h GROUP BY ts) a ON a.ts = h.ts""",
    "forecast_days": """
        SELECT w AS test_week, w + to_days(CAST(i AS INTEGER)) AS day
        FROM (VALUES (TIMESTAMP '2024-01-15'), (TIMESTAMP '2024-01-22')) t(w),
             generate_series(0, 6) g(i)""",
    "slots": """
        SELECT d.test_week, d.day, r.station_id, r.ts, r.departures, r.arrivals
        FROM forecast_days d
        JOIN runs r ON r.ts >= d.day AND r.ts < d.day + INTERVAL 1 DAY""",
    "history": """
        SELECT s.test_week, s.station_id, s.ts, k.k, r.departures, r.arrivals,
               NOT (r.idle AND epoch(least(r.run_end + INTERVAL 1 HOUR, s.day))
                               - epoch(r.run_start) >= 6 * 3600) AS open_then
        FROM slots s CROSS JOIN generate_series(1, 8) k(k)
        JOIN runs r ON r.station_id = s.station_id
                   AND r.ts = s.ts - to_days(CAST(7 * k.k AS INTEGER))""",
    "baselines": """
        SELECT s.test_week, s.station_id, s.ts, f.in_service,
               CAST(s.departures AS DOUBLE) AS departures_y,
               CAST(s.arrivals AS DOUBLE) AS arrivals_y,
               coalesce(h.dep_avg, 0.0) AS departures_historical_average,
               coalesce(h.arr_avg, 0.0) AS arrivals_historical_average,
               coalesce(n.departures, h.dep_avg, 0.0) AS departures_seasonal_naive,
               coalesce(n.arrivals, h.arr_avg, 0.0) AS arrivals_seasonal_naive
        FROM slots s
        JOIN flagged f ON f.station_id = s.station_id AND f.ts = s.ts
        LEFT JOIN (SELECT station_id, ts, avg(departures) AS dep_avg, avg(arrivals) AS arr_avg
                   FROM history WHERE open_then GROUP BY 1, 2) h
          ON h.station_id = s.station_id AND h.ts = s.ts
        LEFT JOIN history n
          ON n.station_id = s.station_id AND n.ts = s.ts AND n.k = 1 AND n.open_then""",
    "models": """
        SELECT test_week, station_id, ts, in_service, target, y, naive, average,
               (naive + average) / 2 AS blend
        FROM (SELECT test_week, station_id, ts, in_service, 'departures' AS target,
                     departures_y AS y, departures_seasonal_naive AS naive,
                     departures_historical_average AS average FROM baselines
              UNION ALL
              SELECT test_week, station_id, ts, in_service, 'arrivals', arrivals_y,
                     arrivals_seasonal_naive, arrivals_historical_average FROM baselines)""",
    "all_preds": """
        SELECT 'seasonal_naive' AS model, test_week, station_id, ts, target, y, naive AS yhat,
               CAST(NULL AS DOUBLE) AS yhat_lower, CAST(NULL AS DOUBLE) AS yhat_upper, in_service
        FROM models
        UNION ALL
        SELECT 'historical_average', test_week, station_id, ts, target, y, average, NULL, NULL,
               in_service FROM models
        UNION ALL
        SELECT 'blend', test_week, station_id, ts, target, y, blend, greatest(0.0, blend - 2),
               blend + 2, in_service FROM models""",
    "preds": "SELECT * FROM all_preds WHERE in_service",
    "weather": """
        SELECT date_trunc('hour', ts) AS ts,
               avg(value) FILTER (WHERE event_type = 'view') AS temp_c,
               coalesce(sum(value) FILTER (WHERE event_type = 'error') / 100, 0.0) AS precip_mm,
               CAST(count(*) AS DOUBLE) AS wind_kmh
        FROM events GROUP BY 1""",
    "rain": """
        SELECT CAST(ts AS DATE) AS date, sum(precip_mm) AS precip_mm
        FROM weather GROUP BY 1""",
}


def with_ctes(body: str, recursive: bool = False, materialized: tuple[str, ...] = (), **extra: str) -> str:
    """Prefix ``body`` with the CTEs it names, and those they name, in order of dependency. Those of
    ``materialized`` are computed once, whatever the plan."""
    known = {**CTES, **extra}
    ordered: list[str] = []

    def visit(text: str, open_names: tuple[str, ...]) -> None:
        for word in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text, re.IGNORECASE):
            if word in known and word not in ordered and word not in open_names:
                visit(known[word], (*open_names, word))
                ordered.append(word)

    visit(body, ())
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in materialized else ''}({known[name].strip()})" for name in ordered)
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return f"{keyword} {parts}\n{body.strip()}"
