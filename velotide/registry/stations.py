"""Section C: station identity and ranking."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from velotide.functions.columns import haversine_m, name_key
from velotide.operators import stations as S
from velotide.plans import projection as P
from velotide.registry.base import query
from velotide.registry.sql import CTES, with_ctes
from velotide.session import materialize

GHOST_DAYS = 5
TOP = 8
SETTLED = 5


def _end_sql(end: str, at: str) -> str:
    i = f"CAST(substr({end}_station_id, 2) AS INTEGER)"
    shift = (
        "CASE WHEN rideable_type = 'electric_bike' THEN (k - 50) * CAST(0.000001 AS DOUBLE) "
        "ELSE 0.0 END"
    )
    return f"""
        SELECT ride_id, started_at, rideable_type, {at} AS ts,
               CASE WHEN {i} = 5 AND CAST({at} AS DATE) = DATE '2024-01-10' THEN 'S5G'
                    WHEN {i} IN (3, 7) AND {at} >= TIMESTAMP '2024-01-16'
                    THEN {end}_station_id || 'N' ELSE {end}_station_id END AS station_id,
               CASE {i} % 4 WHEN 0 THEN 'MIT Lab ' WHEN 1 THEN 'Harvard Yard '
                            WHEN 2 THEN 'Summit Road ' ELSE 'Harbor Point ' END
               || CAST({i} AS VARCHAR)
               || CASE WHEN {i} % 5 = 0 AND {at} >= TIMESTAMP '2024-01-20' THEN ' Annex'
                       ELSE '' END AS name,
               CAST(42.36 AS DOUBLE) + ({i} % 10) * CAST(0.01 AS DOUBLE)
               + floor({i} / 10) * CAST(0.00015 AS DOUBLE) + {shift} AS lat,
               CAST(-71.06 AS DOUBLE) + {shift} AS lng
        FROM valid WHERE {end}_station_id IS NOT NULL"""


CTES["observed"] = _end_sql("start", "started_at") + " UNION ALL " + _end_sql("end", "ended_at")
CTES["stats"] = """
    SELECT station_id, arg_max(name, ts) AS name, count(DISTINCT name) AS n_names,
           coalesce(median(lat) FILTER (WHERE rideable_type = 'classic_bike'), median(lat)) AS lat,
           coalesce(median(lng) FILTER (WHERE rideable_type = 'classic_bike'), median(lng)) AS lng,
           CAST(min(ts) AS DATE) AS first_seen, CAST(max(ts) AS DATE) AS last_seen,
           count(*) AS n_trip_ends
    FROM observed GROUP BY station_id"""
CTES["pairs"] = """
    SELECT a.station_id AS id_a, b.station_id AS id_b, a.name AS name_a, b.name AS name_b,
           2 * 6371000 * asin(sqrt(
               sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat))
               * sin(radians(b.lng - a.lng) / 2) ** 2)) AS dist_m,
           regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g')
             = regexp_replace(lower(b.name), '[^a-z0-9]', '', 'g') AS same_name,
           CAST(greatest(0, least(a.last_seen, b.last_seen)
                            - greatest(a.first_seen, b.first_seen)) AS INTEGER) AS overlap_days,
           CAST(least(a.last_seen - a.first_seen, b.last_seen - b.first_seen) + 1 AS INTEGER)
               AS shorter_life_days
    FROM stats a JOIN stats b ON a.station_id < b.station_id"""
CTES["merges"] = """
    SELECT *, CASE WHEN dist_m <= 50 AND shorter_life_days <= 5 THEN 'ghost'
                   ELSE 'replacement' END AS reason
    FROM pairs
    WHERE (dist_m <= 50 AND shorter_life_days <= 5)
       OR ((dist_m <= 50 OR (same_name AND dist_m <= 200)) AND overlap_days <= 1)"""
CTES["reach"] = """
    SELECT station_id AS a, station_id AS b FROM stats
    UNION
    SELECT r.a, e.b FROM reach r
    JOIN (SELECT id_a AS a, id_b AS b FROM merges
          UNION ALL SELECT id_b, id_a FROM merges) e ON e.a = r.b"""
CTES["crosswalk"] = """
    SELECT a AS station_id,
           (array_agg(b ORDER BY s.last_seen DESC, s.n_trip_ends DESC, b))[1] AS canonical_id
    FROM reach JOIN stats s ON s.station_id = reach.b GROUP BY a"""
CTES["ranks"] = """
    SELECT c.canonical_id, count(*) AS rank_volume
    FROM observed o JOIN crosswalk c ON c.station_id = o.station_id
    WHERE o.started_at >= TIMESTAMP '2024-01-01' AND o.started_at < TIMESTAMP '2024-01-08'
    GROUP BY 1"""
CTES["stations"] = f"""
    SELECT *, row_number() OVER (ORDER BY rank_volume DESC, canonical_id) <= {TOP} AS is_top
    FROM (SELECT l.canonical_id, l.first_seen, l.last_seen, s.name, s.lat, s.lng,
                 coalesce(r.rank_volume, 0) AS rank_volume
          FROM (SELECT c.canonical_id, min(t.first_seen) AS first_seen,
                       max(t.last_seen) AS last_seen
                FROM crosswalk c JOIN stats t ON t.station_id = c.station_id GROUP BY 1) l
          JOIN stats s ON s.station_id = l.canonical_id
          LEFT JOIN ranks r ON r.canonical_id = l.canonical_id)"""


def stats(spark, sf):
    return materialize(S.station_stats(P.located_trips(spark, sf)))


def crosswalk_of(station_stats):
    merges = materialize(S.find_merges(station_stats, GHOST_DAYS))
    return merges, S.build_crosswalk(station_stats, merges)


def stations(spark, sf, top_n=TOP):
    found = stats(spark, sf)
    _, crosswalk = crosswalk_of(found)
    ranks = S.rank_stations(P.located_trips(spark, sf), crosswalk, *P.RANK)
    return S.canonical_stations(found, crosswalk, ranks, top_n)


def _recursive(body: str) -> str:
    return with_ctes(body, recursive=True)


@query("c1_trip_ends", with_ctes("""
    SELECT station_id, name, lat, lng, rideable_type, ts FROM observed"""), doubles="lat lng")  # fmt: skip
def _(spark, sf):
    return S.trip_ends(P.located_trips(spark, sf))


@query("c2_station_stats", with_ctes("SELECT * FROM stats"), doubles="lat lng",
       dates="first_seen last_seen")
def _(spark, sf):
    return S.station_stats(P.located_trips(spark, sf))


@query("c3_haversine", with_ctes("""
    SELECT ride_id, 2 * 6371000 * asin(sqrt(
               sin(radians(e.lat - s.lat) / 2) ** 2 + cos(radians(s.lat)) * cos(radians(e.lat))
               * sin(radians(e.lng - s.lng) / 2) ** 2)) AS dist_m
    FROM starts s JOIN ends e USING (ride_id)""",
    starts=_end_sql("start", "started_at"), ends=_end_sql("end", "ended_at")), doubles="dist_m")
def _(spark, sf):
    """Distance between both ends of every trip that has them."""
    sides = [F.col(f"{end}_{c}") for end in ("start", "end") for c in ("lat", "lng")]
    return (
        P.located_trips(spark, sf)
        .filter("start_station_id IS NOT NULL AND end_station_id IS NOT NULL")
        .select("ride_id", haversine_m(*sides).alias("dist_m"))
    )


@query("c4_name_key", """
    SELECT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name_key,
           count(*) AS n FROM part GROUP BY 1, 2""")  # fmt: skip
def _(spark, sf):
    part = P.table(spark, sf, "part")
    return part.groupBy(F.col("p_name").alias("name"), name_key(F.col("p_name")).alias("name_key")).agg(
        F.count("*").alias("n")
    )


@query("c5_near_pairs", with_ctes("""
    SELECT id_a, id_b, dist_m, same_name, overlap_days, shorter_life_days FROM pairs
    WHERE (dist_m <= 50 AND (shorter_life_days <= 31 OR overlap_days <= 1))
       OR (same_name AND dist_m <= 200 AND overlap_days <= 1)"""), doubles="dist_m")  # fmt: skip
def _(spark, sf):
    """With the published limit of 31 days every near pair of this month counts as brief."""
    merges = S.find_merges(stats(spark, sf))
    return merges.drop("name_a", "name_b", "reason")


@query("c6_merges", with_ctes("SELECT * FROM merges"), doubles="dist_m")
def _(spark, sf):
    return S.find_merges(stats(spark, sf), GHOST_DAYS)


@query("c7_components", _recursive("""
    SELECT a AS station_id, min(b) AS component FROM reach
    WHERE a IN (SELECT id_a FROM merges UNION SELECT id_b FROM merges) GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    return S.connected_components(S.find_merges(stats(spark, sf), GHOST_DAYS))


@query("c8_crosswalk", _recursive("SELECT station_id, canonical_id FROM crosswalk"))
def _(spark, sf):
    return crosswalk_of(stats(spark, sf))[1]


@query("c9_rank_volume", _recursive("SELECT canonical_id, rank_volume FROM ranks"))
def _(spark, sf):
    _, crosswalk = crosswalk_of(stats(spark, sf))
    return S.rank_stations(P.located_trips(spark, sf), crosswalk, *P.RANK)


@query("c10_stations", _recursive("SELECT * EXCLUDE (is_top) FROM stations"), doubles="lat lng",
       dates="first_seen last_seen")
def _(spark, sf):
    return stations(spark, sf).drop("is_top")


@query("c11_top_stations", _recursive("""
    SELECT canonical_id, rank_volume, is_top FROM stations"""))  # fmt: skip
def _(spark, sf):
    return stations(spark, sf).select("canonical_id", "rank_volume", "is_top")


@query("c12_neighbor_changes", _recursive(f"""
    SELECT t.station_id AS top_station, t.name AS top_name, n.station_id AS neighbor,
           n.name AS neighbor_name, n.first_seen AS neighbor_first_seen,
           n.last_seen AS neighbor_last_seen
    FROM stats t JOIN pairs p ON t.station_id IN (p.id_a, p.id_b) AND p.dist_m <= 50
    JOIN stats n ON n.station_id IN (p.id_a, p.id_b) AND n.station_id <> t.station_id
    WHERE t.station_id IN (SELECT canonical_id FROM stations)
      AND (n.first_seen > (SELECT min(first_seen) FROM stats) + {SETTLED}
           OR n.last_seen < (SELECT max(last_seen) FROM stats) - {SETTLED})"""),
    dates="neighbor_first_seen neighbor_last_seen")
def _(spark, sf):
    """Neighbours of every canonical station: the month is too short for the settled 30 days."""
    found = stats(spark, sf)
    _, crosswalk = crosswalk_of(found)
    ids = crosswalk.select(F.col("canonical_id").alias("station_id"))
    return S.neighbor_changes(found, ids, SETTLED)


@query("c13_merge_listing", _recursive("""
    SELECT m.*, c.canonical_id FROM merges m JOIN crosswalk c ON c.station_id = m.id_a"""),
    doubles="dist_m")
def _(spark, sf):
    return S.merge_listing(*crosswalk_of(stats(spark, sf)))


@query("c13_identity_summary", _recursive("""
    SELECT count(*) AS raw_ids, (SELECT count(DISTINCT canonical_id) FROM crosswalk)
               AS canonical_ids,
           (SELECT count(*) FROM merges) AS merged_pairs,
           count(*) FILTER (WHERE n_names > 1) AS multi_name_ids FROM stats"""))  # fmt: skip
def _(spark, sf):
    found = stats(spark, sf)
    return S.identity_summary(found, *crosswalk_of(found))


@query("c14_top_share", _recursive("""
    SELECT count(*) FILTER (WHERE is_top) AS top_stations,
           sum(rank_volume) FILTER (WHERE is_top) / sum(rank_volume) AS top_share
    FROM stations"""), doubles="top_share")  # fmt: skip
def _(spark, sf):
    return S.top_share(stations(spark, sf))


@query("c14_gone_before", _recursive("""
    SELECT canonical_id, name, last_seen, rank_volume FROM stations
    WHERE is_top AND last_seen < DATE '2024-01-31'"""), dates="last_seen")  # fmt: skip
def _(spark, sf):
    gone = S.gone_before(stations(spark, sf), date(2024, 1, 31))
    return gone.select("canonical_id", "name", "last_seen", "rank_volume")
