"""Section B: unified schema, ordered rules, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from velotide.operators import cleaning as C
from velotide.plans import projection as P
from velotide.registry.base import query
from velotide.registry.sql import CTES, with_ctes

CTES["unified"] = r"""
    SELECT source_file, event, copy,
           CASE WHEN source_file = 'new' THEN ride_id END AS ride_id,
           CASE WHEN source_file = 'new' THEN rideable_type END AS rideable_type,
           CASE WHEN event % 97 <> 0 THEN date_trunc('milliseconds', started_at) END AS started_at,
           date_trunc('milliseconds', ended_at) AS ended_at,
           CASE WHEN event % 83 <> 0 THEN start_station_id END AS start_station_id,
           CASE WHEN event % 89 = 0 THEN 'Riverside Test Station'
                WHEN k % 31 = 0 THEN 'Contest Plaza' ELSE 'Main Street' END AS start_station_name,
           CASE WHEN k % 29 <> 0
                THEN CAST(42.36 AS DOUBLE)
                     + CAST(0.01 AS DOUBLE) * (CAST(substr(start_station_id, 2) AS INTEGER) % 10)
           END AS start_lat,
           CASE WHEN k % 29 <> 0
                THEN CAST(-71.06 AS DOUBLE)
                     + CAST(0.01 AS DOUBLE) * (CAST(substr(start_station_id, 2) AS INTEGER) % 10)
           END AS start_lng,
           CASE WHEN event % 83 <> 0 THEN end_station_id END AS end_station_id,
           'Square Annex' AS end_station_name,
           CASE WHEN k % 29 <> 0
                THEN CAST(42.36 AS DOUBLE)
                     + CAST(0.01 AS DOUBLE) * (CAST(substr(end_station_id, 2) AS INTEGER) % 10)
           END AS end_lat,
           CASE WHEN k % 29 <> 0
                THEN CAST(-71.06 AS DOUBLE)
                     + CAST(0.01 AS DOUBLE) * (CAST(substr(end_station_id, 2) AS INTEGER) % 10)
           END AS end_lng,
           CASE WHEN source_file = 'new' OR k % 23 <> 0 THEN member_type END AS member_type
    FROM (SELECT t.*, CAST(ride_id AS BIGINT) AS event, c.copy,
                 CASE WHEN CAST(ride_id AS BIGINT) % 10 = 9 THEN 'legacy' ELSE 'new' END
                     AS source_file
          FROM trips t JOIN (VALUES (0), (1)) c(copy)
            ON c.copy = 0 OR CAST(t.ride_id AS BIGINT) % 50 IN (0, 9))"""
COLUMNS = ", ".join(C.UNIFIED_COLUMNS)
CTES["labelled"] = rf"""
    SELECT *, CASE
        WHEN nth > 1 THEN 'duplicate'
        WHEN started_at IS NULL OR ended_at IS NULL THEN 'unparseable_time'
        WHEN length <= 0 THEN 'duration_nonpositive'
        WHEN length < 60 THEN 'duration_under_60s'
        WHEN length > 86400 THEN 'duration_over_24h'
        WHEN regexp_matches(coalesce(start_station_name, ''), '{C.STAFF_NAMES}')
          OR regexp_matches(coalesce(end_station_name, ''), '{C.STAFF_NAMES}') THEN 'test_station'
        WHEN start_station_id IS NULL AND end_station_id IS NULL THEN 'no_station' END AS rule
    FROM (SELECT *, epoch(ended_at) - epoch(started_at) AS length,
                 CASE WHEN source_file = 'new'
                      THEN row_number() OVER (PARTITION BY source_file, ride_id
                                              ORDER BY event, copy)
                      ELSE row_number() OVER (PARTITION BY source_file, {COLUMNS}
                                              ORDER BY event, copy) END AS nth
          FROM unified)"""
COORDINATES = "start_lat start_lng end_lat end_lng"


@query("b1_schema_detection", with_ctes("""
    SELECT source_file AS schema_kind, count(*) AS n_rows FROM unified GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    parts = []
    for raw in (P.raw_new(spark, sf), P.raw_legacy(spark, sf)):
        kind = C.detect_schema([f" {c.upper()} " for c in raw.columns])
        parts.append(raw.agg(F.lit(kind).alias("schema_kind"), F.count("*").alias("n_rows")))
    return parts[0].unionByName(parts[1])


@query("b2_unified_schema", with_ctes(f"SELECT {COLUMNS} FROM unified"), doubles=COORDINATES)
def _(spark, sf):
    return P.unified(spark, sf).select(*C.UNIFIED_COLUMNS)


@query("b3_member_map", with_ctes("""
    SELECT source_file, member_type, count(*) AS n FROM unified GROUP BY 1, 2"""))  # fmt: skip
def _(spark, sf):
    return P.unified(spark, sf).groupBy("source_file", "member_type").agg(F.count("*").alias("n"))


@query("b4_parse_times", with_ctes("""
    SELECT source_file, started_at, ended_at, count(*) AS n FROM unified GROUP BY 1, 2, 3"""))  # fmt: skip
def _(spark, sf):
    by = ["source_file", "started_at", "ended_at"]
    return P.unified(spark, sf).groupBy(*by).agg(F.count("*").alias("n"))


@query("b5_parse_coordinates", with_ctes("""
    SELECT source_file, start_lat, start_lng, end_lat, end_lng, count(*) AS n
    FROM unified GROUP BY ALL"""), doubles=COORDINATES)  # fmt: skip
def _(spark, sf):
    by = ["source_file", *COORDINATES.split()]
    return P.unified(spark, sf).groupBy(*by).agg(F.count("*").alias("n"))


@query("b6_strip_text", with_ctes("""
    SELECT start_station_id, end_station_id, end_station_name, count(*) AS n
    FROM unified GROUP BY 1, 2, 3"""))  # fmt: skip
def _(spark, sf):
    by = ["start_station_id", "end_station_id", "end_station_name"]
    return P.unified(spark, sf).groupBy(*by).agg(F.count("*").alias("n"))


@query("b7_staff_stations", with_ctes(rf"""
    SELECT start_station_name AS name,
           regexp_matches(start_station_name, '{C.STAFF_NAMES}') AS staff, count(*) AS n
    FROM unified GROUP BY 1, 2"""))  # fmt: skip
def _(spark, sf):
    staff = C.is_staff_station(F.col("start_station_id"), F.col("start_station_name"))
    return (
        P.unified(spark, sf)
        .groupBy(F.col("start_station_name").alias("name"), staff.alias("staff"))
        .agg(F.count("*").alias("n"))
    )


@query("b7_staff_part_types", rf"""
    SELECT p_type AS name, regexp_matches(p_type || ' depot ' || p_name, '{C.STAFF_NAMES}')
        AS with_word, regexp_matches('test' || p_name, '{C.STAFF_NAMES}') AS within_word,
        count(*) AS n
    FROM part GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, sf):
    """Word boundaries over the part names: a separate word matches, part of a word does not."""
    none = F.lit(None).cast("string")
    named = F.concat("p_type", F.lit(" depot "), "p_name")
    inside = F.concat(F.lit("test"), F.col("p_name"))
    return (
        P.table(spark, sf, "part")
        .groupBy(
            F.col("p_type").alias("name"),
            C.is_staff_station(none, named).alias("with_word"),
            C.is_staff_station(none, inside).alias("within_word"),
        )
        .agg(F.count("*").alias("n"))
    )


@query("b8_first_copies", with_ctes(f"""
    SELECT source_file, {COLUMNS}, copies
    FROM (SELECT *, count(*) OVER (PARTITION BY source_file, event) AS copies FROM unified)
    WHERE copy = 0"""), doubles=COORDINATES)  # fmt: skip
def _(spark, sf):
    return C.first_copies(P.unified(spark, sf))


HITS = {
    "b9": ("unparseable_time", "started_at IS NULL OR ended_at IS NULL"),
    "b10": ("duration_nonpositive", "epoch(ended_at) - epoch(started_at) <= 0"),
    "b11": ("duration_under_60s", "epoch(ended_at) - epoch(started_at) < 60"),
    "b12": ("duration_over_24h", "epoch(ended_at) - epoch(started_at) > 86400"),
    "b13": ("test_station", f"regexp_matches(start_station_name, '{C.STAFF_NAMES}')"),
    "b14": ("no_station", "start_station_id IS NULL AND end_station_id IS NULL"),
}
for _id, (_rule, _sql) in HITS.items():

    @query(f"{_id}_{_rule}", with_ctes(f"""
        SELECT source_file, count(*) FILTER (WHERE {_sql}) AS hits, count(*) AS n
        FROM unified GROUP BY 1"""))  # fmt: skip
    def _(spark, sf, rule=_rule):
        """Rows that the rule hits when it is applied alone."""
        hit = F.coalesce(dict(C.rule_predicates())[rule], F.lit(False))
        return P.unified(spark, sf).groupBy("source_file").agg(
            F.count_if(hit).alias("hits"), F.count("*").alias("n")
        )


@query("b15_rule_counts", with_ctes("""
    SELECT source_file, count(*) AS rows_in,
           count(*) FILTER (WHERE rule = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE rule = 'unparseable_time') AS unparseable_time,
           count(*) FILTER (WHERE rule = 'duration_nonpositive') AS duration_nonpositive,
           count(*) FILTER (WHERE rule = 'duration_under_60s') AS duration_under_60s,
           count(*) FILTER (WHERE rule = 'duration_over_24h') AS duration_over_24h,
           count(*) FILTER (WHERE rule = 'test_station') AS test_station,
           count(*) FILTER (WHERE rule = 'no_station') AS no_station,
           count(*) FILTER (WHERE rule IS NULL) AS rows_out
    FROM labelled GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    return C.removed_counts(C.label_rows(P.unified(spark, sf)))


@query("b15_kept_rows", with_ctes(f"""
    SELECT source_file, {COLUMNS} FROM labelled WHERE rule IS NULL"""), doubles=COORDINATES)  # fmt: skip
def _(spark, sf):
    return C.kept_rows(C.label_rows(P.unified(spark, sf)))


@query("b16_distinct_trips", with_ctes(f"""
    SELECT {COLUMNS} FROM (
        SELECT *, row_number() OVER (
            PARTITION BY ride_id, started_at,
                CASE WHEN ride_id IS NULL THEN struct_pack({', '.join(f'a{i} := {c}' for i, c in enumerate(C.UNIFIED_COLUMNS))}) END
            ORDER BY {', '.join(f'{c} NULLS FIRST' for c in C.UNIFIED_COLUMNS)}) AS nth
        FROM unified) WHERE nth = 1"""), doubles=COORDINATES)  # fmt: skip
def _(spark, sf):
    return C.distinct_trips(P.unified(spark, sf).select(*C.UNIFIED_COLUMNS))


@query("b16_distinct_lineitems", """
    SELECT * EXCLUDE (nth) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                     l_returnflag, l_linestatus, l_shipdate) AS nth FROM lineitem)
    WHERE nth = 1""", doubles="l_quantity l_extendedprice l_discount l_tax")  # fmt: skip
def _(spark, sf):
    """The same over a larger table, in which many keys repeat with different rows."""
    return C.distinct_trips(P.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
