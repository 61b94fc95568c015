"""Station identity: statistics per raw ID, merges, canonical stations, ranking."""

from __future__ import annotations

import math
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.functions.columns import EARTH_RADIUS_M, haversine_m, name_key, naive
from velotide.functions.quantiles import exact_median
from velotide.session import materialize, small_side
from velotide.settings import RANK_END, RANK_START, TOP_STATIONS

# Limits of the merge rules.
MERGE_RADIUS_M = 50
SAME_NAME_RADIUS_M = 200
OVERLAP_DAYS = 1
GHOST_MAX_DAYS = 31
SETTLED_DAYS = 30

PAIRS_PER_TASK = 2_000_000


def trip_ends(trips: DataFrame) -> DataFrame:
    """Both ends of every trip as observations of a station, in one pass over the trips."""

    def end(side: str, at: str) -> Column:
        return F.struct(
            F.col(f"{side}_station_id").alias("station_id"),
            F.col(f"{side}_station_name").alias("name"),
            F.col(f"{side}_lat").alias("lat"),
            F.col(f"{side}_lng").alias("lng"),
            F.col("rideable_type"),
            F.col(at).alias("ts"),
        )

    both = F.array(end("start", "started_at"), end("end", "ended_at"))
    return trips.select(F.inline(both)).filter(F.col("station_id").isNotNull())


def station_positions(ends: DataFrame) -> DataFrame:
    """Median position per station: of classic bikes, which report the dock, else of all bikes.

    Which bikes count is decided per coordinate, as some station may have classic bikes without
    one of them. Classic bikes repeat few positions, so they fold to little before the shuffle;
    the drifting positions of other bikes are only taken along where there is nothing else.
    """
    classic = F.coalesce(F.col("rideable_type") == "classic_bike", F.lit(False))
    with_dock = small_side(
        ends.filter(classic)
        .groupBy("station_id")
        .agg(*[(F.count(c) > 0).alias(f"dock_{c}") for c in ("lat", "lng")])
    )

    def taken(c: str) -> Column:
        use = classic | ~F.coalesce(f"dock_{c}", F.lit(False))
        return F.struct(F.lit(c).alias("axis"), F.when(use, F.col(c)).alias("value"))

    weighted = (
        ends.join(with_dock, "station_id", "left")
        .select("station_id", F.inline(F.array(taken("lat"), taken("lng"))))
        .filter("value IS NOT NULL")
        .groupBy("station_id", "axis", "value")
        .agg(F.count("*").alias("weight"))
    )
    medians = exact_median(materialize(weighted), ["station_id", "axis"])
    return medians.groupBy("station_id").agg(
        F.max(F.when(F.col("axis") == "lat", F.col("median"))).alias("lat"),
        F.max(F.when(F.col("axis") == "lng", F.col("median"))).alias("lng"),
    )


def station_stats(trips: DataFrame) -> DataFrame:
    """Per raw station ID: latest name, number of names, position, first and last day, trip ends.

    Trip ends are folded per (station, name) first, with fixed-width buffers that hash on the map
    side; names are compared only among those few rows.
    """
    ends = trip_ends(trips)
    per_name = ends.groupBy("station_id", "name").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")
    )
    named = F.when(F.col("name").isNotNull(), F.struct("last_ts", "name"))
    described = per_name.groupBy("station_id").agg(
        F.max_by("name", named).alias("name"),
        F.count("name").alias("n_names"),
        F.to_date(F.min("first_ts")).alias("first_seen"),
        F.to_date(F.max("last_ts")).alias("last_seen"),
        F.sum("n").alias("n_trip_ends"),
    )
    return described.join(station_positions(ends), "station_id", "left").select(
        "station_id",
        "name",
        "n_names",
        "lat",
        "lng",
        "first_seen",
        "last_seen",
        "n_trip_ends",
    )


def _band(lat: Column, height: float) -> Column:
    return F.floor(lat / height)


def _columns_in_band(band: Column, height: float) -> Column:
    """Cells around the globe in a latitude band, each at least ``height`` degrees of arc wide."""
    edge = F.greatest(F.abs(band), F.abs(band + 1)) + 1
    narrowest = F.cos(F.radians(F.least(edge * height, F.lit(90.0))))
    return F.greatest(F.floor(F.lit(360.0 / height) * narrowest), F.lit(1).cast("bigint"))


def _column(lng: Column, n: Column) -> Column:
    return F.pmod(F.floor((lng + 180) / 360 * n), n)


def with_cell(points: DataFrame, radius_m: float) -> DataFrame:
    """Add the grid cell of each point. Points within ``radius_m`` are in the same or in
    neighbouring cells, also across the date line."""
    height = math.degrees(radius_m / EARTH_RADIUS_M) * 1.001
    band = _band(F.col("lat"), height)
    column = _column(F.col("lng"), _columns_in_band(band, height))
    return points.withColumn("cell", F.struct(band.alias("band"), column.alias("col")))


def with_near_cells(points: DataFrame, radius_m: float) -> DataFrame:
    """One row per point and cell that may hold points within ``radius_m``."""
    height = math.degrees(radius_m / EARTH_RADIUS_M) * 1.001
    own = _band(F.col("lat"), height)

    def cells_in(band: Column) -> Column:
        n = _columns_in_band(band, height)
        middle = _column(F.col("lng"), n)
        return F.transform(
            F.array(middle - 1, middle, middle + 1),
            lambda c: F.struct(band.alias("band"), F.pmod(c, n).alias("col")),
        )

    cells = F.flatten(F.array(*[cells_in(own + step) for step in (-1, 0, 1)]))
    return points.withColumn("cell", F.explode(F.array_distinct(cells)))


def _pairs_by_cell(left: DataFrame, right: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Join on ``keys`` with a condition, splitting crowded keys into slices.

    Pairs that fail the condition never leave the join. Where a key has more than
    ``PAIRS_PER_TASK`` pairs to compare, its right side is cut into slices that each meet the
    whole left side of the key. Mostly no key is crowded, and the join is a plain one.
    """
    in_left = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    in_right = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    pairs = F.col("n_left") * F.col("n_right")
    crowded = materialize(
        in_left.join(in_right, keys)
        .filter(pairs > PAIRS_PER_TASK)
        .select(*keys, F.least(F.ceil(pairs / PAIRS_PER_TASK), F.col("n_right")).alias("slices"))
    )
    if crowded.isEmpty():
        return left.join(right, keys).filter(condition)
    slices = F.coalesce("slices", F.lit(1).cast("bigint"))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1))
    sliced_left = left.join(crowded, keys, "left").withColumn("slice", numbers)
    sliced_right = right.join(crowded, keys, "left").withColumn(
        "slice", F.pmod(F.xxhash64("b.station_id"), slices)
    )
    both = [*keys, "slice"]
    return sliced_left.drop("slices").join(sliced_right.drop("slices"), both).filter(condition)


def find_merges(stats: DataFrame, ghost_max_days: int = GHOST_MAX_DAYS) -> DataFrame:
    """Pairs of raw IDs that are one station, with distance, overlap and reason.

    ``ghost``: within 50 m, and one of the two lived at most ``ghost_max_days``. ``replacement``:
    within 50 m, or within 200 m under the same name, and they overlap by at most a day. The two
    distance rules are two joins, on 50 m cells and on the name with 200 m cells, so that the
    wide radius never meets the crowd of all stations around.
    """
    life = F.datediff("last_seen", "first_seen") + 1
    points = stats.filter("lat IS NOT NULL AND lng IS NOT NULL").select(
        "station_id", "name", "lat", "lng", "first_seen", "last_seen",
        life.alias("life"), name_key(F.col("name")).alias("name_key"),
    )

    def candidates(radius: float, by_name: bool) -> DataFrame:
        packed = F.struct(*points.columns)
        keys = ["cell", "name_key"] if by_name else ["cell"]
        a = with_near_cells(points, radius).select(*keys, packed.alias("a"))
        b = with_cell(points, radius).select(*keys, packed.alias("b"))
        distance = haversine_m(*[F.col(f"{p}.{c}") for p in ("a", "b") for c in ("lat", "lng")])
        brief = F.least(F.col("a.life"), F.col("b.life")) <= ghost_max_days
        overlap = F.greatest(
            F.lit(0),
            F.datediff(
                F.least("a.last_seen", "b.last_seen"), F.greatest("a.first_seen", "b.first_seen")
            ),
        )
        ordered = F.col("a.station_id") < F.col("b.station_id")
        near = distance <= radius
        apart = overlap <= OVERLAP_DAYS
        fits = apart if by_name else apart | brief
        return _pairs_by_cell(a, b, keys, ordered & fits & near).select(
            "a", "b", distance.alias("dist_m"), overlap.alias("overlap_days")
        )

    near = candidates(MERGE_RADIUS_M, False)
    named = candidates(SAME_NAME_RADIUS_M, True).filter(F.col("dist_m") > MERGE_RADIUS_M)
    shorter = F.least(F.col("a.life"), F.col("b.life"))
    ghost = (F.col("dist_m") <= MERGE_RADIUS_M) & (shorter <= ghost_max_days)
    return near.unionByName(named).select(
        F.col("a.station_id").alias("id_a"),
        F.col("b.station_id").alias("id_b"),
        F.col("a.name").alias("name_a"),
        F.col("b.name").alias("name_b"),
        "dist_m",
        (F.col("a.name_key").eqNullSafe(F.col("b.name_key"))).alias("same_name"),
        "overlap_days",
        shorter.alias("shorter_life_days"),
        F.when(ghost, "ghost").otherwise("replacement").alias("reason"),
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node that has an edge (id_a, id_b): its smallest node.

    Each round takes the smallest label among a node and its neighbours and then the label of
    that label, so chains shrink by more than a step per round. A round ends in a checkpoint; the
    driver sees one number, the count of labels that still changed.
    """
    both = F.array(
        F.struct(F.col("id_a").alias("node"), F.col("id_b").alias("other")),
        F.struct(F.col("id_b").alias("node"), F.col("id_a").alias("other")),
    )
    links = materialize(edges.select(F.inline(both)).distinct())
    labels = links.groupBy("node").agg(F.min("other").alias("nearest"))
    labels = materialize(labels.select("node", F.least("node", "nearest").alias("label")))
    while True:
        around = (
            links.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("around"))
        )
        stepped = labels.join(around, "node").select(
            "node", "label", F.least("label", "around").alias("next")
        )
        jump = stepped.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        moved = materialize(
            stepped.join(jump, "next").select(
                "node", F.least("next", "beyond").alias("new"), F.col("label").alias("old")
            )
        )
        changed = moved.filter("new <> old").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("node").alias("station_id"), F.col("label").alias("component"))


def build_crosswalk(stats: DataFrame, merges: DataFrame) -> DataFrame:
    """Raw ID to canonical ID: within a component the one seen last, then the busiest, then the
    smallest ID. Stations without a merge stand for themselves."""
    components = connected_components(merges)
    members = stats.join(components, "station_id", "left").select(
        "station_id",
        "last_seen",
        "n_trip_ends",
        F.coalesce("component", "station_id").alias("component"),
    )
    preference = F.struct(
        (-F.unix_date("last_seen")).alias("age"), (-F.col("n_trip_ends")).alias("quiet"), "station_id"
    )
    best = members.groupBy("component").agg(F.min(preference)["station_id"].alias("canonical_id"))
    return members.join(best, "component").select("station_id", "canonical_id")


def rank_stations(
    trips: DataFrame,
    crosswalk: DataFrame,
    start: date | datetime = RANK_START,
    end: date | datetime = RANK_END,
) -> DataFrame:
    """Trip ends per canonical station over trips that start inside the window."""
    inside = (F.col("started_at") >= naive(start)) & (F.col("started_at") < naive(end))
    per_raw = (
        trips.filter(inside)
        .select(F.explode(F.array("start_station_id", "end_station_id")).alias("station_id"))
        .groupBy("station_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_raw.join(crosswalk, "station_id")
        .groupBy("canonical_id")
        .agg(F.sum("n").alias("rank_volume"))
        .orderBy(F.desc("rank_volume"), "canonical_id")
    )


def canonical_stations(
    stats: DataFrame, crosswalk: DataFrame, ranks: DataFrame, top_n: int = TOP_STATIONS
) -> DataFrame:
    """One row per canonical station, by volume, with the ``top_n`` flagged."""
    lives = (
        stats.select("station_id", "first_seen", "last_seen")
        .join(crosswalk, "station_id")
        .groupBy("canonical_id")
        .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    )
    place = stats.select(F.col("station_id").alias("canonical_id"), "name", "lat", "lng")
    known = lives.join(place, "canonical_id").join(ranks, "canonical_id", "left")
    full = known.withColumn("rank_volume", F.coalesce("rank_volume", F.lit(0)))
    by_volume = [F.desc("rank_volume"), F.asc("canonical_id")]
    top = full.orderBy(*by_volume).limit(top_n).select("canonical_id", F.lit(True).alias("_top"))
    return (
        full.join(top, "canonical_id", "left")
        .withColumn("is_top", F.coalesce("_top", F.lit(False)))
        .drop("_top")
        .orderBy(*by_volume)
    )


def neighbor_changes(
    stats: DataFrame, top_ids: DataFrame, settled_days: int = SETTLED_DAYS
) -> DataFrame:
    """Raw IDs within 50 m of a top station that opened or closed well inside the data range."""
    bounds = stats.agg(F.min("first_seen").alias("first"), F.max("last_seen").alias("last"))
    opened = F.col("first_seen") > F.date_add(bounds.select("first").scalar(), settled_days)
    closed = F.col("last_seen") < F.date_sub(bounds.select("last").scalar(), settled_days)
    columns = ["station_id", "name", "lat", "lng", "first_seen", "last_seen"]
    placed = stats.filter("lat IS NOT NULL AND lng IS NOT NULL").select(*columns)
    top = placed.join(top_ids.select("station_id").distinct(), "station_id", "left_semi")
    a = with_near_cells(top, MERGE_RADIUS_M).select("cell", F.struct(*columns).alias("a"))
    b = with_cell(placed.filter(opened | closed), MERGE_RADIUS_M).select(
        "cell", F.struct(*columns).alias("b")
    )
    distance = haversine_m(*[F.col(f"{p}.{c}") for p in ("a", "b") for c in ("lat", "lng")])
    other = F.col("a.station_id") != F.col("b.station_id")
    return _pairs_by_cell(a, b, ["cell"], other & (distance <= MERGE_RADIUS_M)).select(
        F.col("a.station_id").alias("top_station"),
        F.col("a.name").alias("top_name"),
        F.col("b.station_id").alias("neighbor"),
        F.col("b.name").alias("neighbor_name"),
        F.col("b.first_seen").alias("neighbor_first_seen"),
        F.col("b.last_seen").alias("neighbor_last_seen"),
    )


def merge_listing(merges: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """The merges with the station that they lead to."""
    return merges.join(crosswalk.withColumnRenamed("station_id", "id_a"), "id_a").orderBy(
        "id_a", "id_b"
    )


def identity_summary(stats: DataFrame, merges: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """One row: raw IDs, canonical stations, merged pairs, IDs with more than one name."""
    pairs = merges.agg(F.count("*")).scalar()
    canonical = crosswalk.agg(F.count_distinct("canonical_id")).scalar()
    return stats.agg(
        F.count("*").alias("raw_ids"), F.count_if(F.col("n_names") > 1).alias("multi_name_ids")
    ).select(
        "raw_ids",
        canonical.alias("canonical_ids"),
        pairs.alias("merged_pairs"),
        "multi_name_ids",
    )


def top_share(stations: DataFrame) -> DataFrame:
    """One row: share of all ranked trip ends that the top stations have."""
    top = F.sum(F.when(F.col("is_top"), F.col("rank_volume")).otherwise(0))
    return stations.agg(
        F.count_if("is_top").alias("top_stations"),
        F.try_divide(top, F.sum("rank_volume")).alias("top_share"),
    )


def gone_before(stations: DataFrame, last_test_day: date) -> DataFrame:
    """Top stations that were not seen through the last test day."""
    return stations.filter(F.col("is_top") & (F.col("last_seen") < F.lit(last_test_day)))
