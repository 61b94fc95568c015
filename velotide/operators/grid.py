"""Hourly demand series on a complete grid, and the closure mask over it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velotide.functions.columns import days, hour_floor, hours, naive
from velotide.session import small_side, written
from velotide.settings import CLOSED_MIN_HOURS, SYSTEM_ID

# Hours of all stations that one task unfolds and its windows sort: about 100 MB. Also trip ends that one task folds.
GRID_ROWS = 1 << 19
# Tasks that may share the ends of one busy hour of a station, where ends are dealt before they are folded.
SHARES = 4


def hour_array(start: datetime, end: datetime) -> Column:
    """All hours of [start, end) as one array, exploded where it is needed."""
    return F.sequence(naive(start), naive(end) - hours(1), F.expr("INTERVAL '1' HOUR"))


def hour_spine(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    return spark.range(1).select(F.explode(hour_array(start, end)).alias("ts"))


def station_grid(stations: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Every station with every hour. Each station row unfolds its own hours: nothing is joined."""
    return stations.select("station_id", F.explode(hour_array(start, end)).alias("ts"))


def trip_end_hours(trips: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row per trip end inside [start, end): raw station, hour, which end it is, and its own time.

    Both ends come out of one pass over the trips. The departure is kept or dropped by its own
    time and the arrival by its own, so a trip that ends past the range still departs.
    """
    low, high = naive(start), naive(end)
    touches = ((F.col("started_at") >= low) & (F.col("started_at") < high)) | (
        (F.col("ended_at") >= low) & (F.col("ended_at") < high)
    )
    ends = F.array(
        F.struct(
            F.col("start_station_id").alias("station_id"),
            F.col("started_at").alias("at"),
            F.lit(1).alias("departure"),
        ),
        F.struct(
            F.col("end_station_id").alias("station_id"),
            F.col("ended_at").alias("at"),
            F.lit(0).alias("departure"),
        ),
    )
    return (
        trips.filter(touches)
        .select(F.inline(ends))
        .filter(F.col("station_id").isNotNull() & (F.col("at") >= low) & (F.col("at") < high))
        .select("station_id", hour_floor(F.col("at")).alias("ts"), "departure", "at")
    )


def to_canonical(ends: DataFrame, crosswalk: DataFrame | None) -> DataFrame:
    """Replace raw IDs by canonical ones; ends without an entry drop out, as in an inner join."""
    if crosswalk is None:
        return ends
    return ends.join(small_side(crosswalk), "station_id").select(
        F.col("canonical_id").alias("station_id"), "ts", "departure", "at"
    )


def _folded(ends: DataFrame, tasks: int) -> DataFrame:
    """Departures and arrivals per station and hour with any; an hour may have up to ``SHARES`` rows.

    As many hours as fit one task fit every map-side step too. Of more, a map-side step could hold
    every end of its part of the input: ends are dealt first, to as many tasks as keep ``GRID_ROWS``
    of them in one.
    """
    share = F.pmod(F.xxhash64("at"), F.lit(SHARES)).alias("share")
    ends, keys = ends.select("station_id", "ts", "departure", share), ["station_id", "ts"]
    if tasks > 1:
        keys.append("share")
        ends = ends.repartition(max(1, -(-ends.count() // GRID_ROWS)), *keys)
    departures = F.sum("departure")
    return (
        ends.groupBy(*keys)
        .agg(departures.alias("departures"), (F.count("*") - departures).alias("arrivals"))
        .select("station_id", "ts", "departures", "arrivals")
    )



def departures_by_hour(
    trips: DataFrame, start: datetime, end: datetime, crosswalk: DataFrame | None = None
) -> DataFrame:
    ends = trip_end_hours(trips, start, end).filter("departure = 1")
    return to_canonical(ends, crosswalk).groupBy("station_id", "ts").agg(F.count("*").alias("n"))


def arrivals_by_hour(
    trips: DataFrame, start: datetime, end: datetime, crosswalk: DataFrame | None = None
) -> DataFrame:
    ends = trip_end_hours(trips, start, end).filter("departure = 0")
    return to_canonical(ends, crosswalk).groupBy("station_id", "ts").agg(F.count("*").alias("n"))


def hourly_counts(
    trips: DataFrame,
    stations: DataFrame,
    start: datetime,
    end: datetime,
    crosswalk: DataFrame | None = None,
    selective: bool = False,
) -> DataFrame:
    """Zero-filled departures, arrivals and net flow per selected station and hour.

    Only hours with a trip end are aggregated and shuffled (:func:`_folded`). Every station adds one
    row just before the range; each row then unfolds itself and the empty hours up to the next one,
    after the last shuffle, so that no empty hour is hashed or sent. Stations are dealt to as many
    tasks as keep ``GRID_ROWS`` hours in one, and stay dealt for the windows that follow. Ends at
    stations that are not on the grid form groups without that first row and are dropped;
    ``selective`` drops them before the aggregation, which pays when the selected stations are a
    small part of all.
    """
    stations = written(stations.select("station_id"), "stations")
    ends = to_canonical(trip_end_hours(trips, start, end), crosswalk)
    if selective:
        ends = ends.join(small_side(stations), "station_id", "left_semi")
    n_hours = int((end - start).total_seconds() // 3600)
    tasks = max(1, -(-stations.count() * n_hours // GRID_ROWS))
    nothing = F.lit(0).cast("bigint")
    first = stations.select(
        "station_id",
        (naive(start) - hours(1)).alias("ts"),
        nothing.alias("departures"),
        nothing.alias("arrivals"),
        F.lit(True).alias("on_grid"),
    )
    known = (
        first.unionByName(_folded(ends, tasks).withColumn("on_grid", F.lit(False)))
        .repartition(tasks, "station_id")
        .groupBy("station_id", "ts")
        .agg(
            F.sum("departures").alias("departures"),
            F.sum("arrivals").alias("arrivals"),
            F.max("on_grid").alias("on_grid"),
        )
    )
    by_time = Window.partitionBy("station_id").orderBy("ts")
    following = F.coalesce(F.lead("ts").over(by_time), naive(end))
    here = F.col("hour") == F.col("ts")
    return (
        known.select(
            "station_id",
            "ts",
            "departures",
            "arrivals",
            F.first("on_grid").over(by_time).alias("on_grid"),
            following.alias("following"),
        )
        .filter("on_grid")
        .withColumn(
            "hour",
            F.explode(
                F.sequence("ts", F.col("following") - hours(1), F.expr("INTERVAL '1' HOUR"))
            ),
        )
        .filter(F.col("hour") >= naive(start))
        .select(
            "station_id",
            F.col("hour").alias("ts"),
            F.when(here, F.col("departures")).otherwise(0).cast("int").alias("departures"),
            F.when(here, F.col("arrivals")).otherwise(0).cast("int").alias("arrivals"),
            F.when(here, F.col("arrivals") - F.col("departures"))
            .otherwise(0)
            .cast("int")
            .alias("net_flow"),
        )
    )


def system_counts(trips: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Zero-filled totals over every station with an ID, merged or not, selected or not."""
    ends = trip_end_hours(trips, start, end).select(
        "ts",
        F.col("departure").cast("bigint").alias("departures"),
        (1 - F.col("departure")).cast("bigint").alias("arrivals"),
    )
    nothing = F.lit(0).cast("bigint")
    spine = hour_spine(trips.sparkSession, start, end).select(
        "ts", nothing.alias("departures"), nothing.alias("arrivals")
    )
    return (
        spine.unionByName(ends)
        .groupBy("ts")
        .agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"))
        .select(
            F.lit(SYSTEM_ID).alias("station_id"),
            "ts",
            F.col("departures").cast("int").alias("departures"),
            F.col("arrivals").cast("int").alias("arrivals"),
            (F.col("arrivals") - F.col("departures")).cast("int").alias("net_flow"),
        )
    )


def with_idle_runs(hourly: DataFrame) -> DataFrame:
    """Add ``run_start`` and ``run_end`` of the maximal idle run around each idle hour.

    Idle means no departure and no arrival. Within a station, the number of busy hours so far
    stays constant along a run of idle hours, so it names the run. Both windows share the
    station partitioning: the rows of one station are its hours, however many trips it has.
    """
    so_far = (
        Window.partitionBy("station_id")
        .orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run = Window.partitionBy("station_id", "busy_before", "idle")
    idle = (F.col("departures") == 0) & (F.col("arrivals") == 0)
    busy_before = F.count_if(~idle).over(so_far)
    return (
        hourly.withColumns({"idle": idle, "busy_before": busy_before})
        .withColumns(
            {
                "run_start": F.when(F.col("idle"), F.min("ts").over(run)),
                "run_end": F.when(F.col("idle"), F.max("ts").over(run)),
            }
        )
        .drop("idle", "busy_before")
    )


def open_as_of(cutoff: Column, min_hours: int = CLOSED_MIN_HOURS) -> Column:
    """In service as far as could be known just before ``cutoff``: an idle run counts only the
    hours seen by then. Needs the columns of :func:`with_idle_runs`."""
    seen_until = F.least(F.col("run_end") + hours(1), cutoff)
    closed = (seen_until - F.col("run_start")) >= hours(min_hours)
    return ~F.coalesce(closed, F.lit(False))


def in_service(min_hours: int = CLOSED_MIN_HOURS) -> Column:
    """In service in hindsight. Needs the columns of :func:`with_idle_runs`."""
    closed = (F.col("run_end") + hours(1) - F.col("run_start")) >= hours(min_hours)
    return ~F.coalesce(closed, F.lit(False))


def flag_in_service(hourly: DataFrame, min_hours: int = CLOSED_MIN_HOURS) -> DataFrame:
    """Adds in_service: no part of an idle run of ``min_hours`` or longer. The whole run decides, later
    hours included, so the column may weigh and select rows but must not feed a model."""
    return (
        with_idle_runs(hourly)
        .withColumn("in_service", in_service(min_hours))
        .drop("run_start", "run_end")
    )


def visible_before(
    hourly: DataFrame, cutoff: datetime, min_hours: int = CLOSED_MIN_HOURS
) -> DataFrame:
    """Rows before ``cutoff`` with the mask as of then."""
    return (
        with_idle_runs(hourly.drop("in_service"))
        .filter(F.col("ts") < naive(cutoff))
        .withColumn("in_service", open_as_of(naive(cutoff), min_hours))
        .drop("run_start", "run_end")
    )


def visible_before_each(
    hourly: DataFrame, cutoffs: list[datetime], min_hours: int = CLOSED_MIN_HOURS
) -> DataFrame:
    """:func:`visible_before` for several cutoffs in one pass, one copy of a row per cutoff that
    lies after it. The runs are found once, not once per cutoff."""
    every = F.array(*[naive(c) for c in cutoffs])
    return (
        with_idle_runs(hourly.drop("in_service"))
        .withColumn("cutoff", F.explode(F.filter(every, lambda c: c > F.col("ts"))))
        .withColumn("in_service", open_as_of(F.col("cutoff"), min_hours))
        .drop("run_start", "run_end")
    )


def grid_violations(hourly: DataFrame) -> DataFrame:
    """One row: the number of steps within a station, and of steps that are not one hour."""
    step = F.col("ts") - F.lag("ts").over(Window.partitionBy("station_id").orderBy("ts"))
    return (
        hourly.select("station_id", "ts")
        .withColumn("step", step)
        .agg(
            F.count("step").alias("steps"),
            F.count_if(F.col("step") != hours(1)).alias("bad_steps"),
        )
    )


def require_complete_grid(hourly: DataFrame) -> DataFrame:
    bad = grid_violations(hourly).first()["bad_steps"]
    if bad:
        raise ValueError(f"not a complete hourly grid: {bad} steps differ from one hour")
    return hourly


def grid_profile(flagged: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row: rows against expected rows, zero share, closed hours and stations."""
    n_hours = int((end - start).total_seconds() // 3600)
    per_station = flagged.groupBy("station_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("departures") == 0).alias("zeros"),
        F.count_if(~F.col("in_service")).alias("closed"),
        F.sum("departures").alias("departures"),
        F.sum("arrivals").alias("arrivals"),
    )
    total = F.sum("n")
    return per_station.agg(
        total.alias("grid_rows"),
        (F.count("*") * n_hours).alias("expected_rows"),
        F.try_divide(F.sum("zeros"), total).alias("zero_share"),
        F.sum("closed").alias("closed_hours"),
        F.try_divide(F.sum("closed"), total).alias("closed_share"),
        F.count_if(F.col("closed") > 0).alias("closed_stations"),
        F.sum("departures").alias("departures"),
        F.sum("arrivals").alias("arrivals"),
    )


def forecast_days(week_starts: list) -> Column:
    """The seven days of each test week, as one array of structs (test_week, day)."""
    weeks = F.array(*[naive(w) for w in week_starts])
    return F.flatten(
        F.transform(
            weeks,
            lambda w: F.transform(
                F.sequence(w, w + days(6), F.expr("INTERVAL '1' DAY")),
                lambda d: F.struct(w.alias("test_week"), d.alias("day")),
            ),
        )
    )


def day_grid(stations: DataFrame, week_starts: list) -> DataFrame:
    """Stations x forecast days x 24 hours, unfolded per station row."""
    return (
        stations.select("station_id", F.inline(forecast_days(week_starts)))
        .withColumn(
            "ts",
            F.explode(
                F.sequence(
                    F.col("day"), F.col("day") + hours(23), F.expr("INTERVAL '1' HOUR")
                )
            ),
        )
    )


