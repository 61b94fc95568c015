"""Hourly weather on the local grid."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velotide.functions.columns import elapsed_seconds
from velotide.operators.grid import hour_spine
from velotide.settings import TIMEZONE

# The service's names for the variables, and the clip of model artefacts.
VARIABLES = {
    "temperature_2m": "temp_c",
    "precipitation": "precip_mm",
    "wind_speed_10m": "wind_kmh",
}
FIELDS = ("temp_c", "precip_mm", "wind_kmh")
PRECIP_CLIP_MM = 30.0
FILL_LIMIT = 2

PAYLOAD_SCHEMA = (
    "hourly struct<time array<string>, temperature_2m array<double>, "
    "precipitation array<double>, wind_speed_10m array<double>>"
)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)


def payload_rows(payload: DataFrame) -> DataFrame:
    """The parallel arrays of a payload as rows: UTC time and the renamed variables."""
    zipped = F.arrays_zip("hourly.time", *[f"hourly.{v}" for v in VARIABLES])
    return payload.select(F.inline(zipped)).select(
        F.col("time").cast("timestamp_ntz").alias("utc"),
        *[F.col(v).alias(name) for v, name in VARIABLES.items()],
    )


def to_local(utc: Column, timezone: str = TIMEZONE) -> Column:
    """Naive UTC to naive local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc)


def local_readings(rows: DataFrame, timezone: str = TIMEZONE) -> DataFrame:
    """One row per local hour. When the clock falls back two UTC hours share a local one: their
    mean counts, over the readings that exist."""
    return rows.groupBy(to_local(F.col("utc"), timezone).alias("ts")).agg(
        *[F.avg(f).alias(f) for f in FIELDS]
    )


def interpolate(grid: DataFrame, limit: int = FILL_LIMIT) -> DataFrame:
    """Fill gaps linearly in time, at most ``limit`` points into each; a gap at the end holds the
    last value, a gap at the start stays NULL.

    One place has one row per hour; several places would go into the window's partitioning. The
    next reading is found by the same running window in reverse order: a frame that looks forward
    would be recomputed for every row.
    """
    place = F.lit(0) if "place" not in grid.columns else F.col("place")
    numbered = grid.withColumn("_place", place).withColumn(
        "_n", F.row_number().over(Window.partitionBy("_place").orderBy("ts"))
    )
    running = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("_place").orderBy("ts").rowsBetween(*running)
    ahead = Window.partitionBy("_place").orderBy(F.desc("ts")).rowsBetween(*running)
    known = {f: F.when(F.col(f).isNotNull(), F.struct("ts", F.col(f).alias("v"), "_n")) for f in FIELDS}
    before = {f"_{f}_b": F.last(known[f], ignorenulls=True).over(back) for f in FIELDS}
    after = {f"_{f}_a": F.last(known[f], ignorenulls=True).over(ahead) for f in FIELDS}
    located = numbered.withColumns(before).withColumns(after)

    def filled(f: str) -> Column:
        b, a = F.col(f"_{f}_b"), F.col(f"_{f}_a")
        share = elapsed_seconds(b["ts"], F.col("ts")) / elapsed_seconds(b["ts"], a["ts"])
        line = F.when(a.isNull(), b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * share)
        in_reach = F.col("_n") - b["_n"] <= limit
        return F.when(F.col(f).isNotNull(), F.col(f)).when(b.isNotNull() & in_reach, line)

    kept = [c for c in grid.columns if c not in FIELDS]
    return located.select(*kept, *[filled(f).alias(f) for f in FIELDS])


def to_local_grid(
    rows: DataFrame, start: datetime, end: datetime, timezone: str = TIMEZONE
) -> DataFrame:
    """Readings in UTC as one row per local hour of [start, end), gaps filled where they are short.

    Readings outside the range take part in filling, as neighbours of its first and last hours.
    """
    readings = local_readings(rows, timezone)
    spine = hour_spine(rows.sparkSession, start, end)
    whole = spine.withColumn("wanted", F.lit(True)).join(readings, "ts", "full_outer")
    return interpolate(whole).filter("wanted").select("ts", *FIELDS)


def weather_gaps(grid: DataFrame) -> DataFrame:
    """One row: how many hours lack a value, and the first of them."""
    missing = F.lit(False)
    for f in FIELDS:
        missing = missing | F.col(f).isNull()
    return grid.agg(
        F.count_if(missing).alias("missing_hours"),
        F.min(F.when(missing, F.col("ts"))).alias("first_missing"),
    )


def require_no_gaps(grid: DataFrame) -> DataFrame:
    found = weather_gaps(grid).first()
    if found["missing_hours"]:
        raise ValueError(
            f"weather gaps: {found['missing_hours']} hours, first {found['first_missing']}"
        )
    return grid


def weather_profile(grid: DataFrame) -> DataFrame:
    return grid.agg(
        F.count("*").alias("hours"),
        F.min("temp_c").alias("min_temp"),
        F.max("temp_c").alias("max_temp"),
        F.avg((F.col("precip_mm") > 0).cast("int")).alias("wet_share"),
    )


def weather_features(weather: DataFrame) -> DataFrame:
    """Temperature and wind as they are; precipitation clipped to 0..30 mm, then log1p."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(PRECIP_CLIP_MM), F.col("precip_mm")))
    precip = F.when(F.col("precip_mm").isNotNull(), F.log1p(clipped))
    return weather.select("ts", "temp_c", "wind_kmh", precip.alias("precip_log"))
