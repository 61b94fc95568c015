"""The test tables seen as trips, weather and series, so that every operator has real input.

Each function reads the whole table. The same definitions exist as SQL in ``registry.sql``.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.functions.columns import days, hour_floor, naive, seconds
from velotide.operators.cleaning import normalize
from velotide.operators.forecast import baseline_forecasts, to_long
from velotide.operators.grid import hourly_counts
from velotide.settings import AVERAGE, NAIVE, TARGETS

START = datetime(2024, 1, 1)
END = datetime(2024, 1, 31)
WEEKS = (date(2024, 1, 15), date(2024, 1, 22))
RANK = (date(2024, 1, 1), date(2024, 1, 8))
IDLE_HOURS = 6
BLEND = "blend"
MODELS = [NAIVE, AVERAGE, BLEND]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trips, before any cleaning."""
    seconds_long = (4 * F.round(F.col("value") * 100) - 20).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", _k())
        .select(
            F.col("event_id").cast("string").alias("ride_id"),
            F.when(F.col("event_type").isin("click", "view"), "classic_bike")
            .otherwise("electric_bike")
            .alias("rideable_type"),
            F.col("ts").alias("started_at"),
            (F.col("ts") + seconds(seconds_long)).alias("ended_at"),
            F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("start_station_id"),
            F.when(F.col("k") % 17 != 0, F.concat(F.lit("S"), (F.col("k") % 20).cast("string")))
            .alias("end_station_id"),
            F.when(F.col("event_type") != "error", "member").otherwise("casual")
            .alias("member_type"),
            "k",
        )
    )


def valid_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of one minute to one day."""
    length = F.col("ended_at") - F.col("started_at")
    return trips(spark, sf_dir).filter((length >= seconds(60)) & (length <= days(1)))


def station_ids(trips_df: DataFrame) -> DataFrame:
    """Every station that some trip starts or ends at."""
    both = F.array("start_station_id", "end_station_id")
    return (
        trips_df.select(F.explode(both).alias("station_id"))
        .filter(F.col("station_id").isNotNull())
        .distinct()
    )


def station_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_trips(spark, sf_dir)
    return hourly_counts(valid, station_ids(valid), START, END)


def user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse series per user, in which the two-day closure rule does fire."""
    as_trips = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("start_station_id"),
        F.col("ts").alias("started_at"),
        F.lit(None).cast("string").alias("end_station_id"),
        F.col("ts").alias("ended_at"),
    )
    return hourly_counts(as_trips, station_ids(as_trips), START, END)


def located_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid trips with raw station IDs that change, names and positions."""
    valid = valid_trips(spark, sf_dir)

    def number(end: str) -> Column:
        return F.substring(F.col(f"{end}_station_id"), 2, 9).cast("int")

    def end_columns(end: str, at: str) -> list[Column]:
        i, ts = number(end), F.col(at)
        suffix = (
            F.when(i.isin(3, 7) & (ts >= naive(date(2024, 1, 16))), "N")
            .when((i == 5) & (F.to_date(ts) == F.lit(date(2024, 1, 10))), "5G")
            .otherwise("")
        )
        raw = F.when(F.substring(suffix, 1, 1) == "5", F.lit("S5G")).otherwise(
            F.concat(F.lit("S"), i.cast("string"), suffix)
        )
        kind = (
            F.when(i % 4 == 0, "MIT Lab ")
            .when(i % 4 == 1, "Harvard Yard ")
            .when(i % 4 == 2, "Summit Road ")
            .otherwise("Harbor Point ")
        )
        renamed = F.when(
            (i % 5 == 0) & (ts >= naive(date(2024, 1, 20))), F.lit(" Annex")
        ).otherwise("")
        drift = F.when(F.col("rideable_type") == "electric_bike", (F.col("k") - 50) * 0.000001)
        shift = F.coalesce(drift, F.lit(0.0))
        lat = 42.36 + (i % 10) * 0.01 + F.floor(i / 10) * 0.00015 + shift
        lng = F.when(i.isNotNull(), F.lit(-71.06) + shift)
        return [
            raw.alias(f"{end}_station_id"),
            F.concat(kind, i.cast("string"), renamed).alias(f"{end}_station_name"),
            lat.alias(f"{end}_lat"),
            lng.alias(f"{end}_lng"),
        ]

    return valid.select(
        "ride_id",
        "rideable_type",
        "started_at",
        "ended_at",
        *end_columns("start", "started_at"),
        *end_columns("end", "ended_at"),
        "member_type",
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings in local time; hours without any event have no row."""
    view, error = F.col("event_type") == "view", F.col("event_type") == "error"
    return (
        table(spark, sf_dir, "events")
        .groupBy(hour_floor(F.col("ts")).alias("ts"))
        .agg(
            F.avg(F.when(view, F.col("value"))).alias("temp_c"),
            F.coalesce(F.sum(F.when(error, F.col("value"))) / 100, F.lit(0.0)).alias("precip_mm"),
            F.count("*").cast("double").alias("wind_kmh"),
        )
    )


def with_blend(wide: DataFrame) -> DataFrame:
    """A third model, the mean of both baselines, with an interval of two bikes each way."""
    columns = {}
    for t in TARGETS:
        mean = (F.col(f"{t}_{NAIVE}") + F.col(f"{t}_{AVERAGE}")) / 2
        columns[f"{t}_{BLEND}"] = mean
        columns[f"{t}_{BLEND}_lower"] = F.greatest(F.lit(0.0), mean - 2)
        columns[f"{t}_{BLEND}_upper"] = mean + 2
    return wide.withColumns(columns)


def all_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of the three models, closed hours included."""
    wide = baseline_forecasts(
        station_hourly(spark, sf_dir), list(WEEKS), min_hours=IDLE_HOURS
    )
    return to_long(with_blend(wide), MODELS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are scored: hours in service."""
    return all_predictions(spark, sf_dir).filter("in_service")


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as text with planted defects: copies, bad times, padded or missing stations."""
    event = F.col("ride_id").cast("bigint")
    missing, padded = event % 83 == 0, event % 11 == 0

    def station(end: str) -> Column:
        name = F.col(f"{end}_station_id")
        name = F.when(padded, F.concat(F.lit("  "), name, F.lit("\t"))).otherwise(name)
        return F.when(missing, "").otherwise(F.coalesce(name, F.lit("")))

    def position(base: float, end: str) -> Column:
        i = F.substring(F.col(f"{end}_station_id"), 2, 9).cast("int")
        value = (F.lit(base) + (i % 10) * 0.01).cast("string")
        return F.when(F.col("k") % 29 == 0, "n/a").otherwise(F.coalesce(value, F.lit("")))

    copies = F.sequence(F.lit(0), F.when((event % 50).isin(0, 9), 1).otherwise(0))
    return trips(spark, sf_dir).select(
        event.alias("event"),
        F.explode(copies).alias("copy"),
        F.when(event % 97 == 0, "not a time")
        .otherwise(F.col("started_at").cast("string"))
        .alias("started"),
        F.col("ended_at").cast("string").alias("ended"),
        "ride_id",
        "rideable_type",
        station("start").alias("start_id"),
        station("end").alias("end_id"),
        F.when(event % 89 == 0, "Riverside Test Station")
        .when(F.col("k") % 31 == 0, "Contest Plaza")
        .otherwise("Main Street")
        .alias("start_name"),
        F.lit(" Square Annex ").alias("end_name"),
        position(42.36, "start").alias("start_lat"),
        position(-71.06, "start").alias("start_lng"),
        position(42.36, "end").alias("end_lat"),
        position(-71.06, "end").alias("end_lng"),
        "member_type",
        "k",
    )


def raw_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stand in files of the new schema, all text, with their origin."""
    return (
        _raw_rows(spark, sf_dir)
        .filter(F.col("event") % 10 != 9)
        .select(
            "ride_id",
            "rideable_type",
            F.col("started").alias("started_at"),
            F.col("ended").alias("ended_at"),
            F.col("start_name").alias("start_station_name"),
            F.col("start_id").alias("start_station_id"),
            F.col("end_name").alias("end_station_name"),
            F.col("end_id").alias("end_station_id"),
            "start_lat",
            "start_lng",
            "end_lat",
            "end_lng",
            F.col("member_type").alias("member_casual"),
            F.lit("new").alias("source_file"),
            F.struct("event", "copy").alias("row_order"),
        )
    )


def raw_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stand in files of the legacy schema."""
    user = (
        F.when(F.col("k") % 23 == 0, "Guest")
        .when(F.col("member_type") == "member", "Subscriber")
        .otherwise("Customer")
    )
    return (
        _raw_rows(spark, sf_dir)
        .filter(F.col("event") % 10 == 9)
        .select(
            F.lit("0").alias("tripduration"),
            F.col("started").alias("starttime"),
            F.col("ended").alias("stoptime"),
            F.col("start_id").alias("start station id"),
            F.col("start_name").alias("start station name"),
            F.col("start_lat").alias("start station latitude"),
            F.col("start_lng").alias("start station longitude"),
            F.col("end_id").alias("end station id"),
            F.col("end_name").alias("end station name"),
            F.col("end_lat").alias("end station latitude"),
            F.col("end_lng").alias("end station longitude"),
            F.lit("1").alias("bikeid"),
            user.alias("usertype"),
            F.lit("").alias("postal code"),
            F.lit("legacy").alias("source_file"),
            F.struct("event", "copy").alias("row_order"),
        )
    )


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both raw schemas as one typed table, defects still in it."""
    return normalize(raw_new(spark, sf_dir)).unionByName(normalize(raw_legacy(spark, sf_dir)))


def station_info(spark: SparkSession, sf_dir: str, top_n: int = 15) -> DataFrame:
    """Name, position and first-week volume of each station; one of them has no name."""
    inside = (F.col("started_at") >= naive(RANK[0])) & (F.col("started_at") < naive(RANK[1]))
    volumes = (
        valid_trips(spark, sf_dir)
        .filter(inside)
        .select(F.explode(F.array("start_station_id", "end_station_id")).alias("canonical_id"))
        .filter("canonical_id IS NOT NULL")
        .groupBy("canonical_id")
        .agg(F.count("*").alias("rank_volume"))
    )
    i = F.substring("canonical_id", 2, 9).cast("int")
    kind = (
        F.when(i % 4 == 0, "MIT Lab ")
        .when(i % 4 == 1, "Harvard Yard ")
        .when(i % 4 == 2, "Summit Road ")
        .when(i != 7, "Harbor Point ")
    )
    top = (
        volumes.orderBy(F.desc("rank_volume"), "canonical_id")
        .limit(top_n)
        .select("canonical_id", F.lit(True).alias("top"))
    )
    return volumes.join(top, "canonical_id", "left").select(
        "canonical_id",
        F.concat(kind, i.cast("string")).alias("name"),
        (42.36 + (i % 10) * 0.01).alias("lat"),
        (-71.06 + (i % 3) * 0.01).alias("lng"),
        "rank_volume",
        F.coalesce("top", F.lit(False)).alias("is_top"),
    )
