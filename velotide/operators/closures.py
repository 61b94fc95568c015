"""Closure runs as summaries of pieces of time that can be merged.

A piece is any stretch of a station's hours, such as a month. Its summary is one row: bounds, the first and the last
busy hour, and the long idle runs between busy hours. What is idle before the first busy hour and after the last one is
open: it may be part of a run that began earlier or ends later. Summaries of adjoining pieces merge into the summary of
them all, in any grouping, so a new month adds its rows and reads no hour of older months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.functions.columns import hours
from velotide.settings import CLOSED_MIN_HOURS

RUN = "struct<run_start:timestamp_ntz,run_end:timestamp_ntz>"
SUMMARY = ["low", "high", "hours", "first_busy", "last_busy", "runs"]


def _run(start: Column, end: Column) -> Column:
    return F.struct(start.alias("run_start"), end.alias("run_end"))


def _long(runs: Column, min_hours: int) -> Column:
    return F.filter(runs, lambda r: r["run_end"] + hours(1) - r["run_start"] >= hours(min_hours))


def _between(spans: Column, min_hours: int) -> Column:
    """The long idle runs between neighbours of a sorted array of (first busy hour, last busy hour)."""
    gaps = F.greatest(F.size(spans) - 1, F.lit(0))
    runs = F.zip_with(
        F.slice(spans, F.lit(1), gaps),
        F.slice(spans, F.lit(2), gaps),
        lambda a, b: _run(a["last_busy"] + hours(1), b["first_busy"] - hours(1)),
    )
    return _long(runs, min_hours)


def idle_summaries(hourly: DataFrame, piece: Column, min_hours: int = CLOSED_MIN_HOURS) -> DataFrame:
    """One row per station and ``piece`` (an expression over ``ts``) of complete hourly rows.

    One aggregation. The busy hours of a piece meet in an array that the length of a piece bounds. Only runs of
    ``min_hours`` or more are kept: a shorter one between two busy hours cannot grow any more.
    """
    busy = F.when((F.col("departures") != 0) | (F.col("arrivals") != 0), F.col("ts"))
    grouped = hourly.groupBy("station_id", piece.alias("piece")).agg(
        F.min("ts").alias("low"),
        F.max("ts").alias("high"),
        F.count("*").alias("hours"),
        F.min(busy).alias("first_busy"),
        F.max(busy).alias("last_busy"),
        F.array_sort(F.collect_list(busy)).alias("busy"),
    )
    spans = F.transform("busy", lambda t: F.struct(t.alias("first_busy"), t.alias("last_busy")))
    return grouped.withColumn("runs", _between(spans, min_hours)).select("station_id", "piece", *SUMMARY)


def merge_summaries(
    summaries: DataFrame, min_hours: int = CLOSED_MIN_HOURS, piece: Column | None = None
) -> DataFrame:
    """The summary of all pieces of a station, or of those with the same ``piece``, a coarser expression.

    Pieces may be merged in any grouping as long as those merged adjoin. Runs across their bounds lie between the last
    busy hour of one and the first of the next that has any; pieces without a busy hour only move the bounds.
    """
    keys = ["station_id"] if piece is None else ["station_id", piece.alias("piece")]
    span = F.when(F.col("first_busy").isNotNull(), F.struct("first_busy", "last_busy"))
    grouped = summaries.groupBy(*keys).agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("hours").alias("hours"),
        F.min("first_busy").alias("first_busy"),
        F.max("last_busy").alias("last_busy"),
        F.flatten(F.collect_list("runs")).alias("inner"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    runs = F.array_sort(F.concat("inner", _between(F.col("spans"), min_hours)))
    names = ["station_id"] if piece is None else ["station_id", "piece"]
    return grouped.withColumn("runs", runs).select(*names, *SUMMARY)


def closed_runs(summaries: DataFrame, min_hours: int = CLOSED_MIN_HOURS) -> DataFrame:
    """``station_id`` and ``runs``: all idle runs of ``min_hours`` or longer, open ends included.

    Pieces that leave out hours or hold some twice are refused when the rows are computed: idle runs would be read
    into what is missing.
    """
    whole = merge_summaries(summaries, min_hours)
    last = F.coalesce(F.col("first_busy") - hours(1), F.col("high"))
    before = F.array(_run(F.col("low"), last))
    after = F.when(F.col("last_busy").isNotNull(), F.array(_run(F.col("last_busy") + hours(1), F.col("high"))))
    after = F.coalesce(after, F.array().cast(f"array<{RUN}>"))
    runs = F.concat(_long(before, min_hours), F.col("runs"), _long(after, min_hours))
    adjoin = F.col("high") - F.col("low") == F.make_dt_interval(hours=(F.col("hours") - 1).cast("int"))
    refused = F.raise_error(F.concat(F.lit("pieces do not adjoin: station "), F.col("station_id").cast("string")))
    return whole.select("station_id", F.when(adjoin, runs).otherwise(refused).alias("runs"))


def _mask(hourly: DataFrame, runs: DataFrame, closed) -> DataFrame:
    # One row per station on the other side. Its runs are as many as the months allow, not as the trips.
    known = hourly.drop("in_service").join(runs, "station_id", "left")
    found = F.exists("runs", lambda r: (F.col("ts") >= r["run_start"]) & (F.col("ts") <= r["run_end"]) & closed(r))
    return known.withColumn("in_service", ~F.coalesce(found, F.lit(False))).drop("runs")


def flag_from_runs(hourly: DataFrame, runs: DataFrame) -> DataFrame:
    """Any hours, one month alone too, with ``in_service`` in hindsight as of the runs of :func:`closed_runs`."""
    return _mask(hourly, runs, lambda r: F.lit(True))


def flag_as_of(hourly: DataFrame, runs: DataFrame, cutoff: Column, min_hours: int = CLOSED_MIN_HOURS) -> DataFrame:
    """Hours before ``cutoff`` (an expression over the columns of ``hourly``) with the mask as it could be known then:
    a run counts only the hours before the cutoff."""
    return _mask(
        hourly.filter(F.col("ts") < cutoff),
        runs,
        lambda r: F.least(r["run_end"] + hours(1), cutoff) - r["run_start"] >= hours(min_hours),
    )


def store_summaries(hourly: DataFrame, table: str, min_hours: int = CLOSED_MIN_HOURS) -> None:
    """Write the summaries of the months of ``hourly`` into the folders of these months below ``table``.

    Other months are neither read nor written. A month is replaced as a whole, so a repeated or corrected delivery
    ends in the same table.
    """
    month = F.substring(F.col("ts").cast("string"), 1, 7)
    rows = idle_summaries(hourly, month, min_hours).withColumnRenamed("piece", "month")
    rows.write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(table)


def stored_runs(spark: SparkSession, table: str, min_hours: int = CLOSED_MIN_HOURS) -> DataFrame:
    """:func:`closed_runs` of all months stored so far; ``min_hours`` as they were stored with."""
    return closed_runs(spark.read.parquet(table), min_hours)
