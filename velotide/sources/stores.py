"""Tables that stages write for one another, and small logs kept beside them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.operators.cleaning import RULES, kept_rows, label_rows, removed_counts
from velotide.session import small_side, written

SNAPSHOT_COLUMNS = (
    "model", "test_week", "station_id", "ts", "target", "y", "yhat", "yhat_lower", "yhat_upper",
    "weather", "is_holiday", "holiday_name",
)
SNAPSHOT_FLOATS = ("y", "yhat", "yhat_lower", "yhat_upper")
SNAPSHOT_LABELS = ("model", "station_id", "target", "weather", "holiday_name")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_months(trips: DataFrame, path: str) -> None:
    """Replace exactly the months in ``trips``. The commit protocol makes a month appear whole."""
    (
        trips.write.partitionBy("month")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def months_to_ingest(catalog: DataFrame, present: DataFrame | None) -> DataFrame:
    """Months of the catalog that have no cleaned table yet."""
    if present is None:
        return catalog
    return catalog.join(present.select("month").distinct(), "month", "left_anti")


def upsert_log(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The log with this run's months replaced, by month."""
    if old is None:
        return new.orderBy("month")
    return old.join(new, "month", "left_anti").unionByName(new).orderBy("month")


def ingest_new_months(trips: DataFrame, path: str, log: DataFrame | None = None) -> DataFrame:
    """Clean and store the months of ``trips`` that ``path`` does not have yet; return the new log.

    ``trips`` is normalized and has row_order and month. Running it again changes nothing. The
    labelled rows feed both the table and the log, so they are written once in between. The months
    are few and broadcast: a join that shuffled the trips by month would leave each month to one task.
    """
    present = read_if_present(trips.sparkSession, path)
    todo = small_side(months_to_ingest(trips.select("month").distinct(), present))
    labelled = written(label_rows(trips.join(todo, "month", "left_semi"), "month"), "labelled")
    write_months(kept_rows(labelled), path)
    counts = removed_counts(labelled, "month").select("month", "rows_in", *RULES, "rows_out")
    return upsert_log(log, counts)


def union_predictions(*tables: DataFrame) -> DataFrame:
    """Predictions of several models, of which only some have intervals; hours in service only."""
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first.filter("in_service")


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The same from stored files with differing columns."""
    return spark.read.option("mergeSchema", True).parquet(path).filter("in_service")


def compact(preds: DataFrame) -> DataFrame:
    """The columns a dashboard needs, with single-precision numbers."""
    return preds.select(
        *[
            F.col(c).cast("float").alias(c) if c in SNAPSHOT_FLOATS else F.col(c)
            for c in SNAPSHOT_COLUMNS
            if c in preds.columns
        ]
    )


def write_snapshot(preds: DataFrame, path: str) -> None:
    compact(preds).write.mode("overwrite").option("compression", "zstd").parquet(path)


def top_station_dimension(stations: DataFrame) -> DataFrame:
    return stations.filter("is_top").select(
        F.col("canonical_id").alias("station_id"), "name", "lat", "lng", "rank_volume"
    )


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored snapshot with real NULLs in its labels, and the date and hour of each row."""
    preds = spark.read.parquet(path)
    for name in SNAPSHOT_LABELS:
        if name in preds.columns:
            text = F.col(name).cast("string")
            preds = preds.withColumn(name, F.when(~text.isin("nan", "<NA>"), text))
    return preds.withColumn("date", F.to_date("ts")).withColumn("hour", F.hour("ts"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_fit_log(fits: DataFrame, path: str) -> None:
    """One JSON record per fit."""
    fits.write.mode("overwrite").json(path)


def covers(stored: DataFrame, start, end) -> DataFrame:
    """One row: does a stored hourly table reach from ``start`` to the last hour before ``end``?"""
    low, high = F.min("ts"), F.max("ts")
    first = F.lit(str(start)).cast("timestamp_ntz")
    last = F.lit(str(end)).cast("timestamp_ntz") - F.expr("INTERVAL '1' HOUR")
    return stored.agg(
        low.alias("first_ts"),
        high.alias("last_ts"),
        F.coalesce((low <= first) & (high >= last), F.lit(False)).alias("covered"),
    )
