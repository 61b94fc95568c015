"""Incremental ingest of trip files as a stream that stops when it has seen everything.

The file source remembers which files it has read, so a restarted or repeated run takes only new
ones. Every batch adds its normalized rows to a table of raw months, in folders of its own that a
retry of the batch replaces. When the run has seen everything, the months it touched are cleaned once
from all their raw rows and replaced, so that neither the result nor the work depends on how files
were dealt to batches. A small table beside them says up to which batch each month is cleaned: a run
that broke off in between is made good by the next, with or without new files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.operators.cleaning import RULES, kept_rows, label_rows, normalize, removed_counts
from velotide.session import small_side, written
from velotide.sources.stores import read_if_present, write_months
from velotide.sources.trip_files import month_of_trip_file


def csv_stream(spark: SparkSession, path: str, columns: list[str], files_per_batch: int = 8) -> DataFrame:
    """New CSV files of one schema, all text, with their origin."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _replace(rows: DataFrame, path: str, *folders: str) -> None:
    rows.write.partitionBy(*folders).option("partitionOverwriteMode", "dynamic").mode(
        "overwrite"
    ).parquet(path)


def _raw_table(table: str) -> str:
    return f"{table.rstrip('/')}_raw"


def _store(table: str):
    bronze = _raw_table(table)

    def batch(raw: DataFrame, batch_id: int) -> None:
        # Row numbers are not available to a stream, but each batch is a plain table.
        order = F.struct("block", F.monotonically_increasing_id().alias("row"))
        trips = normalize(raw.withColumn("row_order", order)).withColumn(
            "month", month_of_trip_file(F.col("source_file"))
        )
        _replace(trips.withColumn("batch", F.lit(batch_id)), bronze, "month", "batch")

    return batch


def clean_touched_months(spark: SparkSession, table: str, log: str) -> None:
    """Clean the months that have raw rows of batches beyond the last one they were cleaned with."""
    done = f"{table.rstrip('/')}_done"
    stored = read_if_present(spark, _raw_table(table))
    if stored is None:
        return
    stored = stored.withColumn("month", F.col("month").cast("string"))
    # Both are folder names: a few rows per month.
    touched = stored.groupBy("month").agg(F.max("batch").alias("batch"))
    known = read_if_present(spark, done)
    if known is not None:
        before = known.select(F.col("month").cast("string").alias("month"), F.col("batch").alias("before"))
        touched = touched.join(before, "month", "left").filter("before IS NULL OR batch > before").drop("before")
    touched = small_side(touched)
    if touched.isEmpty():
        return
    rows = stored.drop("batch").join(touched.select("month"), "month", "left_semi")
    labelled = written(label_rows(rows, "month"), "labelled")
    write_months(kept_rows(labelled), table)
    counts = removed_counts(labelled, "month").select("month", "rows_in", *RULES, "rows_out")
    _replace(counts, log, "month")
    _replace(touched, done, "month")


def ingest_available(stream: DataFrame, table: str, log: str, checkpoint: str) -> None:
    """Clean every file that has not been seen yet into ``table``, and its counts into ``log``."""
    running = (
        stream.writeStream.foreachBatch(_store(table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    clean_touched_months(stream.sparkSession, table, log)
