"""Raw trip files: listings, CSV, zipped CSV, and the cleaned Parquet table."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.operators.cleaning import LEGACY_NAMES, NEW_NAMES, UNIFIED_COLUMNS, detect_schema

# Fixed value: the form of object names, YYYYMM-<system>-tripdata in one of three formats.
KEY_FORM = r"^(\d{6})-[A-Za-z]+-tripdata\.(zip|csv\.zip|csv)$"
ROWS_PER_BATCH = 50_000


def read_raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every column as text ("NA" stays text), with the file and the position in it.

    ``row_order`` sorts rows as they stand in their file: by the start of the split, then by the
    running number within it. All files of one call must share a header.
    """
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", False)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
        .select("*", *origin_columns())
    )


def origin_columns() -> list[Column]:
    order = F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return [F.col("_metadata.file_path").alias("source_file"), order.alias("row_order")]


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Object keys and sizes of bucket listing documents, one element per object."""
    return (
        spark.read.format("xml")
        .option("rowTag", "Contents")
        .schema("Key string, Size long")
        .load(path)
        .select(F.col("Key").alias("key"), F.col("Size").alias("size"))
        .filter(F.col("key").isNotNull())
    )


def month_keys(keys: DataFrame, first: str, last: str) -> DataFrame:
    """Trip files of the months [first, last], compared as text, with the files per month."""
    return (
        keys.withColumn("month", F.regexp_extract("key", KEY_FORM, 1))
        .filter((F.col("month") != "") & F.col("month").between(first, last))
        .groupBy("month")
        .agg(F.min("key").alias("key"), F.max("key").alias("other"), F.count("*").alias("files"))
        .withColumn("other", F.when(F.col("files") > 1, F.col("other")))
        .orderBy("month")
    )


def require_one_file_per_month(catalog: DataFrame) -> DataFrame:
    twice = catalog.filter("files > 1").orderBy("month").first()
    if twice:
        raise ValueError(f"two files for month {twice['month']}: {twice['key']}, {twice['other']}")
    return catalog.select("month", "key")


def latest_full_month(today: Column) -> Column:
    """The month before the one ``today`` is in, as YYYYMM."""
    return F.date_format(F.add_months(today, -1), "yyyyMM")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Zip files as (path, content). An archive is one record: it cannot be split."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def unzip_trips(archives: DataFrame) -> DataFrame:
    """Raw rows of zipped trip CSVs under the unified column names, still as text.

    The member is read as a stream and leaves the task in batches, so an archive is never
    unpacked as a whole. Exactly one CSV outside the system folder must be inside.
    """
    fields = ", ".join(f"{c} string" for c in UNIFIED_COLUMNS)
    return archives.select("path", "content").mapInPandas(
        _unzip_batches, f"source_file string, row_order long, {fields}, schema_kind string"
    )


def _unzip_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                with archive.open(_only_csv(archive.namelist(), path)) as member:
                    yield from _unified_text(member, path)


def _only_csv(names: list[str], path: str) -> str:
    found = [n for n in names if n.endswith(".csv") and not n.startswith("__MACOSX/")]
    if len(found) != 1:
        raise ValueError(f"{path}: one CSV expected, found {found}")
    return found[0]


def _unified_text(member, path: str) -> Iterator[pd.DataFrame]:
    chunks = pd.read_csv(member, dtype=str, keep_default_na=False, chunksize=ROWS_PER_BATCH)
    for chunk in chunks:
        chunk.columns = [c.strip().lower() for c in chunk.columns]
        kind = detect_schema(list(chunk.columns))
        renamed = NEW_NAMES if kind == "new" else LEGACY_NAMES
        out = pd.DataFrame({"source_file": path, "row_order": chunk.index})
        for name in UNIFIED_COLUMNS:
            source = renamed.get(name, name)
            out[name] = chunk[source].to_numpy() if source in chunk else None
        out["schema_kind"] = kind
        yield out


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned trips of all months, or of those that a pattern below ``path`` names."""
    base = path.split("/month=")[0]
    stored = spark.read.option("basePath", base).parquet(path)
    return stored.withColumn("month", F.col("month").cast("string"))


def month_of_trip_file(column: Column) -> Column:
    """YYYYMM out of a path such as ``raw/202401.csv`` or ``raw/trips=202401/part-0.csv``."""
    month = F.regexp_extract(column, r"(?:^|/|_|=)(\d{6})(?:\.|-|_|/)", 1)
    lacking = F.raise_error(F.concat(F.lit("no month in the name of "), column)).cast("string")
    return F.when(month != "", month).when(column.isNotNull(), lacking)


def data_range(months: DataFrame) -> DataFrame:
    """One row: midnight of the first month, and midnight after the last. Needs ``month``."""
    first_day = F.to_date(F.concat("month", F.lit("01")), "yyyyMMdd")
    return months.agg(
        F.min(first_day).cast("timestamp_ntz").alias("start"),
        F.add_months(F.max(first_day), 1).cast("timestamp_ntz").alias("end"),
    )


def require_range(months: DataFrame):
    """(start, end) on the driver; an error when there is no month at all."""
    row = data_range(months).first()
    if row["start"] is None:
        raise FileNotFoundError("no cleaned trip files")
    return row["start"], row["end"]
