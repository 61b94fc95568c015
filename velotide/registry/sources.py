"""Section A: sources and sinks. What a source reads here, a Spark job has just written from the
given tables into the shared folder; the twin computes the result from the tables directly."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from velotide.functions import metrics as M
from velotide.operators import cleaning as C
from velotide.operators import weather as W
from velotide.plans import projection as P
from velotide.plans.analysis import enrich
from velotide.registry.base import query
from velotide.registry.cleaning import COLUMNS, COORDINATES
from velotide.registry.dims import calendar, readings
from velotide.registry.sql import with_ctes
from velotide.session import scratch_path
from velotide.settings import AVERAGE, NAIVE
from velotide.sources import stores as ST
from velotide.sources import trip_files as TF
from velotide.streaming import ingest as IN

RAW = ("ride_id", "rideable_type", "started_at", "ended_at", "start_station_name",
       "start_station_id", "end_station_name", "end_station_id", "start_lat", "start_lng",
       "end_lat", "end_lng", "member_casual")


def raw_csv(spark, sf):
    """The new-schema rows as CSV files, one folder of files per call."""
    path = scratch_path(spark, "raw")
    rows = P.raw_new(spark, sf).select(*RAW)
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


@query("a1_scan_csv", with_ctes(f"""
    SELECT {COLUMNS} FROM unified WHERE source_file = 'new'"""), doubles=COORDINATES)  # fmt: skip
def _(spark, sf):
    """Raw text from CSV through the typed columns."""
    return C.normalize(TF.read_raw_csv(spark, raw_csv(spark, sf))).select(*C.UNIFIED_COLUMNS)


def _keys(spark, sf):
    """One trip file key per month of orders, in three formats, and keys that are no trip file."""
    month = F.date_format("o_orderdate", "yyyyMM")
    n = F.month("o_orderdate")
    ending = F.when(n % 3 == 0, "zip").when(n % 3 == 1, "csv.zip").otherwise("csv")
    other = F.concat(F.lit("stations_"), month, F.lit(".csv"))
    trip = F.concat(month, F.lit("-city-tripdata."), ending)
    return (
        P.table(spark, sf, "orders")
        .groupBy(trip.alias("trip"), other.alias("other"))
        .agg(F.count("*").alias("Size"))
        .select(F.explode(F.array("trip", "other")).alias("Key"), "Size")
    )


@query("a2_file_catalog", """
    SELECT month, month || '-city-tripdata.' || CASE CAST(substr(month, 5) AS INTEGER) % 3
               WHEN 0 THEN 'zip' WHEN 1 THEN 'csv.zip' ELSE 'csv' END AS key,
           CAST(NULL AS VARCHAR) AS other, CAST(1 AS BIGINT) AS files
    FROM (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders)
    WHERE month BETWEEN '199603' AND '200012'""")  # fmt: skip
def _(spark, sf):
    """A bucket listing written as XML and read back, matched, and cut to a range of months."""
    path = scratch_path(spark, "listing")
    _keys(spark, sf).write.format("xml").option("rowTag", "Contents").option(
        "rootTag", "ListBucketResult"
    ).save(path)
    return TF.month_keys(TF.read_listing(spark, path), "199603", "200012")


@query("a3_latest_full_month", """
    SELECT strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y%m') AS month,
           count(*) AS n FROM orders GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    """The last full month as seen on the day of each order."""
    orders = P.table(spark, sf, "orders")
    today = F.to_date("o_orderdate")
    return orders.groupBy(TF.latest_full_month(today).alias("month")).agg(F.count("*").alias("n"))


def _zip_batches(batches):
    for number, batch in enumerate(batches):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("trips.csv", batch.to_csv(index=False))
            archive.writestr("__MACOSX/._trips.csv", "junk")
        yield pd.DataFrame({"path": [f"{number}.zip"], "content": [packed.getvalue()]})


@query("a4_zipped_csv", with_ctes("""
    SELECT source_file AS schema_kind, ride_id, started_at, start_station_id, end_station_id,
           start_lat, member_type FROM unified"""), doubles="start_lat")  # fmt: skip
def _(spark, sf):
    """Both schemas packed into archives, one per batch of rows, and unpacked again."""
    archives = None
    for raw in (P.raw_new(spark, sf), P.raw_legacy(spark, sf)):
        packed = raw.drop("source_file", "row_order").mapInPandas(
            _zip_batches, "path string, content binary"
        )
        archives = packed if archives is None else archives.unionByName(packed)
    text = TF.unzip_trips(archives)
    typed = C.to_types(text.withColumn("kind", F.col("schema_kind")))
    return typed.select(
        F.col("kind").alias("schema_kind"),
        "ride_id", "started_at", "start_station_id", "end_station_id", "start_lat", "member_type",
    )


def monthly_trips(spark, sf):
    """Unified rows with the month of their ride, as if each week of the test month were one."""
    week = F.expr("(CAST(row_order.event AS BIGINT) % 3) + 1")
    return P.unified(spark, sf).withColumn(
        "month", F.concat(F.lit("20240"), week.cast("string"))
    ).drop("source_file")


MONTHLY = "SELECT *, '20240' || CAST(event % 3 + 1 AS VARCHAR) AS month FROM unified"
RULE_COUNTS = ", ".join(f"count(*) FILTER (WHERE rule = '{r}') AS {r}" for r in C.RULES)
# A month that holds a legacy row has a row without ride ID: copies are found by the whole row.
MONTH_LABELLED = rf"""
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
                 row_number() OVER (PARTITION BY month, {COLUMNS} ORDER BY event, copy) AS nth
          FROM ({MONTHLY}))"""


@query("a5_trips_view", with_ctes("""
    SELECT month, count(*) AS n, count(DISTINCT ride_id) AS rides, min(started_at) AS first_start
    FROM m WHERE rule IS NULL GROUP BY 1""", m=MONTH_LABELLED))  # fmt: skip
def _(spark, sf):
    """Cleaned months on disk, scanned as one table of distinct trips."""
    path = scratch_path(spark, "trips")
    ST.ingest_new_months(monthly_trips(spark, sf), path)
    trips = C.distinct_trips(TF.read_trips(spark, f"{path}/month=*"))
    return trips.groupBy("month").agg(
        F.count("*").alias("n"),
        F.count_distinct("ride_id").alias("rides"),
        F.min("started_at").alias("first_start"),
    )


@query("a6_partitioned_write", with_ctes(f"SELECT month, {COLUMNS} FROM ({MONTHLY})"),
       doubles=COORDINATES)
def _(spark, sf):
    """Months written, then one month written again: it is replaced, the others stay."""
    path = scratch_path(spark, "months")
    rows = monthly_trips(spark, sf).select("month", *C.UNIFIED_COLUMNS)
    ST.write_months(rows, path)
    ST.write_months(rows.filter("month = '202402'"), path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.select("month", *C.UNIFIED_COLUMNS)


@query("a7_incremental_ingest", with_ctes(f"""
    SELECT month, count(*) AS rows_in, {RULE_COUNTS},
           count(*) FILTER (WHERE rule IS NULL) AS rows_out FROM m GROUP BY 1""", m=MONTH_LABELLED))  # fmt: skip
def _(spark, sf):
    """One month is ingested first, then all are offered: it is skipped, and the log completed."""
    path = scratch_path(spark, "trips")
    rows = monthly_trips(spark, sf)
    log = ST.ingest_new_months(rows.filter("month = '202402'"), path)
    return ST.ingest_new_months(rows, path, log)


@query("a7_streaming_ingest", with_ctes(f"""
    SELECT month, count(*) AS rows_in, {RULE_COUNTS},
           count(*) FILTER (WHERE rule IS NULL) AS rows_out FROM m GROUP BY 1""",
    m=MONTH_LABELLED.replace("FROM unified", "FROM unified WHERE source_file = 'new'")))
def _(spark, sf):
    """Raw CSV files of a month each through the file stream, which is then started again."""
    root = scratch_path(spark, "stream")
    rows = P.raw_new(spark, sf)
    number = F.expr("(CAST(row_order.event AS BIGINT) % 3) + 1")
    named = rows.withColumn("trips", F.concat(F.lit("20240"), number.cast("string")))
    named.select(*RAW, "trips").write.partitionBy("trips").option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(f"{root}/raw")
    for _run in range(2):
        stream = IN.csv_stream(spark, f"{root}/raw", list(RAW))
        IN.ingest_available(stream, f"{root}/trips", f"{root}/log", f"{root}/state")
    log = spark.read.parquet(f"{root}/log")
    return log.withColumn("month", F.col("month").cast("string"))


@query("a7_streaming_many_files", with_ctes(f"""
    SELECT month, count(*) AS rows_in, {RULE_COUNTS},
           count(*) FILTER (WHERE rule IS NULL) AS rows_out FROM m GROUP BY 1""",
    m=MONTH_LABELLED.replace("FROM unified", "FROM unified WHERE source_file = 'new'")))
def _(spark, sf):
    """Many files per month, two in a batch, and more files for months that are already stored."""
    root = scratch_path(spark, "stream")
    event = F.expr("CAST(row_order.event AS BIGINT)")
    rows = P.raw_new(spark, sf).withColumn("trips", F.concat(F.lit("20240"), (event % 3 + 1).cast("string")))
    rows = rows.withColumn("late", F.pmod(F.floor(event / 3), F.lit(4)) == 0)
    for late in (False, True):
        some = rows.filter(F.col("late") == late).select(*RAW, "trips").repartition(4)
        some.write.mode("append").partitionBy("trips").option("header", True).option(
            "escape", '"'
        ).option("emptyValue", "").csv(f"{root}/raw")
        stream = IN.csv_stream(spark, f"{root}/raw", list(RAW), files_per_batch=2)
        IN.ingest_available(stream, f"{root}/trips", f"{root}/log", f"{root}/state")
    log = spark.read.parquet(f"{root}/log")
    return log.withColumn("month", F.col("month").cast("string"))


@query("a8_log_upsert", with_ctes("""
    SELECT month, count(*) * (CASE month WHEN '202402' THEN 2 ELSE 1 END) AS rows_in
    FROM m GROUP BY 1 UNION ALL SELECT '202312', CAST(count(*) AS BIGINT) FROM orders""",
    m=MONTHLY))
def _(spark, sf):
    """A log with two months and a run with three: the month in both is replaced."""
    counts = monthly_trips(spark, sf).groupBy("month").agg(F.count("*").alias("rows_in"))
    older = P.table(spark, sf, "orders").agg(
        F.lit("202312").alias("month"), F.count("*").alias("rows_in")
    )
    old = older.unionByName(counts.filter("month = '202402'"))
    doubled = F.when(F.col("month") == "202402", F.col("rows_in") * 2).otherwise(F.col("rows_in"))
    return ST.upsert_log(old, counts.withColumn("rows_in", doubled))


@query("a9_weather_json", with_ctes("SELECT ts AS utc, temp_c, precip_mm, wind_kmh FROM weather"),
       doubles="temp_c precip_mm wind_kmh")
def _(spark, sf):
    """Readings packed into parallel arrays, a payload per day, and unpacked again."""
    path = scratch_path(spark, "weather")
    reading = F.struct("utc", *W.FIELDS)
    days = readings(spark, sf).groupBy(F.to_date("utc").alias("day")).agg(
        F.sort_array(F.collect_list(reading)).alias("r")
    )
    arrays = [F.transform("r", lambda r: F.date_format(r["utc"], "yyyy-MM-dd'T'HH:mm")).alias("time")]
    arrays += [F.col(f"r.{name}").alias(v) for v, name in W.VARIABLES.items()]
    payload = days.select(F.struct(*arrays).alias("hourly"))
    payload.write.option("ignoreNullFields", False).json(path)
    # One document per line here; the service sends one document per file.
    lines = spark.read.schema(W.PAYLOAD_SCHEMA).json(path)
    return W.payload_rows(lines)


@query("a10_coverage_check", with_ctes("""
    SELECT min(ts) AS first_ts, max(ts) AS last_ts,
           min(ts) <= TIMESTAMP '2024-01-01' AND max(ts) >= TIMESTAMP '2024-01-30 23:00:00'
               AS covered FROM weather"""))  # fmt: skip
def _(spark, sf):
    return ST.covers(P.weather(spark, sf), P.START, P.END)


def stored_models(spark, sf):
    """Predictions stored one folder per model; only the blend's files have interval columns."""
    root = scratch_path(spark, "predictions")
    rows = P.all_predictions(spark, sf)
    rows.filter(F.col("model") == P.BLEND).write.parquet(f"{root}/{P.BLEND}")
    plain = rows.filter(F.col("model") != P.BLEND).drop("yhat_lower", "yhat_upper")
    plain.write.parquet(f"{root}/baselines")
    return root


@query("a11_load_predictions", with_ctes("""
    SELECT model, count(*) AS n, count(yhat_lower) AS with_interval, avg(abs(y - yhat)) AS mae
    FROM preds GROUP BY 1"""), doubles="mae")  # fmt: skip
def _(spark, sf):
    preds = ST.load_predictions(spark, f"{stored_models(spark, sf)}/*")
    return preds.groupBy("model").agg(
        F.count("*").alias("n"), F.count("yhat_lower").alias("with_interval"), M.mae().alias("mae")
    )


@query("a11_union_predictions", with_ctes("""
    SELECT model, count(*) AS n, count(yhat_lower) AS with_interval FROM preds GROUP BY 1"""))  # fmt: skip
def _(spark, sf):
    rows = P.all_predictions(spark, sf)
    plain = rows.filter(F.col("model") != P.BLEND).drop("yhat_lower", "yhat_upper")
    union = ST.union_predictions(plain, rows.filter(F.col("model") == P.BLEND))
    return union.groupBy("model").agg(
        F.count("*").alias("n"), F.count("yhat_lower").alias("with_interval")
    )


SNAPSHOT = """
    SELECT model, test_week, station_id, ts, target, CAST(y AS FLOAT) AS y,
           CAST(yhat AS FLOAT) AS yhat, CAST(yhat_lower AS FLOAT) AS yhat_lower,
           CAST(yhat_upper AS FLOAT) AS yhat_upper, weather, is_holiday, holiday_name"""


@query("a12_snapshot", with_ctes(f"{SNAPSHOT} FROM enriched"),
       doubles="y yhat yhat_lower yhat_upper")
def _(spark, sf):
    path = scratch_path(spark, "snapshot")
    full = enrich(P.predictions(spark, sf), P.weather(spark, sf), calendar(spark))
    ST.write_snapshot(full, path)
    return spark.read.parquet(path)


@query("a12_top_station_dimension", with_ctes("""
    SELECT canonical_id AS station_id, name, lat, lng, rank_volume FROM info WHERE is_top"""),
    doubles="lat lng")
def _(spark, sf):
    return ST.top_station_dimension(P.station_info(spark, sf))


@query("a13_load_snapshot", with_ctes(f"{SNAPSHOT}, date, hour FROM enriched"),
       doubles="y yhat yhat_lower yhat_upper", dates="date")
def _(spark, sf):
    """A snapshot whose missing labels were written as the text "nan" or "<NA>"."""
    path = scratch_path(spark, "snapshot")
    full = enrich(P.predictions(spark, sf), P.weather(spark, sf), calendar(spark))
    spelled = {
        "holiday_name": F.coalesce("holiday_name", F.lit("<NA>")),
        "weather": F.coalesce("weather", F.lit("nan")),
    }
    ST.write_snapshot(full.withColumns(spelled), path)
    return ST.load_snapshot(spark, path)


@query("a14_csv_sink", with_ctes("""
    SELECT canonical_id, coalesce(name, 'unnamed') AS name, rank_volume FROM info WHERE is_top"""))  # fmt: skip
def _(spark, sf):
    path = scratch_path(spark, "csv")
    top = P.station_info(spark, sf).filter("is_top").fillna("unnamed", ["name"])
    ST.write_csv(top.select("canonical_id", "name", "rank_volume"), path)
    back = spark.read.option("header", True).csv(path)
    return back.withColumn("rank_volume", F.col("rank_volume").cast("bigint"))


@query("a15_data_range", """
    SELECT date_trunc('month', min(o_orderdate)) AS "start",
           date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH AS "end" FROM orders""")  # fmt: skip
def _(spark, sf):
    """The range of the months that have a trip file."""
    files = _keys(spark, sf).select(F.col("Key").alias("key"))
    return TF.data_range(TF.month_keys(files, "000000", "999999"))


@query("a16_fit_log", with_ctes("""
    SELECT CAST(test_week AS VARCHAR) AS cutoff, model AS chosen_loss, count(*) AS n,
           avg(abs(y - yhat)) AS val_mae
    FROM preds WHERE model <> 'blend' GROUP BY 1, 2"""), doubles="val_mae")  # fmt: skip
def _(spark, sf):
    """One JSON record per week and candidate."""
    path = scratch_path(spark, "fits")
    candidates = P.predictions(spark, sf).filter(F.col("model").isin(NAIVE, AVERAGE))
    fits = candidates.groupBy(
        F.col("test_week").cast("string").alias("cutoff"), F.col("model").alias("chosen_loss")
    ).agg(F.count("*").alias("n"), M.mae().alias("val_mae"))
    ST.write_fit_log(fits, path)
    return spark.read.schema("cutoff string, chosen_loss string, n bigint, val_mae double").json(path)


