import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_cleaning import HEADER, TAIL

from velotide.operators import cleaning as C
from velotide.sources import stores as ST
from velotide.sources import trip_files as TF
from velotide.streaming import ingest as IN

LISTING = """<?xml version="1.0" encoding="UTF-8"?>
<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Name>b</Name>{}</ListBucketResult>"""


def listing(tmp_path, *keys):
    parts = [f"<Contents><Key>{k}</Key><Size>7</Size></Contents>" for k in keys]
    path = tmp_path / "listing.xml"
    path.write_text(LISTING.format("".join(parts)))
    return str(path)


def ride(number, day):
    return f"{number},classic_bike,{day} 10:00:00,{day} 10:09:00,First St,K1,Second St,K2,{TAIL}"


def test_listing_to_months(spark, tmp_path):
    path = listing(tmp_path, "202312-city-tripdata.zip", "202401-city-tripdata.zip",
                   "202402-city-tripdata.csv.zip", "202403-city-tripdata.csv", "index.html",
                   "x202404-city-tripdata.csv")
    keys = TF.read_listing(spark, path)
    assert keys.count() == 6
    got = TF.require_one_file_per_month(TF.month_keys(keys, "202401", "202609")).collect()
    assert [r["month"] for r in got] == ["202401", "202402", "202403"]


def test_two_files_of_a_month_are_refused(spark, tmp_path):
    keys = TF.read_listing(spark, listing(tmp_path, "202401-city-tripdata.zip", "202401-city-tripdata.csv"))
    with pytest.raises(ValueError, match="two files for month 202401"):
        TF.require_one_file_per_month(TF.month_keys(keys, "2024", "9"))


def test_latest_full_month(spark):
    days = [(date(2026, 10, 8),), (date(2026, 1, 3),)]
    df = spark.createDataFrame(days, "d date").select(TF.latest_full_month(F.col("d")))
    assert [r[0] for r in df.collect()] == ["202609", "202512"]


def test_archives_skip_system_members_and_need_one_csv(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    with zipfile.ZipFile(good / "202401.zip", "w") as z:
        z.writestr("202401.csv", f'{HEADER}\n{ride("R1", "2024-01-03")}\n{ride("R2", "2024-01-04")}\n')
        z.writestr("__MACOSX/._202401.csv", "junk")
    rows = TF.unzip_trips(TF.read_archives(spark, str(good))).orderBy("row_order").collect()
    assert [(r["ride_id"], r["row_order"], r["schema_kind"]) for r in rows] == [("R1", 0, "new"), ("R2", 1, "new")]
    bad = tmp_path / "bad"
    bad.mkdir()
    with zipfile.ZipFile(bad / "x.zip", "w") as z:
        z.writestr("a.csv", HEADER)
        z.writestr("b.csv", HEADER)
    with pytest.raises(Exception, match="one CSV expected"):
        TF.unzip_trips(TF.read_archives(spark, str(bad))).collect()


def test_data_range_covers_whole_months(spark):
    months = spark.createDataFrame([("202401",), ("202402",), ("202609",)], "month string")
    start, end = TF.require_range(months)
    assert (start.date(), end.date()) == (date(2024, 1, 1), date(2026, 10, 1))
    with pytest.raises(FileNotFoundError):
        TF.require_range(months.limit(0))


def month_rows(spark, tmp_path, name, *lines):
    path = tmp_path / f"{name}.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return C.normalize(TF.read_raw_csv(spark, str(path))).withColumn(
        "month", TF.month_of_trip_file(F.col("source_file"))
    )


def test_ingest_skips_months_that_are_there(spark, tmp_path):
    table = str(tmp_path / "trips")
    january = month_rows(spark, tmp_path, "202401", ride("R1", "2024-01-03"), ride("R1", "2024-01-03"))
    log = ST.ingest_new_months(january, table)
    february = month_rows(spark, tmp_path, "202402", ride("R2", "2024-02-03"))
    changed = january.withColumn("ride_id", F.lit("other"))
    log = ST.ingest_new_months(changed.unionByName(february), table, log)
    assert [(r["month"], r["rows_in"], r["duplicate"], r["rows_out"]) for r in log.collect()] == [
        ("202401", 2, 1, 1), ("202402", 1, 0, 1)]
    stored = TF.read_trips(spark, table)
    assert sorted((r["month"], r["ride_id"]) for r in stored.collect()) == [("202401", "R1"), ("202402", "R2")]


def test_trips_are_not_dealt_to_tasks_by_month(spark, tmp_path, monkeypatch):
    """However large the tables look to the planner, the months to ingest are a broadcast side."""
    plans = []
    label = ST.label_rows

    def seen(trips, file_column):
        plans.append(trips._jdf.queryExecution().executedPlan().toString())
        return label(trips, file_column)

    monkeypatch.setattr(ST, "label_rows", seen)
    january = month_rows(spark, tmp_path, "202401", ride("R1", "2024-01-03"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = ST.ingest_new_months(january, str(tmp_path / "trips"))
        assert [(r["month"], r["rows_out"]) for r in log.collect()] == [("202401", 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "Exchange hashpartitioning(month" not in plans[0]


def test_stream_takes_each_file_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    table, log, state = (str(tmp_path / n) for n in ("trips", "log", "state"))

    def run():
        IN.ingest_available(IN.csv_stream(spark, str(raw), HEADER.split(",")), table, log, state)
        return sorted((r["month"], r["ride_id"]) for r in TF.read_trips(spark, table).collect())

    first = [HEADER, ride("R1", "2024-01-03"), ride("R1", "2024-01-03"), ride("R3", "2024-01-09")]
    (raw / "202401.csv").write_text("\n".join(first))
    assert run() == [("202401", "R1"), ("202401", "R3")]
    assert run() == [("202401", "R1"), ("202401", "R3")]
    (raw / "202402.csv").write_text("\n".join([HEADER, ride("R2", "2024-02-03")]))
    assert run()[-1] == ("202402", "R2")
    counts = spark.read.parquet(log).orderBy("month").collect()
    assert [(r["rows_in"], r["duplicate"], r["rows_out"]) for r in counts] == [(3, 1, 2), (1, 0, 1)]


def test_stream_cleans_a_month_once_a_run(spark, tmp_path, monkeypatch):
    """Three files of one month in three batches; then a run that breaks off before it cleans."""
    raw = tmp_path / "raw"
    raw.mkdir()
    table, log, state = (str(tmp_path / n) for n in ("trips", "log", "state"))
    cleaned, label = [], IN.label_rows
    monkeypatch.setattr(IN, "label_rows", lambda rows, c: cleaned.append(1) or label(rows, c))

    def run():
        stream = IN.csv_stream(spark, str(raw), HEADER.split(","), files_per_batch=1)
        IN.ingest_available(stream, table, log, state)
        return spark.read.parquet(log).first()["rows_in"]

    def add(day):
        (raw / f"202401-{day}.csv").write_text("\n".join([HEADER, ride(f"R{day}", f"2024-01-0{day}")]))

    for day in (1, 2, 3):
        add(day)
    assert (run(), len(cleaned)) == (3, 1)
    assert (run(), len(cleaned)) == (3, 1)
    add(4)
    with monkeypatch.context() as broken:
        broken.setattr(IN, "clean_touched_months", lambda *_: None)
        assert run() == 3
    assert (run(), len(cleaned)) == (4, 2)
    assert TF.read_trips(spark, table).count() == 4


def test_snapshot_round_trip_restores_missing_labels(spark, tmp_path):
    schema = "model string, ts timestamp_ntz, y double, yhat double, holiday_name string, extra int"
    df = spark.createDataFrame([("m", None, 1.1, 2.0, "<NA>", 1), ("m", None, 1.0, 2.0, "May Day", 1)], schema)
    path = str(tmp_path / "snap")
    ST.write_snapshot(df, path)
    stored = spark.read.parquet(path)
    assert "extra" not in stored.columns and dict(stored.dtypes)["y"] == "float"
    got = ST.load_snapshot(spark, path)
    assert sorted(r["holiday_name"] or "" for r in got.collect()) == ["", "May Day"]


def test_month_is_found_in_every_kind_of_path(spark):
    paths = ["file:/x/202401.csv", "trips_202402.parquet", "s3://b/raw/trips=202403/part-0.csv",
             "202404-city-tripdata.zip"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(TF.month_of_trip_file(F.col("p")))
    assert [r[0] for r in df.collect()] == ["202401", "202402", "202403", "202404"]
