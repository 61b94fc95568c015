from datetime import datetime

import pytest
from pyspark.sql import functions as F

from velotide.functions.columns import strip_to_null
from velotide.operators import cleaning as C
from velotide.sources.trip_files import read_raw_csv

HEADER = (
    "ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,"
    "end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual"
)
TAIL = "42.1,-71.1,42.2,-71.2,member"
NEW = f"""{HEADER}
A1,classic_bike,2024-02-03 10:00:00,2024-02-03 10:09:00,First St,K1,Second St,K2,{TAIL}
A2,electric_bike,2024-02-03 11:00:00.125,2024-02-03 11:20:00.500,"Third, St",K3,Second St,K2,{TAIL}
A1,classic_bike,2024-02-03 12:00:00,2024-02-03 12:09:00,First St,K1,Second St,K2,{TAIL}
A3,classic_bike,soon,2024-02-03 10:09:00,First St,K1,Second St,K2,{TAIL}
A4,classic_bike,2024-02-03 10:09:00,2024-02-03 10:00:00,First St,K1,Second St,K2,{TAIL}
A5,classic_bike,2024-02-03 10:00:00,2024-02-03 10:00:59.999,First St,K1,Second St,K2,{TAIL}
A6,classic_bike,2024-02-03 10:00:00,2024-02-04 10:00:00.001,First St,K1,Second St,K2,{TAIL}
A7,classic_bike,2024-02-03 10:00:00,2024-02-03 10:09:00,City TEST dock,K9,Second St,K2,{TAIL}
A8,classic_bike,2024-02-03 10:00:00,2024-02-03 10:09:00,First St,K1,North Warehouse 4,K8,{TAIL}
A9,classic_bike,2024-02-03 10:00:00,2024-02-03 10:09:00,,,  ,,{TAIL}
B1,electric_bike,2024-02-03 10:00:00,2024-02-04 10:00:00,NA,"  K1\t",,,x,,42.2,-71.2,casual
"""
LEGACY = """tripduration,starttime,stoptime,start station id,start station name,start station latitude,start station longitude,end station id,end station name,end station latitude,end station longitude,bikeid,usertype,postal code
60,"2022-05-01 00:00:00.5000","2022-05-01 00:09:00.5000",12,Elm,42.1,-71.1,13,Oak,42.2,-71.2,77,Subscriber,01234
60,"2022-05-01 00:00:00.5000","2022-05-01 00:09:00.5000",12,Elm,42.1,-71.1,13,Oak,42.2,-71.2,77,Subscriber,01234
60,"2022-05-01 00:00:00.5000","2022-05-01 00:09:00.5000",12,Elm,42.1,-71.1,13,Oak,42.2,-71.2,78,Customer,
60,"2022-05-01 00:00:00.5000","2022-05-01 00:09:00.5000",12,Elm,42.1,-71.1,13,Oak,42.2,-71.2,78,Visitor,
"""


@pytest.fixture(scope="module")
def new(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "202402.csv"
    path.write_text(NEW)
    return read_raw_csv(spark, str(path))


@pytest.fixture(scope="module")
def legacy(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "202205.csv"
    path.write_text(LEGACY)
    return read_raw_csv(spark, str(path))


def test_schema_is_told_from_the_header(new, legacy):
    assert C.detect_schema(new.columns) == "new"
    assert C.detect_schema([f" {c.upper()}" for c in legacy.columns]) == "legacy"
    with pytest.raises(ValueError):
        C.detect_schema(["a", "b"])


def test_both_schemas_become_the_same_table(new, legacy):
    one, two = C.normalize(new), C.normalize(legacy)
    assert one.columns[:13] == list(C.UNIFIED_COLUMNS)
    assert one.dtypes == two.dtypes


def test_values_are_parsed_and_stripped(new, legacy):
    by_id = {r["ride_id"]: r for r in C.normalize(new).collect()}
    assert by_id["A2"]["started_at"] == datetime(2024, 2, 3, 11, 0, 0, 125000)
    assert by_id["A2"]["start_station_name"] == "Third, St"
    assert by_id["A3"]["started_at"] is None
    odd = by_id["B1"]
    assert (odd["start_station_id"], odd["end_station_id"]) == ("K1", None)
    assert odd["start_station_name"] == "NA"
    assert (odd["start_lat"], odd["start_lng"], odd["end_lat"]) == (None, None, 42.2)
    old = C.normalize(legacy).orderBy("row_order").collect()
    assert [r["member_type"] for r in old] == ["member", "member", "casual", None]
    assert old[0]["started_at"] == datetime(2022, 5, 1, 0, 0, 0, 500000)


def test_each_rule_removes_its_row(new):
    kept, counts = C.apply_rules(C.normalize(new))
    row = counts.first().asDict()
    assert {r: row[r] for r in C.RULES} == {
        "duplicate": 1,
        "unparseable_time": 1,
        "duration_nonpositive": 1,
        "duration_under_60s": 1,
        "duration_over_24h": 1,
        "test_station": 2,
        "no_station": 1,
    }
    rows = kept.orderBy("ride_id").collect()
    assert [r["ride_id"] for r in rows] == ["A1", "A2", "B1"]
    assert rows[0]["started_at"].hour == 10  # the first copy in the file
    assert row["rows_in"] - sum(row[r] for r in C.RULES) == row["rows_out"] == 3


def test_legacy_copies_are_equal_in_everything(legacy):
    _, counts = C.apply_rules(C.normalize(legacy))
    assert (counts.first()["duplicate"], counts.first()["rows_out"]) == (1, 3)


def test_one_missing_id_makes_the_whole_row_the_key(new):
    typed = C.normalize(new)
    without = typed.withColumn("ride_id", F.when(F.col("ride_id") != "A9", F.col("ride_id")))
    assert C.apply_rules(without)[1].first()["duplicate"] == 0


def test_staff_words_need_word_boundaries_or_a_known_id(spark):
    names = ["Contest Plaza", "Testament Ave", "a test", "DEPOT 3", "Depots", "bcu", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    hit = C.is_staff_station(F.lit("K1"), F.col("name"))
    assert [r[0] for r in df.select(hit).collect()] == [False, False, True, True, False, True, False]
    assert df.select(C.is_staff_station(F.lit("X32999"), F.lit("Any"))).first()[0]


def test_a_third_of_all_rows_being_copies_changes_nothing(spark):
    hot = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS ride_id", "id")
    start = F.lit("2024-01-01 08:00:00").cast("timestamp_ntz")
    trips = hot.select(
        *[
            F.col("ride_id") if c == "ride_id" else
            start.alias(c) if c == "started_at" else
            (start + F.expr("INTERVAL '5' MINUTE")).alias(c) if c == "ended_at" else
            F.lit(1.0).alias(c) if c in C.NUMBER_COLUMNS else F.lit("K").alias(c)
            for c in C.UNIFIED_COLUMNS
        ],
        F.lit("f").alias("source_file"),
        F.col("id").alias("row_order"),
    )
    counts = C.removed_counts(C.label_rows(trips)).first()
    assert (counts["rows_in"], counts["duplicate"], counts["rows_out"]) == (30_000, 9_999, 20_001)


def test_distinct_trips_keeps_reused_ids_and_unnamed_rows(spark):
    t, later = datetime(2024, 1, 31, 23, 50), datetime(2024, 2, 5, 9, 0)
    rows = [("A", t, 1), ("A", t, 1), ("B", t, 1), ("B", later, 1), (None, t, 1), (None, t, 2),
            (None, t, 2)]
    trips = spark.createDataFrame(rows, "ride_id string, started_at timestamp_ntz, n int")
    few = C.distinct_trips(trips)
    many = C.distinct_trips(trips, max_suspects=0)
    key = lambda r: repr(tuple(r))
    assert few.count() == 5 and sorted(few.collect(), key=key) == sorted(many.collect(), key=key)


def test_strip_knows_every_white_space(spark):
    df = spark.createDataFrame([("\u2003a b\xa0\n",), (" \t\u3000",), (None,)], "t string")
    assert [r[0] for r in df.select(strip_to_null(F.col("t"))).collect()] == ["a b", None, None]


def test_times_are_cut_to_milliseconds(spark):
    texts = ["2024-03-10 02:30:59.999999", "2024-03-10T02:30:00.0015", "1969-12-31 23:59:59.123456",
             "2024-03-10", "", "n/a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.parse_time(F.col("t"))).collect()] == [
        datetime(2024, 3, 10, 2, 30, 59, 999000), datetime(2024, 3, 10, 2, 30, 0, 1000),
        datetime(1969, 12, 31, 23, 59, 59, 123000), datetime(2024, 3, 10), None, None, None]
