from datetime import datetime, timedelta

import pytest
from helpers import START, hourly, rows_by
from pyspark.sql import functions as F

from velotide.operators import grid as G

END = datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def trips(spark):
    day = "2024-01-01"
    rows = [
        (f"{day} 06:10", f"{day} 06:30", "P", "Q"),
        (f"{day} 06:50", f"{day} 07:05", "P", "Q"),
        (f"{day} 15:00", f"{day} 15:20", "Q_OLD", "R"),  # an old ID of Q
        (f"{day} 12:00", f"{day} 12:30", "P", None),
        (f"{day} 23:40", "2024-01-02 00:20", "Q", "P"),  # ends past the range
        ("2023-12-31 20:00", "2023-12-31 20:30", "P", "Q"),
        (f"{day} 00:00", f"{day} 00:59", None, "P"),
    ]
    text = "started_at string, ended_at string, start_station_id string, end_station_id string"
    df = spark.createDataFrame(rows, text)
    for c in ("started_at", "ended_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@pytest.fixture(scope="module")
def crosswalk(spark):
    pairs = [("P", "P"), ("Q", "Q"), ("Q_OLD", "Q"), ("R", "R")]
    return spark.createDataFrame(pairs, "station_id string, canonical_id string")


@pytest.mark.parametrize("selective", [False, True])
def test_zero_filled_counts(spark, trips, crosswalk, selective):
    stations = spark.createDataFrame([("P",), ("Q",)], "station_id string")
    grid = G.hourly_counts(trips, stations, START, END, crosswalk, selective)
    got = rows_by(grid, "station_id", "ts")
    assert len(got) == 48
    at = lambda s, h: got[(s, START + timedelta(hours=h))]
    assert at("P", 6)["departures"] == 2 and at("P", 3)["departures"] == 0
    assert at("Q", 6)["arrivals"] == 1 and at("Q", 7)["arrivals"] == 1
    assert at("Q", 15)["departures"] == 1  # counted under the station it became
    assert at("Q", 23)["departures"] == 1  # departs although it ends past the range
    assert sum(r["departures"] for r in got.values()) == 5
    assert sum(r["arrivals"] for r in got.values()) == 3
    assert all(r["net_flow"] == r["arrivals"] - r["departures"] for r in got.values())


def test_system_counts_every_station_with_an_id(trips):
    got = G.system_counts(trips, START, END).agg(
        F.count("*"), F.sum("departures"), F.sum("arrivals")
    ).first()
    assert tuple(got) == (24, 5, 4)


def test_only_long_closures_are_masked(spark):
    x = [1] * 20 + [0] * 10 + [1] * 10 + [0] * 50 + [1] * 10
    df = hourly(spark, {"X": (x, x), "Y": ([1] * 100, [0] * 100)}).orderBy(F.rand(1))
    got = rows_by(G.flag_in_service(df), "station_id", "ts")
    flags = [got[("X", START + timedelta(hours=i))]["in_service"] for i in range(100)]
    assert all(flags[:40]) and not any(flags[40:90]) and all(flags[90:])
    assert all(r["in_service"] for (s, _), r in got.items() if s == "Y")


def test_runs_do_not_cross_stations(spark):
    idle = [0] * 30
    df = hourly(spark, {"A": (idle, idle), "B": (idle, idle)})
    assert G.flag_in_service(df).filter("NOT in_service").count() == 0


def test_mask_as_of_equals_mask_of_the_slice(spark):
    """The arithmetic on whole runs against finding runs again on every slice."""
    pattern = [1] * 5 + [0] * 60 + [2] * 7 + [0] * 47 + [1] + [0] * 48 + [1] * 8
    df = hourly(spark, {"A": (pattern, pattern), "B": (pattern[::-1], [0] * len(pattern))})
    hours = [3, 20, 52, 53, 54, 66, 100, 119, 121, 168, 169, 176]
    cutoffs = [START + timedelta(hours=h) for h in hours]
    together = G.visible_before_each(df, cutoffs).select("cutoff", "station_id", "ts", "in_service")
    got = sorted(tuple(r) for r in together.collect())
    want = []
    for c in cutoffs:
        sliced = G.flag_in_service(df.filter(F.col("ts") < F.lit(str(c)).cast("timestamp_ntz")))
        want += [(c, r["station_id"], r["ts"], r["in_service"]) for r in sliced.collect()]
    assert got == sorted(want)


def test_holes_in_the_grid_are_refused(spark):
    df = hourly(spark, {"A": (range(10), range(10))})
    assert G.require_complete_grid(df) is df
    with pytest.raises(ValueError, match="complete"):
        G.require_complete_grid(df.filter("departures <> 4"))


def test_session_zone_does_not_bend_hours(spark, trips):
    """2 am of 10 March 2024 does not exist in New York; a naive stamp of it must stay."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS started_at").withColumns(
            {
                "ended_at": F.col("started_at"),
                "start_station_id": F.lit("A"),
                "end_station_id": F.lit("A"),
            }
        )
        got = G.departures_by_hour(df, datetime(2024, 3, 10), datetime(2024, 3, 11)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got["ts"] == datetime(2024, 3, 10, 2)


def test_empty_hours_are_neither_aggregated_nor_sent(spark, monkeypatch):
    """Ten stations of 48 hours, four to a task: hours unfold after the last shuffle, windows included."""
    monkeypatch.setattr(G, "GRID_ROWS", 4 * 48)
    trips = spark.range(30).select(
        F.concat(F.lit("S"), (F.col("id") % 9).cast("string")).alias("start_station_id"),
        F.lit(START + timedelta(hours=5)).cast("timestamp_ntz").alias("started_at"),
        F.lit("S8").alias("end_station_id"),
        F.lit(START + timedelta(hours=47, minutes=59)).cast("timestamp_ntz").alias("ended_at"),
    )
    stations = spark.range(10).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("station_id"))
    grid = G.flag_in_service(G.hourly_counts(trips, stations, START, START + timedelta(hours=48)))
    above = grid._jdf.queryExecution().executedPlan().toString().split("Generate explode(sequence")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    assert grid.rdd.getNumPartitions() == 3
    rows = grid.collect()
    assert len({(r["station_id"], r["ts"]) for r in rows}) == len(rows) == 480
    assert sum(r["departures"] for r in rows) == 30 and sum(r["arrivals"] for r in rows) == 30
    assert {r["ts"].hour for r in rows if r["departures"]} == {5}
    assert [r["arrivals"] for r in rows if r["arrivals"]] == [30]


def test_ends_are_dealt_before_they_are_folded(spark, monkeypatch):
    """Sixty ends, twenty to a task: no task folds all ends of its part of the input, and a busy hour is folded once."""
    monkeypatch.setattr(G, "GRID_ROWS", 20)
    minute = F.make_interval(mins=F.col("id").cast("int"))
    at = F.lit(START + timedelta(hours=5)).cast("timestamp_ntz") + minute
    trips = spark.range(30).select(
        F.concat(F.lit("S"), (F.col("id") % 9).cast("string")).alias("start_station_id"),
        at.alias("started_at"),
        F.lit("S8").alias("end_station_id"),
        (at + timedelta(hours=1)).alias("ended_at"),
    )
    stations = spark.range(10).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("station_id"))
    grid = G.hourly_counts(trips, stations, START, START + timedelta(hours=48))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    dealt = [part for part in plan.split("Exchange hashpartitioning(") if "Generate inline" in part]
    assert len(dealt) == 1 and "Aggregate" not in dealt[0]
    assert "share" in dealt[0].split(")")[0] and ", 3" in dealt[0].split(")")[0]
    rows = grid.collect()
    assert len({(r["station_id"], r["ts"]) for r in rows}) == len(rows) == 480
    assert {r["ts"].hour: r["arrivals"] for r in rows if r["arrivals"]} == {6: 30}
    assert sum(r["departures"] for r in rows if r["ts"].hour == 5) == 30
