import json
from datetime import date, datetime, timedelta

import pytest
from helpers import rows_by

from velotide.operators import calendar as CA
from velotide.operators import grid as G
from velotide.operators import weather as W


def payload(spark, tmp_path, start, hours, holes=()):
    """A payload whose temperature is the number of the UTC hour."""
    times = [(start + timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M") for i in range(hours)]
    temps = [None if i in holes else float(i) for i in range(hours)]
    body = {"latitude": 1.0, "hourly": {"time": times, "temperature_2m": temps,
            "precipitation": [0.0] * hours, "wind_speed_10m": [10.0] * hours}}
    path = tmp_path / "weather.json"
    path.write_text(json.dumps(body, indent=1))
    return W.payload_rows(W.read_payload(spark, str(path)))


def local(spark, tmp_path, day, holes=()):
    rows = payload(spark, tmp_path, day, 48, holes)
    return W.to_local_grid(rows, day, day + timedelta(days=1))


def test_a_winter_day_is_five_hours_behind(spark, tmp_path):
    got = rows_by(local(spark, tmp_path, datetime(2024, 1, 15)), "ts")
    assert len(got) == 24
    assert [got[datetime(2024, 1, 15, h)]["temp_c"] for h in (0, 1, 23)] == [5.0, 6.0, 28.0]


def test_the_hour_lost_in_spring_is_interpolated(spark, tmp_path):
    got = rows_by(local(spark, tmp_path, datetime(2024, 3, 10)), "ts")
    assert len(got) == 24
    assert [got[datetime(2024, 3, 10, h)]["temp_c"] for h in (1, 2, 3)] == [6.0, 6.5, 7.0]


def test_the_hour_repeated_in_autumn_is_averaged(spark, tmp_path):
    got = rows_by(local(spark, tmp_path, datetime(2024, 11, 3)), "ts")
    assert len(got) == 24
    assert got[datetime(2024, 11, 3, 1)]["temp_c"] == 5.5


def test_only_two_points_of_a_gap_are_filled(spark, tmp_path):
    day = datetime(2024, 1, 15)
    grid = local(spark, tmp_path, day, holes=range(10, 20))
    got = rows_by(grid, "ts")
    temps = [got[day + timedelta(hours=h)]["temp_c"] for h in range(24)]
    assert temps[4:8] == [9.0, 10.0, 11.0, None] and temps[14:16] == [None, 20.0]
    with pytest.raises(ValueError, match="8 hours, first 2024-01-15 07:00"):
        W.require_no_gaps(grid)


def test_gaps_at_both_ends(spark):
    rows = [(datetime(2024, 1, 1, h), float(h) if 2 <= h <= 3 else None, 0.0, 1.0) for h in range(8)]
    grid = spark.createDataFrame(rows, "ts timestamp_ntz, temp_c double, precip_mm double, wind_kmh double")
    got = rows_by(W.interpolate(grid), "ts")
    temps = [got[datetime(2024, 1, 1, h)]["temp_c"] for h in range(8)]
    assert temps == [None, None, 2.0, 3.0, 3.0, 3.0, None, None]


@pytest.fixture(scope="module")
def cal(spark):
    spine = G.hour_spine(spark, datetime(2025, 1, 1), datetime(2026, 1, 1))
    return rows_by(CA.calendar_features(spine), "ts")


def test_calendar_fields(cal):
    assert len(cal) == 365 * 24
    row = cal[datetime(2025, 7, 4, 17)]
    assert (row["hour"], row["dow"], row["month"], row["is_weekend"]) == (17, 4, 7, False)
    assert row["is_holiday"] and row["holiday_name"] == "Independence Day"
    assert cal[datetime(2025, 4, 21, 9)]["holiday_name"] == "Patriots' Day"
    assert not cal[datetime(2025, 4, 22, 9)]["is_holiday"]
    assert cal[datetime(2025, 1, 11, 12)]["is_weekend"]
    semester = [cal[datetime(2025, *d)]["is_semester"] for d in
                ((1, 19), (1, 20), (5, 15), (5, 16), (7, 15), (9, 1), (12, 20), (12, 21))]
    assert semester == [False, True, True, False, False, True, True, False]


def test_holiday_rules(spark):
    years = spark.createDataFrame([(2021,), (2022,), (2023,), (2024,)], "year int")
    got = {r["date"]: r["holiday_name"] for r in CA.holidays(years).collect()}
    assert got[date(2024, 1, 15)] == "Martin Luther King Jr. Day"
    assert got[date(2024, 2, 19)] == "Washington's Birthday"
    assert got[date(2023, 5, 29)] == "Memorial Day" and got[date(2021, 5, 31)] == "Memorial Day"
    assert got[date(2024, 9, 2)] == "Labor Day" and got[date(2024, 10, 14)] == "Columbus Day"
    assert got[date(2023, 11, 23)] == "Thanksgiving Day"
    assert got[date(2022, 6, 20)] == "Juneteenth National Independence Day (observed)"
    assert got[date(2023, 11, 10)] == "Veterans Day (observed)"
    assert got[date(2021, 12, 31)] == "New Year's Day (observed)"
    assert date(2024, 3, 17) not in got
    more = {r["date"] for r in CA.holidays(years, evacuation_day=True).collect()}
    assert date(2024, 3, 17) in more
