"""Raw files to reports through every stage, on two months of made-up rides."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import commute
from pyspark.sql import functions as F
from test_cleaning import HEADER

from velotide.plans import workflow as WF

START, DAYS = datetime(2024, 1, 1), 60  # January and February
WEEK = date(2024, 2, 19)


def write_rides(folder):
    rng = np.random.default_rng(11)
    files = {"202401": [], "202402": []}
    n = 0
    for i, name in enumerate(("Ash", "Birch", "Cedar")):
        other = ("Birch", "Cedar", "Ash")[i]
        for h, count in enumerate(commute(DAYS, 30 + i, 1.5)):
            for _ride in range(count):
                n += 1
                at = START + timedelta(hours=h, minutes=int(rng.integers(0, 50)))
                # Birch gets a new ID on the same spot in February.
                ids = {"Ash": "A1", "Birch": "B1" if at.month == 1 else "B2", "Cedar": "C1"}
                spots = {"Ash": 42.30, "Birch": 42.32, "Cedar": 42.34}
                files[f"{at:%Y%m}"].append(
                    f"R{n},classic_bike,{at},{at + timedelta(minutes=5)},{name} St,{ids[name]},"
                    f"{other} St,{ids[other]},{spots[name]},-71.1,{spots[other]},-71.1,member"
                )
    for month, lines in files.items():
        extra = [lines[0], lines[0].replace("R", "Q", 1).replace("classic_bike", "x").replace(":", "", 1)]
        (folder / f"{month}.csv").write_text("\n".join([HEADER, *lines, *extra]) + "\n")
    return n


def write_weather(path):
    hours = DAYS * 24 + 48
    rng = np.random.default_rng(2)
    times = [(START - timedelta(hours=24) + timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M") for i in range(hours)]
    body = {"hourly": {"time": times, "temperature_2m": list(rng.normal(4, 3, hours)),
                       "precipitation": list(rng.exponential(0.1, hours)),
                       "wind_speed_10m": list(rng.gamma(2, 4, hours))}}
    path.write_text(json.dumps(body))


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("workflow")
    (folder / "raw").mkdir()
    rides = write_rides(folder / "raw")
    write_weather(folder / "weather.json")
    p = WF.Project(spark, str(folder / "root"), test_weeks=(WEEK,), rank=(date(2024, 1, 1), date(2024, 2, 1)),
                   val_days=7, yearly=False)
    log = WF.ingest(p, csv=str(folder / "raw" / "*.csv"))
    assert log.agg(F.sum("rows_out"), F.sum("duplicate")).first() == (rides, 2)
    again = WF.ingest(p, csv=str(folder / "raw" / "*.csv"))
    assert again.collect() == log.collect()
    WF.build_stations(p)
    WF.build_hourly(p)
    for source in ("forecast", "actual"):
        WF.build_weather(p, source, str(folder / "weather.json"))
    WF.build_features(p)
    WF.backtest(p)
    WF.backtest(p, models=(WF.ADDITIVE,), levels=("stations",), weather_source="actual")
    return p, rides


def test_renamed_station_is_one_series(project):
    p, rides = project
    crosswalk = {r["station_id"]: r["canonical_id"] for r in p.read("crosswalk").collect()}
    assert crosswalk == {"A1": "A1", "B1": "B2", "B2": "B2", "C1": "C1"}
    hourly = p.read("hourly")
    assert hourly.count() == 3 * DAYS * 24
    assert hourly.agg(F.sum("departures")).first()[0] == rides
    assert p.read("hourly_system").agg(F.sum("departures")).first()[0] == rides


def test_every_model_is_scored_on_the_same_rows(project):
    p, _ = project
    tables = WF.report(p)
    stations = tables["stations"].collect()
    assert [r["model"] for r in stations[:4]] == ["seasonal_naive", "additive", "global", "historical_average"]
    assert {r["n"] for r in stations} == {3 * 168}
    skills = {r["model"]: r["skill"] for r in stations[:4]}
    assert skills["additive"] > 0 and skills["global"] > 0
    assert {r["model"] for r in tables["system"].collect()} == {"seasonal_naive", "historical_average", "additive"}
    assert tables["weather_sensitivity"].first()["model"] == "additive"
    assert tables["intervals"].filter("group = 'all'").first()["n"] == 2 * 3 * 168


def test_labels_and_snapshot(project):
    p, _ = project
    named = WF.rebalancing(p, WF.GLOBAL)
    assert named.count() == 3 and {r["label"] for r in named.collect()} == {"too few days"}
    WF.snapshot(p)
    assert p.read("snapshot/stations").count() == 4 * 3 * 168 * 2
    assert p.read("snapshot/stations_info").count() == 3
