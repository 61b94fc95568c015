from datetime import date

import numpy as np
import pytest
from helpers import frame, rows_by
from pyspark.sql import functions as F

from velotide.functions.columns import haversine_m
from velotide.functions.quantiles import exact_median
from velotide.operators import stations as S

LAT, LNG = 42.36, -71.06
SCHEMA = ("station_id string, name string, n_names long, lat double, lng double, "
          "first_seen date, last_seen date, n_trip_ends long")  # fmt: skip
FIRST, LAST = date(2024, 1, 1), date(2026, 9, 30)


def station(sid, name, dlat, first=FIRST, last=LAST, n=1000, dlng=0.0, lng=LNG):
    return {"station_id": sid, "name": name, "n_names": 1, "lat": LAT + dlat, "lng": lng + dlng,
            "first_seen": first, "last_seen": last, "n_trip_ends": n}


CASES = [
    # The old ID ends on the day on which the new one starts.
    station("S_NEW", "Quay Rd at Pier 4", 0.0, date(2024, 8, 2)),
    station("S_OLD", "Quay Rd / Pier 4", 0.0, last=date(2024, 8, 2)),
    # A brief ID on top of a busy one.
    station("G_BIG", "Mill Pond", 0.01, n=50_000),
    station("G_TMP", "Mill Pond", 0.01, date(2025, 3, 3), date(2025, 3, 20), 9),
    # 17 m apart and both in use all along.
    station("N_ONE", "Union Sq", 0.02),
    station("N_TWO", "Union Sq East", 0.02015),
    # The same name, 145 m apart, one after the other.
    station("M_OLD", "Weir St. at Lock Ln", 0.03, last=date(2025, 5, 1)),
    station("M_NEW", "Weir St at Lock Ln.", 0.0313, date(2025, 5, 6)),
    # The same name, but far apart.
    station("F_ONE", "High St", 0.04, last=date(2024, 6, 1)),
    station("F_TWO", "High St", 0.05, date(2024, 7, 1)),
    # 145 m apart, one after the other, but under different names.
    station("D_ONE", "Fern Way", 0.06, last=date(2024, 6, 1)),
    station("D_TWO", "Moss Way", 0.0613, date(2024, 7, 1)),
]


@pytest.fixture(scope="module")
def stats(spark):
    return frame(spark, CASES, SCHEMA)


def test_distance_scale(spark):
    args = [F.lit(v) for v in (LAT, LNG, LAT + 0.0001, LNG)]
    assert abs(spark.range(1).select(haversine_m(*args)).first()[0] - 11.12) < 0.01


def test_each_merge_rule_and_its_near_miss(stats):
    got = {(r["id_a"], r["id_b"]): r["reason"] for r in S.find_merges(stats).collect()}
    assert got == {("S_NEW", "S_OLD"): "replacement", ("G_BIG", "G_TMP"): "ghost",
                   ("M_NEW", "M_OLD"): "replacement"}


def test_crowded_cells_are_sliced_without_losing_a_pair(spark, monkeypatch):
    """Many stations in one cell, found with slices of three pairs and by brute force."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        first = date(2024, 1, 1 + int(rng.integers(0, 20)))
        rows.append(station(f"C{i:02d}", f"Hub {i % 5}", float(rng.normal(0, 4e-4)), first,
                            date(2024, 2, 1 + int(rng.integers(0, 20))), dlng=float(rng.normal(0, 4e-4))))
    monkeypatch.setattr(S, "PAIRS_PER_TASK", 3)
    df = frame(spark, rows, SCHEMA)
    got = {(r["id_a"], r["id_b"]) for r in S.find_merges(df, ghost_max_days=20).collect()}

    def metres(a, b):
        la, lb = np.radians(a["lat"]), np.radians(b["lat"])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(
            np.radians(b["lng"] - a["lng"]) / 2) ** 2
        return 2 * 6_371_000 * np.arcsin(np.sqrt(h))

    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            d = metres(a, b)
            overlap = max(0, (min(a["last_seen"], b["last_seen"]) - max(a["first_seen"], b["first_seen"])).days)
            life = min((r["last_seen"] - r["first_seen"]).days + 1 for r in (a, b))
            if (d <= 50 and (life <= 20 or overlap <= 1)) or (
                a["name"] == b["name"] and d <= 200 and overlap <= 1
            ):
                want.add((a["station_id"], b["station_id"]))
    assert got == want and len(want) > 20


def test_neighbours_across_the_date_line_and_near_the_pole(spark):
    rows = [
        station("E", "x", 0, last=date(2024, 2, 1), lng=179.9999),
        station("W", "y", 0, date(2024, 3, 1), lng=-179.9999),
        station("P1", "p", 89.9 - LAT, last=date(2024, 2, 1), lng=10.0),
        station("P2", "q", 89.9 - LAT, date(2024, 3, 1), lng=10.1),
    ]
    got = {(r["id_a"], r["id_b"]) for r in S.find_merges(frame(spark, rows, SCHEMA)).collect()}
    assert got == {("E", "W"), ("P1", "P2")}


def test_crosswalk_points_at_the_station_of_today(stats):
    got = rows_by(S.build_crosswalk(stats, S.find_merges(stats)), "station_id")
    names = {k: r["canonical_id"] for k, r in got.items()}
    assert names["S_OLD"] == names["S_NEW"] == "S_NEW"
    assert names["G_TMP"] == "G_BIG" and names["M_OLD"] == "M_NEW"
    assert names["N_ONE"] == "N_ONE" and names["N_TWO"] == "N_TWO"
    assert len(names) == len(CASES)


def test_components_of_long_chains_and_stars(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    star = [("hub", f"leaf{i}") for i in range(50)]
    edges = spark.createDataFrame(chain[::2] + star + chain[1::2], "id_a string, id_b string")
    got = S.connected_components(edges).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {"c000": 41, "hub": 51}


def test_no_edges_no_components(spark):
    edges = spark.createDataFrame([], "id_a string, id_b string")
    assert S.connected_components(edges).count() == 0


def test_new_dock_next_to_a_top_station_is_flagged(spark, stats):
    late = frame(spark, [station("N_NEW", "Union Annex", 0.0201, date(2025, 6, 1))], SCHEMA)
    top = spark.createDataFrame([("N_ONE",)], "station_id string")
    got = S.neighbor_changes(stats.unionByName(late), top).collect()
    assert [(r["top_station"], r["neighbor"]) for r in got] == [("N_ONE", "N_NEW")]


def test_median_position_prefers_classic_bikes(spark):
    rows = [("A", "n", 1.0, 5.0, "electric_bike", None), ("A", "n", 2.0, None, "classic_bike", None),
            ("A", "n", 4.0, None, "classic_bike", None), ("B", "n", 1.0, 1.0, "electric_bike", None),
            ("B", "n", None, 2.0, "electric_bike", None)]
    ends = spark.createDataFrame(
        rows, "station_id string, name string, lat double, lng double, rideable_type string, ts timestamp_ntz"
    )
    got = rows_by(S.station_positions(ends), "station_id")
    assert (got["A"]["lat"], got["A"]["lng"]) == (3.0, 5.0)
    assert (got["B"]["lat"], got["B"]["lng"]) == (1.0, 1.5)


def test_exact_median_of_a_hot_group(spark):
    rng = np.random.default_rng(7)
    groups = {"hot": rng.normal(42.36, 1e-4, 5000), "two": np.array([1.0, 2.0]),
              "one": np.array([-71.06]), "wide": rng.uniform(-180, 180, 801)}
    rows = [(g, float(v), 1) for g, values in groups.items() for v in values]
    rows += [("weighted", 1.0, 3), ("weighted", 2.0, 2), ("even", 1.0, 2), ("even", 2.0, 2)]
    df = spark.createDataFrame(rows, "g string, value double, weight long")
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"]).collect()}
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.median(values), abs=1e-12)
    assert (got["weighted"], got["even"]) == (1.0, 1.5)
