import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from velotide.functions.columns import naive
from velotide.operators import closures as C
from velotide.operators import grid as G

START = datetime(2024, 1, 1)
DAYS = 100  # from January into April


@pytest.fixture(scope="module")
def hourly(spark):
    """Stations whose idle runs lie inside months, across their ends, over whole months, at both ends, everywhere and nowhere;
    and some with runs of random lengths around the limit."""
    hours = DAYS * 24
    february, march = 31 * 24, 60 * 24
    idle = {
        "inside": set(range(100, 148)) | set(range(200, 247)),
        "across": set(range(february - 20, february + 28)) | set(range(march - 47, march)),
        "month": set(range(february - 5, march + 5)),
        "ends": set(range(48)) | set(range(hours - 50, hours)),
        "short_ends": set(range(47)) | set(range(hours - 47, hours)),
        "never": set(range(hours)),
        "always": set(),
    }
    rng = random.Random(5)
    for k in range(4):
        runs, at = set(), 0
        while at < hours:
            length = rng.choice([1, 30, 47, 48, 49, 200, 900])
            runs |= set(range(at, at + length))
            at += length + rng.choice([1, 2, 50])
        idle[f"random{k}"] = {h for h in runs if h < hours}
    rows = [
        (s, START + timedelta(hours=h), 0 if h in off else h % 2, 0 if h in off else 1 - h % 2)
        for s, off in idle.items()
        for h in range(hours)
    ]
    return spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, departures int, arrivals int").cache()


def flags(df):
    return sorted((r.station_id, r.ts, r.in_service) for r in df.collect())


CUTS = {
    "months": "trunc(CAST(ts AS DATE), 'month')",
    "weeks": "trunc(CAST(ts AS DATE), 'week')",
    "hours": "ts",
    "uneven": "CAST(power(datediff(ts, DATE'2023-12-31'), 0.4) AS INT)",
    "whole": "1",
}


@pytest.mark.parametrize("cut", CUTS)
def test_mask_is_that_of_the_whole_series_for_every_cut(hourly, cut):
    runs = C.closed_runs(C.idle_summaries(hourly, F.expr(CUTS[cut])))
    assert flags(C.flag_from_runs(hourly, runs)) == flags(G.flag_in_service(hourly))


def test_merging_is_associative(hourly):
    days = C.idle_summaries(hourly, F.expr(CUTS["weeks"]))
    once = C.merge_summaries(days)
    halves = C.merge_summaries(days, piece=F.col("low") < naive(datetime(2024, 2, 10)))
    fourths = C.merge_summaries(days, piece=F.month("low"))
    for grouped in (halves, fourths):
        twice = C.merge_summaries(grouped)
        assert sorted(twice.collect()) == sorted(once.collect())


def test_mask_as_of_is_that_of_the_slice(hourly):
    runs = C.closed_runs(C.idle_summaries(hourly, F.expr(CUTS["months"])))
    for cutoff in (START, START + timedelta(days=1), datetime(2024, 2, 1, 5), datetime(2024, 3, 2), datetime(2024, 5, 1)):
        got = C.flag_as_of(hourly, runs, naive(cutoff))
        assert flags(got) == flags(G.visible_before(hourly, cutoff))


def test_a_new_month_leaves_the_stored_ones_alone(spark, hourly, tmp_path):
    table = str(tmp_path / "summaries")
    by_month = [hourly.filter(F.month("ts") == m) for m in (1, 2, 3, 4)]

    def files():
        return {p: p.stat().st_mtime_ns for p in Path(table).rglob("*.parquet")}

    for k, month in enumerate(by_month, 1):
        before = files() if k > 1 else {}
        C.store_summaries(month, table)
        after = files()
        assert before.items() <= after.items()
        assert {p.parent.name for p in after.keys() - before.keys()} == {f"month=2024-0{k}"}
        seen = hourly.filter(F.month("ts") <= k)
        assert flags(C.flag_from_runs(month, C.stored_runs(spark, table))) == [
            f for f in flags(G.flag_in_service(seen)) if f[1].month == k
        ]
    # A corrected month takes the place of the first delivery, and another order of arrival changes nothing.
    fixed = by_month[1].withColumn("arrivals", F.when(F.day("ts") == 10, 1).otherwise(F.col("arrivals")))
    C.store_summaries(fixed, table)
    corrected = by_month[0].union(fixed).union(by_month[2]).union(by_month[3])
    assert flags(C.flag_from_runs(corrected, C.stored_runs(spark, table))) == flags(G.flag_in_service(corrected))


def test_pieces_that_do_not_adjoin_are_refused(hourly):
    pieces = C.idle_summaries(hourly.filter("station_id = 'inside'"), F.month("ts"))
    for wrong in (pieces.filter("piece <> 2"), pieces.union(pieces.filter("piece = 2"))):
        with pytest.raises(Exception, match="do not adjoin"):
            C.closed_runs(wrong).collect()


def test_no_hours_no_runs(hourly):
    none = hourly.limit(0)
    runs = C.closed_runs(C.idle_summaries(none, F.month("ts")))
    assert runs.count() == 0
    assert C.flag_from_runs(hourly.filter("station_id = 'never'"), runs).filter("NOT in_service").count() == 0


def test_one_shuffle_for_the_summaries(hourly):
    plan = C.idle_summaries(hourly, F.month("ts"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
